"""Source and normalization queries (groups A and B) over text made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.functions import cells
from stintwise.functions.qualified import decimal_text, qualified
from stintwise.operators import normalize as nz
from stintwise.operators.audit import fingerprint
from stintwise.operators.normalize import ColumnMapping
from stintwise.operators.spread import literal_table, lookup_join, position_in
from stintwise.plans.bindings import (
    BINS_SQL, EVENTS_SQL, base_events, contexts, distance_bins, lap_table, samples, scale_of, table,
)
from stintwise.plans.registry import ROOT_SQL, query
from stintwise.session import shared_folder
from stintwise.sources import files, recorder, session_export
from stintwise.sources.files import reconcile_inventory
from stintwise.sources.inventory import read_inventory
from stintwise.sources.mapped_csv import records_from_rows
from stintwise.sources.quarantine import mapped_problems, set_apart

MAPPINGS = [
    ColumnMapping("time_s", "timestamp"), ColumnMapping("pos_m", "lap_distance"), ColumnMapping("speed_mps", "speed"),
    ColumnMapping("off", "off_track_state"), ColumnMapping("gear", "gear"),
    ColumnMapping("brake_pct", "brake", "derived", "percent divided by 100"), ColumnMapping("state", "session_state"),
]
TEXT_COLUMNS = "event_id STRING, time_s STRING, lap STRING, pos_m STRING, speed_mps STRING, off STRING, gear STRING, brake_pct STRING, state STRING, unused STRING"


def text_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as semicolon-separated lines, then as text cells: what a mapped CSV scan sees."""
    cell = F.coalesce
    line = F.concat_ws(
        ";", F.col("event_id").cast("string"), (F.col("micros") / F.lit(1e6)).cast("string"),
        F.col("lap_number").cast("string"), F.col("distance").cast("string"), cell(F.col("speed").cast("string"), F.lit("")),
        F.when(F.col("event_type") == "error", " Yes").when(F.col("event_type") == "click", "0").when(
            F.col("event_type") == "view", "maybe").otherwise(""),
        (F.col("event_id") % 7 - 1).cast("string"),
        F.when(F.col("event_type") == "view", "n/a").otherwise((F.col("distance") / 100).cast("string")),
        F.col("event_type"), F.lit("x"))
    parsed = F.from_csv(line, TEXT_COLUMNS, {"sep": ";", "mode": "FAILFAST", "nullValue": "\u0000"})
    rows = base_events(spark, sf).select("dataset_id", parsed.alias("r")).select("dataset_id", "r.*")
    return rows.na.fill("").withColumn("row_index", F.col("event_id").cast("long"))


MAPPED_SQL = "WITH " + EVENTS_SQL + """,
cells AS (SELECT event_id, dataset_id, micros / 1e6::DOUBLE AS time_s, distance AS pos, speed, event_type,
  CASE event_type WHEN 'error' THEN true WHEN 'click' THEN false END AS off, CAST(event_id % 7 - 1 AS DOUBLE) AS gear,
  CASE WHEN event_type <> 'view' THEN distance / 100 END AS brake FROM base)"""


@query("a1_mapped_rows", MAPPED_SQL + """
SELECT event_id, time_s AS timestamp, pos AS lap_distance, speed, off AS off_track_state, gear, brake, event_type AS session_state,
       CASE WHEN speed IS NULL THEN 'unavailable' ELSE 'measured' END AS speed_provenance,
       CASE WHEN brake IS NULL THEN 'unavailable' ELSE 'derived' END AS brake_provenance FROM cells""")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    rows = text_rows(spark, sf).select("event_id", nz.mapped_fields(MAPPINGS).alias("fields"))
    concepts = ("timestamp", "lap_distance", "speed", "off_track_state", "gear", "brake", "session_state")
    return rows.select(
        F.col("event_id").cast("long").alias("event_id"), *[F.col(f"fields.{c}.value").alias(c) for c in concepts],
        F.col("fields.speed.provenance").alias("speed_provenance"),
        F.col("fields.brake.provenance").alias("brake_provenance"))


@query("a2_bad_cells", "WITH " + EVENTS_SQL + """
SELECT CAST(event_id AS VARCHAR) AS event_id, 'off' AS "column", 'maybe' AS text FROM base WHERE event_type = 'view'
UNION ALL SELECT CAST(event_id AS VARCHAR), 'brake_pct', 'n/a' FROM base WHERE event_type = 'view'""")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return nz.bad_cells(text_rows(spark, sf), MAPPINGS, ["event_id"])


@query("a4_strict_scalars", """
SELECT o_orderkey, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN CAST(t AS BIGINT) END AS unsigned_value,
       CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag, try_cast(w AS DOUBLE) AS number
FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN '-' ELSE '' END || o_custkey AS t,
             CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '1-URGENT' THEN 'abc' ELSE substr(o_orderpriority, 1, 1) || '.5' END AS w FROM orders)""")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.when(F.col("o_orderstatus") == "P", "-").otherwise(""), F.col("o_custkey"))
    w = F.when(F.col("o_orderpriority") == "5-LOW", "").when(F.col("o_orderpriority") == "1-URGENT", "abc").otherwise(
        F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".5")))
    return table(spark, sf, "orders").select(
        "o_orderkey", cells.unsigned(t).alias("unsigned_value"),
        cells.strict_boolean(F.col("o_orderstatus"), ("O", "F")).alias("flag"), cells.finite(w).alias("number"))


def event_texts(rows: DataFrame, keep: list[str], sequence: str, kind: str, data: dict[str, Column]) -> DataFrame:
    """Rows as the JSON lines of an event log, in ``value``."""
    return rows.select(*keep, F.to_json(F.struct(
        F.lit("event/1").alias("schema_version"), F.col(sequence).alias("sequence"), F.lit("2024-01-01T00:00:00Z").alias("observed_utc"),
        F.lit(1.5).alias("session_time_s"), F.col(kind).alias("kind"),
        F.struct(*[c.alias(n) for n, c in data.items()]).alias("data"))).alias("value"))


@query("a8_event_payloads", """
SELECT event_id, 'event/1' AS schema_version, event_id AS sequence, event_type AS kind, 1.5::DOUBLE AS session_time_s,
       CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id FROM events""")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.try_parse_json("props").alias("props"))
    lines = event_texts(rows, ["event_id"], "event_id", "event_type", {"props": F.col("props"), "user": F.col("user_id")})
    return files.event_lines(lines, "event/1").where("problem is null").select(
        "event_id", "schema_version", "sequence", "kind", "session_time_s", files.payload("$.props.k", "bigint").alias("k"),
        files.payload("$.user", "bigint").alias("user_id"))


@query("a8_event_refusals", """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'not_json' WHEN 1 THEN 'shape' WHEN 2 THEN 'version' WHEN 3 THEN 'sequence'
  WHEN 4 THEN 'session_time' WHEN 5 THEN 'kind' ELSE 'data' END AS problem FROM events WHERE event_id % 8 < 7""")
def a8_refusals(spark: SparkSession, sf: str) -> DataFrame:
    # Every eighth line stays sound; the others are spoilt in one way each.
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    lines = event_texts(rows, ["event_id"], "event_id", "event_type", {"user": F.col("user_id")})
    way, value = F.col("event_id") % 8, F.col("value")
    spoilt = F.when(way == 0, F.expr("left(value, length(value) - 1)")).when(
        way == 1, F.replace(value, F.lit('"observed_utc"'), F.lit('"observed"'))).when(
        way == 2, F.replace(value, F.lit("event/1"), F.lit("event/2"))).when(
        way == 3, F.regexp_replace(value, '"sequence":([0-9]+)', '"sequence":"$1"')).when(
        way == 4, F.replace(value, F.lit("1.5"), F.lit("true"))).when(
        way == 5, F.regexp_replace(value, '"kind":"[a-z]+"', '"kind":""')).when(
        way == 6, F.regexp_replace(value, '"data":.*', '"data":[1]}')).otherwise(value)
    return files.event_lines(lines.withColumn("value", spoilt), "event/1").where("problem is not null").select("event_id", "problem")


def all_records(spark: SparkSession, sf: str) -> DataFrame:
    """Session, lap and sample records of all datasets, numbered."""
    s = samples(spark, sf)
    head = contexts(spark, sf).select(
        F.lit("session").alias("record_type"), "dataset_id", "session_id", F.col("session_id").alias("record_id"),
        "simulator", F.col("participant").alias("driver_id"), "car", "track", "layout",
        F.lit(-1).cast("long").alias("micros"))
    return nz.number_sequence(nz.unite([head, nz.laps_of(s, [], "micros"), s]), ["micros"], scale_of(sf).times(3))


RECORDS_SQL = "WITH " + EVENTS_SQL + """,
records AS (
  SELECT 'session' AS record_type, dataset_id, dataset_id AS record_id, -1 AS micros, 0 AS r FROM contexts
  UNION ALL SELECT 'lap', dataset_id, lap_id, start_micros, 1 FROM laps
  UNION ALL SELECT 'telemetry_sample', dataset_id, 'e' || event_id, micros, 3 FROM base)"""


@query("a9_union_of_record_types", RECORDS_SQL + """
SELECT dataset_id, record_type, count(*) AS n FROM records GROUP BY ALL""")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return all_records(spark, sf).groupBy("dataset_id", "record_type").agg(F.count(F.lit(1)).alias("n"))


@query("a11_inventory_reconcile", """
WITH d AS (SELECT doc_id, length(rtrim(text)) AS length, sha256(CASE WHEN toxic = 1 THEN upper(text) ELSE text END) AS h
           FROM documents JOIN labels USING (doc_id)
           UNION ALL SELECT -1 - item_id, length(text), sha256(text) FROM benchmark),
a AS (SELECT doc_id, length(text) AS length, sha256(text) AS h FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, d.length AS declared_length, a.length AS actual_length,
  CASE WHEN a.h IS NULL THEN 'missing' WHEN d.h IS NULL THEN 'undeclared' WHEN d.length <> a.length THEN 'size_mismatch'
       WHEN d.h <> a.h THEN 'hash_mismatch' ELSE 'ok' END AS status
FROM d FULL JOIN a USING (doc_id)""")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").select(
        F.col("doc_id").cast("string").alias("path"), F.length(F.rtrim("text")).cast("long").alias("length"),
        F.sha2(F.when(F.col("toxic") == 1, cells.simple_upper(F.col("text"))).otherwise(F.col("text")), 256).alias("sha256"))
    lost = table(spark, sf, "benchmark").select(
        (-1 - F.col("item_id")).cast("string").alias("path"), F.length("text").cast("long").alias("length"),
        F.sha2("text", 256).alias("sha256"))
    actual = docs.select(F.col("doc_id").cast("string").alias("path"), F.length("text").cast("long").alias("length"),
                         F.sha2("text", 256).alias("sha256"))
    return reconcile_inventory(labelled.unionByName(lost), actual)


@query("a12_source_identity", """
SELECT source AS dataset_id, CASE WHEN count(*) FILTER (lang = 'de') = 1 THEN max('sha256:' || sha256(text)) FILTER (lang = 'de') END AS identity,
       CASE WHEN count(*) FILTER (lang = 'de') > 1 THEN 'duplicate_identity_source' END AS problem
FROM documents GROUP BY source""")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(
        F.col("source").alias("dataset_id"), F.concat(F.col("lang"), F.lit(".txt")).alias("path"),
        F.sha2("text", 256).alias("sha256"))
    return nz.source_identity(files, "de.txt")


@query("b1_qualified_values", "WITH " + EVENTS_SQL + """
SELECT event_id, speed * 1000.0 AS value, CASE WHEN speed IS NULL THEN 'unavailable' ELSE 'derived' END AS provenance, 'Pa' AS unit,
       CASE WHEN speed IS NOT NULL THEN 'value * 1000' END AS derivation FROM base""")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    value = qualified(F.col("speed"), "tire_pressure_front_left", "value", scale=1000.0)
    return base_events(spark, sf).select("event_id", value.alias("q")).select(
        "event_id", "q.value", "q.provenance", "q.unit", "q.derivation")


@query("b3_text_concepts", "WITH " + EVENTS_SQL + """
SELECT event_id, CASE WHEN NOT incident THEN CAST(event_id % 5 AS VARCHAR) END AS value,
       CASE WHEN incident THEN 'unavailable' ELSE 'measured' END AS provenance, 'not-decoded' AS flags FROM base""")
def b3(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(~F.col("incident"), F.col("event_id") % 5)
    return base_events(spark, sf).select("event_id", decimal_text(code, "session_state", "code", "not-decoded").alias("q")).select(
        "event_id", "q.value", "q.provenance", F.concat_ws(",", "q.quality_flags").alias("flags"))


def recorder_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the text rows of a recorder bundle; columns it does not know stay blank."""
    stamp = F.expr("timestampadd(MICROSECOND, micros, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    iso = F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."),
                   F.lpad((F.col("micros") % 1_000_000).cast("string"), 6, "0"), F.lit("9Z"))
    known = {
        "capture_sequence": F.col("event_id").cast("string"), "simulator_tick": F.col("event_id").cast("string"),
        "observed_utc": iso,
        "session_time_s": F.when(F.col("event_type") == "view", "").otherwise((F.col("event_id") / 2).cast("string")),
        "lap": F.when(F.col("event_type") == "click", "").otherwise(F.col("lap_number").cast("string")),
        "speed_mps": F.coalesce(F.col("speed").cast("string"), F.lit("")),
        "lap_distance_fraction": (F.col("distance") / 100).cast("string"),
        "tire_cold_pressure_lf_kpa": F.col("distance").cast("string"),
        "track_surface": (F.col("event_id") % 4 - 1).cast("string"),
        "abs_active": F.when(F.col("incident"), "true").otherwise("false"),
        "incident_count": F.when(F.col("incident"), "1").otherwise("0"),
    }
    return base_events(spark, sf).select(*[
        (known[c] if c in known else F.lit("")).alias(c) for c in recorder.SAMPLE_COLUMNS])


SURFACES = {-1: "not_in_world", 0: "off_track", 1: "in_pit_stall"}
SESSION = {"dataset_id": "recorder", "session_id": "rec", "simulator": "sim", "driver_id": "p-1", "car": "c", "track": "t",
           "layout": "l"}


@query("b2_recorder_fields", "WITH " + EVENTS_SQL + """
SELECT event_id AS sample_index, speed, distance / 100 AS lap_fraction, distance * 1000.0 AS pressure, incident AS abs_active,
       CASE WHEN incident THEN '1' ELSE '0' END AS incident_state,
       CASE event_id % 4 - 1 WHEN 0 THEN true WHEN -1 THEN false WHEN 1 THEN false END AS off_track_state,
       CASE WHEN event_id % 4 - 1 = 2 THEN 'unavailable' ELSE 'derived' END AS off_track_provenance,
       'unavailable' AS throttle_provenance FROM base""")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    out = recorder.records(recorder_rows(spark, sf), SESSION, "2024-01-01T00:00:00Z", SURFACES, scale_of(sf).times(3))
    f = "fields."
    return out.filter("record_type = 'telemetry_sample'").select(
        "sample_index", F.col(f + "speed.value").alias("speed"), F.col(f + "lap_fraction.value").alias("lap_fraction"),
        F.col(f + "tire_pressure_front_left.value").alias("pressure"), F.col(f + "abs_active.value").alias("abs_active"),
        F.col(f + "incident_state.value").alias("incident_state"),
        F.col(f + "off_track_state.value").alias("off_track_state"),
        F.col(f + "off_track_state.provenance").alias("off_track_provenance"),
        F.col(f + "throttle.provenance").alias("throttle_provenance"))


@query("b4_session_clock", "WITH " + EVENTS_SQL + """
SELECT event_id, CASE WHEN event_type = 'view' THEN (micros - 1704067200000000) / 1e6::DOUBLE ELSE event_id / 2.0::DOUBLE END AS value,
       CASE WHEN event_type = 'view' THEN 'derived' ELSE 'measured' END AS provenance FROM base""")
def b4(spark: SparkSession, sf: str) -> DataFrame:
    clock = recorder.session_clock("2024-01-01T00:00:00Z")
    return recorder_rows(spark, sf).select(F.col("capture_sequence").cast("long").alias("event_id"), clock.alias("q")).select(
        "event_id", "q.value", "q.provenance")


@query("b5_iso_timestamps", "WITH " + EVENTS_SQL + """
SELECT event_id, CASE WHEN event_type <> 'error' THEN micros END AS micros FROM base""")
def b5(spark: SparkSession, sf: str) -> DataFrame:
    # Error rows lose their zone, which makes the text unusable.
    text = F.col("observed_utc")
    spoilt = F.when(F.col("abs_active") == "true", F.regexp_replace(text, "Z$", "")).otherwise(text)
    return recorder_rows(spark, sf).select(
        F.col("capture_sequence").cast("long").alias("event_id"), cells.iso_micros(spoilt).alias("micros"))


@query("b6_enum_decode", "WITH " + EVENTS_SQL + """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'off_track' WHEN 1 THEN 'on_track' WHEN 2 THEN 'in_pit_stall' END AS decoded FROM base""")
def b6(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = literal_table(spark, "code bigint, meaning string", [(0, "off_track"), (1, "on_track"), (2, "in_pit_stall")])
    rows = base_events(spark, sf).select("event_id", (F.col("event_id") % 4).alias("code"))
    return nz.decode_enum(rows, dictionary, [], "code", "meaning", scale_of(sf)).select("event_id", "decoded")


@query("b7_lap_records", "WITH " + EVENTS_SQL + """
SELECT 'lap' AS record_type, dataset_id, lap_id, lap_number, start_micros AS micros FROM laps""")
def b7(spark: SparkSession, sf: str) -> DataFrame:
    return nz.laps_of(samples(spark, sf), [], "micros").select("record_type", "dataset_id", "lap_id", "lap_number", "micros")


@query("b8_unmapped_columns", "WITH " + EVENTS_SQL + """
SELECT dataset_id, 'event_id,unused' AS unmapped, count(*) AS n FROM base GROUP BY dataset_id""")
def b8(spark: SparkSession, sf: str) -> DataFrame:
    rows = text_rows(spark, sf)
    header = F.array(*[F.lit(c.split()[0]) for c in TEXT_COLUMNS.split(", ")])
    mapped = [m.column for m in MAPPINGS] + ["lap"]
    return rows.withColumn("unmapped", F.concat_ws(",", nz.unmapped_columns(header, mapped))).groupBy(
        "dataset_id", "unmapped").agg(F.count(F.lit(1)).alias("n"))


@query("b9_sample_records", "WITH " + EVENTS_SQL + """
SELECT 's1.sample-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS record_id, 's1.lap-' || lpad(CAST(lap_number AS VARCHAR), 3, '0') AS lap_id,
       event_id + 2 AS row_start, event_id AS sample_index FROM base""")
def b9(spark: SparkSession, sf: str) -> DataFrame:
    session = {**SESSION, "session_id": "s1"}
    rows = text_rows(spark, sf).drop("dataset_id", "event_id")
    out = records_from_rows(rows, MAPPINGS, "lap", session, scale_of(sf).times(3), refuse=False)
    return out.filter("record_type = 'telemetry_sample'").select(
        "record_id", "lap_id", F.col("source_provenance.row_start").alias("row_start"), "sample_index")


@query("b10_distance_bin_records", "WITH " + BINS_SQL + """
SELECT lap_id, distance_m AS distance_bin_index, brake, CASE WHEN has_sample THEN 'derived' ELSE 'unavailable' END AS brake_provenance,
       concat_ws(',', CASE WHEN NOT has_sample THEN 'source_bin_unsampled' END, CASE WHEN NOT lap_is_valid THEN 'product_classified_excluded' END) AS flags
FROM bins""")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    # Lap ids stand in for lap numbers so that one call serves every dataset.
    bins = distance_bins(spark, sf).withColumns({
        "lap_number": F.col("lap_id"), "distance_m": F.col("distance_m").cast("double"),
        "steering_rad": F.lit(0.0)})
    valid = lap_table(spark, sf).select(F.col("lap_id").alias("lap_number"), "is_valid")
    numbered = lookup_join(bins, valid, ["lap_number"], "left", [F.col("distance_m")], scale_of(sf).times(10))
    fields = {c: qualified(F.when(F.col("has_sample"), F.col(s)), c, s, derivation="bin " + session_export.CHANNEL_METHODS[c])
              for c, s in (("brake", "brake"), ("throttle", "throttle"))}
    return numbered.select(
        "lap_id", F.floor("distance_m").alias("distance_bin_index"), fields["brake"].alias("b"),
        F.concat_ws(",", F.when(~F.col("has_sample"), "source_bin_unsampled"),
                    F.when(~F.col("is_valid"), "product_classified_excluded")).alias("flags")).select(
        "lap_id", "distance_bin_index", F.col("b.value").alias("brake"), F.col("b.provenance").alias("brake_provenance"), "flags")


@query("b11_lap_table_records", "WITH " + BINS_SQL + """
SELECT 's1-lap-' || lpad(CAST(row_number() OVER (ORDER BY lap_id) - 1 AS VARCHAR), 6, '0') AS record_id, is_valid AS lap_valid,
       CASE WHEN is_valid THEN '' ELSE 'product_classified_excluded' END AS flags FROM lap_table""")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    rows = position_in(lap_table(spark, sf).drop("lap_number").withColumn("all", F.lit(1)), ["all"], ["lap_id"],
                       "lap_number", scale_of(sf)).withColumn("lap_time_seconds", F.col("coverage_fraction"))
    return session_export.lap_records(rows, "d1", "s1").select(
        "record_id", F.col("fields.lap_valid.value").alias("lap_valid"), F.concat_ws(",", "quality_flags").alias("flags"))


@query("b12_sequence_index", RECORDS_SQL + """
SELECT dataset_id, record_type, record_id, row_number() OVER (PARTITION BY dataset_id ORDER BY micros, r, record_id) - 1 AS sequence_index FROM records""")
def b12(spark: SparkSession, sf: str) -> DataFrame:
    return all_records(spark, sf).select("dataset_id", "record_type", "record_id", "sequence_index")


@query("b13_capabilities", "WITH " + EVENTS_SQL + """
SELECT dataset_id, 'brake,gear,lap_distance,off_track_state,session_state,speed,timestamp' AS available, 34::BIGINT AS unavailable_count
FROM contexts""")
def b13(spark: SparkSession, sf: str) -> DataFrame:
    per = contexts(spark, sf).select("dataset_id", F.inline(nz.capability_rows(MAPPINGS)))
    return nz.capability_summary(per, ["dataset_id"]).select(
        "dataset_id", F.concat_ws(",", "available").alias("available"), "unavailable_count")


@query("c24_record_fingerprint", RECORDS_SQL + """,
h AS (SELECT dataset_id, sha256('9:record_id' || strlen(record_id) || ':' || record_id || '11:record_type' || strlen(record_type) || ':' || record_type) AS h
      FROM records),
"""+ROOT_SQL.format(key="dataset_id"))
def c24_records(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint(all_records(spark, sf), ["dataset_id"], ["record_type", "record_id"])


FILED_SQL = """
WITH f AS (SELECT doc_id // 100 AS bucket, string_agg(text || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY doc_id // 100),
a AS (SELECT bucket, CAST(strlen(body) AS BIGINT) AS length, sha256(body) AS h FROM f)"""


def filed_documents(spark: SparkSession, sf: str) -> str:
    """The documents as text files, a hundred to a file; returns the folder."""
    folder = f"{shared_folder(spark)}/stintwise/{uuid.uuid4().hex}/files"
    rows = table(spark, sf, "documents").selectExpr("doc_id div 100 AS bucket", "doc_id", "text")
    rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "text").write.partitionBy("bucket").text(folder)
    return folder


@query("a11_files_on_disk", FILED_SQL + """,
d AS (SELECT bucket, CASE bucket % 5 WHEN 1 THEN length + 1 ELSE length END AS length, CASE bucket % 5 WHEN 2 THEN sha256('') ELSE h END AS h
      FROM a WHERE bucket % 5 <> 3 UNION ALL SELECT -1 - bucket, length, h FROM a WHERE bucket % 5 = 4)
SELECT bucket, d.length AS declared_length, a.length AS actual_length,
  CASE WHEN a.h IS NULL THEN 'missing' WHEN d.h IS NULL THEN 'undeclared' WHEN d.length <> a.length THEN 'size_mismatch'
       WHEN d.h <> a.h THEN 'hash_mismatch' ELSE 'ok' END AS status FROM d FULL JOIN a USING (bucket)""")
def a11_files(spark: SparkSession, sf: str) -> DataFrame:
    actual = read_inventory(spark, filed_documents(spark, sf)).withColumn("path", F.regexp_extract("path", r"bucket=(-?\d+)/", 1))
    docs = table(spark, sf, "documents").selectExpr("doc_id div 100 AS bucket", "doc_id", "text")
    body = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda r: r["text"]), "\n"), F.lit("\n"))
    files = docs.groupBy("bucket").agg(body.alias("body")).select("bucket", F.octet_length("body").cast("long").alias("length"), F.sha2("body", 256).alias("sha256"))
    rest = F.col("bucket") % 5
    declared = files.where(rest != 3).select(
        "bucket", F.when(rest == 1, F.col("length") + 1).otherwise(F.col("length")).alias("length"),
        F.when(rest == 2, F.sha2(F.lit(""), 256)).otherwise(F.col("sha256")).alias("sha256")).unionByName(
        files.where(rest == 4).withColumn("bucket", -1 - F.col("bucket")))
    found = reconcile_inventory(declared.withColumn("path", F.col("bucket").cast("string")), actual)
    return found.select(F.col("path").cast("long").alias("bucket"), "declared_length", "actual_length", "status")


@query("a1_refusals", MAPPED_SQL + """,
t AS (SELECT event_id, dataset_id, event_type, CASE event_id % 50 WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 7 THEN -4 WHEN 9 THEN 1 ELSE lap_number END AS lap
      FROM base),
o AS (SELECT *, last_value(lap IGNORE NULLS) OVER (PARTITION BY dataset_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
             min(event_id) OVER (PARTITION BY dataset_id, lap) AS first_id FROM t),
g AS (SELECT *, CASE WHEN lap IS NOT NULL AND lap IS DISTINCT FROM prior THEN
                 CASE WHEN first_id < event_id THEN 'lap.reappears' WHEN lap < prior THEN 'lap.regressed' ELSE '' END END AS fault FROM o),
w AS (SELECT *, last_value(fault IGNORE NULLS) OVER (PARTITION BY dataset_id ORDER BY event_id) AS run FROM g)
SELECT event_id, 'lap.unparsable' AS problem FROM w WHERE lap IS NULL
UNION ALL SELECT event_id, 'lap.negative' FROM w WHERE lap < 0
UNION ALL SELECT event_id, run FROM w WHERE lap IS NOT NULL AND run <> ''
UNION ALL SELECT event_id, 'off.unparsable' FROM w WHERE event_type = 'view'
UNION ALL SELECT event_id, 'brake_pct.unparsable' FROM w WHERE event_type = 'view'""")
def a1_refusals(spark: SparkSession, sf: str) -> DataFrame:
    rows = text_rows(spark, sf).withColumn("lap", F.expr(
        "CASE row_index % 50 WHEN 3 THEN '12.5d' WHEN 5 THEN '' WHEN 7 THEN '-4' WHEN 9 THEN '1' ELSE lap END"))
    problems = mapped_problems(rows, MAPPINGS, "lap", ["dataset_id"], scale_of(sf))
    return set_apart(problems, ["row_index"])[1].select(F.col("row_index").alias("event_id"), "problem")


LAP_TEXT = {"lap_number": "CASE WHEN lap_number % 13 = 0 THEN '12.5d' WHEN lap_number % 11 = 0 THEN '' ELSE cast(lap_number AS STRING) END",
            "is_valid": "CASE WHEN lap_number % 7 = 0 THEN 'yes' WHEN is_valid THEN '1' ELSE '0' END",
            "is_reference": "CASE WHEN is_reference OR lap_number % 6 = 0 THEN '1' ELSE '0' END",
            "sampled_bins": "cast(sampled_bins AS STRING)", "total_bins": "CASE WHEN lap_number % 9 = 0 THEN '0' ELSE cast(total_bins AS STRING) END",
            "coverage_fraction": "CASE WHEN lap_number % 8 = 0 THEN '0.99' ELSE cast(coverage_fraction AS STRING) END",
            "exclusion_reasons": "CASE WHEN lap_number % 10 = 0 THEN 'said' ELSE '' END",
            "is_best_valid_lap": "CASE WHEN is_best_valid_lap THEN '1' ELSE '0' END"}


@query("a5_refusals", "WITH " + BINS_SQL + """,
t AS (SELECT lap_id, participant, CASE WHEN lap_number % 13 = 0 OR lap_number % 11 = 0 THEN NULL ELSE lap_number END AS n, lap_number,
             CASE WHEN lap_number % 7 <> 0 THEN is_valid END AS is_valid, is_reference OR lap_number % 6 = 0 AS is_reference, is_best_valid_lap,
             sampled_bins, CASE WHEN lap_number % 9 = 0 THEN 0 ELSE total_bins END AS total_bins,
             CASE WHEN lap_number % 8 = 0 THEN 0.99::DOUBLE ELSE coverage_fraction END AS coverage_fraction FROM lap_table),
u AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE lap_number = 5)
SELECT lap_id, 'lap_number.unparsable' AS problem FROM u WHERE lap_number % 13 = 0
UNION ALL SELECT lap_id, 'lap_number.missing' FROM u WHERE lap_number % 13 <> 0 AND lap_number % 11 = 0
UNION ALL SELECT lap_id, 'is_valid.unparsable' FROM u WHERE is_valid IS NULL
UNION ALL SELECT lap_id, 'total_bins.positive' FROM u WHERE total_bins < 1
UNION ALL SELECT lap_id, 'coverage_fraction.share' FROM u WHERE total_bins > 0 AND abs(coverage_fraction - sampled_bins / total_bins::DOUBLE) > 0.00005
UNION ALL SELECT lap_id, 'exclusion_reasons.valid_lap' FROM u WHERE is_valid AND lap_number % 10 = 0
UNION ALL SELECT lap_id, 'is_reference.invalid_lap' FROM u WHERE is_reference AND NOT is_valid
UNION ALL SELECT lap_id, 'is_best_valid_lap.invalid_lap' FROM u WHERE is_best_valid_lap AND NOT is_valid
UNION ALL SELECT lap_id, 'lap_number.duplicate' FROM (SELECT lap_id, count(*) OVER (PARTITION BY participant, n) AS k, n FROM u) WHERE n IS NOT NULL AND k > 1""")
def a5_refusals(spark: SparkSession, sf: str) -> DataFrame:
    rows = lap_table(spark, sf)
    rows = rows.unionByName(rows.where("lap_number = 5"))
    cells = {c: F.expr(LAP_TEXT.get(c, "'0'" if c in session_export.UNSIGNED | session_export.FLAGS else "''")).alias(c) for c in session_export.LAP_COLUMNS}
    problems = session_export.check_laps(rows.select("lap_id", "participant", *cells.values()), ["participant"])
    return set_apart(problems, ["lap_id"])[1]
