"""Integrity and audit queries (group C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.functions import cells
from stintwise.operators import audit, sweeps
from stintwise.operators.spread import fan_out
from stintwise.plans.bindings import (
    BINS_PER_LAP, BINS_SQL, EVENTS_SQL, base_events, contexts, distance_bins, findings, lap_stretches, lap_table, laps, minute_slot,
    samples, scale_of, table,
)
from stintwise.plans.registry import ROOT_SQL, query
from stintwise.plans.source_queries import event_texts
from stintwise.schema import reading
from stintwise.sources.files import event_lines


@query("c1_record_contract", "WITH " + EVENTS_SQL + """
SELECT 'e' || event_id AS record_id, 'speed.unit' AS rule FROM base WHERE event_type = 'click'
UNION ALL SELECT 'e' || event_id, 'speed.derived_needs_derivation' FROM base WHERE event_type = 'view'
UNION ALL SELECT 'e' || event_id, 'speed.value_missing' FROM base WHERE event_type = 'signup'""")
def c1(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    provenance = F.when(kind == "view", "derived").when(kind == "signup", "measured").otherwise(
        F.col("fields.speed.provenance"))
    spoilt = F.col("fields").withField("speed.unit", F.when(kind == "click", "km/h").otherwise("m/s")).withField(
        "speed.provenance", provenance).withField("speed.source_channel", F.lit("value"))
    stored = fan_out(samples(spark, sf).withColumn("fields", spoilt), scale_of(sf), "event_id")
    return audit.record_contract(stored)


@query("c1_nested_contract", """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'source_provenance.source_file.required' WHEN 1 THEN 'source_provenance.source_file_sha256'
  WHEN 2 THEN 'source_provenance.rows.order' WHEN 3 THEN 'quality_flags.items' WHEN 4 THEN 'aggregation.distance_bin_width_m'
  WHEN 5 THEN 'aggregation.channel_methods.keys' ELSE 'aggregation.channel_methods.brake' END AS rule
FROM events WHERE event_id % 8 < 7""")
def c1_nested(spark: SparkSession, sf: str) -> DataFrame:
    # Events as distance bins; seven of eight are spoilt in one way each.
    way = F.col("event_id") % 8
    methods = {**audit.BIN_METHODS, "brake": F.when(way == 6, "mean").otherwise("maximum")}
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in methods]), F.array(*[m if c == "brake" else F.lit(m) for c, m in methods.items()]))
    rows = table(spark, sf, "events").select(
        "event_id", F.lit("distance_bin").alias("record_type"),
        F.struct(F.when(way == 0, " ").otherwise(F.col("event_type")).alias("source_file"),
                 F.when(way == 1, F.upper(F.sha2("event_type", 256))).otherwise(F.sha2("event_type", 256)).alias("source_file_sha256"),
                 F.lit("events").alias("adapter_id"), F.lit("1").alias("adapter_version"), (F.col("event_id") + 2).alias("row_start"),
                 F.when(way == 2, F.col("event_id") + 1).otherwise(F.col("event_id") + 2).alias("row_end")).alias("source_provenance"),
        F.when(way == 3, F.array(F.lit("kept"), F.lit(""))).alias("quality_flags"),
        F.struct(F.lit(audit.BIN_SEMANTICS).alias("source_semantics"), F.when(way == 4, 2.0).otherwise(1.0).alias("distance_bin_width_m"),
                 F.when(way == 5, F.map_filter(pairs, lambda c, m: c != "speed")).otherwise(pairs).alias("channel_methods")).alias("aggregation"))
    return audit.nested_contract(rows, ["event_id"])


@query("c2_duplicate_identities", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def c2(spark: SparkSession, sf: str) -> DataFrame:
    return audit.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("c3_sequence_contiguous", """
SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS n_distinct,
       min(l_linenumber)::BIGINT AS lowest, max(l_linenumber)::BIGINT AS highest
FROM lineitem GROUP BY l_orderkey
HAVING min(l_linenumber) <> 1 OR count(*) <> count(DISTINCT l_linenumber) OR max(l_linenumber) <> count(*)""")
def c3(spark: SparkSession, sf: str) -> DataFrame:
    return audit.dense_ranks(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", start=1)


@query("c4_parent_references", "WITH " + EVENTS_SQL + """
SELECT 'e' || b.event_id AS record_id, b.lap_id,
       CASE WHEN l.lap_id IS NULL THEN 'unknown_parent' ELSE 'later_parent' END AS rule
FROM base b LEFT JOIN (SELECT * FROM laps WHERE lap_valid) l USING (lap_id)
WHERE l.lap_id IS NULL OR l.start_micros + 3600000000 >= b.micros""")
def c4(spark: SparkSession, sf: str) -> DataFrame:
    # Only valid laps were stored, each an hour after its start: both defects occur.
    stored = laps(spark, sf).filter("lap_valid").withColumn(
        "sequence_index", F.col("start_micros") + F.lit(3_600_000_000))
    children = samples(spark, sf).withColumn("sequence_index", F.col("micros"))
    return audit.parent_references(children, stored, "lap_id", ["dataset_id"], scale_of(sf))


@query("c5_c7_temporal_flags", "WITH " + EVENTS_SQL + """,
t AS (SELECT *, CASE WHEN event_type <> 'signup' THEN micros / 1e6::DOUBLE END AS ts FROM base),
w AS (
  SELECT *, lag(distance) OVER s AS pix,
         last_value(ts IGNORE NULLS) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pts,
         last_value(CASE WHEN ts IS NOT NULL THEN distance END IGNORE NULLS) OVER (
           PARTITION BY lap_id ORDER BY micros, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pd
  FROM t WINDOW s AS (PARTITION BY dataset_id ORDER BY micros, event_id))
SELECT 'e' || event_id AS record_id, concat_ws(',',
  CASE WHEN ts - pts < 0 THEN 'clock_reset' END,
  CASE WHEN ts - pts = 0 THEN 'duplicate_timestamp' END,
  CASE WHEN ts IS NOT NULL AND distance < pd THEN 'lap_distance_regression' END,
  CASE WHEN distance > pix + 1 THEN 'sample_index_gap' END,
  CASE WHEN distance <= pix THEN 'sample_index_not_increasing' END,
  CASE WHEN ts - pts > 129600 THEN 'timestamp_gap' END,
  CASE WHEN ts IS NULL THEN 'timestamp_unavailable' END) AS detected
FROM w""")
def c5_c7(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.when(F.col("event_type") != "signup", reading("timestamp"))
    out = audit.temporal_flags(
        samples(spark, sf), "dataset_id", "lap_id", ["micros", "event_id"], minute_slot(),
        index=reading("lap_distance").cast("long"), timestamp=stamp, distance=reading("lap_distance"),
        expected_period=86400.0, tolerance=43200.0, scale=scale_of(sf))
    return out.select("record_id", F.concat_ws(",", "detected").alias("detected"))


@query("c8_distance_bin_sequence", "WITH " + BINS_SQL + """,
w AS (SELECT *, lag(distance_m) OVER (PARTITION BY lap_id ORDER BY distance_m) AS p FROM bins WHERE has_sample)
SELECT lap_id, distance_m, r.rule FROM w, LATERAL (SELECT unnest(list_filter([
  CASE WHEN p IS NULL AND distance_m <> 0 THEN 'first_index_not_zero' END,
  CASE WHEN distance_m <> p + 1 THEN 'index_not_contiguous' END], lambda x: x IS NOT NULL)) AS rule) r""")
def c8(spark: SparkSession, sf: str) -> DataFrame:
    bins = distance_bins(spark, sf).filter("has_sample").withColumns(
        {"start": F.col("distance_m").cast("double"), "end": F.col("distance_m") + 1.0})
    return audit.bin_sequence(bins, ["lap_id"], "distance_m", "start", "end", F.col("distance_m"), scale_of(sf))


@query("c9_flag_counts", "WITH " + EVENTS_SQL + """,
w AS (SELECT *, lag(micros) OVER (PARTITION BY dataset_id ORDER BY micros, event_id) AS p FROM base)
SELECT flag, count(*) AS n FROM w, LATERAL (SELECT unnest(list_filter([
  CASE WHEN (micros / 1e6::DOUBLE) - (p / 1e6::DOUBLE) > 129600 THEN 'timestamp_gap' END,
  CASE WHEN event_type = 'view' AND distance >= 90 THEN 'replay_view' END], lambda x: x IS NOT NULL)) AS flag) f
GROUP BY flag""")
def c9(spark: SparkSession, sf: str) -> DataFrame:
    flagged = audit.temporal_flags(
        samples(spark, sf), "dataset_id", "lap_id", ["micros", "event_id"], minute_slot(), None, reading("timestamp"),
        None, 86400.0, 43200.0, scale_of(sf))
    return audit.flag_counts(audit.add_flags(flagged))


@query("c10_lap_runs", "WITH " + EVENTS_SQL + """,
w AS (SELECT *, lag(lap_number) OVER (PARTITION BY dataset_id ORDER BY distance, event_id) AS p FROM base)
SELECT dataset_id, lap_number, count(*) FILTER (p IS NULL OR p <> lap_number) AS runs,
       count(*) FILTER (p > lap_number) AS regressions
FROM w GROUP BY ALL HAVING count(*) FILTER (p IS NULL OR p <> lap_number) > 1 OR count(*) FILTER (p > lap_number) > 0""")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    # Read in lap-position order instead of time order, laps interleave.
    return audit.lap_runs(base_events(spark, sf), "dataset_id", "lap_number", ["distance", "event_id"],
                          F.col("distance"), scale_of(sf))


@query("c11_capture_sequence", "WITH " + EVENTS_SQL + """,
w AS (SELECT participant, event_id, event_id - lag(event_id) OVER (PARTITION BY participant ORDER BY micros, event_id) AS step FROM base),
s AS (SELECT participant, count(*) AS n_rows, CAST(coalesce(sum(step - 1) FILTER (step > 0), 0) AS BIGINT) AS gaps,
             count(*) FILTER (step <= 0) AS not_increasing FROM w GROUP BY participant),
d AS (SELECT participant, CAST(sum(n_rows) + CASE WHEN ascii(right(participant, 1)) % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS samples_written, CAST(150 * sum(n_rows) - sum(n_incidents) AS BIGINT) AS samples_dropped
      FROM laps GROUP BY participant)
SELECT participant, samples_written, samples_dropped, n_rows, gaps, not_increasing,
       CASE WHEN not_increasing > 0 THEN 'sequence_not_increasing' WHEN gaps > samples_dropped THEN 'gaps_exceed_declared_drops'
            WHEN samples_written IS DISTINCT FROM n_rows THEN 'row_count_mismatch' END AS problem
FROM d FULL JOIN s USING (participant)""")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    # A third of the participants declare one sample too many.
    excess = F.when(F.ascii(F.substring("participant", -1, 1)) % 3 == 0, 1).otherwise(0)
    declared = laps(spark, sf).groupBy("participant").agg(
        (F.sum("n_rows") + excess).alias("samples_written"),
        (F.sum("n_rows") * 150 - F.sum("n_incidents")).alias("samples_dropped"))
    return audit.capture_sequence(base_events(spark, sf), ["participant"], "event_id", ["micros", "event_id"],
                                  minute_slot(), declared, scale_of(sf))


@query("c12_unavailable_channels_empty", """
SELECT * FROM (
  SELECT 'discount' AS "column", count(*) FILTER (l_discount <> 0) AS n FROM lineitem
  UNION ALL SELECT 'tax', count(*) FILTER (l_tax <> 0) FROM lineitem
  UNION ALL SELECT 'returned', count(*) FILTER (l_returnflag = 'R') FROM lineitem) WHERE n > 0""")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_discount") == 0, "").otherwise(F.col("l_discount").cast("string")).alias("discount"),
        F.when(F.col("l_tax") == 0, "").otherwise(F.col("l_tax").cast("string")).alias("tax"),
        F.when(F.col("l_returnflag") == "R", "R").otherwise("").alias("returned"))
    return audit.forbidden_values(rows, {"price": ["discount", "tax"], "status": ["returned"]}, ["price", "status"])


@query("c13_event_log", """
SELECT conv_id, count(*) AS n_events, min(turn) AS lowest, max(turn) AS highest, count(DISTINCT turn) AS n_distinct,
       bool_or(role = 'system') AS has_required,
       CASE WHEN min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*) THEN 'sequence_not_dense'
            WHEN NOT bool_or(role = 'system') THEN 'required_kind_missing' END AS problem
FROM conversations GROUP BY conv_id""")
def c13(spark: SparkSession, sf: str) -> DataFrame:
    return audit.event_log(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", F.lit("system"))


@query("c13_event_log_rules", """
WITH b AS (SELECT conv_id, count(*) AS n, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS d,
             bool_or(role = 'user') AS c, bool_or(role = 'system') AS s, bool_or(role = 'assistant' AND turn > 2) AS a
           FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn <= 2 THEN 'reply' ELSE role END AS role FROM conversations)
           WHERE turn % 13 <> 5 OR conv_id % 2 = 0 GROUP BY conv_id),
m AS (SELECT conv_id, count(*) AS written FROM conversations GROUP BY conv_id)
SELECT conv_id, 'metadata_missing' AS rule FROM b WHERE conv_id % 17 = 0
UNION ALL SELECT conv_id, 'sequence_not_dense' FROM b WHERE conv_id % 17 <> 0 AND NOT (low = 0 AND high = n - 1 AND d = n)
UNION ALL SELECT conv_id, 'condition_missing' FROM m LEFT JOIN b USING (conv_id) WHERE conv_id % 17 <> 0 AND NOT coalesce(c, false)
UNION ALL SELECT conv_id, 'marker_missing.disabled' FROM m LEFT JOIN b USING (conv_id) WHERE conv_id % 17 <> 0 AND conv_id % 3 = 0 AND NOT coalesce(s, false)
UNION ALL SELECT conv_id, 'marker_missing.enabled' FROM m LEFT JOIN b USING (conv_id) WHERE conv_id % 17 <> 0 AND conv_id % 3 = 1 AND NOT coalesce(a, false)
UNION ALL SELECT conv_id, 'written_mismatch' FROM m LEFT JOIN b USING (conv_id) WHERE conv_id % 17 <> 0 AND coalesce(n, 0) <> written
UNION ALL SELECT conv_id, 'dropped_events' FROM m WHERE conv_id % 17 <> 0 AND conv_id % 11 = 0""")
def c13_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("kind", F.when(
        (F.col("role") == "assistant") & (F.col("turn") <= 2), "reply").otherwise(F.col("role")))
    # The logs of odd conversations have lost some lines.
    kept = rows.where("turn % 13 <> 5 or conv_id % 2 = 0")
    log = event_lines(event_texts(kept, ["conv_id"], "turn", "kind", {"chars": F.length("text")}), "event/1").where("problem is null")
    state = F.when(F.col("conv_id") % 3 == 0, "disabled").when(F.col("conv_id") % 3 == 1, "enabled")
    metadata = rows.where("conv_id % 17 <> 0").groupBy("conv_id").agg(F.count(F.lit(1)).alias("events_written")).withColumn(
        "coaching_state", state).withColumn("events_dropped", (F.col("conv_id") % 11 == 0).cast("int"))
    return audit.event_log_rules(log, metadata, ["conv_id"], "user", {"disabled": "system", "enabled": "assistant"})


@query("c14_lap_table_rules", "WITH " + BINS_SQL + """
SELECT lap_id, 'valid_lap_with_reasons' AS rule FROM lap_table WHERE is_valid AND exclusion_reasons <> ''
UNION ALL SELECT lap_id, 'reference_not_valid' FROM lap_table WHERE is_reference AND NOT is_valid
UNION ALL SELECT lap_id, 'best_not_valid' FROM lap_table WHERE is_best_valid_lap AND NOT is_valid""")
def c14(spark: SparkSession, sf: str) -> DataFrame:
    return audit.lap_table_rules(lap_table(spark, sf), ["lap_id"])


@query("c15_bin_rules", "WITH " + BINS_SQL + """
SELECT lap_id, distance_m, 'sampled_without_values' AS rule FROM bins WHERE has_sample AND speed_ms IS NULL
UNION ALL SELECT b.lap_id, b.distance_m, 'reference_disagrees' FROM bins b JOIN lap_table l USING (lap_id)
WHERE b.lap_is_valid <> l.is_reference""")
def c15(spark: SparkSession, sf: str) -> DataFrame:
    bins = distance_bins(spark, sf).withColumn("lap_is_reference", F.col("lap_is_valid"))
    return audit.bin_rules(bins, lap_table(spark, sf), ["dataset_id", "lap_id"], ["lap_id", "distance_m"],
                           scale_of(sf).times(10)).select("lap_id", F.col("distance_m").cast("long").alias("distance_m"), "rule")


@query("c16_unit_agreement", "WITH " + EVENTS_SQL + """
SELECT dataset_id, max(abs(round(speed * 3.6, 1) - speed * 3.6)) <= 0.05 AS kph_agrees,
       max(abs(round(degrees(distance / 100), 2) - degrees(distance / 100))) <= 0.0005001 AS degrees_agrees
FROM base GROUP BY dataset_id""")
def c16(spark: SparkSession, sf: str) -> DataFrame:
    speed, angle = F.col("speed"), F.col("distance") / 100
    out = audit.unit_agreement(base_events(spark, sf), ["dataset_id"], {
        "kph": (F.round(speed * 3.6, 1), speed * 3.6, 0.05),
        "degrees": (F.round(F.degrees(angle), 2), F.degrees(angle), 0.0005001)})
    return out.select("dataset_id", "kph_agrees", "degrees_agrees")


@query("c17_bin_totals", "WITH " + BINS_SQL + """
SELECT l.lap_id, l.total_bins, l.sampled_bins, b.bins, b.sampled, b.frames,
       CASE WHEN b.bins IS NULL THEN 'lap_without_bins' WHEN l.total_bins IS NULL THEN 'bins_without_lap'
            WHEN b.bins <> l.total_bins OR b.sampled <> l.sampled_bins THEN 'totals_differ' END AS problem
FROM lap_table l LEFT JOIN (
  SELECT lap_id, count(*) AS bins, count(*) FILTER (has_sample) AS sampled, CAST(sum(sample_count) AS BIGINT) AS frames
  FROM bins WHERE speed_ms IS NOT NULL OR NOT has_sample GROUP BY lap_id) b USING (lap_id)""")
def c17(spark: SparkSession, sf: str) -> DataFrame:
    bins = distance_bins(spark, sf).filter("speed_ms is not null or not has_sample")
    return audit.bin_totals(bins, lap_table(spark, sf), ["lap_id"])


@query("c18_finding_keys", "WITH " + BINS_SQL + """,
s AS (SELECT dataset_id, min(distance_m) AS first_bin, max(distance_m) AS last_bin, count(DISTINCT lap_id) AS laps,
             min(lap_id) AS lap FROM bins WHERE finding_keys = 'F1' GROUP BY dataset_id)
SELECT dataset_id, 'F1' AS finding_key, first_bin, last_bin,
       CASE WHEN laps > 1 OR lap <> f.lap_id THEN 'other_lap'
            WHEN first_bin < floor(f."start") OR last_bin >= ceil(f."end") THEN 'outside_range' END AS problem
FROM s JOIN findings f USING (dataset_id)""")
def c18(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.finding_keys(distance_bins(spark, sf), findings(spark, sf), "dataset_id", "lap_id", "distance_m",
                             scale_of(sf).times(10))
    return out.withColumns({c: F.col(c).cast("long") for c in ("first_bin", "last_bin")})


#: Regions about a finding: its own, two that overlap it, and one beyond the lap's end.
REGIONS_SQL = """,
r AS (SELECT dataset_id, finding_key, "start", "end", 1.0::DOUBLE AS declared FROM findings
      UNION ALL SELECT dataset_id, 'F2', 0.0, 5.0, 0.5 FROM findings UNION ALL SELECT dataset_id, 'F3', 4.0, 9.0, NULL FROM findings
      UNION ALL SELECT dataset_id, 'F4', 12.0, 15.0, 0.0 FROM findings),
chosen AS (SELECT DISTINCT dataset_id, lap_id FROM lap_table WHERE is_reference OR is_reviewed_lap
           UNION SELECT dataset_id, 'never driven' FROM lap_table WHERE lap_number % 5 = 0)"""


@query("c19_region_coverage", "WITH " + BINS_SQL + REGIONS_SQL + """,
p AS (SELECT r.dataset_id, r.finding_key, r."start", r."end", c.lap_id, count(b.lap_id) AS total, count(*) FILTER (b.has_sample) AS seen
      FROM r JOIN chosen c ON c.dataset_id = r.dataset_id
      LEFT JOIN bins b ON b.dataset_id = r.dataset_id AND b.lap_id = c.lap_id AND b.distance_m BETWEEN r."start" AND r."end" GROUP BY ALL),
q AS (SELECT dataset_id, finding_key, "start", "end", min(CASE WHEN total > 0 THEN seen / total::DOUBLE ELSE 0.0 END) AS coverage, count(*) AS laps,
             count(*) FILTER (total = 0) AS absent FROM p GROUP BY ALL)
SELECT r.dataset_id, r.finding_key, r."start", r."end", r.declared, q.coverage, coalesce(q.laps, 0) AS laps, coalesce(q.absent, 0) AS absent,
       CASE WHEN q.laps IS NULL THEN 'no_comparison_lap' WHEN q.absent > 0 THEN 'absent_on_lap'
            WHEN abs(r.declared - q.coverage) > 0.0005 THEN 'coverage_mismatch' END AS problem
FROM r LEFT JOIN q ON q.dataset_id = r.dataset_id AND q.finding_key = r.finding_key AND r."start" = q."start" AND r."end" = q."end"
""")
def c19(spark: SparkSession, sf: str) -> DataFrame:
    driven = lap_stretches(spark, sf)
    own = driven.groupBy("dataset_id").agg(F.floor(F.min("first_incident") / 10).cast("double").alias("start"),
                                           F.ceil(F.max("last_incident") / 10).cast("double").alias("end")).where("start is not null")
    regions = own.select("dataset_id", F.inline(F.array(*[
        F.struct(F.lit(key).alias("finding_key"), start.alias("start"), end.alias("end"), F.lit(declared).cast("double").alias("coverage"))
        for key, start, end, declared in (("F1", F.col("start"), F.col("end"), 1.0), ("F2", F.lit(0.0), F.lit(5.0), 0.5),
                                          ("F3", F.lit(4.0), F.lit(9.0), None), ("F4", F.lit(12.0), F.lit(15.0), 0.0))])))
    known = driven.where("dataset_id is not null and lap_id is not null")
    # The reviewed lap of a dataset is its last one.
    chosen = known.groupBy("dataset_id").agg(F.max("lap_id").alias("lap_id")).unionByName(
        known.where("n_incidents = 0 and n_rows >= 3").select("dataset_id", "lap_id")).unionByName(
        known.where("lap_number % 5 = 0").select("dataset_id", F.lit("never driven").alias("lap_id")))
    bins = known.select("dataset_id", "lap_id", "sampled", F.explode(F.sequence(F.lit(0), F.lit(BINS_PER_LAP - 1))).alias("distance_m")).select(
        "dataset_id", "lap_id", "distance_m", F.expr("getbit(sampled, distance_m) = 1").alias("has_sample"))
    return sweeps.region_coverage(bins, regions, chosen, "dataset_id", "lap_id", "distance_m", scale_of(sf).times(BINS_PER_LAP))


@query("c20_lap_set_agreement", "WITH " + BINS_SQL + """
SELECT participant, count(*) FILTER (is_reviewed_lap) AS reviewed, count(*) FILTER (is_best_valid_lap) AS best,
       count(*) FILTER (is_reference) AS "references", count(*) FILTER (is_reference OR is_reviewed_lap) AS comparable,
       CASE WHEN count(*) FILTER (is_reviewed_lap) <> 1 THEN 'reviewed_lap_count'
            WHEN count(*) FILTER (is_best_valid_lap) <> 1 THEN 'best_lap_count' END AS problem
FROM lap_table GROUP BY participant""")
def c20(spark: SparkSession, sf: str) -> DataFrame:
    return audit.lap_set_agreement(lap_table(spark, sf), ["participant"])


BLOCKS = "stack(4, 'b1', 1, 7, 'b2', 8, 14, 'b3', 14, 20, 'b4', 22, 28) AS (block, start_lap, end_lap)"
BLOCKS_SQL = EVENTS_SQL + """,
b(block, start_lap, end_lap) AS (VALUES ('b1', 1, 7), ('b2', 8, 14), ('b3', 14, 20), ('b4', 22, 28))"""


@query("c21_block_binding", "WITH " + BLOCKS_SQL + """,
l AS (SELECT participant, lap_number FROM laps UNION ALL SELECT participant, lap_number FROM laps WHERE lap_number = 5)
SELECT participant, lap_number, rows, count(b.block) AS blocks, CASE WHEN count(b.block) = 1 THEN min(b.block) END AS block,
       CASE WHEN rows > 1 THEN 'duplicate_lap' WHEN count(b.block) = 0 THEN 'no_block' WHEN count(b.block) > 1 THEN 'several_blocks' END AS problem
FROM (SELECT participant, lap_number, count(*) AS rows FROM l GROUP BY ALL) l LEFT JOIN b ON l.lap_number BETWEEN b.start_lap AND b.end_lap
GROUP BY participant, lap_number, rows""")
def c21(spark: SparkSession, sf: str) -> DataFrame:
    driven = laps(spark, sf).select("participant", "lap_number")
    blocks = driven.select("participant").distinct().selectExpr("participant", BLOCKS)
    return sweeps.bind_blocks(driven.unionByName(driven.where("lap_number = 5")), blocks, ["participant"], "lap_number", scale_of(sf))


@query("c21_block_rules", """
WITH b AS (SELECT o_custkey, o_orderkey % 50 AS block, o_custkey % 40 - 2 + o_orderkey % 60 AS start_lap, o_custkey % 40 - 2 + o_orderkey % 70 AS end_lap FROM orders),
w AS (SELECT *, max(end_lap) OVER (PARTITION BY o_custkey ORDER BY start_lap, end_lap, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM b WHERE start_lap <= end_lap)
SELECT o_custkey, block, 'range' AS rule FROM b WHERE start_lap > end_lap
UNION ALL SELECT o_custkey, block, 'start' FROM b WHERE start_lap < 0
UNION ALL SELECT o_custkey, block, 'duplicate' FROM b GROUP BY o_custkey, block HAVING count(*) > 1
UNION ALL SELECT o_custkey, block, 'overlap' FROM w WHERE reach >= start_lap
UNION ALL SELECT o_custkey, block, 'gap' FROM w WHERE reach < start_lap - 1""")
def c21_rules(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "orders").selectExpr(
        "o_custkey", "o_orderkey % 50 AS block", "o_custkey % 40 - 2 + o_orderkey % 60 AS start_lap", "o_custkey % 40 - 2 + o_orderkey % 70 AS end_lap")
    return sweeps.block_rules(blocks, ["o_custkey"], scale_of(sf, "orders"))


@query("c21_assignments", "WITH " + BLOCKS_SQL + """,
s AS (SELECT DISTINCT participant, lap_number,
        CASE WHEN lap_number % 9 = 0 THEN 'b9' WHEN lap_number % 11 = 0 THEN 'b1' WHEN lap_number <= 7 THEN 'b1' WHEN lap_number <= 14 THEN 'b2'
             WHEN lap_number <= 20 THEN 'b3' ELSE 'b4' END AS block FROM laps),
g AS (SELECT * FROM s UNION ALL SELECT participant, lap_number, 'b1' FROM s WHERE lap_number % 5 = 0
      UNION ALL SELECT DISTINCT participant, 99, 'b4' FROM s)
SELECT participant, lap_number, 'duplicate_assignment' AS rule FROM g GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT participant, lap_number, 'unknown_block' FROM g WHERE block NOT IN (SELECT block FROM b)
UNION ALL SELECT DISTINCT participant, lap_number, 'absent_lap' FROM g WHERE (participant, lap_number) NOT IN (SELECT (participant, lap_number) FROM laps)
UNION ALL SELECT DISTINCT participant, lap_number, 'outside_block' FROM g JOIN b USING (block) WHERE lap_number NOT BETWEEN start_lap AND end_lap""")
def c21_assignments(spark: SparkSession, sf: str) -> DataFrame:
    driven = laps(spark, sf).select("participant", "lap_number").distinct()
    blocks = driven.select("participant").distinct().selectExpr("participant", BLOCKS)
    planned = driven.selectExpr("participant", "lap_number", """CASE WHEN lap_number % 9 = 0 THEN 'b9' WHEN lap_number % 11 = 0 THEN 'b1' WHEN lap_number <= 7 THEN 'b1'
        WHEN lap_number <= 14 THEN 'b2' WHEN lap_number <= 20 THEN 'b3' ELSE 'b4' END AS block""")
    given = planned.unionByName(planned.where("lap_number % 5 = 0").withColumn("block", F.lit("b1"))).unionByName(
        driven.select("participant").distinct().selectExpr("participant", "99 AS lap_number", "'b4' AS block"))
    return sweeps.assignment_rules(given, blocks, driven, ["participant"], "lap_number")


@query("c21_identity", "WITH " + EVENTS_SQL + """
SELECT dataset_id, 'unknown_session' AS rule FROM contexts WHERE condition_id = 'warmup'
UNION ALL SELECT dataset_id, 'car_mismatch' FROM contexts WHERE condition_id = 'even' AND lower(car) IS DISTINCT FROM car
UNION ALL SELECT dataset_id, 'simulator_mismatch' FROM contexts WHERE condition_id <> 'warmup' AND records_considered % 5 = 0""")
def c21_identity(spark: SparkSession, sf: str) -> DataFrame:
    seen = contexts(spark, sf)
    claimed = seen.select("dataset_id", F.when(F.col("records_considered") % 5 == 0, "other").otherwise(F.col("simulator")).alias("simulator"),
                          F.when(F.col("condition_id") == "even", F.lower("car")).otherwise(F.col("car")).alias("car"), "track")
    return sweeps.identity_rules(claimed, seen.where("condition_id <> 'warmup'"), ["dataset_id"], ["simulator", "car", "track"])


def _scan_sql(source: str, key: str, text: str, rules: tuple) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {key}, '{name}' AS rule FROM {source} WHERE regexp_matches({text}, '" + pattern.replace("'", "''") + "')"
        for name, _, pattern in rules)


SCANNED = audit.SECRET_RULES + audit.PRIVACY_RULES + audit.IDENTIFIER_RULES


@query("c22_text_scan_documents", _scan_sql("documents", "doc_id", "text", SCANNED))
def c22(spark: SparkSession, sf: str) -> DataFrame:
    return audit.scan_text(fan_out(table(spark, sf, "documents"), scale_of(sf, "documents"), "doc_id"), ["doc_id"], "text", SCANNED)


@query("c22_text_scan_pages", _scan_sql("pages", "page_id", "html", SCANNED))
def c22_pages(spark: SparkSession, sf: str) -> DataFrame:
    return audit.scan_text(fan_out(table(spark, sf, "pages"), scale_of(sf, "pages"), "page_id"), ["page_id"], "html", SCANNED)


@query("c23_file_policy", """
WITH f AS (SELECT source, source || '/telemetry-' || doc_id || CASE lang WHEN 'en' THEN '.csv' WHEN 'de' THEN '.zip' ELSE '.txt' END AS path,
                  lang, n_chars * 1000 AS length FROM documents)
SELECT path, 'large-file' AS rule FROM f WHERE length > 5242880
UNION ALL SELECT path, 'prohibited-extension' FROM f WHERE lang = 'de'
UNION ALL SELECT path, 'raw-telemetry' FROM f WHERE lang = 'en' AND source <> 'web'
UNION ALL SELECT source, 'group-total-size' FROM f GROUP BY source HAVING sum(length) > 2097152""")
def c23(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.when(F.col("lang") == "en", ".csv").when(F.col("lang") == "de", ".zip").otherwise(".txt")
    files = table(spark, sf, "documents").select(
        "source", F.concat(F.col("source"), F.lit("/telemetry-"), F.col("doc_id"), ending).alias("path"),
        (F.col("n_chars") * 1000).alias("length"), F.col("text").alias("content"))
    return audit.scan_files(files, "source", F.col("source") == "web")


@query("c24_content_fingerprint", """
WITH h AS (SELECT c_nationkey, sha256('9:c_custkey' || length(c_custkey::VARCHAR) || ':' || c_custkey || '12:c_mktsegment' || strlen(c_mktsegment) || ':' || c_mktsegment
                                     || '6:c_name' || strlen(c_name) || ':' || c_name) AS h FROM customer),""" + ROOT_SQL.format(key="c_nationkey"))
def c24(spark: SparkSession, sf: str) -> DataFrame:
    return audit.fingerprint(table(spark, sf, "customer"), ["c_nationkey"], ["c_name", "c_custkey", "c_mktsegment"])


@query("c25_rebuild_diff", "WITH " + EVENTS_SQL + """,
a AS (SELECT lap_id, n_rows FROM laps), b AS (SELECT lap_id, count(*) AS n_rows FROM base WHERE speed IS NOT NULL GROUP BY lap_id)
SELECT lap_id, n_rows, -1::BIGINT AS surplus FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT lap_id, n_rows, 1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def c25(spark: SparkSession, sf: str) -> DataFrame:
    rebuilt = base_events(spark, sf).filter("speed is not null").groupBy("lap_id").agg(
        F.count(F.lit(1)).alias("n_rows"))
    return audit.table_diff(laps(spark, sf).select("lap_id", "n_rows"), rebuilt)


@query("c26_bundle_report", "WITH " + BINS_SQL + """
SELECT dataset_id, laps, valid_laps, reference_laps, excluded_laps, bins, sampled_bins, frames FROM (
  SELECT dataset_id, count(*) AS laps, count(*) FILTER (is_valid) AS valid_laps,
         count(*) FILTER (is_reference) AS reference_laps, count(*) FILTER (NOT is_valid) AS excluded_laps
  FROM lap_table GROUP BY dataset_id) JOIN (
  SELECT dataset_id, count(*) AS bins, count(*) FILTER (has_sample) AS sampled_bins, CAST(sum(sample_count) AS BIGINT) AS frames
  FROM bins GROUP BY dataset_id) USING (dataset_id)""")
def c26(spark: SparkSession, sf: str) -> DataFrame:
    return audit.bundle_report(lap_table(spark, sf), distance_bins(spark, sf), ["dataset_id"])


@query("c24_differing_buckets", """
WITH v AS (SELECT doc_id, text, CASE WHEN doc_id % 97 = 3 THEN upper(text) ELSE text END AS other FROM documents),
h AS (SELECT lang, sha256('6:doc_id' || length(d.doc_id::VARCHAR) || ':' || d.doc_id || '4:text' || strlen(v.text) || ':' || v.text) AS a,
             sha256('6:doc_id' || length(d.doc_id::VARCHAR) || ':' || d.doc_id || '4:text' || strlen(v.other) || ':' || v.other) AS b
      FROM v JOIN documents d USING (doc_id)),
n AS (SELECT lang, substr(a, 1, 2) AS bucket, count(*) AS x, 0 AS y FROM h GROUP BY ALL UNION ALL SELECT lang, substr(b, 1, 2), 0, count(*) FROM h GROUP BY ALL),
e AS (SELECT lang, substr(a, 1, 2) AS bucket FROM h WHERE a <> b UNION SELECT lang, substr(b, 1, 2) FROM h WHERE a <> b)
SELECT n.lang, n.bucket, nullif(CAST(sum(x) AS BIGINT), 0) AS stored_rows, nullif(CAST(sum(y) AS BIGINT), 0) AS rebuilt_rows
FROM n JOIN e ON e.lang = n.lang AND e.bucket = n.bucket GROUP BY n.lang, n.bucket""")
def c24_buckets(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "documents")
    rebuilt = stored.withColumn("text", F.when(F.col("doc_id") % 97 == 3, cells.simple_upper(F.col("text"))).otherwise(F.col("text")))
    return audit.differing_buckets(*[audit.bucket_fingerprints(d, ["lang"], ["doc_id", "text"]) for d in (stored, rebuilt)], ["lang"])
