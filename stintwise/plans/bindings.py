"""The shared tables seen as telemetry: events are samples, users are participants.

* participant = user; dataset = session = block = (user, week of the month, day parity)
* lap = (user, calendar day), lap number = day of the month, record order = (ts, event_id)
* condition: ``odd`` and ``even`` days (baseline and intervention arms); days from the 29th
  on are ``warmup``, which no arm uses
* ``speed`` is the event value, unavailable on ``signup`` rows
* ``lap_distance`` is the ``k`` of the JSON payload, 0..99
* ``incident_state`` is "1" on ``error`` rows, otherwise "0"
* ``view`` rows in the last tenth of the lap carry a replay flag
* a lap is valid when fewer than half of its rows are errors
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.functions.qualified import fields, qualified
from stintwise.operators.spread import Scale, deal, fan_out
from stintwise.session import stored_table

# A slot of the scan order: one minute of event time.
SLOT_MICROS = 60_000_000


# Explicit schemas: no job to read footers before a query can be planned.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey LONG, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG",
    "pages": "page_id LONG, url STRING, html STRING",
    "benchmark": "item_id LONG, text STRING",
    "labels": "doc_id LONG, quality INT, toxic INT",
    "conversations": "conv_id LONG, turn LONG, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def base_events(spark: SparkSession, sf_dir: str, dealt: Scale | None = None) -> DataFrame:
    """Flat typed columns of the events table under telemetry names.

    With the bound ``dealt``, events are dealt over partitions that follow their number before anything is done with them.
    """
    rows = table(spark, sf_dir, "events")
    return (deal(rows, dealt.rows, dealt, "event_id", "ts") if dealt else fan_out(rows, scale_of(sf_dir), "event_id")).selectExpr(
        "*", "dayofmonth(ts) AS dom", "concat('u', user_id) AS participant",
    ).selectExpr(
        "*", "CASE WHEN dom >= 29 THEN 'warmup' WHEN dom % 2 = 1 THEN 'odd' ELSE 'even' END AS condition_id",
    ).selectExpr(
        "event_id",
        # Zone-less time stamps: microseconds since 1970 whatever the session zone.
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS micros",
        "user_id", "participant",
        "concat(participant, '-w', (dom - 1) div 7, '-', condition_id) AS dataset_id",
        "concat(participant, '-', date_format(ts, 'yyyyMMdd')) AS lap_id",
        "dom AS lap_number", "condition_id",
        "CASE condition_id WHEN 'odd' THEN 'baseline' WHEN 'even' THEN 'intervention' END AS arm",
        "event_type", "CASE WHEN event_type <> 'signup' THEN value END AS speed",
        "CAST(get_json_object(props, '$.k') AS DOUBLE) AS distance", "event_type = 'error' AS incident",
    )


def _rows(sf_dir: str, name: str) -> int:
    return table(SparkSession.active(), sf_dir, name).count()


def scale_of(sf_dir: str, name: str = "events") -> Scale:
    """Row bound of a table, counted anew from the Parquet footers at every call."""
    per_task = SparkSession.active().conf.get("stintwise.rowsPerTask", None)
    rows = _rows(sf_dir, name)
    return Scale(rows, int(per_task)) if per_task else Scale(rows)


def minute_slot(column: str = "micros") -> Column:
    return F.floor(F.col(column) / F.lit(SLOT_MICROS))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry samples in the record model, with order columns kept beside them."""
    e = base_events(spark, sf_dir)
    replay = (F.col("event_type") == "view") & (F.col("distance") >= 90)
    return e.select(
        F.lit("telemetry_sample").alias("record_type"),
        "dataset_id", F.col("dataset_id").alias("session_id"), "lap_id",
        F.concat(F.lit("e"), F.col("event_id")).alias("record_id"),
        "event_id", "micros", "participant", "condition_id", "arm", "lap_number", "event_type",
        fields(
            timestamp=qualified(F.col("micros") / F.lit(1e6), "timestamp", "ts"),
            lap_distance=qualified(F.col("distance"), "lap_distance", "k"),
            speed=qualified(F.col("speed"), "speed", "value"),
            incident_state=qualified(F.when(F.col("incident"), "1").otherwise("0"), "incident_state", "event_type"),
        ).alias("fields"),
        F.when(replay, F.array(F.lit("replay_view"))).alias("quality_flags"),
    )


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lap with its validity; sums only, so a heavy lap costs nothing extra."""
    return (
        base_events(spark, sf_dir)
        .groupBy("dataset_id", "lap_id", "lap_number", "participant")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("incident").alias("n_incidents"),
             F.min("micros").alias("start_micros"), F.max("micros").alias("end_micros"))
        .withColumn("lap_valid", F.col("n_incidents") * 2 < F.col("n_rows"))
    )


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per dataset: who drove what, where, under which condition."""
    people = (
        table(spark, sf_dir, "customer").alias("c")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("user_id"), F.lit("sim").alias("simulator"),
                F.col("c_mktsegment").alias("car"), F.col("n_name").alias("track"),
                F.col("r_name").alias("layout"))
    )
    datasets = (
        base_events(spark, sf_dir)
        .groupBy("dataset_id", "participant", "user_id", "condition_id", "arm")
        .agg(F.count(F.lit(1)).alias("records_considered"))
    )
    return datasets.join(people, "user_id", "left").drop("user_id").withColumns({
        "session_id": F.col("dataset_id"), "block_id": F.col("dataset_id")})


BINS_PER_LAP = 10


def distance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins per lap, empty ones included, with the channels of their events."""
    seen = base_events(spark, sf_dir).withColumn("distance_m", F.floor(F.col("distance") / 10).cast("int")).groupBy(
        "dataset_id", "lap_id", "distance_m").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.col("distance") % 10 / 10).alias("brake"),
        F.min(F.col("distance") / 100).alias("throttle"), F.min("speed").alias("speed_ms"),
        F.bool_or("incident").alias("_incident"))
    grid = laps(spark, sf_dir).select(
        "dataset_id", "lap_id", "lap_number", F.col("lap_valid").alias("lap_is_valid"),
        F.explode(F.sequence(F.lit(0), F.lit(BINS_PER_LAP - 1))).alias("distance_m"))
    return grid.join(seen, ["dataset_id", "lap_id", "distance_m"], "left").select(
        "dataset_id", "lap_id", "lap_number", "lap_is_valid", "distance_m",
        (F.col("distance_m") / BINS_PER_LAP).alias("lap_fraction"),
        F.coalesce("_n", F.lit(0)).alias("sample_count"), F.col("_n").isNotNull().alias("has_sample"),
        "brake", "throttle", "speed_ms",
        F.when(F.col("_incident"), "F1").otherwise("").alias("finding_keys"))


def lap_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lap from one reading of the events: rows, incidents and the stretch they are in, and a bit for each bin with samples.

    Its bins are those of ``distance_bins``. Beyond one task's rows the laps are written once for their readers.
    """
    scale = scale_of(sf_dir)
    large = not scale.times(BINS_PER_LAP).fits
    at, here = F.floor(F.col("distance") / 10), F.when(F.col("incident"), F.col("distance"))
    # The guard keeps the cast and the shift inside the lap.
    bit = F.when(at.between(0, BINS_PER_LAP - 1), F.expr("shiftleft(1, CAST(floor(distance / 10) AS INT))"))
    rows = base_events(spark, sf_dir, scale if large else None).groupBy("dataset_id", "lap_id", "lap_number").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("incident").alias("n_incidents"), F.min(here).alias("first_incident"),
        F.max(here).alias("last_incident"), F.coalesce(F.bit_or(bit), F.lit(0)).alias("sampled"))
    return stored_table(rows, "laps") if large else rows


def lap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lap summary as a session export would carry it."""
    counted = base_events(spark, sf_dir).groupBy("dataset_id", "lap_id").agg(
        F.count_distinct(F.floor(F.col("distance") / 10)).alias("sampled_bins"))
    rows = laps(spark, sf_dir).join(counted, ["dataset_id", "lap_id"])
    marks = rows.groupBy("dataset_id").agg(
        F.max_by("lap_id", F.struct("n_rows", "lap_id")).alias("_best"), F.max("lap_id").alias("_last"))
    return rows.join(marks, "dataset_id").select(
        "dataset_id", "participant", "lap_id", "lap_number", "sampled_bins",
        F.lit(BINS_PER_LAP).cast("long").alias("total_bins"),
        F.round(F.col("sampled_bins") / BINS_PER_LAP, 4).alias("coverage_fraction"),
        F.col("lap_valid").alias("is_valid"),
        ((F.col("n_incidents") == 0) & (F.col("n_rows") >= 3)).alias("is_reference"),
        (F.col("lap_id") == F.col("_best")).alias("is_best_valid_lap"),
        (F.col("lap_id") == F.col("_last")).alias("is_reviewed_lap"),
        F.when(F.col("n_incidents") == 0, "").otherwise("incident").alias("exclusion_reasons"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per dataset: the stretch between its first and last incident."""
    return base_events(spark, sf_dir).groupBy("dataset_id").agg(
        F.lit("F1").alias("finding_key"), F.min("lap_id").alias("lap_id"),
        F.floor(F.min(F.when(F.col("incident"), F.col("distance"))) / 10).cast("double").alias("start"),
        F.ceil(F.max(F.when(F.col("incident"), F.col("distance"))) / 10).cast("double").alias("end"),
    ).filter("start is not null")


# The same binding for the checking engine.
EVENTS_SQL = """
base AS (
  SELECT event_id, micros, user_id, participant,
         participant || '-w' || ((dom - 1) // 7) || '-' || condition_id AS dataset_id,
         participant || '-' || strftime(ts, '%Y%m%d') AS lap_id,
         dom AS lap_number, condition_id,
         CASE condition_id WHEN 'odd' THEN 'baseline' WHEN 'even' THEN 'intervention' END AS arm,
         event_type, speed, distance, incident
  FROM (
    SELECT *, CASE WHEN dom >= 29 THEN 'warmup' WHEN dom % 2 = 1 THEN 'odd' ELSE 'even' END AS condition_id
    FROM (
      SELECT event_id, ts, epoch_us(ts) AS micros, user_id, 'u' || user_id AS participant,
             CAST(day(ts) AS INTEGER) AS dom, event_type,
             CASE WHEN event_type <> 'signup' THEN value END AS speed,
             CAST(json_extract_string(props, '$.k') AS DOUBLE) AS distance,
             event_type = 'error' AS incident
      FROM events))),
laps AS (
  SELECT dataset_id, lap_id, lap_number, participant, count(*) AS n_rows,
         count(*) FILTER (incident) AS n_incidents, min(micros) AS start_micros, max(micros) AS end_micros,
         count(*) FILTER (incident) * 2 < count(*) AS lap_valid
  FROM base GROUP BY ALL),
contexts AS (
  SELECT d.dataset_id, d.participant, d.condition_id, d.arm, d.records_considered,
         'sim' AS simulator, p.car, p.track, p.layout,
         d.dataset_id AS session_id, d.dataset_id AS block_id
  FROM (SELECT dataset_id, participant, user_id, condition_id, arm, count(*) AS records_considered
        FROM base GROUP BY ALL) d
  LEFT JOIN (SELECT c_custkey, c_mktsegment AS car, n_name AS track, r_name AS layout
             FROM customer JOIN nation ON c_nationkey = n_nationkey
                           JOIN region ON n_regionkey = r_regionkey) p ON p.c_custkey = d.user_id)"""

BINS_SQL = EVENTS_SQL + """,
lap_table AS (
  SELECT l.dataset_id, l.participant, l.lap_id, l.lap_number, c.sampled_bins, 10::BIGINT AS total_bins,
         round(c.sampled_bins / 10.0::DOUBLE, 4) AS coverage_fraction, l.lap_valid AS is_valid,
         l.n_incidents = 0 AND l.n_rows >= 3 AS is_reference,
         l.lap_id = first_value(l.lap_id) OVER (PARTITION BY l.dataset_id ORDER BY l.n_rows DESC, l.lap_id DESC)
           AS is_best_valid_lap,
         l.lap_id = max(l.lap_id) OVER (PARTITION BY l.dataset_id) AS is_reviewed_lap,
         CASE WHEN l.n_incidents = 0 THEN '' ELSE 'incident' END AS exclusion_reasons
  FROM laps l JOIN (SELECT dataset_id, lap_id, count(DISTINCT floor(distance / 10)) AS sampled_bins
                    FROM base GROUP BY ALL) c USING (dataset_id, lap_id)),
bins AS (
  SELECT l.dataset_id, l.lap_id, l.lap_number, l.lap_valid AS lap_is_valid, g.distance_m,
         g.distance_m / 10.0::DOUBLE AS lap_fraction, coalesce(s.n, 0) AS sample_count, s.n IS NOT NULL AS has_sample,
         s.brake, s.throttle, s.speed_ms, CASE WHEN s.incident THEN 'F1' ELSE '' END AS finding_keys
  FROM laps l CROSS JOIN (SELECT unnest(range(10)) AS distance_m) g
  LEFT JOIN (SELECT dataset_id, lap_id, CAST(floor(distance / 10) AS BIGINT) AS distance_m, count(*) AS n,
                    max((distance % 10) / 10) AS brake, min(distance / 100) AS throttle, min(speed) AS speed_ms,
                    bool_or(incident) AS incident FROM base GROUP BY ALL) s
    ON s.dataset_id = l.dataset_id AND s.lap_id = l.lap_id AND s.distance_m = g.distance_m),
findings AS (
  SELECT dataset_id, 'F1' AS finding_key, min(lap_id) AS lap_id,
         floor(min(distance) FILTER (incident) / 10) AS "start", ceil(max(distance) FILTER (incident) / 10) AS "end"
  FROM base GROUP BY dataset_id HAVING count(*) FILTER (incident) > 0)"""
