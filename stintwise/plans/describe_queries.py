"""Descriptive queries (group D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.operators import describe
from stintwise.operators.computations import Computation, run_computations
from stintwise.operators.quantiles import robust_summary
from stintwise.plans.bindings import EVENTS_SQL, base_events, samples, scale_of, table
from stintwise.plans.registry import query
from stintwise.vocabulary import CONCEPT_UNITS

STATS = ("minimum", "maximum", "mean", "median", "q1", "q3", "mad")


def rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.round(s, 9).alias(s) for s in STATS])


def summary_sql(source: str, key: str, value: str) -> str:
    return f"""
SELECT {key}, count({value}) AS n_values, round(min({value}), 9) AS minimum, round(max({value}), 9) AS maximum,
       round(avg({value}), 9) AS mean, round(quantile_cont({value}, 0.5), 9) AS median,
       round(quantile_cont({value}, 0.25), 9) AS q1, round(quantile_cont({value}, 0.75), 9) AS q3,
       round(mad({value}), 9) AS mad
FROM {source} GROUP BY {key} HAVING count({value}) > 0"""


@query("d1_robust_summary", "WITH " + EVENTS_SQL + summary_sql("base", "event_type", "speed"))
def d1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(robust_summary(base_events(spark, sf), ["event_type"], "speed", scale_of(sf)),
                   ["event_type", "n_values"])


@query("d1_price_summary_by_brand", summary_sql("part JOIN lineitem ON p_partkey = l_partkey", "p_brand", "l_extendedprice"))
def d1_brand(spark: SparkSession, sf: str) -> DataFrame:
    scale = scale_of(sf, "lineitem")
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_extendedprice").join(
        table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    return rounded(robust_summary(rows, ["p_brand"], "l_extendedprice", scale), ["p_brand", "n_values"])


@query("d2_record_inventory", "WITH " + EVENTS_SQL + """
SELECT 'record_type' AS kind, 'telemetry_sample' AS name, count(*) AS n FROM base
UNION ALL
SELECT 'quality_flag', 'replay_view', count(*) FROM base WHERE event_type = 'view' AND distance >= 90""")
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return describe.record_inventory(samples(spark, sf))


_CONCEPTS_SQL = ", ".join(f"('{c}')" for c in CONCEPT_UNITS)


@query("d3_concept_availability", "WITH " + EVENTS_SQL + f""",
t AS (SELECT count(*) AS n, count(speed) AS s FROM base)
SELECT concept, n AS records_scanned,
       CASE WHEN concept IN ('timestamp', 'lap_distance', 'speed', 'incident_state') THEN n ELSE 0 END AS present,
       CASE WHEN concept = 'speed' THEN s WHEN concept IN ('timestamp', 'lap_distance', 'incident_state')
            THEN n ELSE 0 END AS measured,
       0::BIGINT AS derived, 0::BIGINT AS estimated,
       CASE WHEN concept = 'speed' THEN n - s ELSE 0 END AS unavailable
FROM t, (VALUES {_CONCEPTS_SQL}) c(concept)""")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    return describe.concept_availability(samples(spark, sf), "telemetry_sample")


def _d4_sql(key: str) -> str:
    return "WITH " + EVENTS_SQL + f"""
SELECT {key}, count(*) AS records_of_type, count(*) AS field_present, count(*) - count(speed) AS values_unavailable,
       count(speed) AS values_included,
       round(min(speed), 9) AS minimum, round(max(speed), 9) AS maximum, round(avg(speed), 9) AS mean,
       round(quantile_cont(speed, 0.5), 9) AS median, round(quantile_cont(speed, 0.25), 9) AS q1,
       round(quantile_cont(speed, 0.75), 9) AS q3, round(mad(speed), 9) AS mad
FROM base GROUP BY {key}"""


def _d4(spark: SparkSession, sf: str, key: str) -> DataFrame:
    out = describe.descriptive_summary(samples(spark, sf), "telemetry_sample", "speed", [key], scale_of(sf))
    return rounded(out, [key, "records_of_type", "field_present", "values_unavailable", "values_included"])


@query("d4_summary_by_lap", _d4_sql("lap_id"))
def d4_lap(spark: SparkSession, sf: str) -> DataFrame:
    return _d4(spark, sf, "lap_id")


@query("d4_summary_by_dataset", _d4_sql("dataset_id"))
def d4_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return _d4(spark, sf, "dataset_id")


@query("d5_event_yield", "WITH " + EVENTS_SQL + """
SELECT 'total' AS level, 'all' AS name, count(*) AS n FROM base
UNION ALL SELECT 'lap', lap_id, count(*) FROM base GROUP BY lap_id
UNION ALL SELECT 'event_type', event_type, count(*) FROM base GROUP BY event_type""")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf).withColumn("record_type", F.lit("driver_input_event"))
    return describe.event_yield(rows, "driver_input_event")


@query("d6_one_scan_many_computations", "WITH " + EVENTS_SQL + """
SELECT count(*) AS records, count(speed) AS speeds, min(speed) AS slowest, max(speed) AS fastest,
       count(DISTINCT participant) AS participants, count(*) FILTER (incident) AS incidents,
       min(micros) AS first_micros, max(micros) AS last_micros FROM base""")
def d6(spark: SparkSession, sf: str) -> DataFrame:
    return base_events(spark, sf).agg(
        F.count(F.lit(1)).alias("records"), F.count("speed").alias("speeds"), F.min("speed").alias("slowest"),
        F.max("speed").alias("fastest"), F.count_distinct("participant").alias("participants"),
        F.count_if("incident").alias("incidents"), F.min("micros").alias("first_micros"),
        F.max("micros").alias("last_micros"))


COMPUTATIONS = (
    Computation("inventory", "record_inventory"),
    Computation("availability", "concept_availability", "telemetry_sample"),
    Computation("speed_by_lap", "descriptive_summary", "telemetry_sample", "speed", "lap_id"),
    Computation("position", "descriptive_summary", "telemetry_sample", "lap_distance"),
    Computation("yield", "event_yield", "driver_input_event"),
)


def _group_sql(computation: str, group: str, value: str) -> str:
    return f"""
SELECT '{computation}', 'group', {group}, NULL, count(*), count(*), count({value}), 0, 0, count(*) - count({value}),
       min({value}), max({value}), round(avg({value}), 9), round(quantile_cont({value}, 0.5), 9),
       round(quantile_cont({value}, 0.25), 9), round(quantile_cont({value}, 0.75), 9), round(mad({value}), 9)
FROM base GROUP BY {group}"""


_NO_STATS = ", ".join(f"NULL::DOUBLE AS {s}" for s in STATS)


@query("d6_computations", "WITH " + EVENTS_SQL + f"""
SELECT 'inventory' AS computation, 'record_type' AS level, NULL::VARCHAR AS "group", record_type AS name, count(*) AS n,
       0::BIGINT AS present, 0::BIGINT AS measured, 0::BIGINT AS derived, 0::BIGINT AS estimated, 0::BIGINT AS unavailable, {_NO_STATS}
FROM (SELECT CASE WHEN event_type = 'view' THEN 'driver_input_event' ELSE 'telemetry_sample' END AS record_type FROM base) GROUP BY record_type
UNION ALL
SELECT 'inventory', 'quality_flag', NULL, 'replay_view', count(*), 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM base WHERE event_type = 'view' AND distance >= 90 HAVING count(*) > 0
UNION ALL
SELECT 'availability', 'scanned', NULL, NULL, count(*), 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM base WHERE event_type <> 'view'
UNION ALL
SELECT 'availability', 'concept', NULL, concept,
       CASE WHEN concept IN ('timestamp', 'lap_distance', 'speed', 'incident_state') THEN n ELSE 0 END,
       CASE WHEN concept IN ('timestamp', 'lap_distance', 'speed', 'incident_state') THEN n ELSE 0 END,
       CASE WHEN concept = 'speed' THEN s WHEN concept IN ('timestamp', 'lap_distance', 'incident_state') THEN n ELSE 0 END,
       0, 0, CASE WHEN concept = 'speed' THEN n - s ELSE 0 END, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM (SELECT count(*) AS n, count(speed) AS s FROM base WHERE event_type <> 'view'), (VALUES {_CONCEPTS_SQL}) c(concept)
UNION ALL {_group_sql("speed_by_lap", "lap_id", "speed").replace("FROM base", "FROM base WHERE event_type <> 'view'")}
UNION ALL {_group_sql("position", "NULL", "distance").replace("FROM base GROUP BY NULL", "FROM base WHERE event_type <> 'view' HAVING count(*) > 0")}
UNION ALL
SELECT 'yield', u.level, NULL, u.name, count(*), 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM base, LATERAL (VALUES ('total', 'all'), ('lap', lap_id), ('event_type', event_type)) u(level, name)
WHERE base.event_type = 'view' GROUP BY u.level, u.name""")
def d6_computations(spark: SparkSession, sf: str) -> DataFrame:
    # Views stand in for a second type of records.
    rows = samples(spark, sf).withColumn("record_type", F.when(
        F.col("event_type") == "view", "driver_input_event").otherwise("telemetry_sample"))
    return rounded(run_computations(rows, COMPUTATIONS, scale_of(sf)), [
        "computation", "level", "group", "name", "n", "present", "measured", "derived", "estimated", "unavailable"])


@query("d7_summary_invariants","WITH " + EVENTS_SQL + """,
s AS (SELECT lap_id, count(*) AS n, count(speed) AS v FROM base GROUP BY lap_id)
SELECT lap_id, 'attrition_order' AS rule FROM s WHERE n % 2 = 1""")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    # Summaries of odd-sized laps get a wrong counter, which the audit has to find.
    out = describe.descriptive_summary(samples(spark, sf), "telemetry_sample", "speed", ["lap_id"], scale_of(sf))
    spoilt = out.withColumn("field_present", F.col("field_present") - F.col("records_of_type") % 2)
    return describe.audit_summaries(spoilt, ["lap_id"])
