"""Segment, evidence and pairing queries (groups E and F) and the paired estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.functions.cells import identifier
from stintwise.operators import evidence as ev
from stintwise.operators.quantiles import medians
from stintwise.operators.segments import (
    Phase, Segment, applicability, covered_cells, geometry_conflicts, in_region, position, selects, tag_segments,
)
from stintwise.plans.bindings import EVENTS_SQL, contexts, laps, minute_slot, samples, scale_of, table
from stintwise.operators.spread import settle
from stintwise.plans.registry import query
from stintwise.schema import reading

CORNER = Segment("corner-a", 20, 60, required_concepts=("speed", "lap_distance"), minimum_coverage=0.5)
WRAP = Segment("start-finish", 90, 10, wraparound=True, end_inclusive=True)
FAST = Segment("fast-corner", 20, 60, phase=Phase("speed", 50.0))
MINIMUM = ev.Extractor()
RULES = {
    "protocol_mismatch": ("r-protocol", True), "outside_segment": ("r-segment", True),
    "invalid_lap": ("r-lap", True), "incident_affected": ("r-incident", True),
    "pit_replay_discontinuity": ("r-replay", False), "insufficient_coverage": ("r-coverage", True),
}
FIXED = {"out_of_order_or_corrupt": "structurally_invalid", "missing_required_channel": "unavailable",
         "record_type_not_read": "excluded_by_preregistered_rule", "unpaired_units": "excluded_by_preregistered_rule"}

# SQL of the cascade for the corner segment; order of the branches is the order of the stages.
STAGED_SQL = "WITH " + EVENTS_SQL + """,
staged AS (
  SELECT b.*, CASE
    WHEN b.arm IS NULL THEN 'protocol_mismatch'
    WHEN NOT (b.distance >= 20 AND b.distance < 60) THEN 'outside_segment'
    WHEN NOT l.lap_valid THEN 'invalid_lap'
    WHEN b.speed IS NULL THEN 'missing_required_channel'
    WHEN b.incident THEN 'incident_affected'
    WHEN b.event_type = 'view' AND b.distance >= 90 THEN 'pit_replay_discontinuity'
  END AS exit_stage
  FROM base b LEFT JOIN laps l USING (dataset_id, lap_id))"""

UNITS_SQL = STAGED_SQL + """,
units0 AS (
  SELECT dataset_id, lap_id, any_value(participant) AS participant, any_value(arm) AS arm,
         any_value(lap_number) AS lap_number,
         min(speed) AS value, count(*) AS records, count(speed) AS used
  FROM staged WHERE exit_stage IS NULL GROUP BY dataset_id, lap_id),
units AS (
  SELECT *, dataset_id || '-' || lap_id AS unit_id, 'participant=' || participant AS pair_key,
         row_number() OVER (PARTITION BY participant, arm ORDER BY dataset_id, lap_number, lap_id) - 1 AS order_index
  FROM units0),
pairs AS (
  SELECT b.pair_key, b.order_index, b.unit_id || '-' || i.unit_id AS pair_id, b.participant AS cluster_id,
         b.participant, b.unit_id AS baseline_unit_id, i.unit_id AS intervention_unit_id,
         b.value AS baseline_value, i.value AS intervention_value, i.value - b.value AS difference
  FROM units b JOIN units i ON b.pair_key = i.pair_key AND b.order_index = i.order_index
       AND b.arm = 'baseline' AND i.arm = 'intervention')"""


def classified(spark: SparkSession, sf: str, segment: Segment = CORNER, extractor: ev.Extractor = MINIMUM) -> DataFrame:
    return ev.classify(samples(spark, sf), laps(spark, sf), segment, extractor, scale=scale_of(sf))


def survivors(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).filter(F.col("exit_stage").isNull())


def lap_units(spark: SparkSession, sf: str, segment: Segment = CORNER, extractor: ev.Extractor = MINIMUM,
              dispersion: bool = False) -> DataFrame:
    """All lap units, those short of coverage included."""
    kept = classified(spark, sf, segment, extractor).filter(F.col("exit_stage").isNull())
    formed = ev.form_units(kept, segment, extractor, ["dataset_id", "lap_id", "lap_number"], dispersion,
                           scale=scale_of(sf))
    return settle(formed, scale_of(sf))


def units(spark: SparkSession, sf: str, segment: Segment = CORNER, extractor: ev.Extractor = MINIMUM,
          dispersion: bool = False, pair_fields: list[str] | None = None) -> DataFrame:
    """Kept lap units with context and order index."""
    formed = lap_units(spark, sf, segment, extractor, dispersion)
    return settle(ev.describe_units(
        formed, contexts(spark, sf), "lap_id", pair_fields or ["participant"], scale=scale_of(sf)), scale_of(sf))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ev.pair_units(units(spark, sf))


@query("e1_applicability", "WITH " + EVENTS_SQL + """
SELECT dataset_id, simulator, track, layout,
       CASE layout WHEN 'EUROPE' THEN 'g-eu' WHEN 'ASIA' THEN 'g-asia' END AS geometry,
       CASE WHEN layout IS NULL OR layout NOT IN ('EUROPE', 'ASIA')
            THEN concat_ws(' ', 'segment corner-a does not apply to', concat_ws('/', simulator, track, layout)) END AS problem
FROM contexts""")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    listed = tuple(("sim", f"NATION_{n}", r, g) for r, g in (("EUROPE", "g-eu"), ("ASIA", "g-asia")) for n in range(25))
    return applicability(contexts(spark, sf), Segment("corner-a", 20, 60, applies_to=listed)).select(
        "dataset_id", "simulator", "track", "layout", "geometry", "problem")


@query("e2_geometry_conflicts", "WITH " + EVENTS_SQL + """,
g AS (SELECT car, CASE layout WHEN 'EUROPE' THEN 'g-eu' WHEN 'ASIA' THEN 'g-asia' END AS geometry FROM contexts)
SELECT car, count(DISTINCT geometry) AS geometries, min(geometry) AS first_geometry, max(geometry) AS last_geometry
FROM g WHERE geometry IS NOT NULL GROUP BY car HAVING count(DISTINCT geometry) > 1""")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    listed = tuple(("sim", f"NATION_{n}", r, g) for r, g in (("EUROPE", "g-eu"), ("ASIA", "g-asia")) for n in range(25))
    applied = applicability(contexts(spark, sf), Segment("corner-a", 20, 60, applies_to=listed))
    return geometry_conflicts(applied, ["car"])


@query("e3_record_position", "WITH " + EVENTS_SQL + """
SELECT 'e' || event_id AS record_id, distance AS position FROM base""")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select("record_id", position().alias("position"))


@query("e4_region_membership", "WITH " + EVENTS_SQL + """
SELECT dataset_id, count(*) FILTER (distance >= 20 AND distance < 60) AS in_corner,
       count(*) FILTER (distance >= 90 OR distance <= 10) AS in_wrap,
       count(*) FILTER (distance > 20 AND distance <= 60) AS in_shifted
FROM base GROUP BY dataset_id""")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    shifted = Segment("shifted", 20, 60, start_inclusive=False, end_inclusive=True)
    return samples(spark, sf).groupBy("dataset_id").agg(
        F.count_if(in_region(CORNER, position())).alias("in_corner"),
        F.count_if(in_region(WRAP, position())).alias("in_wrap"),
        F.count_if(in_region(shifted, position())).alias("in_shifted"))


@query("e6_segment_selection", "WITH " + EVENTS_SQL + """
SELECT dataset_id, s.segment, count(*) AS records, count(speed) AS speeds
FROM base, LATERAL (SELECT unnest(list_filter([
  CASE WHEN distance >= 20 AND distance < 60 THEN 'corner-a' END,
  CASE WHEN distance >= 90 OR distance <= 10 THEN 'start-finish' END,
  CASE WHEN distance >= 20 AND distance < 60 AND speed >= 50 THEN 'fast-corner' END], lambda x: x IS NOT NULL)) AS segment) s
GROUP BY dataset_id, s.segment""")
def e6(spark: SparkSession, sf: str) -> DataFrame:
    return tag_segments(samples(spark, sf), [CORNER, WRAP, FAST]).groupBy("dataset_id", "segment").agg(
        F.count(F.lit(1)).alias("records"), F.count(reading("speed")).alias("speeds"))


@query("e7_concept_coverage", "WITH " + EVENTS_SQL + """
SELECT lap_id, count(*) AS records, (count(speed) + count(distance)) / (count(*) * 2.0::DOUBLE) AS coverage_ratio
FROM base WHERE distance >= 20 AND distance < 60 GROUP BY lap_id""")
def e7(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).filter(selects(CORNER)).groupBy("lap_id").agg(
        F.count(F.lit(1)).alias("records"),
        (F.sum(covered_cells(CORNER)) / (F.count(F.lit(1)) * 2)).alias("coverage_ratio"))


@query("f1_dataset_context", "WITH " + EVENTS_SQL + """
SELECT dataset_id, session_id, participant, simulator, car, track, layout, condition_id, block_id, arm,
       CASE condition_id WHEN 'even' THEN 'coached' WHEN 'odd' THEN 'not_coached' ELSE 'unknown' END AS coaching_state,
       records_considered FROM contexts""")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return contexts(spark, sf).select(
        "dataset_id", "session_id", "participant", "simulator", "car", "track", "layout", "condition_id",
        "block_id", "arm",
        F.when(F.col("condition_id") == "even", "coached").when(F.col("condition_id") == "odd", "not_coached")
        .otherwise("unknown").alias("coaching_state"),
        "records_considered")


@query("f3_out_of_order_records", "WITH " + EVENTS_SQL + """,
m AS (SELECT dataset_id, event_id, micros, CAST(floor(micros / 60000000) AS BIGINT) AS minute, distance,
             max(distance) OVER (PARTITION BY dataset_id ORDER BY micros, event_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM base)
SELECT dataset_id, count(*) AS records, count(*) FILTER (distance <= coalesce(highest, -1)) AS out_of_order
FROM m GROUP BY dataset_id""")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    # The payload number stands in for the stored sequence index, so regressions really occur.
    rows = samples(spark, sf).withColumn("sequence_index", reading("lap_distance").cast("long"))
    return ev.mark_out_of_order(rows, ["micros", "event_id"], minute_slot(), scale_of(sf)).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("out_of_order").alias("out_of_order"))


@query("f5_exclusion_cascade", STAGED_SQL + """
SELECT arm, coalesce(exit_stage, 'kept') AS exit_stage, count(*) AS records, count(speed) AS speeds
FROM staged GROUP BY ALL""")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    return classified(spark, sf).groupBy("arm", F.coalesce("exit_stage", F.lit("kept")).alias("exit_stage")).agg(
        F.count(F.lit(1)).alias("records"), F.count(reading("speed")).alias("speeds"))


@query("f6_attrition_funnel", STAGED_SQL + """,
plan(level, step, stage, rule_id, disposition) AS (VALUES
  ('record', 0, 'records_streamed', NULL, 'counted'),
  ('record', 1, 'protocol_mismatch', 'r-protocol', 'excluded_by_preregistered_rule'),
  ('record', 2, 'out_of_order_or_corrupt', NULL, 'structurally_invalid'),
  ('record', 3, 'record_type_not_read', NULL, 'excluded_by_preregistered_rule'),
  ('record', 4, 'outside_segment', 'r-segment', 'excluded_by_preregistered_rule'),
  ('record', 5, 'invalid_lap', 'r-lap', 'excluded_by_preregistered_rule'),
  ('record', 6, 'missing_required_channel', NULL, 'unavailable'),
  ('record', 7, 'incident_affected', 'r-incident', 'excluded_by_preregistered_rule'),
  ('record', 8, 'pit_replay_discontinuity', 'r-replay', 'post_hoc_exclusion')),
n AS (SELECT p.*, CASE WHEN step = 0 THEN 0 ELSE (SELECT count(*) FROM staged s WHERE s.exit_stage = p.stage) END AS excluded
      FROM plan p)
SELECT level, step, stage, rule_id, disposition, excluded,
       CAST((SELECT count(*) FROM staged) - sum(excluded) OVER (ORDER BY step) + excluded AS BIGINT) AS considered,
       CAST((SELECT count(*) FROM staged) - sum(excluded) OVER (ORDER BY step) AS BIGINT) AS remaining
FROM n""")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return ev.ledger(classified(spark, sf), "record", "records_streamed", list(ev.RECORD_STAGES), RULES, FIXED)


@query("f6_unit_and_pair_funnel", UNITS_SQL + """,
pl AS (SELECT count(*) AS u, (SELECT count(*) FROM pairs) AS p FROM units)
SELECT 'unit' AS level, 0 AS step, 'units_formed' AS stage, u AS considered, 0::BIGINT AS excluded, u AS remaining FROM pl
UNION ALL SELECT 'unit', 1, 'insufficient_coverage', u, 0, u FROM pl
UNION ALL SELECT 'pair', 0, 'pairable_units', u, 0, u FROM pl
UNION ALL SELECT 'pair', 1, 'unpaired_units', u, u - 2 * p, 2 * p FROM pl""")
def f6_levels(spark: SparkSession, sf: str) -> DataFrame:
    formed = lap_units(spark, sf)
    u = settle(ev.describe_units(formed, contexts(spark, sf), "lap_id", ["participant"], scale=scale_of(sf)),
               scale_of(sf))
    pairing = ev.match_units(u).select(F.explode(F.array_compact(F.array("b", "i"))), F.when(
        F.col("b").isNull() | F.col("i").isNull(), "unpaired_units").alias("exit_stage"))
    cols = ["level", "step", "stage", "considered", "excluded", "remaining"]
    return ev.ledger(formed, "unit", "units_formed", ["insufficient_coverage"], RULES, FIXED).select(*cols).unionByName(
        ev.ledger(pairing, "pair", "pairable_units", ["unpaired_units"], RULES, FIXED).select(*cols))


@query("f7_units_by_lap", UNITS_SQL + """
SELECT unit_id, dataset_id, lap_id, participant, arm, lap_number, value, records, used FROM units""")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select(
        "unit_id", "dataset_id", "lap_id", "participant", "arm", "lap_number", "value", "records", "used")


@query("f7_units_by_block", STAGED_SQL + """
SELECT dataset_id AS block_id, max(speed) AS value, count(*) AS records FROM staged WHERE exit_stage IS NULL GROUP BY 1""")
def f7_block(spark: SparkSession, sf: str) -> DataFrame:
    kept = survivors(spark, sf)
    return ev.form_units(kept, CORNER, ev.Extractor(method="maximum"), ["dataset_id"]).select(
        F.col("dataset_id").alias("block_id"), "value", "records")


@query("f8_segment_aggregates", STAGED_SQL + """
SELECT participant, min(speed) AS minimum, max(speed) AS maximum, round(avg(speed), 9) AS mean,
       round(quantile_cont(speed, 0.5), 9) AS median
FROM staged WHERE exit_stage IS NULL GROUP BY participant""")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    kept = survivors(spark, sf)
    out = None
    for method, name in (("minimum", "minimum"), ("maximum", "maximum"), ("arithmetic_mean", "mean"), ("median", "median")):
        one = ev.form_units(kept, CORNER, ev.Extractor(method=method), ["participant"], scale=scale_of(sf)).select(
            "participant", F.round("value", 9).alias(name))
        out = one if out is None else out.join(one, "participant")
    return out


@query("f9_threshold_distance", STAGED_SQL + """
SELECT participant, min(distance) FILTER (speed >= 100) AS first_at, max(distance) FILTER (speed >= 100) AS last_at,
       count(*) FILTER (speed >= 100) AS used
FROM staged WHERE exit_stage IS NULL GROUP BY participant""")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    kept = survivors(spark, sf)
    first = ev.Extractor(kind="segment_threshold_distance", threshold=100.0)
    last = ev.Extractor(kind="segment_threshold_distance", threshold=100.0, first=False)
    a = ev.form_units(kept, CORNER, first, ["participant"]).select("participant", F.col("value").alias("first_at"), "used")
    return a.join(ev.form_units(kept, CORNER, last, ["participant"]).select(
        "participant", F.col("value").alias("last_at")), "participant")


@query("f10_record_field", "WITH " + EVENTS_SQL + """
SELECT lap_id, max(micros / 1e6::DOUBLE) AS value, count(*) AS records,
       CASE WHEN count(*) > 1 THEN 'ambiguous_unit' END AS exit_stage
FROM base b JOIN laps l USING (dataset_id, lap_id)
WHERE b.arm IS NOT NULL AND l.lap_valid AND NOT incident AND NOT (event_type = 'view' AND distance >= 90)
GROUP BY lap_id""")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    field = ev.Extractor(concept="timestamp", kind="record_field")
    kept = classified(spark, sf, CORNER, field).filter(F.col("exit_stage").isNull())
    return ev.form_units(kept, CORNER, field, ["lap_id"]).select("lap_id", "value", "records", "exit_stage")


@query("f11_within_unit_dispersion", STAGED_SQL + """,
m AS (SELECT participant, median(speed) AS med FROM staged WHERE exit_stage IS NULL GROUP BY 1)
SELECT participant, round(median(abs(speed - med)), 9) AS within_unit_dispersion, count(speed) AS used,
       count(*) - count(speed) AS missing
FROM staged JOIN m USING (participant) WHERE exit_stage IS NULL GROUP BY participant""")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    kept = survivors(spark, sf)
    return ev.form_units(kept, CORNER, ev.Extractor(method="median"), ["participant"], dispersion=True, scale=scale_of(sf)).select(
        "participant", F.round("within_unit_dispersion", 9).alias("within_unit_dispersion"), "used", "missing")


@query("f12_unit_sufficiency", STAGED_SQL + """
SELECT lap_id, count(*) AS records, count(speed) / count(*)::DOUBLE AS coverage_ratio,
       CASE WHEN count(*) < 2 OR min(speed) IS NULL THEN 'insufficient_coverage' END AS exit_stage
FROM staged WHERE exit_stage IS NULL GROUP BY lap_id""")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    strict = Segment("corner-a", 20, 60, minimum_records=2, minimum_coverage=0.5)
    kept = survivors(spark, sf)
    return ev.form_units(kept, strict, MINIMUM, ["lap_id"]).select("lap_id", "records", "coverage_ratio", "exit_stage")


@query("f13_stable_ids", """
SELECT doc_id, CASE WHEN length(j) <= 128 THEN j
  ELSE substr(j, 1, 111) || '-' || substr(sha256(j), 1, 16) END AS identifier
FROM (SELECT doc_id, source || '-' || lang || '-' || text AS j FROM documents)""")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", identifier(F.col("source"), F.col("lang"), F.col("text")).alias("identifier"))


@query("f15_holdout", UNITS_SQL + """
SELECT unit_id, dataset_id LIKE '%-w3-%' AS holdout FROM units""")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return ev.describe_units(lap_units(spark, sf), contexts(spark, sf), "lap_id", ["participant"],
                             holdout=F.col("block_id").like("%-w3-%"), scale=scale_of(sf)).select("unit_id", "holdout")


@query("f16_pair_keys", UNITS_SQL + """
SELECT u.unit_id, concat_ws('|', 'participant=' || u.participant, 'car=' || coalesce(c.car, 'None'),
       'layout=' || coalesce(c.layout, 'None')) AS pair_key
FROM units u LEFT JOIN contexts c USING (dataset_id)""")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf, pair_fields=["participant", "car", "layout"]).select("unit_id", "pair_key")


@query("f17_order_index", UNITS_SQL + """
SELECT unit_id, pair_key, arm, order_index FROM units""")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select("unit_id", "pair_key", "arm", "order_index")


@query("f18_pairing", UNITS_SQL + """
SELECT pair_id, pair_key, order_index, cluster_id, baseline_unit_id, intervention_unit_id,
       baseline_value, intervention_value, round(difference, 9) AS difference FROM pairs""")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select(
        "pair_id", "pair_key", "order_index", "cluster_id", "baseline_unit_id", "intervention_unit_id",
        "baseline_value", "intervention_value", F.round("difference", 9).alias("difference"))


@query("f19_unpaired_units", UNITS_SQL + """
SELECT unit_id, pair_key, arm, order_index FROM units u
WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE u.unit_id IN (p.baseline_unit_id, p.intervention_unit_id))""")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    return ev.unpaired_units(units(spark, sf)).select("unit_id", "pair_key", "arm", "order_index")


@query("f20_cluster_ids", UNITS_SQL + """
SELECT p.pair_id, p.participant AS by_participant, bu.dataset_id || '+' || iu.dataset_id AS by_block
FROM pairs p JOIN units bu ON bu.unit_id = p.baseline_unit_id JOIN units iu ON iu.unit_id = p.intervention_unit_id""")
def f20(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    return ev.pair_units(u, cluster="participant").select("pair_id", F.col("cluster_id").alias("by_participant")).join(
        ev.pair_units(u, cluster="block").select("pair_id", F.col("cluster_id").alias("by_block")), "pair_id")


@query("f21_unit_covariates", UNITS_SQL + """
SELECT u.unit_id, CAST(u.lap_number AS VARCHAR) AS lap_number, CAST(u.order_index AS VARCHAR) AS order_index, c.car
FROM units u LEFT JOIN contexts c USING (dataset_id)""")
def f21(spark: SparkSession, sf: str) -> DataFrame:
    held = F.create_map(
        F.lit("lap_number"), F.col("lap_number").cast("string"),
        F.lit("order_index"), F.col("order_index").cast("string"), F.lit("car"), F.col("car"))
    return units(spark, sf).withColumn("covariates", held).select(
        "unit_id", *[F.col("covariates")[c].alias(c) for c in ("lap_number", "order_index", "car")])


@query("f22_evidence_counts", UNITS_SQL + """
SELECT 'all' AS scope, count(*) AS included_units, count(*) FILTER (arm = 'baseline') AS baseline_units,
       count(*) FILTER (arm = 'intervention') AS intervention_units, 0::BIGINT AS holdout_units,
       count(DISTINCT participant) AS participants, count(DISTINCT dataset_id) AS sessions,
       count(DISTINCT dataset_id) AS blocks, (SELECT count(*) FROM pairs) AS pairs,
       (SELECT count(DISTINCT cluster_id) FROM pairs) AS clusters,
       count(*) - 2 * (SELECT count(*) FROM pairs) AS unpaired_units
FROM units""")
def f22(spark: SparkSession, sf: str) -> DataFrame:
    u = units(spark, sf)
    return ev.evidence_counts(u, ev.pair_units(u))


@query("f28_evidence_audit", STAGED_SQL + """
SELECT 'exclusion_without_rule' AS "check", 'incident_affected' AS subject, CAST(count(*) AS VARCHAR) AS detail
FROM staged WHERE exit_stage = 'incident_affected'""")
def f28(spark: SparkSession, sf: str) -> DataFrame:
    # The incident rule is left out on purpose, so the audit has something to find.
    rules = {k: v for k, v in RULES.items() if k != "incident_affected"}
    u = units(spark, sf)
    funnel = ev.ledger(classified(spark, sf), "record", "records_streamed", list(ev.RECORD_STAGES), rules, FIXED)
    return ev.audit_evidence(u, ev.pair_units(u), funnel)


@query("f28_recomputed_values", UNITS_SQL + """,
lone AS (SELECT * FROM units WHERE unit_id NOT IN (SELECT baseline_unit_id FROM pairs UNION ALL SELECT intervention_unit_id FROM pairs)),
stated AS (SELECT * FROM units WHERE order_index % 7 <> 5),
listed AS (SELECT unit_id FROM lone UNION ALL SELECT unit_id FROM lone WHERE order_index % 4 = 1),
said AS (SELECT count(*) AS u, count(*) FILTER (arm = 'baseline') AS b, count(*) FILTER (arm = 'intervention') AS i FROM units),
anew AS (SELECT count(*) AS u, count(*) FILTER (arm = 'baseline') AS b, count(*) FILTER (arm = 'intervention') AS i FROM stated)
SELECT 'unit_without_source' AS "check", unit_id AS subject FROM stated WHERE lap_number % 11 = 4
UNION ALL SELECT 'unit_left_out', dataset_id || '|' || lap_id || '|' || lap_number FROM units WHERE lap_number % 11 <> 4 AND order_index % 7 = 5
UNION ALL SELECT 'value_not_recomputed', unit_id FROM stated WHERE lap_number % 11 <> 4 AND order_index % 7 = 3
UNION ALL SELECT 'record_counts_not_recomputed', unit_id FROM stated WHERE lap_number % 11 <> 4 AND order_index % 13 = 6
UNION ALL SELECT 'unit_neither_or_twice_paired', unit_id FROM lone WHERE order_index % 7 <> 5 AND order_index % 4 = 1
UNION ALL SELECT 'unknown_unit', unit_id FROM units WHERE order_index % 7 = 5
UNION ALL SELECT 'pair_value_differs', unit_id FROM stated WHERE order_index % 7 = 3 AND unit_id NOT IN (SELECT unit_id FROM lone)
UNION ALL SELECT 'arm_differs', unit_id FROM lone WHERE order_index % 7 <> 5 AND order_index % 3 = 0
UNION ALL SELECT 'difference_not_recomputed', pair_id FROM pairs WHERE order_index % 5 = 2
UNION ALL SELECT 'count_differs', 'included_units' FROM said, anew WHERE said.u <> anew.u
UNION ALL SELECT 'count_differs', 'baseline_units' FROM said, anew WHERE said.b <> anew.b
UNION ALL SELECT 'count_differs', 'intervention_units' FROM said, anew WHERE said.i <> anew.i
UNION ALL SELECT 'count_differs', 'unpaired_units' WHERE (SELECT count(*) FROM listed) <> (SELECT count(*) FROM lone)""")
def f28_values(spark: SparkSession, sf: str) -> DataFrame:
    # Every kind of statement is spoilt for some units, so that every check has something to find.
    formed, scale = lap_units(spark, sf), scale_of(sf)
    whole = settle(ev.describe_units(formed, contexts(spark, sf), "lap_id", ["participant"], scale=scale), scale)
    pairing, lone = ev.pair_units(whole), ev.unpaired_units(whole)
    k = F.col("order_index")
    stated = whole.filter(k % 7 != 5).withColumns({
        "value": F.when(k % 7 == 3, F.col("value") + 1).otherwise(F.col("value")),
        "records": F.when(k % 13 == 6, F.col("records") + 1).otherwise(F.col("records"))})
    listed = lone.withColumn("arm", F.when(k % 3 == 0, "other").otherwise(F.col("arm"))).unionByName(lone.filter(k % 4 == 1))
    return ev.audit_values(
        stated, pairing.withColumn("difference", F.when(k % 5 == 2, F.col("difference") + 1).otherwise(F.col("difference"))),
        listed, formed.filter("lap_number % 11 <> 4"), ev.evidence_counts(whole, pairing),
        ["dataset_id", "lap_id", "lap_number"]).select("check", "subject")


@query("g6_paired_difference", UNITS_SQL + """
SELECT participant, count(*) AS pairs, round(quantile_cont(difference, 0.5), 9) AS median_difference,
       round(avg(difference), 9) AS mean_difference
FROM pairs GROUP BY participant""")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    p = settle(pairs(spark, sf), scale_of(sf)).withColumn("participant", F.col("cluster_id"))
    middle = medians(p, ["participant"], "difference", "median_difference", scale_of(sf))
    mean = p.groupBy("participant").agg(F.avg("difference").alias("mean_difference"))
    return middle.join(mean, "participant").select(
        "participant", F.col("n").alias("pairs"), F.round("median_difference", 9).alias("median_difference"),
        F.round("mean_difference", 9).alias("mean_difference"))
