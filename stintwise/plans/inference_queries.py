"""Comparability (F23-F27) and inference queries (group G): one comparison per car."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.operators import bootstrap as bs
from stintwise.operators import comparability as cmp
from stintwise.operators import evidence as ev
from stintwise.operators import inference, sensitivity, stats
from stintwise.operators.quantiles import robust_summary
from stintwise.operators.spread import settle
from stintwise.operators.theilsen import theil_sen
from stintwise.plans.bindings import EVENTS_SQL, base_events, contexts, scale_of
from stintwise.plans.evidence_queries import UNITS_SQL, lap_units, units
from stintwise.plans.registry import query
from stintwise.session import cut_lineage

DRAWS = 200
SEED = 7
COVERAGE = 0.9
THRESHOLD = 5.0
ALPHA = 0.05

PAIRS_SQL = UNITS_SQL + """,
cars AS (SELECT DISTINCT participant, coalesce(car, 'none') AS car FROM contexts),
u AS (SELECT units.*, cars.car FROM units JOIN cars USING (participant)),
p AS (SELECT pairs.*, cars.car, row_number() OVER (PARTITION BY cars.car ORDER BY pair_id) - 1 AS pair_index,
             count(*) OVER (PARTITION BY cars.car) AS n
      FROM pairs JOIN cars USING (participant)),
full_estimate AS (SELECT car, quantile_cont(difference, 0.5) AS f, avg(difference) AS m, count(*) AS n FROM p GROUP BY car)"""


def study_units(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).withColumn("car", F.coalesce("car", F.lit("none")))


def study_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with the car they compare."""
    return settle(ev.pair_units(study_units(spark, sf), by=["car"]), scale_of(sf))


def held_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The same, written once for operators that pass over them many times."""
    return cut_lineage(ev.pair_units(study_units(spark, sf), by=["car"]))


def r9(*columns: str) -> list:
    return [F.round(c, 9).alias(c) for c in columns]


# ------------------------------------------------------------------ comparability

MUST_MATCH = ["simulator", "car", "layout", "configuration_identity"]
PERMITTED = [cmp.Variation("track", "covariate"), cmp.Variation("condition_semantics"),
             cmp.Variation("participant", "covariate"), cmp.Variation("product_build", "limitation", "plan-1")]
KEYS_SQL = "WITH " + EVENTS_SQL + """,
keys AS (SELECT dataset_id, arm, participant, simulator, car, track, layout, '1.0.0' AS protocol_version,
                condition_id AS condition_semantics, NULL::VARCHAR AS coaching_state,
                NULL::VARCHAR AS configuration_identity, 'corner-a@1' AS segment_definition,
                'minimum-speed@1' AS metric_definition, 'v1/events@1' AS normalization_contract,
                NULL::VARCHAR AS product_build FROM contexts)"""
CONSTANTS = {"protocol_version": "1.0.0", "segment_definition": "corner-a@1", "metric_definition": "minimum-speed@1",
             "normalization_contract": "v1/events@1"}


def keys_of(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.comparability_key(contexts(spark, sf), CONSTANTS)


@query("f23_comparability_key", KEYS_SQL + " SELECT * FROM keys")
def f23(spark: SparkSession, sf: str) -> DataFrame:
    return keys_of(spark, sf)


FIELDS_SQL = KEYS_SQL + """,
rules(field, rule, retained, protected) AS (VALUES
  ('simulator', 'must_match', 'none', false), ('car', 'must_match', 'none', false), ('layout', 'must_match', 'none', false),
  ('configuration_identity', 'must_match', 'none', true), ('track', 'permitted', 'covariate', false),
  ('condition_semantics', 'permitted', 'limitation', false), ('participant', 'permitted', 'covariate', false),
  ('product_build', 'permitted', 'limitation', true)),
cell AS (
  SELECT dataset_id, participant AS grp, r.field, coalesce(CASE r.field WHEN 'simulator' THEN simulator WHEN 'car' THEN car
         WHEN 'layout' THEN layout WHEN 'configuration_identity' THEN configuration_identity WHEN 'track' THEN track
         WHEN 'condition_semantics' THEN condition_semantics WHEN 'participant' THEN participant
         WHEN 'product_build' THEN product_build END, '<unavailable>') AS value FROM keys, rules r),
seen AS (
  SELECT grp AS participant, field, count(DISTINCT value) FILTER (value <> '<unavailable>') AS real_values,
         bool_or(value = '<unavailable>') AS some_unavailable, min(value) FILTER (value <> '<unavailable>') AS first_value,
         max(value) FILTER (value <> '<unavailable>') AS last_value FROM cell GROUP BY ALL),
fields AS (
  SELECT participant, field, rule, retained, real_values, some_unavailable, first_value, last_value,
    CASE WHEN rule = 'must_match' AND real_values > 1 THEN 'refused' WHEN rule = 'must_match' AND some_unavailable THEN 'violation'
         WHEN rule = 'must_match' THEN 'fine' WHEN protected THEN 'limitation'
         WHEN real_values > 1 AND field NOT IN ('condition_semantics', 'coaching_state') THEN 'limitation'
         WHEN some_unavailable THEN 'limitation' WHEN retained = 'covariate' THEN 'covariate' ELSE 'fine' END AS verdict,
    protected AND (rule <> 'must_match' OR (real_values <= 1 AND some_unavailable)) AS identity_limited
  FROM seen JOIN rules USING (field))"""


@query("f24_comparability_fields", FIELDS_SQL + " SELECT * FROM fields")
def f24_fields(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.assess_fields(
        keys_of(spark, sf).withColumn("_g", F.col("participant")), ["_g"], MUST_MATCH, PERMITTED,
    ).withColumnRenamed("_g", "participant")


@query("f24_observed_values", KEYS_SQL + """
SELECT car AS "group", field, value, count(*) AS datasets FROM (
  SELECT car, 'track' AS field, coalesce(track, '<unavailable>') AS value FROM keys
  UNION ALL SELECT car, 'layout', coalesce(layout, '<unavailable>') FROM keys
  UNION ALL SELECT car, 'product_build', coalesce(product_build, '<unavailable>') FROM keys) GROUP BY ALL""")
def f24_values(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.observed_values(keys_of(spark, sf).withColumn("group", F.col("car")), ["group"],
                               ["track", "layout", "product_build"])


@query("f24_comparability_status", FIELDS_SQL + """,
arms AS (SELECT participant, count(DISTINCT arm) AS arms, count(*) AS datasets FROM keys GROUP BY 1),
t AS (SELECT participant, count(*) FILTER (verdict = 'refused') AS refused_fields, count(*) FILTER (verdict = 'violation') AS violations,
             count(*) FILTER (verdict IN ('violation', 'limitation')) AS limitations, bool_or(identity_limited) AS identity_limited
      FROM fields GROUP BY 1)
SELECT *, CASE WHEN refused_fields > 0 THEN 'refused' WHEN arms < 2 THEN 'inadequate' WHEN limitations > 0 THEN 'limited'
          ELSE 'adequate' END AS status FROM arms JOIN t USING (participant)""")
def f24_status(spark: SparkSession, sf: str) -> DataFrame:
    keys = keys_of(spark, sf).withColumn("_g", F.col("participant"))
    return cmp.assess(cmp.assess_fields(keys, ["_g"], MUST_MATCH, PERMITTED), keys, ["_g"]).withColumnRenamed(
        "_g", "participant")


@query("f25_identity_variation", KEYS_SQL + """
SELECT study, field, plan_id, CASE WHEN study IN ('BUILDING', 'MACHINERY') THEN NULL WHEN study = 'FURNITURE' THEN 'configuration_identity' ELSE 'product_build' END AS plan_field,
       CASE WHEN study IN ('BUILDING', 'MACHINERY') THEN NULL ELSE 'associational' END AS ceiling,
       CASE WHEN study IN ('BUILDING', 'MACHINERY') THEN 'no_plan' WHEN study = 'FURNITURE' THEN 'plan_for_other_field' END AS problem
FROM (SELECT DISTINCT car AS study, 'product_build' AS field, 'plan-1' AS plan_id FROM keys WHERE car IS NOT NULL)""")
def f25(spark: SparkSession, sf: str) -> DataFrame:
    studies = keys_of(spark, sf).filter("car is not null").select(F.col("car").alias("study")).distinct()
    permitted = studies.withColumns({"field": F.lit("product_build"), "plan_id": F.lit("plan-1")})
    plans = studies.filter(~F.col("study").isin("BUILDING", "MACHINERY")).select(
        "study", F.lit("plan-1").alias("plan_id"),
        F.when(F.col("study") == "FURNITURE", "configuration_identity").otherwise("product_build").alias("plan_field"),
        F.lit("associational").alias("ceiling"))
    return cmp.unplanned_variation(permitted, plans)


@query("f26_structural_ceiling", KEYS_SQL + """
SELECT participant, CASE WHEN arms < 2 THEN 'descriptive' WHEN track IN ('NATION_0', 'NATION_1') THEN 'associational'
  WHEN layout = 'ASIA' THEN 'intervention_associated'
  WHEN layout = 'EUROPE' THEN 'causal_candidate' ELSE 'intervention_associated' END AS ceiling
FROM (SELECT participant, min(track) AS track, min(layout) AS layout, count(DISTINCT arm) AS arms FROM keys GROUP BY 1)""")
def f26(spark: SparkSession, sf: str) -> DataFrame:
    # Layout decides the assignment strategy and whether identities were verified.
    per = keys_of(spark, sf).groupBy("participant").agg(
        F.min("track").alias("track"), F.min("layout").alias("layout"), F.count_distinct("arm").alias("arms"))
    layout = F.coalesce("layout", F.lit("none"))
    return per.select("participant", cmp.structural_ceiling(
        ~F.coalesce(F.col("track").isin("NATION_0", "NATION_1"), F.lit(False)),
        F.when(layout.isin("EUROPE", "ASIA"), "counterbalanced").otherwise("sequential"), F.lit(True),
        F.when(F.col("arms") < 2, "inadequate").otherwise("limited"), layout == "ASIA").alias("ceiling"))


@query("f27_mixed_sources", KEYS_SQL + """
SELECT track, count(DISTINCT synthetic) AS kinds, count(*) AS n, count(DISTINCT dataset_id) AS distinct_datasets,
       CASE WHEN count(DISTINCT synthetic) > 1 THEN 'mixed_synthetic' WHEN count(*) > count(DISTINCT dataset_id) THEN 'repeated_dataset' END AS problem
FROM (SELECT track, dataset_id, car = 'BUILDING' AS synthetic FROM keys
      UNION ALL SELECT track, dataset_id, car = 'BUILDING' FROM keys WHERE layout = 'ASIA')
WHERE track IS NOT NULL GROUP BY track HAVING count(DISTINCT synthetic) > 1 OR count(*) > count(DISTINCT dataset_id)""")
def f27(spark: SparkSession, sf: str) -> DataFrame:
    listed = keys_of(spark, sf).filter("track is not null").withColumn("synthetic", F.col("car") == "BUILDING")
    return cmp.mixed_sources(listed.unionByName(listed.filter("layout = 'ASIA'")), ["track"])


# ------------------------------------------------------------------ estimates


@query("g1_scope", PAIRS_SQL + """
SELECT CASE WHEN baseline_unit_id LIKE '%-w3-%' OR intervention_unit_id LIKE '%-w3-%' THEN 'holdout' ELSE 'primary' END AS scope,
       count(*) AS pairs, round(quantile_cont(difference, 0.5), 9) AS median_difference FROM p GROUP BY 1""")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    scale = scale_of(sf)
    described = ev.describe_units(lap_units(spark, sf), contexts(spark, sf), "lap_id", ["participant"],
                                  holdout=F.col("block_id").like("%-w3-%"), scale=scale)
    p = settle(ev.pair_units(described), scale)
    out = None
    for scope in ("primary", "holdout"):
        one = stats.paired_effect(inference.in_scope(p, scope).withColumn("scope", F.lit(scope)), ["scope"], scale=scale)
        one = one.select("scope", F.col("n").alias("pairs"), F.round("estimate", 9).alias("median_difference"))
        out = one if out is None else out.unionByName(one)
    return out


@query("g2_subset", PAIRS_SQL + """
SELECT p.pair_id, p.pair_key, round(p.difference, 9) AS difference FROM p
JOIN u b ON b.unit_id = p.baseline_unit_id JOIN u i ON i.unit_id = p.intervention_unit_id
WHERE b.car = 'MACHINERY' AND i.car = 'MACHINERY'""")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    u = study_units(spark, sf)
    return inference.pair_subset(ev.pair_units(u), u, "car", "MACHINERY").select(
        "pair_id", "pair_key", *r9("difference"))


@query("g5_mad_and_iqr", PAIRS_SQL + """
SELECT car, count(*) AS n, round(mad(difference), 9) AS mad,
       round(quantile_cont(difference, 0.75) - quantile_cont(difference, 0.25), 9) AS iqr FROM p GROUP BY car""")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return robust_summary(study_pairs(spark, sf), ["car"], "difference", scale_of(sf)).select(
        "car", F.col("n_values").alias("n"), F.round("mad", 9).alias("mad"),
        F.round(F.col("q3") - F.col("q1"), 9).alias("iqr"))


@query("g6_paired_effect_by_car", PAIRS_SQL + """
SELECT car, n, round(f, 9) AS estimate, round(m, 9) AS secondary_estimate FROM full_estimate""")
def g6_car(spark: SparkSession, sf: str) -> DataFrame:
    return stats.paired_effect(study_pairs(spark, sf), ["car"], scale=scale_of(sf)).select(
        "car", "n", *r9("estimate", "secondary_estimate"))


@query("g7_unpaired_difference", PAIRS_SQL + """
SELECT car, count(*) FILTER (arm = 'baseline') AS baseline_n, count(*) FILTER (arm = 'intervention') AS intervention_n,
  round(quantile_cont(value, 0.5) FILTER (arm = 'intervention') - quantile_cont(value, 0.5) FILTER (arm = 'baseline'), 9) AS median_difference,
  round(avg(value) FILTER (arm = 'intervention') - avg(value) FILTER (arm = 'baseline'), 9) AS mean_difference
FROM u GROUP BY car""")
def g7(spark: SparkSession, sf: str) -> DataFrame:
    u, scale = study_units(spark, sf), scale_of(sf)
    mean = stats.unpaired_effect(u, ["car"], "mean_difference", scale).select("car", F.round("estimate", 9).alias("mean_difference"))
    return stats.unpaired_effect(u, ["car"], "median_difference", scale).select(
        "car", "baseline_n", "intervention_n", F.round("estimate", 9).alias("median_difference")).join(mean, "car")


@query("g8_dispersion_ratio", PAIRS_SQL + """,
a AS (SELECT car, arm, mad(value) AS mad, CASE WHEN count(*) >= 2 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS iqr
      FROM u GROUP BY car, arm)
SELECT car, round(b.mad, 9) AS baseline_mad, round(b.iqr, 9) AS baseline_iqr, round(i.mad, 9) AS intervention_mad,
       round(i.iqr, 9) AS intervention_iqr, round(i.mad / nullif(b.mad, 0), 9) AS ratio
FROM (SELECT * FROM a WHERE arm = 'baseline') b FULL JOIN (SELECT * FROM a WHERE arm = 'intervention') i USING (car)""")
def g8(spark: SparkSession, sf: str) -> DataFrame:
    return stats.dispersion_ratio(study_units(spark, sf), ["car"], scale_of(sf)).select("car", *r9(
        "baseline_mad", "baseline_iqr", "intervention_mad", "intervention_iqr", "ratio"))


@query("g9_theil_sen_trend", PAIRS_SQL + """
SELECT a.car, round(quantile_cont((b.difference - a.difference) / (b.pair_index - a.pair_index), 0.5), 9) AS slope
FROM p a JOIN p b ON a.car = b.car AND a.pair_index < b.pair_index GROUP BY a.car""")
def g9(spark: SparkSession, sf: str) -> DataFrame:
    scale = scale_of(sf)
    points = stats.pair_order(study_pairs(spark, sf), ["car"], scale)
    return theil_sen(points, ["car"], "pair_index", "difference", scale).select("car", *r9("slope"))


@query("g9_theil_sen_by_participant", "WITH " + EVENTS_SQL + """
SELECT a.participant, round(quantile_cont((b.speed - a.speed) / (b.distance - a.distance), 0.5), 9) AS slope
FROM base a JOIN base b ON a.participant = b.participant AND a.distance < b.distance
WHERE a.speed IS NOT NULL AND b.speed IS NOT NULL GROUP BY a.participant""")
def g9_participant(spark: SparkSession, sf: str) -> DataFrame:
    return theil_sen(base_events(spark, sf), ["participant"], "distance", "speed", scale_of(sf)).filter(
        "slope is not null").select("participant", *r9("slope"))


@query("g10_group_summary", PAIRS_SQL + """,
v AS (SELECT car, 'baseline' AS arm, baseline_value AS value FROM p UNION ALL SELECT car, 'intervention', intervention_value FROM p)
SELECT car, arm, count(*) AS n, round(median(value), 9) AS median, round(avg(value), 9) AS mean, round(mad(value), 9) AS mad,
       min(value) AS minimum, max(value) AS maximum FROM v GROUP BY car, arm""")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    values = stats.arm_values(study_pairs(spark, sf), ["car"])
    return stats.group_summary(values, ["car"], scale_of(sf)).select(
        "car", "arm", "n", *r9("median", "mean", "mad"), "minimum", "maximum")


def _sign_sql(key: str, extra: str = "") -> str:
    return PAIRS_SQL + f""",
sg AS (SELECT {key}{extra}, count(*) FILTER (difference > 0) AS positive, count(*) FILTER (difference < 0) AS negative,
              count(*) FILTER (difference = 0) AS ties FROM p GROUP BY ALL),
st0 AS (SELECT *, positive + negative AS trials,
  CASE WHEN positive + negative > 0 THEN least(1.0, 2 * list_sum(list_transform(range(least(positive, negative) + 1),
    lambda k: exp(lgamma(positive + negative + 1) - lgamma(k + 1) - lgamma(positive + negative - k + 1)
                  - (positive + negative) * ln(2))))) END AS p_value FROM sg),
st AS (SELECT * REPLACE (CASE WHEN trials BETWEEN 1 AND 50 THEN round(p_value * pow(2, trials - 1)) / pow(2, trials - 1) ELSE p_value END AS p_value)
       FROM st0)"""


@query("g11_exact_sign_test", _sign_sql("car") + """
SELECT car, positive, negative, ties, trials, round(p_value, 9) AS p_value FROM st""")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    return stats.sign_test(study_pairs(spark, sf), ["car"]).select(
        "car", "positive", "negative", "ties", "trials", *r9("p_value"))


# ------------------------------------------------------------------ bootstrap


def boot_sql(contents: str, source: str = "p", cluster: str = "cluster_id") -> str:
    return PAIRS_SQL + f""",
contents AS (SELECT car, {cluster} AS cluster_id, list_sort(list({contents})) AS content FROM {source} GROUP BY ALL),
clusters AS (SELECT car, cluster_id, content, row_number() OVER (PARTITION BY car ORDER BY content, cluster_id) - 1 AS rank,
                    count(*) OVER (PARTITION BY car) AS m FROM contents),
words AS (SELECT car, m, w, ('0x' || substr(sha256('{SEED}:' || car || ':' || (w // 4)), 1 + 16 * (w % 4), 16))::UBIGINT AS v
          FROM (SELECT DISTINCT car, m FROM clusters), LATERAL (SELECT unnest(range({DRAWS} * m)) AS w) r),
drawn AS (SELECT car, w // m AS draw, w % m AS slot, CAST(v % m AS BIGINT) AS rank FROM words)"""


PAIRED_BOOT_SQL = boot_sql("difference")
ARMED_BOOT_SQL = boot_sql("{'arm': arm, 'value': value}", "u", "participant")
MEDIANS_SQL = PAIRED_BOOT_SQL + """,
dist AS (SELECT d.car, d.draw, quantile_cont(x.v, 0.5) AS value FROM drawn d JOIN clusters c USING (car, rank),
         LATERAL (SELECT unnest(c.content) AS v) x GROUP BY d.car, d.draw)"""


def interval_sql(coverage: float = COVERAGE) -> str:
    alpha = 1.0 - coverage
    return f""",
ranked AS (SELECT car, value, row_number() OVER (PARTITION BY car ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY car) AS b
           FROM dist WHERE value IS NOT NULL),
interval_of AS (
  SELECT car, max(b) AS defined_draws,
         max(value) FILTER (i = CAST(floor({alpha / 2!r}::DOUBLE * b) AS BIGINT)) AS lower,
         max(value) FILTER (i = CAST(ceil({1 - alpha / 2!r}::DOUBLE * b) AS BIGINT) - 1) AS upper
  FROM ranked GROUP BY car)"""


@query("g12_index_stream", PAIRED_BOOT_SQL + " SELECT car, draw, slot, rank FROM drawn")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    sizes = study_pairs(spark, sf).select("car", "cluster_id").distinct().groupBy("car").agg(
        F.count(F.lit(1)).alias("clusters"))
    return bs.drawn_clusters(sizes, "car", DRAWS, SEED)


@query("g13_cluster_order", PAIRED_BOOT_SQL + " SELECT car, cluster_id, rank, m AS clusters FROM clusters")
def g13_order(spark: SparkSession, sf: str) -> DataFrame:
    return bs.cluster_order(held_pairs(spark, sf), "car", "cluster_id", ["difference"], scale_of(sf))


@query("g13_bootstrap_median", MEDIANS_SQL + " SELECT car, draw, round(value, 9) AS value FROM dist")
def g13_median(spark: SparkSession, sf: str) -> DataFrame:
    return bs.bootstrap(held_pairs(spark, sf), "car", "cluster_id", "median", DRAWS, SEED, scale_of(sf)).select(
        "car", "draw", *r9("value"))


@query("g13_bootstrap_mean", PAIRED_BOOT_SQL + """
SELECT d.car, d.draw, round(sum(list_sum(c.content)) / sum(len(c.content)), 9) AS value
FROM drawn d JOIN clusters c USING (car, rank) GROUP BY d.car, d.draw""")
def g13_mean(spark: SparkSession, sf: str) -> DataFrame:
    return bs.bootstrap(held_pairs(spark, sf), "car", "cluster_id", "mean", DRAWS, SEED, scale_of(sf)).select(
        "car", "draw", *r9("value"))


@query("g13_bootstrap_unpaired", ARMED_BOOT_SQL + """
SELECT d.car, d.draw, round(quantile_cont(x.v.value, 0.5) FILTER (x.v.arm = 'intervention')
       - quantile_cont(x.v.value, 0.5) FILTER (x.v.arm = 'baseline'), 9) AS value
FROM drawn d JOIN clusters c USING (car, rank), LATERAL (SELECT unnest(c.content) AS v) x GROUP BY d.car, d.draw""")
def g13_unpaired(spark: SparkSession, sf: str) -> DataFrame:
    return bs.bootstrap(cut_lineage(study_units(spark, sf)), "car", "participant", "median_difference", DRAWS, SEED,
                        scale_of(sf)).select("car", "draw", *r9("value"))


@query("g13_bootstrap_dispersion_ratio", ARMED_BOOT_SQL + """
SELECT d.car, d.draw, round(mad(x.v.value) FILTER (x.v.arm = 'intervention')
       / nullif(mad(x.v.value) FILTER (x.v.arm = 'baseline'), 0), 9) AS value
FROM drawn d JOIN clusters c USING (car, rank), LATERAL (SELECT unnest(c.content) AS v) x GROUP BY d.car, d.draw""")
def g13_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return bs.bootstrap(cut_lineage(study_units(spark, sf)), "car", "participant", "dispersion_ratio", DRAWS, SEED,
                        scale_of(sf)).select("car", "draw", *r9("value"))


@query("g13_bootstrap_trend", PAIRED_BOOT_SQL + """,
seq AS (SELECT d.car, d.draw, row_number() OVER (PARTITION BY d.car, d.draw ORDER BY d.slot, x.j) AS i, c.content[x.j] AS y
        FROM drawn d JOIN clusters c USING (car, rank), LATERAL (SELECT unnest(range(1, len(c.content) + 1)) AS j) x)
SELECT a.car, a.draw, round(quantile_cont((b.y - a.y) / (b.i - a.i), 0.5), 9) AS value
FROM seq a JOIN seq b ON a.car = b.car AND a.draw = b.draw AND a.i < b.i GROUP BY a.car, a.draw""")
def g13_trend(spark: SparkSession, sf: str) -> DataFrame:
    return bs.bootstrap(held_pairs(spark, sf), "car", "cluster_id", "trend", DRAWS, SEED, scale_of(sf)).select(
        "car", "draw", *r9("value"))


def median_interval(spark: SparkSession, sf: str, pairs: DataFrame | None = None) -> DataFrame:
    p = held_pairs(spark, sf) if pairs is None else pairs
    drawn = bs.bootstrap(p, "car", "cluster_id", "median", DRAWS, SEED, scale_of(sf))
    clusters = p.select("car", "cluster_id").distinct().groupBy("car").agg(F.count(F.lit(1)).alias("clusters"))
    return bs.percentile_interval(drawn, "car", DRAWS, COVERAGE, clusters, 3)


@query("g14_percentile_interval", MEDIANS_SQL + interval_sql() + """
SELECT car, (SELECT max(m) FROM clusters c WHERE c.car = i.car) AS clusters, defined_draws, NULL::VARCHAR AS unusable_reason,
       true AS usable, round(lower, 9) AS lower, round(upper, 9) AS upper FROM interval_of i""")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    return median_interval(spark, sf).select(
        "car", "clusters", "defined_draws", "unusable_reason", "usable", *r9("lower", "upper"))


@query("g16_practical_significance", MEDIANS_SQL + interval_sql() + f"""
SELECT car, abs(f) >= {THRESHOLD} AS estimate_exceeds_threshold, f > 0 AS direction_matches_hypothesis,
       NOT (lower <= 0 AND upper >= 0) AS interval_excludes_no_effect
FROM full_estimate JOIN interval_of USING (car)""")
def g16(spark: SparkSession, sf: str) -> DataFrame:
    p = held_pairs(spark, sf)
    both = stats.paired_effect(p, ["car"], scale=scale_of(sf)).join(median_interval(spark, sf, p), "car")
    return both.select("car", *[c.alias(n) for n, c in stats.practical(
        F.col("estimate"), THRESHOLD, "increase_is_improvement", F.col("lower"), F.col("upper")).items()])


# ------------------------------------------------------------------ multiplicity


def participant_tests(spark: SparkSession, sf: str) -> DataFrame:
    p = study_pairs(spark, sf).withColumn("participant", F.col("cluster_id"))
    return settle(stats.sign_test(p, ["car", "participant"]), scale_of(sf))


PARTICIPANT_SIGN_SQL = _sign_sql("car", ", participant") + """,
r AS (SELECT *, count(*) OVER (PARTITION BY car) AS m,
             CASE WHEN p_value IS NOT NULL THEN row_number() OVER (PARTITION BY car ORDER BY p_value NULLS LAST, participant) - 1 END AS k FROM st)"""


def _adjusted(spark: SparkSession, sf: str, method: str) -> DataFrame:
    out = stats.adjust_p_values(participant_tests(spark, sf), "car", "p_value", "participant", method, ALPHA, scale_of(sf))
    return out.select("car", "participant", *r9("p_value", "adjusted_p_value"), "rejected")


@query("g17_holm", PARTICIPANT_SIGN_SQL + """,
a AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN max(least(1.0, (m - k) * p_value)) OVER (
      PARTITION BY car ORDER BY k NULLS LAST ROWS UNBOUNDED PRECEDING) END AS adj FROM r)
SELECT car, participant, round(p_value, 9) AS p_value, round(adj, 9) AS adjusted_p_value, coalesce(adj <= 0.05, false) AS rejected FROM a""")
def g17(spark: SparkSession, sf: str) -> DataFrame:
    return _adjusted(spark, sf, "holm_bonferroni")


@query("g18_benjamini_hochberg", PARTICIPANT_SIGN_SQL + """,
a AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN min(least(1.0, m / (k + 1) * p_value)) OVER (
      PARTITION BY car ORDER BY k NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS adj FROM r)
SELECT car, participant, round(p_value, 9) AS p_value, round(adj, 9) AS adjusted_p_value, coalesce(adj <= 0.05, false) AS rejected FROM a""")
def g18(spark: SparkSession, sf: str) -> DataFrame:
    return _adjusted(spark, sf, "benjamini_hochberg")


@query("g19_no_correction", PARTICIPANT_SIGN_SQL + """
SELECT car, participant, round(p_value, 9) AS p_value, round(least(1.0, p_value), 9) AS adjusted_p_value,
       coalesce(p_value <= 0.05, false) AS rejected FROM r""")
def g19(spark: SparkSession, sf: str) -> DataFrame:
    return _adjusted(spark, sf, "none")


# ------------------------------------------------------------------ sensitivity


@query("g20_leave_one_unit_out", PAIRS_SQL + """,
loo AS (SELECT a.car, a.pair_id, quantile_cont(b.difference, 0.5) AS e FROM p a JOIN p b ON a.car = b.car AND a.pair_id <> b.pair_id
        GROUP BY a.car, a.pair_id)
SELECT car, any_value(n) AS n, round(min(e), 9) AS estimates_minimum, round(max(e), 9) AS estimates_maximum,
       count(*) FILTER (sign(e) <> sign(f)) AS direction_changes,
       CASE WHEN count(*) FILTER (sign(e) <> sign(f)) = 0 THEN 'robust' ELSE 'fragile' END AS outcome
FROM loo JOIN full_estimate USING (car) GROUP BY car""")
def g20(spark: SparkSession, sf: str) -> DataFrame:
    return sensitivity.leave_one_unit_out(study_pairs(spark, sf), "car", scale=scale_of(sf)).select(
        "car", "n", *r9("estimates_minimum", "estimates_maximum"), "direction_changes", "outcome")


@query("g20_leave_one_unit_out_mean", PAIRS_SQL + """,
loo AS (SELECT a.car, a.pair_id, avg(b.difference) AS e FROM p a JOIN p b ON a.car = b.car AND a.pair_id <> b.pair_id
        GROUP BY a.car, a.pair_id)
SELECT car, any_value(n) AS n, round(min(e), 9) AS estimates_minimum, round(max(e), 9) AS estimates_maximum,
       count(*) FILTER (sign(e) <> sign(m)) AS direction_changes,
       CASE WHEN count(*) FILTER (sign(e) <> sign(m)) = 0 THEN 'robust' ELSE 'fragile' END AS outcome
FROM loo JOIN full_estimate USING (car) GROUP BY car""")
def g20_mean(spark: SparkSession, sf: str) -> DataFrame:
    return sensitivity.leave_one_unit_out(study_pairs(spark, sf), "car", "mean_paired_difference", scale_of(sf)).select(
        "car", "n", *r9("estimates_minimum", "estimates_maximum"), "direction_changes", "outcome")


@query("g21_leave_one_cluster_out", PAIRS_SQL + """,
c AS (SELECT DISTINCT car, cluster_id FROM p),
loo AS (SELECT c.car, c.cluster_id, quantile_cont(b.difference, 0.5) AS e FROM c JOIN p b ON c.car = b.car AND c.cluster_id <> b.cluster_id
        GROUP BY c.car, c.cluster_id)
SELECT car, count(*) AS clusters, round(min(e), 9) AS estimates_minimum, round(max(e), 9) AS estimates_maximum,
       count(*) FILTER (sign(e) <> sign(f)) AS direction_changes,
       CASE WHEN count(*) FILTER (sign(e) <> sign(f)) = 0 THEN 'robust' ELSE 'fragile' END AS outcome
FROM loo JOIN full_estimate USING (car) GROUP BY car""")
def g21(spark: SparkSession, sf: str) -> DataFrame:
    return sensitivity.leave_one_cluster_out(held_pairs(spark, sf), "car", scale=scale_of(sf)).select(
        "car", "clusters", *r9("estimates_minimum", "estimates_maximum"), "direction_changes", "outcome")


@query("g22_isolation_by_cluster", PAIRS_SQL + """,
c AS (SELECT car, cluster_id, quantile_cont(difference, 0.5) AS e FROM p GROUP BY ALL)
SELECT car, count(*) AS clusters, count(*) FILTER (sign(e) = sign(f)) AS agreeing,
       CASE WHEN count(*) < 2 THEN 'not_computable' WHEN count(*) FILTER (sign(e) = sign(f)) * 2 > count(*) THEN 'robust' ELSE 'fragile' END AS outcome
FROM c JOIN full_estimate USING (car) GROUP BY car""")
def g22(spark: SparkSession, sf: str) -> DataFrame:
    return sensitivity.isolation_by_cluster(held_pairs(spark, sf), "car", scale=scale_of(sf))


@query("g23_early_versus_late", PAIRS_SQL + """,
h AS (SELECT car, any_value(n) AS n, any_value(n) // 2 AS split_at,
             quantile_cont(difference, 0.5) FILTER (pair_index < n // 2) AS e, quantile_cont(difference, 0.5) FILTER (pair_index >= n // 2) AS l
      FROM p GROUP BY car)
SELECT car, h.n, split_at, round(e, 9) AS early_estimate, round(l, 9) AS late_estimate,
       CASE WHEN sign(e) = sign(f) AND sign(l) = sign(f) THEN 'robust' ELSE 'fragile' END AS outcome FROM h JOIN full_estimate USING (car)""")
def g23(spark: SparkSession, sf: str) -> DataFrame:
    return sensitivity.early_versus_late(held_pairs(spark, sf), "car", scale=scale_of(sf)).select(
        "car", "n", "split_at", *r9("early_estimate", "late_estimate"), "outcome")


@query("g24_outlier_dependence", PAIRS_SQL + f""",
x AS (SELECT p.car, pair_id, difference, row_number() OVER (PARTITION BY p.car ORDER BY abs(difference - f) DESC, pair_id DESC) AS k
      FROM p JOIN full_estimate USING (car)),
w AS (SELECT car, max(difference) FILTER (k = 1) AS removed_difference, quantile_cont(difference, 0.5) FILTER (k > 1) AS e FROM x GROUP BY car)
SELECT car, n, round(f, 9) AS full_estimate, round(removed_difference, 9) AS removed_difference, round(e, 9) AS estimate_without_outlier,
       CASE WHEN sign(e) <> sign(f) OR (abs(e) < {THRESHOLD} AND {THRESHOLD} <= abs(f)) THEN 'fragile' ELSE 'robust' END AS outcome
FROM w JOIN full_estimate USING (car)""")
def g24(spark: SparkSession, sf: str) -> DataFrame:
    return sensitivity.outlier_dependence(held_pairs(spark, sf), "car", THRESHOLD, scale=scale_of(sf)).select(
        "car", "n", *r9("full_estimate", "removed_difference", "estimate_without_outlier"), "outcome")


@query("g25_sign_stability", PAIRS_SQL + """
SELECT car, any_value(p.n) AS pairs, count(*) FILTER (sign(difference) = sign(f)) AS concordant_pairs,
       CASE WHEN count(*) FILTER (sign(difference) = sign(f)) * 2 > count(*) THEN 'robust' ELSE 'fragile' END AS outcome
FROM p JOIN full_estimate USING (car) GROUP BY car""")
def g25(spark: SparkSession, sf: str) -> DataFrame:
    return sensitivity.sign_stability(study_pairs(spark, sf), "car", scale=scale_of(sf))


# ------------------------------------------------------------------ sufficiency and ceilings

STUDY_SQL = PAIRS_SQL + """,
counts AS (
  SELECT car, count(*) AS available_units, count(DISTINCT participant) AS available_participants FROM u GROUP BY car),
studies AS (
  SELECT car, available_units, available_participants, coalesce(fe.n, 0) AS available_pairs,
         (SELECT count(DISTINCT cluster_id) FROM p WHERE p.car = counts.car) AS available_clusters,
         CASE car WHEN 'BUILDING' THEN 'not_declared' WHEN 'FURNITURE' THEN 'frozen_protocol' ELSE 'documented' END AS source,
         car IN ('MACHINERY', 'AUTOMOBILE') AS confirmatory, car = 'AUTOMOBILE' AS post_hoc
  FROM counts LEFT JOIN full_estimate fe USING (car)),
suff AS (
  SELECT *, concat_ws(',', CASE WHEN available_units < 200 THEN 'minimum_units' END, CASE WHEN available_pairs < 110 THEN 'minimum_pairs' END,
    CASE WHEN available_clusters < 25 THEN 'minimum_clusters' END, CASE WHEN available_participants < 28 THEN 'minimum_participants' END,
    CASE WHEN source = 'not_declared' THEN 'not_declared' END, CASE WHEN post_hoc AND confirmatory THEN 'post_hoc_exclusion' END,
    CASE WHEN source = 'frozen_protocol' THEN 'uncited_declaration' END) AS unmet FROM studies),
judged AS (
  SELECT *, CASE WHEN source = 'not_declared' THEN 'undetermined' WHEN unmet <> '' THEN 'insufficient' ELSE 'sufficient' END AS status FROM suff)"""


def studies(spark: SparkSession, sf: str) -> DataFrame:
    u = study_units(spark, sf)
    counts = ev.evidence_counts(u, ev.pair_units(u, by=["car"]), by=["car"])
    declared = counts.select(
        "car", F.col("included_units").alias("available_units"), F.col("participants").alias("available_participants"),
        F.col("pairs").alias("available_pairs"), F.col("clusters").alias("available_clusters"),
        F.lit(200).alias("required_units"), F.lit(110).alias("required_pairs"), F.lit(25).alias("required_clusters"),
        F.lit(28).alias("required_participants"),
        F.when(F.col("car") == "BUILDING", "not_declared").when(F.col("car") == "FURNITURE", "frozen_protocol")
        .otherwise("documented").alias("source"),
        F.array(F.lit("at least 110 pairs")).alias("cited"), F.array(F.lit("at least 100 pairs")).alias("protocol"),
        F.lit("limited").alias("comparability_status"), (F.col("car") == "AUTOMOBILE").alias("post_hoc"),
        F.col("car").isin("MACHINERY", "AUTOMOBILE").alias("confirmatory"), F.lit(True).alias("uncertainty_usable"))
    return inference.sufficiency(declared)


@query("g26_sufficiency", STUDY_SQL + """
SELECT car, available_units, available_pairs, available_clusters, available_participants, unmet, status,
       status <> 'sufficient' AS descriptive_only, status = 'sufficient' AND confirmatory AND NOT post_hoc AS confirmatory_permitted FROM judged""")
def g26(spark: SparkSession, sf: str) -> DataFrame:
    return studies(spark, sf).select(
        "car", "available_units", "available_pairs", "available_clusters", "available_participants",
        F.concat_ws(",", "unmet").alias("unmet"), "status", "descriptive_only", "confirmatory_permitted")


@query("g27_interpretation", STUDY_SQL + """
SELECT car, requested, structural, requested = 'causal_candidate' AND structural <> 'causal_candidate' AS refused,
       CASE WHEN available_pairs > 0 AND status <> 'insufficient' THEN 'computed' ELSE 'inconclusive' END AS analysis_state,
       CASE WHEN status <> 'sufficient' THEN 'descriptive' WHEN structural = 'associational' THEN 'associational' ELSE
            CASE WHEN requested = 'causal_candidate' THEN structural ELSE requested END END AS effective_ceiling
FROM (SELECT *, CASE WHEN car = 'HOUSEHOLD' THEN 'causal_candidate' ELSE 'associational' END AS requested,
             CASE WHEN car IN ('HOUSEHOLD', 'MACHINERY') THEN 'intervention_associated' ELSE 'associational' END AS structural FROM judged)""")
def g27(spark: SparkSession, sf: str) -> DataFrame:
    runs = studies(spark, sf).withColumns({
        "primary_computed": F.col("available_pairs") > 0,
        "requested": F.when(F.col("car") == "HOUSEHOLD", "causal_candidate").otherwise("associational"),
        "structural": F.when(F.col("car").isin("HOUSEHOLD", "MACHINERY"), "intervention_associated")
        .otherwise("associational")})
    return inference.interpretation(runs).select(
        "car", "requested", "structural", "refused", "analysis_state", "effective_ceiling")


@query("g28_run_rules", PARTICIPANT_SIGN_SQL + """,
a AS (SELECT car, participant, p_value, least(1.0, p_value) * 0.5 AS adj FROM r)
SELECT participant, 'adjusted_below_raw' AS rule FROM a WHERE adj < p_value
UNION ALL SELECT participant, 'not_rejected_below_alpha' FROM a WHERE adj <= 0.05 AND NOT p_value <= 0.05
UNION ALL SELECT participant, 'synthetic_eligible' FROM a WHERE car = 'BUILDING'""")
def g28(spark: SparkSession, sf: str) -> DataFrame:
    # Halved adjustments and an eligible synthetic study are defects the rules must name.
    results = stats.adjust_p_values(participant_tests(spark, sf), "car", "p_value", "participant", "none", ALPHA, scale_of(sf))
    spoilt = results.withColumns({
        "adjusted_p_value": F.col("adjusted_p_value") * 0.5, "synthetic": F.col("car") == "BUILDING",
        "eligible": F.lit(True)})
    return inference.run_rules(spoilt, ["participant"], ALPHA)
