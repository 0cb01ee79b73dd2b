"""Hand-computed answers of the estimators."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintwise.operators import bootstrap as bs
from stintwise.operators import sensitivity, stats
from stintwise.operators.quantiles import histogram, mad, quantiles
from stintwise.operators.spread import Scale
from stintwise.operators.theilsen import inversions, median_slope, theil_sen

SMALL = Scale(10_000)
DIVIDED = Scale(None, 8)


def pairs_of(spark, differences, clusters=None):
    rows = [("c", f"p{i:03d}", (clusters or ["x"] * len(differences))[i], float(d)) for i, d in enumerate(differences)]
    return spark.createDataFrame(rows, "k string, pair_id string, cluster_id string, difference double")


@pytest.mark.parametrize("differences,p", [
    ([1] * 9 + [-1], 22 / 1024), ([1] * 6, 2 / 64), ([1] * 18, 2 / 2 ** 18), ([1, -1, 0], 1.0)])
def test_sign_test(spark, differences, p):
    got = stats.sign_test(pairs_of(spark, differences), ["k"]).first()
    assert got.p_value == pytest.approx(p, rel=1e-14) and got.ties == differences.count(0)


def test_sign_test_many_trials_and_none(spark):
    import math
    df = spark.createDataFrame([(700, 500), (3000, 2800), (0, 0)], "a long, b long")
    got = [r.p for r in df.select(stats.sign_test_p(F.col("a"), F.col("b")).alias("p")).collect()]
    for p, (a, b) in zip(got, ((700, 500), (3000, 2800))):
        tail = sum(math.comb(a + b, i) for i in range(min(a, b) + 1))
        assert p == pytest.approx(2 * tail / 2 ** (a + b), rel=1e-9)
    assert got[2] is None


def values(spark, rows):
    return spark.createDataFrame([("c", arm, float(v)) for arm, v in rows], "k string, arm string, value double")


def test_mad_iqr_and_dispersion(spark):
    one = values(spark, [("baseline", v) for v in (1, 2, 3, 4, 100)])
    assert mad(one, ["k"], "value", SMALL).first().mad == 1.0
    box = quantiles(histogram(values(spark, [("b", v) for v in range(1, 6)]), ["k"], "value"), ["k"], "value",
                    {"q1": .25, "q3": .75}, SMALL).first()
    assert box.q3 - box.q1 == 2.0
    both = values(spark, [("baseline", v) for v in (0, 2, 4)] + [("intervention", v) for v in (1, 2, 3)])
    assert stats.dispersion_ratio(both, ["k"], SMALL).first().ratio == 0.5
    flat = values(spark, [("baseline", 1)] * 3 + [("intervention", v) for v in (1, 2, 3)])
    assert stats.dispersion_ratio(flat, ["k"], SMALL).first().ratio is None


@pytest.mark.parametrize("method,raw,want", [
    ("holm_bonferroni", [.01, .02, .03], [.03, .04, .04]), ("holm_bonferroni", [.5, .001, .4], [.8, .003, .8]),
    ("holm_bonferroni", [.01, None, None], [.03, None, None]),
    ("benjamini_hochberg", [.001, .008, .039, .041, .042, .06, .074, .205],
     [.008, .032, .0672, .0672, .0672, .08, 8 / 7 * .074, .205])])
@pytest.mark.parametrize("scale", [SMALL, DIVIDED])
def test_corrections(spark, method, raw, want, scale):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(raw)], "family string, i int, p double")
    got = stats.adjust_p_values(df, "family", "p", "i", method, .05, scale).orderBy("i").collect()
    for r, w in zip(got, want):
        assert r.adjusted_p_value == (None if w is None else pytest.approx(w))


def test_theil_sen_kernel_against_all_pairs():
    rng = np.random.default_rng(3)
    assert median_slope(np.array([1, 2, 3, 4]), np.array([1, 2, 3, 100])) == 17.0
    assert median_slope(np.array([1, 1]), np.array([1, 2])) is None
    for n in (300, 401):
        x, y = rng.integers(0, 90, n).astype(float), np.round(rng.normal(0, 5, n), 2)
        i, j = np.triu_indices(n, 1)
        apart = x[i] != x[j]
        want = np.median((y[j] - y[i])[apart] / (x[j] - x[i])[apart])
        assert median_slope(x, y) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_theil_sen_search_over_the_cluster(spark):
    rng = np.random.default_rng(4)
    rows = [("big", float(x), float(y)) for x, y in zip(rng.integers(0, 12, 40), np.round(rng.normal(0, 3, 40), 1))]
    rows += [("small", 1.0, 1.0), ("small", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r.slope for r in theil_sen(df, ["k"], "x", "y", Scale(None, 100_000), max_group=20).collect()}
    b = np.array([r[1:] for r in rows if r[0] == "big"])
    assert got["big"] == pytest.approx(median_slope(b[:, 0], b[:, 1]), rel=1e-9) and got["small"] == 2.0


def test_interval_positions(spark):
    draws = spark.range(1000).select(F.lit("c").alias("k"), F.col("id").cast("double").alias("value"))
    clusters = spark.createDataFrame([("c", 5)], "k string, clusters long")
    for coverage, want in ((.95, (25.0, 974.0)), (.80, (99.0, 899.0))):
        r = bs.percentile_interval(draws, "k", 1000, coverage, clusters, 2).first()
        assert (r.lower, r.upper) == want
    short = bs.percentile_interval(draws, "k", 1000, .95, clusters, 6).first()
    assert not short.usable and short.unusable_reason == "too_few_clusters" and short.lower is None


def test_index_stream_matches_hashlib(spark):
    m, draws = 7, 5
    words = []
    for counter in range(10):
        block = hashlib.sha256(f"11:c:{counter}".encode()).digest()
        words += [int.from_bytes(block[o:o + 8], "big") % m for o in range(0, 32, 8)]
    sizes = spark.createDataFrame([("c", m)], "k string, clusters long")
    got = {(r.draw, r.slot): r["rank"] for r in bs.drawn_clusters(sizes, "k", draws, 11).collect()}
    assert got == {(d, s): words[d * m + s] for d in range(draws) for s in range(m)}


def test_cluster_order_is_by_contents(spark):
    rng = np.random.default_rng(9)
    contents = {f"c{i}": [1.0] * 40 + list(rng.integers(0, 3, 3).astype(float) + 2) for i in range(8)}
    contents["short"] = [1.0] * 40
    rows = [("k", c, float(v)) for c, vs in contents.items() for v in vs]
    want = {c: i for i, (_, c) in enumerate(sorted((sorted(v), c) for c, v in contents.items()))}
    for scale in (SMALL, DIVIDED):
        df = spark.createDataFrame(rows, "k string, cluster_id string, difference double").repartition(5)
        got = {r.cluster_id: r["rank"] for r in bs.cluster_order(df, "k", "cluster_id", ["difference"], scale).collect()}
        assert got == want


@pytest.mark.parametrize("effect", ["median_paired_difference", "mean_paired_difference"])
@pytest.mark.parametrize("n", [8, 9])
def test_leave_one_out_against_brute_force(spark, effect, n):
    rng = np.random.default_rng(n)
    d = np.round(rng.normal(.3, 2, n), 1)
    clusters = [f"g{i % 3}" for i in range(n)]
    f = np.median if effect.startswith("median") else np.mean
    pairs = pairs_of(spark, d, clusters)
    each = [f(np.delete(d, i)) for i in range(n)]
    one = sensitivity.leave_one_unit_out(pairs, "k", effect, DIVIDED).first()
    assert (one.estimates_minimum, one.estimates_maximum) == (pytest.approx(min(each)), pytest.approx(max(each)))
    assert one.direction_changes == sum(np.sign(e) != np.sign(f(d)) for e in each)
    per = [f(d[[c != g for c in clusters]]) for g in ("g0", "g1", "g2")]
    got = sensitivity.leave_one_cluster_out(pairs, "k", effect, SMALL).first()
    assert (got.estimates_minimum, got.estimates_maximum) == (pytest.approx(min(per)), pytest.approx(max(per)))


def test_slope_is_an_actual_slope_at_every_size():
    """0/1 noise has slope 0.0, and larger groups give what enumerating all pairs gives."""
    from stintwise.operators.theilsen import median_slope

    rng = np.random.default_rng(8)
    for n in (256, 257, 2000):
        assert repr(median_slope(np.arange(n, dtype=float), rng.integers(0, 2, n).astype(float))) == "0.0"
    for n in (257, 400, 700):
        x, y = rng.permutation(n).astype(float), rng.normal(size=n)
        i, j = np.triu_indices(n, 1)
        assert median_slope(x, y) == float(np.median((y[j] - y[i]) / (x[j] - x[i])))


def test_identical_clusters_are_settled_at_once(spark):
    """Two clusters of equal contents get their ranks without walking through them."""
    from stintwise.operators.bootstrap import cluster_order
    from stintwise.operators.spread import Scale

    rows = spark.range(2000).selectExpr("'k' AS key", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS cluster", "0.0 AS v")
    rows = rows.unionByName(spark.createDataFrame([("k", "c", -1.0)], "key string, cluster string, v double"))
    got = {r.cluster: (r["rank"], r.clusters) for r in cluster_order(rows, "key", "cluster", ["v"], Scale(None, 500)).collect()}
    assert got == {"c": (0, 3), "a": (1, 3), "b": (2, 3)}


def test_draw_bounds(spark):
    from stintwise.operators.bootstrap import bootstrap

    with pytest.raises(ValueError, match="200 to 100,000"):
        bootstrap(spark.range(1), "k", "c", "median", 100, 1)


@pytest.mark.parametrize("kind", ["sequence", "ties", "few x", "steep"])
def test_slopes_counted_by_blocks(kind):
    rng = np.random.default_rng(len(kind))
    n = 1400
    x = rng.integers(0, 30, n).astype(float) if kind == "few x" else np.arange(n, dtype=float)
    y = rng.integers(0, 4, n).astype(float) if kind == "ties" else rng.normal(0, 30, n).round(2) + (3 * x if kind == "steep" else 0)
    i, j = np.triu_indices(n, 1)
    order = np.lexsort((y, x))
    i, j = order[i], order[j]
    apart = x[i] != x[j]
    assert median_slope(x, y) == pytest.approx(np.median((y[j] - y[i])[apart] / (x[j] - x[i])[apart]), rel=1e-12, abs=1e-15)
    place = rng.permutation(n)
    assert inversions(place) == sum(int((place[:k] > place[k]).sum()) for k in range(n))


def test_slope_of_a_whole_comparison_of_the_larger_tables():
    # Eighty thousand points took ten seconds each, and there are a thousand such draws.
    y = np.random.default_rng(3).integers(-99, 99, 80_000) / 100
    start = time.process_time()
    assert abs(median_slope(np.arange(80_000), y)) < 1e-4
    assert time.process_time() - start < 4


@pytest.mark.parametrize("statistic", ["median", "trend", "median_difference", "dispersion_ratio"])
def test_draws_in_tasks_and_spread(spark, statistic):
    rng = np.random.default_rng(4)
    rows = [(k, f"{k}{i}", f"c{rng.integers(0, n // 3)}", ("baseline", "intervention", None)[i % 3], float(rng.integers(0, 50)) if i % 7 else None)
            for k, n in (("a", 60), ("b", 9)) for i in range(n)]
    obs = spark.createDataFrame(rows, "k string, pair_id string, cluster_id string, arm string, value double").withColumn(
        "difference", F.col("value")).cache()
    got = [{(r.k, r.draw): r.value for r in bs.bootstrap(obs, "k", "cluster_id", statistic, 200, 7, scale).collect()}
           for scale in (SMALL, Scale(None, 20), Scale(None, 8))]
    assert len(got[0]) > 200 and got[0].keys() == got[1].keys() == got[2].keys()
    assert all(got[1][d] == pytest.approx(v, rel=1e-12, abs=1e-15) and got[2][d] == pytest.approx(v, rel=1e-12, abs=1e-15) for d, v in got[0].items())


def test_resamples_are_not_spelled_out(spark):
    obs = pairs_of(spark, range(400), [f"c{i % 40}" for i in range(400)])
    plan = bs.bootstrap(obs, "k", "cluster_id", "median", 200, 7, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "sha2" not in plan
