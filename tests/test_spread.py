"""Divided plans against plain ones, with one key holding a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stintwise.operators.quantiles import histogram, mad, quantiles, robust_summary
from stintwise.operators.spread import Scale, lookup_join, ordered_scan, position_in

DIVIDED = Scale(None, 40)
PLAIN = Scale(10_000)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    keys = np.where(rng.random(900) < 1 / 3, 0, rng.integers(1, 30, 900))
    pdf = pd.DataFrame({"k": keys, "id": np.arange(900), "t": np.sort(rng.integers(0, 300, 900)),
                        "v": rng.integers(-50, 50, 900) / 4.0})
    pdf.loc[rng.random(900) < 0.2, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(7)
    return pdf, df.cache()


@pytest.mark.parametrize("scale", [DIVIDED, PLAIN])
def test_quantiles_match_numpy(rows, scale):
    pdf, df = rows
    got = quantiles(histogram(df, ["k"], "v"), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}, scale).collect()
    for r in got:
        want = np.quantile(pdf[pdf.k == r.k].v.dropna(), [0.25, 0.5, 0.75])
        assert np.allclose([r.a, r.b, r.c], want)
    assert len(got) == pdf.dropna().k.nunique()


@pytest.mark.parametrize("scale", [DIVIDED, PLAIN])
def test_mad_and_summary(rows, scale):
    pdf, df = rows
    spread = {r.k: r for r in mad(df, ["k"], "v", scale).collect()}
    for r in robust_summary(df, ["k"], "v", scale).collect():
        v = pdf[pdf.k == r.k].v.dropna()
        away = np.median(np.abs(v - np.median(v)))
        assert np.allclose([r.minimum, r.maximum, r.mean, r.median, r.mad], [v.min(), v.max(), v.mean(), v.median(), away])
        assert r.n_values == len(v) and spread[r.k].mad == pytest.approx(away)


def test_ordered_scan_divided_equals_plain(rows):
    _, df = rows
    carry = {"prev": ("previous", F.col("v")), "known": ("last", F.col("v")), "high": ("max", F.col("v")),
             "total": ("sum", F.col("v"))}
    out = [sorted(map(str, ordered_scan(df, ["k"], ["t", "id"], F.col("t"), carry, s).collect()))
           for s in (DIVIDED, PLAIN)]
    assert out[0] == out[1]


def test_position_and_lookup(rows):
    pdf, df = rows
    got = {r.id: r.p for r in position_in(df, ["k"], ["t", "id"], "p", DIVIDED).collect()}
    want = pdf.sort_values(["t", "id"]).groupby("k").cumcount()
    assert all(got[i] == want[i] for i in pdf.id)
    names = df.select("k").distinct().withColumn("name", F.concat(F.lit("n"), F.col("k")))
    joined = lookup_join(df, names, ["k"], "left", [F.col("id")], DIVIDED)
    assert joined.count() == 900 and joined.filter("name <> concat('n', k)").count() == 0


def test_null_keys_and_null_slots_at_both_limits(spark):
    """A null group is summarized, and a null order value comes first, however the input is divided."""
    keyed = spark.createDataFrame([(None if k % 3 == 0 else "ab"[k % 2], float(k)) for k in range(60)], "g string, v double")
    both = [sorted(map(str, f(keyed, ["g"], "v", scale).collect())) for f in (robust_summary, mad)
            for scale in (Scale(60, 1000), Scale(60, 10))]
    assert len(both[0]) == 3
    for plain, divided in (both[:2], both[2:]):
        assert plain == divided
    ordered = spark.createDataFrame([(1, None if k % 4 == 0 else k, k) for k in range(40)], "g int, at int, k int")
    rows = [sorted((r.k, r.before) for r in ordered_scan(
        ordered, ["g"], ["at", "k"], F.col("at"), {"before": ("previous", F.col("k"))}, scale).collect())
        for scale in (Scale(40, 1000), Scale(40, 5))]
    assert rows[0] == rows[1]
    assert dict(rows[0])[1] == 36
    joined = [sorted(map(str, lookup_join(keyed, spark.createDataFrame([("a", 1), (None, 2)], "g string, w int"), ["g"], "left",
                                          [F.col("v")], scale).collect())) for scale in (Scale(60, 1000), Scale(60, 10))]
    assert joined[0] == joined[1]
