"""Slope selection over the cluster against all pairs."""

import numpy as np
import pandas as pd
import pytest

from stintwise.operators import slopeselect as own
from stintwise.operators.spread import Scale
from stintwise.operators.theilsen import median_slope, theil_sen

SMALL_PARTS = {"chunk": 80, "drawn_from": 100, "drawn": 600, "most_listed": 1500}


def all_pairs(x, y):
    i, j = np.triu_indices(len(x), 1)
    apart = x[i] != x[j]
    return float(np.median((y[j] - y[i])[apart] / (x[j] - x[i])[apart])) if apart.any() else None


def cases(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 40, n).astype(float)
    return {
        "few x": (x, np.round(rng.normal(0, 5, n), 2)),
        "distinct": (rng.permutation(n).astype(float), rng.normal(size=n)),
        "zero": (np.arange(n, dtype=float), rng.integers(0, 2, n).astype(float)),
        "line": (np.arange(n, dtype=float), 0.1 * np.arange(n)),
        "tiny": (np.arange(n, dtype=float), 1e-200 * rng.normal(size=n)),
        "far": (1.7e9 + np.arange(n) * 0.25, rng.normal(size=n) + np.arange(n) * 1e-3),
        "repeated": (x // 20, np.ones(n)),
        "one x": (np.zeros(n), rng.normal(size=n)),
    }


def test_residual_is_exact():
    from fractions import Fraction

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=200) * 10.0 ** rng.integers(-8, 9, 200), rng.normal(size=200)
    for s in (0.1, -3.7e5, 1e-9):
        hi, lo = own.residual(x, y, s)
        for a, b, h, low in zip(x, y, hi, lo):
            exact = Fraction(float(b)) - Fraction(s) * Fraction(float(a))
            assert abs(Fraction(float(h)) + Fraction(float(low)) - exact) <= abs(exact) * Fraction(1, 2 ** 100) + Fraction(1, 2 ** 1000)


def test_swaps_and_listing():
    rng = np.random.default_rng(2)
    for n in (1, 2, 300, 1000):
        place, w = rng.permutation(n), rng.integers(1, 5, n)
        inverted = np.triu(place[:, None] > place[None, :], 1)
        assert (own.swaps(place, w) == (inverted * w[:, None]).sum(axis=0)).all()
        got = {(a, b) for i, j in own.listed(place) for a, b in zip(i.tolist(), j.tolist())}
        assert got == set(zip(*[v.tolist() for v in np.nonzero(inverted)]))


@pytest.mark.parametrize("n", [400])
def test_all_groups_at_once_equal_all_pairs(spark, n):
    made = cases(n)
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "_x": x, "_y": y}) for k, (x, y) in made.items()]))
    got = {r.k: r.slope for r in own.select_slopes(df.selectExpr("nullif(k, 'far') as k", "_x", "_y"), ["k"], Scale(None, 200), **SMALL_PARTS).collect()}
    got["far"] = got.pop(None)
    for k, (x, y) in made.items():
        want = all_pairs(x, y)
        if k == "line":
            # More pairs than may be listed share this slope up to rounding.
            assert got[k] == pytest.approx(want, rel=1e-14)
        else:
            assert got[k] == want, k


@pytest.mark.parametrize("n", [100_001, 1_000_000])
def test_large_groups_equal_the_task_solver(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), np.round(rng.normal(size=n), 3)
    y += 1e-4 * x
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y})).repartition(8)
    got = theil_sen(df, ["k"], "x", "y", Scale(None, 5_000_000)).first().slope
    # The rank itself: as many slopes below as the middle asks for.
    total = n * (n - 1) // 2
    order = np.lexsort((y, x))
    x, y, one = x[order], y[order], np.ones(n, np.int64)
    count = {}
    for closed in (False, True):
        place = np.empty(n, np.int64)
        s = got * (1 + 2e-15 if closed else 1 - 2e-15)
        place[own.order_at(x, y, s, closed)] = np.arange(n)
        count[closed] = int(own.swaps(place, one).sum())
    assert count[False] <= total // 2 and count[True] >= (total + 1) // 2
    assert count[True] - count[False] < 5_000
    if n < 200_000:
        assert got == median_slope(x, y)
