"""Theil-Sen slope (median of pairwise slopes) without forming the pairs.

The number of slopes below s equals the number of point pairs that are out of order after
y is replaced by y - s * x. Counting those takes a table of blocks. The bracket about the wanted rank is
narrowed with slopes drawn evenly from inside it until its pairs can be listed, and the slope of that rank
among them is the result: an actual slope of two points at every size. Groups up to ``max_group``
points are solved one per task; larger ones by the cluster, see ``slopeselect``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintwise.operators.slopeselect import select_slopes
from stintwise.operators.spread import UNKNOWN, Scale, heavy_keys
from stintwise.session import cut_lineage

MAX_GROUP = 1_000_000
DIRECT = 256
#: Slopes drawn at a time, and most pairs of points looked at one by one.
POOL = 50_000
LISTED = 100_000_000


def median_slope(x: np.ndarray, y: np.ndarray) -> float | None:
    """Median of (y_j - y_i) / (x_j - x_i) over pairs with different x; None without any."""
    order = np.lexsort((y, x))
    x, y = x[order].astype(float), y[order].astype(float)
    n = len(x)
    step = np.r_[False, x[1:] != x[:-1]]
    if not step.any():
        return None
    if n <= DIRECT:
        i, j = np.triu_indices(n, 1)
        apart = x[j] != x[i]
        return float(np.median((y[j] - y[i])[apart] / (x[j] - x[i])[apart]))
    group = np.cumsum(step)  # points of one x
    sizes = np.bincount(group)
    total = (n * n - int((sizes * sizes).sum())) // 2
    first, after = _slopes_at(x, y, group, total, (total - 1) // 2)
    if total % 2:
        return first
    return (first + (_slopes_at(x, y, group, total, total // 2)[0] if after is None else after)) / 2


def inversions(place: np.ndarray) -> int:
    """Pairs i < j with place[i] > place[j], for a permutation.

    Positions and places are cut into blocks: pairs apart in both are counted by a table of blocks, the others
    within their block.
    """
    n, bits = len(place), 8
    while n >> bits > 2048:
        bits += 1
    size, blocks = 1 << bits, (n >> bits) + 1
    at, of = np.arange(n) >> bits, place >> bits
    table = np.bincount(at * blocks + of, minlength=blocks * blocks).reshape(blocks, blocks).astype(np.int32)
    earlier = np.cumsum(table, axis=0, dtype=np.int32) - table
    above = earlier.sum(axis=1, dtype=np.int32, keepdims=True) - np.cumsum(earlier, axis=1, dtype=np.int32)
    count = int((table.astype(np.int64) * above).sum())
    by_place = np.empty(n, dtype=np.int32)
    by_place[place] = at
    for values in (place.astype(np.int32), by_place):
        # One column a block; what fills up the last one is in order.
        columns = np.full(blocks * size, n, dtype=np.int32)
        columns[:n] = values
        columns = np.ascontiguousarray(columns.reshape(blocks, size).T)
        count += sum(int(np.count_nonzero(columns[:-s] > columns[s:])) for s in range(1, size))
    return count


def _slopes_at(x: np.ndarray, y: np.ndarray, group: np.ndarray, total: int, rank: int) -> tuple[float, float | None]:
    """The slope of a rank among all, and the next one where it is at hand."""
    n, rng = len(x), np.random.default_rng(1)
    index = np.arange(n)

    def order(s: float, equal: bool) -> np.ndarray:
        """Points by y - s * x: a pair is turned round when its slope is below s (or equal to it)."""
        z = y - s * x
        return np.lexsort((index, -group, z)) if equal else np.argsort(z, kind="stable")

    def under(by: np.ndarray) -> int:
        place = np.empty(n, dtype=np.int64)
        place[by] = index
        return inversions(place)

    def slope(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (y[j] - y[i]) / (x[j] - x[i])

    low, high = index, np.lexsort((y, -group))
    under_low, under_high = 0, total
    i, j = np.sort(rng.integers(0, n, (2, POOL)), axis=0)
    apart = group[i] != group[j]
    pool = np.sort(slope(i[apart], j[apart]))
    for attempt in range(64):
        if len(pool):
            share = (rank - under_low + 0.5) / max(under_high - under_low, 1)
            near, reach = int(np.clip(share * len(pool), 0, len(pool) - 1)), int(1.5 * np.sqrt(len(pool))) + 1
            ends = float(pool[max(near - reach, 0)]), float(pool[min(near + reach, len(pool) - 1)])
            left, right = order(ends[0], False), order(ends[1], True)
            under_left, under_right = under(left), under(right)
            if under_left <= rank < under_right:
                if ends[0] == ends[1]:
                    return ends[0], ends[0] if rank + 1 < under_right else None
                low, high, under_low, under_high = left, right, under_left, under_right
            elif rank < under_left:
                high, under_high = left, under_left
            else:
                low, under_low = right, under_right
        place = np.empty(n, dtype=np.int64)
        place[high] = index
        place = place[low]  # the pairs between both slopes are those out of order here
        reach = int(2 * np.abs(place - index).max())
        if under_high - under_low <= 16 * n and n * reach <= LISTED or attempt == 63:
            break
        p = rng.integers(0, n - 1, 16 * POOL)
        q = p + rng.integers(1, max(reach, 1) + 1, len(p))
        p, q = p[q < n], q[q < n]
        inside = (place[p] > place[q]) & (low[p] < low[q])
        pool = np.sort(slope(low[p[inside][:POOL]], low[q[inside][:POOL]]))
    found = []
    for s in range(1, min(reach, n - 1) + 1):
        at = np.flatnonzero(place[:-s] > place[s:])
        at = at[low[at] < low[at + s]]
        found.append(slope(low[at], low[at + s]))
    held = np.sort(np.concatenate(found))
    at = min(max(rank - under_low, 0), len(held) - 1)
    return float(held[at]), float(held[at + 1]) if at + 1 < len(held) else None


def theil_sen(
    points: DataFrame, keys: list[str], x: str, y: str, scale: Scale = UNKNOWN, max_group: int = MAX_GROUP
) -> DataFrame:
    """Slope per key. Looks at the group sizes (an action) unless the input is known small."""
    pts = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(
        "_x is not null and _y is not null")
    if scale.rows is not None and scale.rows <= max_group:
        return _solve_groups(pts, keys)
    heavy = cut_lineage(heavy_keys(pts, keys, max_group).select(*keys))
    if heavy.isEmpty():
        return _solve_groups(pts, keys)
    small = _solve_groups(pts.join(heavy, keys, "left_anti"), keys)
    return small.unionByName(select_slopes(pts.join(F.broadcast(heavy), keys, "left_semi"), keys, scale))


def _solve_groups(pts: DataFrame, keys: list[str]) -> DataFrame:
    schema = T.StructType([f for f in pts.schema.fields if f.name in keys] + [T.StructField("slope", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].head(1).copy()
        out["slope"] = median_slope(pdf["_x"].to_numpy(), pdf["_y"].to_numpy())
        return out

    return pts.groupBy(*keys).applyInPandas(solve, schema)
