"""The slope of a wanted rank among all pairs of a group that no single task holds.

Points i and j of a group swap their order, when y is replaced by y - s * x, between every s below
and every s above their slope. So the pairs with a slope in a bracket are those that the orders at
its two ends do not agree on, and three things follow:

* **Counting.** Chunks by x count the swaps inside them and pass on (chunk, z, points); ranges of z
  count those between chunks; what remains differs in chunk and range, and follows from the counts
  of a grid of at most ``CHUNKS`` squared cells. Two shuffles of the points, whatever their number.
* **Drawing.** Chunks by hash draw pairs from inside the bracket, each point by the number of its swaps. Their
  slopes about the wanted ranks are the next bracket.
* **Finding.** Once a bracket holds few pairs, a running maximum and minimum over the order at one end
  shows which points take part in any; those go to one task, which lists the pairs.

z is kept as the exact sum of two doubles, so that a count is wrong for no slope; a slope as a
double is off by up to two units in the last place, and a result is only taken where it is further from
the bracket's ends than that. Where more pairs than may be listed share a slope, the count of
slopes below and up to it settles it. Points that occur several times are one point with a weight.
Null and NaN points must be left out before; keys may be null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.operators.spread import UNKNOWN, Scale, split_cumulative
from stintwise.session import stored_table

#: Most chunks of a group, least points of a chunk, and points of a chunk that pairs are drawn from.
CHUNKS = 512
CHUNK = 1 << 17
DRAWN_FROM = 20_000
#: Slopes drawn in a round (and one more for each chunk), and pairs that one task may list.
DRAWN = 40_000
LISTED = 1_000_000
ROUNDS = 60
#: Units in the last place by which slopes near an end of the bracket are left to the next one.
NEAR = 8


def residual(x: np.ndarray, y: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray]:
    """y - s * x as a rounded double and what the rounding left out."""
    product = s * x
    split = 134217729.0
    a, b = split * s, split * x
    s_hi, x_hi = a - (a - s), b - (b - x)
    s_lo, x_lo = s - s_hi, x - x_hi
    low = ((s_hi * x_hi - product) + s_hi * x_lo + s_lo * x_hi) + s_lo * x_lo
    z = y - product
    back = z - y
    error = (y - (z - back)) + (-product - back)
    rest = error - low
    hi = z + rest
    return hi, rest - (hi - z)


def order_at(x: np.ndarray, y: np.ndarray, s: float, closed: bool) -> np.ndarray:
    """Points in the order after all swaps of slopes below s, or up to s where ``closed``."""
    if np.isneginf(s):
        return np.lexsort((y, x))
    if np.isposinf(s):
        return np.lexsort((y, -x))
    hi, lo = residual(x, y, s)
    return np.lexsort((-x if closed else x, lo, hi))


def swaps(place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For every j the weight of the i < j with place[i] > place[j]; places are 0, 1, 2, ... in any order."""
    n = len(place)
    counts, who = np.zeros(n, np.int64), np.arange(n)
    held = weight.astype(np.int64)
    for bit in range(max(1, int(max(n - 1, 1)).bit_length()) - 1, -1, -1):
        order = np.argsort(place >> (bit + 1), kind="stable")
        place, who, held = place[order], who[order], held[order]
        group, one = place >> (bit + 1), (place >> bit) & 1
        ones = np.cumsum(one * held) - one * held
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        base = np.repeat(ones[starts], np.diff(np.r_[starts, n]))
        counts[who] += (ones - base) * (1 - one)
    return counts


def inside_order(x: np.ndarray, y: np.ndarray, bracket: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Order at the lower end, and the places at the upper end of the points in it."""
    a, a_closed, b, b_closed = bracket
    first = order_at(x, y, a, a_closed)
    place = np.empty(len(x), np.int64)
    place[order_at(x, y, b, b_closed)] = np.arange(len(x))
    return first, place[first]


def draw(x: np.ndarray, y: np.ndarray, w: np.ndarray, bracket: tuple, many: int, seed: int) -> np.ndarray:
    """Slopes of random pairs from inside the bracket."""
    first, place = inside_order(x, y, bracket)
    x, y, w = x[first], y[first], w[first]
    chances = np.cumsum(swaps(place, w).astype(float) * w)
    if not len(x) or not chances[-1]:
        return np.zeros(0)
    rng = np.random.default_rng(seed)
    found = []
    for j in np.searchsorted(chances, rng.random(many) * chances[-1], side="right"):
        partners = np.flatnonzero(place[:j] > place[j])
        shares = np.cumsum(w[partners])
        i = partners[np.searchsorted(shares, rng.integers(shares[-1]), side="right")]
        found.append((y[j] - y[i]) / (x[j] - x[i]))
    return np.array(found)


def listed(place: np.ndarray, start: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with i < j and place[i] > place[j], by halves."""
    n = len(place)
    if n <= 256:
        i, j = np.nonzero(np.triu(place[:, None] > place[None, :], 1))
        return [(i + start, j + start)] if len(i) else []
    half = n // 2
    out = listed(place[:half], start) + listed(place[half:], start + half)
    left = np.argsort(place[:half])
    at = np.searchsorted(place[:half][left], place[half:])
    more = half - at
    j = np.repeat(np.arange(half, n), more)
    if len(j):
        within = np.arange(len(j)) - np.repeat(np.cumsum(more) - more, more)
        out.append((left[np.repeat(at, more) + within] + start, j + start))
    return out


def pick(x: np.ndarray, y: np.ndarray, w: np.ndarray, bracket: tuple, ranks: list[int]) -> list[float]:
    """Slopes of the given ranks among the pairs inside the bracket."""
    first, place = inside_order(x, y, bracket)
    x, y, w = x[first], y[first], w[first].astype(np.int64)
    pairs = listed(place)
    i, j = np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])
    slopes = (y[j] - y[i]) / (x[j] - x[i])
    order = np.argsort(slopes, kind="stable")
    upto = np.cumsum((w[i] * w[j])[order])
    return [float(slopes[order][min(np.searchsorted(upto, r, side="right"), len(order) - 1)]) + 0.0 for r in ranks]


def select_slopes(pts: DataFrame, keys: list[str], scale: Scale = UNKNOWN, chunk: int = CHUNK, drawn_from: int = DRAWN_FROM,
                  drawn: int = DRAWN, most_listed: int = LISTED) -> DataFrame:
    """Median slope for each key of ``pts`` (keys, _x, _y): the mean of the two middle ones where there are two."""
    # Keys may be null, which joins and group-by treat in two ways: a number stands for each, of which there are few.
    names = _kept(pts.groupBy(F.struct(*keys).alias("_whole")).agg(F.lit(1)).select(
        F.monotonically_increasing_id().alias("key"), "_whole"))
    points = pts.groupBy(F.struct(*keys).alias("_whole"), F.col("_x").alias("x"), F.col("_y").alias("y")).agg(F.count(F.lit(1)).alias("w"))
    points = points.join(F.broadcast(names), "_whole").drop("_whole")
    points = split_cumulative(points.withColumn("_at", F.struct("x", "y")), ["key"], "_at", ["w"], scale, null_keys=False)
    size = F.greatest(F.lit(chunk).cast("long"), F.ceil(F.col("w_total") / CHUNKS))
    points = _kept(points.select(
        "key", "x", "y", "w",
        F.expr("w_before").alias("_before"), size.alias("_size"), F.col("w_total").alias("n"))
        .withColumn("part", (F.col("_before") / F.col("_size")).cast("int"))
        .withColumn("draw_part", F.pmod(F.xxhash64("x", "y"), F.greatest(F.lit(1).cast("long"), F.expr(f"n div {drawn_from}"))).cast("int"))
        .drop("_before", "_size"))
    same = points.groupBy("key", "x").agg(F.sum("w").alias("c"), F.max("n").alias("n")).groupBy("key").agg(
        F.max("n").alias("n"), F.expr("cast((max(n) * cast(max(n) as decimal(38,0)) - sum(cast(c as decimal(38,0)) * c)) / 2 as long)").alias("total"))
    # Points whose z cut its values into ranges: four for each chunk.
    cuts = points.where(F.pmod(F.xxhash64("y", "x", F.lit(7)), F.greatest(F.lit(1).cast("long"), F.expr(f"{chunk} div 4"),
                                                                       F.expr(f"n div {4 * CHUNKS}"))) == 0) \
        .groupBy("key").agg(F.collect_list("x").alias("cut_x"), F.collect_list("y").alias("cut_y"))
    fixed = _kept(same.join(cuts, "key", "left").withColumns({
        "low": F.expr("(total - 1) div 2"), "high": F.expr("total div 2")}))
    state = _kept(fixed.select("key", F.lit(float("-inf")).alias("a"), F.lit(False).alias("a_closed"),
                                     F.lit(float("inf")).alias("b"), F.lit(False).alias("b_closed"), F.lit(0).cast("long").alias("under_a"),
                                     F.col("total").alias("under_b"), F.when(F.col("total") == 0, F.lit(True)).otherwise(F.lit(False)).alias("done"),
                                     F.lit(None).cast("double").alias("slope")))
    parts = _kept(points.groupBy("key", "part").agg(F.lit(1).alias("_one")).drop("_one"))
    draw_parts = _kept(points.groupBy("key", "draw_part").agg(F.count(F.lit(1)).alias("_rows")))
    for turn in range(ROUNDS):
        open_state = state.where("not done")
        if open_state.isEmpty():
            break
        few = open_state.where(f"under_b - under_a <= {most_listed}")
        if not few.isEmpty():
            settled = _found(points, few.join(fixed, "key"), parts)
            state = _kept(state.join(settled, "key", "left").select(
                "key", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("a", "a_closed", "b", "b_closed", "under_a", "under_b", "done")],
                F.coalesce("new_slope", "slope").alias("slope")))
            open_state = state.where("not done")
        wide = open_state.where(f"under_b - under_a > {most_listed}")
        if wide.isEmpty():
            continue
        state = _kept(_narrowed(points, state, wide, fixed, parts, draw_parts, drawn, most_listed, turn))
    else:
        raise ArithmeticError(f"the slope search did not settle in {ROUNDS} rounds")
    return state.join(names, "key").select(*[F.col("_whole")[k].alias(k) for k in keys], "slope")


def _kept(df: DataFrame) -> DataFrame:
    """Computed once and written; a checkpoint would compute it twice."""
    return stored_table(df, "slopes")


def _fresh(df: DataFrame) -> DataFrame:
    """The same with columns of its own: both sides of a cogroup may stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _bracket(pdf: pd.DataFrame) -> tuple:
    r = pdf.iloc[0]
    return float(r.a), bool(r.a_closed), float(r.b), bool(r.b_closed)


def _narrowed(points: DataFrame, state: DataFrame, wide: DataFrame, fixed: DataFrame, parts: DataFrame, draw_parts: DataFrame,
              drawn: int, most_listed: int, turn: int) -> DataFrame:
    """The state after one round of drawing and counting for the keys in ``wide``."""
    def sample(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"key": pd.Series(dtype="int64"), "slope": pd.Series(dtype=float)})
        r = right.iloc[0]
        found = draw(left.x.to_numpy(), left.y.to_numpy(), left.w.to_numpy(), _bracket(right), int(r.many), 1000 * turn + int(r.draw_part))
        return pd.DataFrame({"key": [r.key] * len(found), "slope": found})

    asked = draw_parts.join(wide, "key").withColumn("many", F.ceil(F.lit(drawn) / F.count(F.lit(1)).over(
        Window.partitionBy("key"))).cast("int"))
    slopes = points.groupBy("key", "draw_part").cogroup(_fresh(asked).groupBy("key", "draw_part")).applyInPandas(sample, "key long, slope double")
    share = (F.col("low") + F.col("high") + 1) / 2 - F.col("under_a")
    held = slopes.groupBy("key").agg(F.sort_array(F.collect_list("slope")).alias("held")).join(wide.join(fixed, "key"), "key", "right") \
        .withColumn("held", F.coalesce("held", F.array().cast("array<double>"))).withColumn("m", F.size("held")) \
        .withColumn("near", share / (F.col("under_b") - F.col("under_a")) * F.col("m"))

    def at(shift: str) -> Column:
        index = F.greatest(F.lit(0), F.least(F.col("m") - 1, F.floor(F.expr(f"near {shift} 2 * sqrt(m)")))).cast("int")
        return F.when(F.col("m") > 0, F.get("held", index))

    # Without a drawn slope the bracket is halved.
    middle = F.when(F.col("a") == float("-inf"), F.when(F.col("b") == float("inf"), 0.0).otherwise(F.col("b") - F.abs("b") - 1)) \
        .when(F.col("b") == float("inf"), F.col("a") + F.abs("a") + 1).otherwise(F.col("a") / 2 + F.col("b") / 2)
    # The ends keep clear of the slopes drawn, unless those agree: then slopes below and up to that one are counted.
    apart = F.when(at("-") == at("+"), 0.0)

    def off(c: Column) -> Column:
        return F.coalesce(apart, F.greatest(F.abs(c), F.lit(1e-290)) * (2.0 ** -52 * 4 * NEAR))

    probes = held.withColumn("p", F.coalesce(at("-") - off(at("-")), middle)).withColumn(
        "q", F.coalesce(at("+") + off(at("+")), middle)).withColumn(
        "mid", F.when(F.col("m") > 0, F.get("held", F.greatest(F.lit(0), F.least(F.col("m") - 1, F.floor("near"))).cast("int"))))
    probes = _kept(probes.select("key", "p", "q", "mid", "cut_x", "cut_y", "low", "high"))
    counts = _counted(points, parts.join(probes, "key")).groupBy("key").agg(
        F.max(F.when(F.col("probe") == 0, F.col("under"))).alias("under_p"), F.max(F.when(F.col("probe") == 1, F.col("under"))).alias("under_q"))
    both = state.join(probes.drop("cut_x", "cut_y").join(counts, "key"), "key", "left")
    p_low, q_low = F.col("under_p") <= F.col("low"), F.col("under_q") <= F.col("low")
    p_high, q_high = F.col("under_p") > F.col("high"), F.col("under_q") > F.col("high")

    def moved(name: str, q_first: bool) -> Column:
        value = {"edge": ("p", "q"), "closed": (F.lit(False), F.lit(True)), "under": ("under_p", "under_q")}[name]
        of = [F.col(v) if isinstance(v, str) else v for v in value]
        return F.when(q_low, of[1]).when(p_low, of[0]) if q_first else F.when(p_high, of[0]).when(q_high, of[1])

    new = both.select(
        "key", "mid", "done", "slope",
        *[F.coalesce(moved(kind, True), old).alias(old) for kind, old in (("edge", "a"), ("closed", "a_closed"), ("under", "under_a"))],
        *[F.coalesce(moved(kind, False), old).alias(old) for kind, old in (("edge", "b"), ("closed", "b_closed"), ("under", "under_b"))])
    # Up to v but not below it: v. The same within rounding: the slope drawn next to the wanted rank.
    one_value = (F.col("a") == F.col("b")) & ~F.col("a_closed") & F.col("b_closed")
    tight = (F.col("b") - F.col("a") <= 2.0 ** -52 * 16 * NEAR * F.greatest(F.abs("a"), F.abs("b"))) & (F.col("under_b") - F.col("under_a") > most_listed)
    found = F.when(one_value, F.col("a")).when(tight, F.col("mid"))
    return new.select("key", "a", "a_closed", "b", "b_closed", "under_a", "under_b", (F.col("done") | found.isNotNull()).alias("done"),
                      F.coalesce("slope", found + F.lit(0.0)).alias("slope"))


def _counted(points: DataFrame, asked: DataFrame) -> DataFrame:
    """Slopes below p (probe 0) and up to q (probe 1) for every key: key, probe, under."""
    row = "key long, probe int, part int, range int, hi double, lo double, w long"

    def by_x(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c.split()[0]: [] for c in row.split(", ")})
        left, r = left.sort_values(["x", "y"], kind="stable"), right.iloc[0]
        x, y, w = left.x.to_numpy(), left.y.to_numpy(), left.w.to_numpy().astype(np.int64)
        cut_x = np.array([] if r.cut_x is None else r.cut_x, float)
        cut_y = np.array([] if r.cut_y is None else r.cut_y, float)
        out = []
        for probe, s in ((0, float(r.p)), (1, float(r.q))):
            place = np.empty(len(x), np.int64)
            place[order_at(x, y, s, probe == 1)] = np.arange(len(x))
            own = int((swaps(place, w) * w).sum())
            hi, lo = residual(x, y, s)
            cuts = np.sort(residual(cut_x, cut_y, s)[0])[::4]
            z = pd.DataFrame({"hi": hi, "lo": lo, "w": w}).groupby(["hi", "lo"], as_index=False).w.sum()
            z["range"] = np.searchsorted(cuts, z.hi.to_numpy(), side="right")
            z = pd.concat([z, pd.DataFrame({"hi": [0.0], "lo": [0.0], "w": [own], "range": [-1]})])
            z["probe"] = probe
            out.append(z)
        out = pd.concat(out)
        out["key"], out["part"] = r.key, int(r.part)
        return out.astype({"range": "int32", "w": "int64", "probe": "int32", "part": "int32"})[[c.split()[0] for c in row.split(", ")]]

    passed = points.groupBy("key", "part").cogroup(_fresh(asked).groupBy("key", "part")).applyInPandas(by_x, row)
    passed = _kept(passed)
    cell = "key long, probe int, part int, range int, w long, own long"

    def by_z(pdf: pd.DataFrame) -> pd.DataFrame:
        closed = int(pdf.probe.iloc[0]) == 1
        pdf = pdf.sort_values(["part", "hi", "lo"], kind="stable")
        w, part = pdf.w.to_numpy().astype(np.int64), pdf.part.to_numpy().astype(np.int64)
        place = np.empty(len(pdf), np.int64)
        place[np.lexsort((-part if closed else part, pdf.lo.to_numpy(), pdf.hi.to_numpy()))] = np.arange(len(pdf))
        cells = pdf.groupby("part", as_index=False).w.sum()
        cells["own"] = 0
        cells.loc[0, "own"] = int((swaps(place, w) * w).sum())
        cells["key"], cells["probe"], cells["range"] = pdf.key.iloc[0], pdf.probe.iloc[0], pdf.range.iloc[0]
        return cells[[c.split()[0] for c in cell.split(", ")]]

    cells = passed.where("range >= 0").groupBy("key", "probe", "range").applyInPandas(by_z, cell)
    cells = cells.unionByName(passed.where("range < 0").select("key", "probe", "part", "range", F.lit(0).cast("long").alias("w"), F.col("w").alias("own")))

    def grid(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[pdf.range >= 0]
        table = np.zeros((int(held.part.max()) + 1, int(held.range.max()) + 1), np.int64)
        np.add.at(table, (held.part.to_numpy(), held.range.to_numpy()), held.w.to_numpy().astype(np.int64))
        # Points of earlier chunks in higher ranges.
        above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
        earlier = np.cumsum(above, axis=0) - above
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "probe": [pdf.probe.iloc[0]], "under": [int((earlier * table).sum()) + int(pdf.own.sum())]})

    return cells.groupBy("key", "probe").applyInPandas(grid, "key long, probe int, under long")


def _found(points: DataFrame, few: DataFrame, parts: DataFrame) -> DataFrame:
    """The slopes of keys whose brackets hold few pairs, or a wider bracket where one lies too near an end."""
    few = _kept(few)
    base = points.join(few.select("key", "a", "a_closed", "b", "b_closed", "cut_x", "cut_y"), "key")
    row = "key long, range int, x double, y double, w long"

    def dealt(batches):
        for pdf in batches:
            out = []
            for key, own in pdf.groupby("key", sort=False):
                a, closed, _, _ = _bracket(own)
                x, y, r = own.x.to_numpy(), own.y.to_numpy(), own.iloc[0]
                cut_x = np.array([] if r.cut_x is None else r.cut_x, float)
                cut_y = np.array([] if r.cut_y is None else r.cut_y, float)
                first = (lambda u, v: u) if np.isneginf(a) else (lambda u, v: residual(u, v, a)[0])
                cuts = np.sort(first(cut_x, cut_y))[::4]
                out.append(pd.DataFrame({"key": key, "range": np.searchsorted(cuts, first(x, y), side="right").astype("int32"),
                                         "x": x, "y": y, "w": own.w.to_numpy()}))
            yield pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in row.split(", ")})

    ranged = _kept(base.mapInPandas(dealt, row))
    ends = few.select("key", "a", "a_closed", "b", "b_closed")

    def at_upper(x: np.ndarray, y: np.ndarray, b: float) -> np.ndarray:
        """Values that order the points at the upper end."""
        return -x if np.isposinf(b) else residual(x, y, b)[0]

    def extremes(pdf: pd.DataFrame) -> pd.DataFrame:
        q = at_upper(pdf.x.to_numpy(), pdf.y.to_numpy(), float(pdf.b.iloc[0]))
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "range": [pdf.range.iloc[0]], "least": [q.min()], "most": [q.max()]})

    w = Window.partitionBy("key").orderBy("range")
    limits = ranged.join(ends, "key").groupBy("key", "range").applyInPandas(extremes, "key long, range int, least double, most double").select(
        "key", "range", F.max("most").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("most"),
        F.min("least").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("least")).join(ends, "key")

    def involved(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left[["key", "x", "y", "w"]].iloc[:0]
        bracket, r = _bracket(right), right.iloc[0]
        left = left.iloc[order_at(left.x.to_numpy(), left.y.to_numpy(), bracket[0], bracket[1])]
        q = at_upper(left.x.to_numpy(), left.y.to_numpy(), bracket[2])
        most = np.maximum.accumulate(np.r_[-np.inf if pd.isna(r.most) else r.most, q])[:-1]
        least = np.minimum.accumulate(np.r_[np.inf if pd.isna(r.least) else r.least, q[::-1]])[:-1][::-1]
        # Equal rounded values stay in: the pairs themselves are listed exactly.
        return left[(most >= q) | (least <= q)][["key", "x", "y", "w"]]

    points_in = ranged.groupBy("key", "range").cogroup(_fresh(limits).groupBy("key", "range")).applyInPandas(
        involved, "key long, x double, y double, w long")
    result = ("key long, new_a double, new_a_closed boolean, new_b double, new_b_closed boolean, new_under_a long, new_under_b long, "
              "new_done boolean, new_slope double")
    rows = points_in.join(few.drop("cut_x", "cut_y"), "key")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r, bracket = pdf.iloc[0], _bracket(pdf)
        chosen = pick(pdf.x.to_numpy(), pdf.y.to_numpy(), pdf.w.to_numpy(), bracket, [int(r.low - r.under_a), int(r.high - r.under_a)])
        a, _, b, _ = bracket
        clear = all(v - a > NEAR * np.spacing(abs(v)) and b - v > NEAR * np.spacing(abs(v)) for v in chosen)
        if clear or a == b:
            slope = chosen[0] if r.low == r.high else (chosen[0] + chosen[1]) / 2
            return _row(r.key, bracket, (r.under_a, r.under_b), True, slope)
        # Too near an end: take the other side of it in as well, with the counts of the whole.
        return _row(r.key, (-np.inf, False, np.inf, False), (0, r.total), False, None)

    return rows.groupBy("key").applyInPandas(solve, result)


def _row(key, bracket, under, done, slope) -> pd.DataFrame:
    return pd.DataFrame({"key": [key], "new_a": [bracket[0]], "new_a_closed": [bracket[1]], "new_b": [bracket[2]], "new_b_closed": [bracket[3]],
                         "new_under_a": [int(under[0])], "new_under_b": [int(under[1])], "new_done": [done],
                         "new_slope": pd.Series([slope], dtype=float)})
