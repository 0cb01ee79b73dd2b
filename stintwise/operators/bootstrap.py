"""Deterministic cluster bootstrap and percentile intervals.

Indices come from SHA-256 of ``seed:label:counter`` (label = comparison), four big-endian
64-bit words per digest, with rejection of the words that would bias the remainder, so the
same seed gives the same intervals on any cluster. Clusters are ordered by their sorted
contents, which makes the result independent of the order of the input.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintwise.operators.quantiles import deviations, quantiles
from stintwise.operators.spread import UNKNOWN, Scale, heavy_keys, lookup_join, position_in, settle, split_cumulative
from stintwise.operators.theilsen import median_slope, theil_sen
from stintwise.session import cut_lineage

BLOCK = 32
CHUNK = 4096
TWO32 = 1 << 32
#: Draws of a comparison in one task, most such tasks of a comparison, and most observations that a task holds.
DRAWS_PER_TASK = 8
MOST_TASKS = 64
MOST_HELD = 1_000_000


def cluster_order(obs: DataFrame, key: str, cluster: str, values: list[str], scale: Scale = UNKNOWN) -> DataFrame:
    """(key, cluster, rank, clusters): clusters numbered by their sorted contents."""
    item = F.struct(*values)
    whole = Window.partitionBy(key)
    if scale.fits:
        content = obs.groupBy(key, cluster).agg(F.array_sort(F.collect_list(item)).alias("_content"))
        return content.select(
            key, cluster, (F.row_number().over(whole.orderBy("_content", cluster)) - 1).cast("long").alias("rank"),
            F.count(F.lit(1)).over(whole).alias("clusters"))
    # Compare contents a block of positions at a time, and go on only with those still equal.
    hist = obs.withColumn("_item", item).groupBy(key, cluster, "_item").agg(F.count(F.lit(1)).alias("w"))
    placed = cut_lineage(split_cumulative(hist, [key, cluster], "_item", ["w"], scale))
    # Clusters of the same contents stay equal for good; two hashes of the contents tell them.
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "_item", "w")) for i in (1, 2)]
    sizes = placed.groupBy(key, cluster).agg(F.max("w_total").alias("_size"), F.struct(*marks).alias("_same"))
    state = cut_lineage(sizes.withColumn("_group", F.lit(0).cast("long")).withColumn("_tied", F.lit(True)))
    block = 0
    while True:
        start, stop = block * BLOCK, (block + 1) * BLOCK
        inside = F.least(F.col("w_before") + F.col("w"), F.lit(stop)) - F.greatest(F.col("w_before"), F.lit(start))
        part = placed.filter((F.col("w_before") < stop) & (F.col("w_before") + F.col("w") > start)).groupBy(
            key, cluster).agg(F.array_sort(F.flatten(F.collect_list(
                F.array_repeat("_item", inside.cast("int"))))).alias("_part"))
        empty = F.array().cast(part.schema["_part"].dataType)
        joined = state.join(part, [key, cluster], "left").withColumn("_part", F.coalesce("_part", empty))
        groups = joined.groupBy(key, "_group", "_part").agg(F.count(F.lit(1)).alias("c"),
                                                           F.max("_size").alias("_longest"),
                                                           (F.min("_same") != F.max("_same")).alias("_differ"))
        after = split_cumulative(groups, [key, "_group"], "_part", ["c"], scale)
        state = cut_lineage(lookup_join(
            joined.drop("_tied"), after.select(
                key, "_group", "_part", "c_before", (F.col("_differ") & (F.col("_longest") > stop)).alias("_tied")),
            [key, "_group", "_part"], "inner", [F.col(cluster)], scale).select(
            key, cluster, "_size", "_same", (F.col("_group") + F.col("c_before")).alias("_group"), "_tied"))
        block += 1
        if state.filter("_tied").isEmpty():
            break
    final = position_in(state, [key, "_group"], [cluster], "_at", scale)
    totals = final.groupBy(key).agg(F.count(F.lit(1)).alias("clusters"))
    return final.select(key, cluster, (F.col("_group") + F.col("_at")).alias("rank")).join(totals, key)


def _checked(sizes: DataFrame) -> DataFrame:
    m = F.col("clusters")
    return sizes.withColumn("clusters", F.when(m < 2 ** 31, m).otherwise(
        F.raise_error(F.lit("more than 2^31 clusters in one comparison"))))


def _words(base: DataFrame, key: str, draws: int, seed: int, extra: Column) -> DataFrame:
    """The words of every draw, ``extra`` more than it has slots, and whether they are rejected."""
    m = F.col("clusters")
    # 2^64 mod m words at the top of the range are rejected.
    top = (F.lit(TWO32) % m) * (F.lit(TWO32) % m) % m
    first = F.col("draw") * m
    last = first + m - 1 + extra
    chunked = base.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long")))) \
        .repartition(key, "draw") \
        .withColumn("_first", F.expr("(draw * clusters) div 4")).withColumn("_last", F.floor(last / 4)) \
        .withColumn("_from", F.explode(F.sequence("_first", "_last", F.lit(CHUNK).cast("long")))) \
        .withColumn("_counter", F.explode(F.sequence(
            F.col("_from"), F.least(F.col("_from") + CHUNK - 1, F.col("_last"))))) \
        .withColumn("_digest", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key), F.col("_counter").cast("string")), 256)) \
        .withColumn("_word", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    half = F.col("_digest").substr(F.col("_word") * 16 + 1, F.lit(8))
    high = F.conv(half, 16, 10).cast("long")
    low = F.conv(F.col("_digest").substr(F.col("_word") * 16 + 9, F.lit(8)), 16, 10).cast("long")
    return chunked.withColumns({"_w": F.col("_counter") * 4 + F.col("_word"), "_high": high, "_low": low,
                                "_bad": (half == "ffffffff") & (low >= F.lit(TWO32) - top)})


def rejected_words(sizes: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """(key, _rejected): sorted numbers of the words left out, for the (practically always no) keys that have any."""
    return _words(_checked(sizes), key, draws, seed, F.lit(0)).filter("_bad").groupBy(key).agg(
        F.array_sort(F.collect_set("_w")).alias("_rejected"))


def drawn_clusters(sizes: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """(key, draw, slot, rank): which cluster each slot of each draw takes.

    ``sizes`` holds key and clusters, fewer than 2^31, which is checked. Draws are dealt over the cluster first, then
    each draw makes its own digests in chunks; a rejected word shifts all later ones, so the
    (practically always empty) list of rejected words is found first.
    """
    m = F.col("clusters")
    bad = rejected_words(sizes, key, draws, seed)
    none = F.array().cast("array<long>")
    with_bad = _checked(sizes).join(F.broadcast(bad), key, "left").withColumn("_rejected", F.coalesce("_rejected", none))
    # A shifted draw reads a few words further; each of those may be rejected too, so allow twice.
    extra = F.when(F.size("_rejected") > 0, F.size("_rejected") * 2 + 4).otherwise(0)
    accepted = _words(with_bad, key, draws, seed, extra).filter(~F.col("_bad"))
    place = F.col("_w") - F.when(F.size("_rejected") > 0, F.size(
        F.filter("_rejected", lambda r: r < F.col("_w")))).otherwise(0)
    value = (F.col("_high") % m * (F.lit(TWO32) % m) + F.col("_low") % m) % m
    return accepted.withColumn("_p", place).filter(
        (F.col("_p") >= F.col("draw") * m) & (F.col("_p") < (F.col("draw") + 1) * m)).select(
        key, "draw", (F.col("_p") - F.col("draw") * m).alias("slot"), value.alias("rank"))


def bootstrap(
    obs: DataFrame,
    key: str,
    cluster: str,
    statistic: str,
    draws: int,
    seed: int,
    scale: Scale = UNKNOWN,
) -> DataFrame:
    """(key, draw, value): the statistic of each resample of whole clusters.

    ``statistic`` is ``median`` or ``mean`` (of ``difference``), ``median_difference`` or
    ``mean_difference`` (arms unpaired, of ``value``), ``dispersion_ratio``, or ``trend``
    (slope over the resampled sequence; needs ``pair_id``). Undefined draws are left out.
    """
    if not 200 <= draws <= 100_000:
        raise ValueError(f"{draws} draws; 200 to 100,000 are allowed")
    armed = statistic in ("median_difference", "mean_difference", "dispersion_ratio")
    parts = ["arm", "value"] if armed else ["difference"]
    measure = parts[-1]
    by = parts[:-1]
    if not scale.fits:
        # Observations may be far fewer than the rows that they were made from.
        scale = Scale(obs.count(), scale.rows_per_task)
    order = settle(cluster_order(obs, key, cluster, parts, scale), scale)
    ids = ["pair_id"] if statistic == "trend" else []
    held = lookup_join(obs.select(key, cluster, *parts, *ids), order.select(key, cluster, "rank", "clusters"), [key, cluster],
                       "inner", [F.col(measure)], scale)
    if statistic in ("mean", "mean_difference"):
        taken = settle(drawn_clusters(order.select(key, "clusters").distinct(), key, draws, seed), scale)
        sums = held.groupBy(key, "rank").agg(*_sums(by, measure))
        pooled = taken.join(sums, [key, "rank"]).groupBy(key, "draw").agg(
            *[F.sum(c).alias(c) for c in sums.columns if c not in (key, "rank")])
        value = F.col("_s") / F.col("_n") if not by else (
            F.col("_si") / F.nullif(F.col("_ni"), F.lit(0)) - F.col("_sb") / F.nullif(F.col("_nb"), F.lit(0)))
        return pooled.select(key, "draw", value.alias("value")).filter("value is not null")
    held = cut_lineage(held)
    sizes = held.select(key, "clusters").distinct()
    apart = cut_lineage(heavy_keys(held, [key], min(MOST_HELD, scale.rows_per_task)).select(key).union(
        rejected_words(sizes, key, draws, seed).select(key)).distinct())
    if apart.isEmpty():
        return _draws_in_tasks(held, key, by, measure, statistic, draws, seed)
    apart = F.broadcast(apart)
    spread = _draws_spread(held.join(apart, key, "left_semi"), key, by, measure, statistic, draws, seed, scale)
    return spread.unionByName(_draws_in_tasks(held.join(apart, key, "left_anti"), key, by, measure, statistic, draws, seed))


def _draws_in_tasks(held: DataFrame, key: str, by: list[str], measure: str, statistic: str, draws: int, seed: int) -> DataFrame:
    """Comparisons that a task can hold, without rejected words: each task has all observations of one, and some of its draws.

    A resample is the number of times it takes each cluster, so nothing is repeated once per draw.
    """
    per = max(DRAWS_PER_TASK, -(-draws // MOST_TASKS))
    arm = F.when(F.col("arm") == "baseline", 0).when(F.col("arm") == "intervention", 1).otherwise(2) if by else F.lit(0)
    dealt = held.select(key, "rank", "clusters", arm.alias("_arm"), F.col(measure).cast("double").alias("_v"),
                        F.explode(F.sequence(F.lit(0), F.lit(-(-draws // per) - 1))).alias("_block"))
    schema = T.StructType([held.schema[key], T.StructField("draw", T.LongType()), T.StructField("value", T.DoubleType())])

    def solve(at: tuple, rows: pa.Table) -> pa.Table:
        label, block = (k.as_py() for k in at)
        m = rows["clusters"][0].as_py()
        rank, arms, v = (rows[c].to_numpy() for c in ("rank", "_arm", "_v"))
        known = rows["_v"].is_valid().to_numpy()
        # By cluster with sorted contents (nulls first), or by value.
        sort = np.lexsort((v, known, rank)) if statistic == "trend" else np.argsort(v, kind="stable")
        if statistic != "trend":
            sort = sort[known[sort]]
        rank, arms, v, known = rank[sort], arms[sort], v[sort], known[sort]
        numbers = range(block * per, min((block + 1) * per, draws))
        found = [_statistic(statistic, drawn_ranks(seed, label, m, draw), m, rank, arms, v, known) for draw in numbers]
        return pa.table({key: pa.array([label] * len(found), rows.schema.field(key).type),
                         "draw": pa.array(numbers, pa.int64()), "value": pa.array(found, pa.float64())})

    return dealt.groupBy(key, "_block").applyInArrow(solve, schema).filter("value is not null")


def drawn_ranks(seed: int, label: str | None, clusters: int, draw: int) -> np.ndarray:
    """The clusters of one draw by slot, where no word is rejected; see ``drawn_clusters``."""
    start, stop = draw * clusters, (draw + 1) * clusters
    head = f"{seed}:" if label is None else f"{seed}:{label}:"
    digests = b"".join([sha256(f"{head}{c}".encode()).digest() for c in range(start // 4, -(-stop // 4))])
    words = np.frombuffer(digests, ">u8")[start % 4:start % 4 + clusters].astype(np.uint64)
    return (words % np.uint64(clusters)).astype(np.int64)


def _statistic(statistic: str, taken: np.ndarray, m: int, rank: np.ndarray, arms: np.ndarray, v: np.ndarray,
               known: np.ndarray) -> float | None:
    if statistic == "trend":
        sizes = np.bincount(rank, minlength=m)
        starts, many = np.cumsum(sizes) - sizes, sizes[taken]
        before = np.cumsum(many) - many
        at = np.repeat(starts[taken] - before, many) + np.arange(many.sum())
        x = np.flatnonzero(known[at])
        return median_slope(x, v[at[x]])
    weight = np.bincount(taken, minlength=m)[rank]
    if statistic == "median":
        return weighted_median(v, weight)
    centres = []
    for arm in (0, 1):
        values, w = v[arms == arm], weight[arms == arm]
        centre = weighted_median(values, w)
        if statistic == "dispersion_ratio" and centre is not None:
            away = np.abs(values - centre)
            order = np.argsort(away, kind="stable")
            centre = weighted_median(away[order], w[order])
        centres.append(centre)
    b, i = centres
    if b is None or i is None:
        return None
    return i - b if statistic == "median_difference" else (i / b if b else None)


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float | None:
    """Median of sorted values that stand for ``weights`` each; None without any."""
    upto = np.cumsum(weights)
    n = int(upto[-1]) if len(upto) else 0
    if not n:
        return None
    low, high = (float(values[np.searchsorted(upto, r, side="right")]) for r in ((n - 1) // 2, n // 2))
    return low if low == high else low + (high - low) * 0.5


def _draws_spread(held: DataFrame, key: str, by: list[str], measure: str, statistic: str, draws: int, seed: int,
                  scale: Scale) -> DataFrame:
    """Comparisons of any size: every observation of a cluster is repeated once per draw that takes it."""
    taken = settle(drawn_clusters(held.select(key, "clusters").distinct(), key, draws, seed), scale)
    parts = [*by, measure]
    fan_out = Scale(scale.rows, max(1, scale.rows_per_task // draws))
    if statistic == "trend":
        return _trend_draws(held, taken, key, measure, fan_out, scale)
    hist = held.filter(F.col(measure).isNotNull()).groupBy(key, "rank", *parts).agg(F.count(F.lit(1)).alias("_c"))
    drawn = lookup_join(hist, taken.select(key, "draw", "rank"), [key, "rank"], "inner", [F.col(measure)], fan_out)
    group = [key, "draw", *by]
    if statistic == "median":
        pooled = drawn.groupBy(*group, measure).agg(F.sum("_c").alias("w"))
        return quantiles(pooled, group, measure, {"value": 0.5}, scale).select(key, "draw", "value")
    pooled = settle(drawn.groupBy(*group, measure).agg(F.sum("_c").alias("w")), fan_out)
    centre = quantiles(pooled, group, measure, {"centre": 0.5}, scale)
    if statistic == "dispersion_ratio":
        centre = deviations(pooled, group, measure, centre, "centre", scale).withColumnRenamed("mad", "centre")
    arms = centre.groupBy(key, "draw").agg(
        F.max(F.when(F.col("arm") == "baseline", F.col("centre"))).alias("b"),
        F.max(F.when(F.col("arm") == "intervention", F.col("centre"))).alias("i"))
    value = F.col("i") - F.col("b") if statistic == "median_difference" else F.when(
        F.col("b") != 0, F.col("i") / F.col("b"))
    return arms.select(key, "draw", value.alias("value")).filter("value is not null")


def _sums(by: list[str], measure: str) -> list[Column]:
    if not by:
        return [F.sum(measure).alias("_s"), F.count(measure).alias("_n")]
    out = []
    for arm, tag in (("baseline", "b"), ("intervention", "i")):
        mine = F.when(F.col("arm") == arm, F.col(measure))
        out += [F.coalesce(F.sum(mine), F.lit(0.0)).alias(f"_s{tag}"), F.count(mine).alias(f"_n{tag}")]
    return out


def _trend_draws(held: DataFrame, taken: DataFrame, key: str, measure: str, fan_out: Scale, scale: Scale) -> DataFrame:
    """Slope over each resampled sequence: clusters in drawn order, sorted inside."""
    inner = position_in(held, [key, "rank"], [measure, "pair_id"], "_at", scale)
    sizes = held.groupBy(key, "rank").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy(key, "draw").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = taken.join(sizes, [key, "rank"]).select(
        key, "draw", "slot", "rank", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_offset"))
    points = lookup_join(inner.select(key, "rank", measure, "_at"), offsets, [key, "rank"], "inner",
                         [F.col("_at")], fan_out).withColumn("_x", F.col("_offset") + F.col("_at"))
    slopes = theil_sen(points, [key, "draw"], "_x", measure, scale)
    return slopes.select(key, "draw", F.col("slope").alias("value")).filter("value is not null")


def percentile_interval(
    distribution: DataFrame, key: str, draws: int, coverage: float, clusters: DataFrame, minimum_clusters: int
) -> DataFrame:
    """Interval per key with the reason when it may not be used.

    Positions are taken in double arithmetic: floor(a/2 * B) and ceil((1 - a/2) * B) - 1 of
    the B defined draws. ``clusters`` holds key and clusters. A comparison has at most
    ``draws`` rows here, so ranking them in one task is bounded.
    """
    alpha = 1.0 - coverage
    w = Window.partitionBy(key)
    ranked = distribution.select(
        key, "value", (F.row_number().over(w.orderBy("value")) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_b"))
    last = F.col("_b") - 1
    upper = F.least(F.greatest(F.ceil(F.lit(1 - alpha / 2) * F.col("_b")) - 1, F.lit(0)), last)
    lower = F.least(F.greatest(F.floor(F.lit(alpha / 2) * F.col("_b")), F.lit(0)), last, upper)
    found = ranked.groupBy(key).agg(
        F.max("_b").alias("defined_draws"), F.max(F.when(F.col("_i") == lower, F.col("value"))).alias("_lo"),
        F.max(F.when(F.col("_i") == upper, F.col("value"))).alias("_hi"))
    out = clusters.select(key, "clusters").distinct().join(found, key, "left")
    reason = F.when(F.col("clusters") < minimum_clusters, "too_few_clusters").when(
        F.coalesce("defined_draws", F.lit(0)) < draws // 2, "too_few_defined_draws")
    return out.withColumn("unusable_reason", reason).select(
        key, "clusters", F.coalesce("defined_draws", F.lit(0)).cast("long").alias("defined_draws"), "unusable_reason",
        F.col("unusable_reason").isNull().alias("usable"),
        F.when(F.col("unusable_reason").isNull(), F.col("_lo")).alias("lower"),
        F.when(F.col("unusable_reason").isNull(), F.col("_hi")).alias("upper"))
