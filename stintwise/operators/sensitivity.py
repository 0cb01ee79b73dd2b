"""Falsification checks of a paired difference, for many comparisons at once.

``pairs`` hold the key, pair_id, cluster_id and difference. Every check returns one row per
key with its detail and an ``outcome``: robust, fragile or not_computable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.operators.quantiles import histogram, medians, order_statistics
from stintwise.operators.spread import UNKNOWN, Scale, lookup_join, position_in
from stintwise.operators.stats import pair_order


def sign(value: Column) -> Column:
    """-1, 0 or 1; 0 when undefined."""
    return F.coalesce(F.signum(value), F.lit(0.0)).cast("int")


def _centre(pairs: DataFrame, keys: list[str], effect: str, scale: Scale, name: str = "full_estimate") -> DataFrame:
    if effect == "mean_paired_difference":
        return pairs.groupBy(*keys).agg(F.count("difference").alias("n"), F.avg("difference").alias(name))
    return medians(pairs, keys, "difference", name, scale)


def _verdict(enough: Column, robust: Column) -> Column:
    return F.when(~enough, "not_computable").when(robust, "robust").otherwise("fragile")


def leave_one_unit_out(pairs: DataFrame, key: str, effect: str = "median_paired_difference",
                       scale: Scale = UNKNOWN) -> DataFrame:
    """Smallest and largest estimate with one pair left out, and how many change direction.

    Without one value the median can only be one of at most three numbers around the
    middle, so three order statistics and their multiplicities answer for all n removals.
    """
    if effect == "mean_paired_difference":
        totals = pairs.groupBy(key).agg(F.sum("difference").alias("_s"), F.count("difference").alias("n"))
        each = lookup_join(pairs.select(key, "pair_id", "difference"), totals, [key], "inner", [F.col("pair_id")], scale)
        out = each.withColumn("_e", (F.col("_s") - F.col("difference")) / F.nullif(F.col("n") - 1, F.lit(0)))
        changed = sign(F.col("_e")) != sign(F.col("_s"))
        stats = out.groupBy(key).agg(
            F.max("n").alias("n"), F.min("_e").alias("estimates_minimum"), F.max("_e").alias("estimates_maximum"),
            F.count_if(changed).alias("direction_changes"))
    else:
        middle = order_statistics(histogram(pairs, [key], "difference"), [key], "difference", {
            "a": lambda n: F.floor(n / 2) - 1, "b": lambda n: F.floor(n / 2), "c": lambda n: F.floor(n / 2) + 1}, scale)
        n, m = F.col("n"), F.floor(F.col("n") / 2)
        odd = n % 2 == 1
        a, b, c = F.col("a"), F.col("b"), F.col("c")
        full = F.when(odd, b).otherwise((a + b) / 2)
        options = F.when(odd, F.array(
            F.struct(((b + c) / 2).alias("e"), m.alias("k")), F.struct(((a + c) / 2).alias("e"), F.lit(1).cast("long").alias("k")),
            F.struct(((a + b) / 2).alias("e"), m.alias("k")))).otherwise(F.array(
                F.struct(b.alias("e"), m.alias("k")), F.struct(a.alias("e"), m.alias("k"))))
        stats = middle.withColumn("_o", options).withColumn("_d", sign(full)).select(
            key, "n", F.array_min(F.transform("_o", lambda o: o["e"])).alias("estimates_minimum"),
            F.array_max(F.transform("_o", lambda o: o["e"])).alias("estimates_maximum"),
            F.aggregate("_o", F.lit(0).cast("long"), lambda acc, o: acc + F.when(
                F.coalesce(F.signum(o["e"]), F.lit(0.0)).cast("int") != F.col("_d"), o["k"]).otherwise(0)
            ).alias("direction_changes"))
    enough = F.col("n") >= 3
    return stats.select(key, "n", *[F.when(enough, F.col(c)).alias(c) for c in (
        "estimates_minimum", "estimates_maximum", "direction_changes")],
        _verdict(enough, F.col("direction_changes") == 0).alias("outcome"))


def leave_one_cluster_out(pairs: DataFrame, key: str, effect: str = "median_paired_difference",
                          scale: Scale = UNKNOWN) -> DataFrame:
    """The same with one whole cluster left out.

    For the median: give every value its rank in the comparison (g) and in its cluster (i).
    Among the values that remain without the cluster, g - i of them lie below it, so the
    remaining value of rank j sits at overall rank j + #(cluster values with g - i <= j).
    Two counts per cluster and one look-up replace the re-computation.
    """
    per_cluster = [key, "cluster_id"]
    if effect == "mean_paired_difference":
        part = pairs.groupBy(*per_cluster).agg(F.sum("difference").alias("_sc"), F.count("difference").alias("_nc"))
        totals = part.groupBy(key).agg(F.sum("_sc").alias("_s"), F.sum("_nc").alias("_n"))
        each = lookup_join(part, totals, [key], "inner", [F.col("cluster_id")], scale).withColumn(
            "_e", (F.col("_s") - F.col("_sc")) / F.nullif(F.col("_n") - F.col("_nc"), F.lit(0)))
        full = totals.select(key, (F.col("_s") / F.col("_n")).alias("_full"))
    else:
        order = ["difference", "pair_id"]
        ranked = position_in(position_in(pairs.select(key, "cluster_id", *order), [key], order, "_g", scale),
                             per_cluster, order, "_i", scale)
        sizes = pairs.groupBy(*per_cluster).agg(F.count(F.lit(1)).alias("_nc"))
        totals = sizes.groupBy(key).agg(F.sum("_nc").alias("_n"))
        targets = lookup_join(sizes, totals, [key], "inner", [F.col("cluster_id")], scale).withColumn(
            "_left", F.col("_n") - F.col("_nc"))
        free = F.col("_g") - F.col("_i")
        shifts = lookup_join(ranked, targets.select(*per_cluster, "_left"), per_cluster, "inner",
                             [F.col("pair_id")], scale).groupBy(*per_cluster).agg(
            F.max("_left").alias("_left"),
            F.count_if(free <= F.expr("(_left - 1) div 2")).alias("_t1"),
            F.count_if(free <= F.expr("_left div 2")).alias("_t2"))
        wanted = shifts.filter("_left > 0").select(*per_cluster, F.explode(F.array(
            F.expr("(_left - 1) div 2") + F.col("_t1"), F.expr("_left div 2") + F.col("_t2"))).alias("_g"))
        each = wanted.join(ranked.select(key, "_g", "difference"), [key, "_g"]).groupBy(*per_cluster).agg(
            F.avg("difference").alias("_e"))
        full = medians(pairs, [key], "difference", "_full", scale).drop("n")
    clusters = pairs.select(*per_cluster).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("clusters"))
    joined = lookup_join(each, full, [key], "inner", [F.col("cluster_id")], scale)
    stats = joined.groupBy(key).agg(
        F.min("_e").alias("estimates_minimum"), F.max("_e").alias("estimates_maximum"),
        F.count_if(sign(F.col("_e")) != sign(F.col("_full"))).alias("direction_changes"))
    enough = F.col("clusters") >= 3
    return clusters.join(stats, key, "left").select(key, "clusters", *[F.when(enough, F.col(c)).alias(c) for c in (
        "estimates_minimum", "estimates_maximum", "direction_changes")],
        _verdict(enough, F.col("direction_changes") == 0).alias("outcome"))


def isolation_by_cluster(pairs: DataFrame, key: str, effect: str = "median_paired_difference",
                         scale: Scale = UNKNOWN) -> DataFrame:
    """Does a majority of clusters, each on its own, agree with the overall direction?"""
    own = _centre(pairs, [key, "cluster_id"], effect, scale, "_e").drop("n")
    joined = lookup_join(own, _centre(pairs, [key], effect, scale).drop("n"), [key], "inner", [F.col("cluster_id")], scale)
    stats = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(sign(F.col("_e")) == sign(F.col("full_estimate"))).alias("agreeing"))
    return stats.withColumn("outcome", _verdict(F.col("clusters") >= 2, F.col("agreeing") * 2 > F.col("clusters")))


def early_versus_late(pairs: DataFrame, key: str, effect: str = "median_paired_difference",
                      scale: Scale = UNKNOWN) -> DataFrame:
    """Estimates of the first and the second half in pair order."""
    full = _centre(pairs, [key], effect, scale)
    placed = lookup_join(pair_order(pairs, [key], scale), full, [key], "inner", [F.col("pair_id")], scale)
    halves = placed.withColumn("_late", F.col("pair_index") >= F.floor(F.col("n") / 2))
    each = _centre(halves.select(key, "_late", "difference"), [key, "_late"], effect, scale, "_e")
    both = each.groupBy(key).agg(
        F.max(F.when(~F.col("_late"), F.col("_e"))).alias("early_estimate"),
        F.max(F.when(F.col("_late"), F.col("_e"))).alias("late_estimate"))
    enough = F.col("n") >= 4
    agree = (sign(F.col("early_estimate")) == sign(F.col("full_estimate"))) & (
        sign(F.col("late_estimate")) == sign(F.col("full_estimate")))
    return full.join(both, key).select(
        key, "n", F.floor(F.col("n") / 2).alias("split_at"),
        F.when(enough, F.col("early_estimate")).alias("early_estimate"),
        F.when(enough, F.col("late_estimate")).alias("late_estimate"), _verdict(enough, agree).alias("outcome"))


def outlier_dependence(pairs: DataFrame, key: str, threshold: float, effect: str = "median_paired_difference",
                       scale: Scale = UNKNOWN) -> DataFrame:
    """Estimate without the difference farthest from the median (the last one among equals)."""
    full = _centre(pairs, [key], effect, scale)
    middle = full.withColumnRenamed("full_estimate", "_m") if effect == "median_paired_difference" else medians(
        pairs, [key], "difference", "_m", scale)
    away = lookup_join(pairs.select(key, "pair_id", "difference"), middle.select(key, "_m"), [key], "inner",
                       [F.col("pair_id")], scale)
    far = away.groupBy(key).agg(F.max(F.struct(
        F.abs(F.col("difference") - F.col("_m")).alias("away"), "pair_id", "difference")).alias("_far"))
    rest = lookup_join(pairs.select(key, "pair_id", "difference"), far, [key], "inner", [F.col("pair_id")], scale).filter(
        F.col("pair_id") != F.col("_far.pair_id"))
    without = _centre(rest, [key], effect, scale, "estimate_without_outlier").drop("n")
    enough = F.col("n") >= 3
    e, f = F.col("estimate_without_outlier"), F.col("full_estimate")
    carried = (sign(e) != sign(f)) | ((F.abs(e) < threshold) & (F.lit(threshold) <= F.abs(f)))
    return full.join(far, key).join(without, key, "left").select(
        key, "n", "full_estimate", F.when(enough, F.col("_far.difference")).alias("removed_difference"),
        F.when(enough, e).alias("estimate_without_outlier"), _verdict(enough, ~carried).alias("outcome"))


def sign_stability(pairs: DataFrame, key: str, effect: str = "median_paired_difference",
                   scale: Scale = UNKNOWN) -> DataFrame:
    """Does a majority of the differences share the sign of the estimate?"""
    joined = lookup_join(pairs.select(key, "pair_id", "difference"), _centre(pairs, [key], effect, scale), [key],
                         "inner", [F.col("pair_id")], scale)
    stats = joined.groupBy(key).agg(
        F.max("n").alias("pairs"),
        F.count_if(sign(F.col("difference")) == sign(F.col("full_estimate"))).alias("concordant_pairs"))
    return stats.withColumn("outcome", _verdict(F.lit(True), F.col("concordant_pairs") * 2 > F.col("pairs")))


def all_checks(pairs: DataFrame, key: str, threshold: float, effect: str = "median_paired_difference",
               scale: Scale = UNKNOWN) -> DataFrame:
    """(key, kind, outcome) for all six checks."""
    checks = {
        "leave_one_unit_out": leave_one_unit_out(pairs, key, effect, scale),
        "leave_one_cluster_out": leave_one_cluster_out(pairs, key, effect, scale),
        "isolation_by_cluster": isolation_by_cluster(pairs, key, effect, scale),
        "order_effect_early_versus_late": early_versus_late(pairs, key, effect, scale),
        "outlier_dependence": outlier_dependence(pairs, key, threshold, effect, scale),
        "direction_sign_stability": sign_stability(pairs, key, effect, scale),
    }
    out = None
    for kind, df in checks.items():
        part = df.select(key, F.lit(kind).alias("kind"), "outcome")
        out = part if out is None else out.unionByName(part)
    return out
