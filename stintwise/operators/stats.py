"""Estimators and tests over paired or unpaired units, grouped by any key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.operators.quantiles import medians, robust_summary
from stintwise.operators.spread import UNKNOWN, Scale, lookup_join, ordered_scan, position_in


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 16, stepped back down."""
    y = x + 16.0
    series = ((y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi)
              + 1 / (12.0 * y) - 1 / (360.0 * y * y * y) + 1 / (1260.0 * y * y * y * y * y))
    return series - sum((F.log(x + float(i)) for i in range(1, 16)), F.log(x))


def sign_test_p(positive: Column, negative: Column) -> Column:
    """Two-sided exact sign test: min(1, 2 * sum of C(n, i) / 2^n for i up to the smaller count).

    Up to 1000 trials the terms are built up from 2^-n, exactly for as long as a double holds
    the binomials. Beyond, the largest term comes from log-gamma and the smaller ones follow
    by their ratio for as long as they can still change a double, about sqrt(n) terms. Null
    without trials.
    """
    n = (positive + negative).cast("double")
    k = F.least(positive, negative)
    one = F.pow(F.lit(2.0), -n)
    start = F.struct(one.alias("t"), one.alias("s"))
    upward = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.when(n <= 1000, k).otherwise(1))).otherwise(
            F.array().cast("array<long>")),
        start, lambda acc, i: F.struct(
            (acc["t"] * (n - i + 1) / i).alias("t"), (acc["s"] + acc["t"] * (n - i + 1) / i).alias("s")),
        lambda acc: acc["s"])
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1) - n * math.log(2))
    steps = F.least(k, F.ceil(F.sqrt(n) * 7) + 50).cast("long")
    downward = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.when(n > 1000, steps).otherwise(0)),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, i: F.struct(
            (acc["t"] * (k - i) / (n - k + i + 1)).alias("t"), (acc["s"] + acc["t"]).alias("s")),
        lambda acc: acc["s"])
    tail = F.when(n <= 1000, upward).otherwise(top * downward)
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def sign_test(pairs: DataFrame, keys: list[str], difference: str = "difference") -> DataFrame:
    """positive, negative, ties, trials and p_value per key; sums only."""
    counted = pairs.groupBy(*keys).agg(
        F.count_if(F.col(difference) > 0).alias("positive"), F.count_if(F.col(difference) < 0).alias("negative"),
        F.count_if(F.col(difference) == 0).alias("ties"))
    return counted.withColumn("trials", F.col("positive") + F.col("negative")).withColumn(
        "p_value", sign_test_p(F.col("positive"), F.col("negative")))


def paired_effect(pairs: DataFrame, keys: list[str], effect: str = "median_paired_difference",
                  scale: Scale = UNKNOWN) -> DataFrame:
    """Estimate and secondary estimate (the other of median and mean) of the differences."""
    first, second = ("_median", "_mean") if effect == "median_paired_difference" else ("_mean", "_median")
    both = robust_summary(pairs, keys, "difference", scale).select(
        *keys, F.col("n_values").alias("n"), F.col("median").alias("_median"), F.col("mean").alias("_mean"))
    return both.select(*keys, "n", F.col(first).alias("estimate"), F.col(second).alias("secondary_estimate"))


def arm_values(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """Both sides of each pair as rows (arm, value)."""
    return pairs.select(*keep, F.inline(F.array(
        F.struct(F.lit("baseline").alias("arm"), F.col("baseline_value").alias("value")),
        F.struct(F.lit("intervention").alias("arm"), F.col("intervention_value").alias("value")))))


def _by_arm(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key from one row per (key, arm): <arm>_<column>."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{arm}_{c}")
        for arm in ("baseline", "intervention") for c in columns])


def unpaired_effect(units: DataFrame, keys: list[str], effect: str = "median_difference",
                    scale: Scale = UNKNOWN) -> DataFrame:
    """Intervention minus baseline of the arm medians or means; null when an arm is empty."""
    if effect == "median_difference":
        per_arm = medians(units, [*keys, "arm"], "value", "centre", scale)
    else:
        per_arm = units.groupBy(*keys, "arm").agg(F.avg("value").alias("centre"), F.count("value").alias("n"))
    return _by_arm(per_arm, keys, ["centre", "n"]).select(
        *keys, F.coalesce("baseline_n", F.lit(0)).alias("baseline_n"),
        F.coalesce("intervention_n", F.lit(0)).alias("intervention_n"),
        (F.col("intervention_centre") - F.col("baseline_centre")).alias("estimate"))


def dispersion_ratio(units: DataFrame, keys: list[str], scale: Scale = UNKNOWN) -> DataFrame:
    """MAD of the intervention over MAD of the baseline, with both MADs and IQRs.

    The ratio is null when the baseline does not vary, an IQR when it has fewer than two
    values.
    """
    both = robust_summary(units, [*keys, "arm"], "value", scale).withColumn(
        "iqr", F.when(F.col("n_values") >= 2, F.col("q3") - F.col("q1")))
    return _by_arm(both, keys, ["mad", "iqr"]).withColumn(
        "ratio", F.when(F.col("baseline_mad") != 0, F.col("intervention_mad") / F.col("baseline_mad")))


def group_summary(units: DataFrame, keys: list[str], scale: Scale = UNKNOWN) -> DataFrame:
    """n, median, mean, mad, minimum, maximum per (key, arm)."""
    return robust_summary(units, [*keys, "arm"], "value", scale).select(
        *keys, "arm", F.col("n_values").alias("n"), "median", "mean", "mad", "minimum", "maximum")


def adjust_p_values(
    results: DataFrame, family: str, p_value: str, index: str, method: str, alpha: float, scale: Scale = UNKNOWN
) -> DataFrame:
    """Multiple-comparison adjustment within each family, ties broken by ``index``.

    The family size counts every declared member, also those without a p-value. Holm is a
    running maximum in ascending order of p, Benjamini-Hochberg a running minimum in
    descending order.
    """
    if method not in ("none", "holm_bonferroni", "benjamini_hochberg"):
        raise ValueError(f"unknown correction {method!r}")
    p = F.col(p_value)
    if scale.fits:
        # Family size, ranks and running bound share one partitioning and one order.
        whole = Window.partitionBy(family)
        ordered = whole.orderBy(p.asc_nulls_last(), index)
        rank = F.row_number().over(ordered) - 1
        numbered = results.withColumn("_m", F.count(F.lit(1)).over(whole)).withColumn("_rank", F.when(p.isNotNull(), rank))
        if method == "none":
            adjusted = F.least(F.lit(1.0), p)
        elif method == "holm_bonferroni":
            adjusted = F.max("_step").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        else:
            adjusted = F.min("_step").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        step = (F.col("_m") - F.col("_rank")) * p if method == "holm_bonferroni" else F.col("_m") / (F.col("_rank") + 1) * p
        out = numbered.withColumn("_step", F.when(p.isNotNull(), F.least(F.lit(1.0), step))) \
            .withColumn("adjusted_p_value", F.when(p.isNotNull(), adjusted)).drop("_m", "_rank", "_step")
        return out.withColumn("rejected", F.coalesce(F.col("adjusted_p_value") <= alpha, F.lit(False)))
    size = results.groupBy(family).agg(F.count(F.lit(1)).alias("_m"))
    known = lookup_join(results.filter(p.isNotNull()), size, [family], "inner", [F.col(index)], scale)
    if method == "none":
        adjusted = known.withColumn("adjusted_p_value", F.least(F.lit(1.0), p))
    else:
        ranked = position_in(known, [family], [p_value, index], "_rank", scale)
        if method == "holm_bonferroni":
            step, place, sign = F.least(F.lit(1.0), (F.col("_m") - F.col("_rank")) * p), F.col("_rank"), 1
        else:
            step, place, sign = F.least(F.lit(1.0), F.col("_m") / (F.col("_rank") + 1) * p), -F.col("_rank"), -1
        held = ranked.withColumn("_step", step * sign).withColumn("_place", place)
        # Slots of ranks hold equally many rows, wherever the p-values pile up.
        slot = F.floor(F.col("_place") / scale.rows_per_task)
        seen = ordered_scan(held, [family], ["_place"], slot, {"_bound": ("max", F.col("_step"))}, scale)
        adjusted = seen.withColumn("adjusted_p_value", F.greatest("_step", "_bound") * sign)
    back = adjusted.select(family, index, "adjusted_p_value")
    return results.join(back, [family, index], "left").withColumn(
        "rejected", F.coalesce(F.col("adjusted_p_value") <= alpha, F.lit(False)))


def practical(estimate: Column, threshold: float, directionality: str, lower: Column, upper: Column,
              reference: float = 0.0) -> dict[str, Column]:
    """Practical significance: magnitude, direction and whether the interval leaves out no-effect.

    ``reference`` is the value of no effect: 1 for a ratio, otherwise 0.
    """
    direction = {"increase_is_improvement": estimate > reference, "decrease_is_improvement": estimate < reference}
    return {
        "estimate_exceeds_threshold": F.abs(estimate - reference) >= threshold,
        "direction_matches_hypothesis": direction.get(directionality, F.lit(None).cast("boolean")),
        "interval_excludes_no_effect": ~((lower <= reference) & (upper >= reference)),
    }


def pair_order(pairs: DataFrame, keys: list[str], scale: Scale = UNKNOWN) -> DataFrame:
    """0-based place of each pair within its comparison, by pair id."""
    return position_in(pairs, keys, ["pair_id"], "pair_index", scale)
