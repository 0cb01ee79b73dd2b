"""Exact order statistics, medians, quartiles and MAD for groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.operators.spread import UNKNOWN, Scale, by_key, lookup_join, settle, split_cumulative


def histogram(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """One row per (keys, value) with its multiplicity ``w``; null values are left out."""
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(counted.alias("w"))


def order_statistics(
    hist: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    scale: Scale = UNKNOWN,
) -> DataFrame:
    """Values at given 0-based ranks per key, plus the group size ``n``.

    ``ranks`` maps an output name to a function of the group size; a rank outside the
    group gives null.
    """
    ranked = split_cumulative(hist, keys, value, ["w"], scale)
    first, last = F.col("w_before"), F.col("w_before") + F.col("w") - 1
    n = F.col("w_total")
    hits = {name: (rule(n) >= first) & (rule(n) <= last) for name, rule in ranks.items()}
    return ranked.groupBy(*keys).agg(
        F.max("w_total").alias("n"),
        *[F.max(F.when(hit, F.col(value))).alias(name) for name, hit in hits.items()],
    )


def quantiles(
    hist: DataFrame, keys: list[str], value: str, probs: dict[str, float], scale: Scale = UNKNOWN
) -> DataFrame:
    """Inclusive (linearly interpolated) quantiles per key of a histogram, exact."""
    if scale.fits:
        return hist.groupBy(*keys).agg(
            F.sum("w").alias("n"),
            *[F.percentile(value, F.lit(p), F.col("w")).alias(name) for name, p in probs.items()])
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"_hi_{name}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    stats = order_statistics(hist, keys, value, ranks, scale)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        share = (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
        out.append((lo + (hi - lo) * share).alias(name))
    return stats.select(*keys, "n", *out)


def sorted_quantile(values: Column, p: float) -> Column:
    """Inclusive quantile of a sorted array column; null when empty."""
    at = (F.size(values) - 1) * F.lit(p)
    lo = F.try_element_at(values, F.floor(at).cast("int") + 1)
    hi = F.try_element_at(values, F.ceil(at).cast("int") + 1)
    return F.when(F.size(values) > 0, lo + (hi - lo) * (at - F.floor(at)))


def sorted_median(values: Column) -> Column:
    """Median of a sorted array column, the mean of the middle two for an even size."""
    n = F.size(values)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.element_at(values, lo) + F.element_at(values, hi)) / 2)


def _gathered(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sorted values per key as an array; only for inputs that fit in one task as a whole."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_vs"))


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median", scale: Scale = UNKNOWN) -> DataFrame:
    """Exact median and count ``n`` of the non-null values per key."""
    if scale.fits:
        return _gathered(df, keys, value).select(
            *keys, F.size("_vs").cast("long").alias("n"), sorted_median(F.col("_vs")).alias(name))
    return quantiles(histogram(df, keys, value), keys, value, {name: 0.5}, scale)


def array_mad(values: Column, centre: Column) -> Column:
    """Median absolute deviation of an array column around a centre."""
    return sorted_median(F.sort_array(F.transform(values, lambda x: F.abs(x - centre))))


def mad(df: DataFrame, keys: list[str], value: str, scale: Scale = UNKNOWN) -> DataFrame:
    """Median, unscaled median absolute deviation and ``n`` per key."""
    if scale.fits:
        held = _gathered(df, keys, value)
        return held.withColumn("median", sorted_median(F.col("_vs"))).select(
            *keys, F.size("_vs").cast("long").alias("n"), "median", array_mad(F.col("_vs"), F.col("median")).alias("mad"))
    hist = settle(histogram(df, keys, value), scale)
    centre = settle(quantiles(hist, keys, value, {"median": 0.5}, scale), scale)
    return by_key(centre, deviations(hist, keys, value, centre, "median", scale), keys)


def deviations(hist: DataFrame, keys: list[str], value: str, centre: DataFrame, centre_name: str,
               scale: Scale = UNKNOWN) -> DataFrame:
    """MAD of a histogram around a given per-key centre."""
    # A null key is joined under a mark of its own, so that it too may be split.
    marks = [f"_mark_{k}" for k in keys]
    marked = [F.struct(F.col(k)).alias(m) for k, m in zip(keys, marks)]
    away = (
        lookup_join(hist.select("*", *marked), centre.select(*marked, centre_name), marks, "inner", [F.col(value)], scale)
        .withColumn("_away", F.abs(F.col(value) - F.col(centre_name)))
        .groupBy(*keys, "_away").agg(F.sum("w").alias("w"))
    )
    return quantiles(settle(away, scale), keys, "_away", {"mad": 0.5}, scale).drop("n")


def robust_summary(df: DataFrame, keys: list[str], value: str, scale: Scale = UNKNOWN) -> DataFrame:
    """n_values, minimum, maximum, mean, median, q1, q3, mad per key over the non-null values."""
    if scale.fits:
        vs = F.col("_vs")
        held = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
            F.avg(value).alias("mean"), F.sort_array(F.collect_list(value)).alias("_vs"))
        return held.withColumn("median", sorted_median(vs)).select(
            *keys, F.size(vs).cast("long").alias("n_values"), F.element_at(vs, 1).alias("minimum"),
            F.element_at(vs, -1).alias("maximum"), "mean", "median", sorted_quantile(vs, 0.25).alias("q1"),
            sorted_quantile(vs, 0.75).alias("q3"), array_mad(vs, F.col("median")).alias("mad"))
    return histogram_summary(settle(histogram(df, keys, value), scale), keys, value, scale)


def histogram_summary(hist: DataFrame, keys: list[str], value: str, scale: Scale = UNKNOWN) -> DataFrame:
    """As ``robust_summary``, of a histogram (keys, value, w), which is read more than once."""
    plain = hist.groupBy(*keys).agg(
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
        (F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("mean"))
    cut = settle(quantiles(hist, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, scale), scale)
    return (
        by_key(by_key(cut.withColumnRenamed("n", "n_values"), plain, keys),
               deviations(hist, keys, value, cut, "median", scale), keys)
        .select(*keys, "n_values", "minimum", "maximum", "mean", "median", "q1", "q3", "mad")
    )
