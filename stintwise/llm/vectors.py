"""What both vector searches share: usable vectors, equal vectors as one, merged results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(rows: DataFrame, zero: bool = True) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows whose vectors take part.

    Not those with a null id, a null vector, a null or non-finite component and, unless
    ``zero``, no component other than zero. Minus zero becomes zero.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    if not zero:
        kept = kept.where(F.exists("embedding", lambda x: x != 0))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"))


def collapsed(rows: DataFrame, value: str, keep: int, total: int, ids_per_group: int = 50_000) -> DataFrame:
    """One row per distinct vector with its ``keep`` smallest ids, in order.

    No more than ``keep`` of equal vectors can be among the results of a query. A vector that
    many rows share is first reduced in groups of its ids, so that no group is unbounded.
    """
    groups = max(1, -(-total // ids_per_group))
    first = rows.groupBy(value, F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("part")) \
        .agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, keep).alias("ids"))
    if groups == 1:
        return first.select(value, "ids")
    return first.groupBy(value).agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
                                    .alias("ids"))


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of every query over all shards, ties to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
