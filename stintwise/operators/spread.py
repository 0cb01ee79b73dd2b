"""Work that must not put one heavy key into one task.

Building blocks used all over the library:

* ``lookup_join``      joins rows to a per-key table, salting only the heavy keys;
* ``ordered_scan``     "what came before this row" (previous value, running sum, running
                       maximum) when a single key may hold a large share of all rows;
* ``split_cumulative`` cumulative weights in value order, from which exact ranks, medians
                       and quantiles follow, with heavy keys cut into value ranges.

Each takes a ``Scale``. When the whole input is known to be no larger than what one task
may hold, no key can be heavy and the plain Spark form (join, window, percentile) is used;
otherwise, and whenever the size is unknown, the divided form is.

All cuts are functions of the data alone (counts, slots, hashes), never of partition ids
or samples, so a recomputed task after a lost executor gives the same answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintwise.session import cut_lineage


@dataclass(frozen=True)
class Scale:
    """An upper bound on the rows of an input and the most rows one task should hold."""

    rows: int | None = None
    rows_per_task: int = 5_000_000

    @property
    def fits(self) -> bool:
        """True when even a single key holding every row would fit in one task."""
        return self.rows is not None and self.rows <= self.rows_per_task

    def times(self, factor: int) -> "Scale":
        """The bound for a derived input with up to ``factor`` rows per row."""
        return Scale(None if self.rows is None else self.rows * factor, self.rows_per_task)


UNKNOWN = Scale()


def by_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on ``keys`` with null equal to null, so that a null group is a group like any other.

    ``small`` broadcasts the right side; it is for tables whose size the limit bounds.
    """
    # Structs of equal fields are equal, nulls included, and such a key can be hashed and sorted.
    key = F.struct(*keys)
    others = right.select(key.alias("_key"), *[c for c in right.columns if c not in keys])
    return left.withColumn("_key", key).join(F.broadcast(others) if small else others, "_key", how).drop("_key")


def settle(df: DataFrame, scale: Scale) -> DataFrame:
    """End of a stage: beyond one task's worth of rows, write the result to the shared
    checkpoint folder so that the many readers after it do not redo the work before it."""
    return df if scale.fits else cut_lineage(df)


def fan_out(df: DataFrame, scale: Scale, *by: str) -> DataFrame:
    """Deal a small input over all cores, by the hash of ``by``, before row-heavy work.

    A small file is often a single row group, hence a single task. Large inputs already come
    in many pieces and are left alone.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *by) if scale.fits else df


def deal(df: DataFrame, rows: int, scale: Scale, *by: str) -> DataFrame:
    """Partitions by the hash of ``by`` that get a quarter of a task's rows on average.

    Partitions of a plain shuffle are merged up to a size in compressed bytes, of which well
    compressed rows need many; a number that follows the rows is left as it is.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-4 * rows // scale.rows_per_task))
    return df.repartition(parts, *by)


def heavy_keys(df: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """Keys above the limit and the number of pieces each needs.

    The result has at most ``rows / rows_per_task`` rows, which is what makes
    broadcasting it safe at any scale.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rows_per_task)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_pieces"))
    )


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    spread: list[Column] | None = None,
    scale: Scale = UNKNOWN,
    rows: int | None = None,
) -> DataFrame:
    """Join ``facts`` to ``table`` on ``on``; rows of heavy fact keys are dealt over pieces.

    ``spread`` are columns that differ between rows of one key (an id); the matching rows
    of ``table`` are repeated once per piece, for heavy keys only. Where the ``rows`` of both
    together are known, the join's partitions follow them.
    """
    if scale.fits:
        return facts.join(table, on, how)
    heavy = heavy_keys(facts, on, scale.rows_per_task)
    mix = F.xxhash64(*(spread or [F.col(c) for c in facts.columns if c not in on]))
    left = (
        by_key(facts, heavy, on, "left", small=True)
        .withColumn("_piece", F.when(F.col("_pieces").isNull(), F.lit(0)).otherwise(
            F.pmod(mix, F.col("_pieces").cast("long")).cast("int")))
        .drop("_pieces")
    )
    right = (
        by_key(table, heavy, on, "left", small=True)
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)))
        .drop("_pieces")
    )
    if rows is not None:
        left, right = (deal(side, rows, scale, *on, "_piece") for side in (left, right))
    return left.join(right, [*on, "_piece"], how).drop("_piece")


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slot: Column,
    carry: dict[str, tuple[str, Column]],
    scale: Scale = UNKNOWN,
) -> DataFrame:
    """Add, for each entry of ``carry``, a value taken over the *earlier* rows of the key.

    ``carry`` maps an output name to (kind, expression) with kind one of ``last`` (last
    non-null), ``previous`` (the row before, null or not), ``max``, ``sum``. ``slot`` is a
    non-decreasing function of the first order column; where it is null, the rows come first,
    as null does in the order. Keys under the limit are one window;
    a heavier key is scanned slot by slot and each slot starts from what the slots before it
    left behind, so no task holds more than one slot of one key.
    """
    if scale.fits:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        simple = {
            "last": lambda e: F.last(e, ignorenulls=True).over(w),
            "previous": lambda e: F.last(F.struct(e.alias("v")), ignorenulls=True).over(w)["v"],
            "max": lambda e: F.max(e).over(w),
            "sum": lambda e: F.sum(e).over(w),
        }
        return df.select("*", *[simple[kind](e).alias(name) for name, (kind, e) in carry.items()])
    heavy = heavy_keys(df, keys, scale.rows_per_task)
    first_slot = F.lit(-(2 ** 63)).cast("long")
    tagged = (
        by_key(df, heavy, keys, "left", small=True)
        .withColumn("_slot", F.when(F.col("_pieces").isNotNull(), F.coalesce(slot.cast("long"), first_slot)))
        .drop("_pieces")
    )
    rank = F.struct(*order)
    before = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier_slots = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)

    local, summary, prefix = {}, [], []
    for name, (kind, expr) in carry.items():
        value = F.struct(expr.alias("v")) if kind == "previous" else expr
        if kind in ("last", "previous"):
            local[name] = F.last(value, ignorenulls=True).over(before)
            summary.append(F.max_by(value, F.when(value.isNotNull(), rank)).alias(f"_at_{name}"))
            prefix.append(F.last(f"_at_{name}", ignorenulls=True).over(earlier_slots).alias(f"_in_{name}"))
        elif kind == "max":
            local[name] = F.max(value).over(before)
            summary.append(F.max(value).alias(f"_at_{name}"))
            prefix.append(F.max(f"_at_{name}").over(earlier_slots).alias(f"_in_{name}"))
        elif kind == "sum":
            local[name] = F.sum(value).over(before)
            summary.append(F.sum(value).alias(f"_at_{name}"))
            prefix.append(F.sum(f"_at_{name}").over(earlier_slots).alias(f"_in_{name}"))
        else:
            raise ValueError(f"unknown carry kind {kind!r}")

    incoming = (
        tagged.filter(F.col("_slot").isNotNull())
        .groupBy(*keys, "_slot").agg(*summary)
        .select(*keys, "_slot", *prefix)
    )
    out = tagged.select("*", *[c.alias(f"_lo_{n}") for n, c in local.items()])
    out = by_key(out, incoming, [*keys, "_slot"], "left")
    final = []
    for name, (kind, _) in carry.items():
        here, there = F.col(f"_lo_{name}"), F.col(f"_in_{name}")
        if kind == "previous":
            final.append(F.coalesce(here, there)["v"].alias(name))
        elif kind == "last":
            final.append(F.coalesce(here, there).alias(name))
        elif kind == "max":
            final.append(F.greatest(here, there).alias(name))
        else:
            final.append(F.when(here.isNull() & there.isNull(), None)
                         .otherwise(F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))).alias(name))
    return out.select(*df.columns, *final)


def split_cumulative(
    hist: DataFrame,
    keys: list[str],
    value: str,
    weights: list[str],
    scale: Scale = UNKNOWN,
    null_keys: bool = True,
) -> DataFrame:
    """Add ``<w>_before`` (sum over smaller values of the key) and ``<w>_total`` per weight.

    ``hist`` holds one row per (keys, value). Each value becomes a cut point with
    probability 4 / scale.rows_per_task, decided by its hash: small keys get none and stay whole,
    a heavy key is divided into ranges of about a quarter of the limit. The cut table
    therefore has about 4 * rows / rows_per_task entries and is broadcast. Where the keys hold
    no null, ``null_keys=False`` lets the joins be plain ones.
    """
    if scale.fits:
        whole = Window.partitionBy(*keys)
        running = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return hist.select(
            "*", *[F.coalesce(F.sum(w).over(running), F.lit(0)).alias(f"{w}_before") for w in weights],
            *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights])
    step = max(1, scale.rows_per_task // 4)
    cuts = (
        hist.filter(F.pmod(F.xxhash64(F.col(value), *keys), F.lit(step)) == 0)
        .groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_cuts"))
        .withColumn("_stride", F.ceil(F.sqrt(F.size("_cuts"))).cast("int"))
        .withColumn("_heads", F.expr("transform(sequence(0, size(_cuts) - 1, _stride), i -> _cuts[i])"))
    )
    v = F.col(value)
    block = F.size(F.filter("_heads", lambda h: h <= v))
    inner = F.size(F.filter(
        F.slice("_cuts", (F.col("_block") - 1) * F.col("_stride") + 1, F.col("_stride")), lambda h: h <= v))
    ranged = (
        (by_key(hist, cuts, keys, "left", small=True) if null_keys else hist.join(F.broadcast(cuts), keys, "left"))
        .withColumn("_block", F.when(F.col("_cuts").isNotNull(), block))
        .withColumn("_range", F.when(F.col("_block").isNull() | (F.col("_block") == 0), F.lit(0))
                    .otherwise((F.col("_block") - 1) * F.col("_stride") + inner))
        .withColumn("_cut", F.col("_cuts").isNotNull())
        .select(*hist.columns, "_range", "_cut")
    )
    by_range = Window.partitionBy(*keys).orderBy("_range")
    whole = Window.partitionBy(*keys)
    offsets = (
        ranged.filter("_cut").groupBy(*keys, "_range")
        .agg(*[F.sum(w).alias(f"_r_{w}") for w in weights])
        .select(*keys, "_range",
                *[F.coalesce(F.sum(f"_r_{w}").over(by_range.rowsBetween(Window.unboundedPreceding, -1)),
                             F.lit(0)).alias(f"_o_{w}") for w in weights],
                *[F.sum(f"_r_{w}").over(whole).alias(f"_t_{w}") for w in weights])
    )
    piece = Window.partitionBy(*keys, "_range")
    running = piece.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.select(
        *hist.columns, "_range",
        *[F.coalesce(F.sum(w).over(running), F.lit(0)).alias(f"_b_{w}") for w in weights],
        *[F.sum(w).over(piece).alias(f"_p_{w}") for w in weights])
    out = by_key(within, offsets, [*keys, "_range"], "left", small=True) if null_keys else within.join(
        F.broadcast(offsets), [*keys, "_range"], "left")
    return out.select(
        *hist.columns,
        *[(F.col(f"_b_{w}") + F.coalesce(F.col(f"_o_{w}"), F.lit(0))).alias(f"{w}_before") for w in weights],
        *[F.coalesce(F.col(f"_t_{w}"), F.col(f"_p_{w}")).alias(f"{w}_total") for w in weights],
    )


def position_in(
    df: DataFrame, keys: list[str], order: list[str], name: str, scale: Scale = UNKNOWN
) -> DataFrame:
    """0-based place of each row within its key by ``order`` (which must be unique in the key)."""
    if scale.fits:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    return (
        split_cumulative(df.withColumn("_order", F.struct(*order)).withColumn("_one", F.lit(1).cast("long")),
                         keys, "_order", ["_one"], scale)
        .withColumnRenamed("_one_before", name)
        .drop("_order", "_one", "_one_total")
    )


def literal_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small constant table (``columns`` is a DDL string) whose size the optimizer knows."""
    names = [c.split()[0] for c in columns.split(",")]
    types = [c.split()[1] for c in columns.split(",")]
    cells = [F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, types)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))
