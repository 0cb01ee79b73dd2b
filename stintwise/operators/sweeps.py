"""Ranges against positions by one ordered sweep instead of a join of every range with every position.

The ends of the ranges are sorted among the positions, and running sums over that order say what
lies in a range: the sum at its end less the sum at its start. Work grows with positions plus
ranges; a key that holds very many positions is swept slot by slot (``ordered_scan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.operators.audit import violations
from stintwise.operators.spread import UNKNOWN, Scale, by_key, deal, heavy_keys, lookup_join, ordered_scan
from stintwise.session import stored_table

#: Fixed value: declared coverage is given to three decimals.
COVERAGE_TOLERANCE = 0.0005
SLOT = 4096


def region_coverage(bins: DataFrame, regions: DataFrame, comparison: DataFrame, session_key: str, lap: str, at: str,
                    scale: Scale = UNKNOWN) -> DataFrame:
    """Smallest share of sampled bins over the comparison laps for each region, against the declared coverage.

    ``regions``: session, finding_key, start, end (both included) and declared coverage, or null. ``comparison``:
    session and lap. A comparison lap without any bin of the region counts as a share of zero. Problems:
    no_comparison_lap, absent_on_lap, coverage_mismatch.
    """
    laps, size = comparison.select(session_key, lap).distinct(), None
    if not scale.fits:
        laps, regions = stored_table(laps, "laps"), stored_table(regions.select(session_key, "finding_key", "start", "end", "coverage"), "regions")
        size = laps.count() + regions.count()
    wanted = lookup_join(laps, regions.select(session_key, "finding_key", "start", "end"), [session_key], "inner", [F.col(lap)], scale, size)
    edges = wanted.select("*", F.inline(F.array(*[
        F.struct(F.col(column).cast("double").alias("_pos"), F.lit(kind).alias("_kind")) for kind, column in ((0, "start"), (2, "end"))])),
        F.lit(0).alias("_one"), F.lit(0).alias("_seen"))
    nothing = {"finding_key": F.lit(None).cast(regions.schema["finding_key"].dataType),
               **{c: F.lit(None).cast(regions.schema[c].dataType) for c in ("start", "end")}}
    # Laps without edges add nothing; beyond one task's rows they go along, as a join would sort all bins to leave them out.
    known = bins.where(F.col(session_key).isNotNull() & F.col(lap).isNotNull())
    steps = (known.join(laps, [session_key, lap], "left_semi") if scale.fits else known).select(
        session_key, lap, F.col(at).cast("double").alias("_pos"), F.lit(1).alias("_kind"), *[v.alias(k) for k, v in nothing.items()],
        F.lit(1).alias("_one"), F.col("has_sample").cast("int").alias("_seen"))
    swept = _running_totals(steps.unionByName(edges), [session_key, lap], scale)

    def inside(running: str) -> Column:
        # A region that is declared twice has its edges twice, with the same sums.
        first, last = (F.max(F.when(F.col("_kind") == kind, F.coalesce(running, F.lit(0)))) for kind in (0, 2))
        return (last - first).alias(running)

    per_lap = swept.where("_kind <> 1").groupBy(session_key, lap, "finding_key", "start", "end").agg(inside("total"), inside("seen"))
    share = F.when(F.col("total") > 0, F.col("seen") / F.col("total")).otherwise(0.0)
    found = per_lap.groupBy(session_key, "finding_key", "start", "end").agg(
        F.min(share).alias("coverage"), F.count(F.lit(1)).alias("laps"), F.count_if(F.col("total") <= 0).alias("absent"))
    rows = by_key(regions.select(session_key, "finding_key", "start", "end", F.col("coverage").alias("declared")), found,
                  [session_key, "finding_key", "start", "end"], "left")
    return rows.select(session_key, "finding_key", "start", "end", "declared", "coverage", F.coalesce("laps", F.lit(0)).alias("laps"),
                       F.coalesce("absent", F.lit(0)).alias("absent"),
                       F.when(F.col("laps").isNull(), "no_comparison_lap").when(F.col("absent") > 0, "absent_on_lap").when(
                           F.abs(F.col("declared") - F.col("coverage")) > COVERAGE_TOLERANCE, "coverage_mismatch").alias("problem"))


def _running_totals(rows: DataFrame, keys: list[str], scale: Scale) -> DataFrame:
    """Bins (``total``) and sampled bins (``seen``) before each row of its key.

    Beyond one task's rows they are written once and dealt by their number; only keys above
    the limit are swept slot by slot.
    """
    def scan(part: DataFrame, size: Scale) -> DataFrame:
        return ordered_scan(part, keys, ["_pos", "_kind", "finding_key"], F.floor(F.col("_pos") / SLOT),
                            {"total": ("sum", F.col("_one")), "seen": ("sum", F.col("_seen"))}, size)

    if scale.fits:
        return scan(rows, scale)
    rows = stored_table(rows, "sweep")
    heavy = heavy_keys(rows, keys, scale.rows_per_task)
    whole = Scale(0, scale.rows_per_task)
    if heavy.isEmpty():
        return scan(deal(rows, rows.count(), scale, *keys), whole)
    tagged = by_key(rows, heavy, keys, "left", small=True)
    light, large = (tagged.where(f"_pieces is {what}").drop("_pieces") for what in ("null", "not null"))
    return scan(deal(light, rows.count(), scale, *keys), whole).unionByName(scan(large, Scale(None, scale.rows_per_task)))


def bind_blocks(laps: DataFrame, blocks: DataFrame, keys: list[str], lap_number: str, scale: Scale = UNKNOWN) -> DataFrame:
    """The declared block that holds each lap: keys, lap, rows, blocks, block, problem.

    ``blocks``: keys, block, start_lap, end_lap. The number of open blocks runs along, and so does the sum of
    their numbers, which names the block where one is open. Problems: duplicate_lap, no_block, several_blocks.
    """
    numbers = Window.partitionBy(*keys).orderBy("start_lap", "end_lap", "block")
    declared = blocks.where("start_lap <= end_lap").select(*keys, "block", "start_lap", "end_lap", F.row_number().over(numbers).cast("long").alias("_id"))

    def ends(column: str, kind: int, sign: int) -> DataFrame:
        return declared.select(*keys, F.expr(column).cast("long").alias("_pos"), F.lit(kind).alias("_kind"), F.lit(0).cast("long").alias("rows"),
                               F.lit(sign).alias("_open"), (F.col("_id") * sign).alias("_number"))

    driven = laps.groupBy(*keys, lap_number).agg(F.count(F.lit(1)).alias("rows")).select(
        *keys, F.col(lap_number).cast("long").alias("_pos"), F.lit(2).alias("_kind"), "rows", F.lit(0).alias("_open"), F.lit(0).cast("long").alias("_number"))
    swept = ordered_scan(driven.unionByName(ends("start_lap", 1, 1)).unionByName(ends("end_lap + 1", 0, -1)), keys, ["_pos", "_kind", "_number"],
                         F.floor(F.col("_pos") / SLOT), {"blocks": ("sum", F.col("_open")), "_id": ("sum", F.col("_number"))}, scale)
    held = swept.where("_kind = 2").select(*keys, F.col("_pos").cast(laps.schema[lap_number].dataType).alias(lap_number), "rows",
                                          F.coalesce("blocks", F.lit(0)).alias("blocks"), F.when(F.col("blocks") == 1, F.col("_id")).alias("_id"))
    return by_key(held, declared.select(*keys, "_id", "block"), [*keys, "_id"], "left").select(
        *keys, lap_number, "rows", "blocks", "block", F.when(F.col("rows") > 1, "duplicate_lap").when(F.col("blocks") == 0, "no_block").when(
            F.col("blocks") > 1, "several_blocks").alias("problem"))


def block_rules(blocks: DataFrame, keys: list[str], scale: Scale = UNKNOWN) -> DataFrame:
    """Declared blocks that break a rule: range (ends before it starts), start (negative), duplicate (of its id),
    overlap (starts before an earlier one has ended), gap (laps between it and all earlier ones are in no block)."""
    single = violations(blocks, {"range": F.col("start_lap") <= F.col("end_lap"), "start": F.col("start_lap") >= 0}, [*keys, "block"])
    repeated = blocks.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, "block", F.lit("duplicate").alias("rule"))
    swept = ordered_scan(blocks.where("start_lap <= end_lap").select(*keys, "block", "start_lap", "end_lap"), keys, ["start_lap", "end_lap", "block"],
                         F.floor(F.col("start_lap") / SLOT), {"_reach": ("max", F.col("end_lap"))}, scale)
    order = violations(swept, {"overlap": F.col("_reach") < F.col("start_lap"), "gap": F.col("_reach") >= F.col("start_lap") - 1}, [*keys, "block"])
    return single.unionByName(repeated).unionByName(order)


def assignment_rules(assignments: DataFrame, blocks: DataFrame, laps: DataFrame, keys: list[str], lap_number: str) -> DataFrame:
    """Assignments (keys, lap, block) that break a rule: duplicate_assignment, unknown_block, absent_lap, outside_block."""
    once = assignments.groupBy(*keys, lap_number).agg(F.count(F.lit(1)).alias("_n"), F.min("block").alias("_least"), F.max("block").alias("_most"))
    declared = blocks.groupBy(*keys, "block").agg(F.min("start_lap").alias("_start"), F.max("end_lap").alias("_end"))
    driven = laps.select(*keys, lap_number).distinct().withColumn("_driven", F.lit(True))
    twice = once.where("_n > 1").select(*keys, lap_number, F.lit("duplicate_assignment").alias("rule"))
    rows = by_key(by_key(assignments.select(*keys, lap_number, "block").distinct(), declared, [*keys, "block"], "left"), driven, [*keys, lap_number], "left")
    known = F.col("_start").isNotNull()
    return twice.unionByName(violations(rows, {
        "unknown_block": known, "absent_lap": F.col("_driven").isNotNull(),
        "outside_block": ~known | F.col(lap_number).between(F.col("_start"), F.col("_end"))}, [*keys, lap_number]).distinct())


def identity_rules(collected: DataFrame, observed: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Collections whose identity (``names``) is not that of the session they name: <name>_mismatch, or unknown_session."""
    seen = observed.select(*keys, *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_seen"))
    known = F.col("_seen").isNotNull()
    return violations(by_key(collected.select(*keys, *names), seen, keys, "left"), {
        "unknown_session": known, **{f"{n}_mismatch": ~known | F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names}}, keys)
