"""Typed cells beside what is wrong with their row, so that one read gives records and refusals.

``with_problems`` adds an array of codes: ``<column>.unparsable`` for a cell that is not of its type,
``<column>.missing`` for an empty one that must not be, ``row.width`` for a line with too few or too
many cells, and the names of the rules that a row breaks. ``accepted`` refuses the whole input at the
first such row, in the same pass; ``set_apart`` gives the clean rows and a table of refusals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.functions.cells import bad_cell, signed
from stintwise.operators.normalize import ColumnMapping
from stintwise.operators.spread import UNKNOWN, Scale, lookup_join, ordered_scan, settle

CORRUPT = "_corrupt"


def with_problems(rows: DataFrame, typed: dict[str, Column], required: set[str] = frozenset(), rules: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with the columns of ``typed`` parsed and ``problems``. A rule is a condition over the parsed columns
    that holds for a good row; an unknown one passes."""
    codes = []
    for name, parsed in typed.items():
        text = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        codes.append(F.when((text != "") & parsed.isNull(), F.lit(f"{name}.unparsable")))
        if name in required:
            codes.append(F.when(text == "", F.lit(f"{name}.missing")))
    others = [F.col(f"`{c}`") for c in rows.columns if c not in typed]
    cells = rows.select(*others, *[parsed.alias(name) for name, parsed in typed.items()], F.array_compact(F.array(*codes)).alias("problems"))
    broken = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(code)) for code, ok in (rules or {}).items()]
    if broken:
        cells = cells.withColumn("problems", F.concat("problems", F.array_compact(F.array(*broken))))
    if CORRUPT in rows.columns:
        # A row of the wrong width has no cells to speak of.
        cells = cells.withColumn("problems", F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("row.width"))).otherwise(F.col("problems")))
    return cells


def accepted(rows: DataFrame, what: str) -> DataFrame:
    """The rows without ``problems``; a row that has any fails the job that reads it, with its codes."""
    message = F.concat(F.lit(f"{what}: "), F.array_join("problems", ", "))
    return rows.where(F.when(F.size("problems") == 0, True).otherwise(F.raise_error(message).cast("boolean"))).drop("problems", CORRUPT)


def set_apart(rows: DataFrame, subject: list[str]) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and (subject, problem) of the others."""
    return (rows.where(F.size("problems") == 0).drop("problems", CORRUPT),
            rows.select(*subject, F.explode("problems").alias("problem")))


def mapped_problems(rows: DataFrame, mappings: list[ColumnMapping], lap_column: str, keys: list[str], scale: Scale = UNKNOWN) -> DataFrame:
    """Text rows of mapped files (``keys`` and ``row_index`` say where a row stands) with ``problems``.

    Cells that do not parse as their concept, and laps: ``lap.unparsable`` (also when empty), ``lap.negative``,
    ``lap.reappears`` for all rows of a run of a lap that an earlier run has had, ``lap.regressed`` for a run
    of a smaller number than the one before. Rows without a readable lap do not end a run.
    """
    number = signed(F.trim(F.col(f"`{lap_column}`"))).cast("int")
    codes = [F.when(bad_cell(F.col(f"`{m.column}`"), m.concept), F.lit(f"{m.column}.unparsable")) for m in mappings]
    codes += [F.when(number.isNull(), F.lit("lap.unparsable")), F.when(number < 0, F.lit("lap.negative"))]
    if CORRUPT in rows.columns:
        codes.insert(0, F.when(F.col(CORRUPT).isNotNull(), F.lit("row.width")))
    # Generated columns: conditions on the lap stay above the parsing of the cells instead of repeating it.
    own = settle(rows.select("*", F.inline(F.array(F.struct(number.alias("_lap"), F.array_compact(F.array(*codes)).alias("_codes"))))), scale)
    slot = F.floor(F.col("row_index") / 4096)
    own = ordered_scan(own, keys, ["row_index"], slot, {"_before": ("last", F.col("_lap"))}, scale)
    first = own.where("_lap is not null").groupBy(*keys, "_lap").agg(F.min("row_index").alias("_first"))
    own = lookup_join(own, first, [*keys, "_lap"], "left", [F.col("row_index")], scale)
    begins = F.col("_lap").isNotNull() & ~F.col("_lap").eqNullSafe(F.col("_before"))
    fault = F.when(begins, F.when(F.col("_first") < F.col("row_index"), "lap.reappears").when(F.col("_lap") < F.col("_before"), "lap.regressed")
                   .otherwise(""))
    own = ordered_scan(own.withColumn("_fault", fault), keys, ["row_index"], slot, {"_run": ("last", F.col("_fault"))}, scale)
    fault = F.when(F.col("_lap").isNotNull(), F.coalesce("_fault", "_run"))
    return own.select(*rows.columns, F.concat("_codes", F.when(fault != "", F.array(fault)).otherwise(F.array().cast("array<string>"))).alias("problems"))
