"""Several descriptive computations over one scan of the records.

Every computation says which lines a record adds to it: a level, a group, a name, a provenance
and a value. All lines go through one aggregation that counts equal ones, combined before the
shuffle, so the records are read once and no group is gathered. The counts are written once;
totals, provenance counts and exact quantiles of all computations follow from them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.operators.quantiles import histogram_summary
from stintwise.operators.spread import UNKNOWN, Scale, by_key, literal_table
from stintwise.session import cut_lineage
from stintwise.vocabulary import CONCEPT_UNITS, PROVENANCES

INVENTORY, AVAILABILITY, SUMMARY, YIELD = "record_inventory", "concept_availability", "descriptive_summary", "event_yield"
KINDS = (INVENTORY, AVAILABILITY, SUMMARY, YIELD)
KEYS = ["computation", "level", "group", "name"]
STATISTICS = ("minimum", "maximum", "mean", "median", "q1", "q3", "mad")
LINE = "struct<level:string,group:string,name:string,provenance:string,value:double>"


@dataclass(frozen=True)
class Computation:
    """One computation; ``record_type`` None means every record, ``group_by`` None one group for all."""

    name: str
    kind: str
    record_type: str | None = None
    concept: str | None = None
    group_by: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"computation {self.name!r} has an unknown kind {self.kind!r}")
        if (self.kind == SUMMARY) != (self.concept is not None):
            raise ValueError(f"computation {self.name!r}: a summary, and nothing else, names a concept")
        if self.concept is not None and self.concept not in CONCEPT_UNITS:
            raise ValueError(f"computation {self.name!r} names an unknown concept {self.concept!r}")
        if self.group_by is not None and self.kind != SUMMARY:
            raise ValueError(f"computation {self.name!r}: only a summary has groups of its own")


def _line(level: str, group: Column | None = None, name: Column | None = None,
          provenance: Column | None = None, value: Column | None = None) -> Column:
    none = F.lit(None)
    parts = {"group": group, "name": name, "provenance": provenance}
    return F.struct(F.lit(level).alias("level"),
                    *[(none if c is None else c).cast("string").alias(n) for n, c in parts.items()],
                    (none if value is None else value).cast("double").alias("value"))


def _lines(computation: Computation, records: DataFrame) -> Column:
    """The lines that a record adds to a computation, as an array."""
    empty = F.array().cast(f"array<{LINE}>")
    carried = records.schema["fields"].dataType.fieldNames()
    if computation.kind == INVENTORY:
        lines = F.array_union(
            F.array(_line("record_type", name=F.col("record_type"))),
            F.coalesce(F.transform("quality_flags", lambda f: _line("quality_flag", name=f)), empty))
    elif computation.kind == AVAILABILITY:
        known = [F.when(F.col("fields")[c]["provenance"].isNotNull(),
                        _line("concept", name=F.lit(c), provenance=F.col("fields")[c]["provenance"]))
                 for c in CONCEPT_UNITS if c in carried]
        lines = F.array_compact(F.array(_line("scanned"), *known))
    elif computation.kind == SUMMARY:
        group = None if computation.group_by is None else F.col(computation.group_by)
        if computation.concept in carried:
            field = F.col("fields")[computation.concept]
            value = F.when(field["provenance"] != "unavailable", field["value"].cast("double"))
            lines = F.array(_line("group", group, provenance=field["provenance"], value=value))
        else:
            lines = F.array(_line("group", group))
    else:
        lines = F.array(_line("total", name=F.lit("all")), _line("lap", name=F.col("lap_id")))
        if computation.record_type == "driver_input_event":
            lines = F.array_append(lines, _line("event_type", name=F.col("event_type")))
    if computation.record_type is None:
        return lines
    return F.when(F.col("record_type") == computation.record_type, lines).otherwise(empty)


def counted_lines(records: DataFrame, computations: Sequence[Computation]) -> DataFrame:
    """computation, level, group, name, provenance, value and their count ``w``; one scan, one shuffle."""
    names = [c.name for c in computations]
    if not names or len(set(names)) < len(names):
        raise ValueError("computations need distinct names")
    parts = ("level", "group", "name", "provenance", "value")

    def named(computation: Computation) -> Column:
        return F.transform(_lines(computation, records), lambda line: F.struct(
            F.lit(computation.name).alias("computation"), *[line[p].alias(p) for p in parts]))

    every = F.flatten(F.array(*[named(c) for c in computations]))
    return records.select(F.inline(every)).groupBy(*KEYS, "provenance", "value").agg(F.count(F.lit(1)).alias("w"))


def run_computations(records: DataFrame, computations: Sequence[Computation], scale: Scale = UNKNOWN) -> DataFrame:
    """Results of all computations, one row per (computation, level, group, name).

    ``n`` counts records, ``present`` those with a provenance, then follow the counts by provenance
    and, for summaries, the exact robust statistics (null in groups without a value). Every
    availability names all 41 concepts and, at level ``scanned``, the records it looked at.
    """
    counted = cut_lineage(counted_lines(records, computations))
    none = [(c.name, level, concept) for c in computations if c.kind == AVAILABILITY
            for level, concept in [("scanned", None), *[("concept", concept) for concept in CONCEPT_UNITS]]]
    rows = counted
    if none:
        blank = literal_table(records.sparkSession, "computation string, level string, name string", none)
        rows = counted.unionByName(blank.withColumn("w", F.lit(0).cast("long")), allowMissingColumns=True)
    of = {p: F.sum(F.when(F.col("provenance") == p, F.col("w")).otherwise(0)) for p in PROVENANCES}
    totals = rows.groupBy(*KEYS).agg(
        F.sum("w").alias("n"), F.sum(F.when(F.col("provenance").isNotNull(), F.col("w")).otherwise(0)).alias("present"),
        *[total.alias(p) for p, total in of.items()])
    values = counted.filter("value is not null").groupBy(*KEYS, "value").agg(F.sum("w").alias("w"))
    summary = histogram_summary(values, KEYS, "value", scale.times(len(computations))).select(*KEYS, *STATISTICS)
    return by_key(totals, summary, KEYS, "left")
