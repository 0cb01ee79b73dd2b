"""Track-segment definitions and record selection by region and phase."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.operators.spread import literal_table
from stintwise.schema import reading


@dataclass(frozen=True)
class Phase:
    """Keep records whose concept is at or above (or below) a threshold."""

    concept: str
    threshold: float
    at_or_above: bool = True


@dataclass(frozen=True)
class Segment:
    """A stretch of the lap, with explicit boundary rules and coverage requirements."""

    segment_id: str
    start: float
    end: float
    kind: str = "distance_range"
    start_inclusive: bool = True
    end_inclusive: bool = False
    wraparound: bool = False
    phase: Phase | None = None
    required_concepts: tuple[str, ...] = ("speed",)
    minimum_records: int = 1
    minimum_coverage: float = 0.0
    # (simulator, track, layout, geometry fingerprint)
    applies_to: tuple[tuple[str, str, str, str], ...] = field(default=())


def position(kind: str = "distance_range", bins: bool = False) -> Column:
    """Place of a record on the lap: start of a distance bin, else the measured concept.

    ``bins`` says whether the table carries distance-bin records at all.
    """
    if kind == "lap_fraction_range":
        return reading("lap_fraction")
    if not bins:
        return reading("lap_distance")
    return F.when(F.col("record_type") == "distance_bin", F.col("distance_start_m")).otherwise(
        reading("lap_distance"))


def in_region(segment: Segment, at: Column) -> Column:
    """Region membership; an unknown position is outside."""
    after = at >= segment.start if segment.start_inclusive else at > segment.start
    before = at <= segment.end if segment.end_inclusive else at < segment.end
    return F.coalesce((after | before) if segment.wraparound else (after & before), F.lit(False))


def in_phase(segment: Segment) -> Column:
    """Phase membership; an unavailable channel is outside."""
    if segment.phase is None:
        return F.lit(True)
    value = reading(segment.phase.concept)
    test = value >= segment.phase.threshold if segment.phase.at_or_above else value < segment.phase.threshold
    return F.coalesce(test, F.lit(False))


def selects(segment: Segment, bins: bool = False) -> Column:
    """Region and phase together."""
    return in_region(segment, position(segment.kind, bins)) & in_phase(segment)


def tag_segments(records: DataFrame, segments: list[Segment], bins: bool = False) -> DataFrame:
    """One output row per (record, segment that selects it); no join, no record repeated needlessly."""
    hits = F.array_compact(F.array(*[F.when(selects(s, bins), F.lit(s.segment_id)) for s in segments]))
    tagged = records.withColumn("_hits", hits).filter(F.size("_hits") > 0)
    return tagged.withColumn("segment", F.explode("_hits")).drop("_hits")


def covered_cells(segment: Segment) -> Column:
    """How many of the required concepts a record really carries."""
    return sum((reading(c).isNotNull().cast("int") for c in segment.required_concepts), F.lit(0))


def applicability(contexts: DataFrame, segment: Segment) -> DataFrame:
    """Contexts with the matching geometry fingerprint, null where the segment does not apply."""
    listed = literal_table(
        contexts.sparkSession, "simulator string, track string, layout string, geometry string",
        list(segment.applies_to))
    return contexts.join(F.broadcast(listed), ["simulator", "track", "layout"], "left").withColumn(
        "problem", F.when(F.col("geometry").isNull(), F.concat_ws(
            " ", F.lit(f"segment {segment.segment_id} does not apply to"),
            F.concat_ws("/", "simulator", "track", "layout"))))


def geometry_conflicts(applied: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence groups that span more than one geometry."""
    return (
        applied.filter(F.col("geometry").isNotNull()).groupBy(*keys)
        .agg(F.count_distinct("geometry").alias("geometries"),
             F.min("geometry").alias("first_geometry"), F.max("geometry").alias("last_geometry"))
        .filter("geometries > 1")
    )
