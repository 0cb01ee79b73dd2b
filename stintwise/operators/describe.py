"""Descriptive aggregations over records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.operators.audit import violations
from stintwise.operators.quantiles import robust_summary
from stintwise.operators.spread import UNKNOWN, Scale, by_key
from stintwise.schema import reading
from stintwise.vocabulary import CONCEPT_UNITS, PROVENANCES


def record_inventory(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts per record type and per quality flag, as (kind, name, n)."""
    keys = keys or []
    tags = F.array_union(
        F.array(F.struct(F.lit("record_type").alias("kind"), F.col("record_type").alias("name"))),
        F.coalesce(
            F.transform("quality_flags", lambda f: F.struct(F.lit("quality_flag").alias("kind"), f.alias("name"))),
            F.array().cast("array<struct<kind:string,name:string>>")))
    return (
        records.select(*keys, F.explode(tags).alias("t"))
        .groupBy(*keys, F.col("t.kind").alias("kind"), F.col("t.name").alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def concept_availability(records: DataFrame, record_type: str | None = None) -> DataFrame:
    """Present / measured / derived / estimated / unavailable counts for all 41 concepts.

    One wide aggregation with no grouping key and no exploded rows, reading nothing but the
    provenance members; the single result row is then turned into one row per concept.
    """
    rows = records if record_type is None else records.filter(F.col("record_type") == record_type)
    carried = rows.schema["fields"].dataType.fieldNames()
    flat = rows.agg(F.count(F.lit(1)).alias("records_scanned"), *[
        F.struct(
            F.count(F.col("fields")[c]["provenance"]).alias("present"),
            *[F.count_if(F.col("fields")[c]["provenance"] == p).alias(p) for p in PROVENANCES]).alias(c)
        for c in CONCEPT_UNITS if c in carried])
    zero = F.lit(0).cast("long")
    lines = []
    for concept in CONCEPT_UNITS:
        parts = {n: F.col(concept)[n] if concept in carried else zero for n in ("present", *PROVENANCES)}
        lines.append(F.struct(
            F.lit(concept).alias("concept"), "records_scanned", *[p.alias(n) for n, p in parts.items()]))
    return flat.select(F.inline(F.array(*lines)))


def descriptive_summary(
    records: DataFrame, record_type: str, concept: str, group_by: list[str], scale: Scale = UNKNOWN
) -> DataFrame:
    """Robust summary of one numeric concept with its attrition.

    Groups come from all records of the type, so a group without a single value keeps its
    row with a null summary.
    """
    rows = records.filter(F.col("record_type") == record_type)
    field = F.col("fields")[concept]
    attrition = rows.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("records_of_type"), F.count(field["provenance"]).alias("field_present"),
        F.count_if(field["provenance"] == "unavailable").alias("values_unavailable"),
    ).withColumn("values_included", F.col("field_present") - F.col("values_unavailable"))
    values = rows.select(*group_by, reading(concept).cast("double").alias("_v"))
    return by_key(attrition, robust_summary(values, group_by, "_v", scale).drop("n_values"), group_by, "left")


def event_yield(records: DataFrame, record_type: str) -> DataFrame:
    """Total, per lap and per event type counts as (level, name, n); one pass."""
    rows = records.filter(F.col("record_type") == record_type)
    levels = [F.struct(F.lit("total").alias("level"), F.lit("all").alias("name")),
              F.struct(F.lit("lap").alias("level"), F.col("lap_id").alias("name"))]
    if record_type == "driver_input_event":
        levels.append(F.struct(F.lit("event_type").alias("level"), F.col("event_type").alias("name")))
    return rows.select(F.inline(F.array(*levels))).groupBy("level", "name").agg(F.count(F.lit(1)).alias("n"))


def audit_summaries(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Broken invariants of a descriptive summary: attrition order and quartile order."""
    checks = {
        "attrition_order": (F.col("field_present") <= F.col("records_of_type"))
        & (F.col("values_included") + F.col("values_unavailable") == F.col("field_present")),
        "quartile_order": F.coalesce(
            (F.col("minimum") <= F.col("q1")) & (F.col("q1") <= F.col("median"))
            & (F.col("median") <= F.col("q3")) & (F.col("q3") <= F.col("maximum")), F.lit(True)),
        "null_when_empty": (F.col("values_included") > 0) == F.col("median").isNotNull(),
    }
    return violations(summary, checks, keys)
