"""Comparability of the datasets behind one piece of evidence, and what it lets one claim."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.operators.spread import literal_table
from stintwise.vocabulary import CEILINGS, COMPARABILITY_FIELDS, PROTECTED_IDENTITY_FIELDS

UNAVAILABLE = "<unavailable>"


@dataclass(frozen=True)
class Variation:
    """A field that may differ, and how its values are kept (covariate or limitation)."""

    field: str
    retained_as: str = "limitation"
    plan_id: str | None = None


def comparability_key(contexts: DataFrame, constants: dict[str, str]) -> DataFrame:
    """The thirteen key fields per dataset; what neither side supplies is unavailable (null)."""
    have = set(contexts.columns)
    columns = []
    for field in COMPARABILITY_FIELDS:
        if field == "condition_semantics" and "condition_id" in have:
            columns.append(F.col("condition_id").alias(field))
        elif field in have:
            columns.append(F.col(field).cast("string").alias(field))
        else:
            columns.append(F.lit(constants.get(field)).cast("string").alias(field))
    return contexts.select("dataset_id", "arm", *columns)


def observed_values(keys: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """(group, field, value, datasets): every value a field takes, with its support."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(UNAVAILABLE)).alias("value"))
                      for f in fields])
    return keys.select(*group, F.inline(pairs)).groupBy(*group, "field", "value").agg(
        F.count(F.lit(1)).alias("datasets"))


def assess_fields(
    keys: DataFrame, group: list[str], must_match: list[str], permitted: list[Variation],
    factor_fields: tuple[str, ...] = ("condition_semantics", "coaching_state"),
) -> DataFrame:
    """One row per group and declared field: how it varies and what follows.

    verdict: refused, violation, limitation, covariate or fine. Fields of the factor itself
    may vary without becoming a limitation.
    """
    rules = [(f, "must_match", "none", f in PROTECTED_IDENTITY_FIELDS) for f in must_match]
    rules += [(v.field, "permitted", v.retained_as, v.field in PROTECTED_IDENTITY_FIELDS) for v in permitted]
    declared = literal_table(keys.sparkSession, "field string, rule string, retained string, protected boolean", rules)
    seen = observed_values(keys, group, [r[0] for r in rules]).groupBy(*group, "field").agg(
        F.count_if(F.col("value") != UNAVAILABLE).alias("real_values"),
        F.bool_or(F.col("value") == UNAVAILABLE).alias("some_unavailable"),
        F.min(F.when(F.col("value") != UNAVAILABLE, F.col("value"))).alias("first_value"),
        F.max(F.when(F.col("value") != UNAVAILABLE, F.col("value"))).alias("last_value"))
    strict = F.col("rule") == "must_match"
    varied = F.col("real_values") > 1
    verdict = (
        F.when(strict & varied, "refused")
        .when(strict & F.col("some_unavailable"), "violation")
        .when(strict, "fine")
        .when(F.col("protected"), "limitation")
        .when(varied & ~F.col("field").isin(*factor_fields), "limitation")
        .when(F.col("some_unavailable"), "limitation")
        .when(F.col("retained") == "covariate", "covariate")
        .otherwise("fine"))
    identity = F.col("protected") & (verdict.isin("violation") | ~strict)
    return seen.join(F.broadcast(declared), "field").select(
        *group, "field", "rule", "retained", "real_values", "some_unavailable", "first_value", "last_value",
        verdict.alias("verdict"), identity.alias("identity_limited"))


def assess(fields: DataFrame, keys: DataFrame, group: list[str]) -> DataFrame:
    """adequate, limited, inadequate or refused per group."""
    arms = keys.groupBy(*group).agg(F.count_distinct("arm").alias("arms"), F.count(F.lit(1)).alias("datasets"))
    tally = fields.groupBy(*group).agg(
        F.count_if(F.col("verdict") == "refused").alias("refused_fields"),
        F.count_if(F.col("verdict") == "violation").alias("violations"),
        F.count_if(F.col("verdict").isin("violation", "limitation")).alias("limitations"),
        F.bool_or("identity_limited").alias("identity_limited"))
    status = F.when(F.col("refused_fields") > 0, "refused").when(F.col("arms") < 2, "inadequate").when(
        F.col("limitations") > 0, "limited").otherwise("adequate")
    return arms.join(tally, group).withColumn("status", status)


def unplanned_variation(permitted: DataFrame, plans: DataFrame) -> DataFrame:
    """Protected fields allowed to vary: their ceiling, or why the plan does not cover them.

    permitted: study, field, plan_id. plans: study, plan_id, plan_field, ceiling.
    """
    joined = permitted.filter(F.col("field").isin(*PROTECTED_IDENTITY_FIELDS)).join(plans, ["study", "plan_id"], "left")
    return joined.withColumn("problem", F.when(F.col("plan_field").isNull(), "no_plan").when(
        F.col("plan_field") != F.col("field"), "plan_for_other_field"))


def ceiling_rank(name: Column) -> Column:
    """Place of a ceiling on the ordinal scale, 0 = descriptive."""
    scale = F.array(*[F.lit(c) for c in CEILINGS])
    return F.array_position(scale, name) - 1


def ceiling_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CEILINGS]), (rank + 1).cast("int"))


def structural_ceiling(
    has_intervention: Column, strategy: Column, criteria_declared: Column, status: Column,
    identity_unverified: Column, variation_limit: Column | None = None,
) -> Column:
    """Strongest interpretation the design supports, never read from the result."""
    base = (
        F.when(status == "inadequate", 0)
        .when(~has_intervention, 1)
        .when(strategy.isin("randomized", "counterbalanced") & criteria_declared, 3)
        .otherwise(2))
    capped = F.least(base, F.when(identity_unverified, 2))
    if variation_limit is not None:
        capped = F.least(capped, ceiling_rank(variation_limit))
    return ceiling_name(F.when(status == "inadequate", 0).otherwise(capped))


def mixed_sources(datasets: DataFrame, group: list[str]) -> DataFrame:
    """Groups that mix synthetic with real datasets or list a dataset twice."""
    return datasets.groupBy(*group).agg(
        F.count_distinct("synthetic").alias("kinds"), F.count(F.lit(1)).alias("n"),
        F.count_distinct("dataset_id").alias("distinct_datasets"),
    ).withColumn("problem", F.when(F.col("kinds") > 1, "mixed_synthetic").when(
        F.col("n") > F.col("distinct_datasets"), "repeated_dataset")).filter("problem is not null")
