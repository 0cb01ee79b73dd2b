"""Scope, sufficiency and interpretation rules around the estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.operators.audit import violations
from stintwise.operators.comparability import ceiling_name, ceiling_rank


def in_scope(df: DataFrame, scope: str = "primary") -> DataFrame:
    """Units or pairs of the primary evidence, or those held out for replication."""
    return df.filter(F.col("holdout") == F.lit(scope == "holdout"))


def unit_subset(units: DataFrame, field: str, value: str) -> DataFrame:
    return units.filter(F.col(field).cast("string") == value)


def pair_subset(pairs: DataFrame, units: DataFrame, field: str, value: str) -> DataFrame:
    """Pairs both of whose members match; ``pair_key`` is read from the pair itself."""
    if field == "pair_key":
        return pairs.filter(F.col("pair_key") == value)
    members = unit_subset(units, field, value).select("unit_id")
    return pairs.join(members.withColumnRenamed("unit_id", "baseline_unit_id"), "baseline_unit_id", "left_semi").join(
        members.withColumnRenamed("unit_id", "intervention_unit_id"), "intervention_unit_id", "left_semi")


def sufficiency(studies: DataFrame) -> DataFrame:
    """Declared requirements against what is available, one row per study.

    Columns read: available_/required_ units, pairs, clusters, participants; source,
    cited, protocol (arrays of text); comparability_status, post_hoc, confirmatory,
    uncertainty_usable.
    """
    unmet = [F.when(F.col(f"available_{w}") < F.col(f"required_{w}"), f"minimum_{w}")
             for w in ("units", "pairs", "clusters", "participants")]
    unmet += [
        F.when(F.col("source") == "not_declared", "not_declared"),
        F.when(F.col("comparability_status") == "inadequate", "comparability_inadequate"),
        F.when(F.col("post_hoc") & F.col("confirmatory"), "post_hoc_exclusion"),
        F.when((F.col("source") == "frozen_protocol") & (F.size(F.array_except("cited", "protocol")) > 0),
               "uncited_declaration"),
        F.when(~F.col("uncertainty_usable") & F.col("confirmatory"), "no_usable_uncertainty"),
    ]
    held = studies.withColumn("unmet", F.array_compact(F.array(*unmet)))
    held = held.withColumn("status", F.when(F.col("source") == "not_declared", "undetermined").when(
        F.size("unmet") > 0, "insufficient").otherwise("sufficient"))
    held = held.withColumn("descriptive_only", (F.col("status") != "sufficient") | (
        F.col("comparability_status") == "inadequate"))
    return held.withColumn("confirmatory_permitted", (F.col("status") == "sufficient") & F.col("confirmatory")
                           & ~F.col("post_hoc") & ~F.col("descriptive_only"))


def interpretation(runs: DataFrame) -> DataFrame:
    """Analysis state and effective ceiling.

    Columns read: primary_computed, status, descriptive_only, requested, structural.
    ``refused`` marks a request above what the design supports.
    """
    effective = F.when(F.col("descriptive_only"), F.lit("descriptive")).otherwise(
        ceiling_name(F.least(ceiling_rank(F.col("requested")), ceiling_rank(F.col("structural")))))
    return runs.withColumns({
        "refused": ceiling_rank(F.col("requested")) > ceiling_rank(F.col("structural")),
        "analysis_state": F.when(F.col("primary_computed") & (F.col("status") != "insufficient"), "computed")
        .otherwise("inconclusive"),
        "effective_ceiling": effective,
    })


def run_rules(results: DataFrame, subject: list[str], alpha: float) -> DataFrame:
    """Broken rules of a result table: adjusted >= raw, rejected => adjusted <= alpha,
    effective <= requested <= structural, synthetic never eligible."""
    def ordered(low: str, high: str) -> Column:
        return ceiling_rank(F.col(low)) <= ceiling_rank(F.col(high))

    rules = {
        "adjusted_below_raw": F.col("adjusted_p_value") >= F.col("p_value"),
        "rejected_above_alpha": ~F.col("rejected") | (F.col("adjusted_p_value") <= alpha),
        "not_rejected_below_alpha": F.col("rejected") | F.coalesce(F.col("adjusted_p_value") > alpha, F.lit(True)),
    }
    if "requested" in results.columns:
        rules["effective_above_requested"] = ordered("effective_ceiling", "requested")
        rules["requested_above_structural"] = ordered("requested", "structural")
    if "synthetic" in results.columns:
        rules["synthetic_eligible"] = ~(F.col("synthetic") & F.col("eligible"))
    return violations(results, rules, subject)
