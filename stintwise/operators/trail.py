"""Audits over review trails: chained transitions, findings, validations and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.functions.canonical import row_hash
from stintwise.operators.audit import violations
from stintwise.operators.spread import UNKNOWN, Scale, literal_table, lookup_join, ordered_scan

# Permitted lifecycle edges (from, to); a chain starts in ``generated``.
LIFECYCLE_EDGES = (
    ("generated", "analysis_ready"), ("analysis_ready", "tested"),
    ("tested", "supported_provisionally"), ("tested", "rejected"), ("tested", "inconclusive"),
    ("tested", "replication_required"), ("replication_required", "tested"),
    ("supported_provisionally", "replication_required"), ("supported_provisionally", "rejected"),
    ("supported_provisionally", "inconclusive"), ("inconclusive", "analysis_ready"),
)
# States entered only from a completed, verified run.
EVIDENCE_STATES = ("tested", "supported_provisionally", "rejected", "inconclusive", "replication_required")


def hash_mismatches(transitions: DataFrame, subject: list[str], stored: str, columns: list[str]) -> DataFrame:
    """Rows whose stored hash is not the hash of their content."""
    return transitions.filter(~F.col(stored).eqNullSafe(row_hash(columns))).select(*subject)


def replay(
    transitions: DataFrame, key: str, sequence: str, edges: tuple[tuple[str, str], ...], slot: Column | None = None,
    scale: Scale = UNKNOWN,
) -> DataFrame:
    """Chain violations: (key, sequence, rule).

    Columns read: from_state, to_state, previous_hash, hash. Sequence must run 0, 1, 2, ...,
    each from_state and previous_hash must be those of the row before, every step an edge.
    """
    seen = ordered_scan(transitions, [key], [sequence], slot if slot is not None else F.floor(F.col(sequence) / 4096), {
        "_seq": ("previous", F.col(sequence).cast("long")), "_state": ("previous", F.col("to_state")),
        "_hash": ("previous", F.col("hash"))}, scale)
    first = F.col("_seq").isNull()
    allowed = literal_table(transitions.sparkSession, "from_state string, to_state string", list(edges))
    checked = seen.join(F.broadcast(allowed.withColumn("_edge", F.lit(True))), ["from_state", "to_state"], "left")
    return violations(checked, {
        "sequence_not_contiguous": F.col(sequence) == F.coalesce(F.col("_seq") + 1, F.lit(0)),
        "from_state_mismatch": F.when(first, F.col("from_state").isNull()).otherwise(
            F.col("from_state").eqNullSafe(F.col("_state"))),
        "previous_hash_mismatch": F.when(first, F.col("previous_hash").isNull()).otherwise(
            F.col("previous_hash").eqNullSafe(F.col("_hash"))),
        "edge_not_permitted": F.col("from_state").isNull() | F.col("_edge").isNotNull(),
    }, [key, sequence])


def entry_rules(transitions: DataFrame, subject: list[str]) -> DataFrame:
    """What must be bound and reviewed before a state may be entered.

    Columns read: to_state, has_protocol, has_evidence, has_definition, has_run, run_verified,
    run_computed, review_state.
    """
    to = F.col("to_state")
    bearing = to.isin(*EVIDENCE_STATES)
    complete = F.col("has_protocol") & F.col("has_evidence") & F.col("has_definition")
    review = F.col("review_state")
    return violations(transitions, {
        "ready_needs_bindings": (to != "analysis_ready") | complete,
        "ready_before_run": (to != "analysis_ready") | ~F.col("has_run"),
        "evidence_needs_bindings": ~bearing | (complete & F.col("has_run")),
        "run_not_verified": ~bearing | ~F.col("has_run") | F.col("run_verified"),
        "not_reviewed": ~bearing | (review != "unreviewed"),
        "support_needs_approval": (to != "supported_provisionally") | (review == "approved"),
        "support_needs_result": (to != "supported_provisionally") | F.col("run_computed"),
        "inconclusive_needs_review": (to != "inconclusive") | ~F.col("run_computed") | review.isin("approved", "pending"),
    }, subject)


def registry_summary(transitions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Current state, number of transitions and of evidence-bearing ones per chain."""
    return transitions.groupBy(key).agg(
        F.max_by("to_state", F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("transitions"),
        F.count_if(F.col("to_state").isin(*EVIDENCE_STATES)).alias("evidence_bearing"))


def recommendation() -> Column:
    """Product recommendation of a finding; synthetic evidence is decided first.

    Columns read: synthetic, status, scientific_gate, reproducibility_gate, review_state,
    replication, analysis_state, hypothesis_state.
    """
    passed = (F.col("scientific_gate") == "passed") & (F.col("reproducibility_gate") == "passed")
    owed = F.col("replication") == "required_before_validation"
    sound = (F.col("status") == "validated") & passed & (F.col("review_state") == "approved")
    return (
        F.when(F.col("synthetic"), "do_not_implement")
        .when(sound & ~owed, "engineering_review_candidate")
        .when(owed & (F.col("analysis_state") == "computed"), "replication_required")
        .when((F.col("status") == "provisional") & (F.col("hypothesis_state") == "supported_provisionally"), "investigate")
        .otherwise("none"))


def disagreements(findings: DataFrame, artifacts: DataFrame, on: list[str], columns: list[str],
                  scale: Scale = UNKNOWN) -> DataFrame:
    """(on..., rule) for each field in which a finding and its validation differ, nulls equal."""
    table = artifacts.select(*on, *[F.col(c).alias(f"_v_{c}") for c in columns], F.lit(True).alias("_known"))
    joined = lookup_join(findings, table, on, "left", [F.col(c) for c in columns], scale)
    rules = {"validation_missing": F.col("_known").isNotNull()}
    rules.update({f"{c}_differs": F.col("_known").isNull() | F.col(c).eqNullSafe(F.col(f"_v_{c}")) for c in columns})
    return violations(joined, rules, on)


def gate_rules(findings: DataFrame, subject: list[str]) -> DataFrame:
    """Status against gates and review.

    Columns read: status, structural_gate, scientific_gate, reproducibility_gate, review_state,
    synthetic.
    """
    def gate(name: str, value: str) -> Column:
        return F.col(f"{name}_gate") == value

    approved = F.col("review_state") == "approved"
    status = F.col("status")
    return violations(findings, {
        "validated_without_gates": (status != "validated") | (
            gate("scientific", "passed") & gate("reproducibility", "passed") & approved),
        "provisional_without_structure": (status != "provisional") | (gate("structural", "passed") & approved),
        "rejected_without_evidence": (status != "rejected") | (gate("scientific", "failed") & approved),
        "unresolved_not_inconclusive": ~gate("scientific", "unresolved") | (status == "inconclusive"),
        "scientific_before_others": ~gate("scientific", "passed") | (
            gate("structural", "passed") & gate("reproducibility", "passed")),
        "scientific_without_review": ~gate("scientific", "passed") | approved,
        "synthetic_promoted": ~F.col("synthetic") | ~(gate("scientific", "passed") | approved),
    }, subject)


def export_references(references: DataFrame, findings: DataFrame, algorithms: DataFrame,
                      scale: Scale = UNKNOWN) -> DataFrame:
    """(algorithm_id, rule) for algorithms whose supporting findings do not allow their claims.

    references: algorithm_id, finding_id. findings: finding_id, synthetic, status, safe.
    algorithms: algorithm_id, recommendation (not_recommended, recommended or another status),
    safe. Synthetic support forbids every status but not_recommended. A finding may be cited by very many
    algorithms, an algorithm may cite very many findings: both joins salt heavy keys and the
    per-algorithm facts are plain mergeable aggregates.
    """
    table = findings.select("finding_id", "synthetic", "status", F.col("safe").alias("_safe"))
    joined = lookup_join(references, table, ["finding_id"], "left", [F.col("algorithm_id")], scale)
    facts = joined.groupBy("algorithm_id").agg(
        F.count_if(F.col("status").isNull()).alias("dangling"), F.bool_or("synthetic").alias("synthetic"),
        F.bool_and(F.col("status") == "validated").alias("all_validated"), F.bool_and("_safe").alias("all_safe"))
    return violations(algorithms.join(facts, "algorithm_id"), {
        "dangling_reference": F.col("dangling") == 0,
        "synthetic_support": ~(F.coalesce("synthetic", F.lit(False)) & (
            ~F.col("recommendation").eqNullSafe(F.lit("not_recommended")) | F.col("safe"))),
        "recommended_without_validation": ~F.col("recommendation").eqNullSafe(F.lit("recommended")) | F.coalesce("all_validated", F.lit(True)),
        "safe_without_safe_findings": ~F.col("safe") | F.coalesce("all_safe", F.lit(True)),
    }, ["algorithm_id"])


def unreferenced(artifacts: DataFrame, references: DataFrame, on: list[str]) -> DataFrame:
    """Artifacts nothing points to."""
    return artifacts.join(references.select(*on).distinct(), on, "left_anti")


def first_seen(items: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """Distinct items per key with the place they first appear at (their order is kept by it)."""
    return items.groupBy(*keys, item).agg(F.min(order).alias("first_at"), F.count(F.lit(1)).alias("n"))


def expectation_mismatches(expected: DataFrame, observed: DataFrame, on: list[str], kind: str = "kind") -> DataFrame:
    """Known answers against observed values.

    expected: on, ``kind`` (equals or at_least), value. observed: on, value. Observed values
    nobody expected are not mismatches.
    """
    got = observed.select(*on, F.col("value").alias("observed"), F.lit(True).alias("_seen"))
    joined = expected.withColumnRenamed("value", "expected").join(got, on, "left")
    low = (F.col(kind) == "at_least") & ~F.coalesce(F.col("observed") >= F.col("expected"), F.lit(False))
    other = (F.col(kind) == "equals") & ~F.col("observed").eqNullSafe(F.col("expected"))
    return joined.withColumn("problem", F.when(F.col("_seen").isNull(), "nothing_observed").when(
        low, "below_expected").when(other, "differs")).filter("problem is not null").drop("_seen")


def wildcard_mismatches(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Known answers for all paths of a pattern, in which ``*`` stands for any one level of a path with ``.`` between levels.

    expected: pattern, kind (equals, at_least or one_of_each: observed by exactly one path), value. observed: path, value.
    Returns pattern, kind, expected, path, observed, problem; a pattern that fits no path is nothing_observed, and
    more than one path of one_of_each is ambiguous, with the first path. Values nobody expected are no mismatches.

    A pattern's levels before its first ``*`` are its key: paths are joined by those of their leading levels that are
    as many as some pattern of the same depth has, and the levels behind are compared after the join.
    """
    parts = F.split("pattern", r"\.")
    at = F.array_position("_parts", "*").cast("int")
    rules = expected.withColumnRenamed("value", "expected").withColumn("_parts", parts).withColumn("_depth", F.size("_parts")).withColumn(
        "_fixed", F.when(at > 0, at - 1).otherwise(F.size("_parts"))).withColumn(
        "_head", F.array_join(F.slice("_parts", F.lit(1), F.col("_fixed")), "."))
    shapes = rules.select("_depth", "_fixed").distinct()
    paths = observed.select("path", F.col("value").alias("observed"), F.split("path", r"\.").alias("_levels")).withColumn(
        "_depth", F.size("_levels")).join(shapes, "_depth").withColumn(
        "_head", F.array_join(F.slice("_levels", F.lit(1), F.col("_fixed")), "."))
    fits = F.forall(F.zip_with("_parts", "_levels", lambda p, o: (p == "*") | (p == o)), lambda x: x)
    found = rules.join(paths, ["_depth", "_fixed", "_head"]).where(fits)
    low = (F.col("kind") == "at_least") & ~F.coalesce(F.col("observed") >= F.col("expected"), F.lit(False))
    other = (F.col("kind") == "equals") & ~F.col("observed").eqNullSafe(F.col("expected"))
    wrong = found.where("kind <> 'one_of_each'").withColumn("problem", F.when(low, "below_expected").when(other, "differs"))
    names = ["pattern", "kind", "expected"]
    several = found.where("kind = 'one_of_each'").groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("path", "observed")).alias("_first")).where("_n > 1").select(
        *names, "_first.*", F.lit("ambiguous").alias("problem"))
    absent = expected.withColumnRenamed("value", "expected").join(found.select("pattern").distinct(), "pattern", "left_anti").select(
        *names, F.lit(None).cast("string").alias("path"), F.lit(None).cast(observed.schema["value"].dataType).alias("observed"),
        F.lit("nothing_observed").alias("problem"))
    return wrong.where("problem is not null").select(*names, "path", "observed", "problem").unionByName(several).unionByName(absent)
