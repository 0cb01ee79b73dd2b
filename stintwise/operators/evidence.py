"""Comparable evidence: exclusion cascade, attrition ledger, units, pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from stintwise.functions.cells import identifier
from stintwise.operators.quantiles import mad, medians
from stintwise.operators.segments import Segment, covered_cells, position, selects
from stintwise.operators.spread import UNKNOWN, Scale, literal_table, lookup_join, ordered_scan, position_in
from stintwise.schema import reading

# Record-level stages in the order they apply, then the unit and pair levels.
RECORD_STAGES = (
    "protocol_mismatch", "out_of_order_or_corrupt", "record_type_not_read", "outside_segment", "invalid_lap",
    "missing_required_channel", "incident_affected", "pit_replay_discontinuity",
)
FLAG_PREFIXES = ("pit", "replay", "discontinuity")


@dataclass(frozen=True)
class Extractor:
    """How one number is taken from the records of a unit.

    kind: ``segment_aggregate`` (method minimum / maximum / arithmetic_mean / median),
    ``segment_threshold_distance`` (first or last position at or above the threshold) or
    ``record_field`` (exactly one record).
    """

    concept: str = "speed"
    kind: str = "segment_aggregate"
    method: str = "minimum"
    record_type: str = "telemetry_sample"
    threshold: float | None = None
    first: bool = True
    minimum_source_records: int = 1


def mark_out_of_order(records: DataFrame, file_order: list[str], slot: Column,
                      scale: Scale = UNKNOWN) -> DataFrame:
    """Flag records whose sequence index does not pass every earlier one of the dataset."""
    seen = ordered_scan(records, ["dataset_id"], file_order, slot,
                        {"_highest": ("max", F.col("sequence_index"))}, scale)
    return seen.withColumn(
        "out_of_order", F.col("sequence_index") <= F.coalesce(F.col("_highest"), F.lit(-1))).drop("_highest")


def has_incident(text_truthy: bool = False) -> Column:
    """Incident or off-track. A numeric text is an incident when above zero, other text when
    not empty; ``text_truthy`` counts every non-empty text instead."""
    text = reading("incident_state")
    number = text.try_cast("double")
    incident = (text != "") if text_truthy else F.when(number.isNotNull(), number > 0).otherwise(text != "")
    return F.coalesce(incident, F.lit(False))


def off_track() -> Column:
    return F.coalesce(reading("off_track_state"), F.lit(False))


def classify(
    records: DataFrame,
    laps: DataFrame,
    segment: Segment,
    extractor: Extractor,
    bins: bool = False,
    text_truthy: bool = False,
    scale: Scale = UNKNOWN,
) -> DataFrame:
    """Give every record the first stage that removes it (``exit_stage``; null = survivor).

    ``records`` carry an ``arm`` (null when no arm uses their condition) and may carry
    ``out_of_order``; ``laps`` holds dataset_id, lap_id, lap_valid.
    """
    validity = laps.select("dataset_id", "lap_id", "lap_valid")
    joined = lookup_join(records, validity, ["dataset_id", "lap_id"], "left", [F.col("record_id")], scale)
    whole = extractor.kind == "record_field"
    carried = records.schema["fields"].dataType.fieldNames()
    trouble = has_incident(text_truthy) if "incident_state" in carried else F.lit(False)
    if "off_track_state" in carried:
        trouble = trouble | off_track()
    flagged = F.coalesce(F.exists(
        "quality_flags", lambda f: F.lit(False) | sum(
            (f.startswith(p).cast("int") for p in FLAG_PREFIXES), F.lit(0)).cast("boolean")), F.lit(False))
    late = F.col("out_of_order") if "out_of_order" in records.columns else F.lit(False)
    stage = (
        F.when(F.col("arm").isNull(), RECORD_STAGES[0])
        .when(late, RECORD_STAGES[1])
        .when(F.col("record_type") != extractor.record_type, RECORD_STAGES[2])
        .when(F.lit(not whole) & ~selects(segment, bins), RECORD_STAGES[3])
        .when(F.col("lap_valid") == F.lit(False), RECORD_STAGES[4])
        .when(reading(extractor.concept).isNull(), RECORD_STAGES[5])
        .when(trouble, RECORD_STAGES[6])
        .when(flagged, RECORD_STAGES[7])
    )
    return joined.withColumn("exit_stage", stage)


def ledger(
    leaving: DataFrame, level: str, counted: str, stages: list[str],
    rules: dict[str, tuple[str, bool]] | None = None,
    fixed: dict[str, str] | None = None,
) -> DataFrame:
    """Attrition of one level from rows with ``exit_stage``: considered, excluded, remaining.

    ``rules`` maps a stage to (rule id, preregistered); ``fixed`` maps a stage to a
    disposition that does not depend on a rule. A stage that removed rows with neither is
    marked ``not_permitted``.
    """
    rules, fixed = rules or {}, fixed or {}
    rows = [(level, 0, counted, None, "counted")]
    for i, stage in enumerate(stages, 1):
        rule_id, preregistered = rules.get(stage, (None, True))
        how = fixed.get(stage, "excluded_by_preregistered_rule")
        if rule_id is not None and not preregistered:
            how = "post_hoc_exclusion"
        rows.append((level, i, stage, rule_id, how if stage in fixed or rule_id is not None else "not_permitted"))
    plan = literal_table(
        leaving.sparkSession, "level string, step int, stage string, rule_id string, disposition string", rows)
    counts = leaving.groupBy(F.coalesce("exit_stage", F.lit(counted)).alias("stage")).agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("level").orderBy("step")
    taken = F.when(F.col("step") == 0, 0).otherwise(F.coalesce("n", F.lit(0)))
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("level"))
    out = plan.join(counts, "stage", "left").select(
        "level", "step", "stage", "rule_id", "disposition", taken.cast("long").alias("excluded"), total.alias("_t"))
    gone = F.sum("excluded").over(w)
    return out.select(
        "level", "step", "stage", "rule_id",
        F.when((F.col("disposition") == "not_permitted") & (F.col("excluded") == 0),
               "excluded_by_preregistered_rule").otherwise(F.col("disposition")).alias("disposition"),
        (F.col("_t") - gone + F.col("excluded")).alias("considered"), "excluded",
        (F.col("_t") - gone).alias("remaining"))


def form_units(
    survivors: DataFrame,
    segment: Segment,
    extractor: Extractor,
    keys: list[str],
    dispersion: bool = False,
    bins: bool = False,
    scale: Scale = UNKNOWN,
) -> DataFrame:
    """One row per unit (``keys``) with value, counts, coverage and, optionally, MAD.

    A unit that misses a requirement keeps its row and gets
    ``exit_stage = 'insufficient_coverage'``; a whole-lap field found on several records is
    ``ambiguous_unit``.
    """
    value = reading(extractor.concept)
    at = position("distance_range", bins)
    rows = survivors.withColumn("_v", value)
    reached = (F.col("_v") >= extractor.threshold) & at.isNotNull() if extractor.threshold is not None else None
    aggregates = {
        "minimum": F.min("_v"), "maximum": F.max("_v"), "arithmetic_mean": F.avg("_v"), "median": F.lit(None),
    }
    if extractor.kind == "segment_threshold_distance":
        number = (F.min if extractor.first else F.max)(F.when(reached, at))
        used = F.count_if(reached)
        missing = F.count_if(F.col("_v").isNull() | at.isNull())
    elif extractor.kind == "record_field":
        number, used, missing = F.max("_v"), F.count("_v"), F.count_if(F.col("_v").isNull())
    else:
        number, used, missing = aggregates[extractor.method], F.count("_v"), F.count_if(F.col("_v").isNull())
    required = max(1, len(segment.required_concepts))
    units = rows.groupBy(*keys).agg(
        number.cast("double").alias("value"),
        F.count(F.lit(1)).alias("records"),
        used.alias("used"), missing.alias("missing"),
        (F.sum(covered_cells(segment)) / (F.count(F.lit(1)) * required)).alias("coverage_ratio"),
    )
    by_median = extractor.kind == "segment_aggregate" and extractor.method == "median"
    if dispersion:
        middle = mad(rows, keys, "_v", scale).select(
            *keys, F.col("median").alias("_median"), F.col("mad").alias("within_unit_dispersion"))
        units = units.join(middle, keys, "left")
    elif by_median:
        units = units.join(medians(rows, keys, "_v", "_median", scale).drop("n"), keys, "left")
    if by_median:
        units = units.withColumn("value", F.col("_median"))
    units = units.drop("_median")
    whole = extractor.kind == "record_field"
    least = max(extractor.minimum_source_records, 1 if whole else segment.minimum_records)
    short = F.col("value").isNull() | (F.col("records") < least)
    if not whole:
        short = short | (F.col("coverage_ratio") < segment.minimum_coverage)
    return units.withColumns({
        "missing": F.when(F.col("used") == 0, F.col("records")).otherwise(F.col("missing")),
        "exit_stage": F.when(F.lit(whole) & (F.col("used") > 1), "ambiguous_unit").when(
            short, "insufficient_coverage"),
    })


def describe_units(
    units: DataFrame, contexts: DataFrame, key: str, pair_fields: list[str],
    holdout: Column | None = None, scale: Scale = UNKNOWN,
) -> DataFrame:
    """Attach context, unit id, holdout mark, pair key and order index to the kept units."""
    kept = lookup_join(
        units.filter(F.col("exit_stage").isNull()).drop("exit_stage"), contexts, ["dataset_id"], "left",
        [F.col(key)], scale)
    parts = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("None"))) for f in pair_fields]
    kept = kept.withColumns({
        "unit_id": identifier(F.col("dataset_id"), F.col(key)),
        "pair_key": F.concat_ws("|", *parts) if parts else F.lit("all"),
        "holdout": F.lit(False) if holdout is None else F.coalesce(holdout, F.lit(False)),
    })
    lap_number = F.coalesce(F.col("lap_number"), F.lit(0)) if "lap_number" in kept.columns else F.lit(0)
    extra = [c for c in ("segment",) if c in kept.columns]
    return position_in(
        kept.withColumn("_lap", lap_number), [*extra, "pair_key", "arm"], ["dataset_id", "_lap", key],
        "order_index", scale).drop("_lap")


def match_units(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """k-th baseline unit beside the k-th intervention unit of the same pair key.

    One aggregation on (pair_key, order_index), where each group has at most one unit per
    arm: no self-join, and a heavy pair key is spread by its order index. A side without a
    counterpart is null.
    """
    side = [*(by or []), "pair_key", "order_index"]
    unit = F.struct("unit_id", "value", "holdout", "participant", "session_id", "block_id")
    return units.groupBy(*side).agg(
        F.max(F.when(F.col("arm") == "baseline", unit)).alias("b"),
        F.max(F.when(F.col("arm") == "intervention", unit)).alias("i"))


def pair_units(units: DataFrame, by: list[str] | None = None, cluster: str = "participant") -> DataFrame:
    """The matched pairs with their difference, cluster and holdout mark."""
    clusters = {
        "participant": F.col("b.participant"),
        "session": F.concat_ws("+", "b.session_id", "i.session_id"),
        "block": F.concat_ws("+", "b.block_id", "i.block_id"),
        "lap": identifier(F.col("b.unit_id"), F.col("i.unit_id")),
    }
    return match_units(units, by).filter("b is not null and i is not null").select(
        *(by or []), "pair_key", "order_index",
        identifier(F.col("b.unit_id"), F.col("i.unit_id")).alias("pair_id"),
        clusters[cluster].alias("cluster_id"),
        F.col("b.unit_id").alias("baseline_unit_id"), F.col("i.unit_id").alias("intervention_unit_id"),
        F.col("b.value").alias("baseline_value"), F.col("i.value").alias("intervention_value"),
        (F.col("i.value") - F.col("b.value")).alias("difference"),
        (F.col("b.holdout") | F.col("i.holdout")).alias("holdout"),
    )


def unpaired_units(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Units without a counterpart; they are reported, never dropped."""
    lone = F.coalesce("b", "i")
    return match_units(units, by).filter("b is null or i is null").select(
        *(by or []), lone["unit_id"].alias("unit_id"), "pair_key", "order_index",
        F.when(F.col("b").isNotNull(), "baseline").otherwise("intervention").alias("arm"))


def evidence_counts(units: DataFrame, pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Units by arm, pairs, unpaired, holdout and distinct replicates per group ``by``."""
    u = units if by else units.withColumn("scope", F.lit("all"))
    p = pairs if by else pairs.withColumn("scope", F.lit("all"))
    key = by or ["scope"]
    of_units = u.groupBy(*key).agg(
        F.count(F.lit(1)).alias("included_units"),
        F.count_if(F.col("arm") == "baseline").alias("baseline_units"),
        F.count_if(F.col("arm") == "intervention").alias("intervention_units"),
        F.count_if("holdout").alias("holdout_units"),
        F.count_distinct("participant").alias("participants"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("block_id").alias("blocks"),
    )
    of_pairs = p.groupBy(*key).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("cluster_id").alias("clusters"))
    zero = F.lit(0).cast("long")
    return (
        of_units.join(of_pairs, key, "left")
        .withColumns({"pairs": F.coalesce("pairs", zero), "clusters": F.coalesce("clusters", zero)})
        .withColumn("unpaired_units", F.col("included_units") - F.col("pairs") * 2)
    )


def audit_values(units: DataFrame, pairs: DataFrame, unpaired: DataFrame, formed: DataFrame, counts: DataFrame,
                 keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """What an evidence set states against what its own sources give anew: (check, subject, detail).

    ``formed`` are the units made from the source records (``form_units``: ``keys``, value, records, used),
    ``unpaired`` and ``counts`` what the set says of both (``unpaired_units``; one row of ``evidence_counts``).
    Stated and recomputed units meet in one full join, in which a difference is found on either side; units, pairs and
    unpaired units meet in one aggregation by unit. So nothing is scanned per check. Values differ
    when they are more than ``tolerance`` apart, relative to the larger one, or one of them is null.
    """
    def differ(stated: Column, found: Column) -> Column:
        room = F.lit(tolerance) * F.greatest(F.abs(stated), F.abs(found), F.lit(1.0))
        return (stated.isNull() != found.isNull()) | F.coalesce(F.abs(stated - found) > room, F.lit(False))

    def problem(check: str, subject: Column, detail: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))

    facts = ("value", "records", "used")
    stated = units.select(F.struct(*keys).alias("_key"), "unit_id", *facts, F.lit(True).alias("_stated"))
    found = formed.filter(F.col("exit_stage").isNull()).select(
        F.struct(*keys).alias("_key"), *[F.col(f).alias(f"_f_{f}") for f in facts], F.lit(True).alias("_found"))
    named = F.coalesce("unit_id", F.concat_ws("|", *[F.col("_key")[k].cast("string") for k in keys]))
    both = F.col("_stated").isNotNull() & F.col("_found").isNotNull()
    of_units = stated.join(found, "_key", "full_outer").select(F.explode(F.array_compact(F.array(
        F.when(F.col("_found").isNull(), problem("unit_without_source", named, F.col("value"))),
        F.when(F.col("_stated").isNull(), problem("unit_left_out", named, F.col("_f_value"))),
        F.when(both & differ(F.col("value"), F.col("_f_value")),
               problem("value_not_recomputed", named, F.concat_ws("/", "value", "_f_value"))),
        F.when(both & ~(F.col("records").eqNullSafe(F.col("_f_records")) & F.col("used").eqNullSafe(F.col("_f_used"))),
               problem("record_counts_not_recomputed", named, F.concat_ws("/", "records", "_f_records", "used", "_f_used")))))).alias("p")).select("p.*")

    none = F.lit(None)
    role = "struct<unit_id:string,role:string,value:double,arm:string,pair_id:string>"
    places = units.select(F.struct("unit_id", F.lit("unit"), F.col("value").cast("double"), "arm", none).cast(role).alias("r")).unionByName(
        unpaired.select(F.struct("unit_id", F.lit("unpaired"), none, "arm", none).cast(role).alias("r"))).unionByName(
        pairs.select(F.explode(F.array(
            F.struct("baseline_unit_id", F.lit("pair"), "baseline_value", F.lit("baseline"), "pair_id").cast(role),
            F.struct("intervention_unit_id", F.lit("pair"), "intervention_value", F.lit("intervention"), "pair_id").cast(role)))
            .alias("r"))).select("r.*")
    is_unit, is_pair = F.col("role") == "unit", F.col("role") == "pair"
    met = places.groupBy("unit_id").agg(
        F.count_if(is_unit).alias("units"), F.count_if(is_pair).alias("paired"), F.count_if(F.col("role") == "unpaired").alias("unpaired"),
        F.max(F.when(is_unit, F.col("value"))).alias("own"), F.min(F.when(is_pair, F.col("value"))).alias("low"),
        F.max(F.when(is_pair, F.col("value"))).alias("high"), F.max(F.when(is_unit, F.col("arm"))).alias("arm"),
        F.min(F.when(~is_unit, F.col("arm"))).alias("first_arm"), F.max(F.when(~is_unit, F.col("arm"))).alias("last_arm"))
    subject, paired = F.col("unit_id"), F.col("paired") > 0
    of_places = met.select(F.explode(F.array_compact(F.array(
        F.when((F.col("units") > 0) & (F.col("paired") + F.col("unpaired") != 1),
               problem("unit_neither_or_twice_paired", subject, F.concat_ws("/", "paired", "unpaired"))),
        F.when((F.col("units") == 0), problem("unknown_unit", subject, F.concat_ws("/", "paired", "unpaired"))),
        F.when((F.col("units") > 0) & paired & (differ(F.col("low"), F.col("own")) | differ(F.col("high"), F.col("own"))),
               problem("pair_value_differs", subject, F.concat_ws("/", "own", "low", "high"))),
        F.when((F.col("units") > 0) & ((F.col("first_arm") != F.col("arm")) | (F.col("last_arm") != F.col("arm"))),
               problem("arm_differs", subject, F.col("arm")))))).alias("p")).select("p.*")

    wrong = differ(F.col("difference"), F.col("intervention_value") - F.col("baseline_value"))
    of_pairs = pairs.filter(wrong).select(problem("difference_not_recomputed", F.col("pair_id"), F.col("difference")).alias("p")).select("p.*")

    names = ("included_units", "baseline_units", "intervention_units", "holdout_units", "pairs", "unpaired_units")
    anew = units.agg(
        F.count(F.lit(1)).alias("included_units"), F.count_if(F.col("arm") == "baseline").alias("baseline_units"),
        F.count_if(F.col("arm") == "intervention").alias("intervention_units"), F.count_if("holdout").alias("holdout_units"))
    sizes = anew.withColumn("_one", F.lit(1)).join(pairs.agg(F.count(F.lit(1)).alias("pairs")).withColumn("_one", F.lit(1)), "_one") \
        .join(unpaired.agg(F.count(F.lit(1)).alias("unpaired_units")).withColumn("_one", F.lit(1)), "_one")
    said = counts.select(*[F.col(n).alias(f"_s_{n}") for n in names], F.lit(1).alias("_one"))
    of_counts = sizes.join(said, "_one", "left").select(F.explode(F.array_compact(F.array(*[
        F.when(~F.col(n).eqNullSafe(F.col(f"_s_{n}")), problem("count_differs", F.lit(n), F.concat_ws("/", f"_s_{n}", n)))
        for n in names]))).alias("p")).select("p.*")
    return of_units.unionByName(of_places).unionByName(of_pairs).unionByName(of_counts)


def audit_evidence(units: DataFrame, pairs: DataFrame, funnel: DataFrame) -> DataFrame:
    """Violations of the evidence set's own invariants: (check, subject, detail)."""
    def rows(df: DataFrame, check: str, subject: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"),
                         detail.cast("string").alias("detail"))

    members = pairs.select("pair_id", F.explode(F.array("baseline_unit_id", "intervention_unit_id")).alias("unit_id"))
    w = Window.partitionBy("level").orderBy("step")
    broken = funnel.withColumn("_prev", F.lag("remaining").over(w)).filter(
        (F.col("_prev").isNotNull() & (F.col("_prev") != F.col("considered")))
        | (F.col("considered") - F.col("excluded") != F.col("remaining")) | (F.col("excluded") < 0))
    checks = [
        rows(units.groupBy("unit_id").count().filter("count > 1"), "duplicate_unit", F.col("unit_id"), F.col("count")),
        rows(pairs.groupBy("pair_id").count().filter("count > 1"), "duplicate_pair", F.col("pair_id"), F.col("count")),
        rows(members.groupBy("unit_id").count().filter("count > 1"), "unit_in_two_pairs",
             F.col("unit_id"), F.col("count")),
        rows(members.join(units, "unit_id", "left_anti"), "pair_of_unknown_unit", F.col("unit_id"), F.col("pair_id")),
        rows(units.filter("used + missing > records or used < 0"), "source_record_counts",
             F.col("unit_id"), F.concat_ws("/", "used", "missing", "records")),
        rows(broken, "funnel_discontinuity", F.col("stage"), F.col("considered")),
        rows(funnel.filter("disposition = 'not_permitted'"), "exclusion_without_rule",
             F.col("stage"), F.col("excluded")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
