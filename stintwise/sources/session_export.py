"""Distance-binned session export: lap table, bin table and findings document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.functions.cells import finite, strict_boolean, unsigned
from stintwise.functions.qualified import fields, qualified
from stintwise.operators.normalize import number_sequence, unite
from stintwise.operators.spread import UNKNOWN, Scale, by_key, lookup_join
from stintwise.sources.files import read_text_table
from stintwise.sources.quarantine import accepted, with_problems

# The header of the lap table, in order.
LAP_COLUMNS = [
    "lap_number", "lap_time_seconds", "lap_time_display", "is_best_valid_lap", "is_reviewed_lap", "is_valid",
    "is_reference", "exclusion_reasons", "lap_kind", "stint", "laps_since_pit_exit", "sampled_bins", "total_bins",
    "coverage_fraction", "coaching_delivered_on_lap", "delivered_cue_count",
]
# The header of the bin table, in order.
BIN_COLUMNS = [
    "lap_number", "distance_m", "lap_fraction", "brake", "throttle", "steering_rad", "steering_deg", "speed_ms",
    "speed_kph", "sample_count", "has_sample", "lap_is_valid", "lap_is_reference", "lap_is_excluded",
    "lap_exclusion_reason", "lap_kind", "stint", "incident_on_lap", "in_finding_region", "finding_keys",
]
# Which of them hold counts, flags and text.
UNSIGNED = {"lap_number", "stint", "laps_since_pit_exit", "sampled_bins", "total_bins", "delivered_cue_count",
            "sample_count"}
FLAGS = {"is_best_valid_lap", "is_reviewed_lap", "is_valid", "is_reference", "coaching_delivered_on_lap", "has_sample",
         "lap_is_valid", "lap_is_reference", "lap_is_excluded", "incident_on_lap", "in_finding_region"}
TEXT = {"lap_time_display", "exclusion_reasons", "lap_kind", "lap_exclusion_reason", "finding_keys"}
# How each binned channel was aggregated at the source.
CHANNEL_METHODS = {"brake": "maximum", "throttle": "arithmetic_mean", "steering_angle": "arithmetic_mean",
                   "speed": "arithmetic_mean"}
CHANNEL_SOURCE = {"brake": "brake", "throttle": "throttle", "steering_angle": "steering_rad", "speed": "speed_ms"}

# The fields of the findings document.
FINDINGS_SCHEMA = (
    "schema STRING, productVersion STRING, referencePolicy STRING, timeDeltaConvention STRING, "
    "session STRUCT<simulator: STRING, car: STRING, track: STRING, sessionType: STRING, recordedLocal: STRING, "
    "durationSeconds: DOUBLE, trackLengthMeters: DOUBLE, reviewedLapNumber: INT, comparableLapCount: INT, "
    "comparableLapNumbers: ARRAY<INT>, bestValidLapNumber: INT, bestValidLapTimeSeconds: DOUBLE, "
    "driverDisplayName: STRING>, "
    "findings ARRAY<STRUCT<key: STRING, rank: INT, channel: STRING, findingType: STRING, lapNumber: INT, "
    "startDistanceMeters: DOUBLE, endDistanceMeters: DOUBLE, startLapFraction: DOUBLE, endLapFraction: DOUBLE, "
    "locationLabel: STRING, observedValue: DOUBLE, referenceValue: DOUBLE, referenceSpread: DOUBLE, "
    "measurementUnit: STRING, direction: STRING, confidence: DOUBLE, confidenceBand: STRING, severitySigma: DOUBLE, "
    "repeatability: DOUBLE, cleanComparisonLapCount: INT, coverage: DOUBLE, performanceVerdict: STRING, "
    "timeDeltaSeconds: DOUBLE, timeDeltaUnavailableReason: STRING, recommendedAction: STRING, "
    "limitations: ARRAY<STRING>, attributionState: STRING, attribution: STRING, deterministicExplanation: STRING, "
    "aiExplanation: STRING, aiExplanationSource: STRING, aiFallbackCategory: STRING>>")


#: Columns that may be empty.
OPTIONAL = {"lap_time_seconds", "laps_since_pit_exit", "brake", "throttle", "steering_rad", "steering_deg", "speed_ms", "speed_kph"}


def _typed(columns: list[str]) -> dict[str, Column]:
    return {c: (unsigned(F.col(c)) if c in UNSIGNED else strict_boolean(F.col(c)) if c in FLAGS else finite(F.col(c)))
            for c in columns if c not in TEXT}


def _required(columns: list[str]) -> set[str]:
    return {c for c in columns if c not in TEXT and c not in OPTIONAL}


def lap_rules() -> dict[str, Column]:
    """Rules of a lap on its own."""
    share = F.col("sampled_bins") / F.when(F.col("total_bins") > 0, F.col("total_bins"))
    return {"total_bins.positive": F.col("total_bins") >= 1,
            "coverage_fraction.share": F.abs(F.col("coverage_fraction") - share) <= 0.00005,
            "exclusion_reasons.valid_lap": ~F.col("is_valid") | (F.coalesce("exclusion_reasons", F.lit("")) == ""),
            "is_reference.invalid_lap": ~F.col("is_reference") | F.col("is_valid"),
            "is_best_valid_lap.invalid_lap": ~F.col("is_best_valid_lap") | F.col("is_valid")}


def check_laps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Text rows of lap tables with typed cells and ``problems``; a lap number that a key has twice is one for all its rows."""
    typed = with_problems(rows, _typed(LAP_COLUMNS), _required(LAP_COLUMNS), lap_rules())
    twice = typed.where("lap_number is not null").groupBy(*keys, "lap_number").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return by_key(typed, twice, [*keys, "lap_number"], "left").withColumn(
        "problems", F.when(F.col("_n") > 1, F.array_append("problems", F.lit("lap_number.duplicate"))).otherwise(F.col("problems"))).drop("_n")


def read_laps(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """The lap table, typed; header enforced. A row with a problem fails the job, or with ``quarantine`` carries
    its codes in ``problems``."""
    checked = check_laps(read_text_table(spark, path, LAP_COLUMNS, quarantine=quarantine), ["_file"])
    names = [*LAP_COLUMNS, *["problems", "_file", "_line"] * quarantine]
    return (checked if quarantine else accepted(checked, path)).select(*names)


def read_bins(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """The bin table, typed, in the same way."""
    checked = with_problems(read_text_table(spark, path, BIN_COLUMNS, quarantine=quarantine), _typed(BIN_COLUMNS), _required(BIN_COLUMNS))
    names = [*BIN_COLUMNS, *["problems", "_file", "_line"] * quarantine]
    return (checked if quarantine else accepted(checked, path)).select(*names)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings as rows beside their session attributes."""
    document = spark.read.schema(FINDINGS_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    return document.select("session", F.explode("findings").alias("f")).select("session.*", "f.*")


def lap_records(laps: DataFrame, dataset_id: str, session_id: str) -> DataFrame:
    """Lap records with time and validity."""
    return laps.select(
        F.lit("lap").alias("record_type"), F.lit(dataset_id).alias("dataset_id"), F.lit(session_id).alias("session_id"),
        F.format_string(f"{session_id}-lap-%06d", "lap_number").alias("lap_id"),
        F.format_string(f"{session_id}-lap-%06d", "lap_number").alias("record_id"),
        F.col("lap_number").cast("int").alias("lap_number"),
        F.when(~F.col("is_valid"), F.array(F.lit("product_classified_excluded"))).otherwise(
            F.array().cast("array<string>")).alias("quality_flags"),
        fields(
            lap_time=qualified(F.col("lap_time_seconds"), "lap_time", "laps.csv/lap_time_seconds",
                               derivation="lap time as the export states it"),
            lap_valid=qualified(F.col("is_valid"), "lap_valid", "laps.csv/is_valid",
                                derivation="validity as the export states it"),
        ).alias("fields"))


def bin_records(bins: DataFrame, laps: DataFrame, dataset_id: str, session_id: str, scale: Scale = UNKNOWN) -> DataFrame:
    """One record per metre; an unsampled bin keeps its channels as unavailable, never zero."""
    valid = laps.select("lap_number", F.col("is_valid").alias("_lap_valid"))
    rows = lookup_join(bins, valid, ["lap_number"], "left", [F.col("distance_m")], scale)
    channels = {
        concept: qualified(F.when(F.col("has_sample"), F.col(column)), concept, f"telemetry.csv/{column}",
                           derivation=f"one-metre bin {CHANNEL_METHODS[concept]}")
        for concept, column in CHANNEL_SOURCE.items()}
    return rows.select(
        F.lit("distance_bin").alias("record_type"), F.lit(dataset_id).alias("dataset_id"),
        F.lit(session_id).alias("session_id"), F.col("lap_number").cast("int").alias("lap_number"),
        F.format_string(f"{session_id}-lap-%06d", "lap_number").alias("lap_id"),
        F.format_string(f"{session_id}-lap-%06d-bin-%06d", "lap_number", F.col("distance_m").cast("long")).alias("record_id"),
        F.floor("distance_m").cast("int").alias("distance_bin_index"), F.col("distance_m").alias("distance_start_m"),
        (F.col("distance_m") + 1).alias("distance_end_m"), F.col("sample_count").cast("int").alias("sample_count"),
        "has_sample",
        F.struct(F.lit("distance_binned_aggregate").alias("source_semantics"), F.lit(1.0).alias("distance_bin_width_m"),
                 F.create_map(*[F.lit(x) for kv in CHANNEL_METHODS.items() for x in kv]).alias("channel_methods"),
                 ).alias("aggregation"),
        F.array_compact(F.array(F.when(~F.col("has_sample"), "source_bin_unsampled"),
                                F.when(~F.col("_lap_valid"), "product_classified_excluded"))).alias("quality_flags"),
        fields(
            lap_distance=qualified(F.col("distance_m"), "lap_distance", "telemetry.csv/distance_m",
                                   derivation="start of the bin in metres"),
            lap_fraction=qualified(F.col("lap_fraction"), "lap_fraction", "telemetry.csv/lap_fraction",
                                   derivation="fraction as the export states it"), **channels).alias("fields"))


def records(laps: DataFrame, bins: DataFrame, session: dict[str, str], scale: Scale = UNKNOWN) -> DataFrame:
    """All records of one export: session, laps, bins, numbered."""
    ids = (session["dataset_id"], session["session_id"])
    head = laps.sparkSession.range(1).select(
        *[F.lit(v).alias(k) for k, v in session.items()], F.lit("session").alias("record_type"),
        F.lit(session["session_id"]).alias("record_id"))
    everything = unite([head, lap_records(laps, *ids), bin_records(bins, laps, *ids, scale)])
    # Laps come before all bins; both in lap order.
    stage = F.when(F.col("record_type") == "session", 0).when(F.col("record_type") == "lap", 1).otherwise(2)
    return number_sequence(
        everything.withColumn("_stage", stage).withColumn("_lap", F.coalesce("lap_number", F.lit(-1))).withColumn(
            "_bin", F.coalesce("distance_bin_index", F.lit(-1))), ["_stage", "_lap", "_bin"], scale,
    ).drop("_stage", "_lap", "_bin")
