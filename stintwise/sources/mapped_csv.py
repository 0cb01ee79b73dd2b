"""Mapped CSV: any delimiter, each column assigned to a concept by a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.operators.normalize import ColumnMapping, laps_of, mapped_fields, number_sequence, unite
from stintwise.operators.spread import UNKNOWN, Scale
from stintwise.sources.files import read_mapped_table, with_row_number
from stintwise.sources.quarantine import accepted, mapped_problems


def check_mapping(mappings: list[ColumnMapping]) -> None:
    """A mapping names each concept once and has exactly one time column."""
    concepts = [m.concept for m in mappings]
    if len(set(concepts)) != len(concepts):
        raise ValueError("a concept is mapped twice")
    if concepts.count("timestamp") != 1:
        raise ValueError("exactly one column must carry the timestamp")
    for m in mappings:
        if m.provenance in ("derived", "estimated") and m.derivation is None:
            raise ValueError(f"{m.column}: {m.provenance} needs a derivation")


def records_from_rows(
    rows: DataFrame, mappings: list[ColumnMapping], lap_column: str, session: dict[str, str],
    scale: Scale = UNKNOWN, refuse: bool = True,
) -> DataFrame:
    """Session, lap and sample records of text rows that carry ``row_index``.

    A cell that does not parse and a lap that is unreadable, negative, out of order or back again fail the
    job. Without ``refuse`` such cells are null and rows without a lap belong to none; rows to be set apart
    are found by ``mapped_problems`` before.
    """
    check_mapping(mappings)
    missing = {m.column for m in mappings} | {lap_column}
    missing -= set(rows.columns)
    if missing:
        raise ValueError(f"columns not in the source: {sorted(missing)}")
    if refuse:
        rows = accepted(mapped_problems(rows.withColumn("_source", F.lit(0)), mappings, lap_column, ["_source"], scale), "mapped rows").drop("_source")
    ids = {k: F.lit(v) for k, v in session.items() if k in ("dataset_id", "session_id")}
    lap = F.col(f"`{lap_column}`").try_cast("int")
    time_column = next(m.column for m in mappings if m.concept == "timestamp")
    samples = rows.withColumns({**ids, "lap_number": lap}).select(
        "dataset_id", "session_id", F.lit("telemetry_sample").alias("record_type"), "lap_number",
        F.when(F.col("lap_number").isNotNull(), F.format_string("%s.lap-%03d", "session_id", "lap_number")).alias("lap_id"),
        F.format_string("%s.sample-%06d", "session_id", "row_index").alias("record_id"),
        F.col("row_index").alias("sample_index"), mapped_fields(mappings).alias("fields"),
        F.struct((F.col("row_index") + 2).alias("row_start"), (F.col("row_index") + 2).alias("row_end"),
                 F.col(f"`{time_column}`").alias("source_timestamp")).alias("source_provenance"))
    head = rows.sparkSession.range(1).select(
        *[F.lit(v).alias(k) for k, v in session.items()], F.lit("session").alias("record_type"),
        F.concat(F.lit(session["session_id"]), F.lit(".session")).alias("record_id"), F.lit(-1).cast("long").alias("sample_index"))
    everything = unite([head, laps_of(samples, [], "sample_index"), samples])
    numbered = number_sequence(everything, ["sample_index"], scale)
    return numbered.withColumn("sample_index", F.when(F.col("record_type") == "telemetry_sample", F.col("sample_index")))


def read_mapped_csv(
    spark: SparkSession, path: str, mappings: list[ColumnMapping], lap_column: str, session: dict[str, str],
    delimiter: str = ",", scale: Scale = UNKNOWN, refuse: bool = True,
) -> DataFrame:
    """Records of one mapped CSV file."""
    rows = with_row_number(read_mapped_table(spark, path, delimiter), "row_index", scale)
    return records_from_rows(rows, mappings, lap_column, session, scale, refuse)
