"""Stored records: JSON lines in, Parquet out and in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stintwise.operators.normalize import conform
from stintwise.schema import RECORD


def read_record_lines(spark: SparkSession, path: str) -> DataFrame:
    """Normalized records stored as JSON lines, against the full contract."""
    return spark.read.schema(RECORD).json(path, mode="FAILFAST")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records written by ``write_records``."""
    return spark.read.schema(RECORD).parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Write records as Parquet, one folder per record type; refuses to overwrite.

    Partitioning by record type lets a reader of samples skip everything else; dataset ids
    are too many (and too unequal) to be folders, so rows are clustered by them instead.
    """
    conform(records).sortWithinPartitions("dataset_id", "sequence_index").write.mode("errorifexists").partitionBy(
        "record_type").parquet(path)


def write_record_lines(records: DataFrame, path: str) -> None:
    """The same as JSON lines."""
    conform(records).write.mode("errorifexists").json(path)
