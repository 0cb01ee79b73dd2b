"""File inventories and text readers shared by the source profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintwise.operators.spread import UNKNOWN, Scale, position_in


# The fields of an event.
EVENT_FIELDS = ("schema_version", "sequence", "observed_utc", "session_time_s", "kind", "data")


def read_text_table(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", quarantine: bool = False) -> DataFrame:
    """A CSV whose header must be exactly ``columns``; every cell stays text, blanks are ''.

    The header is compared by Spark itself and a row of the wrong width fails the job; with ``quarantine`` its
    line stands in ``_corrupt`` instead, which is null for all other rows.
    ``_file`` and ``_block`` say where in the input a row comes from.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, *["_corrupt"] * quarantine]])
    # Width is checked over all cells, so all of them are parsed.
    rows = spark.read.option("columnPruning", "false").csv(path, schema=schema, header=True, sep=delimiter, enforceSchema=False,
                          mode="PERMISSIVE" if quarantine else "FAILFAST", columnNameOfCorruptRecord="_corrupt",
                          nullValue="\u0000", emptyValue="", encoding="UTF-8")
    return rows.select(*["_corrupt"] * quarantine, *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns],
                       F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_line"))


def read_mapped_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A CSV with its own header, all cells text; only the header line is looked at early."""
    head = spark.read.text(path).select(F.trim(F.regexp_replace("value", "﻿", ""))).first()
    if head is None:
        raise ValueError(f"{path}: no header")
    return read_text_table(spark, path, head[0].split(delimiter), delimiter)


def with_row_number(rows: DataFrame, name: str = "row_index", scale: Scale = UNKNOWN) -> DataFrame:
    """0-based number of each row in its file.

    Blocks of a file are ordered by their offset; within a block the rows were read in order,
    so (block, line id) is the order of the file however it was split.
    """
    return position_in(rows, ["_file"], ["_block", "_line"], name, scale)


def event_lines(lines: DataFrame, version: str, column: str = "value") -> DataFrame:
    """Events out of JSON text: ``column`` gives way to the event's fields, its ``data`` as VARIANT, and ``problem``.

    An event has exactly the fields of EVENT_FIELDS. Problems, the first that applies (null for a sound event, whose
    fields alone are filled): not_json, shape, version, sequence, session_time, kind, data. Null text is not_json. Other columns stay.
    """
    # As generated columns, so that conditions on the problem stay above the parsing instead of repeating it.
    held = lines.select("*", F.explode(F.array(F.try_parse_json(column))).alias("_event")).select(
        "*", F.explode(F.array(F.try_variant_get("_event", "$", "map<string,variant>"))).alias("_cells"))

    def cell(name: str) -> Column:
        return F.try_element_at("_cells", F.lit(name))

    def kind(name: str) -> Column:
        # JSON's null, an absent field and a field of another type are told apart by the type's name.
        return F.coalesce(F.schema_of_variant(cell(name)), F.lit("absent"))

    def text(name: str) -> Column:
        return F.try_variant_get(cell(name), "$", "string")

    fields = F.coalesce(F.sort_array(F.map_keys("_cells")), F.array().cast("array<string>"))
    problem = F.when(F.col("_event").isNull(), "not_json").when(
        fields != F.array(*[F.lit(c) for c in sorted(EVENT_FIELDS)]), "shape").when(
        (kind("schema_version") != "STRING") | (text("schema_version") != version), "version").when(
        (kind("sequence") != "BIGINT") | (F.try_variant_get(cell("sequence"), "$", "bigint") < 0), "sequence").when(
        ~kind("session_time_s").rlike("^(VOID|BIGINT|DOUBLE|DECIMAL.*)$"), "session_time").when(
        (kind("kind") != "STRING") | (text("kind") == ""), "kind").when(~kind("data").startswith("OBJECT"), "data")
    sound = F.col("problem").isNull()
    return held.select("*", F.explode(F.array(problem)).alias("problem")).select(
        *[c for c in lines.columns if c != column], F.when(sound, text("schema_version")).alias("schema_version"),
        F.when(sound, F.try_variant_get(cell("sequence"), "$", "bigint")).alias("sequence"),
        F.when(sound, text("observed_utc")).alias("observed_utc"),
        F.when(sound, F.try_variant_get(cell("session_time_s"), "$", "double")).alias("session_time_s"),
        F.when(sound, text("kind")).alias("kind"), F.when(sound, cell("data")).alias("data"), "problem")


def payload(path: str, kind: str, column: str = "data") -> Column:
    """One typed value of an event's VARIANT payload; null where it is absent or of another type."""
    return F.try_variant_get(column, path, kind)


def read_event_lines(spark: SparkSession, path: str, version: str, quarantine: bool = False) -> DataFrame:
    """JSON lines of an event log, see ``event_lines``. A bad line fails the job; with ``quarantine`` it stays, with its problem."""
    found = event_lines(spark.read.text(path), version)
    if quarantine:
        return found
    refusal = F.raise_error(F.concat(F.lit("event log: "), F.col("problem"))).cast("boolean")
    # A condition, unlike a column, is not pruned.
    return found.where(F.when(F.col("problem").isNotNull(), refusal).otherwise(True)).drop("problem")


def reconcile_inventory(declared: DataFrame, actual: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Declared against actual files: missing, undeclared, size_mismatch, hash_mismatch or ok.

    Both sides: keys, path, length, sha256.
    """
    on = [*(keys or []), "path"]
    a = declared.select(*on, F.col("length").alias("declared_length"), F.col("sha256").alias("_ds"))
    b = actual.select(*on, F.col("length").alias("actual_length"), F.col("sha256").alias("_as"))
    status = F.when(F.col("_as").isNull(), "missing").when(F.col("_ds").isNull(), "undeclared").when(
        F.col("declared_length") != F.col("actual_length"), "size_mismatch").when(
        F.col("_ds") != F.col("_as"), "hash_mismatch").otherwise("ok")
    return a.join(b, on, "full_outer").select(*on, "declared_length", "actual_length", status.alias("status"))
