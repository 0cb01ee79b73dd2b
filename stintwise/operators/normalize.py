"""From typed source rows to records of the common model."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintwise.functions.cells import bad_cell, concept_cell
from stintwise.functions.qualified import fields, qualified
from stintwise.operators.spread import UNKNOWN, Scale, lookup_join, position_in
from stintwise.schema import RECORD
from stintwise.vocabulary import CONCEPT_UNITS

MONOTONIC = "normalized_monotonic_time"
# Order of record types at one place of the sequence, containers first.
TYPE_RANK = {"session": 0, "lap": 1, "segment": 2, "telemetry_sample": 3, "distance_bin": 3, "driver_input_event": 3}


@dataclass(frozen=True)
class ColumnMapping:
    """One source column: the concept it carries and how it came to be."""

    column: str
    concept: str
    provenance: str = "measured"
    derivation: str | None = None


def mapped_value(text: Column, mapping: ColumnMapping) -> Column:
    """Qualified value of a text cell; a blank is unavailable and flagged as such."""
    parsed = concept_cell(text, mapping.concept)
    value = qualified(parsed, mapping.concept, mapping.column, derivation=mapping.derivation,
                      provenance=mapping.provenance)
    value = value.withField("source_channel", F.lit(mapping.column)).withField(
        "quality_flags", F.when(parsed.isNull(), F.array(F.lit("missing_source_value"))))
    return value.withField("reference", F.lit(MONOTONIC)) if mapping.concept == "timestamp" else value


def mapped_fields(mappings: list[ColumnMapping]) -> Column:
    return fields(**{m.concept: mapped_value(F.col(f"`{m.column}`"), m) for m in mappings})


def bad_cells(rows: DataFrame, mappings: list[ColumnMapping], subject: list[str]) -> DataFrame:
    """(subject, column, text) for every non-empty cell that does not parse."""
    found = F.array_compact(F.array(*[
        F.when(bad_cell(F.col(f"`{m.column}`"), m.concept),
               F.struct(F.lit(m.column).alias("column"), F.col(f"`{m.column}`").alias("text"))) for m in mappings]))
    # A filter on the list would be moved below the parsing of the cells, and repeat it for every use of a cell.
    return rows.select(*subject, F.inline(found))


def laps_of(samples: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One lap record per lap, standing where its first sample stands."""
    return samples.groupBy("dataset_id", "session_id", *keys, "lap_id", "lap_number").agg(
        F.min(position).alias(position)).withColumn("record_type", F.lit("lap")).withColumn("record_id", F.col("lap_id"))


def unite(parts: list[DataFrame]) -> DataFrame:
    """Union of record types with different columns; missing ones become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def number_sequence(records: DataFrame, position: list[str], scale: Scale = UNKNOWN) -> DataFrame:
    """Dense ``sequence_index`` per dataset: by position, containers before what they hold."""
    rank = F.element_at(F.create_map(*[x for k, v in TYPE_RANK.items() for x in (F.lit(k), F.lit(v))]),
                        F.col("record_type"))
    return position_in(records.withColumn("_rank", rank), ["dataset_id"], [*position, "_rank", "record_id"],
                       "sequence_index", scale).drop("_rank")


def _widen(records: DataFrame, name: str) -> Column:
    """A column of the contract; members a narrower struct lacks become null."""
    field = RECORD[name]
    if name not in records.columns:
        return F.lit(None).cast(field.dataType)
    have = records.schema[name].dataType
    if not isinstance(have, T.StructType):
        return F.col(name).cast(field.dataType)
    members = set(have.fieldNames())
    whole = F.struct(*[
        (F.col(name)[m.name] if m.name in members else F.lit(None)).cast(m.dataType).alias(m.name)
        for m in field.dataType.fields])
    return F.when(F.col(name).isNotNull(), whole)


def conform(records: DataFrame) -> DataFrame:
    """Give records every column and concept of the full contract, in contract order."""
    return records.select(*[_widen(records, f.name).alias(f.name) for f in RECORD.fields])


def unmapped_columns(header: Column, mapped: list[str]) -> Column:
    """Sorted source columns that no mapping uses."""
    return F.array_sort(F.array_except(header, F.array(*[F.lit(c) for c in mapped])))


def decode_enum(rows: DataFrame, dictionary: DataFrame, keys: list[str], code: str, meaning: str,
                scale: Scale = UNKNOWN) -> DataFrame:
    """Add ``decoded``: the declared meaning of a code; null without a dictionary entry.

    ``dictionary`` holds keys, code and meaning.
    """
    return lookup_join(rows, dictionary.select(*keys, code, F.col(meaning).alias("decoded")), [*keys, code], "left",
                       None, scale)


def enum_state(decoded: Column, wanted: str, concept: str, derivation: str) -> Column:
    """Boolean concept resolved through a dictionary; unknown codes stay unavailable."""
    return qualified(decoded == wanted, concept, None, derivation=derivation)


def enum_dictionary_problems(dictionaries: DataFrame) -> DataFrame:
    """Dictionaries that break the rules for declared enumerations.

    Columns: column, enumeration, kind, dictionary_provenance, unknown_value_behavior,
    limitation, values (map or null).
    """
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in (
        "enumeration", "kind", "dictionary_provenance", "unknown_value_behavior", "limitation")]) == 1
    problem = F.when(missing, "missing_semantics").when(
        ~F.col("dictionary_provenance").isin("product_declared", "sdk_variable_description", "unavailable"),
        "unsupported_provenance").when(
        F.col("unknown_value_behavior") != "preserve_raw_value", "does_not_preserve_unknown").when(
        (F.col("dictionary_provenance") == "unavailable") & F.col("values").isNotNull(), "values_without_provenance").when(
        (F.col("dictionary_provenance") != "unavailable") & (F.coalesce(F.size("values"), F.lit(0)) <= 0),
        "provenance_without_values")
    return dictionaries.withColumn("problem", problem).filter("problem is not null")


def capability_rows(mappings: list[ColumnMapping]) -> Column:
    """The capability table as an array column, to be inlined beside any dataset."""
    by_concept = {m.concept: m for m in mappings}
    rows = []
    for concept, unit in CONCEPT_UNITS.items():
        m = by_concept.get(concept)
        cells = {"concept": concept, "provenance": m.provenance if m else "unavailable", "unit": unit,
                 "source_channel": m.column if m else None, "derivation": m.derivation if m else None}
        rows.append(F.struct(*[F.lit(v).cast("string").alias(k) for k, v in cells.items()]))
    return F.array(*rows)


def capability_summary(capabilities: DataFrame, keys: list[str]) -> DataFrame:
    """Available concepts (sorted) and the number of unavailable ones; 41 rows per key at most."""
    known = F.col("provenance") != "unavailable"
    return capabilities.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(known, F.col("concept")))).alias("available"),
        F.count_if(~known).alias("unavailable_count"))


def source_identity(source_files: DataFrame, file_name: str) -> DataFrame:
    """Identity of a dataset = hash of one named source file; null if absent, problem if repeated.

    ``source_files``: dataset_id, path, sha256.
    """
    mine = F.col("path") == file_name
    return source_files.groupBy("dataset_id").agg(
        F.count_if(mine).alias("_n"), F.min(F.when(mine, F.concat(F.lit("sha256:"), "sha256"))).alias("identity"),
    ).select("dataset_id", F.when(F.col("_n") == 1, F.col("identity")).alias("identity"),
             F.when(F.col("_n") > 1, "duplicate_identity_source").alias("problem"))
