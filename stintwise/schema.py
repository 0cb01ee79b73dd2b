"""Record model as explicit Spark types.

``fields`` is a struct with one member per concept rather than a map: a query on one
concept then reads one Parquet column, and every value has its own type. Nullness has three
states: member null = absent, ``provenance = 'unavailable'`` = known to be missing,
anything else = a real value (zero included).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintwise.vocabulary import CONCEPT_UNITS, value_type

_TYPES = {"boolean": T.BooleanType(), "string": T.StringType(), "double": T.DoubleType()}


def qualified_type(concept: str) -> T.StructType:
    """Type of one qualified value."""
    return T.StructType([
        T.StructField("value", _TYPES[value_type(concept)]),
        T.StructField("provenance", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("source_channel", T.StringType()),
        T.StructField("derivation", T.StringType()),
        T.StructField("quality_flags", T.ArrayType(T.StringType())),
        T.StructField("reference", T.StringType()),
    ])


SOURCE_PROVENANCE = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("source_file_sha256", T.StringType()),
    T.StructField("adapter_id", T.StringType()),
    T.StructField("adapter_version", T.StringType()),
    T.StructField("row_start", T.LongType()),
    T.StructField("row_end", T.LongType()),
    T.StructField("source_record_id", T.StringType()),
    T.StructField("source_timestamp", T.StringType()),
])

FIELDS = T.StructType([T.StructField(c, qualified_type(c)) for c in CONCEPT_UNITS])

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_type", "dataset_id", "session_id", "record_id")]
    + [T.StructField("sequence_index", T.LongType()), T.StructField("source_provenance", SOURCE_PROVENANCE)]
    + [T.StructField(n, T.StringType()) for n in ("simulator", "driver_id", "car", "track", "layout", "lap_id")]
    + [T.StructField("lap_number", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("segment_id", "segment_kind", "label")]
    + [T.StructField("sample_index", T.LongType()), T.StructField("event_type", T.StringType()),
       T.StructField("distance_bin_index", T.IntegerType()), T.StructField("sample_count", T.IntegerType()),
       T.StructField("distance_start_m", T.DoubleType()), T.StructField("distance_end_m", T.DoubleType()),
       T.StructField("has_sample", T.BooleanType()),
       T.StructField("aggregation", T.StructType([
           T.StructField("source_semantics", T.StringType()),
           T.StructField("distance_bin_width_m", T.DoubleType()),
           T.StructField("channel_methods", T.MapType(T.StringType(), T.StringType())),
       ])),
       T.StructField("quality_flags", T.ArrayType(T.StringType())),
       T.StructField("fields", FIELDS)]
)


def reading(concept: str) -> Column:
    """The usable value of a concept: null when absent or unavailable."""
    field = F.col("fields")[concept]
    return F.when(field["provenance"] != "unavailable", field["value"])
