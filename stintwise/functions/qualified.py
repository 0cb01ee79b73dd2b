"""Building qualified values (value, provenance, unit, ...) for the ``fields`` struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stintwise.vocabulary import CONCEPT_UNITS, value_type


def qualified(
    value: Column,
    concept: str,
    source: str | None,
    scale: float = 1.0,
    derivation: str | None = None,
    provenance: str | None = None,
    flags: list[str] | None = None,
) -> Column:
    """Null becomes ``unavailable``; unscaled ``measured``; scaled or derived ``derived``.

    An explicit ``provenance`` replaces the measured/derived choice. The struct is built with
    its final types and not cast as a whole: the optimizer can then reduce ``x.unit`` or
    ``x.value`` to the one expression behind it.
    """
    known = value.isNotNull()
    scaled = value if scale == 1.0 else value * F.lit(scale)
    how = provenance or ("measured" if scale == 1.0 and derivation is None else "derived")
    text = derivation if derivation is not None or scale == 1.0 else f"{source} * {scale:g}"
    return F.struct(
        F.when(known, scaled).cast(value_type(concept)).alias("value"),
        F.when(known, F.lit(how)).otherwise(F.lit("unavailable")).alias("provenance"),
        F.lit(CONCEPT_UNITS[concept]).alias("unit"),
        F.when(known, F.lit(source)).cast("string").alias("source_channel"),
        F.when(known, F.lit(text)).cast("string").alias("derivation"),
        (F.array(*[F.lit(f) for f in flags]) if flags else F.lit(None)).cast("array<string>").alias("quality_flags"),
        F.lit(None).cast("string").alias("reference"),
    )


def decimal_text(value: Column, concept: str, source: str, flag: str) -> Column:
    """A text concept that keeps a raw integer code as its decimal string, with a flag."""
    return qualified(value.cast("string"), concept, source, flags=[flag])


def fields(**members: Column) -> Column:
    """Assemble the ``fields`` struct from qualified members, in concept order."""
    return F.struct(*[members[c].alias(c) for c in CONCEPT_UNITS if c in members])
