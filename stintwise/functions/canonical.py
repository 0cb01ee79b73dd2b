"""One unambiguous text for the named columns of a row, and its hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tagged(text: Column) -> Column:
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def canonical(columns: list[str]) -> Column:
    """The columns in name order, each as its name and its value: byte count, colon, text; a null is a dash.

    Since lengths go before contents no value can be taken for another one, for a name or for a null.
    """
    cells = []
    for name in sorted(columns):
        value = F.col(f"`{name}`").cast("string")
        cells += [_tagged(F.lit(name)), F.when(value.isNull(), F.lit("-")).otherwise(_tagged(value))]
    return F.concat(*cells)


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the canonical text, in hex."""
    return F.sha2(canonical(columns), 256)
