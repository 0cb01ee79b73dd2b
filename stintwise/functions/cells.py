"""Typed parsing of text cells and timestamps."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from stintwise.vocabulary import BOOLEAN_CONCEPTS, INTEGER_CONCEPTS, TEXT_CONCEPTS

# Accepted spellings of booleans in mapped text files.
TRUE_WORDS = ("1", "true", "yes")
FALSE_WORDS = ("0", "false", "no")


# Fixed value: decimal notation with an optional exponent, as a number in a text file may be written.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def finite(text: Column) -> Column:
    """Decimal text to double; null for blanks, type suffixes, hexadecimals, NaN and infinities."""
    number = F.when(F.trim(text).rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def loose_boolean(text: Column) -> Column:
    """1/true/yes and 0/false/no in any case, surrounding blanks ignored."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def strict_boolean(text: Column, words: tuple[str, str] = ("0", "1")) -> Column:
    """Exactly the two given spellings (false, true)."""
    return F.when(text == words[1], True).when(text == words[0], False)


def unsigned(text: Column) -> Column:
    """Digits only, as long."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def signed(text: Column) -> Column:
    """Optional sign and digits, as long."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))


def concept_cell(text: Column, concept: str) -> Column:
    """Parse a cell the way the concept demands; '' is null, text is kept as it is."""
    blank = text == ""
    if concept in BOOLEAN_CONCEPTS:
        parsed = loose_boolean(text)
    elif concept in INTEGER_CONCEPTS:
        parsed = signed(F.trim(text)).cast("double")
    elif concept in TEXT_CONCEPTS:
        parsed = text
    else:
        parsed = finite(text)
    return F.when(~blank, parsed)


def bad_cell(text: Column, concept: str) -> Column:
    """True where a non-empty cell does not parse."""
    return text.isNotNull() & (text != "") & concept_cell(text, concept).isNull()


def iso_micros(text: Column) -> Column:
    """ISO-8601 with a mandatory zone to microseconds since the epoch.

    The fraction is cut (not rounded) to six digits; null when malformed or zoneless.
    """
    cut = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(zoned, F.unix_micros(F.try_to_timestamp(cut)))


def wall_micros(stamp: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, stamp.cast("timestamp_ntz"))


@cache
def capitals() -> dict[str, str]:
    """Every character with a capital that is one character, and that capital."""
    found = {"ß": "ẞ"}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        found.setdefault(c, next((u for u in (c.upper(), c.title()) if len(u) == 1), c))
    return {c: u for c, u in found.items() if u != c}


def simple_upper(text: Column) -> Column:
    """Capitals one character for one, as Unicode's simple mapping has them (ß to ẞ, where Spark's upper writes SS)."""
    return F.translate(text, "".join(capitals()), "".join(capitals().values()))


def identifier(*parts: Column) -> Column:
    """Parts joined by '-'; beyond 128 characters a 111-character head and a 16-digit hash."""
    joined = F.concat_ws("-", *parts)
    return F.when(F.length(joined) <= 128, joined).otherwise(
        F.concat(F.substring(joined, 1, 111), F.lit("-"), F.substring(F.sha2(joined, 256), 1, 16)))
