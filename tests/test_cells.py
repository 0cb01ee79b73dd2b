"""Number cells: decimal notation only."""

from pyspark.sql import functions as F

from stintwise.functions.cells import finite, signed, simple_upper


def test_numbers(spark):
    texts = ["12.5", " -3 ", "+.5e2", "7.", "12.5d", "3f", "0x1p3", "nan", "Infinity", "1e999", "", ".", "1_0", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(finite(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == [12.5, -3.0, 50.0, 7.0] + [None] * 10


def test_integers_take_either_sign(spark):
    rows = spark.createDataFrame([("+3",), ("-4",), ("5",), ("3.0",), ("--1",)], "t string")
    assert [r.v for r in rows.select(signed(F.col("t")).alias("v")).collect()] == [3, -4, 5, None, None]


def test_capitals_are_one_character_each(spark):
    rows = spark.createDataFrame([("straße Äö ŉ ǆ ﬁ ᾳ ς",), ("",), (None,)], "t string")
    assert [r.v for r in rows.select(simple_upper(F.col("t")).alias("v")).collect()] == ["STRAẞE ÄÖ ŉ Ǆ ﬁ ᾼ Σ", "", None]
