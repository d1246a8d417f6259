"""The keyword of a database line is cut off; its other words are not made for it."""

from pyspark.sql import functions as F

from tracelake.functions.fields import first_word, words
from tracelake.sources import databases


def test_first_word(spark):
    lines = ["", " ", "\t", "BO_", " BO_ 1", "\t\r\nSG_\t: a", "a b  c", "VAL_:x y", "\x0b q"]
    rows = spark.createDataFrame([(x,) for x in lines], "value string").select(F.coalesce(F.get(words(F.col("value")), F.lit(0)), F.lit("")).alias("a"), first_word(F.col("value")).alias("b"))
    assert all(r["a"] == r["b"] for r in rows.collect())


def test_no_line_is_split_for_its_keyword(spark):
    lines = spark.createDataFrame([("db", 1, "BO_ 1 A: 8 X"), ("db", 2, "  "), ("db", 3, 'VAL_ 1 a 0 "x'), ("db", 4, 'y";'), ("db", 5, "VERSION 1")], "source_id string, line long, value string")
    found = databases.statements(lines)
    assert [(r["keyword"], r["statement"]) for r in found.orderBy("line").collect()] == [("BO_", 1), (None, 1), ("VAL_", 2), (None, 2), ("VERSION", 3)]
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
