"""Windows over series that are cut into ranges of time give what one window gives."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tracelake import plans
from tracelake.operators import ranges

NAMES = "C3 C4 C5 C6 C7 G12_budget J1_thinned J3 J4 J3_clip P6 P6_drawn P6_zoom P6_joined P4 E4 E5 E6 E7 E9 E10 F10 F11 G5 G6 G9 G10 G11 G12 G13 G14 G17 G18 G20 G24 Q2 R4 T1 T1_bulk T2 T3 T4 T7".split()


@pytest.fixture
def cut(monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_BYTES", -1)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 60)
    monkeypatch.setattr(ranges, "MOST_RANGES", 50)


@pytest.mark.parametrize("name", NAMES)
def test_cut_series_equal_sql(spark, sf_dir, duck, cut, name):
    assert rows_of(plans.queries()[name](spark, sf_dir).toPandas()) == rows_of(duck.sql(plans.oracle_sql()[name]).df())


def test_one_series_is_dealt_evenly(spark, cut):
    rows = spark.range(3000).select(F.lit("s").alias("signal_id"), F.col("id").alias("t_us"), F.col("id").alias("ordinal"))
    counts = [r["count"] for r in ranges.with_ranges(rows, ["signal_id"], "t_us")[0].groupBy("__r").count().collect()]
    assert len(counts) >= 40 and max(counts) <= 3 * sorted(counts)[len(counts) // 2]


def test_low_pass_cut_equals_whole(spark, sf_dir, monkeypatch):
    """The low-pass filter inside an epoch: cut into ranges, blocks too, it gives what the recurrence gives."""
    import math

    from tracelake.operators import derived

    rows = spark.range(1500).select(F.lit(1).alias("key"), F.col("id").alias("ordinal"), (F.col("id") * 1_000_000 + F.col("id") % 7 * 100_000).alias("t_us"), (F.col("id") * 37 % 101).cast("double").alias("value"))
    rows = rows.withColumn("ts", F.col("t_us") / 1e6)
    monkeypatch.setattr(ranges, "RANGE_BYTES", -1)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 60)
    monkeypatch.setattr(ranges, "MOST_RANGES", 50)
    for tau in (0.7, 9.0, 400.0):
        got = [(r["y"], r["previous"], r["delta_s"]) for r in derived.low_pass(rows.withColumn("epoch", F.lit(0)), ["key"], tau).orderBy("ordinal").collect()]
        y, last = None, None
        for i, (g, before, step) in enumerate(got):
            t, x = i + i % 7 / 10, float(i * 37 % 101)
            was = y
            y = x if y is None else y + (1 - math.exp(-(t - last) / tau)) * (x - y)
            assert abs(g - y) < 1e-9 * max(1, abs(y)) and (was is None) == (before is None) and (was is None or abs(step - (t - last)) < 1e-6)
            last = t


def test_short_series_are_only_counted(spark, monkeypatch):
    """Quantiles are taken of series that are cut and of no other: very many short series cost a count."""
    monkeypatch.setattr(ranges, "RANGE_BYTES", -1)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 60)
    monkeypatch.setattr(ranges, "MOST_RANGES", 50)
    short = spark.range(3000).select(F.floor(F.col("id") / 10).alias("key"), F.col("id").alias("t_us"))
    mixed = short.union(spark.range(300).select(F.lit(-1).cast("long"), "id"))
    assert [r["key"] for r in ranges.range_bounds(mixed, ["key"], "t_us").collect()] == [-1]

    def refused(*_):
        raise AssertionError("quantiles of short series")

    monkeypatch.setattr(F, "percentile_approx", refused)
    assert ranges.range_bounds(short, ["key"], "t_us") is None
    assert ranges.range_bounds(short, ["key"], "t_us", coarse=["key"]) is None
