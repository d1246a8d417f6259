"""Series are put in order once, whatever is asked of them, and what each range hands on is worked out once."""

import re

from conftest import SF
from pyspark.sql import functions as F

from tracelake.operators import ranges
from tracelake.plans import series_queries


def _cut(monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_BYTES", -1)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 60)
    monkeypatch.setattr(ranges, "MOST_RANGES", 50)


def _reads(df):
    """How often a plan reads the source itself, not what was written on the way."""
    return len(re.findall(r"FileScan parquet [^\n]*events\.parquet", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")).split("== Physical Plan ==")[1]))


def test_breaks_gaps_and_thinning_do_not_read_the_source_again(spark, monkeypatch):
    _cut(monkeypatch)
    for q in (series_queries.breaks, series_queries.gap_list, series_queries.thin_budget):
        assert _reads(q(spark, SF)) == 0


def test_a_cut_series_is_made_once(spark, monkeypatch):
    _cut(monkeypatch)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def noted(x):
        seen.add(1)
        return x

    rows = spark.range(600).select(F.lit("s").alias("signal_id"), noted(F.col("id")).alias("t_us"), F.col("id").alias("ordinal"))
    out = ranges.Ranged(rows, ["signal_id"]).position("p").lag(a="t_us").lead(b="t_us").done()
    assert out.filter("p = t_us and coalesce(a, -1) = t_us - 1 and coalesce(b, 600) = t_us + 1").count() == 600
    # The rows are counted, then written; no step makes them again.
    assert seen.value <= 1200
