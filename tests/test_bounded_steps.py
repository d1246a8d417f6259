"""Steps that must not grow with the input: what a report makes, and what one task sorts."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tracelake.operators import calculations, store
from tracelake.plans import derived_queries


def test_report_calculates_nothing(spark, monkeypatch):
    monkeypatch.setattr(calculations, "neighbours", lambda *a, **b: pytest.fail("samples were calculated for a report"))
    assert derived_queries.left_out(spark, SF).count() == 6


def test_a_task_sorts_a_bounded_number_of_frames(spark):
    frames = spark.range(50_000).coalesce(1).select(F.col("id").alias("ordinal"))
    sizes = [r["count"] for r in store.dealt(frames, 1_000).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 50_000 and len(sizes) == 50 and max(sizes) < 1_500
