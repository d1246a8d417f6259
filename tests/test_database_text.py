"""Writing a database reads each scale text once or twice, however often its line shows it."""

from tracelake.plans import source_queries as Q
from tracelake.sources import databases


def test_scales_are_read_few_times(spark, sf_dir):
    plan = databases.dbc_lines(Q._part_layouts(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("d{1,38}$") <= 8
