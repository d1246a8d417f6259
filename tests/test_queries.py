"""Every registered query of the engine against its SQL."""

import pytest
from conftest import rows_of

from tracelake import plans

NAMES = sorted(plans.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = plans.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_names():
    import __spark_entry__

    assert set(plans.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
