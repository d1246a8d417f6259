"""Events of which three share each time, as in logs that are put together."""

import os

import pytest
from conftest import SF, rows_of

from tracelake import plans


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    import duckdb

    folder = str(tmp_path_factory.mktemp("tied"))
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    copies = f"SELECT * REPLACE (event_id + i * 1000 AS event_id, value + (event_id * 7 + i * 11) % 13 AS value, '{{\"k\": ' || ((event_id * 31 + i * 17) % 100) || '}}' AS props) FROM '{SF}/events.parquet', range(3) r(i)"
    con.sql(f"COPY (SELECT * EXCLUDE (i) FROM ({copies})) TO '{folder}/events.parquet'")
    os.symlink(f"{SF}/orders.parquet", f"{folder}/orders.parquet")
    for name in ("events", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["E9", "E10", "G24_breaks"])
def test_ties_are_settled_by_ordinal(spark, tied, name):
    folder, con = tied
    assert rows_of(plans.queries()[name](spark, folder).toPandas()) == rows_of(con.sql(plans.oracle_sql()[name]).df())
