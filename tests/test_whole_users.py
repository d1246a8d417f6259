"""Sessions add up whole users, also those that need more than 16 bits or fall below zero, and sums that a double cannot hold."""

import os

import pytest
from conftest import SF, rows_of

from tracelake import plans


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    import duckdb

    folder = str(tmp_path_factory.mktemp("whole"))
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    user = "CASE event_id % 3 WHEN 0 THEN user_id + 70000 WHEN 1 THEN -1 - user_id ELSE user_id + 1125899906842624 END"
    con.sql(f"COPY (SELECT * REPLACE ({user} AS user_id) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    os.symlink(f"{SF}/orders.parquet", f"{folder}/orders.parquet")
    for name in ("events", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["X2", "W5"])
def test_a_session_adds_up_whole_users(spark, wide, name):
    folder, con = wide
    assert "65535" not in plans.oracle_sql()[name]  # nor does the SQL cut them
    got = plans.queries()[name](spark, folder).toPandas()
    assert rows_of(got) == rows_of(con.sql(plans.oracle_sql()[name]).df())
