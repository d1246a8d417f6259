"""Users that do not fit the 16 bits that a frame has for them."""

import os

import pytest
from conftest import SF, rows_of

from tracelake import plans

NAMES = ["D1", "D14", "D3", "D9", "F4", "L7", "N2", "S1", "W5", "X2", "flagship", "W1", "D4", "T1"]


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    import duckdb

    folder = str(tmp_path_factory.mktemp("wide"))
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"COPY (SELECT * REPLACE (user_id + 60000 * (event_id % 5) AS user_id) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    os.symlink(f"{SF}/orders.parquet", f"{folder}/orders.parquet")
    for name in ("events", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_a_field_of_a_frame_wraps(spark, wide, name):
    folder, con = wide
    assert rows_of(plans.queries()[name](spark, folder).toPandas()) == rows_of(con.sql(plans.oracle_sql()[name]).df())
