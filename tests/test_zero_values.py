"""Values that round to nothing: a raw number of 0 has bits too."""

import os

from conftest import SF, rows_of

from tracelake import plans


def test_zero_is_a_number_of_ieee_754(spark, tmp_path):
    import duckdb

    folder, con = str(tmp_path), duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS value) FROM '{SF}/events.parquet' WHERE event_id < 60) TO '{folder}/events.parquet'")
    os.symlink(f"{SF}/orders.parquet", f"{folder}/orders.parquet")
    for name in ("events", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    got = plans.queries()["D3"](spark, folder).toPandas()
    assert (got["exact"] == 0).sum() == 20
    assert rows_of(got) == rows_of(con.sql(plans.oracle_sql()["D3"]).df())
