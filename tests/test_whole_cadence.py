"""The cadence that tells breaks is that of all neighbours: every second step is long, and evenly picked ones are all short."""

import os

import pytest
from conftest import rows_of

from tracelake import plans
from tracelake.operators import ranges, series

N = 4097


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    import duckdb

    folder = str(tmp_path_factory.mktemp("uneven"))
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    at = "(i // 2 * 1100 + i % 2 * 100 + CASE WHEN i > 4000 THEN 9000 ELSE 0 END)"
    con.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds({at}) AS ts, i % 50 AS user_id, 'click' AS event_type, (i * 37 % 101)::DOUBLE AS value,
      '{{"k": ' || CASE WHEN i BETWEEN 1000 AND 1010 THEN 17 ELSE 1 END || '}}' AS props FROM range({N}) t(i)) TO '{folder}/events.parquet'""")
    con.sql(f"COPY (SELECT 1 AS o_orderkey, 1 AS o_custkey, 'O' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, DATE '2024-01-01' AS o_orderdate, '1' AS o_orderpriority) TO '{folder}/orders.parquet'")
    for name in ("events", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


@pytest.fixture(params=[False, True], ids=["whole", "cut"])
def cut(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(ranges, "RANGE_BYTES", -1)
        monkeypatch.setattr(ranges, "RANGE_ROWS", 500)
        monkeypatch.setattr(ranges, "MOST_RANGES", 50)


#: Samples at both ends of the invalid stretch and of the one pause; those two as intervals.
@pytest.mark.parametrize("name, rows", [("G10", 6), ("G11", 2)])
def test_breaks_are_told_by_all_neighbours(spark, uneven, cut, name, rows):
    folder, con = uneven
    assert "2048" not in plans.oracle_sql()[name]
    got = plans.queries()[name](spark, folder).toPandas()
    assert len(got) == rows and rows_of(got) == rows_of(con.sql(plans.oracle_sql()[name]).df())


def test_thinning_keeps_breaks_that_all_neighbours_tell(spark, uneven, cut):
    folder, con = uneven
    assert "2048" not in plans.oracle_sql()["G12_budget"]
    got = plans.queries()["G12_budget"](spark, folder).toPandas()
    assert {4000, 4001} <= set(got["ordinal"]) and rows_of(got) == rows_of(con.sql(plans.oracle_sql()["G12_budget"]).df())


def test_the_upper_median_of_many_steps(spark, cut):
    steps = {"a": [i * 7919 % 3001 + 1 for i in range(3000)], "b": [5, 5, 5, 9], "c": [3], "d": [], "e": [4, 1]}
    rows, at = [], dict.fromkeys(steps, 0)
    for name, own in steps.items():
        for i, step in enumerate([0, *own]):
            at[name] += step
            rows.append((name, i, at[name], 1.0, "valid"))
    s = spark.createDataFrame(rows, "signal_id string, ordinal long, t_us long, value double, quality string")
    got = {r.signal_id: r.threshold_us for r in series.cadence(s, ["signal_id"]).collect()}
    assert got == {name: 4 * sorted(own)[len(own) // 2] if own else None for name, own in steps.items()}
