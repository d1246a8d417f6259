"""Registry of queries: each has an id, a function and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The bus log and its signals as SQL sees them: fields by arithmetic, without any payload bytes.
BASE_SQL = """
WITH fr AS (
  SELECT event_id AS ordinal, epoch_us(ts) AS t_us, epoch_us(ts) / 1e6 AS ts, event_type, value, user_id,
         CASE event_type WHEN 'click' THEN 291 WHEN 'view' THEN 784 WHEN 'signup' THEN 800 WHEN 'error' THEN 388 ELSE 419385573 END::INTEGER AS can_id,
         event_type = 'purchase' AS extended, CASE WHEN user_id % 5 = 0 THEN 'Tx' ELSE 'Rx' END AS direction,
         (user_id % 3 + 1)::INTEGER AS channel, 'log' || (user_id % 4) AS source_id,
         floor(value * 100 + 0.5)::BIGINT AS raw, (props->>'$.k')::INTEGER AS k, event_id % 3 AS mux
  FROM events),
sa AS (
  SELECT source_id, ordinal, event_type AS signal_id, t_us, ts, CASE WHEN k = 0 THEN NULL ELSE value END AS value,
         CASE WHEN k % 17 = 0 THEN 'invalid' ELSE 'valid' END AS quality, k % 17 <> 0 AS usable
  FROM fr),
od AS (
  SELECT o_orderkey AS ordinal, o_custkey % 10 AS key, epoch_us(o_orderdate) AS t_us, epoch_us(o_orderdate) / 1e6 AS ts, o_totalprice AS value FROM orders)
"""


def query(name: str, sql: str | None = None, base: bool = True):
    """Registers a query; ``sql`` is a SELECT over ``fr``, ``sa``, ``od`` or the tables (or more CTEs, starting with a comma)."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (BASE_SQL + sql) if base else sql
        return f

    return add
