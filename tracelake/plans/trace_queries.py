"""Queries of the state of a bus at a time."""

from pyspark.sql import functions as F

from ..operators import trace as O
from .registry import query
from .tables import CAN_IDS, events, frames, samples

AT, START = 1705500000000000, 1704500000000000
_KEY = "source_id, can_id, extended, channel, direction"


def _per(keys, name=""):
    """CTEs of the aggregates per key."""
    return f""", f{name} AS (SELECT *, lag(t_us) OVER w AS bt, row(raw, user_id & 65535, k, mux) IS DISTINCT FROM lag(row(raw, user_id & 65535, k, mux)) OVER w AS ch FROM fr WHERE t_us <= {AT} WINDOW w AS (PARTITION BY {keys} ORDER BY t_us, ordinal)),
 g{name} AS (SELECT {keys}, count(*) FILTER (t_us >= {START}) AS n, arg_max(ordinal, t_us) FILTER (t_us >= {START}) AS ordinal, max(t_us) FILTER (t_us >= {START}) AS last_us, min(t_us) FILTER (t_us >= {START}) AS first_us,
   arg_max(CASE WHEN bt >= {START} THEN {{'d': t_us - bt}} ELSE {{'d': NULL}} END, t_us) FILTER (t_us >= {START}) AS latest,
   min(t_us - bt) FILTER (t_us >= {START} AND bt >= {START}) AS lo, max(t_us - bt) FILTER (t_us >= {START} AND bt >= {START}) AS hi, max(t_us) FILTER (ch) AS changed FROM f{name} GROUP BY ALL),
 e{name} AS (SELECT DISTINCT {keys} FROM fr),
 t{name} AS (SELECT e{name}.*, coalesce(n, 0) AS n, ordinal, last_us, first_us, latest.d AS latest, lo, hi, changed FROM e{name} LEFT JOIN g{name} USING ({keys}))"""


_PER = _per(_KEY)


def _trace(spark, sf):
    return O.trace_at(frames(spark, sf), AT, START)


@query("T1", _PER + f" SELECT {_KEY}, n AS count, ordinal, ({AT} - last_us) / 1000.0::DOUBLE AS age_ms, latest / 1000.0::DOUBLE AS interval_ms FROM t")
def trace(spark, sf):
    return _trace(spark, sf).select(*O.KEY, "count", "ordinal", "age_ms", "interval_ms")


_TIMES = f"tm AS (SELECT {START} + 2200000000 * p_partkey AS at_us FROM (SELECT p_partkey FROM part WHERE p_partkey < 1000))"


@query("T1_bulk", f""", {_TIMES},
 f AS (SELECT *, lag(t_us) OVER w AS bt, row(raw, user_id & 65535, k, mux) IS DISTINCT FROM lag(row(raw, user_id & 65535, k, mux)) OVER w AS ch FROM fr WINDOW w AS (PARTITION BY {_KEY} ORDER BY t_us, ordinal)),
 ks AS (SELECT DISTINCT {_KEY} FROM fr)
 SELECT at_us, {", ".join("ks." + c.strip() for c in _KEY.split(","))}, count(f.ordinal) FILTER (t_us >= {START}) AS count, arg_max(f.ordinal, t_us) FILTER (t_us >= {START}) AS ordinal, (at_us - max(t_us) FILTER (t_us >= {START})) / 1000.0::DOUBLE AS age_ms,
   min(t_us - bt) FILTER (t_us >= {START} AND bt >= {START}) / 1000.0::DOUBLE AS min_ms, max(t_us - bt) FILTER (t_us >= {START} AND bt >= {START}) / 1000.0::DOUBLE AS max_ms,
   CASE WHEN count(f.ordinal) FILTER (t_us >= {START}) > 0 THEN greatest(max(t_us) FILTER (ch), min(t_us) FILTER (t_us >= {START})) END AS changed_us
 FROM tm CROSS JOIN ks LEFT JOIN f ON f.t_us <= tm.at_us AND {" AND ".join(f"f.{c.strip()} = ks.{c.strip()}" for c in _KEY.split(","))} GROUP BY at_us, {", ".join("ks." + c.strip() for c in _KEY.split(","))}""")
def trace_many(spark, sf):
    """Up to a thousand times at once, taken from a table."""
    p = spark.read.parquet(f"{sf}/part.parquet").filter("p_partkey < 1000")
    times = p.select((F.lit(START) + F.lit(2200000000) * F.col("p_partkey")).alias("at_us"))
    return O.trace_at_times(frames(spark, sf), times, START).select("at_us", *O.KEY, "count", "ordinal", "age_ms", "min_ms", "max_ms", "changed_us")


@query("T2", _PER + f" SELECT {_KEY}, lo / 1000.0::DOUBLE AS min_ms, hi / 1000.0::DOUBLE AS max_ms FROM t")
def intervals(spark, sf):
    return _trace(spark, sf).select(*O.KEY, "min_ms", "max_ms")


@query("T3", _PER + f" SELECT {_KEY}, CASE WHEN n > 0 THEN greatest(changed, first_us) END AS changed_us FROM t")
def changed(spark, sf):
    return _trace(spark, sf).select(*O.KEY, "changed_us")


_ALL = f"n AS count, ordinal, ({AT} - last_us) / 1000.0::DOUBLE AS age_ms, latest / 1000.0::DOUBLE AS interval_ms, lo / 1000.0::DOUBLE AS min_ms, hi / 1000.0::DOUBLE AS max_ms, CASE WHEN n > 0 THEN greatest(changed, first_us) END AS changed_us"


@query("T4", _PER + _per(f"{_KEY}, mux", "m") + f" SELECT {_KEY}, NULL::BIGINT AS mux, {_ALL} FROM t UNION ALL SELECT {_KEY}, mux, {_ALL} FROM tm")
def branches(spark, sf):
    from ..functions.bits import byte_at

    f = frames(spark, sf).withColumn("mux", byte_at(F.col("data"), F.lit(7)))
    return O.branches(f, AT, "mux", START).drop("whole", "data")


@query("T5", f"SELECT source_id, signal_id, arg_max(value, ordinal) AS value, max(t_us) AS t_us, max(t_us) < 1705490000000000 AS carried FROM sa WHERE usable AND t_us <= {AT} GROUP BY ALL")
def values(spark, sf):
    return O.latest_values(samples(spark, sf), AT, 1705490000000000, ["source_id", "signal_id"])


@query("T6", f"SELECT can_id, extended, max(ordinal) AS ordinal, max(t_us) AS t_us FROM fr WHERE t_us <= {AT} GROUP BY ALL")
def last_frame(spark, sf):
    return O.last_frames(frames(spark, sf), AT, ["can_id", "extended"])


@query("T7", _PER + _per(f"{_KEY}, mux", "m") + f" SELECT {_KEY}, NULL::BIGINT AS mux, latest / 1000.0::DOUBLE - 100000 AS deviation_ms, coalesce({AT} - last_us > 300000000, false) AS stale FROM t UNION ALL SELECT {_KEY}, mux, NULL, false FROM tm")
def periods(spark, sf):
    """Deviation of the latest interval; branches of a multiplexer have none."""
    from ..functions.bits import byte_at

    p = spark.createDataFrame([(c, k == "purchase", 100000.0) for k, c in CAN_IDS.items()], "can_id int, extended boolean, period_ms double")
    f = frames(spark, sf).withColumn("mux", byte_at(F.col("data"), F.lit(7)))
    return O.with_periods(O.branches(f, AT, "mux", START), p).select(*O.KEY, "mux", "deviation_ms", "stale")


@query("T8", f"SELECT can_id, extended, count(*) AS count FROM fr WHERE t_us <= {AT} GROUP BY ALL UNION ALL SELECT 1, false, 0 UNION ALL SELECT 2, true, 0")
def missing(spark, sf):
    defined = spark.createDataFrame([(1, False), (2, True), (0x123, False)], "can_id int, extended boolean")
    counts = frames(spark, sf).filter(F.col("t_us") <= AT).groupBy("can_id", "extended").agg(F.count(F.lit(1)).alias("count"))
    return O.with_missing(counts, defined)


_T9 = f""", c AS (SELECT {_KEY}, count(*) AS n, nullif(count(*) FILTER (event_type = 'click'), 0) AS clicks FROM fr GROUP BY ALL)"""


@query("T9", _T9 + f" SELECT {_KEY}, n, row_number() OVER (ORDER BY (can_id = 784) DESC, clicks DESC NULLS LAST, can_id, extended, channel, direction, source_id)::INTEGER AS place FROM c")
def ordered(spark, sf):
    c = events(spark, sf).groupBy(*O.KEY).agg(F.count(F.lit(1)).alias("n"), F.nullif(F.count(F.when(F.col("event_type") == "click", 1)), F.lit(0)).alias("clicks"))
    return O.ordered(c, F.col("can_id") == 784, [F.desc_nulls_last("clicks")]).drop("clicks")


@query("T10", "SELECT source_id, count(*) FILTER (t_us < lo + 1) AS received FROM fr, (SELECT min(t_us) AS lo FROM fr) GROUP BY source_id")
def head(spark, sf):
    return O.received_before_first(frames(spark, sf))
