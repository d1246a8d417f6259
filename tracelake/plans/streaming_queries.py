"""Queries that run streams over the event table until all is read."""

from pyspark.sql import functions as F

from ..streaming import jobs as J
from .registry import query
from ..storage import shared_folder as shared


def _frames(spark, sf):
    return J.as_frames(J.arriving(spark, sf, shared(spark)))


def _stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _bus_frames(spark, sf, whole_users=False):
    """Arriving frames with their payloads, as ``tables.frames`` has them, or ``tables.session_frames``."""
    from .tables import CAN_IDS, _hex, with_whole_user

    f = _frames(spark, sf)
    can_id = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in CAN_IDS.items()))
    raw = _hex(F.floor(F.col("value") * 100 + 0.5), 4)
    little = F.concat(*(F.substring(raw, i, 2) for i in (7, 5, 3, 1)))
    data = F.unhex(F.concat(little, _hex(F.col("user_id"), 2), _hex(F.col("k"), 1), _hex(F.col("ordinal") % 3, 1)))
    if whole_users:
        data = with_whole_user(data, F.col("user_id"))
    return f.select("source_id", "ordinal", "t_us", (F.col("t_us") / 1e6).alias("ts"), can_id.alias("can_id"), (F.col("event_type") == "purchase").alias("extended"), F.lit(1).alias("channel"), F.lit("Rx").alias("direction"), data.alias("data"))


@query("W1", """, x AS (SELECT ordinal, event_type || '.value' AS signal_id, raw::DOUBLE / 100 AS value FROM fr UNION ALL SELECT ordinal, event_type || '.user', (user_id & 65535)::DOUBLE FROM fr UNION ALL SELECT ordinal, event_type || '.k', k::DOUBLE FROM fr
 UNION ALL SELECT ordinal, event_type || '.mux', mux::DOUBLE FROM fr UNION ALL SELECT ordinal, event_type || '.when_one', floor((k % 16) / 2)::DOUBLE FROM fr WHERE mux = 1) SELECT * FROM x""")
def progressive(spark, sf):
    """Every signal of every layout, decoded as its frames arrive."""
    from ..operators import decode as D
    from .tables import layouts

    return J.drain(D.decode(_bus_frames(spark, sf), layouts(spark)).select("ordinal", "signal_id", "value"), shared(spark))


#: How far behind its time each kind of frame arrives: lanes that are written a little apart. Every 50th frame comes an hour late.
_LAGS = {"click": 0, "view": 180_000_000, "signup": 60_000_000, "error": 600_000_000, "purchase": 20_000_000}
_HOUR = 3_600_000_000
_ARRIVAL = "(t_us + CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _LAGS.items()) + f" END + CASE WHEN ordinal % 50 = 7 THEN {_HOUR} ELSE 0 END) * 64 + ordinal % 64"


def _shuffled(spark, sf, files=5):
    """Frames as a stream in order of arrival, with an end mark for each source behind them."""
    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("end", F.lit(False))
    placed = table.selectExpr("*", "unix_micros(CAST(ts AS TIMESTAMP)) AS t_us", "event_id AS ordinal").withColumn("arrival", F.expr(_ARRIVAL)).drop("t_us", "ordinal")
    columns = {"event_id": F.lit(None).cast("long"), "end": F.lit(True), "arrival": F.lit(2**62)}
    ends = placed.groupBy((F.col("user_id") % 4).alias("user_id")).agg(F.max("ts").alias("ts"), *[F.first(c).alias(c) for c in ("event_type", "value", "props")]).withColumns(columns)
    return J.as_frames(J.delivered(placed, "arrival", shared(spark), files, [ends])).withColumn("lane", F.col("event_type"))


_LANES = "".join(f", last_value(CASE WHEN event_type = '{k}' THEN t_us END IGNORE NULLS) OVER w AS l{i}" for i, k in enumerate(_LAGS))
_MARK = "CASE WHEN " + " AND ".join(f"l{i} IS NOT NULL" for i in range(len(_LAGS))) + " THEN least(" + ", ".join(f"l{i}" for i in range(len(_LAGS))) + ") END AS mark"


@query("W2", f""", a AS (SELECT source_id, ordinal, t_us, event_type, {_ARRIVAL} AS arrival FROM fr),
 s AS (SELECT *, row_number() OVER w AS i{_LANES} FROM a WINDOW w AS (PARTITION BY source_id ORDER BY arrival ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, {_MARK} FROM s),
 r AS (SELECT f.source_id, f.ordinal, f.t_us, f.arrival, coalesce(min(g.i), 1000000000000) AS step FROM m f LEFT JOIN m g ON f.source_id = g.source_id AND g.i >= f.i AND g.mark >= f.t_us GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY step, t_us, arrival) - 1 AS position FROM r)
 SELECT source_id, ordinal, t_us, position, coalesce(t_us < max(t_us) OVER (PARTITION BY source_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM o""")
def reordered(spark, sf):
    """Lanes that arrive apart, some frames an hour late: the order of release and who was late."""
    _stateful(spark)
    return J.drain(J.release_in_order(_shuffled(spark, sf), list(_LAGS)), shared(spark))


@query("W2_bounded", "SELECT source_id, count(*) AS n, count(*) AS released, count(*) - 1 AS last_position FROM fr GROUP BY 1")
def bounded(spark, sf):
    """With room for 20 frames a source none is lost or released twice; tests hold the order against a plain heap."""
    _stateful(spark)
    released = J.drain(J.release_in_order(_shuffled(spark, sf), list(_LAGS), 20), shared(spark))
    return released.groupBy("source_id").agg(F.count_distinct("ordinal").alias("n"), F.count(F.lit(1)).alias("released"), F.max("position").alias("last_position"))


@query("W3", "SELECT ordinal FROM fr WHERE event_type = 'error' AND value > 50")
def filtered(spark, sf):
    return J.drain(_frames(spark, sf).filter("event_type = 'error' and value > 50").select("ordinal"), shared(spark))


@query("W4")
def low_pass(spark, sf):
    """Checked in tests against the batch filter."""
    _stateful(spark)
    return J.drain(J.low_pass_stream(_frames(spark, sf).select("event_type", "ordinal", "t_us", "value"), ["event_type"], 3600.0), shared(spark))


@query("W5", "SELECT source_id, ordinal, count(*) OVER w AS n, (sum(user_id) OVER w)::BIGINT AS users FROM fr WINDOW w AS (PARTITION BY source_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)")
def sessions(spark, sf):
    """The plugin session of X2 over arriving frames, its state carried from batch to batch."""
    from ..operators import plugins as P
    from .plugin_queries import CountingSession
    from .tables import CAN_IDS

    _stateful(spark)
    bound = spark.createDataFrame([("p", "b", c, k == "purchase", True, True) for k, c in CAN_IDS.items()], "plugin_id string, binding_id string, can_id int, extended boolean, plugin_enabled boolean, binding_enabled boolean")
    out = J.drain(J.session_stream(P.route(_bus_frames(spark, sf, whole_users=True), bound), CountingSession), shared(spark)).filter("kind = 'sample'")
    return out.groupBy("source_id", "ordinal").pivot("name", ["n", "users"]).agg(F.first("label")).select("source_id", "ordinal", F.col("n").cast("long").alias("n"), F.col("users").cast("long").alias("users"))


@query("W6", """, g AS (SELECT user_id, t_us // 1000 AS ms, lead(t_us // 1000) OVER (PARTITION BY user_id ORDER BY t_us) AS nxt, 1800000 * (1 + user_id % 3) AS p, max(t_us) OVER () // 1000 AS finish FROM fr)
 SELECT user_id, ms AS last_ms, ms + 3 * p AS silent_ms FROM g WHERE coalesce(nxt, finish) - ms > 3 * p""")
def silent(spark, sf):
    """Each user has a period of its own; at the end silences that are still open are told too."""
    _stateful(spark)
    # Delivered in order of time: ids need not follow it, and what comes behind the watermark is dropped.
    table = spark.read.parquet(f"{sf}/events.parquet").withColumns({"end": F.lit(False), "arrival": F.unix_micros(F.col("ts").cast("timestamp"))})
    last = table.agg(F.max("ts").alias("ts"))
    ends = table.groupBy("user_id").agg(*[F.first(c).alias(c) for c in ("event_id", "event_type", "value", "props")]).withColumns({"end": F.lit(True), "arrival": F.lit(2**62)}).crossJoin(F.broadcast(last))
    periods = table.select("user_id").distinct().select("user_id", (1800000 * (1 + F.col("user_id") % 3)).alias("period_ms"))
    f = J.as_frames(J.delivered(table, "arrival", shared(spark), ends=[ends])).select("user_id", "t_us", "at", "end").join(periods, "user_id")
    return J.drain(J.silent_keys(f, ["user_id"], "1 minute"), shared(spark))


_TIMEOUT_S = 7200


@query("X9_stream", f""", q AS (SELECT user_id, ordinal, t_us FROM fr WHERE event_type = 'click'), r AS (SELECT user_id, ordinal, t_us FROM fr WHERE event_type = 'view')
 SELECT r.user_id, r.ordinal AS response, q.ordinal AS request, (r.t_us - q.t_us) / 1000::DOUBLE AS response_ms FROM r ASOF JOIN q ON r.user_id = q.user_id AND r.t_us >= q.t_us WHERE r.t_us - q.t_us <= {_TIMEOUT_S}000000
 UNION ALL SELECT user_id, NULL, ordinal, NULL FROM q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = q.user_id AND r.t_us BETWEEN q.t_us AND q.t_us + {_TIMEOUT_S}000000)""")
def paired(spark, sf):
    """Requests and responses as two streams of five files each; requests that time out are listed."""
    table = spark.read.parquet(f"{sf}/events.parquet")
    sides = []
    for kind in ("click", "view"):
        own = table.filter(F.col("event_type") == kind)
        # Two marks of nobody's, later and later, move the watermark past all that may still pair.
        ends = [own.agg(F.max(F.col("ts") + F.expr(f"INTERVAL {d} DAYS")).alias("ts"), *[F.first(c).alias(c) for c in ("event_type", "value", "props")]).withColumns({"event_id": F.lit(-d).cast("long"), "user_id": F.lit(-1).cast("long")}) for d in (400, 401)]
        sides.append(J.as_frames(J.delivered(own, "event_id", shared(spark), ends=ends)))
    out = J.drain(J.pair_streams(*sides, ["user_id"], _TIMEOUT_S, "1 minute"), shared(spark))
    return J.latest_requests(out.filter("user_id >= 0"), ["user_id"]).select("user_id", "response", "request", "response_ms")


@query("W7", "SELECT source_id, event_type, max(ordinal) AS ordinal, count(*) AS count FROM fr GROUP BY ALL")
def live(spark, sf):
    s = _frames(spark, sf).groupBy("source_id", "event_type").agg(F.max_by("ordinal", "t_us").alias("ordinal"), F.count(F.lit(1)).alias("count"))
    out = J.drain(s, shared(spark), "update")
    return out.groupBy("source_id", "event_type").agg(F.max_by("ordinal", "batch").alias("ordinal"), F.max_by("count", "batch").alias("count"))
