"""Queries of decoder plugins."""

from pyspark.sql import functions as F

from ..operators import plugins as O
from .registry import query
from .tables import CAN_IDS, events, frames, session_frames


def _bindings(spark):
    rows = [("p", f"b{i}", c, k == "purchase", k != "error", k != "signup") for i, (k, c) in enumerate(CAN_IDS.items())]
    return spark.createDataFrame(rows, "plugin_id string, binding_id string, can_id int, extended boolean, plugin_enabled boolean, binding_enabled boolean")


def decode_value(data, row):
    """Sample plugin: the value of bytes 0 to 3; fails on mux 2 with a k of 50 and more, reports events for k = 1."""
    k, mux = data[6], data[7]
    if mux == 2 and k >= 50:
        raise ValueError("cannot decode")
    raw = int.from_bytes(data[:4], "little")
    yield {"signal": "value", "name": "Value", "unit": "m", "group": f"mux {mux}", "quality": "invalid" if k % 17 == 0 else "valid", "value": float("nan") if k == 0 else raw / 100}
    if k == 1:
        yield {"event": "one", "label": "k is 1"}


class CountingSession:
    """Sample session: counts the frames of its source and sums their whole users (frames of ``session_frames``)."""

    def __init__(self):
        self.n, self.users = 0, 0

    def __call__(self, data, row):
        self.n += 1
        self.users += int.from_bytes(data[8:16], "big", signed=True)
        # The labels are exact where a double is not.
        return [{"signal": s, "value": v, "label": str(v)} for s, v in (("n", self.n), ("users", self.users))]


_ON = "event_type IN ('click', 'view', 'purchase')"
_B = "CASE event_type WHEN 'click' THEN 'b0' WHEN 'view' THEN 'b1' ELSE 'b4' END"


@query("X1", f"SELECT ordinal, 'plugin:p:' || {_B} || ':value' AS signal_id, raw::DOUBLE / 100 AS value, 'Value' AS name, 'm' AS unit, 'mux ' || mux AS grp, CASE WHEN k % 17 = 0 THEN 'invalid' ELSE 'valid' END AS quality FROM fr WHERE {_ON} AND k <> 0 AND NOT (mux = 2 AND k >= 50)")
def stateless(spark, sf):
    out = O.run_stateless(O.route(frames(spark, sf), _bindings(spark)), decode_value)
    return out.filter("kind = 'sample'").select("ordinal", "signal_id", "value", "name", "unit", F.col("group").alias("grp"), "quality")


@query("X2", f"SELECT ordinal, count(*) OVER w::DOUBLE AS n, sum(user_id) OVER w::DOUBLE AS users FROM fr WHERE {_ON} WINDOW w AS (PARTITION BY source_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)".replace("count(*) OVER w::DOUBLE", "(count(*) OVER w)::DOUBLE").replace("sum(user_id) OVER w::DOUBLE", "(sum(user_id) OVER w)::DOUBLE"))
def stateful(spark, sf):
    out = O.run_stateful(O.route(session_frames(spark, sf), _bindings(spark)), CountingSession).filter("kind = 'sample'")
    return out.groupBy("ordinal").pivot("name", ["n", "users"]).agg(F.first("value"))


@query("X3", f"SELECT ordinal, {_B} AS binding_id FROM fr WHERE {_ON}")
def routed(spark, sf):
    return O.route(frames(spark, sf), _bindings(spark)).select("ordinal", "binding_id")


@query("X4", f"SELECT ordinal, t_us, 'PLUGIN_VALUE' AS code FROM fr WHERE {_ON} AND k = 0")
def unfit(spark, sf):
    out = O.run_stateless(O.route(frames(spark, sf), _bindings(spark)), decode_value)
    return out.filter("code = 'PLUGIN_VALUE'").select("ordinal", "t_us", "code")


@query("X5", f"SELECT ordinal, 'cannot decode' AS message FROM fr WHERE {_ON} AND mux = 2 AND k >= 50")
def isolated(spark, sf):
    out = O.run_stateless(O.route(frames(spark, sf), _bindings(spark)), decode_value)
    return out.filter("code = 'PLUGIN_ERROR'").select("ordinal", "message")


@query("X6", f"SELECT ordinal, t_us, 'one' AS name, 'k is 1' AS label FROM fr WHERE {_ON} AND k = 1")
def plugin_events(spark, sf):
    out = O.run_stateless(O.route(frames(spark, sf), _bindings(spark)), decode_value)
    return out.filter("kind = 'event'").select("ordinal", "t_us", "name", "label")


@query("X9", "SELECT r.user_id, r.ordinal AS response, q.ordinal AS request, (r.t_us - q.t_us) / 1000::DOUBLE AS response_ms FROM (SELECT * FROM fr WHERE event_type = 'view') r ASOF JOIN (SELECT * FROM fr WHERE event_type = 'click') q ON r.user_id = q.user_id AND r.t_us >= q.t_us")
def pairs(spark, sf):
    e = events(spark, sf)
    q = e.filter("event_type = 'click'").select("user_id", "t_us", "ordinal")
    r = e.filter("event_type = 'view'").select("user_id", "t_us", F.col("ordinal").alias("response"))
    return O.respond(q, r, ["user_id"])
