"""Queries of units, charts, trajectories, comparisons and clips."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import units as U
from ..operators import charts as O
from ..operators import series as S
from ..operators import frames as FR
from ..operators import views as V
from .registry import query
from .series_queries import FROM, KEY, TO
from .tables import events, frames, order_samples, samples
from .thinning_sql import broken_sql, thinned_sql

_UNITS = """, un AS (SELECT ordinal, value, k, CASE k % 8 WHEN 0 THEN 'km/h' WHEN 1 THEN ' mm ' WHEN 2 THEN 'fahrenheit' WHEN 3 THEN 'PSI' WHEN 4 THEN 'furlong' WHEN 5 THEN 'kW' WHEN 6 THEN 'mm^2' ELSE 'kmh' END AS unit FROM fr),
 ru AS (SELECT * FROM (VALUES ('km/h', 'speed', 'm/s', 1 / 3.6::DOUBLE, 0.0::DOUBLE), (' mm ', 'length', 'm', 0.001::DOUBLE, 0), ('fahrenheit', 'temperature', '°C', 5 / 9.0::DOUBLE, -160 / 9.0::DOUBLE), ('mm^2', 'area', 'm²', 0.000001::DOUBLE, 0), ('kmh', 'speed', 'm/s', 1 / 3.6::DOUBLE, 0), ('PSI', 'pressure', 'kPa', 6.894757293::DOUBLE, 0), ('kW', 'power', 'kW', 1.0::DOUBLE, 0)) t(unit, family, canonical, scale, shift))"""


def _with_units(spark, sf):
    texts = ["km/h", " mm ", "fahrenheit", "PSI", "furlong", "kW", "mm^2", "kmh"]
    return events(spark, sf).select("ordinal", "value", "k", "source_id", F.element_at(F.array(*map(F.lit, texts)), F.col("k") % 8 + 1).alias("unit"))


@query("U1", _UNITS + " SELECT ordinal, family, canonical, CASE family WHEN 'speed' THEN 1 WHEN 'length' THEN 0 WHEN 'temperature' THEN 23 WHEN 'pressure' THEN 13 WHEN 'power' THEN 11 WHEN 'area' THEN 21 END AS axis FROM un LEFT JOIN ru USING (unit)")
def resolved(spark, sf):
    return U.resolve(_with_units(spark, sf), "unit").select("ordinal", "family", "canonical", "axis")


@query("U2", _UNITS + " SELECT ordinal, round(CASE WHEN family = 'speed' THEN value * scale / 0.44704 WHEN family = 'length' THEN value ELSE value END, 9) AS converted FROM un LEFT JOIN ru USING (unit)")
def converted(spark, sf):
    rows = _with_units(spark, sf).withColumn("target", F.lit("mph"))
    return U.convert(rows, "value", "unit", "target").select("ordinal", F.round("converted", 9).alias("converted"))


@query("U2_canonical", _UNITS + " SELECT ordinal, round(CASE WHEN family IS NULL THEN value ELSE value * scale + shift END, 6) AS converted, coalesce(canonical, unit) AS shown_unit FROM un LEFT JOIN ru USING (unit)")
def canonical(spark, sf):
    return U.convert(_with_units(spark, sf), "value", "unit").select("ordinal", F.round("converted", 6).alias("converted"), "shown_unit")


@query("U3", ", g AS (SELECT user_id AS key, count(DISTINCT CASE k % 2 WHEN 0 THEN 'km' ELSE 'mm' END) AS n, arg_min(CASE k % 2 WHEN 0 THEN 'km' ELSE 'mm' END, ordinal) AS u FROM fr GROUP BY 1) SELECT key, CASE WHEN n = 1 THEN u ELSE 'm' END AS unit FROM g")
def preferred(spark, sf):
    rows = events(spark, sf).select(F.col("user_id").alias("key"), "ordinal", F.when(F.col("k") % 2 == 0, "km").otherwise("mm").alias("unit"))
    return U.preferred(rows, ["key"], "unit", "ordinal")


@query("U4", _UNITS + """, ut AS (SELECT ordinal, family, CASE WHEN k % 8 = 4 AND ordinal % 2 = 0 THEN 'Furlong' WHEN k % 8 = 7 AND ordinal % 3 = 0 THEN '  ' WHEN k % 8 = 7 AND ordinal % 3 = 1 THEN NULL ELSE unit END AS unit FROM un LEFT JOIN ru USING (unit)),
 gr AS (SELECT ordinal, CASE WHEN coalesce(trim(unit), '') = '' THEN NULL ELSE family END AS family, coalesce(trim(unit), '') AS unit FROM ut)
 SELECT CASE WHEN family IS NOT NULL THEN 'family:' || family WHEN unit <> '' THEN 'unit:' || lower(unit) ELSE 'empty' END AS axis, count(*) AS n,
  arg_min(CASE WHEN family = 'length' THEN 'Distance / length' WHEN family IS NOT NULL THEN upper(family[1]) || family[2:] WHEN unit <> '' THEN unit ELSE 'No unit' END, ordinal) AS label,
  min(CASE family WHEN 'speed' THEN 1 WHEN 'length' THEN 0 WHEN 'temperature' THEN 23 WHEN 'pressure' THEN 13 WHEN 'power' THEN 11 WHEN 'area' THEN 21 ELSE CASE WHEN unit <> '' THEN 10000 ELSE 20000 END END) AS axis_order FROM gr GROUP BY 1""")
def axes(spark, sf):
    """Signals by the axis of their unit: families, other texts in any case, and those without a unit."""
    other = F.when((F.col("k") % 8 == 4) & (F.col("ordinal") % 2 == 0), "Furlong").when((F.col("k") % 8 == 7) & (F.col("ordinal") % 3 == 0), "  ")
    rows = _with_units(spark, sf).withColumn("unit", F.when((F.col("k") % 8 == 7) & (F.col("ordinal") % 3 == 1), None).otherwise(F.coalesce(other, "unit")))
    g = U.unit_groups(rows, "unit").groupBy(F.col("group_key").alias("axis"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min_by("group_label", "ordinal").alias("label"), F.min("group_order").alias("axis_order"))


@query("U6", """, f AS (SELECT * FROM (VALUES ('f1', 291, false, 'Speed'), ('f2', 419385573, true, ''), ('f3', 784, false, 'Empty')) t(frame_id, can_id, extended, name)),
 d AS (SELECT DISTINCT user_id, k % 4 AS g FROM fr),
 s AS (SELECT 'frame' AS kind, 'frame:f' || user_id % 2 + 1 AS group_id, CASE user_id % 2 WHEN 0 THEN '123 Speed' ELSE '18FF50E5' END AS label, user_id AS seq, 'u' || user_id AS signal_id FROM (SELECT DISTINCT user_id FROM fr)
  UNION ALL SELECT 'plugin', 'plugin:b' || user_id % 2 || ':' || CASE g WHEN 0 THEN '' ELSE 'group%20' || g END, CASE user_id % 2 WHEN 0 THEN 'Plugin p · 123' ELSE 'Plugin q' END || CASE g WHEN 0 THEN '' ELSE ' · group ' || g END, user_id * 4 + g, 'p' || user_id || '.' || g FROM d
  UNION ALL SELECT 'measured', 'mdf:' || CASE WHEN user_id % 5 = 0 THEN '' ELSE 'ch%2F' || user_id % 5 END, CASE WHEN user_id % 5 = 0 THEN 'CSV' ELSE 'MF4 · ch/' || user_id % 5 END, user_id, 'm' || user_id FROM (SELECT DISTINCT user_id FROM fr))
 SELECT kind, group_id, any_value(label) AS label, string_agg(signal_id, ',' ORDER BY seq) AS signals FROM s GROUP BY ALL""")
def grouped(spark, sf):
    """Signals of frames, of plugin bindings and their groups, and of channel groups."""
    from ..operators.catalogue import catalogue_groups

    u = events(spark, sf).select("user_id", (F.col("k") % 4).alias("g"))
    one = u.select("user_id").distinct()
    none = F.lit(None).cast("string")
    frame = one.select(F.lit("frame").alias("kind"), F.concat(F.lit("u"), "user_id").alias("signal_id"), F.col("user_id").alias("seq"), F.concat(F.lit("f"), F.col("user_id") % 2 + 1).alias("frame_id"), none.alias("binding_id"), none.alias("plugin_group"), none.alias("channel_group"), none.alias("format"))
    plugin = u.distinct().select(F.lit("plugin"), F.concat(F.lit("p"), "user_id", F.lit("."), "g"), F.col("user_id") * 4 + F.col("g"), none, F.concat(F.lit("b"), F.col("user_id") % 2), F.when(F.col("g") > 0, F.concat(F.lit("group "), "g")), none, none)
    channel = F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("ch/"), F.col("user_id") % 5))
    measured = one.select(F.lit("measured"), F.concat(F.lit("m"), "user_id"), "user_id", none, none, none, channel, F.when(channel.isNull(), "CSV"))
    frames_ = spark.createDataFrame([("f1", 0x123, False, "Speed"), ("f2", 0x18FF50E5, True, ""), ("f3", 0x310, False, "Empty")], "frame_id string, can_id int, extended boolean, name string")
    bindings = spark.createDataFrame([("b0", "p", "f1"), ("b1", "q", "gone"), ("b2", "r", "f2")], "binding_id string, plugin_id string, frame_id string")
    g = catalogue_groups(frame.union(plugin).union(measured), frames_, bindings)
    return g.select("kind", "group_id", "label", F.array_join("signal_ids", ",").alias("signals"))


@query("C1", ", r AS (SELECT *, min(value) FILTER (usable) OVER (PARTITION BY signal_id) AS lo, max(value) FILTER (usable) OVER (PARTITION BY signal_id) AS hi FROM sa) SELECT signal_id, ordinal, round((value - lo) / (hi - lo) * 100, 9) AS share FROM r")
def normalised(spark, sf):
    return O.normalise(samples(spark, sf), KEY).select("signal_id", "ordinal", F.round("share", 9).alias("share"))


_SEEN = f"t_us BETWEEN {FROM} AND {TO}"


@query("C2", f"""SELECT signal_id, 'visible' AS mode, least(0.0::DOUBLE, coalesce(min(value) FILTER (usable AND {_SEEN}), min(value) FILTER (usable))) AS lo, greatest(0.0::DOUBLE, coalesce(max(value) FILTER (usable AND {_SEEN}), max(value) FILTER (usable))) AS hi FROM sa GROUP BY signal_id
 UNION ALL SELECT signal_id, 'global', min(value * 3.6::DOUBLE + 1) FILTER (usable), max(value * 3.6::DOUBLE + 1) FILTER (usable) FROM sa GROUP BY signal_id UNION ALL SELECT DISTINCT signal_id, 'manual', -5.0::DOUBLE, 20.0::DOUBLE FROM sa
 UNION ALL SELECT signal_id, 'shifted', coalesce(min(value) FILTER (usable AND t_us - sh BETWEEN 0 AND 86400000000), min(value) FILTER (usable)), coalesce(max(value) FILTER (usable AND t_us - sh BETWEEN 0 AND 86400000000), max(value) FILTER (usable)) FROM (SELECT *, min(t_us) OVER (PARTITION BY source_id) AS sh FROM sa) GROUP BY signal_id""")
def ranges(spark, sf):
    """Visible with zero, global in another unit, manual, and by each log's own time."""
    s = samples(spark, sf)
    shifted = S.totals(s, ["source_id"], sh=F.min("t_us"))
    parts = {
        "visible": O.value_range(s, KEY, FROM, TO, True), "global": O.value_range(s, KEY, FROM, TO, mode="global", scale=3.6, shift=1.0), "manual": O.value_range(s, KEY, FROM, TO, mode="manual", manual=(20.0, -5.0)),
        "shifted": O.value_range(shifted, KEY, 0, 86400000000, shift_us="sh"),
    }
    out = None
    for mode, part in parts.items():
        part = part.select("signal_id", F.lit(mode).alias("mode"), "lo", "hi")
        out = part if out is None else out.union(part)
    return out


_LINE = """, g AS (SELECT signal_id, bt AS a, t_us AS b FROM (SELECT *, lag(t_us) OVER (PARTITION BY signal_id ORDER BY t_us) AS bt FROM sa) WHERE t_us - bt > 5400000000),
 pr AS (SELECT DISTINCT signal_id, (t_us // 7200000000) * 7200000000 AS t_us FROM sa),
 u AS (SELECT * FROM sa WHERE usable),
 b AS (SELECT pr.*, u.t_us AS t0, u.value AS v0 FROM pr ASOF LEFT JOIN u ON pr.signal_id = u.signal_id AND pr.t_us >= u.t_us),
 n AS (SELECT b.*, u.t_us AS t1, u.value AS v1 FROM b ASOF LEFT JOIN u ON b.signal_id = u.signal_id AND b.t_us <= u.t_us),
 x AS (SELECT n.*, EXISTS (SELECT 1 FROM sa WHERE sa.signal_id = n.signal_id AND NOT usable AND sa.t_us > t0 AND sa.t_us < t1) AS skipped,
   EXISTS (SELECT 1 FROM g WHERE g.signal_id = n.signal_id AND a < t1 AND b > t0) AS cut FROM n)"""


def _gaps(spark, sf):
    return S.long_steps(samples(spark, sf), KEY, 5400000000)


@query("C3", _LINE + " SELECT signal_id, t_us, round(CASE WHEN t0 = t_us THEN v0 WHEN NOT skipped AND NOT cut THEN v0 + (v1 - v0) * ((t_us - t0)::DOUBLE / (t1 - t0)) END, 9) AS value FROM x")
def on_line(spark, sf):
    s = samples(spark, sf)
    p = s.select("signal_id", (F.floor(F.col("t_us") / 7200000000) * 7200000000).alias("t_us")).distinct()
    return O.line_value(p, s, _gaps(spark, sf), KEY).select("signal_id", "t_us", F.round("value", 9).alias("value"))


@query("C4", """, g AS (SELECT signal_id, bt AS a, t_us AS b FROM (SELECT *, lag(t_us) OVER (PARTITION BY signal_id ORDER BY t_us) AS bt FROM sa) WHERE t_us - bt > 5400000000),
 s AS (SELECT signal_id, lag(t_us) OVER (PARTITION BY signal_id ORDER BY t_us) AS left_us, t_us AS right_us FROM sa WHERE usable)
 SELECT signal_id, left_us, right_us, EXISTS (SELECT 1 FROM g WHERE g.signal_id = s.signal_id AND a < right_us AND b > left_us) AS crosses FROM s WHERE left_us IS NOT NULL""")
def crossing(spark, sf):
    s = samples(spark, sf).filter(S.usable())
    seg = s.withColumn("left_us", F.lag("t_us").over(S.series_window(KEY))).filter("left_us is not null").select("signal_id", "left_us", F.col("t_us").alias("right_us"))
    return O.crosses(seg, _gaps(spark, sf), KEY)


_RUN = """, r AS (SELECT *, CASE WHEN usable AND coalesce(NOT lag(usable) OVER w OR t_us - lag(t_us) OVER w > 5400000000, true) THEN 1 ELSE 0 END AS b FROM sa WINDOW w AS (PARTITION BY signal_id ORDER BY t_us, ordinal)),
 q AS (SELECT *, sum(b) OVER (PARTITION BY signal_id ORDER BY t_us, ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM r)"""


@query("C5", _RUN + " SELECT signal_id, ordinal, t_us - 1000 AS t_us, run FROM q WHERE usable")
def runs(spark, sf):
    return O.drawable_runs(samples(spark, sf), KEY, F.lit(5400000000), 1000).select("signal_id", "ordinal", "t_us", "run")


@query("C6", _RUN + f""", n AS (SELECT *, lead(t_us) OVER w AS nt, lead(value) OVER w AS nv, lead(run) OVER w AS nr FROM (SELECT * FROM q WHERE usable) WINDOW w AS (PARTITION BY signal_id ORDER BY t_us, ordinal)),
 e AS (SELECT signal_id, value AS v FROM n WHERE t_us BETWEEN {FROM} AND {TO} UNION ALL SELECT signal_id, value + (nv - value) * ((x - t_us)::DOUBLE / (nt - t_us)) FROM n, (VALUES ({FROM}), ({TO})) t(x) WHERE nr = run AND t_us < x AND nt > x),
 v AS (SELECT signal_id, min(v) AS lo, max(v) AS hi FROM e GROUP BY signal_id) SELECT signal_id, round(lo, 9) AS lo, round(hi, 9) AS hi, NOT (hi - lo > greatest(abs(lo), abs(hi)) * 1e-12) AS flat FROM v""")
def lanes(spark, sf):
    g = O.lane_extremes(samples(spark, sf), KEY, F.lit(5400000000), FROM, TO)
    return g.select("signal_id", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "flat")


@query("C7", ", pr AS (SELECT DISTINCT (t_us // 7200000000) * 7200000000 AS probe FROM fr) SELECT probe, (SELECT arg_min(t_us, {'d': abs(t_us - probe), 't': t_us}) FROM sa WHERE usable AND signal_id IN ('click', 'error')) AS nearest_us FROM pr")
def reference_time(spark, sf):
    from ..operators.asof import nearest

    s = samples(spark, sf).filter(S.usable() & F.col("signal_id").isin("click", "error")).select(F.lit(1).alias("one"), "t_us", "ordinal")
    p = frames(spark, sf).select(F.lit(1).alias("one"), (F.floor(F.col("t_us") / 7200000000) * 7200000000).alias("t_us")).distinct()
    return nearest(p, s, ["one"], order=["ordinal"]).select(F.col("t_us").alias("probe"), F.col("nearest.t_us").alias("nearest_us"))


def _axis(spark, sf, name):
    e = events(spark, sf).withColumn("t_us", F.floor(F.col("t_us") / 600000000) * 600000000)
    quality = F.when(F.col("k") % 17 == 0, "invalid").otherwise("valid")
    return e.select("t_us", "ordinal", F.col(name).cast("double").alias("value"), quality.alias("quality"))


_TRJ = ", tr AS (SELECT (t_us // 600000000) * 600000000 AS t_us, row_number() OVER (PARTITION BY t_us // 600000000 ORDER BY ordinal)::INTEGER AS k, -value AS x, user_id::DOUBLE AS y, k::DOUBLE AS z, k % 17 <> 0 AS ok FROM fr), pt AS (SELECT t_us, k, x, y, z FROM tr WHERE ok)"


def _points(spark, sf):
    return O.trajectory(_axis(spark, sf, "value"), _axis(spark, sf, "user_id"), _axis(spark, sf, "k"), (True, False, False))


@query("J1", _TRJ + " SELECT * FROM pt")
def points(spark, sf):
    return _points(spark, sf)


@query("J1_thinned", _TRJ + ", th_src AS (SELECT *, 0 AS path, row_number() OVER (ORDER BY t_us, k) - 1 AS p, count(*) OVER () AS n, 60 AS most, false AS broken FROM pt)" + thinned_sql(["path"], ("x", "y", "z"), 10) + " SELECT t_us, k, x, y, z FROM th_src JOIN th_kept USING (path, p)")
def thinned_points(spark, sf):
    return O.thin_points(_points(spark, sf), 60)


@query("J2", _TRJ + " SELECT t_us, k FROM pt WHERE t_us BETWEEN 1705500000000000 - 3600000000 AND 1705500000000000")
def trail(spark, sf):
    return O.recent(_points(spark, sf), TO, 3600000000).select("t_us", "k")


_ONE = ", p1 AS (SELECT t_us, 1 AS k, value AS x, user_id::DOUBLE AS y FROM fr)"


def _single(spark, sf):
    return events(spark, sf).select("t_us", F.lit(1).alias("k"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))


@query("J3", _ONE + f""", n AS (SELECT *, lead(t_us) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM p1 WINDOW w AS (ORDER BY t_us))
 SELECT t_us, round(x, 9) AS x, round(y, 9) AS y, false AS carried FROM p1 WHERE t_us BETWEEN {FROM} AND {TO}
 UNION ALL SELECT e, round(x + (nx - x) * ((e - t_us)::DOUBLE / (nt - t_us)), 9), round(y + (ny - y) * ((e - t_us)::DOUBLE / (nt - t_us)), 9), true FROM n, (VALUES ({FROM}), ({TO})) v(e) WHERE t_us < e AND nt > e""")
def clip_edges(spark, sf):
    e = O.edge_points(_single(spark, sf), FROM, TO)
    return e.select("t_us", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "carried")


_CLIP_TO = TO - 300000000


@query("J3_clip", f""", tb AS (SELECT (t_us // 600000000) * 600000000 AS t_us, ordinal, value AS x, -user_id::DOUBLE AS y, k::DOUBLE AS z, k % 17 <> 0 AS ok FROM fr),
 ins AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t_us ORDER BY ordinal) AS k FROM tb WHERE t_us BETWEEN {FROM} AND {_CLIP_TO}) WHERE ok),
 far AS (SELECT {FROM} AS edge, * FROM (SELECT * FROM tb WHERE t_us < {FROM} ORDER BY t_us DESC, ordinal DESC LIMIT 1) UNION ALL SELECT {_CLIP_TO}, * FROM (SELECT * FROM tb WHERE t_us > {_CLIP_TO} ORDER BY t_us, ordinal LIMIT 1)),
 near AS (SELECT {FROM} AS edge, * FROM (SELECT * FROM ins ORDER BY t_us, k LIMIT 1) UNION ALL SELECT {_CLIP_TO}, * FROM (SELECT * FROM ins ORDER BY t_us DESC, k DESC LIMIT 1)),
 cr AS (SELECT edge, f.x + (n.x - f.x) * ((edge - f.t_us)::DOUBLE / (n.t_us - f.t_us)) AS x, f.y + (n.y - f.y) * ((edge - f.t_us)::DOUBLE / (n.t_us - f.t_us)) AS y, f.z + (n.z - f.z) * ((edge - f.t_us)::DOUBLE / (n.t_us - f.t_us)) AS z FROM far f JOIN near n USING (edge) WHERE f.ok AND NOT EXISTS (SELECT 1 FROM tb WHERE tb.t_us = edge))
 SELECT t_us, x, y, z, false AS carried FROM ins UNION ALL SELECT edge, round(x, 9), round(y, 9), round(z, 9), true FROM cr""")
def clip_path(spark, sf):
    """The path of a clip from its axes and their carried samples, ended at the clip's edges."""
    clips = spark.range(1).selectExpr("1 AS one", f"{FROM} AS start_us", f"{_CLIP_TO} AS end_us")
    axes = [V.drawn(_axis(spark, sf, name).withColumn("one", F.lit(1)), ["one"], clips=clips) for name in ("value", "user_id", "k")]
    p = V.clip_path(O.trajectory(*axes, invert=(False, True, False)), FROM, _CLIP_TO)
    return p.select("t_us", *(F.round(c, 9).alias(c) for c in "xyz"), "carried")


@query("J4", _ONE + """, w AS (SELECT *, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) AS piece FROM p1 WINDOW o AS (ORDER BY t_us)),
 ends AS (SELECT min(t_us) AS a, max(t_us) AS b FROM p1), pa AS (SELECT p1.* FROM p1, ends WHERE t_us = a), pb AS (SELECT p1.* FROM p1, ends WHERE t_us = b)
 SELECT pb.x - pa.x AS dx, pb.y - pa.y AS dy, round(sqrt((pb.x - pa.x) ** 2 + (pb.y - pa.y) ** 2), 6) AS straight, round((SELECT sum(piece) FROM w), 4) AS path, round((SELECT sum(piece) FROM w) / ((pb.t_us - pa.t_us) / 1e6), 6) AS speed FROM pa, pb""")
def measured(spark, sf):
    p = _single(spark, sf)
    first, last = p.agg(F.min("t_us"), F.max("t_us")).first()
    m = O.path_measure(p, first, last)
    return m.select("dx", "dy", F.round("straight", 6).alias("straight"), F.round("path", 4).alias("path"), F.round("speed", 6).alias("speed"))


@query("J5", _TRJ + " SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, (min(x) + max(x)) / 2 AS cx, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS span FROM pt")
def extent(spark, sf):
    return O.extent(_points(spark, sf)).select("x0", "x1", "y0", "y1", "cx", "span")


@query("P1", "SELECT source_id, channel, min(ordinal) AS ordinal FROM fr GROUP BY ALL")
def unique_targets(spark, sf):
    return O.unique_targets(events(spark, sf), ["source_id", "channel"]).select("source_id", "channel", "ordinal")


@query("P2", ", st AS (SELECT source_id, min(t_us) AS start FROM fr GROUP BY 1) SELECT ordinal, t_us - (start + 2500000) AS at_us FROM fr JOIN st USING (source_id)")
def overlaid(spark, sf):
    return O.overlaid(frames(spark, sf), ["source_id"], 2500000).select("ordinal", "at_us")


_TIMES = ", ends AS (SELECT source_id, min(t_us) AS lo, max(t_us) AS hi FROM fr GROUP BY 1)"


@query("P3", _TIMES + """, an AS (SELECT source_id, lo, hi, unnest([lo - 7200000000, lo + 3600000000, hi - 1800000000, hi + 3600000000]) AS anchor FROM ends),
 m AS (SELECT *, CASE WHEN anchor < lo THEN 2 * lo - anchor WHEN anchor > hi THEN 2 * hi - anchor ELSE anchor END AS t FROM an),
 n AS (SELECT m.source_id, anchor, lo, hi, arg_min(t_us, {'d': abs(t_us - t), 't': t_us}) AS near FROM m JOIN fr USING (source_id) GROUP BY ALL)
 SELECT source_id, anchor, CASE WHEN anchor < lo THEN 2 * lo - near WHEN anchor > hi THEN 2 * hi - near ELSE near END AS snapped FROM n""")
def snapped(spark, sf):
    f = frames(spark, sf)
    ends = f.groupBy("source_id").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    anchors = ends.select("source_id", F.explode(F.array(F.expr("lo - 7200000000"), F.expr("lo + 3600000000"), F.expr("hi - 1800000000"), F.expr("hi + 3600000000"))).alias("anchor"))
    return O.snap(anchors, f, ["source_id"])


@query("P4", _TIMES + """, d AS (SELECT source_id, t_us, row_number() OVER (PARTITION BY source_id ORDER BY t_us) - 1 AS i, count(*) OVER (PARTITION BY source_id) - 1 AS last FROM (SELECT DISTINCT source_id, t_us FROM fr)),
 s AS (SELECT *, CASE WHEN i + 3 > last THEN 2 * last - i - 3 ELSE i + 3 END AS j FROM d)
 SELECT s.source_id, s.t_us, CASE WHEN s.i + 3 > s.last THEN 2 * hi - d.t_us ELSE d.t_us END AS stepped FROM s JOIN d ON s.source_id = d.source_id AND s.j = d.i JOIN ends ON ends.source_id = s.source_id""")
def stepped(spark, sf):
    return O.steps_from(frames(spark, sf), ["source_id"], 3)


@query("P5", """, o AS (SELECT user_id AS signal, list_sort(list(DISTINCT source_id || '/' || channel)) AS owners FROM fr GROUP BY 1), a AS (SELECT count(DISTINCT (source_id, channel)) AS n FROM fr)
 SELECT signal, array_to_string(owners, ',') AS owners, len(owners) = n AS common, n - len(owners) < len(owners) AS name_missing FROM o, a""")
def owners(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("signal"), F.concat("source_id", F.lit("/"), "channel").alias("target"))
    return O.signal_owners(e, "signal", "target").withColumn("owners", F.array_join("owners", ","))


_PAIR = ["source_id", "signal_id"]
_WANTED = ", wa AS (SELECT * FROM sa WHERE signal_id IN ('click', 'view')), ta AS (SELECT count(DISTINCT source_id) AS targets FROM wa)"
_KEPT = " SELECT source_id, signal_id, ordinal FROM th_src JOIN th_kept USING (source_id, signal_id, p)"


@query("P6", _WANTED + broken_sql("wa", _PAIR, "(SELECT greatest(2, least(4000, 100000 // (2 * targets))) FROM ta)") + thinned_sql(_PAIR) + _KEPT)
def per_target(spark, sf):
    """Series of each target within the budget of all targets and signals."""
    return V.compared_series(samples(spark, sf), ["click", "view"], pairs=S.PICKED_PAIRS).select("source_id", "signal_id", "ordinal")


_VIEWS = """, vw AS (SELECT source_id, lo + (hi - lo) // 4 AS start_us, hi - (hi - lo) // 4 AS end_us FROM (SELECT source_id, min(t_us) AS lo, max(t_us) AS hi FROM sa GROUP BY 1) WHERE source_id <> 'log3'),
 cp AS (SELECT source_id, CASE source_id WHEN 'log1' THEN lo + (hi - lo) // 3 WHEN 'log2' THEN lo - 10 ELSE lo END AS start_us, CASE source_id WHEN 'log1' THEN hi + 10 WHEN 'log2' THEN lo - 1 ELSE hi - (hi - lo) // 3 END AS end_us FROM (SELECT source_id, min(t_us) AS lo, max(t_us) AS hi FROM sa GROUP BY 1) WHERE source_id <> 'log0'),
 sl AS (SELECT wa.*, cp.start_us AS c0, cp.end_us AS c1, coalesce(greatest(cp.start_us, vw.start_us), cp.start_us, vw.start_us) AS v0, coalesce(least(cp.end_us, vw.end_us), cp.end_us, vw.end_us) AS v1 FROM wa LEFT JOIN cp USING (source_id) LEFT JOIN vw USING (source_id)),
 kc AS (SELECT *, c0 IS NOT NULL AND NOT t_us BETWEEN c0 AND c1 AS carried FROM (SELECT *, max(CASE WHEN t_us < c0 THEN {'t': t_us, 'o': ordinal} END) OVER w AS lc, min(CASE WHEN t_us > c1 THEN {'t': t_us, 'o': ordinal} END) OVER w AS rc,
   coalesce(bool_or(t_us = c0) OVER w, false) AS e0, coalesce(bool_or(t_us = c1) OVER w, false) AS e1 FROM sl WINDOW w AS (PARTITION BY source_id, signal_id))
   WHERE c0 IS NULL OR t_us BETWEEN c0 AND c1 OR (NOT e0 AND lc = {'t': t_us, 'o': ordinal}) OR (NOT e1 AND rc = {'t': t_us, 'o': ordinal})),
 dr AS (SELECT *, v0 IS NULL OR t_us BETWEEN v0 AND v1 AS inside FROM (SELECT *, max(CASE WHEN t_us < v0 THEN {'t': t_us, 'o': ordinal} END) OVER w AS lv, min(CASE WHEN t_us > v1 THEN {'t': t_us, 'o': ordinal} END) OVER w AS rv FROM kc WINDOW w AS (PARTITION BY source_id, signal_id))
   WHERE v0 IS NULL OR (v0 <= v1 AND (t_us BETWEEN v0 AND v1 OR lv = {'t': t_us, 'o': ordinal} OR rv = {'t': t_us, 'o': ordinal})))"""


def _views(s):
    """Views of three targets and clips of three: one target has a view alone, one a clip alone, one a clip beside its samples."""
    ends = s.groupBy("source_id").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    views = ends.filter("source_id <> 'log3'").selectExpr("source_id", "lo + (hi - lo) div 4 AS start_us", "hi - (hi - lo) div 4 AS end_us")
    start = "CASE source_id WHEN 'log1' THEN lo + (hi - lo) div 3 WHEN 'log2' THEN lo - 10 ELSE lo END AS start_us"
    end = "CASE source_id WHEN 'log1' THEN hi + 10 WHEN 'log2' THEN lo - 1 ELSE hi - (hi - lo) div 3 END AS end_us"
    return views, ends.filter("source_id <> 'log0'").selectExpr("source_id", start, end)


@query("P6_drawn", _WANTED + _VIEWS + " SELECT source_id, signal_id, ordinal, inside, carried FROM dr")
def drawn_samples(spark, sf):
    """What each target draws of its view and its clip, before thinning."""
    s = samples(spark, sf)
    d = V.drawn(s.filter(F.col("signal_id").isin("click", "view")), _PAIR, *_views(s))
    return d.select("source_id", "signal_id", "ordinal", "inside", "carried")


@query("P6_zoom", _WANTED + _VIEWS + broken_sql("dr", _PAIR, "(SELECT 400 // (2 * targets) FROM ta)") + thinned_sql(_PAIR) + " SELECT source_id, signal_id, ordinal, dr.inside, dr.carried FROM th_src JOIN th_kept USING (source_id, signal_id, p) JOIN dr USING (source_id, signal_id, ordinal)")
def zoomed(spark, sf):
    """Zoomed and clipped series, thinned over the part that shows."""
    s = samples(spark, sf)
    views, clips = _views(s)
    return V.compared_series(s, ["click", "view"], total=400, views=views, clips=clips, pairs=S.PICKED_PAIRS).select("source_id", "signal_id", "ordinal", "inside", "carried")


@query("P6_joined", _WANTED.replace("wa AS (SELECT *", "wa AS (SELECT * REPLACE ((t_us // 1800000000) * 1800000000 AS t_us)") + broken_sql("wa", _PAIR, "(SELECT 60 // count(DISTINCT signal_id) FROM wa w WHERE w.source_id = th_b.source_id)") + thinned_sql(_PAIR) + """,
 tm AS (SELECT DISTINCT source_id, t_us FROM th_src JOIN th_kept USING (source_id, signal_id, p)),
 sh AS (SELECT wa.*, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source_id, signal_id) AS m FROM wa SEMI JOIN tm USING (source_id, t_us) WINDOW w AS (PARTITION BY source_id, signal_id ORDER BY t_us, ordinal))
 SELECT source_id, signal_id, ordinal FROM sh WHERE m <= 60 OR i IN (SELECT floor(j * (m - 1) / 59.0 + 0.5) FROM range(60) g(j))""")
def joined_axes(spark, sf):
    """Two axes of a trajectory thinned together, on times that both share."""
    s = samples(spark, sf).withColumn("t_us", F.expr("t_us div 1800000000 * 1800000000"))
    return V.compared_series(s, ["click", "view"], joined=True, points=60, pairs=S.PICKED_PAIRS).select("source_id", "signal_id", "ordinal")


@query("P6_budget", "SELECT source_id, signal_id, true AS within FROM sa WHERE signal_id IN ('click', 'view') GROUP BY ALL")
def per_target_budget(spark, sf):
    """A tenth of the budget: every series keeps its extremes and stays inside."""
    s = samples(spark, sf)
    total = 400
    g = V.compared_series(s, ["click", "view"], total=total).groupBy("source_id", "signal_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(S.usable(), F.col("value"))).alias("hi"))
    whole = s.groupBy("source_id", "signal_id").agg(F.max(F.when(S.usable(), F.col("value"))).alias("top"))
    n = s.select("source_id").distinct().count()
    return g.join(whole, ["source_id", "signal_id"]).select("source_id", "signal_id", ((F.col("n") <= O.point_budget(n, 2, total)) & (F.col("hi") == F.col("top"))).alias("within"))


_CLIPS = f", cl AS (SELECT * FROM (VALUES ('log0', 'a', {FROM}, {TO}), ('log1', 'a', {FROM}, {FROM} + 90000000000), ('log1', 'b', {FROM}, {TO} + 5), ('log9', 'c', 0, 1)) t(source_id, clip_id, start_us, end_us))"


def _clips(spark):
    return spark.createDataFrame([("log0", "a", FROM, TO), ("log1", "a", FROM, FROM + 90000000000), ("log1", "b", FROM, TO + 5), ("log9", "c", 0, 1)], "source_id string, clip_id string, start_us long, end_us long")


@query("K1", _CLIPS + " SELECT source_id, clip_id, ordinal FROM sa JOIN cl USING (source_id) WHERE t_us BETWEEN start_us AND end_us")
def clip_scope(spark, sf):
    return O.in_clips(samples(spark, sf), _clips(spark)).select("source_id", "clip_id", "ordinal")


@query("K2", "SELECT ordinal, round((raw % 5000 - 500) / 7::DOUBLE, 6) AS start_s, round((raw % 5000 - 500 + k - 20) / 7::DOUBLE, 6) AS end_s FROM fr WHERE raw % 5000 >= 500 AND round((raw % 5000 - 500 + k - 20) / 7::DOUBLE, 6) > round((raw % 5000 - 500) / 7::DOUBLE, 6)")
def clip_rules(spark, sf):
    from ..operators.definitions import valid_clips

    e = events(spark, sf).select("ordinal", ((F.col("raw") % 5000 - 500) / 7).alias("start_s"), ((F.col("raw") % 5000 - 500 + F.col("k") - 20) / 7).alias("end_s"))
    return valid_clips(e)[0].select("ordinal", "start_s", "end_s")


@query("K4", "SELECT ordinal, source_id, 'c' || k || CASE WHEN row_number() OVER (PARTITION BY source_id, k ORDER BY ordinal) = 1 THEN '' ELSE '-' || row_number() OVER (PARTITION BY source_id, k ORDER BY ordinal) END AS clip_id FROM fr")
def clip_ids(spark, sf):
    from ..operators.definitions import unique_ids

    e = events(spark, sf).select("ordinal", "source_id", F.concat(F.lit("c"), "k").alias("clip_id"))
    return unique_ids(e, ["source_id"], "clip_id", "ordinal")


@query("K6", _CLIPS + """, ed AS (SELECT source_id, clip_id, start_us, end_us FROM cl WHERE source_id <> 'log9')
 SELECT source_id, clip_id, (SELECT arg_min(t_us, {'d': abs(t_us - start_us), 't': t_us}) FROM fr WHERE fr.source_id = ed.source_id) AS start_us, (SELECT arg_min(t_us, {'d': abs(t_us - end_us), 't': t_us}) FROM fr WHERE fr.source_id = ed.source_id) AS end_us FROM ed""")
def clip_snap(spark, sf):
    from ..operators.asof import nearest

    f = frames(spark, sf).select("source_id", "t_us", "ordinal")
    c = _clips(spark).filter("source_id <> 'log9'")
    ends = c.select("source_id", "clip_id", F.explode(F.map_from_arrays(F.array(F.lit("start_us"), F.lit("end_us")), F.array("start_us", "end_us"))).alias("edge", "t_us"))
    n = nearest(ends, f, ["source_id"], order=["ordinal"])
    return n.groupBy("source_id", "clip_id").pivot("edge", ["start_us", "end_us"]).agg(F.first("nearest.t_us"))
