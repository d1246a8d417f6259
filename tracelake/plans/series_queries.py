"""Queries over series of samples."""

from pyspark.sql import functions as F

from ..operators import series as O
from ..operators.views import thinned_for_graph
from .registry import query
from .tables import events, order_samples, samples
from .thinning_sql import broken_sql, thinned_sql

IDS = ["click", "view", "signup"]
KEY = ["signal_id"]
#: A range of times in the middle of the events.
FROM, TO = 1704500000000000, 1705500000000000


def marked(spark, sf):
    """Samples with NaN read as null, so that results have no NaN."""
    return samples(spark, sf).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def orders(spark, sf):
    return order_samples(spark, sf).select(F.concat(F.lit("key"), F.col("key")).alias("signal_id"), "ordinal", F.lit(0).alias("seq"), "t_us", "ts", "value", F.lit("valid").alias("quality"), F.lit(None).cast("string").alias("value_label"))


@query("G1", "SELECT DISTINCT signal_id FROM sa WHERE signal_id IN ('click', 'purchase', 'none')")
def catalog(spark, sf):
    wanted = spark.createDataFrame([("click",), ("purchase",), ("none",)], "signal_id string")
    return wanted.join(samples(spark, sf), "signal_id", "left_semi")


@query("G2", """, k AS (SELECT key, t_us, value, row_number() OVER (PARTITION BY key, t_us ORDER BY ordinal)::INTEGER AS k FROM od WHERE key IN (1, 2, 3))
 SELECT t_us, k, max(value) FILTER (key = 1) AS key1, max(value) FILTER (key = 2) AS key2, max(value) FILTER (key = 3) AS key3 FROM k GROUP BY ALL""")
def aligned(spark, sf):
    return O.align(orders(spark, sf), [], ["key1", "key2", "key3"])


@query("G3", "SELECT ordinal, max(value) FILTER (signal_id = 'click') AS click, max(value) FILTER (signal_id = 'view') AS view, max(value) FILTER (signal_id = 'signup') AS signup FROM sa WHERE signal_id IN ('click', 'view', 'signup') AND t_us BETWEEN 1704500000000000 AND 1705500000000000 GROUP BY ordinal")
def wide(spark, sf):
    return O.wide(marked(spark, sf).filter(F.col("t_us").between(FROM, TO)), ["ordinal"], IDS)


@query("G4", "SELECT t_us, arg_max(value, ordinal) FILTER (key = 1) AS key1, arg_max(value, ordinal) FILTER (key = 2) AS key2 FROM od WHERE key IN (1, 2) GROUP BY t_us")
def last_in_row(spark, sf):
    return O.wide(orders(spark, sf).withColumn("seq", F.col("ordinal")), ["t_us"], ["key1", "key2"])


_EVEN = """, p AS (SELECT {key}, ordinal, t_us, row_number() OVER (PARTITION BY {key} ORDER BY t_us, ordinal) - 1 AS p, count(*) OVER (PARTITION BY {key}) AS n FROM {src}),
 e AS (SELECT DISTINCT {key}, floor(i * (n - 1) / {last}::DOUBLE + 0.5)::BIGINT AS p FROM (SELECT DISTINCT {key}, n FROM p), (SELECT unnest(range({limit})) AS i) WHERE n > {limit})
 SELECT p.{key}, p.ordinal FROM p JOIN e ON p.{key} = e.{key} AND p.p = e.p"""


@query("G5", _EVEN.format(key="source_id", src="fr", last=99, limit=100))
def even_rows(spark, sf):
    return O.thin_evenly(events(spark, sf), ["source_id"], 100).select("source_id", "ordinal")


@query("G14", _EVEN.format(key="signal_id", src="sa", last=36, limit=37))
def even(spark, sf):
    return O.thin_evenly(samples(spark, sf), KEY, 37).select("signal_id", "ordinal")


@query("G6", """, s AS (SELECT *, lag(value) OVER w AS b, lag(usable) OVER w AS bu, lag(t_us) OVER w AS bt,
  min(CASE WHEN usable THEN value END) OVER (PARTITION BY signal_id) AS lo, max(CASE WHEN usable THEN value END) OVER (PARTITION BY signal_id) AS hi
  FROM sa WINDOW w AS (PARTITION BY signal_id ORDER BY t_us, ordinal)),
 c AS (SELECT signal_id, ordinal, CASE WHEN bu IS NULL OR NOT usable THEN NULL WHEN NOT bu OR t_us - bt > 3600000000 THEN 'recovery' WHEN value = b THEN NULL ELSE 'numeric' END AS kind,
  least(1.0::DOUBLE, abs(value - b) / (hi - lo)) AS m FROM s)
 SELECT signal_id, ordinal, kind, round(CASE WHEN kind = 'numeric' THEN m END, 9) AS magnitude FROM c WHERE kind IS NOT NULL""")
def changes(spark, sf):
    return O.changes(samples(spark, sf), KEY, F.lit(3600000000)).select("signal_id", "ordinal", "kind", F.round("magnitude", 9).alias("magnitude"))


@query("G7", """, s AS (SELECT signal_id, ordinal, t_us, t_us BETWEEN 1704500000000000 AND 1705500000000000 AS inside, lead(t_us) OVER w AS nt, lag(t_us) OVER w AS pt FROM sa WINDOW w AS (PARTITION BY signal_id ORDER BY t_us, ordinal))
 SELECT signal_id, ordinal, inside FROM s WHERE inside OR (t_us < 1704500000000000 AND nt >= 1704500000000000) OR (t_us > 1705500000000000 AND pt <= 1705500000000000)""")
def context(spark, sf):
    return O.slice_with_context(samples(spark, sf), KEY, FROM, TO).select("signal_id", "ordinal", "inside")


@query("G8", """SELECT signal_id, ordinal, false AS carried FROM sa WHERE t_us BETWEEN 1704500000000000 AND 1705500000000000
 UNION ALL SELECT signal_id, arg_max(ordinal, t_us), true FROM sa WHERE t_us < 1704500000000000 GROUP BY signal_id
 UNION ALL SELECT signal_id, arg_min(ordinal, t_us), true FROM sa WHERE t_us > 1705500000000000 GROUP BY signal_id""")
def clip(spark, sf):
    return O.clip_with_carried(samples(spark, sf), KEY, FROM, TO).select("signal_id", "ordinal", "carried")


_STEPS = """, p AS (SELECT *, row_number() OVER w - 1 AS p, t_us - lag(t_us) OVER w AS step, usable AND lag(usable) OVER w AS two, lag(usable) OVER w AS bu, lag(t_us) OVER w AS bt, count(*) OVER (PARTITION BY signal_id) AS n
  FROM sa WINDOW w AS (PARTITION BY signal_id ORDER BY t_us, ordinal)),
"""
_THRESHOLD = """ th AS (SELECT signal_id, step * 4 AS threshold_us FROM st WHERE r = m // 2),
 br AS (SELECT p.*, threshold_us, bu IS NOT NULL AND NOT (usable AND bu AND step <= threshold_us) AS breaks FROM p JOIN th USING (signal_id))"""
_PICKED_CADENCE = _STEPS + """ c AS (SELECT DISTINCT signal_id, n, least(2048, n - 1) AS c FROM p),
 pk AS (SELECT signal_id, 1 + (i * (n - 1)) // c AS p FROM c, (SELECT unnest(range(2048)) AS i) WHERE i < c),
 st AS (SELECT p.signal_id, step, row_number() OVER (PARTITION BY p.signal_id ORDER BY step, p.p) - 1 AS r, count(*) OVER (PARTITION BY p.signal_id) AS m FROM p JOIN pk ON p.signal_id = pk.signal_id AND p.p = pk.p WHERE two AND step > 0),
""" + _THRESHOLD
_CADENCE = _STEPS + """ st AS (SELECT signal_id, step, row_number() OVER (PARTITION BY signal_id ORDER BY step, p) - 1 AS r, count(*) OVER (PARTITION BY signal_id) AS m FROM p WHERE two AND step > 0),
""" + _THRESHOLD


@query("G9", _PICKED_CADENCE + " SELECT * FROM th")
def cadence(spark, sf):
    return O.cadence(samples(spark, sf), KEY, O.PICKED_PAIRS)


@query("G10", _CADENCE + """, mk AS (SELECT *, breaks AND (usable OR bu) AS mark FROM br),
 kp AS (SELECT *, mark OR coalesce(lead(mark) OVER w, false) OR (bu IS NULL AND NOT usable) OR (lead(usable) OVER w IS NULL AND NOT usable) AS keep FROM mk WINDOW w AS (PARTITION BY signal_id ORDER BY t_us, ordinal))
 SELECT signal_id, ordinal FROM kp WHERE keep""")
def breaks(spark, sf):
    s = samples(spark, sf)
    return O.break_samples(s, KEY).select("signal_id", "ordinal")


@query("G11", _CADENCE + """, g AS (SELECT signal_id, bt AS a, t_us AS b FROM br WHERE breaks),
 f AS (SELECT *, CASE WHEN a - coalesce(max(b) OVER (PARTITION BY signal_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9e15) > 600000000 THEN 1 ELSE 0 END AS fresh FROM g),
 h AS (SELECT *, sum(fresh) OVER (PARTITION BY signal_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM f)
 SELECT signal_id, min(a) AS start_us, max(b) AS end_us FROM h GROUP BY signal_id, i""")
def gap_list(spark, sf):
    s = samples(spark, sf)
    return O.gaps(s, KEY, None, 600000000)


_RUNS = """, p AS (SELECT signal_id, ordinal, value, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY signal_id) AS n FROM sa WINDOW w AS (PARTITION BY signal_id ORDER BY t_us, ordinal)),
 r AS (SELECT *, ((p + 1) * 20 - 1) // n AS run FROM p),
 x AS (SELECT signal_id, unnest([min(p), max(p), arg_min(p, {'v': value, 'p': p}) FILTER (value IS NOT NULL), arg_min(p, {'v': -value, 'p': p}) FILTER (value IS NOT NULL)]) AS p FROM r GROUP BY signal_id, run),
 kept AS (SELECT DISTINCT r.signal_id, r.ordinal FROM r JOIN x ON r.signal_id = x.signal_id AND r.p = x.p)"""


@query("G12", _RUNS + " SELECT * FROM kept")
def thin_runs(spark, sf):
    s = samples(spark, sf)
    runs = s.select("signal_id").distinct().withColumn("runs", F.lit(20).cast("long"))
    return O.extremes(s, KEY, runs).select("signal_id", "ordinal")


@query("G12_budget", broken_sql("sa", KEY, "200", pairs=None) + thinned_sql(KEY) + " SELECT signal_id, ordinal FROM th_src JOIN th_kept USING (signal_id, p)")
def thin_budget(spark, sf):
    """Thinning to a budget, with break samples and the reruns."""
    return thinned_for_graph(samples(spark, sf), KEY, 200).select("signal_id", "ordinal")


@query("G13", _RUNS + " SELECT sa.signal_id, sa.ordinal FROM sa WHERE t_us IN (SELECT t_us FROM kept JOIN sa USING (signal_id, ordinal))")
def thin_joined(spark, sf):
    s = samples(spark, sf)
    runs = s.select("signal_id").distinct().withColumn("runs", F.lit(20).cast("long"))
    return O.on_shared_times(s, O.extremes(s, KEY, runs)).select("signal_id", "ordinal")


@query("G15", "SELECT signal_id, min(value) AS lo, max(value) AS hi FROM sa WHERE usable GROUP BY signal_id")
def global_range(spark, sf):
    return O.value_ranges(samples(spark, sf), KEY)


@query("G16", "SELECT min(t_us) AS first_us, max(t_us) AS last_us, 'own' AS time FROM sa WHERE signal_id IN ('click', 'view') UNION ALL SELECT min(t_us - sh), max(t_us - sh), 'shifted' FROM (SELECT *, min(t_us) OVER (PARTITION BY source_id) AS sh FROM sa) WHERE signal_id IN ('click', 'view') AND ordinal % 100 <> 0")
def full_range(spark, sf):
    """By own times, and by each log's own start with carried samples (here every hundredth) left out."""
    s = samples(spark, sf)
    shifted = O.totals(s, ["source_id"], sh=F.min("t_us")).withColumn("carried", F.col("ordinal") % 100 == 0)
    ids = ["click", "view"]
    return O.time_extent(s, ids).withColumn("time", F.lit("own")).union(O.time_extent(shifted, ids, "sh").withColumn("time", F.lit("shifted")))


_NEAR = """, pr AS (SELECT DISTINCT signal_id, (t_us // 7200000000) * 7200000000 AS probe FROM sa),
 ne AS (SELECT pr.signal_id, probe, arg_min(ordinal, {'d': abs(t_us - probe), 't': t_us}) AS ordinal, min(t_us) AS a, max(t_us) AS b FROM pr JOIN sa USING (signal_id) GROUP BY ALL)"""


def _near(spark, sf):
    from ..operators.asof import nearest

    s = samples(spark, sf).select("signal_id", "t_us", "ordinal", "value", "quality")
    p = s.select("signal_id", (F.floor(F.col("t_us") / 7200000000) * 7200000000).alias("t_us")).distinct()
    return s, nearest(p, s, KEY, order=["ordinal"]).withColumnRenamed("t_us", "probe")


@query("G17", _NEAR + " SELECT signal_id, probe, ordinal FROM ne")
def nearest_sample(spark, sf):
    return _near(spark, sf)[1].select("signal_id", "probe", F.col("nearest.ordinal").alias("ordinal"))


@query("G18", _NEAR + " SELECT ne.signal_id, probe, ne.ordinal FROM ne JOIN sa ON ne.ordinal = sa.ordinal WHERE probe BETWEEN a AND b AND usable")
def measured_sample(spark, sf):
    n = _near(spark, sf)[1].filter("before is not null and after is not null")
    ok = O.usable("nearest.value", "nearest.quality")
    return n.filter(ok).select("signal_id", "probe", F.col("nearest.ordinal").alias("ordinal"))


@query("G19", "SELECT signal_id, count(*) AS n, sum((value * 100)::BIGINT)::BIGINT AS cents FROM sa WHERE usable GROUP BY signal_id")
def usable_samples(spark, sf):
    s = samples(spark, sf).filter(O.usable())
    return s.groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("G20", "SELECT key, ordinal, row_number() OVER (PARTITION BY key ORDER BY t_us, ordinal) AS place FROM od")
def stable_order(spark, sf):
    return O.with_place(order_samples(spark, sf), ["key"]).select("key", "ordinal", "place")


@query("G21", "SELECT signal_id, ordinal, CASE WHEN signal_id = 'view' THEN value * 2 ELSE value END AS value FROM sa WHERE signal_id <> 'error'")
def replaced(spark, sf):
    from ..operators.definitions import replace_definitions

    s = marked(spark, sf)
    changed = spark.createDataFrame([("view",), ("error",)], "signal_id string")
    fresh = s.filter("signal_id = 'view'").withColumn("value", F.col("value") * 2)
    return replace_definitions(s, fresh, changed, ["signal_id"]).select("signal_id", "ordinal", "value")


@query("G22", ", l AS (SELECT source_id, ordinal FROM fr WHERE k % 7 = 0), x AS (SELECT source_id, ordinal, signal_id, value, 0 AS seq FROM sa UNION ALL SELECT source_id, ordinal, signal_id, value, 1 FROM sa WHERE ordinal % 2 = 0) SELECT ordinal, signal_id, value, row_number() OVER (PARTITION BY source_id, ordinal, signal_id ORDER BY seq)::INTEGER AS repeat FROM x JOIN l USING (source_id, ordinal)")
def of_frames(spark, sf):
    """Samples of listed frames; in every second frame a signal has two, as plugins may give."""
    s = marked(spark, sf)
    s = s.union(s.filter("ordinal % 2 = 0").withColumn("seq", F.lit(1)).select(*s.columns))
    return O.of_frames(s, events(spark, sf).filter("k % 7 = 0")).select("ordinal", "signal_id", "value", "repeat")


@query("G23", "SELECT event_type AS signal_id, count(DISTINCT (channel, k % 3)) AS variants, 'ch' || arg_min(channel, t_us) AS name, 'u' || arg_min(k % 3, t_us) AS unit, count(DISTINCT (channel, k % 3)) > 1 AS varies FROM fr GROUP BY 1")
def variants(spark, sf):
    v = events(spark, sf).select(F.col("event_type").alias("signal_id"), "t_us", "ordinal", F.concat(F.lit("ch"), "channel").alias("name"), F.concat(F.lit("u"), F.col("k") % 3).alias("unit"))
    return O.variants(v, KEY)


@query("G24", """, p AS (SELECT *, (row_number() OVER (PARTITION BY signal_id ORDER BY t_us, ordinal) - 1) // 64 AS block FROM sa),
 s AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY signal_id, block ORDER BY t_us, ordinal) AS step FROM p)
 SELECT signal_id, block, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us, min(CASE WHEN usable THEN value END) AS lo, max(CASE WHEN usable THEN value END) AS hi, max(step) AS max_step_us, bool_and(usable) AS all_usable FROM s GROUP BY ALL""")
def blocks(spark, sf):
    return O.pyramid(samples(spark, sf), KEY)


@query("G24_view", f"SELECT signal_id, count(*) AS n, min(CASE WHEN usable THEN value END) AS lo, max(CASE WHEN usable THEN value END) AS hi FROM sa WHERE t_us BETWEEN {FROM} AND {TO} GROUP BY 1")
def view(spark, sf):
    """A view read through blocks of blocks, with samples only at its edges."""
    s = samples(spark, sf)
    return O.view_extremes(s, O.levels(s, KEY, 8, 4), KEY, FROM, TO)


@query("G24_breaks", f""", b AS (SELECT *, lag(t_us) OVER w AS bt, lag(usable) OVER w AS bok FROM sa WINDOW w AS (PARTITION BY signal_id ORDER BY t_us, ordinal))
 SELECT signal_id, bt AS start_us, t_us AS end_us FROM b WHERE bt >= {FROM} AND t_us <= {TO} AND NOT (usable AND bok AND t_us - bt <= 5400000000)""")
def view_breaks(spark, sf):
    """Breaks of a view, found from summaries and the samples of blocks that have any; as many rows as breaks, equal ones too."""
    s = samples(spark, sf)
    limits = s.select("signal_id").distinct().withColumn("threshold_us", F.lit(5400000000))
    return O.view_breaks(s, O.levels(s, KEY, 8, 4), KEY, limits, FROM, TO)


@query("G25", "SELECT ordinal, t_us, t_us + k::BIGINT * 1000000 AS end_us FROM fr WHERE event_type = 'error' AND t_us + k::BIGINT * 1000000 >= 1704500000000000 AND t_us <= 1705500000000000")
def overlapping(spark, sf):
    e = events(spark, sf).filter("event_type = 'error'").withColumn("end_us", F.col("t_us") + F.col("k").cast("long") * 1000000)
    return O.overlapping(e, FROM, TO).select("ordinal", "t_us", "end_us")


@query("G27", "SELECT ordinal, greatest(t_us, 1704500000000000) AS start_us, least(t_us + k::BIGINT * 1000000000, 1705500000000000) AS end_us FROM fr WHERE greatest(t_us, 1704500000000000) <= least(t_us + k::BIGINT * 1000000000, 1705500000000000)")
def intersected(spark, sf):
    e = events(spark, sf).select("ordinal", F.col("t_us").alias("start_us"), (F.col("t_us") + F.col("k").cast("long") * 1000000000).alias("end_us"))
    return O.intersected(e, FROM, TO)
