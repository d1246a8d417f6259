"""Queries over frames."""

from pyspark.sql import functions as F

from ..operators import decode as D
from ..operators import frames as O
from .registry import query
from .tables import events, frames, layouts, samples


@query("F1", "SELECT ordinal FROM fr WHERE (can_id, extended) IN ((291, false), (419385573, true))")
def refs(spark, sf):
    wanted = spark.createDataFrame([(0x123, False), (0x18FF50E5, True)], "can_id int, extended boolean")
    return O.by_refs(frames(spark, sf), wanted).select("ordinal")


@query("F2", "SELECT ordinal FROM fr WHERE direction = 'Rx' AND channel = 2 AND ts BETWEEN 1704500000 AND 1706000000")
def filtered(spark, sf):
    return O.where(frames(spark, sf), "Rx", 2, 1704500000, 1706000000).select("ordinal")


@query("F3", "SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY ordinal)::BIGINT AS ordinal, event_type IN ('click', 'view') AS decoded FROM fr")
def decoded(spark, sf):
    """Logs that number their frames alike: a frame is known by its source and its ordinal."""
    from pyspark.sql import Window

    f = frames(spark, sf).withColumn("ordinal", F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal")).cast("long"))
    s = D.decode(f, layouts(spark).filter("def_id in ('def_click', 'def_view')"))
    return O.decoded(f, s).select("source_id", "ordinal", F.lit(True).alias("decoded")).union(O.decoded(f, s, False).select("source_id", "ordinal", F.lit(False)))


_NAMED = ", n AS (SELECT *, printf('%X', can_id) || CASE WHEN extended AND can_id <= 2047 THEN 'x' ELSE '' END AS id_text, upper(event_type) AS name FROM fr) "


def _named(spark, sf):
    names = events(spark, sf).select("ordinal", F.upper("event_type").alias("name"))
    return frames(spark, sf).join(names, "ordinal")


@query("F4", _NAMED + "SELECT ordinal FROM n WHERE lower(id_text) LIKE '%18%' OR lower(name) LIKE '%18%' OR printf('%02X %02X %02X %02X %02X %02X %02X %02X', raw & 255, (raw >> 8) & 255, (raw >> 16) & 255, raw >> 24, (user_id >> 8) & 255, user_id & 255, k, mux) LIKE '%18%'")
def keyword(spark, sf):
    return O.keyword(_named(spark, sf), " 18 ", O.search_fields(F.col("name"), F.lit(None).cast("string"))).select("ordinal")


@query("F5", _NAMED + "SELECT ordinal, p AS pattern FROM n, (VALUES ('^18.*e5$'), ('(?<head>18).*e5$')) v(p) WHERE regexp_matches(lower(id_text), '18.*e5$') OR regexp_matches(lower(name), '18.*e5$')")
def by_pattern(spark, sf):
    """Patterns that the engine can run, one with a named group, and two that it cannot, which match nothing."""
    named, out = _named(spark, sf), None
    for text in ("^18.*e5$", "(?<head>18).*e5$", "(?P<head>18)", "(18"):
        hit = O.pattern(named, text, [O.id_text(F.col("can_id"), F.col("extended")), F.col("name")]).select("ordinal", F.lit(text).alias("pattern"))
        out = hit if out is None else out.union(hit)
    return out


@query("F6", "SELECT ordinal, t_us FROM fr ORDER BY ordinal LIMIT 240 OFFSET 100")
def page(spark, sf):
    return O.page(frames(spark, sf), 100, 240).select("ordinal", "t_us")


@query("F7", "SELECT can_id, extended, count(*) AS frames FROM fr GROUP BY ALL")
def counts(spark, sf):
    return O.count_by_ref(frames(spark, sf))


@query("F8", "SELECT ordinal, can_id, row_number() OVER (PARTITION BY source_id ORDER BY ordinal) AS place FROM fr WHERE can_id IN (291, 784)")
def merged(spark, sf):
    from pyspark.sql import Window

    wanted = spark.createDataFrame([(0x123, False), (0x310, False)], "can_id int, extended boolean")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal")).cast("long")
    return O.by_refs(frames(spark, sf), wanted).select("ordinal", "can_id", place.alias("place"))


@query("F9", "SELECT min(t_us) AS first_us, max(t_us) AS last_us FROM fr")
def bounds(spark, sf):
    return O.bounds(frames(spark, sf))


_PROBES = ", pr AS (SELECT DISTINCT (t_us // 1800000000) * 1800000000 AS probe FROM fr)"


def probes(spark, sf):
    return frames(spark, sf).select((F.floor(F.col("t_us") / 1800000000) * 1800000000).alias("probe")).distinct()


@query("F10", _PROBES + """ SELECT probe, coalesce((SELECT min(t_us) FROM fr WHERE t_us > probe), (SELECT max(t_us) FROM fr)) AS next_us,
 coalesce((SELECT max(t_us) FROM fr WHERE t_us < probe), (SELECT min(t_us) FROM fr)) AS previous_us FROM pr""")
def steps(spark, sf):
    return O.step(frames(spark, sf), probes(spark, sf))


@query("F11", _PROBES + " SELECT probe, (SELECT arg_min(t_us, {'d': abs(t_us - probe), 't': t_us}) FROM fr) AS nearest_us FROM pr")
def nearest(spark, sf):
    from ..operators.asof import nearest as near

    f = frames(spark, sf).select(F.lit(1).alias("one"), "t_us", "ordinal")
    p = probes(spark, sf).select(F.lit(1).alias("one"), F.col("probe").alias("t_us"))
    return near(p, f, ["one"], order=["ordinal"]).select(F.col("t_us").alias("probe"), F.col("nearest.t_us").alias("nearest_us"))


@query("F12", """SELECT c_mktsegment AS segment, c_name AS text, length(c_name)::INTEGER AS width, row_number() OVER (PARTITION BY c_mktsegment ORDER BY length(c_name) DESC, c_custkey)::INTEGER AS rank
 FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY length(c_name) DESC, c_custkey) <= 3""", base=False)
def widest(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("text"), "c_custkey")
    return O.widest(c, ["segment"], "text", "c_custkey").drop("c_custkey")


@query("F13", "SELECT DISTINCT source_id, channel FROM fr")
def channels(spark, sf):
    return frames(spark, sf).select("source_id", "channel").distinct()


@query("F14", """, r AS (SELECT user_id AS key, ordinal AS lo, ordinal + k AS hi FROM fr),
 f AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9) + 1 THEN 1 ELSE 0 END AS fresh FROM r),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f),
 m AS (SELECT key, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY key, island)
 SELECT key, count(*) AS ranges, sum(hi - lo + 1)::BIGINT AS covered FROM m GROUP BY key""")
def ranges(spark, sf):
    r = events(spark, sf).select(F.col("user_id").alias("key"), F.col("ordinal").alias("lo"), (F.col("ordinal") + F.col("k")).alias("hi"))
    return O.merge_ranges(r, ["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("covered"))


@query("F15", "SELECT DISTINCT t_us FROM fr UNION SELECT DISTINCT t_us FROM od")
def all_times(spark, sf):
    from .tables import order_samples

    return frames(spark, sf).select("t_us").union(order_samples(spark, sf).select("t_us")).distinct()
