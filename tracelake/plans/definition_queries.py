"""Queries of definitions, levels, findings, reports, numbers and times."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times as T
from ..operators import decode as D
from ..operators import definitions as O
from ..operators import diagnostics as Q
from ..operators import store as R
from ..operators.frames import id_text, payload_text
from ..sources.logs import parse_can_id
from ..storage import shared_folder
from .registry import query
from .tables import CAN_IDS, events, frames, layouts, order_samples, samples


@query("L1", """, lo AS (SELECT DISTINCT 'root/' || source_id || '/ch' || channel || '/u' || user_id AS path FROM fr),
 lv AS (SELECT * FROM (VALUES (''), ('root'), ('root/log1'), ('root/log1/ch2'), ('root/log')) t(folder))
 SELECT path, arg_max(folder, length(folder)) AS level FROM lo, lv WHERE folder = '' OR path = folder OR starts_with(path, folder || '/') GROUP BY path""")
def levels(spark, sf):
    e = events(spark, sf).select(F.concat(F.lit("root/"), "source_id", F.lit("/ch"), "channel", F.lit("/u"), "user_id").alias("path")).distinct()
    l = spark.createDataFrame([("",), ("root",), ("root/log1",), ("root/log1/ch2",), ("root/log",)], "folder string")
    return O.level_of(e, l)


@query("L2", "SELECT source_id AS place, can_id, extended, max(channel) AS depth, 'd' || max(channel) AS def_id FROM fr GROUP BY ALL")
def overlays(spark, sf):
    d = events(spark, sf).select(F.col("source_id").alias("place"), "can_id", "extended", F.col("channel").alias("depth"), F.concat(F.lit("d"), "channel").alias("def_id")).distinct()
    return O.overlay(d, ["can_id", "extended"])


_GROUPS = ", g AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 10 THEN 31 WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent FROM part WHERE p_partkey < 150)"
_CHAINS = _GROUPS.replace(", g", "WITH RECURSIVE g", 1) + """,
 c AS (SELECT id AS place, id AS member, 0 AS up, [id] AS seen FROM g UNION ALL SELECT c.place, g.parent, c.up + 1, list_append(c.seen, g.parent) FROM c JOIN g ON g.id = c.member WHERE g.parent IS NOT NULL AND NOT list_contains(c.seen, g.parent) AND g.parent IN (SELECT id FROM g)),
 k AS (SELECT place, member, max(up) OVER (PARTITION BY place) - up + 1 AS depth FROM c)"""


def _groups(spark, sf):
    """A tree of groups some five levels deep; two of them are each other's parents."""
    p = spark.read.parquet(f"{sf}/part.parquet").filter("p_partkey < 150")
    parent = F.when(F.col("p_partkey") == 10, F.lit(31)).when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3))
    return p.select(F.col("p_partkey").alias("group_id"), parent.cast("long").alias("parent_id"))


@query("L2_chain", _CHAINS + """, f AS (SELECT place, depth, member % 11 AS can_id, 'g' || member AS def_id FROM k UNION ALL SELECT id, 0, x, 'common' || x FROM g, range(13) t(x)),
 t AS (SELECT place, depth, 't' || member % 3 AS id, 'g' || member AS def_id FROM k)
 SELECT place, 'frame' AS kind, can_id::VARCHAR AS key, arg_max(def_id, depth) AS def_id FROM f GROUP BY ALL UNION ALL SELECT place, 'table', id, arg_max(def_id, depth) FROM t GROUP BY ALL""", base=False)
def chained_levels(spark, sf):
    """Every group resolved from the common definitions down: frames by CAN key, tables by id."""
    g = _groups(spark, sf)
    frame = g.select("group_id", (F.col("group_id") % 11).cast("int").alias("can_id"), F.lit(False).alias("extended"), F.concat(F.lit("g"), "group_id").alias("def_id"))
    common = spark.range(13).select(F.lit(None).cast("long").alias("group_id"), F.col("id").cast("int").alias("can_id"), F.lit(False).alias("extended"), F.concat(F.lit("common"), "id").alias("def_id"))
    table = g.select("group_id", F.concat(F.lit("t"), F.col("group_id") % 3).alias("id"), F.concat(F.lit("g"), "group_id").alias("def_id"))
    chains = O.group_chains(g)
    frames_ = O.resolve_levels(chains, frame.unionByName(common), ["can_id", "extended"]).select("place", F.lit("frame").alias("kind"), F.col("can_id").cast("string").alias("key"), "def_id")
    return frames_.union(O.resolve_levels(chains, table, ["id"]).select("place", F.lit("table"), "id", "def_id"))


@query("L2_bindings", _CHAINS + """, f AS (SELECT place, arg_max(def_id, depth) AS def_id FROM (SELECT place, depth, member % 11 AS can_id, 'g' || member AS def_id FROM k) GROUP BY place, can_id)
 SELECT k.place, 'b' || member AS binding_id FROM k JOIN f ON f.place = k.place AND f.def_id = 'g' || member""", base=False)
def bound_levels(spark, sf):
    """Each group binds a plugin to its own frame; where that frame is hidden further down the binding falls away."""
    g = _groups(spark, sf)
    frame = g.select("group_id", (F.col("group_id") % 11).cast("int").alias("can_id"), F.lit(False).alias("extended"), F.concat(F.lit("g"), "group_id").alias("def_id"))
    binding = g.select("group_id", F.concat(F.lit("b"), "group_id").alias("binding_id"), F.concat(F.lit("g"), "group_id").alias("frame_id"), F.concat(F.lit("g"), "group_id").alias("def_id"))
    chains = O.group_chains(g)
    return O.bindings_in_use(O.resolve_levels(chains, binding, ["binding_id"]), O.resolve_levels(chains, frame, ["can_id", "extended"])).select("place", "binding_id")


@query("L1_parents", """, f AS (SELECT DISTINCT 'root/' || source_id || '/u' || user_id AS folder FROM fr UNION SELECT DISTINCT 'root/' || source_id FROM fr WHERE user_id % 4 < 2 UNION SELECT DISTINCT x FROM fr, (VALUES (''), ('root')) t(x))
 SELECT c.folder, arg_max(p.folder, length(p.folder)) AS parent FROM f c LEFT JOIN f p ON c.folder <> p.folder AND (p.folder = '' OR starts_with(c.folder, p.folder || '/')) GROUP BY c.folder""")
def parents(spark, sf):
    """Levels that the logs of the events lie in, some of them without a level for their log, and the level above each."""
    e = events(spark, sf)
    log = F.concat(F.lit("root/"), "source_id")
    user = e.select(F.concat(log, F.lit("/u"), "user_id").alias("folder"))
    some = e.filter("user_id % 4 < 2").select(log.alias("folder"))
    return O.parent_level(user.union(some).union(e.select(F.explode(F.array(F.lit(""), F.lit("root"))))).distinct())


@query("L3", "SELECT user_id * 100 + k AS signal_id, count(DISTINCT can_id) AS frames FROM fr GROUP BY 1 HAVING count(DISTINCT can_id) > 1")
def shared_ids(spark, sf):
    d = events(spark, sf).select((F.col("user_id") * 100 + F.col("k")).alias("signal_id"), "can_id", "extended")
    return O.shared_ids(d, ["can_id", "extended"])


@query("L6", "SELECT p_partkey AS def_id, CASE WHEN p_partkey % 7 = 0 THEN 'removed' WHEN p_partkey % 5 = 0 THEN 'changed' END AS kind FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0 UNION ALL SELECT -1, 'added'", base=False)
def changed(spark, sf):
    old = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("def_id"), "p_name", "p_size")
    new = old.filter("p_partkey % 7 <> 0" if "p_partkey" in old.columns else "def_id % 7 <> 0")
    new = new.withColumn("p_size", F.when(F.col("def_id") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    new = new.union(spark.createDataFrame([(-1, "new", 1)], "def_id long, p_name string, p_size int").select("def_id", "p_name", F.col("p_size").cast(dict(old.dtypes)["p_size"])))
    return O.changed_definitions(old, new)


@query("L6_keys", "SELECT DISTINCT p_partkey // 2 AS can_id, false AS extended FROM part WHERE p_partkey % 5 = 0 UNION SELECT DISTINCT 100000 + p_partkey, true FROM part WHERE p_partkey % 5 = 0", base=False)
def keys_to_decode(spark, sf):
    """Every fifth definition moves to another id: the frames of the old id and of the new one are to be decoded again."""
    old = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("def_id"), F.floor(F.col("p_partkey") / 2).cast("long").alias("can_id"), F.lit(False).alias("extended"))
    moved = F.col("def_id") % 5 == 0
    new = old.select("def_id", F.when(moved, F.col("def_id") + 100000).otherwise(F.col("can_id")).alias("can_id"), moved.alias("extended"))
    return O.keys_to_decode(old, new, O.changed_definitions(old, new))


@query("L6_rebuild", "SELECT kind, count(*) AS changes FROM part, (VALUES ('plugin', 5), ('csv', 7), ('routing', 1000000000)) t(kind, n) WHERE p_partkey % n = 0 AND p_partkey > 0 GROUP BY kind", base=False)
def full_rebuild(spark, sf):
    """Settings of four kinds, some changed: those of definitions never call for a rebuild."""
    p = spark.read.parquet(f"{sf}/part.parquet").filter("p_partkey > 0")
    every = spark.createDataFrame([("definition", 3), ("plugin", 5), ("csv", 7), ("routing", 1000000000)], "kind string, n int")
    old = p.join(F.broadcast(every), F.lit(True)).select("kind", F.col("p_partkey").alias("id"), "p_size", "n")
    new = old.withColumn("p_size", F.col("p_size") + (F.col("id") % F.col("n") == 0).cast("int"))
    return O.rebuild_reasons(old, new).select("kind", "changes")


def _restored(spark, sf):
    """A store of all signals; then one definition has another scale, one has moved to another id, one is gone and one is new."""
    f, old = frames(spark, sf), layouts(spark)
    new = old.filter("def_id <> 'def_error'").withColumn("scale", F.when(F.expr("def_id = 'def_view' AND name = 'Value'"), "0.1").otherwise(F.col("scale")))
    new = new.withColumn("can_id", F.when(F.col("def_id") == "def_signup", F.lit(CAN_IDS["error"])).otherwise(F.col("can_id")))
    extra = new.filter("def_id = 'def_click' AND name = 'User'").withColumns({"def_id": F.lit("def_extra"), "signal_id": F.lit("extra.user"), "can_id": F.lit(CAN_IDS["signup"])})
    new = new.union(extra.select(*new.columns))
    store = R.SampleStore(spark, shared_folder(spark)).create(D.decode(R.dealt(f), old, True))
    return store, f, old, new


_SIGNALS = """, d AS (SELECT *, CASE event_type WHEN 'error' THEN 'signup' WHEN 'signup' THEN 'extra' ELSE event_type END AS df FROM fr),
 v AS (SELECT ordinal, df || '.value' AS signal_id, raw::DOUBLE / CASE WHEN df = 'view' THEN 10 ELSE 100 END AS value FROM d WHERE df <> 'extra' UNION ALL SELECT ordinal, df || '.user', (user_id & 65535)::DOUBLE FROM d
 UNION ALL SELECT ordinal, df || '.k', k::DOUBLE FROM d WHERE df <> 'extra' UNION ALL SELECT ordinal, df || '.mux', mux::DOUBLE FROM d WHERE df <> 'extra' UNION ALL SELECT ordinal, df || '.when_one', floor((k % 16) / 2)::DOUBLE FROM d WHERE mux = 1 AND df <> 'extra')"""


@query("L7", _SIGNALS + " SELECT * FROM v")
def redecoded(spark, sf):
    """Stored samples of all signals after a change of definitions, of which only the changed ones' frames were decoded anew."""
    store, f, old, new = _restored(spark, sf)
    R.redecode(store, f, old, new)
    return store.read().select("ordinal", "signal_id", "value")


@query("L7_touched", "SELECT * FROM (VALUES ('def_view'), ('def_error'), ('def_signup'), ('def_extra')) t(def_id) WHERE EXISTS (SELECT 1 FROM fr)")
def touched(spark, sf):
    """What was made anew: not the definitions whose ids nobody changed."""
    store, f, old, new = _restored(spark, sf)
    return R.redecode(store, f, old, new)


@query("L8", """, x AS (SELECT p_partkey AS part, p_size FROM part)
 SELECT part::VARCHAR AS def_id, 'a' AS signal_id, 'LENGTH' AS problem FROM x WHERE p_size = 0 OR p_size > 64
 UNION ALL SELECT part::VARCHAR, 'a', 'OUTSIDE_FRAME' FROM x WHERE 6 + ceil((1 + p_size) / 8) > 8
 UNION ALL SELECT part::VARCHAR, 'a', 'OVERLAP' FROM x WHERE p_size > 7 AND part % 2 = 0 UNION ALL SELECT part::VARCHAR, 'b', 'OVERLAP' FROM x WHERE p_size > 7 AND part % 2 = 0
 UNION ALL SELECT part::VARCHAR, s, 'NAME_TWICE' FROM x, (VALUES ('a'), ('b')) v(s) WHERE part % 10 = 0
 UNION ALL SELECT part::VARCHAR, 'b', 'SCALE' FROM x WHERE part % 3 = 0""")
def validated(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("string").alias("def_id"), F.col("p_partkey").alias("n"), F.col("p_size").cast("int").alias("size"))
    none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>")

    def signal(i, name, at, bit, length, scale):
        return p.select("def_id", F.lit(1).alias("can_id"), F.lit(False).alias("extended"), F.lit(i).alias("signal_id"), name.alias("name"), F.lit("").alias("unit"), at.alias("byte_offset"), F.lit(bit).alias("bit_offset"), length.alias("length_bits"), F.lit("unsigned").alias("signedness"), F.lit("little").alias("byte_order"), scale.alias("scale"), F.lit("0").alias("offset"), F.lit("none").alias("mux_role"), none.alias("mux_ranges"))

    a = signal("a", F.lit("A"), F.lit(6), 1, F.col("size"), F.lit("1"))
    b = signal("b", F.when(F.col("n") % 10 == 0, "a").otherwise("B"), F.when(F.col("n") % 2 == 0, 7).otherwise(0), 0, F.lit(8), F.when(F.col("n") % 3 == 0, "0").otherwise("1/3"))
    return O.validate(a.union(b))


_V = "WITH x AS (SELECT p_partkey AS n, p_partkey::VARCHAR AS def_id FROM part) "


def _defined(spark, sf):
    """A selector and two conditional signals on the same bits for every part; every third shares a value, every fifth breaks other rules."""
    n = F.col("n")
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("n"), F.col("p_partkey").cast("string").alias("def_id"))
    span = lambda lo, hi: F.array(F.struct(F.lit(lo).cast("long").alias("lo"), hi.cast("long").alias("hi")))
    none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>")

    def signal(i, role, ranges, at, length, sign, offset, low):
        return p.select("n", "def_id", F.lit(1).alias("can_id"), F.lit(False).alias("extended"), F.lit(i).alias("signal_id"), F.lit(i.upper()).alias("name"), F.lit("").alias("unit"), F.lit(at).alias("byte_offset"), F.lit(0).alias("bit_offset"), F.lit(length).alias("length_bits"), sign.alias("signedness"), F.lit("little").alias("byte_order"), F.lit("1").alias("scale"), offset.alias("offset"), F.lit(role).alias("mux_role"), ranges.alias("mux_ranges"), F.lit(8).alias("frame_bytes"), low.alias("minimum"), F.lit(9.0).alias("maximum"))

    fifth, one = n % 5 == 0, F.lit("unsigned")
    return (
        signal("m", "selector", none, 0, 8, F.when(fifth, "signed").otherwise("unsigned"), F.lit("0"), F.lit(0.0))
        .union(signal("a", "conditional", span(1, F.lit(2)), 1, 8, one, F.when(fifth, "x").otherwise("0"), F.lit(0.0)))
        .union(signal("b", "conditional", span(2, F.when(fifth, 300).otherwise(4)), 1, 8, one, F.lit("0"), F.when(fifth, 10.0).otherwise(0.0)).withColumn("mux_ranges", F.when(n % 3 == 0, F.col("mux_ranges")).otherwise(span(3, F.when(fifth, 300).otherwise(4)))))
    )


@query("L8_mux", _V + "SELECT def_id, s AS signal_id, 'OVERLAP' AS problem FROM x, (VALUES ('a'), ('b')) v(s) WHERE n % 3 = 0 UNION ALL SELECT def_id, s, r FROM x, (VALUES ('m', 'SELECTOR_FORMAT'), ('a', 'OFFSET_VALUE'), ('b', 'MUX_RANGE'), ('b', 'RANGE')) v(s, r) WHERE n % 5 = 0", base=False)
def validated_mux(spark, sf):
    """Conditional signals may share bits unless a selector value activates both."""
    return O.validate(_defined(spark, sf).drop("n"))


@query("L8_frames", _V + "SELECT def_id, 'CAN_ID_RANGE' AS problem FROM x WHERE n > 2047 UNION ALL SELECT def_id, 'FRAME_LENGTH' FROM x WHERE n % 65 NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64) UNION ALL SELECT def_id, 'EXPECTED_PERIOD' FROM x WHERE n % 4 = 0 UNION ALL SELECT def_id, 'NAME_EMPTY' FROM x WHERE n % 9 = 0", base=False)
def validated_frames(spark, sf):
    n = F.col("n")
    f = _defined(spark, sf).filter("signal_id = 'm'").select("def_id", F.when(n % 9 == 0, " ").otherwise("f").alias("name"), n.alias("can_id"), "extended", (n % 65).alias("frame_bytes"), F.when(n % 4 == 0, 0.0).alias("expected_period_ms"))
    return O.validate_frames(f)


@query("L8_labels", _V + "SELECT def_id, 'a' AS signal_id, 'LABEL_RANGE' AS problem FROM x WHERE n % 1000 > 255 UNION ALL SELECT def_id, 'a', 'LABEL_TWICE' FROM x WHERE n % 1000 = 16 UNION ALL SELECT def_id, 'a', 'LABEL_RAW' FROM x WHERE n % 7 = 0", base=False)
def validated_labels(spark, sf):
    d = _defined(spark, sf)
    l = d.filter("signal_id = 'a'").select("def_id", "signal_id", F.explode(F.array(F.lit("0x10"), (F.col("n") % 1000).cast("string"), F.when(F.col("n") % 7 == 0, "1.5"))).alias("raw_text"), F.lit("x").alias("label"))
    return O.validate_labels(l.filter("raw_text is not null"), d)


@query("L8_derived", _V + "SELECT def_id, 'd' AS signal_id, r AS problem FROM x, (VALUES (0, 'FORWARD_REFERENCE'), (1, 'LOOKUP_POINTS'), (2, 'LOOKUP_INPUT_TWICE'), (3, 'FILTER_TIME'), (4, 'INPUT_EMPTY')) v(k, r) WHERE n % 6 = k", base=False)
def validated_derived(spark, sf):
    d = _defined(spark, sf)
    k = F.col("n") % 6
    points = F.when(k == 1, F.expr("array(named_struct('input', 0D, 'output', 1D))")).when(k == 2, F.expr("array(named_struct('input', 0D, 'output', 1D), named_struct('input', 0D, 'output', 2D))")).otherwise(F.expr("array(named_struct('input', 0D, 'output', 1D), named_struct('input', 1D, 'output', 2D))"))
    kind = F.when(k == 3, "filter").when(k.isin(1, 2, 5), "lookup").otherwise("expression")
    inputs = F.when(k == 0, F.array(F.lit("LATER"))).when(k == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("A")))
    first = d.filter("signal_id = 'm'")
    derived = first.select("def_id", F.lit("d").alias("signal_id"), F.lit(0).alias("place"), F.lit("D").alias("name"), kind.alias("kind"), inputs.alias("inputs"), points.alias("points"), F.lit(0.0).alias("seconds"))
    later = first.select("def_id", F.lit("l").alias("signal_id"), F.lit(1).alias("place"), F.lit("LATER").alias("name"), F.lit("expression").alias("kind"), F.array(F.lit("D"), F.lit("B")).alias("inputs"), points.alias("points"), F.lit(0.0).alias("seconds"))
    return O.validate_derived(derived.union(later), d)


def _findings(spark, sf):
    e = events(spark, sf)
    return e.select(F.when(F.col("mux") == 0, "parser").otherwise("definition").alias("source"), F.col("event_type").alias("code"), F.lit("").alias("owner"), F.concat(F.lit("d"), F.col("user_id") % 10).alias("def_id"), F.col("source_id").alias("signal_id"), F.concat(F.lit("m"), "k").alias("message"), F.col("ts").alias("position"), F.col("ordinal").alias("seq"))


_FIND = ", fi AS (SELECT CASE WHEN mux = 0 THEN 'parser' ELSE 'definition' END AS source, event_type AS code, '' AS owner, 'd' || user_id % 10 AS def_id, source_id AS signal_id, 'm' || k AS message, ts AS position, ordinal AS seq FROM fr), gr AS (SELECT source, code, owner, def_id, signal_id, message, count(*) AS count, min(position) AS first, max(position) AS last, min(seq) AS seq FROM fi GROUP BY ALL)"


@query("Q1", _FIND + " SELECT * EXCLUDE (seq) FROM gr")
def tallied(spark, sf):
    return Q.tally(_findings(spark, sf), 10**9)


@query("Q2", _FIND + ", r AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM gr) SELECT source, code, owner, def_id, CASE WHEN r > 500 THEN '*' ELSE signal_id END AS signal_id, CASE WHEN r > 500 THEN '(grouped)' ELSE message END AS message, sum(count)::BIGINT AS count, min(first) AS first, max(last) AS last FROM r GROUP BY ALL")
def tallied_many(spark, sf):
    return Q.tally(_findings(spark, sf), 500)


@query("Q3", _FIND + " SELECT * EXCLUDE (seq, message), message FROM gr WHERE NOT (source = 'definition' AND def_id IN ('d1', 'd2')) UNION ALL SELECT source, code, owner, def_id, signal_id, count, first, last, 'fresh' FROM gr WHERE source = 'definition' AND def_id = 'd1'")
def refreshed(spark, sf):
    g = Q.tally(_findings(spark, sf), 10**9)
    changed_ids = spark.createDataFrame([("d1",), ("d2",)], "def_id string")
    return Q.replace_findings(g, changed_ids, g.filter("source = 'definition' and def_id = 'd1'").withColumn("message", F.lit("fresh")))


def _cells(spark, sf):
    e = events(spark, sf)
    return e.select(F.col("event_type").alias("signal_id"), F.col("mux").alias("value"), F.col("ordinal").alias("row"), F.when(F.col("k") % 10 != 0, F.concat(F.lit("L"), F.col("k") % 3)).alias("label"))


@query("R1", ", c AS (SELECT event_type AS signal_id, mux AS value, ordinal AS row, CASE WHEN k % 10 <> 0 THEN 'L' || k % 3 END AS label FROM fr), d AS (SELECT signal_id, value, arg_min(label, row) AS first FROM c WHERE label IS NOT NULL GROUP BY ALL) SELECT signal_id, row, label AS own FROM c JOIN d USING (signal_id, value) WHERE label IS DISTINCT FROM first")
def exceptions(spark, sf):
    return Q.label_dictionary(_cells(spark, sf))[1]


@query("R3", ", a AS (SELECT t_us, row_number() OVER (PARTITION BY t_us ORDER BY ordinal)::INTEGER AS k, value AS left_value FROM od WHERE key = 1), b AS (SELECT t_us, row_number() OVER (PARTITION BY t_us ORDER BY ordinal)::INTEGER AS k, value AS right_value FROM od WHERE key = 2) SELECT t_us, k, left_value, right_value FROM a FULL JOIN b USING (t_us, k)")
def added(spark, sf):
    o = order_samples(spark, sf)
    a = o.filter("key = 1").select("t_us", "ordinal", F.col("value").alias("left_value"))
    return Q.add_series(a, o.filter("key = 2").select("t_us", "ordinal", F.col("value").alias("right_value")))


@query("R4", "SELECT source_id, ordinal, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN k % 10 <> 0 THEN value END DESC NULLS LAST, ordinal)::INTEGER AS place FROM fr")
def sorted_rows(spark, sf):
    v = F.when(F.col("k") % 10 != 0, F.col("value"))
    return Q.sorted_table(events(spark, sf), ["source_id"], v, descending=True).select("source_id", "ordinal", "place")


@query("N1", "SELECT ordinal, CASE WHEN k % 2 = 0 THEN can_id ELSE k END AS can_id, k % 3 = 0 OR CASE WHEN k % 2 = 0 THEN can_id ELSE k END > 2047 AS extended, printf('%X', CASE WHEN k % 2 = 0 THEN can_id ELSE k END) || CASE WHEN k % 3 = 0 AND CASE WHEN k % 2 = 0 THEN can_id ELSE k END <= 2047 THEN 'x' ELSE '' END AS text FROM fr")
def can_ids(spark, sf):
    n = F.when(F.col("k") % 2 == 0, F.col("can_id")).otherwise(F.col("k"))
    written = F.concat(F.when(F.col("k") % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex(n)))).otherwise(n.cast("string")), F.when(F.col("k") % 3 == 0, "X").otherwise(""))
    can_id, extended = parse_can_id(written, F.when(F.col("k") % 2 == 0, "hex").otherwise("dec"))
    e = events(spark, sf).select("ordinal", can_id.alias("can_id"), extended.alias("extended"))
    return e.withColumn("text", id_text(F.col("can_id"), F.col("extended")))


@query("N2", "SELECT ordinal, printf('%02X %02X %02X %02X %02X %02X %02X %02X', raw & 255, (raw >> 8) & 255, (raw >> 16) & 255, raw >> 24, (user_id >> 8) & 255, user_id & 255, k, mux) AS payload FROM fr")
def payloads(spark, sf):
    return frames(spark, sf).select("ordinal", payload_text(F.col("data")).alias("payload"))


@query("N3", "SELECT ordinal, regexp_replace(regexp_replace(printf('%.2f', raw / 100.0), '0+$', ''), '\\.$', '') AS fixed, regexp_replace(regexp_replace(printf('%.6f', t_us / 1000000::DOUBLE - 1704067200), '0+$', ''), '\\.$', '') AS seconds FROM fr")
def numbers(spark, sf):
    return events(spark, sf).select("ordinal", X.significant(F.col("raw") / 100, 9).alias("fixed"), X.fixed((F.col("t_us") - 1704067200000000).cast("decimal(30,0)") / 1000000, 9).alias("seconds"))


@query("N4", '''SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN '"' || p_name || ', ""x""' || '"' ELSE p_name END AS cell FROM part''', base=False)
def quoted(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(', "x"'))).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("part"), X.csv_cell(raw).alias("cell"))


_PROJECTS = "WITH p AS (SELECT *, p_partkey % 6 AS v FROM part) "


def _projects(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    text = F.format_string(
        '{"version": %d, "frames": [{"id": "f%d", "canId": %d}], "clips": [{"id": "c%d", "name": "clip", "start": %d, "end": %d}, {"id": "bad"}], "groups": [{"id": "g", "members": []}, {"id": "h", "members": ["f"]}]}',
        F.col("p_partkey") % 6, "p_partkey", F.col("p_partkey") * 10, "p_size", "p_size", F.when(F.col("p_size") > 10, F.col("p_size") + 1).otherwise(F.col("p_size")),
    )
    return O.parse_projects(p.select(F.col("p_partkey").alias("project"), F.when(F.col("p_partkey") % 50 == 49, "no json").otherwise(text).alias("text")))


@query("N5", _PROJECTS + "SELECT p_partkey AS project, 'c' || p_size AS clip, 'clip' AS name, '' AS source_path, p_size::DOUBLE AS start_s FROM p WHERE v BETWEEN 1 AND 4 AND p_size > 10 AND p_partkey % 50 <> 49", base=False)
def projects(spark, sf):
    """Project texts become definition tables; clips without a valid range are left out."""
    return _projects(spark, sf)[2].drop("end_s")


@query("N5_frames", _PROJECTS + "SELECT p_partkey AS project, 'f' || p_partkey AS def_id, (p_partkey * 10)::INTEGER AS can_id, p_partkey * 10 > 2047 AS extended, 'f' || p_partkey AS name, 8 AS frame_bytes FROM p WHERE v BETWEEN 1 AND 4 AND p_partkey % 50 <> 49", base=False)
def project_frames(spark, sf):
    """Missing names, flags and lengths get their defaults."""
    return _projects(spark, sf)[1]


@query("N5_report", _PROJECTS + "SELECT p_partkey AS project, 'PROJECT_VERSION' AS code, NULL AS id FROM p WHERE v NOT BETWEEN 1 AND 4 OR p_partkey % 50 = 49 UNION ALL SELECT p_partkey, 'CLIP_INVALID', 'bad' FROM p WHERE v BETWEEN 1 AND 4 AND p_partkey % 50 <> 49 UNION ALL SELECT p_partkey, 'CLIP_INVALID', 'c' || p_size FROM p WHERE v BETWEEN 1 AND 4 AND p_partkey % 50 <> 49 AND p_size <= 10 UNION ALL SELECT p_partkey, 'GROUP_INVALID', 'g' FROM p WHERE v BETWEEN 1 AND 4 AND p_partkey % 50 <> 49", base=False)
def project_report(spark, sf):
    return _projects(spark, sf)[3]


_REF = ", rf AS (SELECT *, CASE WHEN source_id = 'log0' THEN 0 ELSE 1704067200000000 END AS off, CASE WHEN mux = 1 THEN 540::BIGINT END AS utc FROM fr)"


def _referenced(spark, sf):
    """Timestamps of logs whose own times are clock times (log0) or count from the start, with and without a UTC offset, some without a start."""
    start = F.lit(1704067200000000)
    offset = F.when(F.col("source_id") == "log0", 0).otherwise(start).cast("long")
    e = events(spark, sf).withColumns({"offset_us": offset, "start_us": F.when(F.col("k") != 5, start), "utc": F.when(F.col("mux") == 1, 540), "mode": F.element_at(F.array(F.lit("relative"), F.lit("datetime"), F.lit("unix")), F.col("k") % 3 + 1)})
    return e.withColumn("t_us", F.col("t_us") - F.col("offset_us"))


@query("M1", _REF + " SELECT ordinal, CASE WHEN k = 5 THEN t_us - off WHEN k % 3 = 0 THEN t_us - 1704067200000000 WHEN k % 3 = 1 THEN t_us ELSE t_us - coalesce(utc, 0) * 60000000 END AS shown_us, t_us - off AS back_us FROM rf")
def shown(spark, sf):
    reference = F.col("start_us"), F.col("offset_us"), F.col("utc")
    e = _referenced(spark, sf).withColumn("shown_us", T.displayed_us(F.col("t_us"), F.col("mode"), *reference))
    return e.select("ordinal", "shown_us", T.timestamp_us(F.col("shown_us"), F.col("mode"), *reference).alias("back_us"))


@query("M2", "SELECT ordinal, strftime(make_timestamp(t_us), '%Y-%m-%d %H:%M:%S.%f') AS full_text, strftime(make_timestamp(((t_us + 500) // 1000) * 1000), '%Y-%m-%d %H:%M:%S.%g') AS short_text, CASE WHEN k % 2 = 0 THEN '+09:00' ELSE '-03:30' END AS zone FROM fr")
def clock_texts(spark, sf):
    t = F.col("t_us")
    return events(spark, sf).select("ordinal", T.clock_text(t).alias("full_text"), T.clock_text(t, 3).alias("short_text"), T.offset_text(F.when(F.col("k") % 2 == 0, 540).otherwise(-210)).alias("zone"))


@query("M2_cells", _REF + """, m AS (SELECT *, CASE WHEN k = 5 OR k % 3 = 0 THEN 'relative' WHEN k % 3 = 1 THEN 'datetime' ELSE 'unix' END AS mode, CASE WHEN k = 5 THEN t_us - off WHEN k % 3 = 0 THEN t_us - 1704067200000000 WHEN k % 3 = 1 THEN t_us ELSE t_us - coalesce(utc, 0) * 60000000 END AS us FROM rf)
 SELECT ordinal, CASE mode WHEN 'datetime' THEN strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') || CASE WHEN utc IS NULL THEN '' ELSE '+09:00' END ELSE (us // 1000000) || '.' || lpad((us % 1000000)::VARCHAR, 6, '0') END AS cell,
  CASE mode WHEN 'datetime' THEN strftime(make_timestamp(((us + 500) // 1000) * 1000), '%Y-%m-%d %H:%M:%S.%g') || '–' || CASE WHEN strftime(make_timestamp(((us + 500) // 1000) * 1000), '%Y-%m-%d') = strftime(make_timestamp(((us + 7200000500) // 1000) * 1000), '%Y-%m-%d') THEN strftime(make_timestamp(((us + 7200000500) // 1000) * 1000), '%H:%M:%S.%g') ELSE strftime(make_timestamp(((us + 7200000500) // 1000) * 1000), '%Y-%m-%d %H:%M:%S.%g') END
   ELSE ((us + 500) // 1000 // 1000) || '.' || lpad(((us + 500) // 1000 % 1000)::VARCHAR, 3, '0') || '–' || ((us + 7200000500) // 1000 // 1000) || '.' || lpad(((us + 7200000500) // 1000 % 1000)::VARCHAR, 3, '0') || ' s' END AS span,
  CASE mode WHEN 'datetime' THEN 'TIME' WHEN 'unix' THEN 'TIME (UNIX S)' ELSE 'TIME(S)' END AS label FROM m""")
def time_cells(spark, sf):
    """Exported cells, range texts over two hours and headings."""
    reference = F.col("start_us"), F.col("offset_us"), F.col("utc")
    e = _referenced(spark, sf)
    span = T.range_text(F.col("t_us"), F.col("t_us") + 7200000000, F.col("mode"), *reference)
    return e.select("ordinal", T.export_time(F.col("t_us"), F.col("mode"), *reference).alias("cell"), span.alias("span"), T.time_label(F.col("mode"), F.col("start_us")).alias("label"))


@query("M3", "SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE epoch_us(o_orderdate) + 46800000000 + 250000 END AS start_us FROM orders", base=False)
def date_lines(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    d = F.col("o_orderdate").cast("timestamp")
    german = F.element_at(F.map_from_arrays(F.array(*map(F.lit, range(1, 13))), F.array(*map(F.lit, "Jän Feb Mär Apr Mai Jun Jul Aug Sep Okt Nov Dez".split()))), F.month(d))
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("date Mon Feb 30 12:00:00 "), F.year(d))).when(
        F.col("o_orderkey") % 2 == 0, F.concat(F.lit("date "), F.date_format(d, "EEE MMM d"), F.lit(" 01:00:00.250 pm "), F.year(d))
    ).otherwise(F.concat(F.lit("date Mit "), german, F.lit(". "), F.dayofmonth(d), F.lit(" 13:00:00,250 "), F.year(d)))
    return o.select(F.col("o_orderkey").alias("ordinal"), T.parse_date_line(line).alias("start_us"))


@query("M4", _REF + " SELECT ordinal, t_us - off + CASE WHEN utc IS NULL THEN 7200000000 ELSE 0 END AS placed_us FROM rf WHERE k <> 5")
def placed(spark, sf):
    """Clock texts written two hours ahead of their log's clock: converted where both offsets are known, else taken as written."""
    e = _referenced(spark, sf)
    ahead = F.coalesce(F.col("utc"), F.lit(0)) + 120
    written = F.concat(F.translate(T.clock_text(F.col("t_us") + F.col("offset_us") + 7200000000), "-", "/"), F.lit(" "), F.replace(T.offset_text(ahead), F.lit(":"), F.lit("")))
    e = e.withColumn("written", written).filter("start_us is not null")
    return e.select("ordinal", T.timestamp_of_clock_text(F.col("written"), F.col("start_us"), F.col("offset_us"), F.col("utc")).alias("placed_us"))
