"""Definition tables: overlays, changes, validation and re-decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import DIGITS, HEX, made_of
from ..functions.scale import scale_parts
from ..schemas import FD_LENGTHS
from ..storage import written
from .decode import occupied_bits, small


def replace_definitions(samples: DataFrame, fresh: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Samples with those of changed definitions taken out and the fresh ones put in."""
    return samples.join(small(changed.select(*keys).distinct()), keys, "left_anti").unionByName(fresh)


def unique_ids(rows: DataFrame, keys: list[str], id_col: str, order: str) -> DataFrame:
    """Repeated ids of a key get ``-2``, ``-3`` and so on, in order."""
    n = F.row_number().over(Window.partitionBy(*keys, id_col).orderBy(order))
    return rows.withColumn("__n", n).withColumn(id_col, F.when(F.col("__n") == 1, F.col(id_col)).otherwise(F.concat(id_col, F.lit("-"), "__n"))).drop("__n")


def valid_clips(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) clips: finite edges, rounded to microseconds, start at 0 or later, end after start."""
    c = clips.withColumn("start_s", F.round("start_s", 6)).withColumn("end_s", F.round("end_s", 6))
    good = F.coalesce(~F.isnan("start_s") & ~F.isnan("end_s") & (F.abs("end_s") < float("inf")) & (F.col("start_s") >= 0) & (F.col("end_s") > F.col("start_s")), F.lit(False))
    return c.filter(good), c.filter(~good)


def level_of(logs: DataFrame, levels: DataFrame) -> DataFrame:
    """Nearest level of each log: the longest folder that is a prefix of its path."""
    # Each log meets the levels at its own prefixes: an equi-join, whatever the number of levels.
    parts = F.split("path", "/")
    prefixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    at = logs.select("path", F.explode(F.array_distinct(prefixes)).alias("folder"))
    hits = at.join(small(levels.select("folder").distinct()), "folder")
    return hits.groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("level"))


def parent_level(levels: DataFrame) -> DataFrame:
    """``folder, parent``: the nearest level above each; none above the root."""
    up = F.when(F.contains("folder", F.lit("/")), F.regexp_replace("folder", "/[^/]*$", "")).when(F.col("folder") != "", F.lit(""))
    above = level_of(levels.select(up.alias("path")).filter("path is not null").distinct(), levels)
    return levels.withColumn("path", up).join(above, "path", "left").select("folder", F.col("level").alias("parent"))


def shared_ids(definitions: DataFrame, frame: list[str], place: list[str] | None = None) -> DataFrame:
    """Signal ids that more than one frame of a resolved place defines, with the number of frames."""
    on = [*(place or []), "signal_id"]
    return definitions.groupBy(*on).agg(F.count_distinct(*frame).alias("frames")).filter("frames > 1")


def overlay(definitions: DataFrame, key: list[str]) -> DataFrame:
    """Of the definitions seen along a chain of levels (``place, depth``), the deepest one of each key."""
    w = Window.partitionBy("place", *key).orderBy(F.desc("depth"), F.desc("def_id"))
    return definitions.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def group_chains(groups: DataFrame) -> DataFrame:
    """``place, member, depth`` of ``groups(group_id, parent_id)``: the groups from the top down to each place, the top at depth 1.

    A parent that nobody defines ends a chain; so does a group that the chain already has (a cycle). One join a level, over the
    table of groups.
    """
    edges = written(groups.select("group_id", "parent_id"))
    found = written(edges.select(F.col("group_id").alias("place"), F.col("group_id").alias("member"), F.lit(0).alias("up"), F.array("group_id").alias("seen")))
    chains, more = found, True
    defined = edges.select(F.col("group_id").alias("known"))
    while more:
        above = found.join(small(edges), found["member"] == edges["group_id"]).filter("parent_id is not null and not array_contains(seen, parent_id)")
        above = above.join(small(defined), F.col("parent_id") == F.col("known"), "left_semi")
        found = written(above.select("place", F.col("parent_id").alias("member"), (F.col("up") + 1).alias("up"), F.concat("seen", F.array("parent_id")).alias("seen")))
        more = found.limit(1).count() > 0
        chains = chains.union(found)
    top = chains.groupBy("place").agg(F.max("up").alias("__top"))
    return written(chains.join(small(top), "place").select("place", "member", (F.col("__top") - F.col("up") + 1).alias("depth")))


def resolve_levels(chains: DataFrame, definitions: DataFrame, key: list[str]) -> DataFrame:
    """What each place sees of ``definitions(group_id, def_id, ...)``: of each key the definition of the deepest level of its chain.

    Common definitions (null ``group_id``) lie above all levels. Frames are overlaid by CAN key, tables, calculations and bindings by id.
    """
    own = definitions.filter("group_id is not null").join(chains.select("place", F.col("member").alias("group_id"), "depth"), "group_id")
    common = definitions.filter("group_id is null")
    places = chains.select("place").distinct()
    if common.limit(1).count():
        # Each place holds all common definitions: a row each is the result, not a detour.
        own = own.unionByName(common.withColumn("depth", F.lit(0)).join(small(places), F.lit(True)).select(*own.columns))
    return overlay(own, key)


def bindings_in_use(bindings: DataFrame, frames: DataFrame) -> DataFrame:
    """Resolved bindings ``place, frame_id`` whose frame the place still has."""
    return bindings.join(frames.select("place", F.col("def_id").alias("frame_id")).distinct(), ["place", "frame_id"], "left_semi")


def changed_definitions(old: DataFrame, new: DataFrame, id_col: str = "def_id") -> DataFrame:
    """Ids added, removed or changed, by a full join that compares the rest of each row as JSON."""
    o, n = (d.select(id_col, F.to_json(F.struct(*sorted(c for c in d.columns if c != id_col))).alias(x)) for d, x in ((old, "o"), (new, "n")))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    return o.join(n, id_col, "full").filter("not (o <=> n)").select(id_col, kind.alias("kind"))


#: Settings whose change calls for decoding everything anew.
REBUILD_KINDS = ("plugin", "csv", "routing")


def keys_to_decode(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """``can_id, extended`` whose frames are to be decoded again: the keys that changed definitions had or have."""
    both = old.select("def_id", "can_id", "extended").union(new.select("def_id", "can_id", "extended"))
    return both.join(small(changed.select("def_id").distinct()), "def_id", "left_semi").select("can_id", "extended").distinct()


def rebuild_reasons(old: DataFrame, new: DataFrame) -> DataFrame:
    """``kind, changes``: how many ``settings(kind, id, ...)`` of plugins, CSV sources or routing differ, by kind; kinds without a change are left out."""
    mine = F.col("kind").isin(*REBUILD_KINDS)
    o, n = (d.filter(mine).withColumn("__id", F.struct("kind", "id")) for d in (old, new))
    return changed_definitions(o, n, "__id").groupBy("__id.kind").agg(F.count(F.lit(1)).alias("changes"))


def needs_full_rebuild(old: DataFrame, new: DataFrame) -> bool:
    """Whether any such setting differs; then no part of the samples can stay."""
    return rebuild_reasons(old, new).limit(1).count() > 0


#: Versions of project texts that can be read.
PROJECT_VERSIONS = (1, 4)
PROJECT = "version int, name string, frames array<struct<id:string,canId:int,extended:boolean,name:string,frameLength:int>>, clips array<struct<id:string,name:string,sourcePath:string,start:double,`end`:double>>, groups array<struct<id:string,members:array<string>>>"


def parse_projects(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(projects, frames, clips, report) of project texts ``project, text``.

    Missing names, lists and frame lengths get defaults (the id, empty, 8). Clips without a valid range and groups without
    members are left out and reported, as are texts of another version or that are no JSON.
    """
    j = texts.select("project", F.from_json("text", PROJECT).alias("j"))
    known = F.coalesce(F.col("j.version").between(*PROJECT_VERSIONS), F.lit(False))
    good = j.filter(known)
    projects = good.select("project", "j.version", F.coalesce("j.name", F.lit("")).alias("name"))
    frames = good.select("project", F.explode("j.frames").alias("f")).select("project", F.col("f.id").alias("def_id"), F.col("f.canId").alias("can_id"), F.coalesce("f.extended", F.col("f.canId") > 0x7FF).alias("extended"), F.coalesce("f.name", "f.id").alias("name"), F.coalesce("f.frameLength", F.lit(8)).alias("frame_bytes"))
    clips = good.select("project", F.explode("j.clips").alias("c")).select("project", F.col("c.id").alias("clip"), F.coalesce("c.name", "c.id").alias("name"), F.coalesce("c.sourcePath", F.lit("")).alias("source_path"), F.col("c.start").alias("start_s"), F.col("c.end").alias("end_s"))
    kept, bad = valid_clips(clips)
    groups = good.select("project", F.explode("j.groups").alias("g")).filter("g.id is null or g.members is null or size(g.members) = 0")
    report = (
        j.filter(~known).select("project", F.lit("PROJECT_VERSION").alias("code"), F.lit(None).cast("string").alias("id"))
        .union(bad.select("project", F.lit("CLIP_INVALID"), "clip")).union(groups.select("project", F.lit("GROUP_INVALID"), "g.id"))
    )
    return projects, frames, kept, report


#: Payload lengths that a frame can have (fixed values of the bus standard).
PAYLOADS = tuple(sorted(set(FD_LENGTHS)))


def validate(layouts: DataFrame, frame_bytes: int = 8) -> DataFrame:
    """``def_id, signal_id, problem`` for each broken rule of a layout table.

    ``layouts`` may also have ``frame_bytes, minimum, maximum``. Two signals may share bits only if both are conditional and no value of
    the selector activates both.
    """
    has = set(layouts.columns)
    length = F.col("frame_bytes") if "frame_bytes" in has else F.lit(frame_bytes)
    low, high = (F.col(c) if c in has else F.lit(None).cast("double") for c in ("minimum", "maximum"))
    end = F.col("byte_offset") + F.ceil((F.col("bit_offset") + F.col("length_bits")) / 8)
    infinite = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    offset = F.col("offset").try_cast("double")
    conditional = F.col("mux_role") == "conditional"
    spans = F.coalesce("mux_ranges", F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    selector = F.when((F.col("mux_role") == "selector") & (F.col("length_bits") <= 32), F.pow(F.lit(2.0), F.col("length_bits")) - 1)
    per = layouts.groupBy("def_id").agg(F.count_if(F.col("mux_role") == "selector").alias("__selectors"), F.count_if(F.col("mux_role") != "none").alias("__muxed"), F.max(selector).alias("__top"))
    rows = layouts.join(small(per), "def_id")
    top = F.when(F.col("__selectors") == 1, F.col("__top"))
    rules = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "NAME_EMPTY"),
        F.when(F.trim(F.coalesce("signal_id", F.lit(""))) == "", "ID_EMPTY"),
        F.when(~F.col("length_bits").between(1, 64), "LENGTH"),
        F.when(~F.col("bit_offset").between(0, 7) | (F.col("byte_offset") < 0), "OFFSET"),
        F.when(end > length, "OUTSIDE_FRAME"),
        F.when((F.col("signedness") == "float") & ~F.col("length_bits").isin(32, 64), "FLOAT_LENGTH"),
        F.when(scale_parts(F.col("scale"))[0].isNull(), "SCALE"),
        F.when(offset.isNull() | infinite(offset), "OFFSET_VALUE"),
        F.when(infinite(low) | infinite(high), "RANGE_VALUE"),
        F.when(low > high, "RANGE"),
        F.when((F.col("mux_role") == "selector") & ((F.col("signedness") != "unsigned") | (F.col("length_bits") > 32)), "SELECTOR_FORMAT"),
        F.when(conditional & (F.size(spans) == 0), "MUX_RANGES_EMPTY"),
        F.when(conditional & F.exists(spans, lambda r: (r["lo"] < 0) | (r["hi"] < r["lo"]) | F.coalesce(r["hi"] > top, F.lit(False))), "MUX_RANGE"),
        F.when((F.col("__muxed") > 0) & (F.col("__selectors") != 1), "SELECTOR_COUNT"),
    ))
    own = rows.select("def_id", "signal_id", F.explode(rules).alias("problem"))
    names = layouts.groupBy("def_id", F.lower("name").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.collect_list("signal_id").alias("ids")).filter("c > 1")
    twice = names.select("def_id", F.explode("ids").alias("signal_id"), F.lit("NAME_TWICE").alias("problem"))
    same = layouts.groupBy("def_id", "signal_id").count().filter("count > 1").select("def_id", "signal_id", F.lit("ID_TWICE").alias("problem"))
    key = ["def_id", "signal_id"]
    bits = occupied_bits(layouts).join(layouts.select(*key, "mux_role", spans.alias("spans")), key).select("def_id", "byte", "bit", F.struct("signal_id", "mux_role", "spans").alias("s"))
    shared = bits.groupBy("def_id", "byte", "bit").agg(F.collect_set("s").alias("ss")).filter("size(ss) > 1")
    pairs = shared.select("def_id", F.explode("ss").alias("a"), "ss").select("def_id", "a", F.explode("ss").alias("b")).filter("a.signal_id <> b.signal_id").distinct()
    meet = F.exists("a.spans", lambda x: F.exists("b.spans", lambda y: (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"])))
    disjoint = (F.col("a.mux_role") == "conditional") & (F.col("b.mux_role") == "conditional") & ~meet
    overlap = pairs.filter(~disjoint).select("def_id", F.col("a.signal_id").alias("signal_id"), F.lit("OVERLAP").alias("problem")).distinct()
    return own.unionByName(twice).unionByName(same).unionByName(overlap)


def validate_frames(frames: DataFrame) -> DataFrame:
    """``def_id, problem`` of frame definitions ``def_id, name, can_id, extended, frame_bytes, expected_period_ms``."""
    period = F.col("expected_period_ms")
    rules = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("def_id", F.lit(""))) == "", "ID_EMPTY"), F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "NAME_EMPTY"),
        F.when(~F.coalesce(F.col("can_id").between(0, F.when(F.col("extended"), 0x1FFFFFFF).otherwise(0x7FF)), F.lit(False)), "CAN_ID_RANGE"),
        F.when(~F.coalesce(F.col("frame_bytes").isin(*PAYLOADS), F.lit(False)), "FRAME_LENGTH"), F.when((period <= 0) | F.isnan(period) | (period == float("inf")), "EXPECTED_PERIOD"),
    ))
    return frames.select("def_id", F.explode(rules).alias("problem"))


def validate_labels(labels: DataFrame, layouts: DataFrame) -> DataFrame:
    """``def_id, signal_id, problem`` of value labels ``def_id, signal_id, raw_text, label``: keys are decimal or ``0x`` integers, within the field, once each."""
    key = F.trim("raw_text")
    unsigned = F.when(key.startswith("-"), F.substring(key, F.lit(2), F.length(key))).otherwise(key)
    hexadecimal = F.lower(F.substring(unsigned, 1, 2)) == "0x"
    figures = F.substring(unsigned, F.lit(3), F.length(unsigned))
    size = F.when(hexadecimal, F.when(made_of(figures, HEX) & (F.length(figures) <= 16), F.conv(figures, 16, 10))).when(made_of(unsigned, DIGITS) & ((unsigned == "0") | ~unsigned.startswith("0")), unsigned).try_cast("decimal(38,0)")
    raw = F.when(~key.startswith("-"), size).when(size != 0, -size)
    l = labels.withColumn("__raw", raw).join(small(layouts.select("def_id", "signal_id", "length_bits", "signedness").distinct()), ["def_id", "signal_id"])
    n = F.count("__raw").over(Window.partitionBy("def_id", "signal_id", "__raw"))
    signed = F.col("signedness") == "signed"
    top = F.pow(F.lit(2.0), F.col("length_bits") - signed.cast("int"))
    outside = (F.col("__raw").cast("double") >= top) | (F.col("__raw").cast("double") < F.when(signed, -top).otherwise(0.0))
    rules = F.array_compact(F.array(
        F.when(F.col("__raw").isNull() | F.col("label").isNull(), "LABEL_RAW"), F.when(F.col("__n") > 1, "LABEL_TWICE"), F.when(outside, "LABEL_RANGE"), F.when(F.col("signedness") == "float", "FLOAT_LABELS"),
    ))
    return l.withColumn("__n", n).select("def_id", "signal_id", F.explode(rules).alias("problem")).distinct()


def validate_derived(derived: DataFrame, layouts: DataFrame) -> DataFrame:
    """``def_id, signal_id, problem`` of derived signals ``def_id, signal_id, place, name, kind, inputs, points, seconds``.

    ``inputs`` are the names that an expression, lookup or filter refers to: signals of the frame or derived ones of an earlier ``place``. A
    lookup needs two finite points or more with different inputs, a filter a positive time.
    """
    points = F.coalesce("points", F.array().cast("array<struct<input:double,output:double>>"))
    finite = lambda p: ~F.isnan(p["input"]) & ~F.isnan(p["output"]) & (F.abs(p["input"]) < float("inf")) & (F.abs(p["output"]) < float("inf"))
    lookup, seconds = F.col("kind") == "lookup", F.col("seconds")
    good = F.filter(points, finite)
    rules = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("signal_id", F.lit(""))) == "", "ID_EMPTY"), F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "NAME_EMPTY"), F.when(F.size(F.coalesce("inputs", F.array().cast("array<string>"))) == 0, "INPUT_EMPTY"),
        F.when(lookup & (F.size(points) < 2), "LOOKUP_POINTS"), F.when(lookup & (F.size(good) < F.size(points)), "LOOKUP_POINT"),
        F.when(lookup & (F.size(F.array_distinct(F.transform(good, lambda p: p["input"]))) < F.size(good)), "LOOKUP_INPUT_TWICE"),
        F.when((F.col("kind") == "filter") & ~F.coalesce((seconds > 0) & (seconds < float("inf")), F.lit(False)), "FILTER_TIME"),
    ))
    own = derived.select("def_id", "signal_id", F.explode(rules).alias("problem"))
    known = layouts.select("def_id", F.trim("name").alias("input"), F.lit(-1).alias("__from")).union(derived.select("def_id", F.trim("name"), "place")).groupBy("def_id", "input").agg(F.min("__from").alias("__from"))
    used = derived.select("def_id", "signal_id", "place", F.explode("inputs").alias("input")).join(known, ["def_id", "input"], "left")
    forward = used.filter("__from is null or __from >= place").select("def_id", "signal_id", F.lit("FORWARD_REFERENCE").alias("problem")).distinct()
    return own.unionByName(forward)
