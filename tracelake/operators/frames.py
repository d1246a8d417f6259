"""Filters, pages, counts and time steps over frames."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decode import small


def by_refs(frames: DataFrame, refs: DataFrame) -> DataFrame:
    """Frames whose exact (can_id, extended) is listed."""
    return frames.join(small(refs.select("can_id", "extended").distinct()), ["can_id", "extended"], "left_semi")


def where(frames: DataFrame, direction: str | None = None, channel: int | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """Direction, channel and an inclusive time range; conditions reach the scan."""
    for name, want in (("direction", direction), ("channel", channel)):
        if want is not None:
            frames = frames.filter(F.col(name) == want)
    if start is not None:
        frames = frames.filter(F.col("ts") >= start)
    return frames if end is None else frames.filter(F.col("ts") <= end)


def decoded(frames: DataFrame, samples: DataFrame, yes: bool = True) -> DataFrame:
    """Frames that gave samples, or those that gave none."""
    return frames.join(samples.select("source_id", "ordinal"), ["source_id", "ordinal"], "left_semi" if yes else "left_anti")


def id_text(can_id: Column, extended: Column) -> Column:
    """Hexadecimal id; extended ids that a standard one could be have an ``x`` behind."""
    return F.concat(F.hex(can_id), F.when(extended & (can_id <= 0x7FF), "x").otherwise(""))


def payload_text(data: Column) -> Column:
    return F.regexp_replace(F.hex(data), "(..)(?!$)", "$1 ")


def search_fields(name: Column, tags: Column, only_undecoded_payload: bool = False) -> list[Column]:
    payload = payload_text(F.col("data"))
    if only_undecoded_payload:
        payload = F.when(F.coalesce(tags, F.lit("")) == "", payload)
    return [id_text(F.col("can_id"), F.col("extended")), F.concat(F.lit("0x"), F.hex("can_id")), payload, name, tags]


def keyword(frames: DataFrame, text: str, fields: list[Column]) -> DataFrame:
    """Frames with the trimmed, case-folded text in any field; cheap fields are tried first."""
    want = text.strip().lower()
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(want)), F.lit(False))
    return frames.filter(hit) if want else frames


def pattern(frames: DataFrame, regex: str, fields: list[Column]) -> DataFrame:
    """Frames where any field matches, ignoring case; a pattern that cannot be compiled matches nothing."""
    try:
        # Spark's own engine says whether it can run the pattern; another one's syntax differs.
        frames.sparkSession.range(1).select(F.lit("").rlike(f"(?i){regex}")).collect()
    except PySparkException:
        return frames.filter(F.lit(False))
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(f.rlike(f"(?i){regex}"), F.lit(False))
    return frames.filter(hit)


def page(frames: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` and on in arrival order; the limit is held to 1 to 2000."""
    return frames.orderBy("ordinal").offset(max(0, offset)).limit(min(2000, max(1, limit)))


def count_by_ref(frames: DataFrame) -> DataFrame:
    return frames.groupBy("can_id", "extended").agg(F.count(F.lit(1)).alias("frames"))


def bounds(frames: DataFrame) -> DataFrame:
    """First and last finite time."""
    return frames.filter(~F.isnan("ts") & (F.abs("ts") < float("inf"))).agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


def step(frames: DataFrame, at: DataFrame) -> DataFrame:
    """``probe`` times with the next and the previous distinct frame time, held to the first and last."""
    times = frames.select("t_us").distinct()
    from .asof import neighbours

    one = times.select(F.lit(1).alias("__k"), "t_us")
    after = neighbours(at.select(F.lit(1).alias("__k"), (F.col("probe") + 1).alias("t_us"), "probe"), one, ["__k"])
    before = neighbours(at.select(F.lit(1).alias("__k"), (F.col("probe") - 1).alias("t_us"), "probe"), one, ["__k"])
    ends = times.agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    both = after.select("probe", F.col("after.t_us").alias("next")).join(before.select("probe", F.col("before.t_us").alias("previous")), "probe")
    return both.crossJoin(F.broadcast(ends)).select("probe", F.coalesce("next", "hi").alias("next_us"), F.coalesce("previous", "lo").alias("previous_us"))


def display_width(text: Column) -> Column:
    """Characters, wide ones (CJK, Hangul, full-width forms, emoji) counted twice."""
    wide = r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1FAFF}]"
    return F.length(text) + F.regexp_count(text, F.lit(wide))


def widest(rows: DataFrame, keys: list[str], text: str, order: str, n: int = 3) -> DataFrame:
    """The ``n`` widest texts of each key, earlier ones first on a tie."""
    w = Window.partitionBy(*keys).orderBy(F.desc("width"), order)
    return rows.withColumn("width", display_width(F.col(text))).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or adjacent integer ranges ``lo..hi`` of each key as one."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    upto = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(upto.isNull() | (F.col("lo") > upto + 1), 1).otherwise(0)
    island = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("fresh", fresh).withColumn("island", island).groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")
