"""State of a bus at a time: latest frame of each key, intervals, changes and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .asof import neighbours
from .decode import small
from .ranges import Ranged
from .series import usable

KEY = ["source_id", "can_id", "extended", "channel", "direction"]


def _with_before(frames: DataFrame, keys: list[str]) -> DataFrame:
    """``frames`` with ``__before``, the time of the key's frame before, and ``__changed``, whether the payload is another."""
    f = Ranged(frames, keys, ("t_us", "ordinal")).lag(__before="t_us", __data="data").done()
    return f.withColumn("__changed", ~F.col("data").eqNullSafe(F.col("__data"))).drop("__data")


def _aggregates(until: Column, start: Column) -> list[Column]:
    """Of frames with ``__before`` and ``__changed``: what a trace shows of those from ``start`` to ``until``."""
    inside = until & (F.col("t_us") >= start)
    gap = F.when(inside & (F.col("__before") >= start), F.col("t_us") - F.col("__before"))
    return [
        F.count(F.when(inside, 1)).alias("count"), F.max(F.when(inside, F.struct("t_us", "ordinal", "data", gap.alias("__gap")))).alias("last"), F.min(F.when(inside, F.col("t_us"))).alias("first_us"),
        F.min(gap).alias("__lo"), F.max(gap).alias("__hi"), F.max(F.when(until & F.col("__changed"), F.col("t_us"))).alias("changed_us"),
    ]


def _shown(now: Column) -> list[Column]:
    known = F.col("last").isNotNull()
    return [
        "count", F.col("last.ordinal").alias("ordinal"), F.col("last.data").alias("data"), F.when(known, (now - F.col("last.t_us")) / 1000).alias("age_ms"), (F.col("last.__gap") / 1000).alias("interval_ms"),
        (F.col("__lo") / 1000).alias("min_ms"), (F.col("__hi") / 1000).alias("max_ms"), F.when(known, F.greatest("changed_us", "first_us")).alias("changed_us"),
    ]


def trace_at(frames: DataFrame, t_us: int, start_us: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Per key: latest frame at or before ``t_us``, count, age, latest, shortest and longest interval in ms, last change.

    Keys without a frame in the range are listed with count 0. Only intervals with both ends in range
    count. A change is a payload unlike the one before of the key, also beyond the start; the first frame
    in range counts as one.
    """
    keys = keys or KEY
    start = F.lit(start_us if start_us is not None else -(2**62))
    per = _with_before(frames, keys).groupBy(*keys).agg(*_aggregates(F.col("t_us") <= t_us, start))
    return per.select(*keys, *_shown(F.lit(t_us)))


def branches(frames: DataFrame, t_us: int, mux: str, start_us: int | None = None) -> DataFrame:
    """The same for each key (``whole`` true, no ``mux``) and beside it for each multiplexer branch of its frames.

    Intervals and changes of a branch are those between its own frames. Both groupings are one aggregation: a frame counts
    once with what lies before it in its key, once with what lies before it in its branch.
    """
    start = F.lit(start_us if start_us is not None else -(2**62))
    f = _with_before(frames, KEY).withColumnsRenamed({"__before": "__b", "__changed": "__c"})
    f = _with_before(f, [*KEY, mux])
    sets = F.array(
        F.struct(F.lit(True).alias("whole"), F.lit(None).cast(frames.schema[mux].dataType).alias("mux"), F.col("__b").alias("before"), F.col("__c").alias("changed")),
        F.struct(F.lit(False).alias("whole"), F.col(mux).alias("mux"), F.col("__before").alias("before"), F.col("__changed").alias("changed")),
    )
    each = f.select(*KEY, "t_us", "ordinal", "data", F.explode(sets).alias("set"))
    each = each.select(*KEY, "t_us", "ordinal", "data", F.col("set.whole").alias("whole"), F.col("set.mux").alias(mux), F.col("set.before").alias("__before"), F.col("set.changed").alias("__changed"))
    per = each.groupBy(*KEY, "whole", mux).agg(*_aggregates(F.col("t_us") <= t_us, start))
    return per.select(*KEY, *_shown(F.lit(t_us)), mux, "whole")


def trace_at_times(frames: DataFrame, times: DataFrame, start_us: int | None = None, end_us: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """``trace_at`` at each of many ``times(at_us)`` in one job: a row per key and distinct time.

    Each frame belongs to the first time that sees it (an as-of join in ranges of time). Per key and such time the frames aggregate to
    one delta; running sums over a key's deltas are its snapshots, and each stands until the time of the next
    one. So work grows with frames and with rows of the result, not with frames times ``times``. A frame beyond
    ``end_us`` is never seen; the age is counted from the asked time.
    """
    keys = keys or KEY
    start = F.lit(start_us if start_us is not None else -(2**62))
    asked = written(Ranged(times.select("at_us").distinct(), [], ("at_us",)).position("__slot").done())
    n = asked.count()
    seen = _with_before(frames if end_us is None else frames.filter(F.col("t_us") <= end_us), keys)
    probes = seen.withColumn("__one", F.lit(1)).select("__one", "t_us", *keys, "ordinal", "data", "__before", "__changed")
    series = asked.select(F.lit(1).alias("__one"), F.col("at_us").alias("t_us"), "__slot")
    placed = neighbours(probes, series, ["__one"]).withColumn("__slot", F.col("after.__slot")).drop("before", "after")
    delta = placed.filter("__slot is not null").groupBy(*keys, "__slot").agg(*_aggregates(F.lit(True), start))
    # A key is listed from the first time on, with nothing yet.
    none = {c: F.lit(None).cast(delta.schema[c].dataType) for c in ("last", "first_us", "__lo", "__hi", "changed_us")}
    begin = frames.select(*keys).distinct().withColumns({"__slot": F.lit(0).cast("long"), "count": F.lit(0).cast("long"), **none})
    both = written(delta.unionByName(begin).groupBy(*keys, "__slot").agg(
        F.sum("count").alias("count"), F.max("last").alias("last"), F.min("first_us").alias("first_us"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.max("changed_us").alias("changed_us"),
    ))
    r = Ranged(both, keys, ("__slot",)).lead(__next="__slot")
    r.running(count=(F.sum, "count"), last=(F.max, "last"), first_us=(F.min, "first_us"), __lo=(F.min, "__lo"), __hi=(F.max, "__hi"), changed_us=(F.max, "changed_us"))
    upto = F.coalesce("__next", F.lit(n)) - 1
    dense = r.done().withColumn("__slot", F.explode(F.when(upto >= F.col("__slot"), F.sequence(F.col("__slot"), upto))))
    return dense.join(small(asked), "__slot").select("at_us", *keys, *_shown(F.col("at_us")))


def latest_values(samples: DataFrame, t_us: int, start_us: int, keys: list[str]) -> DataFrame:
    """Latest usable value of each signal at or before a time; ``carried`` if it is from before the start."""
    s = samples.filter((F.col("t_us") <= t_us) & usable())
    best = s.groupBy(*keys).agg(F.max(F.struct("t_us", "ordinal", "value")).alias("last"))
    return best.select(*keys, F.col("last.value").alias("value"), F.col("last.t_us").alias("t_us"), (F.col("last.t_us") < start_us).alias("carried"))


def with_periods(trace: DataFrame, periods: DataFrame) -> DataFrame:
    """Deviation of the latest interval from the id's expected period, and staleness after three of them.

    The cycle of an id is not that of its multiplexer branches: rows with ``whole`` false get no period.
    """
    t = trace.join(small(periods), ["can_id", "extended"], "left")
    if "whole" in trace.columns:
        t = t.withColumn("period_ms", F.when(F.col("whole"), F.col("period_ms")))
    return t.withColumn("deviation_ms", F.col("interval_ms") - F.col("period_ms")).withColumn("stale", F.coalesce(F.col("age_ms") > 3 * F.col("period_ms"), F.lit(False)))


def with_missing(trace: DataFrame, defined: DataFrame) -> DataFrame:
    """Adds defined ids that were never received, with count 0."""
    missing = defined.join(trace, ["can_id", "extended"], "left_anti")
    return trace.unionByName(missing.withColumn("count", F.lit(0).cast("long")), allowMissingColumns=True)


def last_frames(frames: DataFrame, t_us: int, keys: list[str]) -> DataFrame:
    """The last frame of each key at or before a time."""
    f = frames.filter(F.col("t_us") <= t_us)
    return f.groupBy(*keys).agg(F.max_by("ordinal", F.struct("t_us", "ordinal")).alias("ordinal"), F.max("t_us").alias("t_us"))


def ordered(trace: DataFrame, pinned: Column, order: list[Column]) -> DataFrame:
    """``place`` of each row of a trace table: pinned rows first, then by ``order``, then by key. A row a key, so one sort suffices."""
    return trace.withColumn("place", F.row_number().over(Window.orderBy(pinned.desc(), *order, "can_id", "extended", "channel", "direction", "source_id")))


def received_before_first(frames: DataFrame) -> DataFrame:
    """``source_id, received``: frames of each source up to the first time of all, the head of a trace."""
    lo = frames.agg(F.min("t_us").alias("__lo"))
    return frames.crossJoin(F.broadcast(lo)).groupBy("source_id").agg(F.count(F.when(F.col("t_us") <= F.col("__lo"), 1)).alias("received"))
