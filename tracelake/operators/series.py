"""Operators on time series of samples: rows, gaps, thinning, nearest values and changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .decode import small
from .ranges import Ranged, settled, totals

ORDER = ("t_us", "ordinal")


def series_window(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*ORDER)


def usable(value: str = "value", quality: str = "quality") -> Column:
    v = F.col(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (F.coalesce(F.col(quality), F.lit("valid")) == "valid")


def align(samples: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Rows for each distinct time: the k-th sample of a signal at a time stands beside the k-th of the others."""
    k = F.row_number().over(Window.partitionBy(*keys, "signal_id", "t_us").orderBy("ordinal"))
    return samples.filter(F.col("signal_id").isin(ids)).withColumn("k", k).groupBy(*keys, "t_us", "k").pivot("signal_id", ids).agg(F.first("value"))


def wide(samples: DataFrame, row: list[str], ids: list[str], value: str = "value") -> DataFrame:
    """One row per event row with a column for each signal; no value is carried forward, the last in a row wins."""
    return samples.filter(F.col("signal_id").isin(ids)).groupBy(*row).pivot("signal_id", ids).agg(F.max_by(value, "seq"))


def even_positions(n: Column, limit: int | Column) -> Column:
    """Positions ``round(i * (n - 1) / (limit - 1))`` without repeats; the first alone for a limit of 1, none below."""
    most = F.lit(limit).cast("long") if isinstance(limit, int) else limit
    i = F.sequence(F.lit(0).cast("long"), most - 1)
    spread = F.array_distinct(F.transform(i, lambda x: F.floor(x * (n - 1) / (most - 1) + 0.5)))
    none = F.array().cast("array<bigint>")
    return F.when((most <= 0) | (n <= 0), none).when(n <= most, F.sequence(F.lit(0).cast("long"), n - 1)).when(most == 1, F.array(F.lit(0).cast("long"))).otherwise(spread)


def thin_evenly(samples: DataFrame, keys: list[str], limit: int) -> DataFrame:
    at = Ranged(samples, keys, ORDER).position("position").done()
    n = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.explode(even_positions(F.col("n"), limit)).alias("position"))
    return at.join(n, [*keys, "position"], "left_semi")


def changes(samples: DataFrame, keys: list[str], gap_us: Column | None = None) -> DataFrame:
    """Change of each usable sample against the one before of its signal: ``kind`` and ``magnitude``.

    ``recovery`` after a gap or an unusable sample, ``state`` where a label takes part, else ``numeric``
    with the step as a share of the signal's range, 1 at most.
    """
    s = Ranged(samples.withColumn("ok", usable()), keys, ORDER).lag(before=F.struct("t_us", "value", "value_label", "ok")).done()
    v = F.when(F.col("ok"), F.col("value"))
    s = totals(s, keys, lo=F.min(v), hi=F.max(v))
    b = F.col("before")
    gap = (F.col("t_us") - b["t_us"] > gap_us) if gap_us is not None else F.lit(False)
    same = (F.col("value") == b["value"]) & F.col("value_label").eqNullSafe(b["value_label"])
    labelled = F.col("value_label").isNotNull() | b["value_label"].isNotNull()
    kind = (
        F.when(b.isNull() | ~F.col("ok"), None).when(~b["ok"] | gap, "recovery").when(same, None).when(labelled, "state").when(F.col("hi") > F.col("lo"), "numeric")
    )
    size = F.least(F.lit(1.0), F.abs(F.col("value") - b["value"]) / (F.col("hi") - F.col("lo")))
    return s.withColumn("kind", kind).withColumn("magnitude", F.when(F.col("kind") == "numeric", size)).filter("kind is not null").drop("before", "lo", "hi", "ok")


def slice_with_context(samples: DataFrame, keys: list[str], start_us: int, end_us: int) -> DataFrame:
    """Samples of a time range and one on each side of it."""
    inside = F.col("t_us").between(start_us, end_us)
    s = Ranged(samples.withColumn("inside", inside), keys, ORDER).lag(__before="t_us").lead(__after="t_us").done()
    near = F.coalesce(F.col("__after") >= start_us, F.lit(False)) & (F.col("t_us") < start_us) | F.coalesce(F.col("__before") <= end_us, F.lit(False)) & (F.col("t_us") > end_us)
    return s.filter(F.col("inside") | near).drop("__before", "__after")


def clip_with_carried(samples: DataFrame, keys: list[str], start_us: int, end_us: int) -> DataFrame:
    """Samples of a clip, and the nearest outside each edge marked ``carried`` unless one lies exactly on the edge."""
    fields = [c for c in samples.columns if c not in keys]
    row = F.struct("t_us", "ordinal", *[c for c in fields if c not in ("t_us", "ordinal")])
    inside = samples.filter(F.col("t_us").between(start_us, end_us)).withColumn("carried", F.lit(False))
    edges = inside.groupBy(*keys).agg(F.max(F.col("t_us") == start_us).alias("on_start"), F.max(F.col("t_us") == end_us).alias("on_end"))
    outer = samples.filter((F.col("t_us") < start_us) | (F.col("t_us") > end_us)).groupBy(*keys).agg(
        F.max(F.when(F.col("t_us") < start_us, row)).alias("first"), F.min(F.when(F.col("t_us") > end_us, row)).alias("last")
    )
    outer = outer.join(edges, keys, "left")
    parts = [
        outer.filter(f"{side} is not null and not coalesce({edge}, false)").select(*keys, *[F.col(f"{side}.{c}").alias(c) for c in fields], F.lit(True).alias("carried"))
        for side, edge in (("first", "on_start"), ("last", "on_end"))
    ]
    return inside.unionByName(parts[0]).unionByName(parts[1])


def placed(samples: DataFrame, keys: list[str]) -> DataFrame:
    """``samples`` with their place ``__p`` in the series, whether they are usable (``__ok``), and time and usability of the samples
    before (``__t0, __ok0``) and after (``__t1, __ok1``): all that cadence and breaks need, in one window pass, written."""
    s = Ranged(samples.withColumn("__ok", usable()), keys, ORDER).position("__p")
    return written(s.lag(__t0="t_us", __ok0="__ok").lead(__t1="t_us", __ok1="__ok").done())


#: Neighbours that a cadence is read off where a query asks for evenly picked ones.
PICKED_PAIRS = 2048


def cadence(samples: DataFrame, keys: list[str], pairs: int | None = None) -> DataFrame:
    """``threshold_us`` of each signal: four times the upper median step between usable neighbours.

    All neighbours count, or up to ``pairs`` evenly picked ones; without a positive step there is no threshold (null).
    """
    return cadence_of(placed(samples, keys), keys, pairs)


def cadence_of(placed: DataFrame, keys: list[str], pairs: int | None = None) -> DataFrame:
    """``cadence`` of samples that ``placed`` has numbered."""
    s = placed.filter("__p > 0 and __ok and __ok0 and t_us > __t0")
    if pairs is None:
        series = placed.select(*keys).distinct()
    else:
        series = written(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
        # The i-th of c picks is at 1 + i * (n - 1) div c; a sample can only be the pick of the first i that reaches its place.
        s = s.join(small(series), keys).filter("n > 1").withColumn("__c", F.least(F.lit(pairs).cast("long"), F.col("n") - 1))
        s = s.withColumn("__i", F.expr("((__p - 1) * __c + n - 2) div (n - 1)")).filter("__i < __c and (__i * (n - 1)) div __c = __p - 1")
    median = _upper_median(s.select(*keys, (F.col("t_us") - F.col("__t0")).alias("step")), keys, "step")
    return series.select(*keys).join(median.select(*keys, (F.col("step") * 4).alias("threshold_us")), keys, "left")


def _upper_median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each series in the middle of its order, the upper of two: equal values are counted, then the counts added up in order."""
    counted = written(values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c")))
    s = Ranged(counted, keys, [value]).running_sum(__upto=F.col("__c")).done()
    s = s.join(settled(counted.groupBy(*keys).agg(F.sum("__c").alias("__m"))), keys).filter("__upto > __m div 2")
    return s.groupBy(*keys).agg(F.min(value).alias(value))


def _broken(before: tuple[Column, Column], here: tuple[Column, Column]) -> Column:
    """Whether a line is broken between two samples ``(t_us, usable)``, by ``threshold_us``; not before the first."""
    close = F.coalesce(here[0] - before[0] <= F.coalesce("threshold_us", F.lit(2**62)), F.lit(True))
    return F.when(before[1].isNull() | here[1].isNull(), False).otherwise(~(here[1] & before[1] & close))


def with_break_samples(placed: DataFrame, keys: list[str], thresholds: DataFrame) -> DataFrame:
    """``placed`` with ``broken``: both samples at each end of a break; the inside of an invalid stretch is left out."""
    s = placed.join(settled(thresholds), keys, "left")
    before, here, after = ((F.col(t), F.col(ok)) for t, ok in (("__t0", "__ok0"), ("t_us", "__ok"), ("__t1", "__ok1")))
    either = [F.coalesce(a[1] | b[1], F.lit(False)) for a, b in ((before, here), (here, after))]
    end = (before[1].isNull() | after[1].isNull()) & ~here[1]
    return s.withColumn("broken", _broken(before, here) & either[0] | _broken(here, after) & either[1] | end).drop("threshold_us")


def break_samples(samples: DataFrame, keys: list[str], thresholds: DataFrame | None = None) -> DataFrame:
    """Both samples at each end of a break; the inside of an invalid stretch is left out. Without ``thresholds`` those of ``cadence``."""
    p = placed(samples, keys)
    return with_break_samples(p, keys, cadence_of(p, keys) if thresholds is None else thresholds).filter("broken").select(*samples.columns)


def gaps(samples: DataFrame, keys: list[str], thresholds: DataFrame | None, resolution_us: int) -> DataFrame:
    """Intervals between the samples at each break; those at most ``resolution_us`` apart are merged. Without ``thresholds`` those of ``cadence``."""
    p = placed(samples, keys)
    s = p.join(settled(cadence_of(p, keys) if thresholds is None else thresholds), keys, "left")
    breaks = _broken((F.col("__t0"), F.col("__ok0")), (F.col("t_us"), F.col("__ok")))
    g = s.filter(breaks).select(*keys, F.col("__t0").alias("start_us"), F.col("t_us").alias("end_us"), "ordinal")
    r = Ranged(g, keys, ("start_us", "end_us", "ordinal")).running(__upto=(F.max, "end_us")).lag(__before="__upto")
    r.running_sum(gap=F.when(F.col("__before").isNull() | (F.col("start_us") - F.col("__before") > resolution_us), 1).otherwise(0))
    g = r.done("__upto", "__before")
    return g.groupBy(*keys, "gap").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("gap")


def long_steps(samples: DataFrame, keys: list[str], threshold_us: int) -> DataFrame:
    """Intervals of more than ``threshold_us`` between one sample and the next: ``start_us, end_us``."""
    s = Ranged(samples, keys, ORDER).lag(start_us="t_us").done().filter(F.col("t_us") - F.col("start_us") > threshold_us)
    return s.select(*keys, "start_us", F.col("t_us").alias("end_us"))


def with_place(samples: DataFrame, keys: list[str], name: str = "place") -> DataFrame:
    """``samples`` with the place of each in its series, from 1: by time, then order of arrival."""
    s = Ranged(samples, keys, ORDER).position("__p").done()
    return s.withColumn(name, F.col("__p") + 1).drop("__p")


def value_ranges(samples: DataFrame, keys: list[str]) -> DataFrame:
    """``lo, hi`` of the usable samples of each signal."""
    return samples.filter(usable()).groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def on_shared_times(samples: DataFrame, thinned: DataFrame) -> DataFrame:
    """Joined thinning: all samples at the times that any of the thinned series keeps."""
    return samples.join(thinned.select("t_us").distinct(), "t_us", "left_semi")


def overlapping(events: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Events ``t_us, end_us`` (null: a moment) that overlap a range, edges included."""
    return events.filter((F.coalesce("end_us", "t_us") >= start_us) & (F.col("t_us") <= end_us))


def intersected(ranges: DataFrame, start_us: int | None, end_us: int | None) -> DataFrame:
    """The part of each ``start_us, end_us`` inside a range; null bounds are open, empty parts are left out."""
    start = F.col("start_us") if start_us is None else F.greatest("start_us", F.lit(start_us))
    end = F.col("end_us") if end_us is None else F.least("end_us", F.lit(end_us))
    return ranges.withColumns({"start_us": start, "end_us": end}).filter("start_us is null or end_us is null or start_us <= end_us")


def _numbered(samples: DataFrame, keys: list[str], breaks: DataFrame | None, order: Sequence[str] = ORDER) -> DataFrame:
    """Samples with their place ``p`` in the series, its length ``n`` and whether they are break samples."""
    s = totals(Ranged(samples, keys, order).position("p").done(), keys, n=F.count(F.lit(1)))
    if breaks is None:
        return s.withColumn("broken", F.lit(False))
    s = s.join(breaks.select(*keys, "ordinal", F.lit(True).alias("__b")), [*keys, "ordinal"], "left")
    return s.withColumn("broken", F.coalesce("__b", F.lit(False))).drop("__b")


def _kept_places(numbered: DataFrame, keys: list[str], runs: DataFrame, measures: Sequence[str] = ("value",)) -> DataFrame:
    """``keys, p`` of the samples that stay when each series is cut into ``runs(keys, runs)``."""
    s = numbered.join(small(runs), keys).withColumn("run", F.floor(((F.col("p") + 1) * F.col("runs") - 1) / F.col("n")))
    ends = [F.min("p").alias("a"), F.max("p").alias("b"), F.min(F.when(F.col("broken"), F.col("p"))).alias("c"), F.max(F.when(F.col("broken"), F.col("p"))).alias("d")]
    for i, m in enumerate(measures):
        v = F.col(m)
        finite = ~F.isnan(v) & v.isNotNull() & (F.abs(v) < float("inf"))
        ends += [F.min(F.when(finite, F.struct(side.alias("v"), F.col("p").alias("p")))).alias(f"{name}{i}") for name, side in (("lo", v), ("hi", -v))]
    kept = s.groupBy(*keys, "run").agg(*ends)
    places = F.array_compact(F.array("a", "b", "c", "d", *(f"{name}{i}.p" for i in range(len(measures)) for name in ("lo", "hi"))))
    return kept.select(*keys, F.explode(F.array_distinct(places)).alias("p"))


def extremes(samples: DataFrame, keys: list[str], runs: DataFrame, breaks: DataFrame | None = None) -> DataFrame:
    """Of each of ``runs(keys, runs)`` equal runs: first, last, lowest, highest, and first and last break sample.

    Ties keep the earlier sample. Samples are numbered in ranges of time, one aggregation finds the positions.
    """
    s = _numbered(samples, keys, breaks)
    return s.join(_kept_places(s, keys, runs), [*keys, "p"], "left_semi").select(*samples.columns)


def thin(
    samples: DataFrame, keys: list[str], limit: int | str, breaks: DataFrame | None = None,
    measures: Sequence[str] = ("value",), order: Sequence[str] = ORDER, per_run: int = 6,
) -> DataFrame:
    """Thinning that keeps peaks: starts with the runs that surely fit, then up to three times more while it fits.

    ``limit`` is a number, or a column with one number a series. Short series are kept whole, limits under
    ``per_run`` (the most samples that a run keeps) take samples at even places. The samples are numbered once and
    written; the counts that steer it are one row per series.
    """
    most = F.lit(limit) if isinstance(limit, int) else F.col(limit)
    s = written(_numbered(samples.withColumn("__most", most.cast("long")), keys, breaks, order))
    return _thinned(s, keys, limit, measures, per_run).select(*samples.columns)


def thin_with_breaks(samples: DataFrame, keys: list[str], limit: int | str, pairs: int | None = None) -> DataFrame:
    """``thin`` that keeps the samples at both ends of each break; places, cadence (of ``pairs``) and breaks come from one window pass."""
    most = F.lit(limit) if isinstance(limit, int) else F.col(limit)
    p = placed(samples.withColumn("__most", most.cast("long")), keys)
    s = totals(with_break_samples(p, keys, cadence_of(p, keys, pairs)).withColumnRenamed("__p", "p"), keys, n=F.count(F.lit(1)))
    return _thinned(s, keys, limit, ("value",), 6).select(*samples.columns)


def _thinned(s: DataFrame, keys: list[str], limit: int | str, measures: Sequence[str], per_run: int) -> DataFrame:
    """The rows of ``s`` (``p, n, __most, broken`` beside the samples) that ``thin`` keeps."""
    parts = [s.filter(F.col("n") <= F.col("__most"))]
    if not isinstance(limit, int) or limit < per_run:
        parts.append(s.filter((F.col("n") > F.col("__most")) & (F.col("__most") < per_run) & F.array_contains(even_positions(F.col("n"), F.col("__most")), F.col("p"))))
    if not isinstance(limit, int) or limit >= per_run:
        long = s.filter((F.col("n") > F.col("__most")) & (F.col("__most") >= per_run))
        runs = written(long.groupBy(*keys).agg(F.first("n").alias("n"), F.first("__most").alias("__most")).withColumn("runs", F.floor(F.col("__most") / per_run)))

        def counted(runs: DataFrame, name: str) -> DataFrame:
            return _kept_places(s, keys, runs.select(*keys, "runs"), measures).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

        # What was counted for more runs that fit holds for the next turn; where more did not fit they never will.
        tried = runs.join(counted(runs, "got"), keys).withColumn("open", F.lit(True))
        for _ in range(3):
            more = F.least("n", F.floor(F.col("runs") * F.col("__most") / F.col("got")))
            tried = tried.withColumn("next", more).withColumn("open", F.col("open") & (F.col("got") < 0.9 * F.col("__most")) & (F.col("next") > F.col("runs")))
            tried = written(tried)
            again = tried.filter("open")
            if not again.limit(1).count():
                break
            after = written(counted(again.select(*keys, F.col("next").alias("runs")), "then"))
            fits = F.coalesce(F.col("then") <= F.col("__most"), F.lit(False))
            tried = tried.join(after, keys, "left").select(*keys, "n", "__most", *(F.when(fits, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("runs", "next"), ("got", "then"))), fits.alias("open"))
        kept = written(_kept_places(s, keys, tried.select(*keys, "runs"), measures))
        parts.append(s.join(small(kept), [*keys, "p"], "left_semi").select(s.columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pyramid(samples: DataFrame, keys: list[str], block: int = 64) -> DataFrame:
    """Summaries of blocks of samples: extremes, largest step and whether all are usable."""
    s = Ranged(samples.withColumn("ok", usable()), keys, ORDER).position("__p").done()
    s = s.withColumn("block", F.floor(F.col("__p") / block))
    step = F.col("t_us") - F.lag("t_us").over(Window.partitionBy(*keys, "block").orderBy(*ORDER))
    v = F.when(F.col("ok"), F.col("value"))
    return s.withColumn("step", step).groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.max("step").alias("max_step_us"), F.min("ok").alias("all_usable"),
    )


def levels(samples: DataFrame, keys: list[str], block: int = 64, fan: int = 16, most: int = 4) -> DataFrame:
    """A pyramid of block summaries: ``level`` 0 of ``block`` samples, each further one of ``fan`` blocks of the one below.

    Beside extremes of usable samples and the largest step inside, a block knows the sample before it (``before_us, before_ok``), whether
    all its samples are usable, and the extent of the block above it (``up_first_us, up_last_us``; null at the top), by which a reader
    tells which blocks of a level to take. Written, sorted by level, series and time, so that readers skip what lies outside.
    """
    s = Ranged(samples.withColumn("ok", usable()), keys, ORDER).position("__p").lag(before_us="t_us", before_ok="ok").done()
    s = s.withColumn("block", F.floor(F.col("__p") / block))
    v = F.when(F.col("ok"), F.col("value"))
    first = F.col("__p") % block == 0
    step = F.col("t_us") - F.col("before_us")
    here = written(s.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.max(F.when(~first, step)).alias("max_step_us"), F.min("ok").alias("all_usable"), F.max(F.when(first, F.col("before_us"))).alias("before_us"), F.max(F.when(first, F.col("before_ok"))).alias("before_ok"),
    ))
    out, level = [], 0
    while True:
        up = written(here.withColumn("above", F.floor(F.col("block") / fan)).groupBy(*keys, F.col("above").alias("block")).agg(
            F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.max(F.greatest("max_step_us", F.when(F.col("block") % fan != 0, F.col("first_us") - F.col("before_us")))).alias("max_step_us"), F.min("all_usable").alias("all_usable"),
            F.min_by("before_us", "block").alias("before_us"), F.min_by("before_ok", "block").alias("before_ok"),
        )) if level < most else None
        extent = up.select(*keys, F.col("block").alias("above"), F.col("first_us").alias("up_first_us"), F.col("last_us").alias("up_last_us")) if up is not None else None
        if extent is not None:
            linked = here.withColumn("above", F.floor(F.col("block") / fan)).join(extent, [*keys, "above"]).drop("above")
        else:
            linked = here.withColumns({"up_first_us": F.lit(None).cast("long"), "up_last_us": F.lit(None).cast("long")})
        out.append(linked.withColumn("level", F.lit(level)))
        if up is None:
            break
        here, level = up, level + 1
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o)
    return written(both.repartitionByRange("level", *keys, "first_us").sortWithinPartitions("level", *keys, "first_us"))


def _inside(pyramid: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """The blocks that cover a view from within: of each place the coarsest that fits."""
    here = (F.col("first_us") >= start_us) & (F.col("last_us") <= end_us)
    above = F.coalesce((F.col("up_first_us") >= start_us) & (F.col("up_last_us") <= end_us), F.lit(False))
    return pyramid.filter(here & ~above)


def view_extremes(samples: DataFrame, pyramid: DataFrame, keys: list[str], start_us: int, end_us: int) -> DataFrame:
    """``n, lo, hi`` of each series in a view (edges included): whole blocks from the pyramid, samples only at its two edges.

    ``n`` counts all samples, ``lo`` and ``hi`` are of usable ones. The bounds reach the scan of blocks as filters, and the scan of samples as
    the two stretches that no block covers.
    """
    blocks = written(_inside(pyramid, start_us, end_us))
    covered = blocks.groupBy(*keys).agg(F.min("first_us").alias("__a"), F.max("last_us").alias("__b"))
    # One row: how far the edges reach in from the view's ends, over all series.
    touched = pyramid.filter((F.col("level") == 0) & (F.col("last_us") >= start_us) & (F.col("first_us") <= end_us) & ((F.col("first_us") < start_us) | (F.col("last_us") > end_us)))
    left, right = touched.agg(F.max(F.when(F.col("first_us") < start_us, F.col("last_us"))), F.min(F.when(F.col("last_us") > end_us, F.col("first_us")))).first()
    edge = F.col("t_us").between(start_us, left if left is not None else start_us - 1) | F.col("t_us").between(right if right is not None else end_us + 1, end_us)
    raw = samples.filter(F.col("t_us").between(start_us, end_us)).filter(edge).join(small(covered), keys, "left")
    raw = raw.filter(F.col("__a").isNull() | (F.col("t_us") < F.col("__a")) | (F.col("t_us") > F.col("__b")))
    v = F.when(usable(), F.col("value"))
    parts = blocks.select(*keys, "n", "lo", "hi").union(raw.select(*keys, F.lit(1).cast("long"), v, v))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def view_breaks(samples: DataFrame, pyramid: DataFrame, keys: list[str], thresholds: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """``start_us, end_us`` of each break of a line between two samples of a view, as ``gaps`` tells them.

    Blocks of the lowest level that are usable as a whole and have no step beyond the threshold, nor one from the sample before them, have no break and
    are passed over. A sample knows its block by its place in the series, so it meets one block even where many share its time.
    """
    limit = F.coalesce("threshold_us", F.lit(2**62))
    lowest = pyramid.filter(F.col("level") == 0)
    sizes = lowest.groupBy(*keys).agg(F.max("n").alias("__size"))
    blocks = lowest.filter((F.col("last_us") >= start_us) & (F.col("first_us") <= end_us)).join(small(thresholds), keys, "left")
    odd = ~F.col("all_usable") | ~F.coalesce("before_ok", F.lit(True)) | (F.coalesce("max_step_us", F.lit(0)) > limit) | (F.coalesce(F.col("first_us") - F.col("before_us"), F.lit(0)) > limit)
    blocks = written(blocks.filter(odd).select(*keys, "block", "before_us", "before_ok", limit.alias("__limit")))
    s = Ranged(samples.withColumn("ok", usable()), keys, ORDER).position("__p").done().filter(F.col("t_us").between(start_us, end_us))
    s = s.join(small(sizes), keys).withColumn("block", F.floor(F.col("__p") / F.col("__size"))).join(small(blocks), [*keys, "block"])
    before = F.lag(F.struct("t_us", "ok")).over(Window.partitionBy(*keys, "block").orderBy(*ORDER))
    first = F.when(F.col("before_us") >= start_us, F.struct(F.col("before_us").alias("t_us"), F.col("before_ok").alias("ok")))
    s = s.withColumn("__before", F.coalesce(before, first)).filter("__before is not null")
    broken = ~(F.col("ok") & F.col("__before.ok") & (F.col("t_us") - F.col("__before.t_us") <= F.col("__limit")))
    return s.filter(broken).select(*keys, F.col("__before.t_us").alias("start_us"), F.col("t_us").alias("end_us"))


def time_extent(samples: DataFrame, ids: list[str], shift_us: str | None = None) -> DataFrame:
    """``first_us, last_us`` of the signals asked for, by shifted time if a column of shifts is named; carried samples do not count."""
    s = samples.filter(F.col("signal_id").isin(ids))
    if "carried" in samples.columns:
        s = s.filter(~F.col("carried"))
    t = F.col("t_us") - F.col(shift_us) if shift_us else F.col("t_us")
    return s.agg(F.min(t).alias("first_us"), F.max(t).alias("last_us"))


def of_frames(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """All samples of the listed frames, with ``repeat``: the place of a sample among those that its signal has in the frame."""
    listed = frames.select("source_id", "ordinal").distinct()
    n = F.row_number().over(Window.partitionBy("source_id", "ordinal", "signal_id").orderBy("seq"))
    return samples.join(small(listed), ["source_id", "ordinal"], "left_semi").withColumn("repeat", n)


def variants(samples: DataFrame, keys: list[str], name: str = "name", unit: str = "unit") -> DataFrame:
    """Signals whose samples carry their own names or units: ``variants``, the first name and unit, and whether either changes."""
    pair = F.struct(F.col(name).alias("name"), F.col(unit).alias("unit"))
    g = samples.groupBy(*keys).agg(F.count_distinct(pair).alias("variants"), F.min_by(pair, F.struct(*ORDER)).alias("__first"))
    return g.select(*keys, "variants", F.col("__first.name").alias("name"), F.col("__first.unit").alias("unit"), (F.col("variants") > 1).alias("varies"))
