"""What graphs draw of each series: the part in view, a clip and the samples carried into it, thinned alone or together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .decode import small
from .ranges import Ranged
from .series import ORDER, thin_evenly, thin_with_breaks


def _with_bounds(samples: DataFrame, keys: list[str], bounds: DataFrame | None, low: str, high: str) -> DataFrame:
    if bounds is None:
        return samples.withColumns({low: F.lit(None).cast("long"), high: F.lit(None).cast("long")})
    on = [c for c in bounds.columns if c in keys]
    ends = bounds.select(*on, F.least("start_us", "end_us").alias(low), F.greatest("start_us", "end_us").alias(high))
    return samples.join(small(ends), on, "left")


def _beside(low: Column, high: Column, before: Column, after: Column, on_edge: bool) -> Column:
    """Whether a row is the last before a range or the first after it; with ``on_edge`` false, only if no row lies on that edge."""
    t = F.col("t_us")
    reaches = (after >= low, before <= high) if on_edge else (after > low, before < high)
    return F.coalesce((t < low) & (after.isNull() | reaches[0]) | (t > high) & (before.isNull() | reaches[1]), F.lit(False))


def drawn(samples: DataFrame, keys: list[str], views: DataFrame | None = None, clips: DataFrame | None = None) -> DataFrame:
    """The samples that a graph draws, with ``inside`` (counts as in view) and ``carried`` (from outside the clip).

    ``views`` and ``clips`` hold one time range ``start_us, end_us`` for some of ``keys``, such as a target; series without
    one are not bounded. A clip takes the nearest sample outside each edge along, unless one lies on that edge. A
    view takes one drawn sample more on each side. A target with both shows what they share, and nothing if they share
    nothing. One window pass over the series answers both. Empty tables give empty tables; rows without a time
    are drawn in no view and no clip.
    """
    s = _with_bounds(_with_bounds(samples, keys, clips, "__c0", "__c1"), keys, views, "__w0", "__w1")
    s = Ranged(s, keys, ORDER).lag(__before="t_us").lead(__after="t_us").done()
    # greatest and least pass over nulls: a view alone, a clip alone, or what both share.
    s = s.withColumns({"__v0": F.greatest("__c0", "__w0"), "__v1": F.least("__c1", "__w1")})
    t, before, after = F.col("t_us"), F.col("__before"), F.col("__after")
    carried = _beside(F.col("__c0"), F.col("__c1"), before, after, False)
    in_clip = F.when(F.col("__c0").isNull(), True).otherwise(t.between(F.col("__c0"), F.col("__c1")))
    inside = F.when(F.col("__v0").isNull(), True).otherwise(t.between(F.col("__v0"), F.col("__v1")))
    near = _beside(F.col("__v0"), F.col("__v1"), before, after, True)
    shares = F.col("__v0").isNull() | (F.col("__v0") <= F.col("__v1"))
    s = s.withColumns({"carried": carried, "inside": inside})
    return s.filter((in_clip | carried) & (inside | near) & shares).select(*samples.columns, "inside", "carried")


def thinned_for_graph(samples: DataFrame, keys: list[str], limit: int | str, pairs: int | None = None) -> DataFrame:
    """Each series thinned to ``limit`` with its peaks and the samples at both ends of each break of its line.

    Breaks are told by the series' ``cadence``, of all neighbours or of ``pairs``.
    """
    return thin_with_breaks(samples, keys, limit, pairs)


def thinned_together(samples: DataFrame, target: list[str], series: str, limit: int, counts: DataFrame | None = None, pairs: int | None = None) -> DataFrame:
    """Axes of one trajectory thinned together: a time kept for one series is kept for all series of its target.

    Each series of a target first gets an equal part of ``limit``; then all samples at the kept times stay, at even
    places down to ``limit`` where equal times make them more. ``counts`` (target columns, ``series_count``) tells how many series
    share the limit; it is counted from ``samples`` where not given.
    """
    keys = [*target, series]
    if counts is None:
        counts = samples.select(*keys).distinct().groupBy(*target).agg(F.count(F.lit(1)).alias("series_count"))
    part = F.floor(F.lit(limit) / F.greatest(F.lit(1), F.coalesce("series_count", F.lit(1)))).alias("__part")
    s = samples.join(small(counts.select(*target, part)), target, "left")
    kept = thinned_for_graph(s, keys, "__part", pairs).select(*target, "t_us").distinct()
    shared = samples.join(kept, [*target, "t_us"], "left_semi")
    return thin_evenly(shared, keys, limit).select(*samples.columns)


def compared_series(
    samples: DataFrame, ids: list[str], target: str = "source_id", total: int = 100_000,
    views: DataFrame | None = None, clips: DataFrame | None = None, joined: bool = False, points: int | None = None,
    pairs: int | None = None,
) -> DataFrame:
    """Series per target of the signals asked for, known by their ids, within a budget of points for all of them.

    ``views`` and ``clips`` (``target, start_us, end_us``) are the part of its own time that each target shows and the clip it is
    bound to; thinning covers that part only. ``joined`` thins the signals of a target together, ``points`` sets the budget of
    each series instead of its share of ``total``, ``pairs`` is that of ``thinned_for_graph``. The result has ``inside`` and ``carried`` as ``drawn`` gives them.
    """
    from .charts import point_budget

    keys = [target, "signal_id"]
    wanted = samples.filter(F.col("signal_id").isin(ids))
    counts = written(wanted.select(*keys).distinct().groupBy(target).agg(F.count(F.lit(1)).alias("series_count")))
    limit = points if points is not None else point_budget(counts.count(), len(ids), total)
    shown = written(drawn(wanted, keys, views, clips))
    return thinned_together(shown, [target], "signal_id", limit, counts, pairs) if joined else thinned_for_graph(shown, keys, limit, pairs)


def clip_path(points: DataFrame, start_us: int | None, end_us: int | None) -> DataFrame:
    """A clip's path ends at the clip's edges.

    The point outside each edge (``carried``) gives way to the point where the line from it to the first or last point inside crosses
    the edge, carried too as it was not measured. Without an edge (null) or a point inside there is none.
    """
    axes = [c for c in "xyz" if c in points.columns]
    inside, t = ~F.col("carried"), F.col("t_us")
    at = F.struct("t_us", *(["k"] if "k" in points.columns else []), *axes)
    out = points.filter(inside).select("t_us", *axes, "carried")
    sides = [(start_us, F.min(F.when(inside, at)), F.max(F.when(~inside & (t <= start_us), at)))] if start_us is not None else []
    sides += [(end_us, F.max(F.when(inside, at)), F.min(F.when(~inside & (t >= end_us), at)))] if end_us is not None else []
    if not sides:
        return out
    ends = points.agg(F.array(*(F.struct(F.lit(e).cast("long").alias("edge"), near.alias("near"), far.alias("far")) for e, near, far in sides)).alias("ends"))
    ends = ends.select(F.inline("ends")).filter("near is not null and far is not null and near.t_us <> far.t_us and edge between least(near.t_us, far.t_us) and greatest(near.t_us, far.t_us)")
    share = (F.col("edge") - F.col("far.t_us")) / (F.col("near.t_us") - F.col("far.t_us"))
    mixed = [(F.col(f"far.{c}") + (F.col(f"near.{c}") - F.col(f"far.{c}")) * share).alias(c) for c in axes]
    return out.union(ends.select(F.col("edge").alias("t_us"), *mixed, F.lit(True).alias("carried")))
