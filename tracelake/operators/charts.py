"""Analytics behind charts, trajectories and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .asof import neighbours
from .decode import small
from .ranges import Ranged, totals
from .series import ORDER, thin, usable


def normalise(samples: DataFrame, keys: list[str]) -> DataFrame:
    """``share``: 0 to 100 between the usable extremes of a series, 50 where these are equal, null if not finite."""
    v = F.when(usable(), F.col("value"))
    s = totals(samples, keys, __lo=F.min(v), __hi=F.max(v))
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    share = F.when(~finite, None).when(F.col("__lo") == F.col("__hi"), 50.0).otherwise((F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * 100)
    return s.withColumn("share", share).drop("__lo", "__hi")


def value_range(samples: DataFrame, keys: list[str], start_us: int, end_us: int, include_zero: bool = False, mode: str = "visible", manual: tuple[float, float] | None = None, scale: float = 1.0, shift: float = 0.0, shift_us: str | None = None) -> DataFrame:
    """``lo, hi`` of an axis: the visible usable samples' range, else that of all, else 0 to 1.

    ``mode`` may also be ``global`` (all usable samples) or ``manual`` (the given range). Values are shown as
    ``value * scale + shift``. With ``shift_us``, a column of each target's shift, a sample counts as visible by its
    shifted time.
    """
    if mode == "manual" and manual is not None:
        return samples.select(*keys).distinct().withColumns({"lo": F.lit(float(min(manual))), "hi": F.lit(float(max(manual)))})
    v = F.when(usable(), F.col("value") * scale + shift)
    t = F.col("t_us") - F.col(shift_us) if shift_us else F.col("t_us")
    seen = v if mode == "global" else F.when(t.between(start_us, end_us), v)
    g = samples.groupBy(*keys).agg(F.min(seen).alias("a"), F.max(seen).alias("b"), F.min(v).alias("c"), F.max(v).alias("d"))
    lo, hi = F.coalesce("a", "c", F.lit(0.0)), F.coalesce("b", "d", F.lit(1.0))
    if include_zero:
        lo, hi = F.least(lo, F.lit(0.0)), F.greatest(hi, F.lit(0.0))
    return g.select(*keys, lo.alias("lo"), hi.alias("hi"))


def lane_extremes(samples: DataFrame, keys: list[str], threshold_us: Column, start_us: int, end_us: int) -> DataFrame:
    """``lo, hi, flat`` of each lane in a view: its drawn samples inside, and where its line crosses either edge.

    A line is drawn inside a run only; a lane with nothing in view has no row. ``flat`` means that the extremes
    differ by no more than rounding.
    """
    r = Ranged(drawable_runs(samples, keys, threshold_us), keys, ORDER).lead(t_next="t_us", v_next="value", run_next="run").done()
    shown = [F.when(F.col("t_us").between(start_us, end_us), F.col("value"))]
    for edge in (start_us, end_us):
        part = (F.lit(edge) - F.col("t_us")) / (F.col("t_next") - F.col("t_us"))
        crosses_edge = (F.col("run_next") == F.col("run")) & (F.col("t_us") < edge) & (F.col("t_next") > edge)
        shown.append(F.when(crosses_edge, F.col("value") + (F.col("v_next") - F.col("value")) * part))
    g = r.groupBy(*keys).agg(F.min(F.least(*shown)).alias("lo"), F.max(F.greatest(*shown)).alias("hi")).filter("lo is not null")
    return g.withColumn("flat", ~(F.col("hi") - F.col("lo") > F.greatest(F.abs("lo"), F.abs("hi")) * 1e-12))


def line_value(probes: DataFrame, samples: DataFrame, gaps: DataFrame, keys: list[str], connect: bool = False) -> DataFrame:
    """Value of the drawn line: an exact usable sample, else between usable neighbours unless a gap or invalid sample lies there."""
    s = samples.withColumn("ok", usable())
    near = neighbours(probes, s.select(*keys, "t_us", "ordinal", "value", "ok"), keys, "t_us", ["ordinal"])
    near = near.withColumnsRenamed({"before": "any_before", "after": "any_after"})
    good = neighbours(near, s.filter("ok").select(*keys, "t_us", "ordinal", "value"), keys, "t_us", ["ordinal"])
    b, a = F.col("before"), F.col("after")
    skipped = (F.col("any_before.t_us") > b["t_us"]) | (F.col("any_after.t_us") < a["t_us"])
    part = (F.col("t_us") - b["t_us"]) / (a["t_us"] - b["t_us"])
    out = good.withColumn("exact", b["t_us"] == F.col("t_us")).withColumn("value", F.when(b["t_us"] == F.col("t_us"), b["value"]).otherwise(b["value"] + (a["value"] - b["value"]) * part))
    out = out.select(*probes.columns, "exact", "value", b["t_us"].alias("left_us"), a["t_us"].alias("right_us"), F.coalesce(skipped, F.lit(False)).alias("skipped"))
    if connect:
        return out
    crossing = crosses(out.filter("not exact"), gaps, keys).filter("crosses").select(*keys, "t_us").distinct()
    out = out.join(crossing.withColumn("cut", F.lit(True)), [*keys, "t_us"], "left")
    hidden = ~F.col("exact") & (F.col("skipped") | F.coalesce("cut", F.lit(False)))
    return out.withColumn("value", F.when(~hidden, F.col("value"))).drop("cut")


def crosses(segments: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """``crosses``: whether a gap overlaps the open span from ``left_us`` to ``right_us``."""
    # Gaps of a series are apart and in order, so only the last that begins before a segment's end can reach into it.
    g = gaps.select(*keys, (F.col("start_us") + 1).alias("t_us"), "start_us", "end_us")
    ends = segments.select(*keys, F.col("left_us"), F.col("right_us").alias("t_us")).distinct()
    near = neighbours(ends, g, keys, "t_us", ["start_us"])
    hit = near.select(*keys, "left_us", F.col("t_us").alias("right_us"), F.coalesce(F.col("before.end_us") > F.col("left_us"), F.lit(False)).alias("crosses"))
    return segments.join(hit, [*keys, "left_us", "right_us"])


def drawable_runs(samples: DataFrame, keys: list[str], threshold_us: Column, shift_us: int = 0) -> DataFrame:
    """Usable samples with the number of the unbroken run they belong to, on a shifted time axis."""
    r = Ranged(samples.withColumn("ok", usable()), keys, ORDER).lag(__ok="ok", __t="t_us")
    broken = (~F.col("__ok")) | (F.col("t_us") - F.col("__t") > threshold_us)
    s = r.running_sum(run=F.when(F.col("ok") & F.coalesce(broken, F.lit(True)), 1).otherwise(0)).done("__ok", "__t")
    return s.filter("ok").withColumn("t_us", F.col("t_us") - shift_us).drop("ok")


def trajectory(x: DataFrame, y: DataFrame, z: DataFrame | None = None, invert: tuple[bool, bool, bool] = (False, False, False)) -> DataFrame:
    """Points of shared times, k-th sample with k-th; pairs with an unusable sample are dropped.

    Where the axes tell which samples are ``carried`` into a clip, a point is carried if any of its samples is.
    """
    out = None
    for name, s, flip in zip("xyz", (x, y, z), invert):
        if s is None:
            continue
        k = F.row_number().over(Window.partitionBy("t_us").orderBy("ordinal"))
        carried = [F.col("carried").alias(f"from_{name}")] if "carried" in s.columns else []
        s = s.select("t_us", k.alias("k"), (-F.col("value") if flip else F.col("value")).alias(name), usable().alias(f"ok_{name}"), *carried)
        out = s if out is None else out.join(s, ["t_us", "k"])
    good = " and ".join(c for c in out.columns if c.startswith("ok_"))
    flags = [c for c in out.columns if c.startswith("from_")]
    if flags:
        out = out.withColumn("carried", F.expr(" or ".join(flags)))
    return out.filter(good).drop(*flags, *[c for c in out.columns if c.startswith("ok_")])


def thin_points(points: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` points of a path that keep the extremes of every axis; a shorter path is kept whole.

    Runs keep their first and last point and the lowest and highest one of each axis, the earlier on a tie; a path
    without z is cut as if it had a constant one.
    """
    axes = [c for c in ("x", "y", "z") if c in points.columns]
    # The joins that make a path run once, not for each count of it.
    one = written(points).withColumn("__path", F.lit(0))
    return thin(one, ["__path"], limit, measures=axes, order=("t_us", "k"), per_run=10).drop("__path")


def recent(points: DataFrame, at_us: int, span_us: int) -> DataFrame:
    """The trail of a path: its points of the last ``span_us`` up to a time."""
    return points.filter(F.col("t_us").between(at_us - span_us, at_us))


def extent(points: DataFrame) -> DataFrame:
    """Box, centre and largest side of a path."""
    axes = [c for c in ("x", "y", "z") if c in points.columns]
    ends = [f(c).alias(f"{c}{i}") for c in axes for i, f in ((0, F.min), (1, F.max))]
    g = points.agg(*ends)
    sides = [F.col(f"{c}1") - F.col(f"{c}0") for c in axes]
    return g.withColumns({f"c{c}": (F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in axes} | {"span": F.greatest(*sides) if len(sides) > 1 else sides[0]})


def point_budget(targets: int, signals: int, total: int = 100_000, least: int = 2, most: int = 4_000) -> int:
    """Points that each series of a comparison may have."""
    return max(least, min(most, total // max(1, targets * signals)))


def unique_targets(targets: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """The first of targets that name the same thing."""
    w = Window.partitionBy(*keys).orderBy(order)
    return targets.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def overlaid(rows: DataFrame, keys: list[str], offset_us: int = 0) -> DataFrame:
    """``at_us``: time from each target's own start and its offset, so that targets lie over each other."""
    return totals(rows, keys, __start=F.min("t_us")).withColumn("at_us", F.col("t_us") - (F.col("__start") + offset_us)).drop("__start")


def signal_owners(samples: DataFrame, signal: str, target: str) -> DataFrame:
    """``signal, owners, common, name_missing``: which targets have a signal, whether all do, and whether those without it are fewer."""
    n = samples.select(target).distinct().agg(F.count(F.lit(1)).alias("__n"))
    o = samples.groupBy(signal).agg(F.array_sort(F.collect_set(target)).alias("owners")).crossJoin(F.broadcast(n))
    return o.select(signal, "owners", (F.size("owners") == F.col("__n")).alias("common"), (F.col("__n") - F.size("owners") < F.size("owners")).alias("name_missing"))


def path_measure(points: DataFrame, first_us: int, second_us: int) -> DataFrame:
    """Differences, straight distance, path length and mean speed between two points of a path."""
    lo, hi = min(first_us, second_us), max(first_us, second_us)
    axes = [c for c in ("x", "y", "z") if c in points.columns]
    p = Ranged(points.filter(F.col("t_us").between(lo, hi)), [], ("t_us", "k")).lag(**{f"__{c}": c for c in axes}).done()
    square = sum(((F.col(c) - F.col(f"__{c}")) ** 2 for c in axes), F.lit(0.0))
    p = p.withColumn("piece", F.sqrt(square))
    first, second = (F.when(F.col("t_us") == t, F.struct(*axes)) for t in (first_us, second_us))
    g = p.agg(F.min(first).alias("a"), F.min(second).alias("b"), F.sum("piece").alias("path"))
    delta = [(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"d{c}") for c in axes]
    straight = F.sqrt(sum(((F.col(f"b.{c}") - F.col(f"a.{c}")) ** 2 for c in axes), F.lit(0.0)))
    return g.select(*delta, straight.alias("straight"), "path", (F.col("path") / ((hi - lo) / 1e6)).alias("speed"))


def edge_points(points: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Points inside a clip, and where the line crosses each of its edges; nothing for a clip without a point inside."""
    from .views import clip_path, drawn

    clip = points.sparkSession.range(1).select(F.lit(0).alias("__path"), F.lit(start_us).cast("long").alias("start_us"), F.lit(end_us).cast("long").alias("end_us"))
    path = points.withColumns({"__path": F.lit(0), "ordinal": F.col("k")})
    return clip_path(drawn(path, ["__path"], clips=clip), start_us, end_us)


def snap(anchors: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """``snapped``: the nearest frame time, frames mirrored beyond the first and last."""
    ends = times.groupBy(*keys).agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    a = anchors.join(small(ends), keys).withColumn("t_us", F.when(F.col("anchor") < F.col("lo"), 2 * F.col("lo") - F.col("anchor")).when(F.col("anchor") > F.col("hi"), 2 * F.col("hi") - F.col("anchor")).otherwise(F.col("anchor")))
    n = neighbours(a, times.select(*keys, "t_us", F.lit(0).alias("ordinal")).distinct(), keys)
    b, f = F.col("before.t_us"), F.col("after.t_us")
    near = F.when(f.isNull() | (F.col("t_us") - b <= f - F.col("t_us")), b).otherwise(f)
    back = F.when(F.col("anchor") < F.col("lo"), 2 * F.col("lo") - near).when(F.col("anchor") > F.col("hi"), 2 * F.col("hi") - near).otherwise(near)
    return n.select(*keys, "anchor", back.alias("snapped"))


def steps_from(times: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``stepped``: the frame time ``n`` distinct times on (negative: back), mirrored beyond either end."""
    distinct = times.select(*keys, "t_us").distinct()
    d = totals(Ranged(distinct, keys, ("t_us",)).position("i").done(), keys, count=F.count(F.lit(1)))
    to = F.col("i") + n
    last = F.col("count") - 1
    d = d.withColumn("side", F.when(to < 0, -1).when(to > last, 1).otherwise(0)).withColumn("j", F.when(to < 0, -to).when(to > last, 2 * last - to).otherwise(to))
    ends = d.groupBy(*keys).agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    target = d.select(*keys, F.col("i").alias("j"), F.col("t_us").alias("to_us"))
    out = d.join(target, [*keys, "j"]).join(ends, keys)
    stepped = F.when(F.col("side") < 0, 2 * F.col("lo") - F.col("to_us")).when(F.col("side") > 0, 2 * F.col("hi") - F.col("to_us")).otherwise(F.col("to_us"))
    return out.select(*keys, "t_us", stepped.alias("stepped"))


def in_clips(samples: DataFrame, clips: DataFrame) -> DataFrame:
    """Samples of each clip's log inside its range, edges included."""
    c = small(clips.select(F.col("source_id").alias("__source"), "clip_id", "start_us", "end_us"))
    return samples.join(c, [F.col("source_id") == F.col("__source"), F.col("t_us").between(F.col("start_us"), F.col("end_us"))]).drop("__source")
