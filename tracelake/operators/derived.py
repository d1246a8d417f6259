"""Derived signals: lookup tables, filters and calculations across signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, written
from .asof import neighbours
from .decode import small
from .ranges import Ranged, totals, with_halo


def lookup(rows: DataFrame, points: DataFrame, table_col: str, x: str, outside: str = "clamp") -> DataFrame:
    """``y`` by linear interpolation between the sorted points of a table; beyond them held or null.

    Segments are made once; a row meets the one segment that holds it in an equi-join on the table with a
    range condition. Needs two points at least.
    """
    w = Window.partitionBy(table_col).orderBy("input")
    seg = points.select(table_col, F.col("input").alias("x0"), F.col("output").alias("y0"), F.lead("input").over(w).alias("x1"), F.lead("output").over(w).alias("y1"), F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(table_col)).alias("n"))
    seg = seg.filter("x1 is not null")
    v = F.col(x)
    inside = (v >= F.col("x0")) & ((v < F.col("x1")) | ((v == F.col("x1")) & (F.col("i") == F.col("n") - 1)))
    if outside == "clamp":
        inside = inside | ((F.col("i") == 1) & (v < F.col("x0"))) | ((F.col("i") == F.col("n") - 1) & (v > F.col("x1")))
    held = F.least(F.greatest(v, F.col("x0")), F.col("x1"))
    y = F.col("y0") + (held - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    found = rows.alias("r").join(small(seg).alias("s"), (F.col(f"r.{table_col}") == F.col(f"s.{table_col}")) & inside, "left")
    return found.select("r.*", y.alias("y"), *[F.col(c).alias(f"bracket_{c}") for c in ("x0", "y0", "x1", "y1")])


def epochs(rows: DataFrame, keys: list[str], time: str = "ts", order: str = "ordinal") -> DataFrame:
    """``epoch``: counts how often time did not advance, in order of arrival; filters start anew there."""
    r = Ranged(rows, keys, (order,)).lag(__before=time)
    return r.running_sum(epoch=F.when(F.col(time) <= F.col("__before"), 1).otherwise(0)).done("__before")


def moving_average(rows: DataFrame, keys: list[str], seconds: float, value: str = "value", time_us: str = "t_us") -> DataFrame:
    """Mean, count and sum of the values at most ``seconds`` old, by a range frame.

    An epoch with very many rows is cut into ranges of time; each gets the last ``seconds`` before it as well.
    """
    reach = round(seconds * 1e6)
    r = with_halo(rows, [*keys, "epoch"], time_us, reach, keys)
    w = Window.partitionBy(*keys, "epoch", "__r").orderBy(time_us).rangeBetween(-reach, 0)
    r = r.withColumns({"y": F.avg(value).over(w), "count": F.count(value).over(w), "sum": F.sum(value).over(w)})
    return r.filter("__own").drop("__r", "__own")


def with_evidence(filtered: DataFrame, keys: list[str], time_us: str = "t_us") -> DataFrame:
    """What a filter started from: ``previous`` output and ``delta_us`` since; null for the first of an epoch."""
    r = Ranged(filtered, [*keys, "epoch"], (time_us, "ordinal"), keys).lag(previous="y", __before=time_us).done()
    return r.withColumn("delta_us", F.col(time_us) - F.col("__before")).drop("__before")


def low_pass(rows: DataFrame, keys: list[str], tau: float, value: str = "value", time: str = "ts") -> DataFrame:
    """First-order low pass with a varying step, as windows instead of a loop over samples.

    y(k) = a y(k-1) + (1 - a) x(k) with a = exp(-step / tau) is solved inside blocks of 20 tau by a
    weighted running sum; the value a block starts with is carried over from three blocks before, beyond
    which weights vanish below double precision. Steps, sums and carries run over ranges of time where an epoch, a
    block or the table of blocks has very many rows: a range composes to one sum, and a small table carries sums over.
    """
    scope = [*keys, "epoch"]
    r = Ranged(rows, scope, (time, "ordinal"), keys).lag(__before=time).done()
    r = totals(r.withColumn("__step", F.col(time) - F.col("__before")), scope, __t0=F.min(time))
    r = r.withColumn("__block", F.floor((F.col(time) - F.col("__t0")) / (20 * tau)))
    b = F.when(F.col("__step").isNull(), F.col(value)).otherwise((1 - F.exp(-F.col("__step") / tau)) * F.col(value))
    r = r.withColumn("__tb", F.col("__t0") + F.col("__block") * 20 * tau)
    r = r.withColumn("__u", b * F.exp((F.col(time) - F.col("__tb")) / tau))
    r = Ranged(r, [*scope, "__block"], (time, "ordinal"), keys).running_sum(__s=F.col("__u")).done()
    ends = r.groupBy(*scope, "__block").agg(F.sum("__u").alias("__sum"), F.first("__tb").alias("__tb_end"))
    ends = Ranged(ends, scope, ("__block",), keys)
    carry, last = F.lit(0.0), ("__sum", "__tb_end")
    for i in (1, 2, 3):
        ends.lag(**{f"__sum{i}": last[0], f"__tb{i}": last[1]})
        last = f"__sum{i}", f"__tb{i}"
        carry = carry + F.coalesce(F.col(last[0]) * F.exp((F.col(last[1]) - F.col("__tb_end")) / tau), F.lit(0.0))
    carried = ends.done().select(*scope, "__block", carry.alias("__brought"))
    r = r.join(carried, [*scope, "__block"])
    y = F.exp(-(F.col(time) - F.col("__tb")) / tau) * (F.col("__brought") + F.col("__s"))
    r = Ranged(r.withColumn("y", y), scope, (time, "ordinal"), keys).lag(previous="y").done()
    return r.withColumnRenamed("__step", "delta_s").drop("__before", "__t0", "__block", "__tb", "__u", "__s", "__brought")


def sample_at(probes: DataFrame, series: DataFrame, keys: list[str], linear: bool = True) -> DataFrame:
    """``at``: value of a series at each probe time: exact, else linear between usable neighbours, never beyond."""
    n = neighbours(probes, series, keys, "t_us", ["ordinal"])
    b, a = F.col("before"), F.col("after")
    part = (F.col("t_us") - b["t_us"]) / (a["t_us"] - b["t_us"])
    between = F.when(b["ok"] & a["ok"] & (b["t_us"] < a["t_us"]), b["value"] + (a["value"] - b["value"]) * part)
    exact = F.when(b["ok"], b["value"])
    return n.withColumn("at", F.when(b["t_us"] == F.col("t_us"), exact).otherwise(between if linear else F.lit(None).cast("double"))).drop("before", "after")


def lineage(edges: DataFrame, roots: DataFrame, spark: SparkSession) -> DataFrame:
    """Level of each node: 0 for roots, else one more than its deepest input.

    Nodes that lie on a cycle, or behind one, and nodes with an input that nobody defines have no level (null);
    ``missing`` lists those inputs. Each round settles the nodes whose inputs all have a level, and ends when a round
    settles none; the number of rounds is the depth, without a limit.
    """
    links = written(edges.select("node", "input").distinct())
    named = links.select("node").union(roots.select("node")).distinct()
    absent = links.join(named.select(F.col("node").alias("input")), "input", "left_anti").groupBy("node").agg(F.array_sort(F.collect_set("input")).alias("missing"))
    level = written(roots.select("node").distinct().withColumn("level", F.lit(0)))
    waiting = written(links.join(roots.select("node").distinct(), "node", "left_anti"))
    depth = 0
    while True:
        depth += 1
        # Inputs settled in any earlier round; a node waits while it has another.
        done = level.select(F.col("node").alias("input"), F.lit(1).alias("settled"))
        open_ = waiting.join(done, "input", "left").groupBy("node").agg(F.count("input").alias("n"), F.count("settled").alias("settled"))
        fresh = written(open_.filter("n = settled").select("node", F.lit(depth).alias("level")))
        if not fresh.limit(1).count():
            discard(fresh)
            break
        level = level.union(fresh)
        waiting = waiting.join(fresh.select("node"), "node", "left_anti")
        if depth % 20 == 0:
            level, waiting = written(level), written(waiting)
    nodes = named.union(edges.select(F.col("input").alias("node"))).distinct()
    return nodes.join(level, "node", "left").join(absent, "node", "left").select("node", "level", "missing")
