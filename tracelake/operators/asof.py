"""As-of joins: for each probe time the nearest sample before, after or either side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import settled, with_ranges


def neighbours(probes: DataFrame, series: DataFrame, keys: list[str], time: str = "t_us", order: list[str] | None = None) -> DataFrame:
    """``probes`` with ``before`` and ``after``: structs of the last series row at or before its time and the first at or after.

    Both sides are put in one time order per key, in ranges of time where a key is large, and read with two windows. A probe with
    no row on a side gets null there. Where rows share a time the last of them is before, the first after.
    """
    order = order or []
    fields = [c for c in series.columns if c not in keys]
    extra = [c for c in probes.columns if c not in (*keys, time)]
    s = series.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*fields).alias("__row"), F.lit(None).cast(_struct(probes, extra)).alias("__probe"))
    p = probes.select(*keys, F.col(time).alias("__t"), F.lit(2).alias("__side"), F.lit(None).cast(s.schema["__row"].dataType).alias("__row"), (F.struct(*extra) if extra else F.struct(F.lit(1).alias("x"))).alias("__probe"))
    both, cut = with_ranges(s.unionByName(p), keys, "__t")
    ties = [F.col(f"__row.{c}") for c in order]
    back = Window.partitionBy(*keys, "__r").orderBy("__t", "__side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "__r").orderBy(F.desc("__t"), "__side", *[t.desc() for t in ties]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("before", F.last("__row", True).over(back)).withColumn("after", F.last("__row", True).over(ahead))
    if cut:
        # What a range takes from those before and after it: their last and first rows of the series.
        row = F.when(F.col("__side") == 1, F.struct("__t", *[t.alias(f"tie{i}") for i, t in enumerate(ties)], "__row"))
        ends = both.groupBy(*keys, "__r").agg(F.max(row).alias("__last"), F.min(row).alias("__first"))
        up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("__r"), F.desc("__r")))
        ends = ends.select(*keys, "__r", F.last("__last", True).over(up)["__row"].alias("__earlier"), F.last("__first", True).over(down)["__row"].alias("__later"))
        found = found.join(settled(ends), [*keys, "__r"]).withColumn("before", F.coalesce("before", "__earlier")).withColumn("after", F.coalesce("after", "__later"))
    both = found
    out = both.filter("__side = 2")
    return out.select(*keys, F.col("__t").alias(time), *[F.col(f"__probe.{c}").alias(c) for c in extra], "before", "after")


def _struct(df: DataFrame, names: list[str]):
    from pyspark.sql import types as T

    return T.StructType([df.schema[c] for c in names] or [T.StructField("x", T.IntegerType())])


def nearest(probes: DataFrame, series: DataFrame, keys: list[str], time: str = "t_us", order: list[str] | None = None) -> DataFrame:
    """As above with ``nearest``: the closer row, the earlier one on a tie."""
    n = neighbours(probes, series, keys, time, order)
    b, a, t = F.col("before"), F.col("after"), F.col(time)
    earlier = a.isNull() | (b.isNotNull() & ((t - b[time]) <= (a[time] - t)))
    return n.withColumn("nearest", F.when(earlier, b).otherwise(a))
