"""Windows over a series that one task could not hold: the series is cut into ranges of time.

A window in time order needs only its neighbours: what a range takes from those before or after it is a row or a
sum, kept in a table with one row a range. So one hot signal is worked on by many tasks. Tables that are surely
small are not cut, and their plans have one window and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .decode import MAX_BROADCAST_BYTES, small

#: Rows of a series in a range, about; series with no more are one range.
RANGE_ROWS = 1_000_000
#: Tables that Spark estimates at no more bytes are not cut; of larger ones the rows of each series are counted.
RANGE_BYTES = 16 << 20
#: Ranges of one series, at most: the quantiles of its times that bound them.
MOST_RANGES = 1_000


def with_ranges(df: DataFrame, keys: Sequence[str], time: str, coarse: Sequence[str] | None = None) -> tuple[DataFrame, bool]:
    """(``df`` with the number ``__r`` of the range that a row's time falls in, whether any series was cut).

    Equal times share a range. The bounds are quantiles of the times of series with more than ``RANGE_ROWS`` rows,
    a small table; all other series are range 0.
    """
    counted = _long_series(df, keys, coarse)
    if counted is None:
        return df.withColumn("__r", F.lit(0)), False
    # Quantiles, windows and what ranges hand on all read the rows: whatever made them runs once more, not once for each.
    df = written(df)
    return df.join(small(_bounds(df, keys, time, counted)), list(keys), "left").withColumn("__r", range_of(F.col(time))).drop("__q"), True


def settled(df: DataFrame) -> DataFrame:
    """A table with a row for each series or range, for a join: worked out once and written, unless Spark knows that it is small."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= MAX_BROADCAST_BYTES // 8:
        return F.broadcast(df)
    return small(written(df))


def range_bounds(df: DataFrame, keys: Sequence[str], time: str, coarse: Sequence[str] | None = None) -> DataFrame | None:
    """``keys, __q``: the times that bound the ranges of each series that is cut; None where none is.

    Series are counted first, and quantiles taken of the long ones alone. ``coarse`` are some of the keys, of which the
    others are made at some cost: where no series of these is long, those are not made to be counted.
    """
    counted = _long_series(df, keys, coarse)
    return None if counted is None else _bounds(df, keys, time, counted)


def _long_series(df: DataFrame, keys: Sequence[str], coarse: Sequence[str] | None) -> DataFrame | None:
    """``keys, __n`` of the series that are cut; None where none is."""
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= RANGE_BYTES:
        return None

    def long_series(of: Sequence[str]) -> DataFrame:
        return df.groupBy(*of).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > RANGE_ROWS)

    # Counting is cheap; quantiles of each of very many short series would cost far more than the windows do.
    if coarse is not None and not long_series(coarse).limit(1).count():
        return None
    counted = written(long_series(keys))
    return counted if counted.limit(1).count() else None


def _bounds(df: DataFrame, keys: Sequence[str], time: str, counted: DataFrame) -> DataFrame:
    share = F.array(*(F.lit(i / MOST_RANGES) for i in range(1, MOST_RANGES)))
    per = df.select(*keys, F.col(time).alias("__time")).join(small(counted), list(keys)).groupBy(*keys).agg(F.first("__n").alias("__n"), F.percentile_approx("__time", share, 10 * MOST_RANGES).alias("__q"))
    wanted = F.ceil(F.col("__n") / RANGE_ROWS)
    every = F.greatest(F.floor(F.lit(MOST_RANGES) / wanted), F.lit(1))
    return written(per.select(*keys, F.array_distinct(F.filter("__q", lambda q, i: (i + 1) % every == 0)).alias("__q")))


def range_of(time: Column) -> Column:
    """Number of the range that a time falls in, by the bounds ``__q`` (null: one range)."""
    return F.when(F.col("__q").isNull(), 0).otherwise(F.size(F.filter("__q", lambda q: q < time)))


def with_halo(df: DataFrame, keys: Sequence[str], time: str, reach: int, coarse: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``__r`` and ``__own``: each row in its own range, and again (``__own`` false) in each later range whose rows look back to it.

    A range's rows see ``reach`` units of time back, so a window frame over (keys, range) holds all it needs.
    """
    bounds = range_bounds(df, keys, time, coarse)
    if bounds is None:
        return df.withColumns({"__r": F.lit(0), "__own": F.lit(True)})
    placed = df.join(small(bounds), list(keys), "left").withColumn("__at", range_of(F.col(time)))
    placed = placed.withColumn("__r", F.explode(F.sequence("__at", range_of(F.col(time) + reach))))
    return placed.withColumn("__own", F.col("__r") == F.col("__at")).drop("__q", "__at")


class Ranged:
    """A table with windows per series, cut into ranges where that is needed. ``done`` gives the table back."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("t_us", "ordinal"), coarse: Sequence[str] | None = None):
        self.constant = not keys
        if self.constant:
            df, keys = df.withColumn("__one", F.lit(1)), ["__one"]
        self.keys, self.order = list(keys), list(order)
        self.df, self.cut = with_ranges(df, self.keys, self.order[0], coarse)
        self.window = Window.partitionBy(*self.keys, "__r").orderBy(*self.order)

    def done(self, *drop: str) -> DataFrame:
        return self.df.drop("__r", *drop, *(["__one"] if self.constant else []))

    def _carried(self, ends: Column, carry: Column) -> None:
        """Adds ``__carry``: of a table with ``__end`` for each range, what ``carry`` makes of it for each range."""
        per = self.df.groupBy(*self.keys, "__r").agg(ends.alias("__end"))
        per = per.select(*self.keys, "__r", carry.alias("__carry"))
        self.df = self.df.join(settled(per), [*self.keys, "__r"])

    def _steps(self) -> tuple[Window, Column]:
        return Window.partitionBy(*self.keys).orderBy("__r"), F.struct(*self.order)

    def lag(self, **values: Column | str) -> Ranged:
        """Columns of the row before: ``lag(name=value)``; null for the first row of a series."""
        return self._beside(values, F.lag, F.max_by)

    def lead(self, **values: Column | str) -> Ranged:
        """Columns of the row after."""
        return self._beside(values, F.lead, F.min_by)

    def _beside(self, values: dict, shift, nearest) -> Ranged:
        row = F.struct(*((F.col(v) if isinstance(v, str) else v).alias(n) for n, v in values.items()))
        self.df = self.df.withColumn("__beside", shift(row).over(self.window))
        beside = F.col("__beside")
        if self.cut:
            over_ranges, place = self._steps()
            self._carried(nearest(row, place), shift("__end").over(over_ranges))
            beside = F.coalesce("__beside", "__carry")
        self.df = self.df.withColumns({n: beside[n] for n in values}).drop("__beside", "__carry")
        return self

    def running_sum(self, **values: Column) -> Ranged:
        """Sums up to and with each row; nulls count as 0."""
        for name, value in values.items():
            counted = F.coalesce(value, F.lit(0))
            total = F.sum(counted).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
            self.df = self.df.withColumn(name, total)
            if self.cut:
                over_ranges, _ = self._steps()
                self._carried(F.sum(counted), F.coalesce(F.sum("__end").over(over_ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                self.df = self.df.withColumn(name, F.col(name) + F.col("__carry")).drop("__carry")
        return self

    def running(self, **values: tuple) -> Ranged:
        """Running aggregates up to and with each row: ``running(name=(F.max, value))``; of sums, least and greatest values."""
        here = self.window.rowsBetween(Window.unboundedPreceding, 0)
        plain = {n: F.col(v) if isinstance(v, str) else v for n, (_, v) in values.items()}
        over = {n: f(plain[n]).over(here) for n, (f, _) in values.items()}
        if not self.cut:
            self.df = self.df.withColumns(over)
            return self
        steps = self._steps()[0].rowsBetween(Window.unboundedPreceding, -1)
        per = self.df.groupBy(*self.keys, "__r").agg(*(f(plain[n]).alias(f"__e_{n}") for n, (f, _) in values.items()))
        per = per.select(*self.keys, "__r", *(f(f"__e_{n}").over(steps).alias(f"__c_{n}") for n, (f, _) in values.items()))
        self.df = self.df.withColumns(over).join(settled(per), [*self.keys, "__r"])
        # Arrays of both also order structs, and pass over nulls.
        joined = {
            F.sum: lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
            F.max: lambda a, b: F.array_max(F.array(a, b)), F.min: lambda a, b: F.array_min(F.array(a, b)),
        }
        self.df = self.df.withColumns({n: joined[f](F.col(n), F.col(f"__c_{n}")) for n, (f, _) in values.items()})
        self.df = self.df.drop(*(f"__c_{n}" for n in values))
        return self

    def position(self, name: str) -> Ranged:
        """Place of each row in its series, from 0."""
        self.df = self.df.withColumn(name, (F.row_number().over(self.window) - 1).cast("long"))
        if self.cut:
            over_ranges, _ = self._steps()
            self._carried(F.count(F.lit(1)), F.coalesce(F.sum("__end").over(over_ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            self.df = self.df.withColumn(name, F.col(name) + F.col("__carry")).drop("__carry")
        return self

    def filter(self, condition: Column | str) -> Ranged:
        self.df = self.df.filter(condition)
        return self

    def with_columns(self, **values: Column) -> Ranged:
        self.df = self.df.withColumns(values)
        return self


def totals(df: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """``df`` with aggregates of its whole series beside each row: a grouped aggregation joined back, no window."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*(v.alias(n) for n, v in values.items()))))
    per = df.groupBy(*keys).agg(*(v.alias(n) for n, v in values.items()))
    return df.join(settled(per), list(keys))
