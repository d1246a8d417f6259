"""Value semantics of measured channels: conversions, labels, validity, arrays and bus records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.bits import byte_at
from ..operators.decode import small
from ..schemas import FD_LENGTHS


def linear(x: Column, a: Column | float, b: Column | float) -> Column:
    return a + b * x


def rational(x: Column, p: list) -> Column:
    """(p1 x² + p2 x + p3) / (p4 x² + p5 x + p6); null where the divisor is 0."""
    return F.try_divide(p[0] * x * x + p[1] * x + p[2], p[3] * x * x + p[4] * x + p[5])


def table_nearest(x: Column, points: Column) -> Column:
    """Output of the nearest of ``points array<struct<input, output>>``, the lower one on a tie."""
    below = F.array_max(F.filter(points, lambda p: p["input"] <= x))
    above = F.array_min(F.filter(points, lambda p: p["input"] >= x))
    lower = above.isNull() | (below.isNotNull() & (x - below["input"] <= above["input"] - x))
    return F.when(lower, below["output"]).otherwise(above["output"])


def table_interpolated(x: Column, points: Column) -> Column:
    """Linear interpolation between the points; held before the first and behind the last."""
    below = F.array_max(F.filter(points, lambda p: p["input"] <= x))
    above = F.array_min(F.filter(points, lambda p: p["input"] >= x))
    slope = F.try_divide(x - below["input"], above["input"] - below["input"])
    return F.when(below.isNull(), above["output"]).when(above.isNull() | (below["input"] == above["input"]), below["output"]).otherwise(below["output"] + slope * (above["output"] - below["output"]))


def range_value(x: Column, ranges: Column, is_float: Column | bool, default: Column | float | None) -> Column:
    """Value of the first of ``ranges array<struct<lo, hi, value>>`` that holds x, else the default.

    The upper bound belongs to a range of integers and not to one of floats.
    """
    real = F.lit(is_float) if isinstance(is_float, bool) else is_float
    fallback = default if isinstance(default, Column) else F.lit(default).cast("double")
    holding = F.filter(ranges, lambda r: (x >= r["lo"]) & F.when(real, x < r["hi"]).otherwise(x <= r["hi"]))
    return F.when(F.size(holding) > 0, F.get(holding, F.lit(0))["value"]).otherwise(fallback)


def value_labels(rows: DataFrame, labels: DataFrame, default: str | None, x: str = "raw", key: str | None = None) -> DataFrame:
    """``rows`` with ``label``: the first by ``place`` of ``labels(raw, place, label)`` for a raw number, else the default."""
    on = [key] if key else []
    first = labels.groupBy(*on, F.col("raw").alias(x)).agg(F.min_by("label", "place").alias("label"))
    return rows.join(small(first), [*on, x], "left").withColumn("label", F.coalesce("label", F.lit(default)))


def at_remote_master(rows: DataFrame, master: DataFrame, record: str = "record", time: str = "master_us") -> DataFrame:
    """Rows of a group without times of its own with the time of the master group's record they name; null for none."""
    return rows.join(master.select(record, time), record, "left")


def merge_streams(*streams: DataFrame, time: str = "t_us") -> DataFrame:
    """Streams in one table with ``stream`` (from 1) and ``place``, the order among rows of one time: by stream, then arrival.

    Each stream has ``ordinal`` and the time. Sorting by time and place merges them.
    """
    both = None
    for i, s in enumerate(streams, 1):
        s = s.withColumn("stream", F.lit(i))
        both = s if both is None else both.unionByName(s)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(time).orderBy("stream", "ordinal")))


def channel_ids(channels: DataFrame, prefix: str = "mdf", group: str = "group", name: str = "name", order: str = "ordinal") -> DataFrame:
    """``channels`` with ``signal_id``: prefix, group and name, percent-encoded; a repeated name gets its place behind it."""
    def coded(c: str) -> Column:
        return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))

    n = F.row_number().over(Window.partitionBy(group, name).orderBy(order))
    return channels.withColumn("signal_id", F.concat_ws(":", F.lit(prefix), coded(group), coded(name), F.when(n > 1, n)))


def validity(value: Column, flags: Column, bit: Column, all_invalid: Column) -> Column:
    """NaN where the value's invalidation bit is set or the record is invalid as a whole."""
    byte = byte_at(flags, F.floor(bit / 8))
    set_ = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.when(all_invalid | set_, F.lit(float("nan"))).otherwise(value)


def flatten_array(rows: DataFrame, name: str, array: str, shape: Sequence[int], row_major: bool = True, sizes: Sequence[Column | None] = (), size: Column | None = None) -> DataFrame:
    """One signal per element of a flat array with a ``shape`` of any depth, named ``Name[i][j]...``.

    ``sizes`` tells how many places of each dimension a record really has (null or left out: all), ``size`` how many elements in all; others are left out.
    """
    at = rows.select(*[c for c in rows.columns if c != array], F.posexplode(array).alias("__p", "value"))
    if size is not None:
        at = at.filter(F.col("__p") < size)
    steps = [1] * len(shape)
    order = range(len(shape) - 2, -1, -1) if row_major else range(1, len(shape))
    for d in order:
        steps[d] = steps[d + 1] * shape[d + 1] if row_major else steps[d - 1] * shape[d - 1]
    places = [F.floor(F.col("__p") / step) % n for n, step in zip(shape, steps)]
    for place, present in zip(places, sizes):
        if present is not None:
            at = at.filter(place < F.coalesce(present, F.lit(2**31 - 1)))
    text = F.concat(F.lit(name), *[x for place in places for x in (F.lit("["), place, F.lit("]"))])
    return at.withColumn("signal_id", text).drop("__p")


def flatten_nested(rows: DataFrame, name: str, array: str, sizes: Sequence[Column | None] = ()) -> DataFrame:
    """One signal per leaf of arrays in arrays, as deep as the column's type: a ``posexplode`` for each level.

    ``sizes`` as above, from the outermost level; inner arrays may have different lengths.
    """
    kept = [c for c in rows.columns if c != array]
    at, kind = rows.select(*kept, F.col(array).alias("value"), F.lit(name).alias("signal_id")), rows.schema[array].dataType
    level = 0
    while isinstance(kind, ArrayType):
        at = at.select(*kept, "signal_id", F.posexplode("value").alias("__p", "value"))
        if level < len(sizes) and sizes[level] is not None:
            at = at.filter(F.col("__p") < F.coalesce(sizes[level], F.lit(2**31 - 1)))
        at = at.withColumn("signal_id", F.concat("signal_id", F.lit("["), "__p", F.lit("]"))).drop("__p")
        kind, level = kind.elementType, level + 1
    return at


def normalise_record(rows: DataFrame) -> DataFrame:
    """Bus records as frames: extended from the flag or bit 31, DLC clamped, length by record, FD table or DLC, short payloads filled with zeros."""
    raw = F.col("id").cast("long")
    extended = F.col("ide") | (raw >= 0x80000000)
    can_id = F.when(raw >= 0x80000000, raw - 0x80000000).otherwise(raw)
    dlc = F.least(F.greatest("dlc", F.lit(0)), F.lit(15))
    length = F.coalesce("length", F.when(F.col("fd"), F.element_at(F.array(*map(F.lit, FD_LENGTHS)), dlc + 1)).otherwise(F.least(dlc, F.lit(8))))
    length = F.least(length, F.lit(64))
    good = can_id <= F.when(extended, 0x1FFFFFFF).otherwise(0x7FF)
    data = F.substring(F.concat("data", F.unhex(F.lit("00" * 64))), F.lit(1), length)
    return rows.filter(good).select(
        "ordinal", can_id.cast("int").alias("can_id"), extended.alias("extended"), F.coalesce("channel", F.lit(1)).alias("channel"), dlc.alias("dlc_code"), length.alias("data_length"), data.alias("data"),
    )


def frame_problem() -> Column:
    """Which rule a frame breaks, null if none."""
    top = F.when(F.col("extended"), 0x1FFFFFFF).otherwise(0x7FF)
    return (
        F.when(F.isnan("ts") | (F.abs("ts") == float("inf")), "TIME").when(~F.col("can_id").between(0, top), "ID").when(F.col("channel") < 0, "CHANNEL")
        .when(~F.col("dlc_code").between(0, 15), "DLC").when((F.col("data_length") != F.length("data")) | (F.col("data_length") > 64), "LENGTH")
    )
