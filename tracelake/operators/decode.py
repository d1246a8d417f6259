"""Decoding of frames into samples by a table of signal layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bits, scale
from ..functions.once import with_computed
from ..functions.text import significant
from ..schemas import SAFE_INTEGER

#: Tables up to this many rows and bytes are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_LAYOUTS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, max_rows: int = MAX_BROADCAST_LAYOUTS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint, given only where the table is known or seen to be small.

    Spark's own estimate of the plan, an upper bound for local tables and plain scans, settles it without a
    job; else rows are counted up to the limit, which is lower for wide rows.
    """
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= max_bytes // 8:
        return F.broadcast(df)
    width = sum(64 if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)) else 8 for f in df.schema)
    most = max(1, min(max_rows, max_bytes // width))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Dimensions up to this many rows are worked out once on the driver and enter later plans as rows, not as their own plan.
MAX_LOCAL_ROWS = 20_000


def localised(dim: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> tuple[DataFrame, list | None]:
    """(a small dimension as a local table, its rows); a larger one as it is, with no rows."""
    rows = dim.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return dim, None
    return dim.sparkSession.createDataFrame(rows, dim.schema), rows


#: Tables that Spark estimates at no more bytes are dealt over all cores before long expressions.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame, key: str = "ordinal") -> DataFrame:
    """A small table on all cores: one small file would be one task, however long its expressions. Larger ones have tasks enough and stay as they are."""
    if df.isStreaming or df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def effective_layouts(layouts: DataFrame) -> DataFrame:
    """Where definitions share a CAN key the last by ``def_id`` wins; scale and offset texts become fractions."""
    last = layouts.withColumn("__last", F.max("def_id").over(Window.partitionBy("can_id", "extended")))
    return _with_fractions(last.filter("def_id = __last").drop("__last"))


def _with_fractions(layouts: DataFrame) -> DataFrame:
    num, den = scale.scale_parts(F.col("scale"))
    o_num, o_den = scale.scale_parts(F.when(F.col("offset").rlike(r"^[+-]?0*\.?0*$"), "1").otherwise(F.col("offset")))
    zero = F.col("offset").rlike(r"^[+-]?0*\.?0*$")
    return layouts.withColumn("shift_bits", scale.power_of_two(num, den)).withColumns({
        "num": num, "den": den, "o_num": F.when(zero, F.lit(0).cast(scale.DECIMAL)).otherwise(o_num), "o_den": F.when(zero, F.lit(1).cast(scale.DECIMAL)).otherwise(o_den),
    })


_SELECTOR = ("byte_offset", "bit_offset", "length_bits", "byte_order")


def _dimension(layouts: DataFrame) -> tuple[DataFrame, list | None]:
    """(winning layouts with fractions and the ``selector`` of their CAN key, the rows of ``layouts`` if they are few).

    Few layouts are joined here and enter the plan as a local table, which Spark works out while it plans, without a job.
    """
    rows = layouts.limit(MAX_LOCAL_ROWS + 1).collect()
    if len(rows) > MAX_LOCAL_ROWS:
        dims = effective_layouts(layouts)
        selectors = dims.filter("mux_role = 'selector'").select("can_id", "extended", F.struct(*_SELECTOR).alias("selector"))
        return dims.join(selectors, ["can_id", "extended"], "left"), None
    last: dict = {}
    for r in rows:
        key = (r["can_id"], r["extended"])
        last[key] = max(last.get(key, r["def_id"]), r["def_id"])
    kept = [r for r in rows if r["def_id"] == last[(r["can_id"], r["extended"])]]
    selectors: dict = {}
    for r in kept:
        if r["mux_role"] == "selector":
            selectors.setdefault((r["can_id"], r["extended"]), []).append(tuple(r[c] for c in _SELECTOR))
    joined = [(*r, s) for r in kept for s in selectors.get((r["can_id"], r["extended"]), [None])]
    fields = T.StructType([layouts.schema[c] for c in _SELECTOR])
    schema = T.StructType([*layouts.schema.fields, T.StructField("selector", fields)])
    return _with_fractions(layouts.sparkSession.createDataFrame(joined, schema)), kept


def decode_all(frames: DataFrame, layouts: DataFrame, dealt: bool = False) -> DataFrame:
    """One row per frame and signal with ``raw``, ``value``, ``active`` and ``status`` (null where a sample results).

    ``dealt`` says that frames lie in as many tasks as they should.

    One broadcast equi-join on the CAN key; everything else is a column of the same stage. Conditional
    signals are active when the selector, read unsigned from the same payload, lies in any of their ranges.
    """
    dims, known = _dimension(layouts)
    # The payload is cut into words once a frame; its fields are then shifts.
    worded = with_computed(frames if dealt else spread(frames), {"__big": bits.words(F.col("data"))})
    worded = with_computed(worded, {"__little": F.transform("__big", bits.swap_bytes)})
    rows = worded.join(small(dims), ["can_id", "extended"])
    payload = (F.col("__big"), F.col("__little"), F.length("data"))
    s = F.col("selector")
    unsigned = bits.extract_from_words(*payload, F.col("byte_offset"), F.col("bit_offset"), F.col("length_bits"), F.col("byte_order"))
    chosen = bits.extract_from_words(*payload, s["byte_offset"], s["bit_offset"], s["length_bits"], s["byte_order"])
    rows = with_computed(rows, {"unsigned": unsigned, "selected": chosen}).drop("__big", "__little")
    rows = rows.withColumn("raw", bits.sign(F.col("unsigned"), F.col("length_bits"), F.col("signedness")))
    is_float = F.col("signedness") == "float"
    real = bits.ieee754(F.col("unsigned"), F.col("length_bits"))
    ratio = F.col("num").cast("double") / F.col("den").cast("double")
    shift = F.col("o_num").cast("double") / F.col("o_den").cast("double")
    value = scale.physical(F.col("raw"), F.col("num"), F.col("den"), F.col("o_num"), F.col("o_den"), F.col("shift_bits"))
    # The long expression for IEEE numbers is left out where no layout needs it; the generated code stays small.
    if known is None or any(r["signedness"] == "float" for r in known):
        value = F.when(is_float, real * ratio + shift).otherwise(value)
    active = (F.col("mux_role") != "conditional") | F.coalesce(F.exists("mux_ranges", lambda r: F.col("selected").between(r["lo"], r["hi"])), F.lit(False))
    unsafe = ~is_float & ((F.abs(F.col("raw")) > SAFE_INTEGER) | ((F.col("length_bits") == 64) & (F.col("signedness") == "unsigned") & (F.col("raw") < 0)))
    rows = with_computed(rows, {"value": value}).withColumn("active", active)
    status = (
        F.when(F.col("unsigned").isNull(), "FRAME_TOO_SHORT")
        .when(unsafe, "SIGNAL_INTEGER_UNSAFE")
        .when(F.isnan("value") | (F.abs("value") == float("inf")), "SIGNAL_VALUE_NONFINITE")
    )
    return rows.withColumn("status", status).drop("selector", "num", "den", "o_num", "o_den", "shift_bits")


def decode(frames: DataFrame, layouts: DataFrame, dealt: bool = False) -> DataFrame:
    """Samples of active signals that decode well."""
    good = decode_all(frames, layouts, dealt).filter("active and status is null")
    return good.select("source_id", "ordinal", "t_us", "ts", "can_id", "extended", "channel", "direction", "def_id", "signal_id", "name", "unit", "raw", "value")


def decode_diagnostics(frames: DataFrame, layouts: DataFrame) -> DataFrame:
    bad = decode_all(frames, layouts).filter("active and status is not null")
    return bad.select("source_id", "ordinal", F.col("signal_id").alias("origin"), F.col("status").alias("code"), F.lit("error").alias("severity"))


def with_labels(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Value label by exact raw integer; label keys are decimal or ``0x`` texts."""
    key = F.trim("raw_text")
    number = F.when(key.rlike("(?i)^0x[0-9a-f]+$"), F.conv(F.substring(key, 3, 16), 16, 10).cast("long")).otherwise(key.try_cast("long"))
    dim = labels.select("signal_id", number.alias("raw"), F.col("label").alias("value_label"))
    return samples.join(small(dim), ["signal_id", "raw"], "left")


def occupied_bits(layouts: DataFrame) -> DataFrame:
    """``def_id, can_id, extended, signal_id, byte, bit`` for each bit of a field; bit 0 is the least significant of its byte."""
    i = F.explode(F.sequence(F.lit(0), F.col("length_bits") - 1)).alias("i")
    at = layouts.filter("length_bits > 0").select("def_id", "can_id", "extended", "signal_id", "byte_offset", "bit_offset", "byte_order", i)
    sequential = F.col("bit_offset") + F.col("i")
    inside = (sequential % 8).cast("int")
    return at.select(
        "def_id", "can_id", "extended", "signal_id", (F.col("byte_offset") + F.floor(sequential / 8)).cast("int").alias("byte"),
        F.when(F.col("byte_order") == "little", inside).otherwise(7 - inside).alias("bit"),
    )


def byte_masks(layouts: DataFrame) -> DataFrame:
    one = F.call_function("shiftleft", F.lit(1), F.col("bit"))
    return occupied_bits(layouts).groupBy("can_id", "extended", "byte").agg(F.bit_or(one).alias("mask"))


def tag() -> Column:
    """``name=value unit (label)`` of a sample, 12 significant digits; unit and label only where there are any."""
    label = F.when(F.coalesce("value_label", F.lit("")) != "", F.concat(F.lit("("), "value_label", F.lit(")")))
    return F.concat_ws(" ", F.concat("name", F.lit("="), significant(F.col("value"), 12)), F.when(F.col("unit") != "", F.col("unit")), label)


def explain(samples: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """Each sample beside the other samples of its frame, as a map of inputs by name.

    With ``layouts`` also where its bits lie (``bits``: first byte, bit, length, order) and how the value comes from the raw
    integer (``calculation``: ``raw × scale + offset = value unit``). Of derived signals, ``derived.lookup`` gives the bracket
    points and ``derived.moving_average`` the samples that a value rests on.
    """
    inputs = samples.groupBy("source_id", "ordinal").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("inputs"))
    out = samples.join(inputs, ["source_id", "ordinal"])
    if layouts is None:
        return out
    l = effective_layouts(layouts)
    bits_text = F.format_string("byte %d bit %d, %d bits %s endian %s", "byte_offset", "bit_offset", "length_bits", "byte_order", "signedness")
    factor, offset = (significant(F.col(a).cast("double") / F.col(b).cast("double"), 12) for a, b in (("num", "den"), ("o_num", "o_den")))
    dim = l.select("def_id", "signal_id", bits_text.alias("bits"), F.format_string("%s + %s", factor, offset).alias("__rule"))
    out = out.join(small(dim), ["def_id", "signal_id"])
    text = F.concat("raw", F.lit(" × "), "__rule", F.lit(" = "), significant(F.col("value"), 12), F.when(F.col("unit") != "", F.concat(F.lit(" "), "unit")).otherwise(""))
    return out.withColumn("calculation", text).drop("__rule")
