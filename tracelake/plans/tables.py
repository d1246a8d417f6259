"""The bus-log tables that the queries run on, derived from the given event and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: CAN id of each kind of event.
CAN_IDS = {"click": 0x123, "view": 0x310, "signup": 0x320, "error": 0x184, "purchase": 0x18FF50E5}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t_us = F.unix_micros(F.col("ts").cast("timestamp"))
    can_id = F.lit(None).cast("int")
    for kind, number in CAN_IDS.items():
        can_id = F.when(F.col("event_type") == kind, F.lit(number)).otherwise(can_id)
    return e.select(
        F.concat(F.lit("log"), F.col("user_id") % 4).alias("source_id"),
        F.col("event_id").alias("ordinal"),
        t_us.alias("t_us"),
        (t_us.cast("double") / 1e6).alias("ts"),
        can_id.alias("can_id"),
        (F.col("event_type") == "purchase").alias("extended"),
        F.when(F.col("user_id") % 5 == 0, "Tx").otherwise("Rx").alias("direction"),
        (F.col("user_id") % 3 + 1).cast("int").alias("channel"),
        "event_type", "value", "user_id",
        F.floor(F.col("value") * 100 + 0.5).alias("raw"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("event_id") % 3).alias("mux"),
    )


def _hex(value: Column, n: int) -> Column:
    """The low ``n`` bytes of a whole number: a field of the payload wraps where a number is wider."""
    return F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit((1 << 8 * n) - 1))), 2 * n, "0")


def _payload() -> Column:
    raw = _hex(F.col("raw"), 4)
    little = F.concat(*(F.substring(raw, i, 2) for i in (7, 5, 3, 1)))
    return F.unhex(F.concat(little, _hex(F.col("user_id"), 2), _hex(F.col("k"), 1), _hex(F.col("mux"), 1)))


def _framed(events: DataFrame, data: Column, dlc_code: int) -> DataFrame:
    return events.select(
        "source_id", "ordinal", "t_us", "ts", "can_id", "extended", "direction", "channel",
        F.lit(dlc_code).alias("dlc_code"), F.length(data).alias("data_length"), data.alias("data"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with 8 bytes: value in hundredths (bytes 0-3, little), the low 16 bits of user (4-5, big), k (6), mux selector (7)."""
    return _framed(events(spark, sf_dir), _payload(), 8)


def with_whole_user(data: Column, user: Column) -> Column:
    """A payload with the whole user behind it (bytes 8-15, big, signed): a CAN FD frame of 16 bytes, where 16 bits of 8 would wrap."""
    return F.concat(data, F.unhex(F.lpad(F.hex(user.cast("long")), 16, "0")))


def session_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frames`` of 16 bytes, with whole users."""
    return _framed(events(spark, sf_dir), with_whole_user(_payload(), F.col("user_id")), 10)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal for each kind of event; k = 0 reads as NaN, every 17th k is invalid."""
    return events(spark, sf_dir).select(
        "source_id", "ordinal", F.lit(0).alias("seq"), F.col("event_type").alias("signal_id"), "t_us", "ts",
        F.when(F.col("k") == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.when(F.col("k") % 17 == 0, "invalid").otherwise("valid").alias("quality"),
        F.lit(None).cast("string").alias("value_label"),
    )


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that arrive out of time order and share times: ``key, ordinal, t_us, ts, value``."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t_us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        (F.col("o_custkey") % 10).alias("key"), F.col("o_orderkey").alias("ordinal"), t_us.alias("t_us"),
        (t_us.cast("double") / 1e6).alias("ts"), F.col("o_totalprice").alias("value"),
    )


def layouts(spark: SparkSession) -> DataFrame:
    """Definition of the payload above for every kind of event."""
    from ..schemas import LAYOUTS

    rows = []
    for kind, number in CAN_IDS.items():
        ext = kind == "purchase"
        rows += [
            (f"def_{kind}", number, ext, f"{kind}.value", "Value", "m", 0, 0, 32, "unsigned", "little", "0.01", "0", "none", None),
            (f"def_{kind}", number, ext, f"{kind}.user", "User", "", 4, 0, 16, "unsigned", "big", "1", "0", "none", None),
            (f"def_{kind}", number, ext, f"{kind}.k", "K", "", 6, 0, 8, "signed", "little", "1", "0", "none", None),
            (f"def_{kind}", number, ext, f"{kind}.mux", "Mux", "", 7, 0, 8, "unsigned", "little", "1", "0", "selector", None),
            (f"def_{kind}", number, ext, f"{kind}.when_one", "When one", "", 6, 0, 4, "unsigned", "little", "1/2", "0", "conditional", [(1, 1)]),
        ]
    return spark.createDataFrame(rows, LAYOUTS)
