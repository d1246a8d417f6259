"""Queries of bit decoding and physical conversion."""

from pyspark.sql import functions as F

from ..functions import bits, scale
from ..operators import decode as D
from .registry import query
from .tables import frames, layouts


def _layout(spark, text):
    return layouts(spark).filter(text)


def _mux_labels(spark):
    ids = layouts(spark).filter("name = 'Mux'").select("signal_id")
    return ids.crossJoin(F.broadcast(spark.createDataFrame([("0", "idle"), ("0x1", "run")], "raw_text string, label string")))


@query("D1", "SELECT ordinal, raw, user_id & 255 AS low_byte, user_id & 65535 AS be_user, (raw >> 3) & 4095 AS mid FROM fr")
def extract(spark, sf):
    f = frames(spark, sf)

    def field(a, b, n, order):
        return bits.extract_unsigned(F.col("data"), F.lit(a), F.lit(b), F.lit(n), F.lit(order))

    return f.select("ordinal", field(0, 0, 32, "little").alias("raw"), field(5, 0, 8, "little").alias("low_byte"), field(4, 0, 16, "big").alias("be_user"), field(0, 3, 12, "little").alias("mid"))


@query("D2", "SELECT ordinal, CASE WHEN k % 64 >= 32 THEN k % 64 - 64 ELSE k % 64 END::BIGINT AS signed6 FROM fr")
def signed(spark, sf):
    raw = bits.extract_unsigned(F.col("data"), F.lit(6), F.lit(0), F.lit(6), F.lit("little"))
    return frames(spark, sf).select("ordinal", bits.sign(raw, F.lit(6), F.lit("signed")).alias("signed6"))


@query("D3", "SELECT ordinal, raw::DOUBLE AS exact, ((user_id & 65535) + 1)::DOUBLE / 4 AS quarter FROM fr")
def ieee(spark, sf):
    f = frames(spark, sf).join(D.small(layouts(spark).select("can_id", "extended").distinct()), ["can_id", "extended"])
    raw = bits.extract_unsigned(F.col("data"), F.lit(0), F.lit(0), F.lit(32), F.lit("little"))
    user = bits.extract_unsigned(F.col("data"), F.lit(4), F.lit(0), F.lit(16), F.lit("big"))

    def exponent(v):
        e = F.floor(F.log2(v)).cast("long")
        return F.when(F.pow(F.lit(2.0), e) > v, e - 1).when(F.pow(F.lit(2.0), e + 1) <= v, e + 1).otherwise(e)

    def to_bits(v, e, mantissa, bias):
        m = ((v / F.pow(F.lit(2.0), e) - 1) * F.pow(F.lit(2.0), F.lit(mantissa))).cast("long")
        # Zero has no logarithm; all its bits are zero.
        return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", e + bias, F.lit(mantissa)) + m)

    # In steps: each reads the columns of the one before several times.
    f = f.select("ordinal", raw.cast("double").alias("raw"), ((user + 1).cast("double") / 4).alias("user"))
    f = f.withColumns({"raw_e": exponent(F.col("raw")), "user_e": exponent(F.col("user"))})
    f = f.select("ordinal", to_bits(F.col("raw"), F.col("raw_e"), 52, 1023).alias("raw"), to_bits(F.col("user"), F.col("user_e"), 23, 127).alias("user"))
    return f.select("ordinal", bits.ieee754(F.col("raw"), F.lit(64)).alias("exact"), bits.ieee754(F.col("user"), F.lit(32)).alias("quarter"))


@query("D4", """, b AS (SELECT *, raw::HUGEINT * 137438953472 + (user_id & 65535) AS big FROM fr)
 SELECT ordinal, ((raw * 3)::DOUBLE + 5) / 10 AS scaled, ((raw * 1)::DOUBLE * 100 - 300) / 10000 AS cents, ((big * 3 + 1)::VARCHAR || 'e-1')::DOUBLE AS large, ((big * 1234567890123456789 + 5 * 1000000000000000000)::VARCHAR || 'e-19')::DOUBLE AS long_scale,
  round(((big * 7)::DECIMAL(38, 0) / 3)::DOUBLE / 1e6) AS thirds FROM b""")
def exact_scale(spark, sf):
    raw = bits.extract_unsigned(F.col("data"), F.lit(0), F.lit(0), F.lit(32), F.lit("little"))
    user = bits.extract_unsigned(F.col("data"), F.lit(4), F.lit(0), F.lit(16), F.lit("big"))
    f = frames(spark, sf).select("ordinal", raw.alias("raw"), (raw * 137438953472 + user).alias("big"))
    texts = {"scaled": ("raw", "0.3", "5e-1"), "cents": ("raw", ".01", "-.03"), "large": ("big", "0.3", "0.1"), "long_scale": ("big", "0.1234567890123456789", "0.5"), "thirds": ("big", "7/3", "0")}
    return _scaled(f, texts).withColumn("thirds", F.round(F.col("thirds") / 1e6)).drop("raw", "big")


def _scaled(rows, texts):
    """``rows`` with a column for each of ``name: (raw column, scale text, offset text)``."""
    none = (F.lit(0).cast(scale.DECIMAL), F.lit(1).cast(scale.DECIMAL))
    for name, (raw, lsb, offset) in texts.items():
        parts = (*scale.scale_parts(F.lit(lsb)), *(none if offset == "0" else scale.scale_parts(F.lit(offset))))
        rows = rows.withColumns(dict(zip(("__n", "__d", "__on", "__od"), parts)))
        rows = rows.withColumn("__k", scale.power_of_two(F.col("__n"), F.col("__d")))
        value = scale.physical(F.col(raw), *(F.col(c) for c in ("__n", "__d", "__on", "__od", "__k")))
        rows = rows.withColumn(name, value).drop("__n", "__d", "__on", "__od", "__k")
    return rows


@query("D5", "SELECT ordinal, (raw >> 4)::DOUBLE AS sixteenth, (-(raw >> 4))::DOUBLE AS negated, (raw * 2)::DOUBLE AS twice FROM fr")
def shift_scale(spark, sf):
    raw = bits.extract_unsigned(F.col("data"), F.lit(0), F.lit(0), F.lit(32), F.lit("little"))
    f = frames(spark, sf).select("ordinal", raw.alias("raw"))
    return _scaled(f, {"sixteenth": ("raw", "1/16", "0"), "negated": ("raw", "-0.0625", "0"), "twice": ("raw", "2", "0")}).drop("raw")


@query("D6", """SELECT p_partkey AS part, (p_size)::DOUBLE AS num, (p_size + 1)::DOUBLE AS den, (p_size * 10 + 5)::DOUBLE AS d_num, 100::DOUBLE AS d_den FROM part""")
def scale_text(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    n, d = scale.scale_parts(F.concat(F.col("p_size"), F.lit("/"), F.col("p_size") + 1))
    dn, dd = scale.scale_parts(F.concat(F.col("p_size"), F.lit("5e-2")))
    return p.select(F.col("p_partkey").alias("part"), *(c.cast("double").alias(x) for c, x in ((n, "num"), (d, "den"), (dn, "d_num"), (dd, "d_den"))))


@query("D7", """SELECT ordinal, mux::BIGINT AS raw, CASE mux WHEN 0 THEN 'idle' WHEN 1 THEN 'run' END AS value_label FROM fr""")
def labels(spark, sf):
    s = D.decode(frames(spark, sf), _layout(spark, "name = 'Mux'"))
    return D.with_labels(s, _mux_labels(spark)).select("ordinal", "raw", "value_label")


@query("D8", "SELECT ordinal, k % 16 AS raw, CASE WHEN (k % 16) % 2 = 0 THEN (k % 16 / 2)::DOUBLE ELSE floor((k % 16) / 2)::DOUBLE END AS value FROM fr WHERE mux = 1")
def multiplexed(spark, sf):
    s = D.decode(frames(spark, sf), layouts(spark)).filter("name = 'When one'")
    return s.select("ordinal", F.col("raw").cast("int").alias("raw"), "value")


@query("D9", """, x AS (SELECT ordinal, event_type || '.value' AS signal_id, raw::DOUBLE / 100 AS value FROM fr
 UNION ALL SELECT ordinal, event_type || '.user', (user_id & 65535)::DOUBLE FROM fr UNION ALL SELECT ordinal, event_type || '.k', k::DOUBLE FROM fr
 UNION ALL SELECT ordinal, event_type || '.mux', mux::DOUBLE FROM fr UNION ALL SELECT ordinal, event_type || '.when_one', floor((k % 16) / 2)::DOUBLE FROM fr WHERE mux = 1)
 SELECT * FROM x""")
def decode(spark, sf):
    return D.decode(frames(spark, sf), layouts(spark)).select("ordinal", "signal_id", "value")


@query("D10", "SELECT ordinal, event_type || '.value' AS origin, 'FRAME_TOO_SHORT' AS code FROM fr WHERE k % 10 = 3 UNION ALL SELECT ordinal, event_type || '.wide', CASE WHEN k % 10 = 3 THEN 'FRAME_TOO_SHORT' ELSE 'SIGNAL_INTEGER_UNSAFE' END FROM fr WHERE k % 10 = 3 OR (mux * 256 + k) >= 32")
def diagnostics(spark, sf):
    from .tables import events

    k = events(spark, sf).select("ordinal", "k")
    short = frames(spark, sf).join(k, "ordinal").withColumn("data", F.when(F.col("k") % 10 == 3, F.substring("data", 1, 3)).otherwise(F.col("data")))
    wide = _layout(spark, "name in ('Value', 'Mux')").withColumns({
        "signal_id": F.when(F.col("name") == "Mux", F.concat(F.substring_index("signal_id", ".", 1), F.lit(".wide"))).otherwise(F.col("signal_id")),
        "byte_offset": F.lit(0), "length_bits": F.when(F.col("name") == "Mux", 64).otherwise(F.col("length_bits")), "mux_role": F.lit("none"),
    })
    return D.decode_diagnostics(short, wide).select("ordinal", "origin", "code")


@query("D11", "SELECT can_id, extended, b.byte::INTEGER AS byte, 255 AS mask FROM (SELECT DISTINCT can_id, extended FROM fr), (SELECT unnest(range(8)) AS byte) b")
def masks(spark, sf):
    used = frames(spark, sf).select("can_id", "extended").distinct()
    return D.byte_masks(layouts(spark).join(used, ["can_id", "extended"], "left_semi"))


@query("D13", "SELECT ordinal, 'Value=' || CASE WHEN raw % 100 = 0 THEN (raw // 100)::VARCHAR WHEN raw % 10 = 0 THEN (raw // 100)::VARCHAR || '.' || (raw % 100 // 10)::VARCHAR ELSE (raw // 100)::VARCHAR || '.' || lpad((raw % 100)::VARCHAR, 2, '0') END || ' m' AS tag FROM fr UNION ALL SELECT ordinal, 'Mux=' || mux || CASE mux WHEN 0 THEN ' (idle)' WHEN 1 THEN ' (run)' ELSE '' END FROM fr")
def tags(spark, sf):
    s = D.decode(frames(spark, sf), _layout(spark, "name in ('Value', 'Mux')"))
    return D.with_labels(s, _mux_labels(spark)).select("ordinal", D.tag().alias("tag"))


@query("D14", """SELECT ordinal, raw::DOUBLE / 100 AS value, raw::BIGINT AS raw, (user_id & 65535)::DOUBLE AS input_user, k::DOUBLE AS input_k, 'byte 0 bit 0, 32 bits little endian unsigned' AS bits,
 raw || ' × 0.01 + 0 = ' || CASE WHEN raw % 100 = 0 THEN (raw // 100)::VARCHAR WHEN raw % 10 = 0 THEN (raw // 100)::VARCHAR || '.' || (raw % 100 // 10)::VARCHAR ELSE (raw // 100)::VARCHAR || '.' || lpad((raw % 100)::VARCHAR, 2, '0') END || ' m' AS calculation FROM fr""")
def explained(spark, sf):
    l = _layout(spark, "name in ('Value', 'User', 'K')")
    s = D.explain(D.decode(frames(spark, sf), l), l)
    return s.filter("name = 'Value'").select("ordinal", "value", "raw", F.col("inputs")["User"].alias("input_user"), F.col("inputs")["K"].alias("input_k"), "bits", "calculation")
