"""Vectors and equivalences for functions and operators."""

import math
import random
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake import plans
from tracelake.functions import bits, scale
from tracelake.functions.expression import compile_expression
from tracelake.operators import decode, derived, series, trace
from tracelake.plans.tables import order_samples
from tracelake.sources import csv_logs, logs


def reference_bits(data, byte, bit, length, order):
    if order == "little":
        return (int.from_bytes(data, "little") >> (8 * byte + bit)) & ((1 << length) - 1)
    whole = int.from_bytes(data, "big")
    return (whole >> (8 * len(data) - 8 * byte - bit - length)) & ((1 << length) - 1)


def test_bits_against_big_integers(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        data = bytes(rnd.randrange(256) for _ in range(16))
        byte, bit, length, order = rnd.randrange(0, 7), rnd.randrange(8), rnd.randrange(1, 65), rnd.choice(["little", "big"])
        raw = reference_bits(data, byte, bit, length, order)
        rows.append((i, bytearray(data), byte, bit, length, order, raw - (1 << 64) if raw >= 1 << 63 else raw))
    df = spark.createDataFrame(rows, "i int, data binary, byte int, bit int, length int, byte_order string, want long")
    got = df.select(bits.extract_unsigned(F.col("data"), F.col("byte"), F.col("bit"), F.col("length"), F.col("byte_order")).alias("got"), "want").toPandas()
    assert (got["got"] == got["want"]).all()


def test_field_past_the_payload_is_null(spark):
    df = spark.createDataFrame([(bytearray(b"\1\2"),)], "data binary")
    raw = bits.extract_unsigned(F.col("data"), F.lit(1), F.lit(1), F.lit(8), F.lit("little"))
    assert df.select(raw.alias("r")).first()["r"] is None


@pytest.mark.parametrize("value", [3.14159274, -0.5, 0.0, 1e-40, math.inf])
def test_ieee(spark, value):
    single, double = struct.unpack(">I", struct.pack(">f", value))[0], struct.unpack(">q", struct.pack(">d", value))[0]
    row = spark.range(1).select(bits.ieee754(F.lit(single).cast("long"), F.lit(32)).alias("s"), bits.ieee754(F.lit(double).cast("long"), F.lit(64)).alias("d")).first()
    assert row["s"] == struct.unpack(">f", struct.pack(">f", value))[0] and row["d"] == value


@pytest.mark.parametrize("raw,lsb,offset,want", [
    (36, "1/16", "0", 2.0), (36, "-1/16", ".9", -1.1), (-36, "1/16", "0", -3.0), (-1, "1/16", "0", -1.0), (0xFFFFFFFF, "2", "0", 8589934590.0),
    (29, "0.1", "0.1", 3.0), (3, "0.3", "0.1", 1.0), (7, ".01", "-.03", 0.04), (36, "3/16", "0", 6.75),
])
def test_scale_vectors(spark, raw, lsb, offset, want):
    n, d = scale.scale_parts(F.lit(lsb))
    on, od = scale.scale_parts(F.lit(offset)) if offset != "0" else (F.lit(0).cast(scale.DECIMAL), F.lit(1).cast(scale.DECIMAL))
    assert spark.range(1).select(scale.physical(F.lit(raw).cast("long"), n, d, on, od).alias("v")).first()["v"] == want


@pytest.mark.parametrize("text", ["0", "1/0", "abc", "1e16", "1e-16", ""])
def test_scale_texts_refused(spark, text):
    assert spark.range(1).select(scale.scale_parts(F.lit(text))[0].alias("n")).first()["n"] is None


@pytest.mark.parametrize("text,want", [("-2^2", 4.0), ("2^3^2", 512.0), ("1/0", None), ("sqrt(0-1)", None), ("max(1, 2, [a])", 5.0), ("clamp([a], 0, 3) + 1", 4.0), ("-(2 + 3) * 2", -10.0)])
def test_expressions(spark, text, want):
    row = spark.createDataFrame([(5.0,)], "a double").select(compile_expression(text, {"a": F.col("a")}).alias("v")).first()
    assert row["v"] == want


@pytest.mark.parametrize("text", ["1 +", "foo(1)", "(1", "clamp(1, 2)", "1 2"])
def test_expressions_refused(text):
    with pytest.raises(ValueError):
        compile_expression(text, {})


def test_low_pass_equals_recurrence(spark, sf_dir):
    tau = 3 * 86400.0
    rows = derived.epochs(order_samples(spark, sf_dir), ["key"], "t_us")
    got = derived.low_pass(rows, ["key"], tau).toPandas().sort_values(["key", "ordinal"])
    for _, g in got.groupby("key"):
        y, last, epoch = None, None, None
        for r in g.itertuples():
            a = 0.0 if y is None or r.epoch != epoch else math.exp(-(r.ts - last) / tau)
            y = r.value if a == 0.0 and (y is None or r.epoch != epoch) else a * y + (1 - a) * r.value
            last, epoch = r.ts, r.epoch
            assert r.y == pytest.approx(y, rel=1e-9)


def _series(spark, values, times=None, quality=None):
    rows = [("s", i, 0, int((times[i] if times else i) * 1_000_000), float(v), (quality or {}).get(i, "valid"), None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "signal_id string, ordinal long, seq int, t_us long, value double, quality string, value_label string")


def test_breaks_at_a_gap(spark):
    s = _series(spark, range(8), [0, 1, 2, 3, 100, 101, 102, 103])
    got = series.break_samples(s, ["signal_id"], series.cadence(s, ["signal_id"])).toPandas()
    assert sorted(got["t_us"] // 1_000_000) == [3, 100]


def test_breaks_of_an_invalid_stretch(spark):
    values = [math.nan if 20 <= i <= 80 else i for i in range(100)]
    s = _series(spark, values)
    t = series.cadence(s, ["signal_id"])
    assert sorted(series.break_samples(s, ["signal_id"], t).toPandas()["ordinal"]) == [19, 20, 80, 81]
    assert len(series.gaps(s, ["signal_id"], t, 0).toPandas()) == 1


def test_thinning_keeps_its_budget_and_extremes(spark):
    values = [math.sin(i / 50) for i in range(5000)]
    values[1234], values[4321] = 9.0, -9.0
    got = series.thin(_series(spark, values), ["signal_id"], 300).toPandas()
    assert len(got) <= 300 and {1234, 4321, 0, 4999} <= set(got["ordinal"])


def test_empty_tables(spark):
    s = _series(spark, [1.0]).filter("false")
    k = ["signal_id"]
    assert series.gaps(s, k, series.cadence(s, k), 0).count() == 0
    assert series.thin(s, k, 10).count() == 0
    assert series.changes(s, k).count() == 0


def test_trace_intervals(spark):
    times, payload = [0, 0.1, 0.35, 0.4, 1], [1, 1, 2, 2, 2]
    rows = [("l", i, int(t * 1e6), 1, False, 1, "Rx", bytearray([p])) for i, (t, p) in enumerate(zip(times, payload))]
    f = spark.createDataFrame(rows, "source_id string, ordinal long, t_us long, can_id int, extended boolean, channel int, direction string, data binary")
    a = trace.trace_at(f, 450_000).first()
    assert (a["min_ms"], a["max_ms"], a["changed_us"], a["count"]) == (50.0, 250.0, 350_000, 4)
    assert trace.trace_at(f, 2_000_000).first()["max_ms"] == 600.0
    assert trace.trace_at(f, 2_000_000, 300_000).first()["count"] == 3


def test_asc_rows(spark):
    text = """date Sun Aug 30 12:00:00.000 2026
base hex  timestamps absolute
// comment
0.010000 1 123 Rx d 2 AA 1
0.020000 2 18FF50E5x Tx d 1 FF
0.030000 CANFD 1 Rx 310 Engine 1 0 9 12 01 02 03 04 05 06 07 08 09 0A 0B 0C
0.040000 1 123 Rx r 8
base dec
0.050000 1 291 Rx d 0
0.060000 1 123 Rx d 3 01 02
garbage""".split("\n")
    lines = spark.createDataFrame([("log", i + 1, t) for i, t in enumerate(text)], "source_id string, line long, value string")
    frames, bad, refs = logs.parse_asc(lines)
    f = {r["ordinal"]: r for r in frames.collect()}
    assert f[4]["data"] == b"\xaa\x01" and f[4]["can_id"] == 0x123 and f[4]["t_us"] == 10000
    assert f[5]["extended"] and f[5]["can_id"] == 0x18FF50E5
    assert f[6]["dlc_code"] == 9 and f[6]["data_length"] == 12
    assert f[7]["data_length"] == 0 and f[7]["dlc_code"] == 8
    assert f[9]["can_id"] == 291
    assert {(int(r["position"]), r["code"]) for r in bad.collect()} == {(10, "ASC_CLASSIC_PAYLOAD"), (11, "ASC_UNSUPPORTED_ROW")}
    assert refs.first()["start_us"] == 1788091200000000


def test_lines_are_numbered_alike_for_any_split(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"".join(b"line %d%s" % (i, [b"\n", b"\r\n", b"\r"][i % 3]) for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = logs.numbered_lines(spark, str(tmp_path)).toPandas().sort_values("line")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["value"].tolist() == [f"line {i}" for i in range(5000)] and got["line"].tolist() == list(range(1, 5001))


def test_csv_log(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time_ms,Speed [km/h],Note\n0,1.5,x\n500,,y\nbad,3,z\n1000,2,w\n")
    s, bad = csv_logs.read_csv_log(spark, str(tmp_path))
    rows = s.toPandas().sort_values("t_us")
    assert rows["t_us"].tolist() == [0, 500000, 1000000] and set(rows["name"]) == {"Speed"} and set(rows["unit"]) == {"km/h"}
    assert math.isnan(rows["value"].iloc[1])
    assert {r["code"] for r in bad.collect()} == {"CSV_COLUMN_NOT_NUMERIC", "CSV_TIME_INVALID"}


def test_stream_filter_equals_batch(spark, sf_dir):
    got = plans.queries()["W4"](spark, sf_dir).toPandas().sort_values("ordinal")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("event_id").alias("ordinal"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "value")
    e = e.withColumn("ts", F.col("t_us") / 1e6)
    want = derived.low_pass(derived.epochs(e, ["event_type"], "t_us"), ["event_type"], 3600.0).toPandas().sort_values("ordinal")
    assert got["ordinal"].tolist() == want["ordinal"].tolist()
    assert got["y"].tolist() == pytest.approx(want["y"].tolist(), rel=1e-9)


def test_lineage_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 3)], "node long, input long")
    got = {r["node"]: r["level"] for r in derived.lineage(edges, spark.createDataFrame([(0,)], "node long"), spark).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: None, 4: None}


def test_decode_last_definition_wins(spark, sf_dir):
    from tracelake.plans.tables import frames, layouts

    l = layouts(spark).filter("name = 'Value' and def_id = 'def_click'")
    twice = l.union(l.withColumn("def_id", F.lit("zz")).withColumn("scale", F.lit("1")))
    got = decode.decode(frames(spark, sf_dir), twice).select("def_id").distinct().toPandas()
    assert isinstance(got, pd.DataFrame) and got["def_id"].tolist() == ["zz"]


def test_drawn_edges(spark):
    """Series wholly beside a view or clip, samples on an edge, ranges that share nothing, turned bounds, empty tables."""
    from tracelake.operators import views

    rows = [("a", "s", i, t, float(i), "valid") for i, t in enumerate((10, 20, 20, 30, 40))] + [("b", "s", 9, 5, 1.0, "valid")]
    s = spark.createDataFrame(rows, "target string, signal_id string, ordinal long, t_us long, value double, quality string")
    k = ["target", "signal_id"]

    def drawn(clips=None, shown=None):
        bounds = [x and spark.createDataFrame([(*r,) for r in x], "target string, start_us long, end_us long") for x in (shown, clips)]
        return sorted((r.target, r.ordinal, r.inside, r.carried) for r in views.drawn(s, k, *bounds).filter("target = 'a'").collect())

    whole = [("a", i, True, False) for i in range(5)]
    assert drawn() == whole and drawn(clips=[("b", 0, 1)]) == whole
    assert drawn(clips=[("a", 30, 20)]) == [("a", 1, True, False), ("a", 2, True, False), ("a", 3, True, False)]
    assert drawn(clips=[("a", 21, 29)]) == [("a", 2, False, True), ("a", 3, False, True)]
    assert drawn(clips=[("a", 50, 60)]) == [("a", 4, False, True)] and drawn(clips=[("a", 0, 5)]) == [("a", 0, False, True)]
    assert drawn(shown=[("a", 20, 30)]) == [("a", 0, False, False)] + whole[1:4] + [("a", 4, False, False)]
    assert drawn(shown=[("a", 50, 60)]) == [("a", 4, False, False)]
    assert drawn(clips=[("a", 15, 35)], shown=[("a", 18, 25)]) == [("a", 0, False, True), ("a", 1, True, False), ("a", 2, True, False), ("a", 3, False, False)]
    assert drawn(clips=[("a", 10, 20)], shown=[("a", 30, 40)]) == []
    assert views.drawn(s.limit(0), k).count() == 0


def test_thin_small_limits(spark):
    """Limits too small for a run take samples at even places; each series may have a limit of its own."""
    from tracelake.operators import series

    s = spark.range(40).selectExpr("concat('m', id % 8) AS signal_id", "id AS ordinal", "id div 8 AS t_us", "cast(id AS double) AS value", "'valid' AS quality", "id % 8 AS most")
    got = {r.signal_id: (r.n, r.places) for r in series.thin(s, ["signal_id"], "most").groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("t_us")).alias("places")).collect()}
    assert "m0" not in got and got["m1"][1] == [0] and got["m2"][1] == [0, 4] and got["m3"][1] == [0, 2, 4]
    assert got["m4"][1] == [0, 1, 3, 4] and all(got[f"m{i}"][0] == 5 for i in (5, 6, 7))


def test_clip_path_without_inside(spark):
    """Carried points give no edge without a point inside, and go where the clip has no bounds."""
    from tracelake.operators import views

    p = spark.createDataFrame([(0, 1, 1.0, 2.0, True), (10, 1, 3.0, 6.0, False), (20, 1, 5.0, 0.0, True)], "t_us long, k int, x double, y double, carried boolean")
    assert sorted(tuple(r) for r in views.clip_path(p, 5, 15).collect()) == [(5, 2.0, 4.0, True), (10, 3.0, 6.0, False), (15, 4.0, 3.0, True)]
    assert views.clip_path(p.filter("carried"), 5, 15).count() == 0
    assert [tuple(r) for r in views.clip_path(p, None, None).collect()] == [(10, 3.0, 6.0, False)]
