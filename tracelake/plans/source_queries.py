"""Queries of sources, sinks and measured channels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.times import clock_text, offset_text, seconds_text
from ..operators import decode as D
from ..operators import series as S
from ..sources import conversions as V
from ..sources import csv_logs as C
from ..sources import databases as B
from ..sources import logs as L
from ..sources import measured as M
from ..storage import shared_folder
from .registry import query
from .tables import events, frames, layouts, order_samples, samples


@query("S1", "SELECT ordinal, t_us, can_id, extended, channel, direction, 8 AS data_length, printf('%02X%02X%02X%02X%02X%02X%02X%02X', raw & 255, (raw >> 8) & 255, (raw >> 16) & 255, raw >> 24, (user_id >> 8) & 255, user_id & 255, k, mux) AS payload FROM fr")
def asc(spark, sf):
    f, _, _ = L.parse_asc(L.asc_lines(frames(spark, sf)))
    return f.select("ordinal", "t_us", "can_id", "extended", "channel", "direction", "data_length", F.hex("data").alias("payload"))


@query("S1_rejects", "SELECT source_id, ordinal::DOUBLE AS position, CASE WHEN mux = 0 THEN 'ASC_UNSUPPORTED_ROW' ELSE 'ASC_CLASSIC_PAYLOAD' END AS code FROM fr WHERE k < 5 AND mux < 2")
def asc_rejects(spark, sf):
    e = events(spark, sf).select("ordinal", "k", "mux")
    l = L.asc_lines(frames(spark, sf)).join(e, F.col("line") == F.col("ordinal"))
    damaged = F.when((F.col("k") < 5) & (F.col("mux") == 0), "?? unreadable").when((F.col("k") < 5) & (F.col("mux") == 1), F.regexp_replace("value", r" \S+ \S+$", " ZZ")).otherwise(F.col("value"))
    return L.parse_asc(l.select("source_id", "line", damaged.alias("value")))[1].select("source_id", "position", "code")


@query("S2", "SELECT ordinal, can_id, extended OR can_id > 2047 AS extended FROM fr")
def bases(spark, sf):
    f = frames(spark, sf)
    in_dec = (F.floor(F.col("ordinal") / 500) % 2) == 1
    text = F.format_string("%.6f %d %s%s %s r 8", "ts", "channel", F.when(in_dec, F.col("can_id").cast("string")).otherwise(F.hex("can_id")), F.lit(""), "direction")
    rows = f.select(F.lit("log").alias("source_id"), (F.col("ordinal") * 2 + 2).alias("line"), text.alias("value"))
    toggles = f.filter("ordinal % 500 = 0").select(F.lit("log").alias("source_id"), (F.col("ordinal") * 2 + 1).alias("line"), F.when(in_dec, "base dec  timestamps absolute").otherwise("base hex").alias("value"))
    out, _, _ = L.parse_asc(rows.union(toggles))
    return out.select(((F.col("ordinal") - 2) / 2).cast("long").alias("ordinal"), "can_id", "extended")


@query("S3", "SELECT ordinal, t_us FROM fr")
def files(spark, sf):
    """Frames written as text files and read back in small splits; each file counts its lines from 1."""
    path = shared_folder(spark)
    lines = L.asc_lines(frames(spark, sf))
    lines.repartitionByRange(4, "line").sortWithinPartitions("line").select("value").write.text(path)
    f, _, _ = L.read_asc(spark, path)
    sizes = f.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("source_id", before.alias("before"))
    return f.join(starts, "source_id").select((F.col("ordinal") - 1 + F.col("before")).alias("ordinal"), "t_us")


def _csv(spark, sf):
    path = shared_folder(spark)
    e = events(spark, sf)
    e.select(
        F.col("t_us").alias("Time_us"), F.col("value").alias("Speed [km/h]"), F.when(F.col("k") % 10 != 0, F.col("k")).alias("Level (%)"), F.col("user_id").alias("User"), F.concat(F.lit("t"), "k").alias("Note"),
    ).write.csv(path, header=True)
    return C.read_csv_log(spark, path)


@query("S4", "SELECT t_us, 'Speed' AS name, 'km/h' AS unit, value FROM fr UNION ALL SELECT t_us, 'Level', '%', CASE WHEN k % 10 <> 0 THEN k::DOUBLE END FROM fr UNION ALL SELECT t_us, 'User', NULL, user_id::DOUBLE FROM fr")
def csv(spark, sf):
    s, _ = _csv(spark, sf)
    return s.select("t_us", "name", "unit", F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query("S5", "SELECT ordinal, t_us + (SELECT CASE WHEN k % 2 = 0 THEN 60 ELSE 120 END FROM fr WHERE k % 50 <> 7 ORDER BY ordinal LIMIT 1)::BIGINT * 60000000 AS t_us FROM fr WHERE k % 50 <> 7")
def clocks(spark, sf):
    """A log with times of changing UTC offsets, some of them unreadable: all land on the first readable one's clock."""
    path = shared_folder(spark)
    e = events(spark, sf)
    minutes = F.when(F.col("k") % 2 == 0, 60).otherwise(120)
    text = F.concat(F.translate(clock_text(F.col("t_us") + minutes.cast("long") * 60000000), " ", "T"), offset_text(minutes))
    rows = e.select(F.when(F.col("k") % 50 == 7, "unreadable").otherwise(text).alias("Time"), F.col("ordinal").alias("Id"))
    rows.repartitionByRange(4, "Id").sortWithinPartitions("Id").write.csv(path, header=True)
    s, _ = C.read_csv_log(spark, path)
    return s.select(F.col("value").cast("long").alias("ordinal"), "t_us")


@query("S6", "SELECT ordinal, t_us - CASE WHEN source_id = 'log0' THEN 0 ELSE 1704067200000000 END AS t_us FROM fr WHERE k <> 3")
def time_base(spark, sf):
    """Overlay times written as log times, seconds from the start, Unix milliseconds and dates, on logs with and without a UTC offset."""
    start = 1704067200000000
    e = events(spark, sf).withColumns({
        "start_us": F.when(F.col("k") != 3, F.lit(start)), "offset_us": F.when(F.col("source_id") == "log0", 0).otherwise(start).cast("long"), "utc_minutes": F.when(F.col("mux") == 1, 60),
        "base": F.element_at(F.array(F.lit("log"), F.lit("relative"), F.lit("unix"), F.lit("datetime")), F.col("k") % 4 + 1),
    })
    ahead = F.coalesce(F.col("utc_minutes"), F.lit(0)).cast("long") * 60000000
    unix_ms = F.concat(F.floor((F.col("t_us") - ahead) / 1000), F.lit("."), F.lpad(((F.col("t_us") - ahead) % 1000).cast("string"), 3, "0"))
    # A log on UTC+1 gets dates written on UTC+2; the others' dates have no zone.
    dated = F.when(F.col("mux") == 1, F.concat(clock_text(F.col("t_us") + 3600000000), F.lit("+02:00"))).otherwise(clock_text(F.col("t_us")))
    written = F.when(F.col("base") == "log", seconds_text(F.col("t_us") - F.col("offset_us"), 6)).when(F.col("base") == "relative", seconds_text(F.col("t_us") - start, 6)).when(F.col("base") == "unix", unix_ms).otherwise(dated)
    rows = e.select("ordinal", "start_us", "offset_us", "utc_minutes", "base", written.alias("written"))
    placed, _ = C.place_on_log(rows, unit_seconds=F.when(F.col("base") == "unix", 0.001).otherwise(1.0))
    return placed.select("ordinal", "t_us")


@query("S6_unplaced", "SELECT 'CSV_TIME_BASE_UNAVAILABLE' AS code, 1::BIGINT AS n WHERE EXISTS (SELECT 1 FROM fr WHERE k % 4 = 3) UNION ALL SELECT 'CSV_TIMESTAMP_INVALID', count(*) FROM fr WHERE k % 4 = 1")
def unplaced(spark, sf):
    e = events(spark, sf).withColumns({"start_us": F.lit(None).cast("long"), "offset_us": F.lit(None).cast("long"), "utc_minutes": F.lit(None).cast("int")})
    rows = e.withColumn("base", F.when(F.col("k") % 4 == 3, "datetime")).withColumn("written", F.when(F.col("k") % 4 == 1, "later").otherwise(F.col("ordinal").cast("string")))
    return C.place_on_log(rows)[1].groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_SCALE = "regexp_replace(('0.' || p_size)::DOUBLE::VARCHAR, '[.]0$', '')"
_DBC_SQL = f"SELECT 'dbc-' || CASE WHEN p_partkey >= 2047 THEN 'e' ELSE 's' END || '-' || printf('%x', p_partkey + 1) || CASE WHEN i = 0 THEN '-size' ELSE '-price' END AS signal_id, p_partkey::INTEGER + 1 AS can_id, p_partkey >= 2047 AS extended, CASE WHEN i = 0 THEN 'Size' ELSE 'Price' END AS name, CASE WHEN i = 0 THEN 'mm' ELSE 'a\"b' END AS unit, CASE WHEN i = 0 THEN 1 ELSE 3 END AS byte_offset, CASE WHEN i = 0 THEN 2 ELSE 0 END AS bit_offset, CASE WHEN i = 0 THEN 6 ELSE 32 END AS length_bits, CASE WHEN i = 0 THEN 'signed' ELSE 'float' END AS signedness, CASE WHEN i = 0 THEN 'big' ELSE 'little' END AS byte_order, CASE WHEN i = 0 THEN {_SCALE} ELSE '1' END AS scale, CASE WHEN i = 0 THEN 'conditional' ELSE 'none' END AS mux_role, CASE WHEN i = 0 THEN '1-2,7-9' END AS spans FROM part, (VALUES (0), (1)) v(i)"


def _part_layouts(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") + 1).cast("int").alias("can_id"), (F.col("p_partkey") >= 2047).alias("extended"), F.concat(F.lit("Part "), "p_partkey").alias("message"), F.lit(8).alias("frame_bytes"), "p_size")
    none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>")
    two = F.array(F.struct(F.lit(1).cast("long").alias("lo"), F.lit(2).cast("long").alias("hi")), F.struct(F.lit(7).cast("long").alias("lo"), F.lit(9).cast("long").alias("hi")))
    no_range = F.lit(None).cast("double")

    def signal(name, unit, at, bit, n, signedness, order, scale, role, ranges):
        signal_id = F.concat_ws(".", F.lit(name), "can_id", "extended")
        return p.select("can_id", "extended", "message", "frame_bytes", signal_id.alias("signal_id"), F.lit(name).alias("name"), F.lit(unit).alias("unit"), F.lit(at).alias("byte_offset"), F.lit(bit).alias("bit_offset"), F.lit(n).alias("length_bits"), F.lit(signedness).alias("signedness"), F.lit(order).alias("byte_order"), scale.alias("scale"), F.lit("0").alias("offset"), F.lit(role).alias("mux_role"), ranges.alias("mux_ranges"), no_range.alias("minimum"), no_range.alias("maximum"), "p_size")

    return signal("Size", "mm", 1, 2, 6, "signed", "big", F.concat(F.lit("0."), "p_size"), "conditional", two).union(
        signal("Price", 'a"b', 3, 0, 32, "float", "little", F.lit("1"), "none", none)).union(
        signal("Selector", "", 0, 0, 8, "unsigned", "little", F.lit("1"), "selector", none))


def _part_labels(layouts):
    size = layouts.filter("name = 'Size'")
    pairs = F.array(F.struct(F.lit("0").alias("raw_text"), F.concat(F.lit("off; "), "p_size").alias("label")), F.struct(F.lit("1").alias("raw_text"), F.concat(F.lit('"on" '), "p_size").alias("label")))
    return size.select("signal_id", F.explode(pairs).alias("e")).select("signal_id", "e.raw_text", "e.label")


def _numbered(spark, sf):
    """The text of 64 databases, each message's lines together; value labels stand on two lines."""
    l = _part_layouts(spark, sf)
    lines = B.dbc_lines(l, _part_labels(l)).withColumn("value", F.when(F.col("place") == 2, F.replace("value", F.lit('" 1 "'), F.lit('"\n 1 "'))).otherwise(F.col("value")))
    lines = lines.select("can_id", "extended", "place", "value", F.posexplode(F.split("value", "\n")).alias("at", "text"))
    w = Window.partitionBy(F.floor(F.col("can_id") / 64)).orderBy("can_id", "extended", "place", "value", "at")
    return lines.select(F.concat(F.lit("db"), F.floor(F.col("can_id") / 64)).alias("source_id"), F.row_number().over(w).alias("line"), F.col("text").alias("value"))


@query("S7", _DBC_SQL, base=False)
def dbc(spark, sf):
    s, _, _ = B.parse_dbc(_numbered(spark, sf))
    spans = F.array_join(F.transform("mux_ranges", lambda r: F.concat_ws("-", r["lo"], r["hi"])), ",")
    return s.filter("name <> 'Selector'").select("signal_id", "can_id", "extended", "name", "unit", "byte_offset", "bit_offset", "length_bits", "signedness", "byte_order", "scale", "mux_role", spans.alias("spans"))


@query("S7_labels", "SELECT p_partkey::INTEGER + 1 AS can_id, v.raw AS raw_text, v.label || p_size AS label FROM part, (VALUES ('0', 'off; '), ('1', '\"on\" ')) v(raw, label)", base=False)
def dbc_labels(spark, sf):
    """Value labels over two lines, with semicolons and quotes inside."""
    return B.parse_dbc(_numbered(spark, sf))[1].select("can_id", "raw_text", "label")


@query("S7_reports", "SELECT 'db' || p_partkey AS source_id, v.line, v.code FROM part, (VALUES (1, 'DBC_SIGNAL_WITHOUT_MESSAGE'), (4, 'DBC_SIGNAL_CONVERSION'), (5, 'DBC_SIGNAL_SYNTAX'), (6, 'DBC_VALUE_TYPE_REFERENCE'), (7, 'DBC_VALUE_TYPE_INVALID'), (8, 'DBC_VALUE_LABEL_REFERENCE'), (9, 'DBC_VALUE_LABEL_SYNTAX'), (10, 'DBC_MULTIPLEXING_REFERENCE'), (11, 'DBC_MULTIPLEXING_FRAME'), (12, 'DBC_VALUE_LABEL_SYNTAX')) v(line, code)", base=False)
def dbc_reports(spark, sf):
    """A damaged database for every part: each damage is reported with its line."""
    damaged = (
        'SG_ Early : 0|8@1+ (1,0) [0|255] "" X', "BO_ 291 Part: 8 ECU", ' SG_ Size : 0|8@1+ (1,0) [0|255] "" X', ' SG_ Flat : 8|8@1+ (0,0) [0|255] "" X', ' SG_ Odd : 8|8@1 (1,0) [0|255] "" X', "SIG_VALTYPE_ 291 None : 1;",
        "SIG_VALTYPE_ 291 Size : 1;", 'VAL_ 291 None 0 "off";', 'VAL_ 291 Size 0 "off" 0 "on";', "SG_MUL_VAL_ 291 Size Size 5-2;", "SG_MUL_VAL_ 292 Size Size 1-2;", 'VAL_ 291 Size 0 "off"',
    )
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("db"), "p_partkey").alias("source_id"), F.posexplode(F.array(*map(F.lit, damaged))).alias("at", "value"))
    return B.parse_dbc(p.select("source_id", (F.col("at") + 1).alias("line"), "value"))[2].select("source_id", "line", "code")


@query("S7_samples", ", x AS (SELECT ordinal, 'Value' AS name, raw::DOUBLE / 100 AS value, NULL AS label FROM fr UNION ALL SELECT ordinal, 'Mux', mux::DOUBLE, CASE mux WHEN 0 THEN 'idle' WHEN 1 THEN 'run; one' END FROM fr UNION ALL SELECT ordinal, 'When_one', floor((k % 16) / 2)::DOUBLE, NULL FROM fr WHERE mux = 1) SELECT * FROM x")
def from_texts(spark, sf):
    """From the text of a log and the text of a database to labelled samples."""
    l = layouts(spark).withColumns({"message": F.col("def_id"), "frame_bytes": F.lit(8), "minimum": F.lit(None).cast("double"), "maximum": F.lit(None).cast("double")})
    labels = l.filter("name = 'Mux'").select("signal_id").crossJoin(F.broadcast(spark.createDataFrame([("0", "idle"), ("1", "run; one")], "raw_text string, label string")))
    w = Window.orderBy("can_id", "extended", "place", "value")  # a database of five messages
    text = B.dbc_lines(l, labels).select(F.lit("db").alias("source_id"), F.row_number().over(w).alias("line"), "value")
    found, value_labels, _ = B.parse_dbc(text)
    log, _, _ = L.parse_asc(L.asc_lines(frames(spark, sf)))
    s = D.with_labels(D.decode(log, found.drop("database")), value_labels)
    return s.filter("name in ('Value', 'Mux', 'When_one')").select("ordinal", "name", "value", F.col("value_label").alias("label"))


@query("S8", f"""WITH p AS (SELECT *, p_partkey + 1 + CASE WHEN p_partkey >= 2047 THEN 2147483648 ELSE 0 END AS id, {_SCALE} AS lsb, regexp_replace(round(('0.' || p_size)::DOUBLE * -32, 8)::VARCHAR, '[.]0$', '') AS lo, regexp_replace(round(('0.' || p_size)::DOUBLE * 31, 8)::VARCHAR, '[.]0$', '') AS hi FROM part)
 SELECT 'BO_ ' || id || ' Part_' || p_partkey || ': 8 Vector__XXX' AS value FROM p UNION ALL SELECT ' SG_ Size m1 : 13|6@0- (' || lsb || ',0) [' || lo || '|' || hi || '] "mm" Vector__XXX' FROM p
 UNION ALL SELECT ' SG_ Price : 24|32@1- (1,0) [0|0] "a\\"b" Vector__XXX' FROM p UNION ALL SELECT ' SG_ Selector M : 0|8@1+ (1,0) [0|255] "" Vector__XXX' FROM p
 UNION ALL SELECT 'VAL_ ' || id || ' Size 0 "off; ' || p_size || '" 1 "\\"on\\" ' || p_size || '";' FROM p
 UNION ALL SELECT 'SG_MUL_VAL_ ' || id || ' Size Selector 1-2, 7-9;' FROM p UNION ALL SELECT 'SIG_VALTYPE_ ' || id || ' Price : 1;' FROM p""", base=False)
def write_dbc(spark, sf):
    l = _part_layouts(spark, sf)
    return B.dbc_lines(l, _part_labels(l)).select("value")


@query("S8_report", "SELECT 'DBC_NAME_NORMALIZED' AS code, c_name || ' -> ' || regexp_replace(c_name, '[^A-Za-z0-9_]', '_', 'g') AS message FROM customer UNION ALL SELECT 'DBC_DERIVED_SIGNALS_SKIPPED', c_mktsegment || ': ' || count(*) FROM customer GROUP BY c_mktsegment", base=False)
def report_dbc(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>")
    l = c.select(F.col("c_custkey").cast("int").alias("can_id"), F.lit(True).alias("extended"), F.lit("m").alias("message"), F.lit("s").alias("signal_id"), F.col("c_name").alias("name"), F.lit(0).alias("byte_offset"), F.lit(0).alias("bit_offset"), none.alias("mux_ranges"))
    return B.export_report(l, c.select(F.col("c_mktsegment").alias("def_id"), F.col("c_mktsegment").alias("message"))).select("code", "message")


@query("S9", "SELECT ordinal, strftime(make_timestamp(t_us), '%Y-%m-%d %H:%M:%S.%f') || '+09:00' AS time, CASE WHEN event_type = 'click' AND k <> 0 THEN value END AS click, CASE WHEN event_type = 'view' AND k <> 0 THEN value END AS view FROM fr WHERE event_type IN ('click', 'view') AND t_us BETWEEN 1704500000000000 AND 1706000000000000")
def export_csv(spark, sf):
    """Wide rows of a time range exported with the displayed time and units, and read back."""
    path = shared_folder(spark)
    wide = S.wide(samples(spark, sf), ["ordinal", "t_us"], ["click", "view"]).withColumn("id", F.col("ordinal").cast("double"))
    cells = C.export_rows(wide, [("click", "click", "m"), ("view", "view", "m"), ("id", "id", "")], "datetime", 1704067200000000, 0, 540, (1704500000000000, 1706000000000000))
    cells.write.csv(path, header=True)
    back = spark.read.csv(path, header=True)
    return back.select(F.col("id").cast("long").alias("ordinal"), F.col("TIME").alias("time"), *(F.col(f"`{c} (m)`").cast("double").alias(c) for c in ("click", "view")))


_POINTS = [(0.0, 1.0), (10.0, 2.0), (100.0, 3.0)]
_CONVERSION = "conversion_id int, kind string, p array<double>, text string, points array<struct<input:double,output:double>>, ranges array<struct<lo:double,hi:double,value:double>>, is_float boolean, fallback double, refs array<struct<lo:double,hi:double,exact:boolean,ref:int>>, fallback_ref int"


def _conversion(i, kind, p=None, text=None, points=None, ranges=None, is_float=False, fallback=None, refs=None, fallback_ref=None):
    return (i, kind, p, text, points, ranges, is_float, fallback, refs, fallback_ref)


#: Conversions of every kind. 12 leads to others by ranges, one of them (13) on to others by values; 15 to 18 cannot be read.
_CONVERSIONS = [
    _conversion(0, "linear", [3.0, 2.0]), _conversion(1, "rational", [1.0, 0.0, 1.0, 0.0, 1.0, 2.0]), _conversion(2, "formula", text="-X^2 + 2*x"), _conversion(3, "nearest", points=_POINTS),
    _conversion(4, "ranges", ranges=[(0.0, 10.0, 1.0), (10.0, 50.0, 2.0)], fallback=-1.0), _conversion(5, "interpolated", points=_POINTS), _conversion(7, "formula", text="X**2 / (X - X)"), _conversion(8, "formula", text="sin(X)"),
    _conversion(9, "formula3", text="2 ^ -1 ^ 2 * x1"), _conversion(10, "rational3", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), _conversion(11, "formula", text="1/(1/(X-X)) + X**2"),
    _conversion(12, "nested", is_float=True, refs=[(0.0, 100.0, False, 13), (100.0, 300.0, False, 0), (300.0, 310.0, False, None)], fallback_ref=1),
    _conversion(13, "nested", refs=[(0.0, 20.0, False, None), (20.0, 40.0, False, 2), (40.0, 60.0, False, 14)], fallback_ref=5), _conversion(14, "nested", refs=[(50.0, 50.0, True, 4)], fallback_ref=0),
    _conversion(15, "nested", refs=[(0.0, 1.0, False, 8)]), _conversion(16, "nested", refs=[(0.0, 1.0, False, 17)]), _conversion(17, "nested", refs=[(0.0, 1.0, False, 16)]), _conversion(18, "unheard of"),
]


def _converted(spark, sf):
    e = events(spark, sf).select("ordinal", "value", (F.col("k") % 19).alias("conversion_id"))
    return V.convert(e, spark.createDataFrame(_CONVERSIONS, _CONVERSION), "value")


@query("S11", """, c AS (SELECT ordinal, value AS x, k % 19 AS c FROM fr),
 t AS (SELECT *, 3 + 2 * x AS linear, (x * x + 1) / (x + 2) AS rational, -(x * x) + 2 * x AS formula, CASE WHEN x BETWEEN 0 AND 10 THEN 1.0::DOUBLE WHEN x BETWEEN 10 AND 50 THEN 2.0 ELSE -1.0 END AS ranges,
   CASE WHEN x <= 0 THEN 1.0::DOUBLE WHEN x >= 100 THEN 3.0 WHEN x < 10 THEN 1 + x / 10 ELSE 2 + (x - 10) / 90 END AS bent FROM c)
 SELECT ordinal, round(CASE c WHEN 0 THEN linear WHEN 1 THEN rational WHEN 2 THEN formula WHEN 3 THEN CASE WHEN x <= 5 THEN 1.0::DOUBLE WHEN x <= 55 THEN 2.0 ELSE 3.0 END WHEN 4 THEN ranges WHEN 5 THEN bent
   WHEN 9 THEN 0.5 * x WHEN 10 THEN (2 - 4 * (x - 11)) / (3 * (x - 11) - 1) WHEN 11 THEN x * x
   WHEN 12 THEN CASE WHEN x >= 0 AND x < 100 THEN CASE WHEN x < 20 THEN x WHEN x < 40 THEN formula WHEN x < 60 THEN CASE WHEN x = 50 THEN ranges ELSE linear END ELSE bent END WHEN x >= 100 AND x < 300 THEN linear WHEN x >= 300 AND x < 310 THEN x ELSE rational END
   WHEN 13 THEN CASE WHEN x >= 0 AND x <= 20 THEN x WHEN x >= 20 AND x <= 40 THEN formula WHEN x >= 40 AND x <= 60 THEN CASE WHEN x = 50 THEN ranges ELSE linear END ELSE bent END
   WHEN 14 THEN CASE WHEN x = 50 THEN ranges ELSE linear END WHEN 6 THEN x END, 6) AS y FROM t WHERE c NOT IN (8, 15, 16, 17, 18)""")
def conversions(spark, sf):
    """One dimension of conversions of every kind; each row names its own, one has none."""
    return _converted(spark, sf)[0].select("ordinal", F.round("y", 6).alias("y"))


@query("S11_unreadable", "SELECT (k % 19)::INTEGER AS conversion_id, count(*) AS n FROM fr WHERE k % 19 IN (8, 15, 16, 17, 18) GROUP BY 1")
def unreadable(spark, sf):
    """Conversions that reject their channels, and how many values are left out for each."""
    e = events(spark, sf).select((F.col("k") % 19).alias("conversion_id"))
    return e.join(_converted(spark, sf)[1], "conversion_id").groupBy("conversion_id").agg(F.count(F.lit(1)).alias("n"))


@query("S12", "SELECT ordinal, CASE WHEN k BETWEEN 0 AND 9 THEN 1.0::DOUBLE WHEN k BETWEEN 10 AND 20 THEN 2.0 END AS whole, CASE WHEN k >= 0 AND k < 9 THEN 1.0::DOUBLE WHEN k >= 10 AND k < 20 THEN 2.0 END AS real FROM fr")
def range_bounds(spark, sf):
    ranges = F.expr("array(named_struct('lo', 0D, 'hi', 9D, 'value', 1D), named_struct('lo', 10D, 'hi', 20D, 'value', 2D))")
    x = F.col("k").cast("double")
    return events(spark, sf).select("ordinal", M.range_value(x, ranges, False, None).alias("whole"), M.range_value(x, ranges, True, None).alias("real"))


@query("S13", "SELECT ordinal, CASE WHEN k = 0 THEN 'zero' WHEN k = 1 THEN 'one' ELSE 'other' END AS label FROM fr")
def labels(spark, sf):
    table = spark.createDataFrame([(0, 1, "zero"), (1, 2, "one"), (1, 3, "uno")], "raw int, place int, label string")
    return M.value_labels(events(spark, sf).select("ordinal", "k"), table, "other", "k").select("ordinal", "label")


@query("S14", "SELECT ordinal, CASE WHEN (k >> 1) & 1 = 1 OR user_id = 7 THEN NULL ELSE value END AS value FROM fr")
def invalidation(spark, sf):
    flags = F.substring("data", 7, 1)
    e = events(spark, sf).select("ordinal", "value", "user_id").join(frames(spark, sf).select("ordinal", "data"), "ordinal")
    v = M.validity(F.col("value"), flags, F.lit(1), F.col("user_id") == 7)
    return e.select("ordinal", F.when(~F.isnan(v), v).alias("value"))


@query("S15", ", a AS (SELECT ordinal, k, unnest([raw, raw + 1, raw + 2, raw + 3, raw + 4, raw + 5]) AS value, unnest(range(6)) AS p FROM fr) SELECT ordinal, 'A[' || p // 3 || '][' || p % 3 || ']' AS signal_id, value FROM a WHERE p < k % 7")
def arrays(spark, sf):
    e = events(spark, sf).select("ordinal", "k", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("raw") + i).alias("values"))
    return M.flatten_array(e, "A", "values", (2, 3), True, size=F.col("k") % 7).select("ordinal", "signal_id", "value")


@query("S15_deep", """, a AS (SELECT ordinal, k, raw, unnest(range(24)) AS p FROM fr)
 SELECT ordinal, 'A[' || p // 12 || '][' || p // 4 % 3 || '][' || p % 4 || ']' AS signal_id, raw + p AS value FROM a WHERE p // 4 % 3 < k % 4 UNION ALL SELECT ordinal, 'B[' || p % 2 || '][' || p // 2 % 3 || '][' || p // 6 || ']', raw + p FROM a WHERE p // 6 < 2
 UNION ALL SELECT ordinal, 'C[' || p // 4 || '][' || p % 4 || ']', raw + p FROM a WHERE p < 12 AND p % 4 <= p // 4 AND p // 4 < k % 3""")
def deep_arrays(spark, sf):
    """Three dimensions in either order with sizes of their own, and arrays in arrays of unequal lengths."""
    e = events(spark, sf).select("ordinal", "k", "raw", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.col("raw") + i).alias("values"))
    a = M.flatten_array(e, "A", "values", (2, 3, 4), True, (None, F.col("k") % 4))
    b = M.flatten_array(e, "B", "values", (2, 3, 4), False, (None, None, F.lit(2)))
    ragged = e.withColumn("values", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.slice("values", i * 4 + 1, i + 1)))
    c = M.flatten_nested(ragged, "C", "values", (F.col("k") % 3,))
    return a.unionByName(b).unionByName(c).select("ordinal", "signal_id", "value")


@query("S16", "SELECT c.ordinal, m.t_us AS master_us FROM fr c LEFT JOIN fr m ON m.ordinal = c.ordinal + c.k * 200")
def remote_master(spark, sf):
    e = events(spark, sf)
    master = e.select(F.col("ordinal").alias("record"), F.col("t_us").alias("master_us"))
    return M.at_remote_master(e.select("ordinal", (F.col("ordinal") + F.col("k") * 200).alias("record")), master).select("ordinal", "master_us")


@query("S17", ", m AS (SELECT 1 AS stream, ordinal, t_us FROM fr UNION ALL SELECT 2, ordinal, t_us FROM od) SELECT stream, ordinal, row_number() OVER (PARTITION BY t_us ORDER BY stream, ordinal)::INTEGER AS place FROM m")
def merged(spark, sf):
    return M.merge_streams(events(spark, sf).select("ordinal", "t_us"), order_samples(spark, sf).select("ordinal", "t_us")).select("stream", "ordinal", "place")


@query("S18", "SELECT ordinal, can_id, extended, CASE WHEN mux = 0 THEN 1 ELSE channel END AS channel, least(k % 20, 15) AS dlc_code, CASE WHEN mux = 1 THEN [0,1,2,3,4,5,6,7,8,12,16,20,24,32,48,64][least(k % 20, 15) + 1] ELSE least(k % 20, 8) END::INTEGER AS data_length, (CASE WHEN mux = 1 THEN [0,1,2,3,4,5,6,7,8,12,16,20,24,32,48,64][least(k % 20, 15) + 1] ELSE least(k % 20, 8) END)::INTEGER AS n_bytes FROM fr WHERE NOT (extended AND k = 99)")
def records(spark, sf):
    e = events(spark, sf).join(frames(spark, sf).select("ordinal", "data"), "ordinal")
    raw_id = F.when(F.col("extended"), F.col("can_id").cast("long") + 0x80000000 + F.when(F.col("k") == 99, F.lit(0x40000000)).otherwise(F.lit(0))).otherwise(F.col("can_id").cast("long"))
    r = e.select("ordinal", raw_id.alias("id"), F.lit(False).alias("ide"), F.when(F.col("mux") != 0, F.col("channel")).alias("channel"), (F.col("k") % 20).alias("dlc"), F.lit(None).cast("int").alias("length"), (F.col("mux") == 1).alias("fd"), "data")
    return M.normalise_record(r).select("ordinal", "can_id", "extended", "channel", "dlc_code", "data_length", F.length("data").alias("n_bytes"))


@query("S19", "SELECT ordinal, CASE WHEN k = 1 THEN 'TIME' WHEN k = 2 AND NOT extended THEN 'ID' WHEN k = 3 THEN 'CHANNEL' WHEN k = 4 THEN 'DLC' WHEN k = 5 THEN 'LENGTH' END AS problem FROM fr WHERE k IN (1, 3, 4, 5) OR (k = 2 AND NOT extended)")
def validity(spark, sf):
    f = frames(spark, sf).join(events(spark, sf).select("ordinal", "k"), "ordinal").withColumns({
        "ts": F.when(F.col("k") == 1, F.lit(float("nan"))).otherwise(F.col("ts")), "can_id": F.when(F.col("k") == 2, F.lit(0x800)).otherwise(F.col("can_id")),
        "channel": F.when(F.col("k") == 3, -1).otherwise(F.col("channel")), "dlc_code": F.when(F.col("k") == 4, 16).otherwise(F.col("dlc_code")), "data_length": F.when(F.col("k") == 5, 7).otherwise(F.col("data_length")),
    })
    return f.select("ordinal", M.frame_problem().alias("problem")).filter("problem is not null")


@query("S20", "SELECT ordinal, 'mdf:' || source_id || ':user%20' || user_id || CASE WHEN row_number() OVER w = 1 THEN '' ELSE ':' || row_number() OVER w END AS signal_id FROM fr WINDOW w AS (PARTITION BY source_id, user_id ORDER BY ordinal)")
def signal_ids(spark, sf):
    c = events(spark, sf).select("ordinal", F.col("source_id").alias("group"), F.concat(F.lit("user "), "user_id").alias("name"))
    return M.channel_ids(c).select("ordinal", "signal_id")


@query("S21", "SELECT p_partkey AS part, p_name AS name, p_size || 'mm' AS unit FROM part UNION ALL SELECT p_partkey, p_name || ' [', NULL FROM part", base=False)
def headers(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    h = p.select(F.col("p_partkey").alias("part"), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " [").otherwise(" ("), "p_size", F.lit("mm"), F.when(F.col("p_partkey") % 2 == 0, "]").otherwise(")")).alias("h"))
    h = h.union(p.select("p_partkey", F.concat("p_name", F.lit(" ["))))
    name, unit = C.name_and_unit(F.col("h"))
    return h.select("part", name.alias("name"), unit.alias("unit"))
