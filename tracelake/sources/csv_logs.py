"""Measurement tables written as CSV: logs of signals, overlays on a log, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import with_computed
from ..functions.text import significant
from ..functions.times import clock_of, export_time, parse_clock, time_label, timestamp_of_clock_text, timestamp_us
from ..operators.decode import spread

#: Words that name a time column wherever they stand, and words that do so as the first of a heading (fixed values).
TIME_WORDS = {"time", "timestamp"}
LEADING_TIME_WORDS = {"time", "timestamp", "zeit", "temps", "時刻", "時間", "タイムスタンプ"}
#: Seconds of the units that a heading may name (fixed values).
UNIT_WORDS = (
    (("ns", "nanosecond", "nanoseconds"), 1e-9),
    (("us", "µs", "μs", "microsecond", "microseconds"), 1e-6),
    (("ms", "millisecond", "milliseconds"), 1e-3),
)
#: Numbers from this size on are Unix seconds, not seconds from a start.
UNIX_FROM = 1e8
SAMPLES = "row long, column string, name string, unit string, t_us long, value double, clock string"
REPORT = "code string, severity string, message string"


def heading_words(heading: str) -> list[str]:
    """Lower-case words of a heading: runs of letters and digits."""
    return "".join(c if c.isalnum() else " " for c in heading.lower()).split()


def time_column(headings: list[str]) -> tuple[int, float]:
    """(place, seconds a unit) of the time column: by name, else the first."""
    split = [heading_words(h) for h in headings]
    at = next((i for i, w in enumerate(split) if w and (w[0] in LEADING_TIME_WORDS or TIME_WORDS & set(w))), 0)
    unit = next((seconds for names, seconds in UNIT_WORDS if set(names) & set(split[at])), 1.0)
    return at, unit


def name_and_unit(heading: Column) -> tuple[Column, Column]:
    """Name and unit of ``Speed [km/h]`` or ``Speed (km/h)``: what the last bracket holds, if anything."""
    h = F.trim(heading)
    opening = F.when(h.endswith("]"), "[").when(h.endswith(")"), "(")
    inside = F.when(opening.isNotNull() & F.contains(h, opening), F.when(opening == "[", F.substring_index(h, "[", -1)).otherwise(F.substring_index(h, "(", -1)))
    unit = F.trim(F.substring(inside, F.lit(1), F.length(inside) - 1))
    name = F.trim(F.substring(h, F.lit(1), F.length(h) - F.length(inside) - 1))
    has = F.coalesce((unit != "") & (F.translate(unit, "])", "") == unit), F.lit(False))
    return F.when(has & (name != ""), name).otherwise(h), F.when(has, unit)


def read_csv_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, diagnostics) of a CSV log: one time column, every other column a signal.

    The first readable time tells how times are written: clock text, Unix seconds (1e8 and up) or
    seconds from the start. Times written with another UTC offset than the first are put on its clock. Empty
    cells are gaps (NaN); a column with any other text is rejected whole; rows without a readable time are
    reported.

    A first read settles the clock and which columns to reject, one row in all; a second one gives the samples.
    """
    df = spark.read.csv(path, header=True, inferSchema=False)
    if not df.columns:
        return spark.createDataFrame([], SAMPLES), spark.createDataFrame([("CSV_EMPTY", "error", "no header row")], REPORT)
    headings = df.columns
    place, unit = time_column(headings)
    others = [i for i in range(len(headings)) if i != place]
    row = F.monotonically_increasing_id()
    place_in_files = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), row.alias("row")).alias("place")
    rows = df.select(row.alias("row"), place_in_files, *(F.col(f"`{h.replace('`', '``')}`").alias(f"c{i}") for i, h in enumerate(headings)))
    rows = rows.select("row", "place", *(F.trim(f"c{i}").alias(f"c{i}") for i in range(len(headings))))
    text = F.col(f"c{place}")
    rows = with_computed(spread(rows, "row"), {"__clock": clock_of(text), "number": text.try_cast("double") * unit})
    us, utc, number = F.col("__clock.us"), F.col("__clock.utc"), F.col("number")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))

    def first_bad(i: int, readable: Column) -> Column:
        c = F.col(f"c{i}")
        value = c.try_cast("double")
        wrong = (c != "") & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
        return F.min(F.when(readable & wrong, F.struct("place", c.alias("cell"))))

    clock = F.when(us.isNotNull(), "text").when(finite & (F.abs(number) >= UNIX_FROM), "unix").when(finite, "relative")
    seen = rows.agg(
        F.min(F.when(us.isNotNull() | finite, F.struct("place", clock.alias("clock"), utc.alias("utc")))).alias("first"),
        *(first_bad(i, us.isNotNull()).alias(f"text{i}") for i in others), *(first_bad(i, finite).alias(f"number{i}") for i in others),
    ).first()
    report = []
    clock = seen["first"]["clock"] if seen["first"] else None
    rejected = {i: seen[f"{'text' if clock == 'text' else 'number'}{i}"] for i in others}
    report += [("CSV_COLUMN_NOT_NUMERIC", "error", f"{headings[i]}: {bad['cell']}") for i, bad in rejected.items() if bad]
    kept = [i for i in others if not rejected[i]]
    if clock is None:
        report.append(("CSV_NO_ROWS", "error", headings[place]))
    elif not others:
        report.append(("CSV_NO_VALUES", "error", headings[place]))
    if clock == "text":
        first_utc = seen["first"]["utc"]
        shift = F.coalesce((F.lit(first_utc) - utc).cast("long") * 60_000_000, F.lit(0)) if first_utc is not None else F.lit(0)
        t_us = us + shift
    else:
        t_us = F.when(finite, F.round(number * 1e6).cast("long"))
    late = rows.filter(t_us.isNull() & F.lit(clock is not None)).select(F.lit("CSV_TIME_INVALID").alias("code"), F.lit("warning").alias("severity"), F.coalesce(text, F.lit("")).alias("message"))
    diagnostics = spark.createDataFrame(report, REPORT).union(late)
    if clock is None or not kept:
        return spark.createDataFrame([], SAMPLES), diagnostics
    # Names and units are literals of each heading, folded by the planner. An unpivot here (Spark's Expand) fails to compile.
    cells = []
    for i in kept:
        name, unit_text = name_and_unit(F.lit(headings[i]))
        cell = F.col(f"c{i}")
        value = F.when(F.coalesce(cell, F.lit("")) == "", F.lit(float("nan"))).otherwise(cell.try_cast("double"))
        cells.append(F.struct(F.lit(headings[i]).alias("column"), name.alias("name"), unit_text.alias("unit"), value.alias("value")))
    timed = rows.select("row", t_us.alias("t_us"), *(f"c{i}" for i in kept)).filter("t_us is not null")
    long = timed.select("row", "t_us", F.inline(F.array(*cells)))
    return long.select("row", "column", "name", "unit", "t_us", "value", F.lit(clock).alias("clock")), diagnostics


def suggest_time_base(first: Column, unit_seconds: Column | float) -> Column:
    """How an overlay's times are written, judged by the first: ``datetime``, ``unix`` or ``relative``."""
    us, _ = parse_clock(first)
    number = first.try_cast("double") * unit_seconds
    return F.when(us.isNotNull(), "datetime").when(F.abs(number) >= UNIX_FROM, "unix").otherwise("relative")


def place_on_log(rows: DataFrame, written: str = "written", base: str = "base", unit_seconds: Column | float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(rows with ``t_us`` and ``original``, diagnostics) of an overlay's written times put on a log's time.

    ``rows`` carry the log's reference as ``start_us, offset_us, utc_minutes`` (nulls where unknown). ``base`` is
    ``log`` (timestamps of the log itself; also for null), ``relative`` (from its start), ``unix`` or ``datetime``; numbers
    are in units of ``unit_seconds``. The written text stays as ``original``. Dates, and Unix seconds, cannot be placed
    on a log without a start (``CSV_TIME_BASE_UNAVAILABLE``); a text that is no time is ``CSV_TIMESTAMP_INVALID``.
    """
    text = F.trim(written)
    kind = F.coalesce(base, F.lit("log"))
    unit = F.lit(unit_seconds) if isinstance(unit_seconds, float) else unit_seconds
    micros = F.round(text.try_cast("decimal(30,9)") * unit.cast("decimal(10,9)") * 1_000_000, 0).cast("long")
    reference = F.col("start_us"), F.col("offset_us"), F.col("utc_minutes")
    placed = (
        F.when(kind == "log", micros)
        .when(kind == "datetime", timestamp_of_clock_text(text, *reference))
        .when(F.col("start_us").isNotNull() | (kind == "relative"), timestamp_us(micros, kind, *reference))
    )
    needs_start = F.col("start_us").isNull() & kind.isin("datetime", "unix")
    code = F.when(needs_start, "CSV_TIME_BASE_UNAVAILABLE").when(F.col("__t").isNull(), "CSV_TIMESTAMP_INVALID")
    out = with_computed(with_computed(rows, {"__t": placed}), {"__code": code})
    good = out.filter("__code is null").withColumn("original", text).withColumnRenamed("__t", "t_us").drop("__code")
    # A log without a start is reported once, not for every row.
    bad = out.filter("__code is not null")
    once = bad.filter("__code = 'CSV_TIME_BASE_UNAVAILABLE'").select(F.col("__code").alias("code"), F.lit("error").alias("severity"), F.lit("").alias("message")).distinct()
    each = bad.filter("__code <> 'CSV_TIME_BASE_UNAVAILABLE'").select(F.col("__code").alias("code"), F.lit("warning").alias("severity"), F.coalesce(text, F.lit("")).alias("message"))
    return good, once.union(each)


def export_rows(wide: DataFrame, signals: list[tuple[str, str, str]], mode: str = "datetime", start_us: int | None = None, offset_us: int | None = None, utc_minutes: int | None = None, view: tuple[int, int] | None = None) -> DataFrame:
    """Cells of a CSV export of ``wide`` rows (``t_us`` and a column a signal), in their time range.

    ``signals`` are ``(column, name, unit)``; headings read ``Name (unit)``, with a number behind where they would
    repeat. The first column is the time as displayed, values have up to 12 significant digits, nulls are empty cells.
    """
    start, offset, utc = (F.lit(v).cast("long") for v in (start_us, offset_us, utc_minutes))
    if view is not None:
        wide = wide.filter(F.col("t_us").between(*view))
    label = wide.sparkSession.range(1).select(time_label(F.lit(mode), start)).first()[0]
    seen: dict[str, int] = {label: 1}
    columns = [export_time(F.col("t_us"), F.lit(mode), start, offset, utc.cast("int")).alias(label)]
    for column, name, unit in signals:
        heading = f"{name} ({unit})" if unit else name
        seen[heading] = seen.get(heading, 0) + 1
        value = F.col(f"`{column}`")
        columns.append(F.when(~F.isnan(value), significant(value, 12)).alias(heading if seen[heading] == 1 else f"{heading} {seen[heading]}"))
    return wide.select(*columns)
