"""Derived signals and calculations from definition tables.

Definitions are few beside their samples: they are read to the driver, put into stages by what they use (a stage's
definitions use only earlier ones), and each stage becomes columns of one projection, windows for its filters, or one
as-of join for all its inputs. Points of lookup tables are joined as arrays. Definitions that cannot be used are
reported, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expression import compile_expression, names_of
from ..storage import written
from .asof import neighbours
from .decode import small
from .derived import epochs, low_pass, moving_average

#: Definitions of one kind that may be read to the driver.
MAX_DEFINITIONS = 20_000
FRAME = ["source_id", "ordinal", "def_id", "t_us", "ts", "channel", "direction"]


def _rows(df: DataFrame, order: list[str]) -> list:
    rows = df.orderBy(*order).limit(MAX_DEFINITIONS + 1).collect()
    if len(rows) > MAX_DEFINITIONS:
        raise ValueError(f"more than {MAX_DEFINITIONS} definitions")
    return rows


def looked_up(x: Column, points: Column, outside: Column) -> Column:
    """Linear interpolation between the sorted ``points array<struct<input, output>>``; beyond them held (``clamp``) or null (``error``)."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    above = F.get(F.filter(points, lambda p: p["input"] >= x), F.lit(0))
    below = F.element_at(F.filter(points, lambda p: p["input"] < x), -1)
    share = (x - below["input"]) / (above["input"] - below["input"])
    inside = F.when(x == first["input"], first["output"]).otherwise(below["output"] + share * (above["output"] - below["output"]))
    held = F.when(x < first["input"], first["output"]).otherwise(last["output"])
    beyond = (x < first["input"]) | (x > last["input"])
    return F.when(x.isNotNull() & points.isNotNull(), F.when(beyond, F.when(outside == "clamp", held)).otherwise(inside))


def points_of(points: DataFrame, key: str) -> DataFrame:
    """``key, points``: the finite points of each table as one sorted array."""
    finite = F.col("input").isNotNull() & F.col("output").isNotNull() & ~F.isnan("input") & ~F.isnan("output") & (F.abs("input") < float("inf")) & (F.abs("output") < float("inf"))
    return points.filter(finite).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("input", "output"))).alias("points"))


def _finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _uses(d) -> set[str] | None:
    """Names that a definition reads; None if its text cannot be read."""
    if d["kind"] != "expression":
        return {d["input"]}
    try:
        return names_of(d["text"])
    except ValueError:
        return None


def derive(samples: DataFrame, definitions: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(derived samples, report) of direct samples by a table of derived signals.

    ``samples``: the columns of ``FRAME``, ``name`` and ``value``. ``definitions``: ``def_id, place, name, kind``, and by kind ``text`` (``expression``),
    ``input, table_id, outside`` (``lookup``), or ``input, filter, seconds`` (``filter``: ``low-pass`` or ``moving-average``). ``points``: ``table_id, input, output``.

    A derived signal may use direct signals of its frame and derived ones of a smaller ``place``. Where an input is missing, a divisor is 0, a
    lookup is left or a result is not finite there is no sample. Filters keep state for each definition, source, channel and
    direction, in order of arrival, and start anew where time does not advance. The report has ``def_id, name, code`` of
    definitions that can never give a sample: unreadable texts, inputs that no earlier signal has, tables with fewer than two points.
    """
    spark = samples.sparkSession
    direct = {(r["def_id"], r["name"]) for r in _rows(samples.select("def_id", "name").distinct(), ["def_id", "name"])}
    tables = {r["table_id"] for r in points_of(points, "table_id").filter("size(points) > 1").select("table_id").collect()}
    level = {k: 0 for k in direct}
    stages: dict[int, list] = {}
    report = []
    for d in _rows(definitions, ["def_id", "place"]):
        uses = _uses(d)
        missing = sorted(x for x in uses or () if (d["def_id"], x) not in level)
        code = "EXPRESSION_INVALID" if uses is None else "INPUT_MISSING" if missing else "LOOKUP_INVALID" if d["kind"] == "lookup" and d["table_id"] not in tables else None
        if code:
            report.append((d["def_id"], d["name"], code))
            continue
        # Filters need a stage of their own: their input must stand in a column before the window.
        at = max((level[(d["def_id"], x)] for x in uses), default=0) + 1
        level[(d["def_id"], d["name"])] = at
        stages.setdefault(at, []).append(d)
    rows = samples.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__v"))
    of_frame = definitions.filter("kind = 'lookup'").select("def_id", "table_id").distinct().join(points_of(points, "table_id"), "table_id")
    per = of_frame.groupBy("def_id").agg(F.map_from_entries(F.collect_list(F.struct("table_id", "points"))).alias("__points"))
    rows = rows.join(small(per), "def_id", "left")
    for at in sorted(stages):
        plain = [d for d in stages[at] if d["kind"] != "filter"]
        if plain:
            rows = _add(rows, [(d["def_id"], d["name"], _column(d)) for d in plain])
        for kind, seconds in sorted({(d["filter"], d["seconds"]) for d in stages[at] if d["kind"] == "filter"}):
            rows = _filtered(rows, [d for d in stages[at] if d["kind"] == "filter" and (d["filter"], d["seconds"]) == (kind, seconds)], kind, seconds)
    own = definitions.select("def_id", "name").distinct()
    out = rows.select(*FRAME, F.explode("__v").alias("name", "value")).join(small(own), ["def_id", "name"], "left_semi")
    return out, spark.createDataFrame(report, "def_id string, name string, code string")


def _value(name: str) -> Column:
    return F.try_element_at("__v", F.lit(name))


def _column(d) -> Column:
    if d["kind"] == "expression":
        return compile_expression(d["text"], {x: _value(x) for x in names_of(d["text"])})
    return looked_up(_value(d["input"]), F.try_element_at("__points", F.lit(d["table_id"])), F.lit(d["outside"]))


def _add(rows: DataFrame, columns: list[tuple[str, str, Column]]) -> DataFrame:
    """Puts finite values of ``(def_id, name, column)`` into the frames of their definition, in one projection."""
    made = F.array(*(F.struct(F.lit(name).alias("key"), F.when(F.col("def_id") == def_id, _finite(c)).alias("value")) for def_id, name, c in columns))
    return rows.withColumn("__v", F.map_concat("__v", F.map_from_entries(F.filter(made, lambda e: e["value"].isNotNull()))))


def _filtered(rows: DataFrame, definitions: list, kind: str, seconds: float) -> DataFrame:
    """Outputs of filters of one kind and time, over the frames that have their input."""
    inputs = F.array(*(F.struct(F.lit(d["name"]).alias("name"), F.when(F.col("def_id") == d["def_id"], _finite(_value(d["input"]))).alias("x")) for d in definitions))
    rows = written(rows)
    long = rows.select(*FRAME, F.explode(F.filter(inputs, lambda e: e["x"].isNotNull())).alias("e")).select(*FRAME, F.col("e.name").alias("name"), F.col("e.x").alias("value"))
    keys = ["def_id", "name", "source_id", "channel", "direction"]
    started = epochs(long, keys, "t_us")
    out = low_pass(started, keys, seconds) if kind == "low-pass" else moving_average(started, keys, seconds)
    made = out.groupBy("source_id", "ordinal", "def_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "y"))).alias("__made"))
    found = rows.join(made, ["source_id", "ordinal", "def_id"], "left")
    return found.withColumn("__v", F.when(F.col("__made").isNull(), F.col("__v")).otherwise(F.map_concat("__v", "__made"))).drop("__made")


def calculated_id(calculation: Column) -> Column:
    return F.concat(F.lit("calculated:"), F.replace(F.url_encode(calculation), F.lit("+"), F.lit("%20")))


def planned(samples: DataFrame, definitions: DataFrame, points: DataFrame) -> tuple[dict[int, list], dict, list]:
    """(stages of calculations, their signal ids, ``(id, code)`` of those left out) of ``calculate``: of the samples only the signals count."""
    spark = samples.sparkSession
    all_rows = [d for d in _rows(definitions, ["id"]) if d["enabled"]]
    ids = dict(zip([d["id"] for d in all_rows], [r[0] for r in spark.createDataFrame([(d["id"],) for d in all_rows], "id string").select(calculated_id(F.col("id"))).collect()])) if all_rows else {}
    known = {r["signal_id"] for r in _rows(samples.select("signal_id").distinct(), ["signal_id"])}
    tables = {r["table_id"] for r in points_of(points, "table_id").select("table_id").collect()}
    level = {s: 0 for s in known}
    waiting, report, stages = list(all_rows), [], {}
    for d in all_rows:
        uses = _uses(d)
        code = None
        if uses is None:
            code = "CALCULATION_EXPRESSION_INVALID"
        elif not uses <= set(d["inputs"]):
            code = "CALCULATION_VARIABLE_MISSING"
        elif d["kind"] == "lookup" and d["table_id"] not in tables:
            code = "CALCULATION_LOOKUP_MISSING"
        if code:
            report.append((d["id"], code))
            waiting.remove(d)
    fresh = True
    while fresh:
        fresh = [d for d in waiting if all(s in level for s in [*d["inputs"].values(), d["axis"]])]
        for d in fresh:
            at = 1 + max(level[s] for s in [*d["inputs"].values(), d["axis"]])
            level[ids[d["id"]]] = at
            stages.setdefault(at, []).append(d)
            waiting.remove(d)
    for d in waiting:
        # What is left waits for a signal that nobody gives, or for itself.
        mine = {ids[w["id"]] for w in waiting}
        lost = [s for s in [*d["inputs"].values(), d["axis"]] if s not in level and s not in mine]
        report.append((d["id"], "CALCULATION_INPUT_MISSING" if lost else "CALCULATION_CYCLE"))
    return stages, ids, report


_REPORT = "id string, code string"


def calculation_report(samples: DataFrame, definitions: DataFrame, points: DataFrame) -> DataFrame:
    """The report of ``calculate`` alone; nothing is calculated for it."""
    return samples.sparkSession.createDataFrame(planned(samples, definitions, points)[2], _REPORT)


def calculate(samples: DataFrame, definitions: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calculated samples, report) across signals by a table of calculations.

    ``samples``: ``source_id, signal_id, t_us, ordinal, value, ok`` (usable). ``definitions``: ``id, enabled, inputs map<name, signal_id>, axis`` (signal that gives
    the times), ``interpolation`` (``exact`` or ``linear``), ``kind`` (``expression`` with ``text``, or ``lookup`` with ``input, table_id, outside``). ``points``: ``table_id, input, output``.

    A result at each usable time of the axis at which every input has a sample: one of exactly that time, else, if linear, between its
    two usable neighbours, never beyond. A calculation may use others, named ``calculated:<id>``. Each stage is one as-of join of
    all its axis times with all its inputs, whatever the number of calculations. The report has ``id, code`` of calculations that are left
    out: on a cycle, behind a missing signal, or unreadable.
    """
    spark = samples.sparkSession
    stages, ids, report = planned(samples, definitions, points)
    columns = ["source_id", "signal_id", "t_us", "ordinal", "value", "ok"]
    series = samples.select(*columns)
    made = []
    arrays = points_of(points, "table_id")
    for at in sorted(stages):
        now = stages[at]
        dim = spark.createDataFrame([(ids[d["id"]], d["axis"], d["interpolation"] == "linear", dict(d["inputs"]), d["table_id"]) for d in now], "calc string, axis string, linear boolean, inputs map<string,string>, table_id string")
        axis = series.filter("ok").select("source_id", F.col("signal_id").alias("axis"), "t_us", "ordinal").join(small(dim), "axis")
        probes = axis.select("source_id", "t_us", "ordinal", "calc", "linear", F.explode("inputs").alias("name", "signal_id"))
        b, a, t = F.col("before"), F.col("after"), F.col("t_us")
        between = F.when(b["ok"] & a["ok"] & (b["t_us"] < a["t_us"]), b["value"] + (a["value"] - b["value"]) * ((t - b["t_us"]) / (a["t_us"] - b["t_us"])))
        x = F.when(b["t_us"] == t, F.when(b["ok"], b["value"])).otherwise(F.when(F.col("linear"), between))
        found = neighbours(probes, series, ["source_id", "signal_id"], "t_us", ["ordinal"]).withColumn("x", _finite(x))
        rows = found.groupBy("source_id", "calc", "t_us", "ordinal").agg(F.map_from_entries(F.collect_list(F.struct("name", "x"))).alias("__v"), F.min(F.col("x").isNotNull()).alias("whole"))
        rows = rows.filter("whole").join(small(dim.join(arrays, "table_id", "left").select("calc", "points")), "calc")
        value = F.lit(None).cast("double")
        for d in now:
            c = compile_expression(d["text"], {n: _value(n) for n in d["inputs"]}) if d["kind"] == "expression" else looked_up(_value(d["input"]), F.col("points"), F.lit(d["outside"]))
            value = F.when(F.col("calc") == ids[d["id"]], c).otherwise(value)
        got = rows.select("source_id", F.col("calc").alias("signal_id"), "t_us", "ordinal", _finite(value).alias("value"), F.lit(True).alias("ok")).filter("value is not null")
        got = written(got)
        made.append(got)
        series = series.unionByName(got)
    out = made[0] if made else samples.select(*columns).filter("false")
    for m in made[1:]:
        out = out.unionByName(m)
    return out, spark.createDataFrame(report, _REPORT)
