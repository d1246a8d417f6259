"""Conversions of raw measured values: a dimension of linked conversions becomes one program per channel.

A conversion may name others for values or ranges, several deep. The links are followed over the dimension, not over samples: each channel
gets its cases in order, each with the conditions on the raw value that lead to it and the conversion at its end. A
sample then takes the first case whose conditions hold. Formulas become rows of stack operations, so the plan is the same
whatever the number of channels and formulas.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import with_computed
from ..operators.decode import small
from ..storage import written
from . import measured as M

#: Levels of conversions that name others, below the channel's own.
MOST_LINKS = 8
KINDS = ("identity", "linear", "rational", "rational3", "formula", "formula3", "interpolated", "nearest", "ranges")
#: Numbers that each kind needs in ``p``.
PARAMETERS = {"linear": 2, "rational": 6, "rational3": 6}
PROGRAM = "array<struct<op:string,v:double>>"
_TOKEN = re.compile(r"\s*(?:((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(\*\*|[-+*/^()])|([xX]))")
#: How tightly an operator binds; ``~`` is the sign, looser than a power and tighter than a product.
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "~": 3, "^": 4}


def program_of(text: str | None) -> list[tuple[str, float | None]] | None:
    """Stack operations of a formula in X: ``n`` number, ``x``, ``~`` sign, ``+ - * / ^``; None if it cannot be read.

    Signs bind looser than powers (-X^2 is -(X^2)), and powers group to the right.
    """
    out: list[tuple[str, float | None]] = []
    held: list[str] = []
    at, operand = 0, False
    text = (text or "").rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        number, sign, x = m.groups()
        if number or x:
            if operand:
                return None
            out.append(("n", float(number)) if number else ("x", None))
            operand = True
        elif sign == "(":
            if operand:
                return None
            held.append("(")
        elif sign == ")":
            if not operand:
                return None
            while held and held[-1] != "(":
                out.append((held.pop(), None))
            if not held:
                return None
            held.pop()
        elif not operand:
            if sign not in "+-":
                return None
            if sign == "-":
                held.append("~")
        else:
            sign = "^" if sign == "**" else sign
            while held and held[-1] != "(" and (_BINDS[held[-1]] > _BINDS[sign] or _BINDS[held[-1]] == _BINDS[sign] and sign != "^"):
                out.append((held.pop(), None))
            held.append(sign)
            operand = False
    if not operand or "(" in held:
        return None
    return out + [(op, None) for op in reversed(held)]


def _programs(texts: Column) -> Column:
    """Over the dimension only: a row for each conversion."""

    def read(texts: pd.Series) -> pd.Series:
        found = [program_of(t) for t in texts]
        return pd.Series([None if p is None else [{"op": op, "v": v} for op, v in p] for p in found], dtype=object)

    return F.pandas_udf(read, PROGRAM)(texts)


def run_program(program: Column, x: Column) -> Column:
    """Value of stack operations; a division by 0 goes on as an infinity, as doubles do."""

    def step(stack: Column, o: Column) -> Column:
        a, b = F.try_element_at(stack, F.lit(-2)), F.try_element_at(stack, F.lit(-1))
        quotient = F.when(b == 0, F.signum(a) * float("inf")).otherwise(F.try_divide(a, b))
        two = F.when(o["op"] == "+", a + b).when(o["op"] == "-", a - b).when(o["op"] == "*", a * b).when(o["op"] == "/", quotient).otherwise(F.pow(a, b))
        n = F.size(stack)
        return (
            F.when(o["op"] == "n", F.concat(stack, F.array(o["v"]))).when(o["op"] == "x", F.concat(stack, F.array(x)))
            .when(o["op"] == "~", F.concat(F.slice(stack, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(-b)))
            .otherwise(F.concat(F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(two)))
        )

    return F.aggregate(program, F.array().cast("array<double>"), step, lambda s: F.try_element_at(s, F.lit(-1)))


def programs(conversions: DataFrame, key: str = "conversion_id") -> DataFrame:
    """``key, is_float, readable, cases`` for each conversion.

    ``conversions``: ``kind`` (one of ``KINDS``, or ``nested``), ``p array<double>``, ``text``, ``points array<struct<input, output>>``, ``ranges array<struct<lo, hi, value>>``,
    ``is_float``, ``fallback``, and for nested ones ``refs array<struct<lo, hi, exact, ref>>`` and ``fallback_ref``; a null ``ref`` stands for a text, which leaves the value.
    A channel is unreadable if anything it may lead to is: an unknown kind, too few parameters, a formula that is none, a conversion that nobody has, or links deeper than ``MOST_LINKS``
    (so also links in a circle). A case has ``place`` (its order), ``tests`` and ``leaf``.
    """
    formula = F.col("kind").isin("formula", "formula3")
    text = F.when(F.col("kind") == "formula3", F.regexp_replace("text", r"(?i)\bx1\b", "X")).otherwise(F.col("text"))
    dim = conversions.withColumn("program", F.when(formula, _programs(F.when(formula, text))))
    enough = F.lit(True)
    for kind, n in PARAMETERS.items():
        enough = enough & F.when(F.col("kind") == kind, F.coalesce(F.size("p") >= n, F.lit(False))).otherwise(True)
    tables = F.when(F.col("kind").isin("interpolated", "nearest"), F.coalesce(F.size("points") > 0, F.lit(False))).otherwise(True)
    readable = F.col("kind").isin(*KINDS) & enough & tables & F.when(formula, F.col("program").isNotNull()).otherwise(True)
    dim = written(dim.withColumn("readable", F.coalesce(readable, F.lit(False))))
    leaf = F.struct("kind", "p", "program", "points", "ranges", "fallback")
    nodes = dim.select(F.col(key).alias("node"), F.col("kind").alias("__kind"), "refs", "fallback_ref", "readable", leaf.alias("leaf"))
    no_tests = F.from_json(F.lit("[]"), "array<struct<lo:double,hi:double,exact:boolean>>")
    todo = dim.select(F.col(key).alias("root"), F.col(key).alias("node"), F.array().cast("array<int>").alias("place"), no_tests.alias("tests"))
    ends = []
    for _ in range(MOST_LINKS + 1):
        now = written(todo.join(small(nodes), "node", "left"))
        nested = F.coalesce(F.col("__kind") == "nested", F.lit(False))
        ends.append(now.filter(~nested).select("root", "place", "tests", F.coalesce("readable", F.lit(False)).alias("readable"), "leaf"))
        always = F.struct(F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("exact"), F.col("fallback_ref").alias("ref"))
        typed = F.transform(F.coalesce("refs", F.array()), lambda r: F.struct(r["lo"].cast("double").alias("lo"), r["hi"].cast("double").alias("hi"), r["exact"].alias("exact"), r["ref"].alias("ref")))
        links = now.filter(nested).select("root", "place", "tests", F.posexplode(F.concat(typed, F.array(always))).alias("i", "link"))
        links = links.select("root", F.concat("place", F.array("i")).alias("place"), F.concat("tests", F.array(F.struct("link.lo", "link.hi", "link.exact"))).alias("tests"), F.col("link.ref").alias("node"))
        same = F.struct(F.lit("identity").alias("kind"), *[F.lit(None).cast(nodes.schema["leaf"].dataType[c].dataType).alias(c) for c in ("p", "program", "points", "ranges", "fallback")])
        ends.append(links.filter("node is null").select("root", "place", "tests", F.lit(True), same))
        todo = written(links.filter("node is not null").select("root", "node", "place", "tests"))
        if not todo.limit(1).count():
            break
    cases = ends[0]
    for e in ends[1:]:
        cases = cases.union(e)
    per = cases.groupBy("root").agg(F.min("readable").alias("readable"), F.array_sort(F.collect_list(F.struct("place", "tests", "leaf")), lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)).alias("cases"))
    deep = todo.select("root").distinct().withColumn("__deep", F.lit(True))
    out = dim.select(F.col(key).alias("root"), "is_float").join(per, "root").join(deep, "root", "left")
    return written(out.select(F.col("root").alias(key), "is_float", (F.col("readable") & F.col("__deep").isNull()).alias("readable"), "cases"))


def apply_leaf(x: Column, leaf: Column, is_float: Column) -> Column:
    p = [F.get(leaf["p"], F.lit(i)) for i in range(6)]
    kind = leaf["kind"]
    moved = x - p[4] - p[5]
    y = F.when(kind == "identity", x).when(kind == "linear", M.linear(x, p[0], p[1])).when(kind == "rational", M.rational(x, p))
    y = y.when(kind == "rational3", F.try_divide(p[1] - p[3] * moved, p[2] * moved - p[0])).when(kind.isin("formula", "formula3"), run_program(leaf["program"], x))
    y = y.when(kind == "interpolated", M.table_interpolated(x, leaf["points"])).when(kind == "nearest", M.table_nearest(x, leaf["points"]))
    y = y.when(kind == "ranges", M.range_value(x, leaf["ranges"], is_float, leaf["fallback"]))
    return F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y)


def convert(rows: DataFrame, conversions: DataFrame, x: str = "raw", key: str = "conversion_id") -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``y``, ``key`` of unreadable conversions). Rows of unreadable channels are left out, those without a conversion keep their value.

    ``y`` is null where the result is not finite.
    """
    dim = programs(conversions, key)
    known = dim.select(F.col(key).alias("__key"), F.col("is_float").alias("__float"), "readable", "cases")
    found = rows.join(small(known), F.col(key) == F.col("__key"), "left").filter("readable is null or readable")
    v = F.col(x).cast("double")
    real = F.coalesce("__float", F.lit(False))

    def holds(t: Column) -> Column:
        within = (v >= t["lo"]) & F.when(real, v < t["hi"]).otherwise(v <= t["hi"])
        return t["lo"].isNull() | F.coalesce(F.when(t["exact"], v == t["lo"]).otherwise(within), F.lit(False))

    case = F.get(F.filter("cases", lambda c: F.forall(c["tests"], holds)), F.lit(0))
    found = with_computed(found, {"__leaf": case["leaf"]})
    y = F.when(F.col("__key").isNull(), v).otherwise(apply_leaf(v, F.col("__leaf"), real))
    return found.withColumn("y", y).drop("__key", "__float", "readable", "cases", "__leaf"), dim.filter("not readable").select(key)
