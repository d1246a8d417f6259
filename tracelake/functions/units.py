"""Units: rules by family, conversion, and which unit a set of signals shares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Families of units in the order of their axes (fixed values).
FAMILIES = (
    "length", "speed", "acceleration", "jerk", "angle", "angular-speed", "angular-acceleration", "rotational-speed", "mass", "force", "torque", "power", "energy",
    "pressure", "flow", "voltage", "current", "resistance", "capacitance", "time", "frequency", "area", "volume", "temperature", "percentage",
)
PREFIXES = {"n": 1e-9, "µ": 1e-6, "u": 1e-6, "m": 1e-3, "c": 1e-2, "": 1.0, "k": 1e3, "M": 1e6, "G": 1e9}
#: Family: canonical unit, SI symbols with their size in that unit, prefixes in use (fixed values).
SI = {
    "length": ("m", "m", 1.0, ("", "n", "µ", "u", "m", "c", "k")),
    "force": ("N", "N", 1.0, ("", "k")),
    "torque": ("Nm", "Nm N·m", 1.0, ("", "k")),
    "power": ("kW", "W", 1e-3, ("", "m", "k", "M")),
    "energy": ("kJ", "J", 1e-3, ("", "k", "M")),
    "pressure": ("kPa", "Pa", 1e-3, ("", "k", "M")),
    "voltage": ("V", "V", 1.0, ("", "µ", "u", "m", "k")),
    "current": ("A", "A", 1.0, ("", "µ", "u", "m", "k")),
    "resistance": ("Ω", "Ω ohm", 1.0, ("", "m", "k", "M")),
    "time": ("s", "s", 1.0, ("", "n", "µ", "u", "m")),
    "frequency": ("Hz", "Hz", 1.0, ("", "k", "M", "G")),
    "volume": ("L", "L", 1.0, ("", "m")),
    "speed": ("m/s", "m/s", 1.0, ("", "m", "c")),
    "acceleration": ("m/s²", "m/s²", 1.0, ("", "m", "c")),
    "jerk": ("m/s³", "m/s³", 1.0, ("", "m")),
}
#: Other unit texts of a family, apart by commas: canonical unit, texts, size in the canonical unit, offset (fixed values).
OTHER = {
    "length": ("m", ("meter,meters,metre,metres", 1.0), ("in,inch,inches", 0.0254), ("ft,feet", 0.3048), ("yd", 0.9144), ("mi,mile,miles", 1609.344)),
    "area": ("m²", ("m²,m2", 1.0), ("mm²", 1e-6), ("cm²", 1e-4), ("km²", 1e6), ("in²", 0.00064516), ("ft²", 0.09290304)),
    "volume": ("L", ("liter,liters,litre,litres", 1.0), ("cc,cm³", 1e-3), ("m³", 1e3), ("in³", 0.016387064), ("gal", 3.785411784)),
    "speed": ("m/s", ("m/sec,mps,meter/second,metre/second", 1.0), ("km/h,km/hr,kmh,kmph,kph", 1 / 3.6), ("mph", 0.44704), ("kn,knot,knots", 0.514444444)),
    "acceleration": ("m/s²", ("m/s2,m/sec²,mps2", 1.0), ("km/h/s", 1 / 3.6), ("g,G", 9.80665)),
    "jerk": ("m/s³", ("m/s3,mps3", 1.0)),
    "angle": ("deg", ("deg,degree,degrees,°", 1.0), ("rad,radian,radians", 180 / math.pi), ("mrad", 0.18 / math.pi)),
    "angular-speed": ("deg/s", ("deg/s,degree/s,degrees/s,°/s,deg/sec", 1.0), ("rad/s,radian/s,radians/s", 180 / math.pi)),
    "rotational-speed": ("rpm", ("rpm,rev/min,r/min", 1.0), ("rps,rev/s", 60.0)),
    "angular-acceleration": ("deg/s²", ("deg/s²,degree/s²,°/s²", 1.0), ("rad/s²", 180 / math.pi)),
    "time": ("s", ("sec,second,seconds", 1.0), ("microsecond,microseconds", 1e-6), ("millisecond,milliseconds", 1e-3), ("min,minute,minutes", 60.0), ("h,hr,hour,hours", 3600.0)),
    "frequency": ("Hz", ("hertz", 1.0)),
    "mass": ("kg", ("kg,kilogram,kilograms", 1.0), ("gram,grams", 1e-3), ("mg", 1e-6), ("tonne,tonnes", 1e3), ("lb,lbs", 0.45359237)),
    "force": ("N", ("newton,newtons", 1.0), ("kgf", 9.80665), ("lbf", 4.4482216153)),
    "torque": ("Nm", ("N*m,N m,newton-meter,newton-metre", 1.0), ("kgf·m,kgf*m", 9.80665), ("lb-ft,ft-lb,lbf·ft", 1.3558179483)),
    "pressure": ("kPa", ("pascal,pascals", 1e-3), ("hPa,mbar", 0.1), ("bar", 100.0), ("psi", 6.894757293), ("mmHg", 0.1333223874), ("inHg", 3.386389)),
    "power": ("kW", ("watt,watts", 1e-3), ("hp", 0.745699872), ("PS", 0.73549875)),
    "energy": ("kJ", ("joule,joules", 1e-3), ("Wh", 3.6), ("kWh", 3600.0), ("cal", 0.004184), ("kcal", 4.184)),
    "flow": ("L/min", ("L/min", 1.0), ("L/s", 60.0), ("mL/min", 1e-3), ("m³/s", 60000.0), ("m³/h", 1000 / 60), ("gal/min", 3.785411784)),
    "voltage": ("V", ("volt,volts", 1.0)),
    "current": ("A", ("amp,amps,ampere,amperes", 1.0)),
    "resistance": ("Ω", ("ohms", 1.0)),
    "capacitance": ("µF", ("µF,uF", 1.0), ("nF", 1e-3), ("pF", 1e-6), ("mF", 1e3), ("F,farad,farads", 1e6)),
    "temperature": ("°C", ("°C,C,degC,celsius", 1.0), ("K,kelvin", 1.0, -273.15), ("°F,Fahrenheit", 5 / 9, -160 / 9)),
    "percentage": ("%", ("%,percent,percentage", 1.0), ("‰,permille", 0.1), ("ppm", 1e-4)),
}


def normal(unit: Column) -> Column:
    """Trimmed, single spaces, one sign each for micro and the product dot."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.trim(unit), r"\s+", " "), "μ⋅∙", "µ··"), "^$", "")


def unit_rules(spark: SparkSession) -> DataFrame:
    """``unit, family, axis, canonical, scale, shift`` of every known unit text; a small dimension.

    Squares and cubes may also be written with ``^``.
    """
    rows = [(p + symbol, family, canonical, PREFIXES[p] * size, 0.0) for family, (canonical, symbols, size, prefixes) in SI.items() for symbol in symbols.split(" ") for p in prefixes]
    for family, (canonical, *groups) in OTHER.items():
        for texts, size, *shift in groups:
            rows += [(u, family, canonical, size, shift[0] if shift else 0.0) for u in texts.split(",")]
    rows += [(u.replace("²", "^2").replace("³", "^3"), *rest) for u, *rest in rows if "²" in u or "³" in u]
    rows = [(u, family, FAMILIES.index(family), canonical, scale, shift) for u, family, canonical, scale, shift in rows]
    return spark.createDataFrame(rows, "unit string, family string, axis int, canonical string, scale double, shift double")


RULE = ("family", "axis", "canonical", "scale", "shift")


def resolve(rows: DataFrame, unit_col: str, prefix: str = "") -> DataFrame:
    """Adds family, its place among the axes, canonical unit, scale and shift: by exact case, else by folded case where that is unambiguous."""
    rules = unit_rules(rows.sparkSession)
    exact = F.broadcast(rules.select(F.col("unit").alias("__u"), F.struct(*RULE).alias("__exact")))
    folded = rules.groupBy(F.lower("unit").alias("__f")).agg(F.count_distinct("family", "scale", "shift").alias("n"), F.first(F.struct(*RULE)).alias("__folded")).filter("n = 1").drop("n")
    text = normal(F.col(unit_col))
    out = rows.join(exact, text == F.col("__u"), "left").join(F.broadcast(folded), F.lower(text) == F.col("__f"), "left")
    rule = F.coalesce("__exact", "__folded")
    return out.select(*rows.columns, *[rule[c].alias(prefix + c) for c in RULE])


def convert(rows: DataFrame, value: str, source: str, target: str | None = None) -> DataFrame:
    """``converted``: the value in the target unit where both units are of one family, else as it was.

    Without a target the canonical unit of the source's family is the target; then ``shown_unit`` names it.
    """
    resolved = resolve(rows, source, "s_")
    canonical = F.col(value) * F.col("s_scale") + F.col("s_shift")
    if target is None:
        known = F.col("s_family").isNotNull()
        return resolved.select(*rows.columns, F.when(known, canonical).otherwise(F.col(value)).alias("converted"), F.when(known, F.col("s_canonical")).otherwise(F.col(source)).alias("shown_unit"))
    both = resolve(resolved, target, "t_")
    known = F.col("s_family") == F.col("t_family")
    out = (canonical - F.col("t_shift")) / F.col("t_scale")
    same = normal(F.col(source)) == normal(F.col(target))
    return both.select(*rows.columns, F.when(known & ~same, out).otherwise(F.col(value)).alias("converted"))


def preferred(rows: DataFrame, keys: list[str], unit_col: str, order: str) -> DataFrame:
    """Unit of each group: its own where all agree, the family's canonical one where all are of a family, else the first."""
    r = resolve(rows.filter(F.trim(unit_col) != ""), unit_col)
    g = r.groupBy(*keys).agg(
        F.count_distinct(normal(F.col(unit_col))).alias("n"), F.min_by(unit_col, order).alias("first_unit"), F.count_distinct("family").alias("families"),
        F.min(F.col("family").isNotNull()).alias("known"), F.first("canonical", True).alias("canonical"),
    )
    return g.select(*keys, F.when(F.col("n") == 1, F.col("first_unit")).when((F.col("families") == 1) & F.col("known"), F.col("canonical")).otherwise(F.col("first_unit")).alias("unit"))


#: Names of families that are not just their words (fixed values).
FAMILY_NAMES = {"length": "Distance / length", "flow": "Flow rate", "percentage": "Ratio"}


def unit_groups(rows: DataFrame, unit_col: str) -> DataFrame:
    """Adds ``group_key, group_label, group_order`` of the axis that a unit belongs to.

    Units of a family share an axis; any other text has one of its own, whatever its case; no unit, or a blank
    one, is ``empty``. Families come first in the order of their axes, then other texts, then no unit.
    """
    taken = "__g_"
    r = resolve(rows, unit_col, taken)
    family, text = F.col(f"{taken}family"), F.trim(F.coalesce(F.col(unit_col), F.lit("")))
    words = F.translate(family, "-", " ")
    name = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))
    for key, given in FAMILY_NAMES.items():
        name = F.when(family == key, given).otherwise(name)
    known = family.isNotNull()
    return r.withColumns({
        "group_key": F.when(known, F.concat(F.lit("family:"), family)).when(text != "", F.concat(F.lit("unit:"), F.lower(text))).otherwise("empty"),
        "group_label": F.when(known, name).when(text != "", text).otherwise("No unit"),
        "group_order": F.when(known, F.col(f"{taken}axis")).when(text != "", 10_000).otherwise(20_000),
    }).drop(*[taken + c for c in RULE])
