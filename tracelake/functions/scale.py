"""Exact scaling of raw integers and parsing of scale texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import let

DECIMAL = "decimal(38,0)"


def _ten_to(places: Column) -> Column:
    """A power of ten as a decimal, null beyond 37 places."""
    return F.when(places.between(0, 37), F.concat(F.lit("1"), F.repeat(F.lit("0"), places))).try_cast(DECIMAL)


def scale_parts(text: Column) -> tuple[Column, Column]:
    """(numerator, denominator) of a scale text: an integer, decimal, exponent form or ``a/b``; null if it is none.

    Zero and sizes outside 1e-15 to 1e15 are refused. Decimals count up to 30 places below 1e8, else up to 20.
    """
    parts = let(F.trim(text), _parts)
    return parts["num"], parts["den"]


def _parts(t: Column) -> Column:
    """Numerator and denominator of a trimmed scale text; each step is computed once, and in no method too long to be compiled."""
    ratio = F.split(t, r"\s*/\s*")
    is_ratio = t.rlike(r"^[+-]?\d{1,38}\s*/\s*\d{1,38}$")
    plain = F.coalesce(t.try_cast("decimal(38,30)").cast("string"), t.try_cast("decimal(38,20)").cast("string"))

    def pair(short: Column) -> Column:
        num = F.when(is_ratio, F.get(ratio, F.lit(0)).try_cast(DECIMAL)).otherwise(F.replace(short, F.lit("."), F.lit("")).try_cast(DECIMAL))
        den = F.when(is_ratio, F.get(ratio, F.lit(1)).try_cast(DECIMAL)).otherwise(_ten_to(F.length(short) - F.instr(short, ".")))
        return F.struct(num.alias("num"), den.alias("den"))

    # The text without the zeros at its end; what it says is digits and where the point stands.
    made = let(F.regexp_replace(plain, r"0+$", ""), pair)
    return let(made, lambda p: F.when(F.abs(F.try_divide(p["num"].cast("double"), p["den"].cast("double"))).between(1e-15, 1e15), p))


def power_of_two(num: Column, den: Column) -> Column:
    """k where num/den is plus or minus 2**k, else null."""
    size = F.abs(num.cast("double"))
    k = F.round(F.log2(size / den.cast("double"))).cast("int")
    return F.when(size == den.cast("double") * F.pow(F.lit(2.0), k), k)


def _fraction(num: Column, den: Column) -> Column:
    """num/den of whole decimals as the nearest double; null where the digits do not suffice.

    A power of ten below is an exponent, and a decimal text with an exponent is read with one rounding. Other
    denominators divide a numerator that was widened to 31 digits.
    """
    n, d = num.cast("string"), den.cast("string")
    decimal = F.translate(d, "0", "") == "1"
    wide = F.greatest(F.lit(31) - F.length(n), F.lit(0))
    quotient = F.try_divide(F.try_multiply(num, _ten_to(wide)), den).cast("string")
    return F.when(decimal, F.concat(n, F.lit("E-"), F.length(d) - 1)).otherwise(F.concat(quotient, F.lit("E-"), wide)).try_cast("double")


def physical(raw: Column, num: Column, den: Column, offset_num: Column, offset_den: Column, k: Column | None = None) -> Column:
    """Value of a raw integer: scale, then offset, rounded once.

    A scale of plus or minus a power of two (``k``) shifts the integer, downwards with floor, before the
    sign and the offset; a shifted result beyond 2**53 - 1 is NaN. Otherwise raw * num / den + offset is
    one fraction of whole numbers; where its parts stay below 2**53 doubles are exact, else decimals
    are used. Only where a fraction needs more than 38 digits (raw, scale and offset together) is the result
    that of plain doubles.
    """
    k = power_of_two(num, den) if k is None else k
    n, d, o, od = (c.cast("double") for c in (num, den, offset_num, offset_den))
    r = raw.cast("double")
    limit = float(2**53)
    left, right = F.greatest(k, F.lit(0)), F.greatest(-k, F.lit(0))
    shifted = F.call_function("shiftright", F.call_function("shiftleft", raw, left), right).cast("double") * F.signum(n)
    too_large = F.abs(r) * F.pow(F.lit(2.0), k) >= limit
    by_shift = F.when(too_large, F.lit(float("nan"))).otherwise((shifted * od + o) / od)
    exact = (F.abs(r * n * od) + F.abs(o * d) < limit) & (d * od < limit)
    top = F.try_add(F.try_multiply(F.try_multiply(raw.cast(DECIMAL), num), offset_den), F.try_multiply(offset_num, den)).cast(DECIMAL)
    big = F.coalesce(_fraction(top, F.try_multiply(den, offset_den).cast(DECIMAL)), r * n / d + o / od)
    return F.when(k.isNotNull(), by_shift).when(exact, (r * n * od + o * d) / (d * od)).otherwise(big)
