"""Number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_zeros(text: Column) -> Column:
    """Removes zeros behind a decimal point, and the point if nothing is left behind it."""
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")).otherwise(text)


def fixed(value: Column, digits: int) -> Column:
    """Up to ``digits`` decimals, zeros trimmed; ``-0`` reads ``0``."""
    text = trim_zeros(F.round(value.cast(f"decimal(38,{digits + 2})"), digits).cast(f"decimal(38,{digits})").cast("string"))
    return F.when(text == "-0", "0").otherwise(text)


def significant(value: Column, digits: int) -> Column:
    """``digits`` significant digits, zeros trimmed. Covers sizes from 1e-18 to 1e20; others keep Spark's text."""
    rounded = F.format_string(f"%.{digits - 1}e", value).try_cast("decimal(38,18)")
    return F.when(value == 0, "0").otherwise(F.coalesce(trim_zeros(rounded.cast("string")), value.cast("string")))


def csv_cell(text: Column) -> Column:
    """A cell of a CSV file: quoted, with its quotes doubled, if it holds a comma, a quote or a line break; empty for null."""
    plain = F.coalesce(text, F.lit(""))
    return F.when(plain.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain)
