"""Columns that later filters must not compute again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, computed once a row.

    A filter on a plain column is pushed below it and repeats its expression for every use. The columns
    come out of a one-row generator instead, which no filter passes.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    out = df.select(*df.columns, made.alias("__made"))
    return out.select(*kept, *[F.col(f"__made.{n}").alias(n) for n in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it.

    A plain column is copied into every place it is used, so nested uses multiply. The variable of a lambda is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
