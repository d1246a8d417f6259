"""Grouped findings and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decode import small
from .ranges import Ranged

GROUP = ["source", "code", "owner", "def_id", "signal_id", "message"]
MAX_GROUPS = 5_000


def tally(findings: DataFrame, max_groups: int = MAX_GROUPS) -> DataFrame:
    """Groups of equal findings with count, first and last position, in order of first position.

    Groups beyond ``max_groups``, by first appearance (``seq``), are merged per code, owner and
    definition. The ranking runs over the groups, not over the findings, in ranges of ``seq`` where they are very many.
    """
    g = findings.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("count"), F.min("position").alias("first"), F.max("position").alias("last"), F.min("seq").alias("seq"))
    g = Ranged(g, [], ("seq", *GROUP)).position("__place").done()
    over = F.col("__place") >= max_groups
    g = g.withColumn("signal_id", F.when(over, "*").otherwise(F.col("signal_id"))).withColumn("message", F.when(over, "(grouped)").otherwise(F.col("message")))
    return g.groupBy(*GROUP).agg(F.sum("count").alias("count"), F.min("first").alias("first"), F.max("last").alias("last"))


def replace_findings(groups: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Takes out the definition findings of re-analysed definitions and puts the fresh ones in."""
    stale = F.col("source") == "definition"
    kept = groups.filter(stale).join(small(changed.select("def_id").distinct()), "def_id", "left_anti").unionByName(groups.filter(~stale))
    return kept.unionByName(fresh)


def sorted_table(rows: DataFrame, tables: list[str], column: Column, row: str = "ordinal", descending: bool = False) -> DataFrame:
    """``place`` of each row when a table is sorted by any column: missing last in both directions, ties in order of rows.

    A table with very many rows is sorted in ranges of the column.
    """
    key = F.when(~F.isnan(column.cast("double")), column.cast("double"))
    key = -key if descending else key
    r = Ranged(rows.withColumns({"__missing": key.isNull().cast("int"), "__key": key}).withColumn("__sort", F.coalesce("__key", F.lit(float("inf")))), tables, ("__sort", "__missing", row))
    out = r.position("__place").done()
    return out.withColumn("place", (F.col("__place") + 1).cast("int")).drop("__missing", "__key", "__sort", "__place")


def label_dictionary(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first label of each signal and value, rows whose own label differs from it, also by having none)."""
    first = cells.filter("label is not null").groupBy("signal_id", "value").agg(F.min_by("label", "row").alias("label"))
    odd = cells.alias("c").join(first.alias("d"), ["signal_id", "value"]).filter("not (c.label <=> d.label)").select("signal_id", "row", F.col("c.label").alias("own"))
    return first, odd


def add_series(rows: DataFrame, series: DataFrame) -> DataFrame:
    """A series put into the rows of exactly its times, k-th with k-th; samples without such a row get one of their own."""
    def k(df):
        return df.withColumn("k", F.row_number().over(Window.partitionBy("t_us").orderBy("ordinal"))).drop("ordinal")

    return k(rows).join(k(series), ["t_us", "k"], "full")
