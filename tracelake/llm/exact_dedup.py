"""Exact deduplication: group by a 128-bit content hash, compare the bytes inside each group.

Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise


def content_hash(text: Column) -> Column:
    """128 bits of MD5, as 16 bytes."""
    return F.unhex(F.md5(text))


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _texts(rows: DataFrame) -> DataFrame:
    # Grouping by hash and text compares the bytes of equal hashes; copies collapse before the shuffle.
    return rows.groupBy("__hash", "__norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def assign_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Nulls and empty texts form one group. Equal texts keep the smallest id; rows that repeat an id
    and a text are kept or dropped together. A null id never wins against another id. An empty table
    gives an empty result; other columns of ``docs`` are not read. Texts that share a hash but not
    their bytes stay apart: when any such pair exists, rows meet their group by hash and text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("__norm"))
    rows = rows.withColumn("__hash", hash_of(F.col("__norm")))
    groups = materialise(_texts(rows).withColumn("text_sha256", F.sha2("__norm", 256)).drop("__norm"))
    keys = ["__hash"]
    if groups.groupBy("__hash").count().filter("count > 1").limit(1).count():
        groups = _texts(rows).withColumn("text_sha256", F.sha2("__norm", 256))
        keys = ["__hash", "__norm"]
    else:
        rows = rows.drop("__norm")
    out = rows.join(groups, keys)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return out.select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The semi-join key holds the id beside the hash, so a large group of copies is no hot key.
    """
    hashed = docs.withColumn("__norm_of_row", normalised(F.col(text_col)))
    rows = hashed.select(F.col(id_col).alias("doc_id"), F.col("__norm_of_row").alias("__norm"))
    keep = _texts(rows.withColumn("__hash", content_hash(F.col("__norm"))))
    keep = keep.select(F.col("keep_id").alias("__keep_id"), F.sha2("__norm", 256).alias("__keep_sha"))
    same = F.col(id_col).eqNullSafe(F.col("__keep_id")) & (F.sha2("__norm_of_row", 256) == F.col("__keep_sha"))
    return hashed.join(keep, same, "left_semi").drop("__norm_of_row")
