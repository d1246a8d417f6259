"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters, and runs of anything else.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session leaves it unset (tests) a temporary folder is used; on a cluster other
    executors could not read such a folder, so there an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage with files that outlive any executor; readers prune columns. ``discard`` removes
    the files of tables that no later step reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialise``; nothing may read them afterwards."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when ``df`` is seen to hold at most ``max_rows`` rows.

    Beyond that the plain frame is returned and the join shuffles (AQE splits hot keys).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def id_remainder(column: str, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows: of each of ``rows`` buckets of hashed keys the row with the smallest hash.

    Buckets are combined before the shuffle, so no task sends more than ``rows`` rows on, and every
    size of table is sampled alike.
    """
    h = F.xxhash64(F.col(key).cast("string"))
    best = df.groupBy(F.pmod(h, F.lit(rows)).alias("__bucket")).agg(F.min(F.struct(h.alias("__h"), *df.columns)).alias("__row"))
    return best.select(*[F.col(f"__row.{c}").alias(c) for c in df.columns])


def fingerprint(df: DataFrame) -> tuple:
    """Row count and an order-free digest of a frame, for convergence tests."""
    row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first()
    return tuple(row)


#: Rows of a node are dealt over so many keys where edges meet their node's minimum, so that a star is no hot key.
STAR_SALT = 16


def _with_minimum(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """``edges(u, v)`` with the ``m`` of their node ``u``; the minima, a row a node, are repeated for each salt."""
    salted = minima.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(STAR_SALT - 1))))
    own = F.pmod(F.xxhash64("v"), F.lit(STAR_SALT)).cast("int")
    return edges.withColumn("__salt", own).join(salted, ["u", "__salt"]).drop("__salt")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Component of each node of ``edges(a, b)``: ``(node, root)``, root the smallest node.

    Alternates large-star and small-star steps (each is a grouped minimum and a salted join on the node)
    until the edge set stands still; every round is written to the shared folder and the one before deleted. Loops and
    repeated edges are harmless; an empty edge table gives an empty result.
    """
    links = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    )
    seen = fingerprint(links)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_minimum(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_minimum(large, low).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, links = links, materialise(small.union(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct())
        discard(old)
        now = fingerprint(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(links.select(F.col("v"), F.col("v")).distinct())
