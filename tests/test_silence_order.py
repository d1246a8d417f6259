"""Silences when ids do not follow time."""

from pyspark.sql import functions as F

from tracelake.plans import streaming_queries as Q
from tracelake.storage import shared_folder


def test_ids_against_time(spark, sf_dir, duck):
    path = shared_folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("event_id", 10**6 - F.col("event_id")).write.parquet(f"{path}/events.parquet")
    want = duck.sql(Q_SQL).fetchall()
    assert sorted(map(tuple, Q.silent(spark, path).select("user_id", "last_ms", "silent_ms").collect())) == sorted(want) and want


Q_SQL = """WITH g AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS nxt, 1800000 * (1 + user_id % 3) AS p, max(epoch_us(ts)) OVER () // 1000 AS finish FROM events)
 SELECT user_id, ms, ms + 3 * p FROM g WHERE coalesce(nxt, finish) - ms > 3 * p"""
