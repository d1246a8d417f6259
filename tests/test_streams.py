"""Streams against plain versions, and restarts from a checkpoint."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tracelake.plans import streaming_queries as Q
from tracelake.storage import shared_folder
from tracelake.streaming import jobs as J


def plain_order(rows, lanes, most):
    """One heap for each source, asked after every frame."""
    out = []
    for source in sorted({r[0] for r in rows}):
        heap, reached, last, position = [], {}, None, 0
        marks = [r for r in sorted(rows, key=lambda r: r[3]) if r[0] == source]
        for step in [*marks, None]:
            if step:
                _, ordinal, t, arrival, lane = step
                heapq.heappush(heap, (t, arrival, ordinal))
                reached[lane] = t
            mark = float("inf") if step is None else min(reached[x] for x in lanes) if len(reached) == len(lanes) else float("-inf")
            while heap and (len(heap) > most or heap[0][0] <= mark):
                t, _, ordinal = heapq.heappop(heap)
                late = last is not None and t < last
                last = last if late else t
                out.append((source, ordinal, t, position, late))
                position += 1
    return sorted(out)


@pytest.fixture
def arrivals(spark):
    rnd = random.Random(12)
    lanes, rows, arrival = ["a", "b", "c"], [], 0
    clocks = {(s, lane): rnd.randrange(10**6) for s in ("x", "y") for lane in lanes}
    for ordinal in range(600):
        key = rnd.choice(list(clocks))
        clocks[key] += rnd.randrange(1, 3_000_000)
        arrival += rnd.randrange(1, 5)
        t = clocks[key] - (rnd.randrange(20_000_000) if rnd.random() < 0.05 else 0)
        rows.append((key[0], ordinal, max(0, t), arrival, key[1]))
    return lanes, rows


def as_stream(spark, rows, path, files):
    table = spark.createDataFrame([(*r, False) for r in rows], "source_id string, ordinal long, t_us long, arrival long, lane string, end boolean")
    ends = spark.createDataFrame([(s, None, None, 2**62, None, True) for s in ("x", "y")], table.schema)
    return J.delivered(table, "arrival", path, files, [ends])


@pytest.mark.parametrize("most, slice_us, files", [(65_536, 60_000_000, 5), (10, 2_000_000, 3), (3, 10**12, 1)])
def test_order_of_release(spark, arrivals, most, slice_us, files):
    Q._stateful(spark)
    lanes, rows = arrivals
    stream = J.release_in_order(as_stream(spark, rows, shared_folder(spark), files), lanes, most, slice_us)
    got = sorted(map(tuple, J.drain(stream, shared_folder(spark)).collect()))
    want = plain_order(rows, lanes, most)
    assert got == want and any(r[4] for r in want)


def test_restart(spark, arrivals):
    """Three files, a stop, the rest: the same as all at once."""
    Q._stateful(spark)
    lanes, rows = arrivals
    rows.sort(key=lambda r: r[3])
    path, out = shared_folder(spark), shared_folder(spark)
    table = spark.createDataFrame([(*r, False) for r in rows], "source_id string, ordinal long, t_us long, arrival long, lane string, end boolean")
    first = J.delivered(table.filter(F.col("arrival") <= rows[300][3]), "arrival", path, 3)
    half = J.drain(J.release_in_order(first, lanes, 10), out, again="one")
    assert 0 < half.count() < 301
    J.delivered(table.filter(F.col("arrival") > rows[300][3]), "arrival", path, 2, [spark.createDataFrame([(s, None, None, 2**62, None, True) for s in ("x", "y")], table.schema)])
    rest = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    whole = J.drain(J.release_in_order(rest, lanes, 10), out, again="one")
    assert sorted(map(tuple, whole.collect())) == plain_order(rows, lanes, 10)
