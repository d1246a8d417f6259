"""Structured Streaming jobs over frames that keep arriving."""

from __future__ import annotations

import heapq
import math
import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.plugins import OUTPUT, frame_outputs, output_rows


#: Frames of a source that may wait for their turn; beyond that the earliest are released ahead of the watermark.
MOST_WAITING = 65_536


def arriving(spark: SparkSession, sf_dir: str, path: str, files: int = 5) -> DataFrame:
    """The event table as a stream that gets one file after the other, in order of its ids: a micro-batch for each."""
    return delivered(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", path, files)


def delivered(table: DataFrame, order: str, path: str, files: int = 5, ends: Sequence[DataFrame] = ()) -> DataFrame:
    """A table as a stream of files that appear one after the other, in the order of a whole number; each of ``ends`` comes behind as its own file.

    A micro-batch reads one file, so what a batch holds of one key is bounded by a file.
    """
    bounds = table.agg(F.min(order), F.max(order) + 1).first()
    low, high = (bounds[0] or 0, bounds[1] or 1)
    part = F.floor((F.col(order) - low) * files / (high - low))
    for i in range(files):
        # One folder in which files appear later and later, as a logger would write them.
        table.filter(part == i).coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(path)
    for end in ends:
        end.select(*table.columns).coalesce(1).write.mode("append").parquet(path)
    return table.sparkSession.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def as_frames(stream: DataFrame) -> DataFrame:
    return stream.select(
        F.concat(F.lit("log"), F.col("user_id") % 4).alias("source_id"), F.col("event_id").alias("ordinal"), F.col("ts").cast("timestamp").alias("at"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "event_type", "value", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
        *[c for c in ("arrival", "end") if c in stream.columns],
    )


def drain(stream: DataFrame, path: str, mode: str = "append", again: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote, as a table in the shared folder.

    A run that is given the name of an earlier one in ``again`` goes on from its checkpoint and adds to its output.
    """
    spark = stream.sparkSession
    name = again or uuid.uuid4().hex
    out, state = f"{path}/{name}/out", f"{path}/{name}/state"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        # Each batch's rows are written with its number, so that the last state of a key can be told.
        query = writer.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    return spark.read.schema(spark.read.parquet(out).schema).parquet(out)


#: Microseconds of frames that wait in one piece of state.
SLICE_US = 60_000_000


def release_in_order(frames: DataFrame, lanes: list[str], most: int = MOST_WAITING, slice_us: int = SLICE_US) -> DataFrame:
    """Frames of each source put back into time order: ``source_id, ordinal, t_us, position, late``.

    Each lane (a bus, a kind of frame) comes in order, but lanes come apart. A frame is released once every one of ``lanes`` has
    reached its time, or while more than ``most`` wait, or when the source ends. ``position`` counts the releases of a
    source; a frame released after a later one is ``late``. ``frames`` has ``source_id, ordinal, t_us, lane``, ``arrival``, a number that
    grows, and ``end``: a row with it true says that no more frames of its source will come. There is no watermark, so none is dropped.

    Waiting frames lie in slices of time, one entry of a map state each; a release reads the slices it passes and no other, and
    the times that lanes have reached are a second map. A list of the slices in use is all that is read each time.
    """

    class Reorder(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.slices = handle.getMapState("waiting", "slice bigint", "rows binary")
            self.reached = handle.getMapState("reached", "lane string", "t_us bigint")
            self.now = handle.getValueState("now", "position bigint, last_us bigint, waiting bigint, slices array<bigint>")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            fresh = sorted((x for batch in rows for x in batch[["arrival", "t_us", "ordinal", "lane", "end"]].itertuples(index=False, name=None)), key=lambda x: x[0])
            position, last, waiting, known = self.now.get() if self.now.exists() else (0, None, 0, [])
            known = {int(k) for k in known}
            # Only slices of earlier batches lie in the state; most others come and go within a batch and never touch it.
            stored = set(known)
            reached = {lane: int(self.reached.getValue((lane,))[0]) for lane in lanes if self.reached.containsKey((lane,))}
            heaps: dict[int, list[tuple[int, int, int]]] = {}
            out: list[tuple] = []

            def heap_of(k: int) -> list:
                if k not in heaps:
                    heaps[k] = pickle.loads(bytes(self.slices.getValue((k,))[0])) if k in stored and self.slices.containsKey((k,)) else []
                    known.add(k)
                return heaps[k]

            def release(mark: int | None) -> None:
                """Up to a time; up to the bound of waiting frames without one."""
                nonlocal position, last, waiting
                while waiting and known:
                    k = min(known)
                    if waiting <= most and (mark is None or k > mark // slice_us):
                        return
                    heap = heap_of(k)
                    while heap and (waiting > most or mark is not None and heap[0][0] <= mark):
                        t, _, ordinal = heapq.heappop(heap)
                        late = last is not None and t < last
                        out.append((key[0], ordinal, t, position, late))
                        position, last, waiting = position + 1, t if not late else last, waiting - 1
                    if heap:
                        return
                    known.discard(k)
                    heaps.pop(k)
                    if k in stored:
                        stored.discard(k)
                        self.slices.removeKey((k,))

            for arrival, t, ordinal, lane, end in fresh:
                if end:
                    release(2**62)
                    continue
                t = int(t)
                heapq.heappush(heap_of(t // slice_us), (t, int(arrival), int(ordinal)))
                waiting += 1
                reached[lane] = t
                release(min(reached[x] for x in lanes) if all(x in reached for x in lanes) else None)
            for k, heap in heaps.items():
                self.slices.updateValue((k,), (pickle.dumps(heap),))
            for lane, t in reached.items():
                self.reached.updateValue((lane,), (t,))
            self.now.update((position, last, waiting, sorted(known)))
            yield pd.DataFrame(out, columns=["source_id", "ordinal", "t_us", "position", "late"])

        def close(self) -> None:
            pass

    return frames.groupBy("source_id").transformWithStateInPandas(Reorder(), "source_id string, ordinal bigint, t_us bigint, position bigint, late boolean", "append", "None")


def low_pass_stream(frames: DataFrame, keys: list[str], tau: float) -> DataFrame:
    """The low-pass filter over a stream: the last output and time of each key live on from batch to batch."""
    key_schema = ", ".join(f"{k} {dict(frames.dtypes)[k]}" for k in keys)

    class LowPass(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "t_us bigint, y double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            last = self.last.get() if self.last.exists() else None
            batches = pd.concat(list(rows)).sort_values("ordinal")
            out = []
            for row in batches.itertuples(index=False):
                if last is None or row.t_us <= last[0]:
                    y = row.value
                else:
                    a = math.exp(-(row.t_us - last[0]) / 1e6 / tau)
                    y = a * last[1] + (1 - a) * row.value
                last = (int(row.t_us), float(y))
                out.append((*key, row.ordinal, y))
            self.last.update(last)
            yield pd.DataFrame(out, columns=[*keys, "ordinal", "y"])

        def close(self) -> None:
            pass

    return frames.groupBy(*keys).transformWithStateInPandas(LowPass(), f"{key_schema}, ordinal bigint, y double", "append", "None")


def session_stream(routed: DataFrame, make_session: Callable) -> DataFrame:
    """Plugin sessions over a stream of routed frames: outputs as of ``operators.plugins.run_stateful``.

    A session belongs to a source and a plugin. It lives on from batch to batch as its pickled self, so a session is an
    object that can be pickled and is called with ``(data, row)``; frames of a batch come to it in order of arrival.
    """
    class Session(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getValueState("session", "pickled binary")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            session = pickle.loads(bytes(self.kept.get()[0])) if self.kept.exists() else make_session()
            batch = pd.concat(list(rows)).sort_values(["ordinal", "binding_id"])
            out = [x for row in batch.itertuples(index=False) for x in frame_outputs(row, session)]
            self.kept.update((pickle.dumps(session),))
            yield output_rows(out)

        def close(self) -> None:
            pass

    return routed.groupBy("source_id", "plugin_id").transformWithStateInPandas(Session(), OUTPUT, "append", "None")


def silent_keys(frames: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """A row ``last_ms, silent_ms`` whenever a key has been silent for three of its own periods.

    ``frames`` has the ``period_ms`` that belongs to each key, joined to its rows, and ``end``: a row with it true ends its key at its
    time, so a silence that is still open then is told too. Between frames event-time timers tell a silence as soon as
    the watermark has passed it. Rows with a null period are watched by nobody.
    """
    key_schema = ", ".join(f"{k} {dict(frames.dtypes)[k]}" for k in keys)

    class Silence(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "ms bigint, period_ms bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # Keys are many and short: each question to the state, and each table made, counts.
            times = sorted((int(t) // 1000, bool(end), int(p)) for b in rows for t, end, p in zip(b["t_us"], b["end"], b["period_ms"]))
            last, period = self.last.get() or (None, None)
            # A key with a state has one timer, and a key without has none.
            timer = None if last is None else last + 3 * period + 1
            out, ended = [], False
            for t, end, period in times:
                if last is not None and t - last > 3 * period:
                    out.append((*key, last, last + 3 * period))
                ended = end
                last = None if end else t if last is None else max(last, t)
            after = None if ended or last is None else last + 3 * period + 1
            if timer is not None and timer != after:
                self.handle.deleteTimer(timer)
            if after is not None:
                self.last.update((last, period))
                if timer != after:
                    self.handle.registerTimer(after)
            elif timer is not None:
                self.last.clear()
            if out:
                yield pd.DataFrame(out, columns=[*keys, "last_ms", "silent_ms"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            last, period = self.last.get()
            self.last.clear()
            yield pd.DataFrame([(*key, last, last + 3 * period)], columns=[*keys, "last_ms", "silent_ms"])

        def close(self) -> None:
            pass

    stream = frames.filter("period_ms is not null").withWatermark("at", delay)
    return stream.groupBy(*keys).transformWithStateInPandas(Silence(), f"{key_schema}, last_ms bigint, silent_ms bigint", "append", "EventTime")


def pair_streams(requests: DataFrame, responses: DataFrame, keys: list[str], timeout_s: float, delay: str) -> DataFrame:
    """Requests with every response of the same keys that follows within ``timeout_s``; nulls for those that nobody answers.

    A stream-stream join with watermarks on both sides: state holds only what may still pair, and an unanswered request comes out
    once the watermarks have passed its timeout. Both sides have ``at`` (event time), ``t_us`` and ``ordinal``. ``latest_requests``
    makes pairs of the rows.
    """
    a = requests.withWatermark("at", delay).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("at").alias("asked_at"), F.col("ordinal").alias("request"), F.col("t_us").alias("request_us"))
    b = responses.withWatermark("at", delay).select(*keys, F.col("at").alias("answered_at"), F.col("ordinal").alias("response"), F.col("t_us").alias("response_us"))
    same = F.expr(" AND ".join(f"__{k} = {k}" for k in keys))
    near = F.expr(f"answered_at >= asked_at AND answered_at <= asked_at + interval {round(timeout_s * 1e6)} microseconds")
    both = a.join(b, same & near, "left_outer")
    return both.select(*[F.col(f"__{k}").alias(k) for k in keys], "request", "request_us", "response", "response_us")


def latest_requests(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Each response with the latest request before it, and each request without any response; ``response_ms`` between them."""
    answered = candidates.filter("response is not null").groupBy(*keys, "response", "response_us").agg(F.max(F.struct("request_us", "request")).alias("asked"))
    pairs = answered.select(*keys, "response", F.col("asked.request").alias("request"), ((F.col("response_us") - F.col("asked.request_us")) / 1000).alias("response_ms"))
    none = candidates.filter("response is null").select(*keys, "response", "request", F.lit(None).cast("double").alias("response_ms"))
    return pairs.unionByName(none)
