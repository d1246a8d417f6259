"""Decoder plugins: user code in Python that turns frames into samples and events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import small

#: One row per output or finding of a plugin.
OUTPUT = (
    "source_id string, ordinal bigint, t_us bigint, plugin_id string, binding_id string, kind string, "
    "signal_id string, name string, unit string, `group` string, value double, label string, quality string, code string, message string"
)
FIELDS = ["source_id", "ordinal", "t_us", "can_id", "extended", "data", "plugin_id", "binding_id"]


def route(frames: DataFrame, bindings: DataFrame) -> DataFrame:
    """Frames beside the bindings of their CAN key; both the plugin and the binding must be enabled."""
    on = bindings.filter("plugin_enabled and binding_enabled").select("can_id", "extended", "plugin_id", "binding_id")
    return frames.join(small(on), ["can_id", "extended"]).select(*FIELDS)


def frame_outputs(row, decode: Callable) -> Iterator[tuple]:
    """Rows for one frame: each item has ``signal`` and ``value``, and may have ``name, unit, group, label, quality``; or it is an ``event``.

    Whatever a plugin raises or returns amiss becomes a finding of that frame alone.
    """
    head = (row.source_id, row.ordinal, row.t_us, row.plugin_id, row.binding_id)
    try:
        for item in decode(bytes(row.data), row):
            if item.get("event"):
                yield (*head, "event", None, item["event"], None, item.get("group"), None, item.get("label"), None, None, None)
                continue
            value = item.get("value")
            if not isinstance(value, (int, float)) or value != value or value in (float("inf"), float("-inf")):
                yield (*head, "diagnostic", item.get("signal"), *[None] * 6, "PLUGIN_VALUE", "value is not finite")
                continue
            signal = f"plugin:{row.plugin_id}:{row.binding_id}:{item['signal']}"
            yield (*head, "sample", signal, item.get("name", item["signal"]), item.get("unit"), item.get("group"), float(value), item.get("label"), item.get("quality", "valid"), None, None)
    except Exception as error:  # noqa: BLE001 - user code
        yield (*head, "diagnostic", *[None] * 7, "PLUGIN_ERROR", str(error))


def output_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0].strip("`") for c in OUTPUT.split(", ")])


def run_stateless(routed: DataFrame, decode: Callable) -> DataFrame:
    """Applies ``decode(data, row)`` to each frame by itself, over Arrow batches and without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield output_rows([x for row in batch.itertuples(index=False) for x in frame_outputs(row, decode)])

    return routed.mapInPandas(run, OUTPUT)


def run_stateful(routed: DataFrame, make_session: Callable) -> DataFrame:
    """One session per source and plugin, shared by the plugin's bindings; frames come in order of arrival.

    A session needs all frames of its source one after the other, so sources are the unit of parallelism.
    Frames are sorted by Spark, streamed in batches, and never gathered: only the session's state is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, session = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.source_id, row.plugin_id) != key:
                    key, session = (row.source_id, row.plugin_id), make_session()
                out.extend(frame_outputs(row, session))
            yield output_rows(out)

    keys = ["source_id", "plugin_id"]
    return routed.repartition(*keys).sortWithinPartitions(*keys, "ordinal", "binding_id").mapInPandas(run, OUTPUT)


def respond(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Each response with the latest request before it and the time between them."""
    from .asof import neighbours

    n = neighbours(responses, requests, keys, "t_us", ["ordinal"]).filter("before is not null")
    return n.select(*keys, F.col("response"), F.col("before.ordinal").alias("request"), ((F.col("t_us") - F.col("before.t_us")) / 1000).alias("response_ms"))
