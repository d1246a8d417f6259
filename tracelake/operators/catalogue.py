"""The catalogue of a log's signals, grouped by where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decode import small
from .frames import id_text


def _coded(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def catalogue_groups(signals: DataFrame, frames: DataFrame, bindings: DataFrame) -> DataFrame:
    """``kind, group_id, label, signal_ids`` of the groups that have signals.

    ``signals``: ``signal_id, seq`` (their order), ``kind`` and by kind ``frame_id`` (``frame``), ``binding_id, plugin_group`` (``plugin``) or ``channel_group, format``
    (``measured``). ``frames``: ``frame_id, can_id, extended, name``. ``bindings``: ``binding_id, plugin_id, frame_id``. Signals of a frame form a group; those of a plugin one for each binding
    and group the plugin names; measured ones one for each channel group, the unnamed one under its format alone. Signals of unknown frames or bindings are in no group.
    """
    name = F.coalesce("name", F.lit(""))
    can_id = id_text(F.col("can_id"), F.col("extended"))
    known = frames.select("frame_id", can_id.alias("__id"), F.concat(can_id, F.when(name != "", F.concat(F.lit(" "), name)).otherwise("")).alias("label"))
    group = F.coalesce("plugin_group", F.lit(""))
    dot = F.lit(" · ")
    bound = bindings.join(known.select("frame_id", "__id"), "frame_id", "left").select("binding_id", F.concat(F.lit("Plugin "), "plugin_id", F.coalesce(F.concat(dot, "__id"), F.lit(""))).alias("__label"))
    channel, format_ = F.coalesce("channel_group", F.lit("")), F.coalesce("format", F.lit("MF4"))
    parts = [
        signals.filter("kind = 'frame'").join(small(known), "frame_id").select("kind", F.concat(F.lit("frame:"), "frame_id").alias("group_id"), "label", "seq", "signal_id"),
        signals.filter("kind = 'plugin'").join(small(bound), "binding_id").select(
            "kind", F.concat(F.lit("plugin:"), "binding_id", F.lit(":"), _coded(group)), F.concat("__label", F.when(group != "", F.concat(dot, group)).otherwise("")), "seq", "signal_id"
        ),
        signals.filter("kind = 'measured'").select("kind", F.concat(F.lit("mdf:"), _coded(channel)), F.when(channel != "", F.concat(format_, dot, channel)).otherwise(format_), "seq", "signal_id"),
    ]
    both = parts[0].union(parts[1]).union(parts[2])
    members = F.array_sort(F.collect_list(F.struct("seq", "signal_id")))
    return both.groupBy("kind", "group_id").agg(F.min_by("label", "seq").alias("label"), members["signal_id"].alias("signal_ids"))
