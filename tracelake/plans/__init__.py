"""Registered queries of the bus-log and signal engine."""

from . import chart_queries, decode_queries, definition_queries, derived_queries, frame_queries, plugin_queries, series_queries, source_queries, streaming_queries, trace_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
