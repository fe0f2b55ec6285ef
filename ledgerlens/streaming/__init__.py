"""Incremental (Structured Streaming) versions of the dashboard aggregates."""

from ledgerlens.streaming.incremental import (
    STREAMABLE,
    read_latest_snapshot,
    start_dashboard_stream,
    transaction_stream,
)

__all__ = ["STREAMABLE", "read_latest_snapshot", "start_dashboard_stream", "transaction_stream"]
