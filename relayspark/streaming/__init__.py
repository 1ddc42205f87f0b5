"""Structured Streaming runner (T-01 .. T-06, M-13)."""

from relayspark.streaming.runner import (
    run_stream,
    run_update_stream,
    run_broker_stream,
    stream_report,
    read_latest,
    read_topic_table,
    read_stream_metrics,
    with_totals,
    TOTALS_NAME,
)

__all__ = ["run_stream", "run_broker_stream", "stream_report", "run_update_stream", "read_latest", "read_topic_table", "read_stream_metrics", "with_totals", "TOTALS_NAME"]
