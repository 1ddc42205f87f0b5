"""relayspark: topic routing and topic metrics as Spark DataFrame operators.

Messages live in DataFrames of the ``MESSAGE`` schema (batch or streaming).
Routing and column-expression processors are narrow projections; metrics are
partial + final hash aggregates keyed by topic; streaming runs through
``foreachBatch`` with idempotent per-batch writes.
"""

__version__ = "0.1.0"

from relayspark.schema import MESSAGE, MESSAGE_COLUMNS
from relayspark.session import build_session, configure, shared_dir
from relayspark.operators.routing import fan, funnel, one_to_one, subscribe, prepare
from relayspark.operators.processors import (
    passthrough,
    load_processor,
    row_processor,
    add_processing_time,
    json_enrich,
    priority_tag,
    header_stamp,
    process,
)
from relayspark.operators.metrics import (
    source_metrics,
    destination_metrics,
    metrics_report,
    topic_report,
    counter_rows,
    windowed_throughput,
    windowed_volume,
    windowed_errors,
    loss_check,
)

__all__ = [
    "__version__",
    "MESSAGE",
    "MESSAGE_COLUMNS",
    "build_session",
    "configure",
    "shared_dir",
    "fan",
    "funnel",
    "one_to_one",
    "subscribe",
    "prepare",
    "passthrough",
    "load_processor",
    "row_processor",
    "add_processing_time",
    "json_enrich",
    "priority_tag",
    "header_stamp",
    "process",
    "source_metrics",
    "destination_metrics",
    "metrics_report",
    "topic_report",
    "counter_rows",
    "windowed_throughput",
    "windowed_volume",
    "windowed_errors",
    "loss_check",
]
