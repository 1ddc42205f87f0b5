"""Sinks (K-*): per-broker egress projections and writers."""

from relayspark.sinks.egress import (
    deliverable,
    in_source_order,
    to_kafka,
    to_pulsar,
    to_eventhubs,
    to_pubsub,
    write_topics,
    write_broker,
)

__all__ = [
    "deliverable",
    "in_source_order",
    "to_kafka",
    "to_pulsar",
    "to_eventhubs",
    "to_pubsub",
    "write_topics",
    "write_broker",
]
