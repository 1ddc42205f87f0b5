"""Stored tables as message topics.

The driver tables become MESSAGE rows with plain column expressions, so the
scan keeps its pushed filters and pruned columns. ``events`` also carries a
fixed fault pattern that reaches the error branches:

* ``event_id % 10 = 0``: payload loses its first byte (not JSON),
* ``event_id % 10 = 1``: payload ``[1]`` (JSON, not an object),
* ``event_id % 10 = 2``: no ``destination_topic`` header,
* ``event_id % 10 = 3``: null payload (tombstone).

Every row is kept; the pattern only changes what a row holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared schemas of the driver tables: no footer-inference job per read.
TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


EVENTS_SCHEMA = TABLE_SCHEMAS["events"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(TABLE_SCHEMAS[name]) if name in TABLE_SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (a file, or a folder of part files) as a stream. The path is
    written as a pattern because a stream takes a single file only that way."""
    return spark.readStream.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def event_payload_sql(faults: bool = True) -> str:
    if not faults:
        return "props"
    return (
        "CASE pmod(event_id, 10) WHEN 0 THEN substring(props, 2) WHEN 1 THEN '[1]' "
        "WHEN 3 THEN CAST(NULL AS STRING) ELSE props END"
    )


def event_payload_text(faults: bool = True) -> Column:
    return F.expr(event_payload_sql(faults))


def events_to_messages(events: DataFrame, topic: str | None = "events", faults: bool = True) -> DataFrame:
    """``events`` rows as messages. ``topic=None`` uses ``event_type`` as the
    topic (a multi-topic source for one-to-one routing)."""
    header = "map('destination_topic', event_type)"
    headers = f"CASE WHEN pmod(event_id, 10) = 2 THEN CAST(map() AS MAP<STRING, STRING>) ELSE {header} END" if faults else header
    topic_sql = f"'{topic}'" if topic else "event_type"
    return events.selectExpr(
        f"encode({event_payload_sql(faults)}, 'UTF-8') AS payload",
        f"{headers} AS headers",
        f"{topic_sql} AS topic",
        "CAST(user_id AS STRING) AS key",
        "CAST(pmod(event_id, 4) AS INT) AS partition",
        "event_id AS offset",
        "CAST(ts AS TIMESTAMP) AS timestamp",
    )


def events_messages(spark: SparkSession, sf_dir: str, topic: str | None = "events", faults: bool = True) -> DataFrame:
    return events_to_messages(read_table(spark, sf_dir, "events"), topic, faults)


def documents_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as large text messages on topic ``documents``; headers
    ``lang`` and ``source``."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.encode(F.col("text"), "UTF-8").alias("payload"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("headers"),
        F.lit("documents").alias("topic"),
        F.col("doc_id").cast("string").alias("key"),
        F.pmod(F.col("doc_id"), F.lit(4)).cast("int").alias("partition"),
        F.col("doc_id").alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"),
    )


def conversations_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as ordered keyed messages: key ``conv_id``, offset
    ``conv_id * 1000 + turn`` so turns of a conversation are in offset order."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        F.encode(F.col("text"), "UTF-8").alias("payload"),
        F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string")).alias("headers"),
        F.lit("conversations").alias("topic"),
        F.col("conv_id").cast("string").alias("key"),
        F.pmod(F.col("conv_id"), F.lit(4)).cast("int").alias("partition"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"),
    )


# --- raw broker rows replayed from events (for the normalisers) --------------


def kafka_raw_from_events(events: DataFrame) -> DataFrame:
    """Kafka-shaped rows: every 7th key empty, every 13th key invalid UTF-8,
    header ``dup`` repeated (last wins), header ``none`` without value on even
    ids, every 11th row has an invalid UTF-8 header value."""
    eid = F.col("event_id")
    bad = F.unhex(F.lit("FF"))
    key = (
        F.when(F.pmod(eid, F.lit(7)) == 0, F.unhex(F.lit("")))
        .when(F.pmod(eid, F.lit(13)) == 0, bad)
        .otherwise(F.encode(F.col("user_id").cast("string"), "UTF-8"))
    )
    h = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    headers = F.array(
        h("destination_topic", F.encode(F.col("event_type"), "UTF-8")),
        h("dup", F.encode(F.lit("first"), "UTF-8")),
        h("dup", F.encode(F.col("event_id").cast("string"), "UTF-8")),
        h("none", F.when(F.pmod(eid, F.lit(2)) == 0, F.lit(None).cast("binary")).otherwise(F.encode(F.lit("v"), "UTF-8"))),
        h("check", F.when(F.pmod(eid, F.lit(11)) == 0, bad).otherwise(F.encode(F.lit("ok"), "UTF-8"))),
    )
    return events.select(
        key.alias("key"),
        F.encode(event_payload_text(True), "UTF-8").alias("value"),
        headers.alias("headers"),
        F.col("event_type").alias("topic"),
        F.pmod(eid, F.lit(4)).cast("int").alias("partition"),
        eid.alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def pulsar_raw_from_events(events: DataFrame) -> DataFrame:
    """Pulsar-shaped rows: every 5th partition key empty, every 9th publish
    time 0."""
    eid = F.col("event_id")
    return events.select(
        F.encode(F.col("props"), "UTF-8").alias("data"),
        F.create_map(F.lit("destination_topic"), F.col("event_type")).alias("properties"),
        F.concat(F.lit("persistent://public/default/"), F.col("event_type")).alias("topic_name"),
        F.when(F.pmod(eid, F.lit(5)) == 0, F.lit("")).otherwise(F.col("user_id").cast("string")).alias("partition_key"),
        F.when(F.pmod(eid, F.lit(9)) == 0, F.lit(0).cast("bigint"))
        .otherwise(F.unix_millis(F.col("ts").cast("timestamp")))
        .alias("publish_timestamp"),
    )


def eventhubs_raw_from_events(events: DataFrame) -> DataFrame:
    """Event Hubs-shaped rows with byte properties; every 10th id (``% 10 = 5``)
    is a null event that only names its partition."""
    eid = F.col("event_id")
    null_event = F.pmod(eid, F.lit(10)) == 5
    enc = lambda s: F.encode(s, "UTF-8")
    props = F.array(
        F.struct(enc(F.lit("content-type")).alias("key"), enc(F.lit("application/json")).alias("value")),
        F.struct(enc(F.lit("event_type")).alias("key"), enc(F.col("event_type")).alias("value")),
    )
    return events.select(
        F.when(~null_event, enc(F.col("props"))).alias("body"),
        F.when(~null_event, props).alias("properties"),
        F.pmod(eid, F.lit(4)).cast("string").alias("partition_id"),
        F.when(~null_event, eid.cast("string")).alias("offset"),
        F.when(~null_event, F.col("ts").cast("timestamp")).alias("enqueued_time"),
    )


def pubsub_raw_from_events(events: DataFrame) -> DataFrame:
    """Pub/Sub-shaped rows; the subscription is a bare id per event type."""
    return events.select(
        F.encode(F.col("props"), "UTF-8").alias("data"),
        F.create_map(F.lit("env"), F.lit("prod"), F.lit("event_type"), F.col("event_type")).alias("attributes"),
        F.col("ts").cast("timestamp").alias("publish_time"),
        F.concat(F.lit("ack-"), F.col("event_id").cast("string")).alias("ack_id"),
        F.concat(F.lit("sub-"), F.col("event_type")).alias("subscription"),
    )
