"""Normalisers: each broker's raw rows -> MESSAGE (+ ``error`` for rows that
cannot be decoded). Pure column expressions, so they work unchanged on batch
and streaming DataFrames and never shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.schema import MESSAGE_COLUMNS


def _text_or_none(b: Column) -> Column:
    """N-01: bytes decode as UTF-8; a missing value prints as ``'None'``
    (``str(None)``). NULL means undecodable bytes."""
    return F.when(b.isNull(), F.lit("None")).otherwise(F.try_validate_utf8(b.cast("string")))


def _entries_to_headers(entries: Column, key_fn, value_fn) -> tuple[Column, Column]:
    """(headers map, any-undecodable flag) from an array of key/value structs.

    N-02: a repeated key keeps its last value (map_from_entries under
    mapKeyDedupPolicy=LAST_WIN).
    """
    arr = F.coalesce(entries, F.array())
    decoded = F.transform(arr, lambda e: F.struct(key_fn(e["key"]).alias("k"), value_fn(e["value"]).alias("v")))
    bad = F.exists(decoded, lambda e: e["k"].isNull() | e["v"].isNull())
    safe = F.transform(
        decoded, lambda e: F.struct(F.coalesce(e["k"], F.lit("")).alias("key"), F.coalesce(e["v"], F.lit("")).alias("value"))
    )
    headers = F.when(F.size(safe) > 0, F.map_from_entries(safe)).otherwise(
        F.create_map().cast("map<string,string>")
    )
    return headers, bad


def _key_text(raw_key: Column) -> tuple[Column, Column]:
    """N-03: key decodes as UTF-8, an empty key is NULL. Returns (key, undecodable)."""
    text = F.try_validate_utf8(raw_key.cast("string"))
    bad = raw_key.isNotNull() & (F.octet_length(raw_key) > 0) & text.isNull()
    return F.nullif(text, F.lit("")), bad


def _select_message(df: DataFrame, cols: dict[str, Column], error: Column) -> DataFrame:
    return df.select(*[cols[c].alias(c) for c in MESSAGE_COLUMNS], error.alias("error"))


def from_kafka(raw: DataFrame) -> DataFrame:
    """S-01: Kafka rows (Spark's kafka source shape) -> MESSAGE.

    Undecodable header values or keys do not end the stream (Q-08): the row
    carries ``error`` and becomes a source error.
    """
    headers, bad_h = _entries_to_headers(F.col("headers"), lambda k: k, _text_or_none)
    key, bad_k = _key_text(F.col("key"))
    error = F.when(bad_h, F.lit("undecodable header")).when(bad_k, F.lit("undecodable key"))
    cols = {
        "payload": F.col("value"),
        "headers": headers,
        "topic": F.col("topic"),
        "key": key,
        "partition": F.col("partition").cast("int"),
        "offset": F.col("offset").cast("bigint"),
        "timestamp": F.col("timestamp").cast("timestamp"),
    }
    return _select_message(raw, cols, error)


def from_pulsar(raw: DataFrame) -> DataFrame:
    """S-02: Pulsar rows -> MESSAGE. Properties are already text; the partition
    key is empty -> NULL; publish time in ms, 0 -> NULL (N-04), read as UTC."""
    ms = F.nullif(F.col("publish_timestamp"), F.lit(0))
    cols = {
        "payload": F.col("data"),
        "headers": F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>")),
        "topic": F.col("topic_name"),
        "key": F.nullif(F.col("partition_key"), F.lit("")),
        "partition": F.lit(None).cast("int"),
        "offset": F.lit(None).cast("bigint"),
        "timestamp": F.timestamp_millis(ms),
    }
    return _select_message(raw, cols, F.lit(None).cast("string"))


def from_eventhubs(raw: DataFrame) -> DataFrame:
    """S-03: Event Hubs rows -> MESSAGE. Null events (no body, properties,
    offset or time) are skipped; property keys and values are decoded (N-01);
    topic is ``eventhub-<partition>`` (N-05). A text offset or partition that is no
    number makes an error row, not a failed job (Q-08)."""
    present = (
        F.col("body").isNotNull()
        | F.col("properties").isNotNull()
        | F.col("offset").isNotNull()
        | F.col("enqueued_time").isNotNull()
    )
    kept = raw.filter(present)
    headers, bad_h = _entries_to_headers(F.col("properties"), _text_or_none, _text_or_none)
    cols = {
        "payload": F.col("body"),
        "headers": headers,
        "topic": F.concat(F.lit("eventhub-"), F.col("partition_id")),
        "key": F.lit(None).cast("string"),
        "partition": F.col("partition_id").try_cast("int"),
        "offset": F.col("offset").try_cast("bigint"),
        "timestamp": F.col("enqueued_time").cast("timestamp"),
    }
    bad_number = (F.col("offset").isNotNull() & cols["offset"].isNull()) | (F.col("partition_id").isNotNull() & cols["partition"].isNull())
    error = F.when(bad_h, F.lit("undecodable header")).when(bad_number, F.lit("undecodable position"))
    return _select_message(kept, cols, error)


def subscription_path(project: str | Column, subscription: str | Column) -> Column:
    """N-05: ``projects/<project>/subscriptions/<subscription>``."""
    p = F.lit(project) if isinstance(project, str) else project
    s = F.lit(subscription) if isinstance(subscription, str) else subscription
    return F.format_string("projects/%s/subscriptions/%s", p, s)


def from_pubsub(raw: DataFrame, project: str | None = None) -> DataFrame:
    """S-04: Pub/Sub rows -> MESSAGE. Attributes become headers; topic is the
    subscription path (built from ``project`` when the row holds a bare
    subscription id)."""
    sub = F.col("subscription")
    topic = sub if project is None else F.when(sub.startswith("projects/"), sub).otherwise(subscription_path(project, sub))
    cols = {
        "payload": F.col("data"),
        "headers": F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>")),
        "topic": topic,
        "key": F.lit(None).cast("string"),
        "partition": F.lit(None).cast("int"),
        "offset": F.lit(None).cast("bigint"),
        "timestamp": F.col("publish_time").cast("timestamp"),
    }
    return _select_message(raw, cols, F.lit(None).cast("string"))
