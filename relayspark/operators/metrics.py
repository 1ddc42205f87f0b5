"""Topic metrics (M-01 .. M-12).

Every metric is a hash aggregate keyed by topic whose functions (count, sum,
max, count_if) all have a partial form: each input task folds its rows to one
row per topic before the shuffle, so a topic holding a third of all messages
costs one row per task on the wire, not a third of the data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.functions.message import message_size

METRIC_COLUMNS = [
    "topic",
    "message_count",
    "total_bytes",
    "error_count",
    "last_message_time",
    "rate_per_second",
]


def _with_rate(agg: DataFrame, elapsed) -> DataFrame:
    """Add ``rate_per_second``. Without ``elapsed``, it is the replayed event-time
    span: the least and greatest time over all groups of the aggregate, as a
    scalar (partial minima and maxima; no task sees all groups).

    The input is read once: the result and the span each use all columns of the
    aggregate, so that nothing is pruned from either and the exchange below it is
    reused. The span takes its extremes from structs of all columns; the result
    names the times in a condition that no group meets."""
    count = F.col("message_count")
    if elapsed is None:
        count = F.when(F.col("__tmin") > F.col("__tmax"), F.lit(None)).otherwise(count)
        rest = [c for c in agg.columns if c not in ("__tmin", "__tmax")]
        # A null time is the least of all, so the first time is a greatest, too.
        last = F.max(F.struct(F.unix_micros("__tmax").alias("at"), *rest))["at"]
        first = -F.max(F.struct((-F.unix_micros("__tmin")).alias("at"), *rest))["at"]
        elapsed = agg.agg(((last - first) / F.lit(1e6)).alias("elapsed")).scalar()
    out = agg.withColumn("rate_per_second", _rate(count, elapsed))
    return out.drop("__tmin", "__tmax")


def _rate(count: Column, elapsed) -> Column:
    e = elapsed if isinstance(elapsed, Column) else F.lit(float(elapsed))
    return F.when(e > 0, count / e).otherwise(F.lit(0.0)).cast("double")


def source_metrics(routed: DataFrame, elapsed=None) -> DataFrame:
    """M-01, M-03, M-04, M-05: per source topic, measured before processing.

    A message counts when it could be measured; an error adds to
    ``error_count`` whether or not the message was counted (a processor failure
    is both, Q-09; a null payload is only an error, Q-05). A topic seen only in
    errors appears with ``message_count`` 0.
    """
    counted = F.col("source_size").isNotNull()
    agg = routed.groupBy("topic").agg(
        F.count("source_size").alias("message_count"),
        F.coalesce(F.sum("source_size"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count("error").alias("error_count"),
        F.max(F.when(counted, F.col("timestamp"))).alias("last_message_time"),
        F.min("timestamp").alias("__tmin"),
        F.max("timestamp").alias("__tmax"),
    )
    return _with_rate(agg, elapsed)


def delivered(routed: DataFrame) -> Column:
    """Rows the sink writes: no source error, a destination, no delivery error,
    and a message that can be measured (a payload, no null header value)."""
    ok = F.col("error").isNull() & F.col("dest_topic").isNotNull() & message_size().isNotNull()
    if "delivery_error" in routed.columns:
        ok = ok & F.col("delivery_error").isNull()
    return ok


def _destination_agg(processed: DataFrame, keys: list) -> DataFrame:
    """Destination-side aggregate without a row filter.

    Rows with a source error carry a NULL ``dest_topic`` and add nothing; a
    group made only of them has zero messages and zero errors and is dropped
    after the aggregate. Not filtering first keeps Catalyst from pushing the
    filter below the message projection, where it would evaluate the payload
    and size expressions a second time.
    """
    ok = delivered(processed)
    failed = F.col("error").isNull() & ~ok
    agg = processed.groupBy(*keys).agg(
        F.count_if(ok).alias("message_count"),
        F.coalesce(F.sum(F.when(ok, message_size())), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count_if(failed).alias("error_count"),
        F.max(F.when(ok, F.col("timestamp"))).alias("last_message_time"),
        F.min("timestamp").alias("__tmin"),
        F.max("timestamp").alias("__tmax"),
    )
    return agg


def destination_metrics(processed: DataFrame, elapsed=None) -> DataFrame:
    """M-02, M-03: per destination topic, measured after processing and only on
    delivery. A NULL destination (Q-02) or a processor that returned nothing is
    a destination error under that destination."""
    agg = _destination_agg(processed, [F.col("dest_topic").alias("topic")])
    # Groups of source-error rows only (NULL topic, 0 / 0) are dropped after the
    # rate, so that the span still covers every input row.
    out = _with_rate(agg, elapsed)
    return out.filter((F.col("message_count") + F.col("error_count")) > 0)


def metrics_report(source: DataFrame, destination: DataFrame) -> DataFrame:
    """M-06: both sides in one table with a ``side`` column (from separately
    computed sides; ``topic_report`` computes both in one pass)."""
    return source.select(F.lit("source").alias("side"), *METRIC_COLUMNS).unionByName(
        destination.select(F.lit("destination").alias("side"), *METRIC_COLUMNS)
    )


def _two_sided(routed: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides of the metrics from one read of the routed rows.

    Rows are first folded per pair of topic and destination, with the measures of
    both sides (sized before processing, and after it for what is delivered). Only
    these few rows are doubled into a source and a destination entry and folded
    again by side and topic.
    """
    ok = delivered(routed)
    failed = F.col("error").isNull() & ~ok
    ts = F.col("timestamp")
    pairs = routed.groupBy(*keys, "topic", "dest_topic").agg(
        F.count("source_size").alias("s_count"),
        F.sum("source_size").alias("s_bytes"),
        F.count("error").alias("s_errors"),
        F.max(F.when(F.col("source_size").isNotNull(), ts)).alias("s_last"),
        F.count_if(ok).alias("d_count"),
        F.sum(F.when(ok, message_size())).alias("d_bytes"),
        F.count_if(failed).alias("d_errors"),
        F.max(F.when(ok, ts)).alias("d_last"),
        F.min(ts).alias("tmin"),
        F.max(ts).alias("tmax"),
    )

    def entry(side: str, topic: str) -> Column:
        of = side[0]
        measures = [F.col(f"{of}_{m}").alias(m) for m in ("count", "bytes", "errors", "last")]
        return F.struct(F.lit(side).alias("side"), F.col(topic).alias("topic"), *measures, "tmin", "tmax")

    entries = pairs.select(*keys, F.inline(F.array(entry("source", "topic"), entry("destination", "dest_topic"))))
    return entries.groupBy(*keys, "side", "topic").agg(
        F.sum("count").cast("bigint").alias("message_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.sum("errors").cast("bigint").alias("error_count"),
        F.max("last").alias("last_message_time"),
        F.min("tmin").alias("__tmin"),
        F.max("tmax").alias("__tmax"),
    )


def _drop_empty(agg: DataFrame) -> DataFrame:
    """Destination groups made only of source-error rows (NULL topic, 0 / 0) go."""
    return agg.filter((F.col("side") == "source") | ((F.col("message_count") + F.col("error_count")) > 0))


def topic_report(routed: DataFrame, elapsed=None) -> DataFrame:
    """M-06 in one pass: ``(side, topic, message_count, total_bytes,
    error_count, last_message_time, rate_per_second)``.

    Without ``elapsed`` the rate uses the replayed event-time span, taken from
    the per-topic min/max already in the aggregate (no second read of the
    input).
    """
    agg = _two_sided(routed, [])
    out = _drop_empty(_with_rate(agg, elapsed))
    return out.select("side", *METRIC_COLUMNS)


def batch_deltas(routed: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per-batch metric deltas of both sides (what the stream writer stores),
    from one read of the batch."""
    cols = ["topic", "message_count", "total_bytes", "error_count", "last_message_time"]
    return _drop_empty(_two_sided(routed, [batch_col])).select(batch_col, "side", *cols)


def metrics_since_batch(deltas: DataFrame, after_batch: int, batch_col: str = "batch_id") -> DataFrame:
    """M-07: a reset is a new metrics epoch: fold only deltas after ``after_batch``."""
    return (
        deltas.filter(F.col(batch_col) > F.lit(after_batch))
        .groupBy("side", "topic")
        .agg(
            F.sum("message_count").cast("bigint").alias("message_count"),
            F.sum("total_bytes").cast("bigint").alias("total_bytes"),
            F.sum("error_count").cast("bigint").alias("error_count"),
            F.max("last_message_time").alias("last_message_time"),
        )
    )


# The counter name parts, ``<prefix>.<side>.<measure>``.
COUNTER_MEASURES = {"message_count": "messages", "total_bytes": "bytes", "error_count": "errors"}
DEFAULT_COUNTER_PREFIX = "relay"


def counter_rows(report: DataFrame, prefix: str = DEFAULT_COUNTER_PREFIX, drop_zero: bool = True) -> DataFrame:
    """M-08: one row ``(metric, topic, value)`` per exported counter and topic;
    six counters ``<prefix>.{source,destination}.{messages,bytes,errors}``.

    A counter that was never incremented for a topic has no data point, so
    zero values are left out by default.
    """
    long = report.unpivot(["side", "topic"], list(COUNTER_MEASURES), "field", "value")
    measure = F.element_at(
        F.create_map(*[F.lit(x) for kv in COUNTER_MEASURES.items() for x in kv]), F.col("field")
    )
    name = F.concat_ws(".", F.lit(prefix), F.col("side"), measure)
    out = long.select(name.alias("metric"), "topic", F.col("value").cast("bigint").alias("value"))
    return out.filter(F.col("value") != 0) if drop_zero else out


def _event_windows(df: DataFrame, window: str, slide: str | None) -> DataFrame:
    """Rows with the event-time window(s) ``w`` that hold them; a row without a
    time is in the NULL window. Streams use Spark's own window function, whose
    state a watermark bounds; it leaves rows without a time out, and they count
    in the per-batch metric deltas only."""
    if df.isStreaming:
        return df.withColumn("w", F.window("timestamp", window, slide) if slide else F.window("timestamp", window))
    length = _micros(df, window)
    step = _micros(df, slide) if slide else length
    micros = F.unix_micros("timestamp")
    last = (micros - F.pmod(micros, F.lit(step))).cast("bigint")
    at = lambda start: F.struct(F.timestamp_micros(start).alias("start"), F.timestamp_micros(start + F.lit(length)).alias("end"))
    if length == step:
        return df.withColumn("w", F.when(micros.isNotNull(), at(last)))
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit((length - 1) // step)), lambda i: last - i * step), lambda start: start + length > micros)
    return df.withColumn("w", F.explode_outer(F.when(micros.isNotNull(), F.transform(starts, at))))


def _windowed(df: DataFrame, topic_col: str, value: Column, name: str, window: str, slide: str | None) -> DataFrame:
    seconds = _micros(df, window) / 1e6
    return (
        _event_windows(df, window, slide)
        .groupBy("w", F.col(topic_col).alias("topic"))
        .agg(value.alias("__v"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "topic",
            (F.col("__v") / F.lit(seconds)).cast("double").alias(name),
        )
    )


def _micros(df: DataFrame, interval: str) -> int:
    """Microseconds of an interval in any form that Spark reads. Months have no
    fixed length and are refused, as Spark's own windows do."""
    text = interval.replace("'", "")
    if re.search(r"\b(month|year)s?\b", text, re.IGNORECASE):
        raise ValueError(f"a window of {interval!r} has no fixed length; use days or less")
    micros = df.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL '{text}')").first()[0]
    if micros <= 0:
        raise ValueError(f"a window needs a positive length, not {interval!r}")
    return micros


def windowed_throughput(routed: DataFrame, window: str = "5 minutes", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """M-09: messages per second per source topic in event-time windows."""
    df = routed.withWatermark("timestamp", watermark) if watermark else routed
    return _windowed(df, "topic", F.count("source_size"), "messages_per_second", window, slide)


def windowed_volume(processed: DataFrame, window: str = "5 minutes", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """M-10: delivered bytes per second per destination topic."""
    df = processed.withWatermark("timestamp", watermark) if watermark else processed
    size = F.sum(F.when(delivered(processed), message_size()))
    # Groups without a delivered row (only the NULL destination) are dropped after the aggregate.
    out = _windowed(df, "dest_topic", size, "bytes_per_second", window, slide)
    return out.filter(F.col("bytes_per_second").isNotNull())


def windowed_errors(routed: DataFrame, window: str = "5 minutes", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """M-11: source errors per second per source topic."""
    df = routed.withWatermark("timestamp", watermark) if watermark else routed
    return _windowed(df, "topic", F.count("error"), "errors_per_second", window, slide)


def loss_check(report: DataFrame, routes) -> DataFrame:
    """M-12: per destination topic, messages counted at the source topic(s)
    routed to it against messages delivered; ``lost > 0`` means loss.

    Takes a ``topic_report`` (both sides from one read of the routed rows):
    source rows are re-keyed to their destination through the route table and
    summed with the destination rows, so the messages are read once and no
    join touches them. A DataFrame route table joins the report (one row per
    topic) after the rule for repeated sources that routing has.
    """
    src = F.col("side") == "source"
    if isinstance(routes, DataFrame):
        from relayspark.operators.routing import route_table

        table = route_table(routes).select(F.col("source_topic").alias("__src"), F.col("destination_topic").alias("__dst"))
        report = report.join(table, src & (F.col("topic") == F.col("__src")), "left")
        mapped = F.col("__dst")
    else:
        pairs = dict(routes)
        mapped = F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), F.col("topic"))
    keyed = report.select(
        F.when(src, mapped).otherwise(F.col("topic")).alias("dest_topic"),
        F.when(src, F.col("message_count")).otherwise(F.lit(0)).alias("__s"),
        F.when(src, F.lit(0)).otherwise(F.col("message_count")).alias("__d"),
    )
    out = keyed.filter(F.col("dest_topic").isNotNull()).groupBy("dest_topic").agg(
        F.sum("__s").cast("bigint").alias("source_count"), F.sum("__d").cast("bigint").alias("dest_count")
    )
    return out.withColumn("lost", (F.col("source_count") - F.col("dest_count")).cast("bigint"))
