"""Streaming runner.

``run_stream`` takes a routed (and processed) streaming DataFrame and writes,
per micro-batch, the delivered rows (a topic table partitioned by batch and
destination), the per-topic metric deltas of both sides, and when the batch ran.
Each write overwrites the whole folder of its ``batch_id``, so a batch replayed
after a failure leaves neither duplicates nor rows of destinations that the
replay no longer has: exactly-once into files, with the checkpoint beside them.
Deltas and times are compacted as the stream runs (``deltas``).
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from relayspark.operators.metrics import batch_deltas
from relayspark.session import shared_dir
from relayspark.sinks.egress import TOPIC_FOLDER, TOPIC_TABLE, topic_rows
from relayspark.streaming.deltas import EVERY, RUNS, DeltaStore, fold

TOTALS_NAME = "relay_totals"


def with_totals(routed: DataFrame, name: str = TOTALS_NAME) -> DataFrame:
    """M-13: whole-query counters per batch through ``observe`` (read them from
    ``query.lastProgress['observedMetrics']``)."""
    return routed.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        F.count("source_size").alias("source_messages"),
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("source_bytes"),
        F.count("error").alias("source_errors"),
    )


def _write_batch(out_dir: str, sink=None, compact_every: int = EVERY, clock=time.time):
    run, began, store = uuid.uuid4().hex, clock(), []

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not store:
            store.append(DeltaStore(spark, out_dir, compact_every))
        b = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).persist()
        try:
            if sink is not None:
                # A broker: the projection of this batch is sent; a replayed
                # batch is sent again (at-least-once), its deltas overwritten.
                sink(b.drop("batch_id"))
            else:
                topic_rows(b).write.mode("overwrite").partitionBy(TOPIC_FOLDER).parquet(f"{out_dir}/topics/batch_id={batch_id}")
            now = clock()
            # M-05: when the last message was recorded, by the relay's clock.
            recorded = F.when(F.col("message_count") > 0, F.lit(float(now)))
            times = spark.createDataFrame([(run, float(began), float(now))], RUNS)
            store[0].add(batch_id, batch_deltas(b).withColumn("last_recorded", recorded), times)
        finally:
            b.unpersist()

    return write


def run_stream(
    routed: DataFrame,
    out_dir: str | None = None,
    checkpoint: str | None = None,
    drain: bool = True,
    processing_time: str | None = None,
    query_name: str | None = None,
    sink=None,
    compact_every: int = EVERY,
    clock=time.time,
) -> tuple[StreamingQuery, str]:
    """T-01 / T-02 / T-06: start the stream; with ``drain`` read what is
    available, then stop (``availableNow``) and wait. Returns the query and
    the output folder (under the shared checkpoint root unless given).

    T-03: a stream resumes from its checkpoint, so one that isn't drained needs
    ``out_dir`` or ``checkpoint``: a new folder at every start would skip or send
    again whatever came meanwhile.

    ``sink``: a function given each routed micro-batch (for example a broker
    write of ``to_kafka(batch)``) used instead of the topic table; the metric
    deltas are stored either way, and ``compact_every`` batches of them become a
    block (see ``deltas``). ``clock``: seconds of the relay's clock (M-05)."""
    spark = routed.sparkSession
    if not drain and not (out_dir or checkpoint):
        raise ValueError("a continuous stream needs out_dir or checkpoint, so that a restart resumes it")
    out_dir = out_dir or shared_dir(spark, "stream-out")
    checkpoint = checkpoint or f"{out_dir}/_checkpoint"
    writer = routed.writeStream.foreachBatch(_write_batch(out_dir, sink, compact_every, clock)).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    if drain:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    query = writer.start()
    if drain:
        query.awaitTermination()
    return query, out_dir


def run_update_stream(
    agg: DataFrame,
    out_dir: str | None = None,
    checkpoint: str | None = None,
    drain: bool = True,
    processing_time: str | None = None,
) -> tuple[StreamingQuery, str]:
    """Streamed aggregates (the windowed metrics M-09 .. M-11) in update mode.

    Each micro-batch writes the rows whose value changed, tagged with its
    ``batch_id`` and overwriting only that batch's partition, so a replayed
    batch leaves no duplicates. With a watermark on the input, state for
    closed windows is dropped, so state stays bounded however long the stream
    runs. ``read_latest`` folds the updates to the current value per key.
    """
    spark = agg.sparkSession
    out_dir = out_dir or shared_dir(spark, "stream-agg")
    checkpoint = checkpoint or f"{out_dir}/_checkpoint"
    path = f"{out_dir}/updates"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    query = writer.start()
    if drain:
        query.awaitTermination()
    return query, out_dir


def read_latest(spark: SparkSession, out_dir: str, keys: list[str]) -> DataFrame:
    """The latest value per key of an update-mode stream (partial aggregate
    with ``max_by`` on the batch id)."""
    updates = spark.read.parquet(f"{out_dir}/updates")
    values = [c for c in updates.columns if c not in keys and c != "batch_id"]
    latest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("__v"))
    return latest.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in values])


def read_topic_table(spark: SparkSession, out_dir: str) -> DataFrame:
    """The stored rows with ``dest_topic`` and ``batch_id``; names read back as they
    were (the schema is stated, not inferred from folder names)."""
    schema = T.StructType([*TOPIC_TABLE.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{out_dir}/topics").drop(TOPIC_FOLDER)


def read_stream_metrics(spark: SparkSession, out_dir: str, after_batch: int = -1) -> DataFrame:
    """Fold the stored deltas into per-(side, topic) metrics (M-07 epoch by
    ``after_batch``). No rows if no batch is stored."""
    return fold(DeltaStore(spark, out_dir).deltas(after_batch)).drop("last_recorded")


def run_broker_stream(
    projected: DataFrame,
    fmt: str,
    options: dict[str, str],
    checkpoint: str | None = None,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Stream an egress projection (``to_kafka`` etc.) to a broker connector.

    The checkpoint commits source offsets after the sink accepted the batch:
    at-least-once into the broker (a replayed batch may be sent again),
    never the at-most-once of committing before processing.
    """
    if not checkpoint:
        raise ValueError("a broker stream needs a checkpoint folder, so that a restart resumes it")
    writer = projected.writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint)
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def stream_uptime(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row: seconds that the stream ran, over all its runs (each from its start
    to the end of its last batch); NULL if no batch is stored."""
    return DeltaStore(spark, out_dir).runs().agg(F.sum(F.col("ended") - F.col("began")).alias("uptime_seconds"))


def stream_report(spark: SparkSession, out_dir: str, uptime_seconds: float | None = None, after_batch: int = -1) -> DataFrame:
    """M-13: both sides folded from the stored deltas, with the rate over the
    stream's uptime (measured, unless given; without one the rate is NULL):
    side, topic, message_count, total_bytes, error_count, last_message_time,
    last_recorded (M-05: seconds of the relay's clock at the last message, 0 if
    there was none), uptime_seconds, rate_per_second. One row per side and topic,
    not collected; no rows if no batch is stored."""
    up = F.lit(float(uptime_seconds)) if uptime_seconds is not None else stream_uptime(spark, out_dir).scalar()
    report = fold(DeltaStore(spark, out_dir).deltas(after_batch)).withColumn("last_recorded", F.coalesce("last_recorded", F.lit(0.0)))
    report = report.withColumn("uptime_seconds", up.cast("double"))
    return report.withColumn("rate_per_second", F.when(F.col("uptime_seconds") > 0, F.col("message_count") / F.col("uptime_seconds")))
