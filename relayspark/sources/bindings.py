"""Broker bindings: ``readStream``/``read`` with the right format and options,
then the broker's normaliser.

No broker connector jar is on this image's classpath, so these bindings are
option mapping only here; the mapping functions are tested, the reads run
where a connector is installed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayspark.sources.normalise import from_kafka, from_pubsub, from_pulsar


def kafka_reader_options(
    bootstrap_servers: str,
    topics: Iterable[str],
    starting: str | dict | None = None,
    max_per_trigger: int | None = None,
    extra: dict[str, str] | None = None,
    min_partitions: int | None = None,
    fail_on_data_loss: bool = True,
) -> dict[str, str]:
    """S-01, S-07, S-08, T-05 as Kafka source options.

    ``starting``: ``"earliest"``, ``"latest"``, an offsets dict
    ``{topic: {partition: offset}}`` or ``{"timestamp": ms}``.
    ``max_per_trigger`` bounds each micro-batch (the back-pressure knob);
    ``min_partitions`` splits large topic partitions over more tasks than the
    topic has partitions. Offsets that aged out end the query, unless
    ``fail_on_data_loss`` is given as False.
    """
    import json

    opts = {
        "kafka.bootstrap.servers": bootstrap_servers,
        "subscribe": ",".join(topics),
        "includeHeaders": "true",
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if isinstance(starting, str):
        opts["startingOffsets"] = starting
    elif isinstance(starting, dict) and "timestamp" in starting:
        opts["startingTimestamp"] = str(int(starting["timestamp"]))
    elif isinstance(starting, dict):
        opts["startingOffsets"] = json.dumps(
            {t: {str(p): int(o) for p, o in parts.items()} for t, parts in starting.items()}
        )
    if max_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(int(max_per_trigger))
    if min_partitions:
        opts["minPartitions"] = str(int(min_partitions))
    opts.update(extra or {})
    return opts


def eventhubs_reader_options(
    namespace: str,
    connection_string: str,
    eventhub: str,
    starting: str | dict | None = "latest",
    max_per_trigger: int | None = None,
    extra: dict[str, str] | None = None,
) -> dict[str, str]:
    """S-03: Event Hubs through its Kafka-compatible endpoint."""
    jaas = (
        "org.apache.kafka.common.security.plain.PlainLoginModule required "
        f'username="$ConnectionString" password="{connection_string}";'
    )
    return kafka_reader_options(
        f"{namespace}.servicebus.windows.net:9093",
        [eventhub],
        starting,
        max_per_trigger,
        {
            "kafka.security.protocol": "SASL_SSL",
            "kafka.sasl.mechanism": "PLAIN",
            "kafka.sasl.jaas.config": jaas,
            **(extra or {}),
        },
    )


def _reader(spark: SparkSession, streaming: bool):
    return spark.readStream if streaming else spark.read


def read_topics(
    spark: SparkSession,
    broker: str,
    options: dict[str, str],
    streaming: bool = True,
    fmt: str | None = None,
    project: str | None = None,
) -> DataFrame:
    """Read a broker as MESSAGE rows.

    ``broker``: ``kafka``, ``eventhubs`` (Kafka endpoint), ``pulsar`` or
    ``pubsub``; ``fmt`` names the connector's format where it differs.
    """
    reader = _reader(spark, streaming).format(fmt or ("kafka" if broker in ("kafka", "eventhubs") else broker))
    raw = reader.options(**options).load()
    if broker == "kafka":
        return from_kafka(raw)
    if broker == "eventhubs":
        # An Event Hubs message has no key, so none is read (and none can be undecodable).
        msg = from_kafka(raw.withColumn("key", F.lit(None).cast("binary")))
        return msg.withColumn("topic", F.concat(F.lit("eventhub-"), F.col("partition").cast("string")))
    if broker == "pulsar":
        # Column names of the common Pulsar connector.
        shaped = raw.select(
            F.col("value").cast("binary").alias("data"),
            F.col("__messageProperties").alias("properties"),
            F.col("__topic").alias("topic_name"),
            F.col("__key").cast("string").alias("partition_key"),
            F.unix_millis(F.col("__publishTime")).alias("publish_timestamp"),
        )
        return from_pulsar(shaped)
    if broker == "pubsub":
        return from_pubsub(raw, project)
    raise ValueError(f"unknown broker {broker!r}")
