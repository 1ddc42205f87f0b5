"""Flows from a relay configuration.

The configuration is the dict a relay is described with (the caller loads it,
for example from YAML): ``mode`` (``funnel``, ``fan`` or ``one_to_one``),
``processor_class``, ``thread_pool`` and the mode's section with its
``source``/``sources``, ``destination``, ``source_topic``,
``destination_resolver``, ``mappings`` or ``destination_topic``. Each part is
mapped onto a read binding, a router, a processor and a sink; nothing else is
interpreted. Worker counts, queue sizes and fill marks describe threads and have
no meaning on Spark; a rate limit is set with ``max_per_trigger`` (messages per
micro-batch; no limit without it). ``state_path`` names the folder of the
checkpoint, the metric deltas and, for stored destinations, the topic table; a
relay that isn't drained needs it (or a table destination's path) to resume.

Further entries of a Kafka or Event Hubs ``connection`` are client settings and
are passed on under their Kafka names (``security_protocol`` becomes
``kafka.security.protocol``); unknown starting positions are refused.

Source and destination ``type``: ``kafka``, ``eventhubs``, ``pulsar``,
``google_pubsub``, ``mock`` (synthetic messages) and ``table`` (a stored
topic table at ``connection.path``, MESSAGE schema; optional
``connection.max_files_per_trigger``).
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayspark.operators.processors import process
from relayspark.operators.routing import fan, funnel, one_to_one, subscribe
from relayspark.schema import MESSAGE
from relayspark.session import configure
from relayspark.sinks.egress import in_source_order, to_eventhubs, to_kafka, to_pubsub, to_pulsar, write_broker
from relayspark.sources.bindings import eventhubs_reader_options, kafka_reader_options, read_topics
from relayspark.sources.synthetic import synthetic_stream
from relayspark.streaming.runner import run_stream


def _servers(conn: Mapping) -> str:
    s = conn.get("bootstrap_servers", "")
    return ",".join(s) if isinstance(s, (list, tuple)) else str(s)


# Entries of a connection that are mapped by name; the rest are client settings.
_MAPPED = {"bootstrap_servers", "group_id", "auto_offset_reset", "starting_position", "connection_string", "eventhub_name", "consumer_group", "sasl_plain_username", "sasl_plain_password", "fail_on_data_loss"}


# Client settings that Spark sets itself (it reads and writes bytes and
# keeps offsets in the checkpoint) and refuses, and settings of Python clients alone.
_SET_BY_SPARK = ["auto.offset.reset", "auto.commit.interval.ms", "enable.auto.commit", "interceptor.classes", "key.deserializer", "key.serializer", "value.deserializer", "value.serializer"]
_PYTHON_ONLY = ["api.version", "api.version.auto.timeout.ms", "consumer.timeout.ms", "loop", "selector"]


def _client_options(conn: Mapping) -> dict[str, str]:
    """Client settings as options of Spark's Kafka connector. Settings without a
    meaning there are left out with a warning; a value that isn't text, a number or
    a truth value is refused."""
    opts = {}
    for k, v in conn.items():
        if k in _MAPPED or v is None:
            continue
        name = k.removeprefix("kafka.").replace("_", ".")
        if name in _SET_BY_SPARK or name in _PYTHON_ONLY:
            warnings.warn(f"client setting {k!r} is left out: {'Spark sets it itself' if name in _SET_BY_SPARK else 'it belongs to another client'}", stacklevel=2)
            continue
        if not isinstance(v, (str, int, float)):
            raise ValueError(f"client setting {k!r} needs text, a number or true/false, not {type(v).__name__}")
        opts[k if k.startswith("kafka.") else f"kafka.{name}"] = str(v).lower() if isinstance(v, bool) else str(v)
    if conn.get("sasl_plain_username"):
        opts["kafka.sasl.jaas.config"] = (
            "org.apache.kafka.common.security.plain.PlainLoginModule required "
            f'username="{conn["sasl_plain_username"]}" password="{conn.get("sasl_plain_password", "")}";'
        )
    return opts


# Starting positions by source type, as Spark's startingOffsets; None: not given.
_STARTS = {
    "kafka": {None: "latest", "earliest": "earliest", "latest": "latest"},
    # An Event Hubs client starts at the start of a partition unless told otherwise.
    "eventhubs": {None: "earliest", "-1": "earliest", "@latest": "latest", "earliest": "earliest", "latest": "latest"},
    "pulsar": {None: "latest", "earliest": "earliest", "latest": "latest"},
}


def _starting(kind: str, value) -> str | dict:
    """A configured position; a dict of offsets ``{topic: {partition: offset}}`` or
    ``{"timestamp": ms}`` is passed on. Anything else is refused: guessing would
    skip or repeat stored messages."""
    if isinstance(value, Mapping):
        return dict(value)
    known = _STARTS[kind]
    name = None if value in (None, "") else str(value).lower()
    if name not in known:
        raise ValueError(f"unknown starting position {value!r} for {kind}; known: {', '.join(k for k in known if k)}, or offsets")
    return known[name]


def _eventhubs_parts(conn: Mapping) -> tuple[str, str, str]:
    cs = conn["connection_string"]
    ns = re.search(r"sb://([^.;/]+)", cs)
    hub = conn.get("eventhub_name") or (re.search(r"EntityPath=([^;]+)", cs) or [None, None])[1]
    if not ns or not hub:
        raise ValueError("Event Hubs connection needs a namespace endpoint and an event hub name")
    return ns.group(1), cs, hub


def _no_message_limit(kind: str):
    raise ValueError(f"{kind} limits a micro-batch by bytes: set connection.max_bytes_per_trigger")


def read_source(spark: SparkSession, system: Mapping, topics: list[str], max_per_trigger: int | None) -> DataFrame:
    """One configured source as a streaming MESSAGE DataFrame of ``topics``."""
    kind = system["type"]
    conn = system.get("connection", {}) or {}
    if kind == "kafka":
        extra = _client_options(conn) | ({"kafka.group.id": conn["group_id"]} if conn.get("group_id") else {})
        start = _starting(kind, conn.get("auto_offset_reset"))
        opts = kafka_reader_options(_servers(conn), topics, start, max_per_trigger, extra, fail_on_data_loss=conn.get("fail_on_data_loss", True))
        return read_topics(spark, "kafka", opts)
    if kind == "eventhubs":
        ns, cs, hub = _eventhubs_parts(conn)
        opts = eventhubs_reader_options(ns, cs, hub, _starting(kind, conn.get("starting_position")), max_per_trigger, _client_options(conn))
        return read_topics(spark, "eventhubs", opts)
    if kind == "pulsar":
        opts = {"service.url": conn["service_url"], "topics": ",".join(topics), "startingOffsets": _starting(kind, conn.get("starting_position"))}
        if isinstance(opts["startingOffsets"], dict):
            opts["startingOffsets"] = json.dumps(opts["startingOffsets"])
        if conn.get("subscription_name"):
            opts["predefinedSubscription"] = conn["subscription_name"]
        if max_per_trigger:
            opts["maxBytesPerTrigger"] = str(int(conn.get("max_bytes_per_trigger") or _no_message_limit(kind)))
        return read_topics(spark, "pulsar", opts)
    if kind == "google_pubsub":
        opts = {"projectId": conn["project_id"], "subscriptionId": conn["subscription_id"]}
        if max_per_trigger:
            opts["maxMessagesPerTrigger"] = str(int(max_per_trigger))
        return read_topics(spark, "pubsub", opts, fmt=conn.get("format", "pubsub"), project=conn["project_id"])
    if kind == "mock":
        return synthetic_stream(spark, topics, rows_per_batch=max_per_trigger or 100)
    if kind == "table":
        # A message count does not translate to files: a stored table is
        # limited by ``connection.max_files_per_trigger`` when given.
        reader = spark.readStream.schema(MESSAGE)
        if max_per_trigger and not conn.get("max_files_per_trigger"):
            warnings.warn("max_per_trigger counts messages and doesn't limit a stored table: set connection.max_files_per_trigger", stacklevel=2)
        if conn.get("max_files_per_trigger"):
            reader = reader.option("maxFilesPerTrigger", int(conn["max_files_per_trigger"]))
        return subscribe(reader.parquet(conn["path"]), topics)
    raise ValueError(f"unsupported source type {kind!r}")


def broker_sink(system: Mapping):
    """A micro-batch writer for a configured destination, or None for the
    topic table (``mock`` / ``table``)."""
    kind = system["type"]
    conn = system.get("connection", {}) or {}
    if kind == "kafka":
        opts = {"kafka.bootstrap.servers": _servers(conn), **_client_options(conn)}
        return lambda b: write_broker(to_kafka(b), "kafka", opts)
    if kind == "eventhubs":
        ns, cs, hub = _eventhubs_parts(conn)
        opts = {k: v for k, v in eventhubs_reader_options(ns, cs, hub).items() if k.startswith("kafka.")}
        opts["topic"] = hub

        def to_hub(b: DataFrame) -> DataFrame:
            e = to_eventhubs(b)
            headers = F.transform(
                F.map_entries("properties"), lambda x: F.struct(x["key"].alias("key"), F.encode(x["value"], "UTF-8").alias("value"))
            )
            return e.select(F.col("body").alias("value"), headers.alias("headers"))

        return lambda b: write_broker(to_hub(b), "kafka", opts)
    if kind == "pulsar":
        opts = {"service.url": conn["service_url"]}

        def to_pulsar_rows(b: DataFrame) -> DataFrame:
            p = to_pulsar(b)
            return p.select(
                "value", F.col("partition_key").alias("__key"), F.col("topic").alias("__topic"), F.col("properties").alias("__messageProperties")
            )

        return lambda b: write_broker(to_pulsar_rows(b), "pulsar", opts)
    if kind == "google_pubsub":
        return lambda b: write_broker(to_pubsub(b, conn["project_id"]), conn.get("format", "pubsub"), {"projectId": conn["project_id"]})
    if kind in ("mock", "table"):
        return None
    raise ValueError(f"unsupported destination type {kind!r}")


def flow_from_config(spark: SparkSession, cfg: Mapping) -> tuple[DataFrame, Mapping]:
    """The routed and processed stream of a configuration, and its destination."""
    configure(spark)
    mode = cfg["mode"]
    if mode not in ("funnel", "fan", "one_to_one"):
        raise ValueError(f"unknown mode {mode!r}")
    section = cfg[mode]
    limit = cfg.get("max_per_trigger")
    if mode == "funnel":
        sources = [read_source(spark, s, list(s.get("topics") or []), limit) for s in section["sources"]]
        routed = funnel(sources, section["destination_topic"])
    elif mode == "fan":
        # The source reads this topic alone; its messages carry the broker's own topic names.
        routed = fan(read_source(spark, section["source"], [section["source_topic"]], limit), section["destination_resolver"])
    else:
        routes = [(m["source_topic"], m["destination_topic"]) for m in section["mappings"]]
        topics = list(dict(routes))
        routed = one_to_one(read_source(spark, section["source"], topics, limit), routes)
    return process(routed, cfg.get("processor_class") or None), section["destination"]


def start_from_config(spark: SparkSession, cfg: Mapping, out_dir: str | None = None, drain: bool = False, processing_time: str | None = None):
    """Start the configured relay: returns ``(query, out_dir)``; metric deltas
    (and, for ``mock`` / ``table`` destinations, the topic table) are under
    ``out_dir``. ``preserve_order``: a broker gets each source partition's messages
    in order of their offsets (T-04), for one shuffle of every batch."""
    routed, destination = flow_from_config(spark, cfg)
    conn = destination.get("connection", {}) or {}
    out_dir = out_dir or cfg.get("state_path") or (conn.get("path") if destination["type"] == "table" else None)
    sink = broker_sink(destination)
    if sink is not None and cfg.get("preserve_order"):
        send = sink
        sink = lambda batch: send(in_source_order(batch))
    return run_stream(routed, out_dir=out_dir, drain=drain, processing_time=processing_time, sink=sink)
