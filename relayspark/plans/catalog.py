"""Registered queries over the driver tables, each with its DuckDB oracle.

Every query reads whole driver tables (``events``, ``documents``,
``conversations``) turned into messages, and returns plain columns (no map,
variant or binary) so that the oracle can be compared value by value. Column
names match the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relayspark.functions.message import header_bytes, message_size
from relayspark.operators import checks
from relayspark.operators.metrics import (
    batch_deltas,
    delivered,
    counter_rows,
    destination_metrics,
    loss_check,
    metrics_since_batch,
    topic_report,
    source_metrics,
    windowed_errors,
    windowed_throughput,
    windowed_volume,
)
from relayspark.operators.processors import (
    add_processing_time,
    header_stamp,
    json_enrich,
    load_processor,
    priority_tag,
    process,
)
from relayspark.operators.routing import fan, funnel, one_to_one, subscribe
from relayspark.session import configure
from relayspark.sinks.egress import deliverable, to_eventhubs, to_kafka, to_pubsub, to_pulsar
from relayspark.sources.normalise import from_eventhubs, from_kafka, from_pubsub, from_pulsar
from relayspark.sources.replay import replay_from
from relayspark.sources.synthetic import synthetic_messages
from relayspark.sources.tables import (
    conversations_messages,
    documents_messages,
    events_messages,
    events_to_messages,
    eventhubs_raw_from_events,
    kafka_raw_from_events,
    pubsub_raw_from_events,
    pulsar_raw_from_events,
    read_table,
    stream_table,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return wrap


HEADER = {"type": "header", "key": "destination_topic"}
PAYLOAD_K = {"type": "payload_key", "key": "k"}
ROUTES = [("signup", "signups"), ("purchase", "orders"), ("click", "clicks-old"), ("click", "clicks"), ("view", "views")]
ROUTES_SQL = "(VALUES ('signup','signups'), ('purchase','orders'), ('click','clicks'), ('view','views')) AS r(src, dst)"
LOSS_ROUTES = [("signup", "signups"), ("purchase", "orders"), ("click", "clicks"), ("view", "views"), ("error", "errors")]
FIXED_NOW = "2024-05-01 12:30:45.123456"

# --------------------------------------------------------------------------
# DuckDB fragments: the events view with its fault pattern, and sizes.
# --------------------------------------------------------------------------

EV = """ev AS (
  SELECT event_id AS msg_offset, ts, event_type, user_id, props,
    CAST(event_id % 4 AS INTEGER) AS msg_partition,
    CASE event_id % 10 WHEN 0 THEN substr(props, 2) WHEN 1 THEN '[1]' WHEN 3 THEN NULL ELSE props END AS payload,
    CASE WHEN event_id % 10 = 2 THEN NULL ELSE event_type END AS h_dest,
    CAST(user_id AS VARCHAR) AS msg_key
  FROM events),
evs AS (
  SELECT *, CAST(strlen(payload) + coalesce(17 + strlen(h_dest), 0) + coalesce(strlen(msg_key), 0) AS BIGINT) AS size,
    CASE WHEN payload IS NULL THEN NULL ELSE coalesce(h_dest, 'default') END AS dest_topic,
    CASE WHEN payload IS NULL THEN 'null payload' END AS error,
    CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END AS is_obj
  FROM ev),
el AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE) AS elapsed FROM events)"""

RATE = "CASE WHEN el.elapsed > 0 THEN count(size) / el.elapsed ELSE CAST(0 AS DOUBLE) END"


def _ts(col: str) -> F.Column:
    return F.col(col).cast("timestamp_ntz")


def _metric_cols(df: DataFrame, with_rate: bool = True) -> DataFrame:
    cols = [
        "topic",
        "message_count",
        "total_bytes",
        "error_count",
        _ts("last_message_time").alias("last_message_time"),
    ]
    if with_rate:
        cols.append("rate_per_second")
    return df.select(*cols)


# --------------------------------------------------------------------------
# Routing
# --------------------------------------------------------------------------


@register(
    "fan_header_metrics",
    f"""WITH {EV}
SELECT dest_topic, count(*)::BIGINT AS message_count, sum(size)::BIGINT AS total_bytes
FROM evs WHERE error IS NULL GROUP BY dest_topic""",
)
def fan_header_metrics(spark, sf_dir):
    """Flagship (F-02, M-02): fan by header, then destination metrics."""
    routed = fan(events_messages(spark, sf_dir), HEADER)
    m = destination_metrics(routed, elapsed=1.0)
    return m.select(F.col("topic").alias("dest_topic"), "message_count", "total_bytes")


@register(
    "fan_header_default",
    f"""WITH {EV}
SELECT msg_offset, dest_topic, error FROM evs""",
)
def fan_header_default(spark, sf_dir):
    """F-02 / X-02: absent header -> 'default'; null payload -> source error."""
    routed = fan(events_messages(spark, sf_dir), HEADER)
    return routed.select(F.col("offset").alias("msg_offset"), "dest_topic", "error")


@register(
    "fan_payload_key",
    f"""WITH {EV}
SELECT msg_offset,
  CASE WHEN payload IS NULL THEN NULL
       WHEN NOT is_obj THEN 'default'
       WHEN json_extract(payload, '$.k') IS NULL THEN 'default'
       ELSE json_extract_string(payload, '$.k') END AS dest_topic,
  error
FROM evs""",
)
def fan_payload_key(spark, sf_dir):
    """F-03 / X-03..X-05: route by the payload's top-level JSON member ``k``."""
    routed = fan(events_messages(spark, sf_dir), PAYLOAD_K)
    return routed.select(F.col("offset").alias("msg_offset"), "dest_topic", "error")


@register(
    "fan_unknown_resolver",
    f"""WITH {EV}
SELECT 'default' AS dest_topic, count(*)::BIGINT AS message_count, sum(size)::BIGINT AS total_bytes
FROM evs WHERE error IS NULL""",
)
def fan_unknown_resolver(spark, sf_dir):
    """F-04: an unknown resolver type sends every message to 'default'."""
    routed = fan(events_messages(spark, sf_dir), {"type": "topic_hash", "key": "k"})
    m = destination_metrics(routed, elapsed=1.0)
    return m.select(F.col("topic").alias("dest_topic"), "message_count", "total_bytes")


FUNNEL_SQL = f"""WITH {EV},
docs AS (
  SELECT 'documents' AS topic,
    CAST(strlen(text) + 4 + strlen(lang) + 6 + strlen(source) + strlen(CAST(doc_id AS VARCHAR)) AS BIGINT) AS size,
    CASE WHEN text IS NULL THEN 'null payload' END AS error
  FROM documents),
convs AS (
  SELECT 'conversations' AS topic,
    CAST(strlen(text) + 4 + strlen(role) + 4 + strlen(CAST(turn AS VARCHAR)) + strlen(CAST(conv_id AS VARCHAR)) AS BIGINT) AS size,
    CASE WHEN text IS NULL THEN 'null payload' END AS error
  FROM conversations),
allm AS (
  SELECT 'events' AS topic, size, error FROM evs
  UNION ALL SELECT * FROM docs
  UNION ALL SELECT * FROM convs)
SELECT 'source' AS side, topic, count(size)::BIGINT AS message_count, coalesce(sum(size), 0)::BIGINT AS total_bytes,
  count(error)::BIGINT AS error_count
FROM allm GROUP BY topic
UNION ALL
SELECT 'destination', 'funnel-destination', count(size)::BIGINT, coalesce(sum(size), 0)::BIGINT, 0::BIGINT
FROM allm WHERE error IS NULL"""


@register("funnel_union", FUNNEL_SQL)
def funnel_union(spark, sf_dir):
    """F-01: events, documents and conversations into one topic (UNION ALL)."""
    routed = funnel(
        [events_messages(spark, sf_dir), documents_messages(spark, sf_dir), conversations_messages(spark, sf_dir)],
        "funnel-destination",
    )
    rep = topic_report(routed, elapsed=1.0)
    return rep.select("side", "topic", "message_count", "total_bytes", "error_count")


ONE_TO_ONE_SQL = f"""WITH {EV}
SELECT msg_offset, event_type AS topic, CASE WHEN error IS NULL THEN r.dst END AS dest_topic, error
FROM evs JOIN {ROUTES_SQL} ON evs.event_type = r.src"""


@register("one_to_one_route", ONE_TO_ONE_SQL)
def one_to_one_route(spark, sf_dir):
    """F-05 / F-06: lookup by topic through a literal map; unmapped topics
    skipped; a repeated source keeps its last destination."""
    routed = one_to_one(events_messages(spark, sf_dir, topic=None), ROUTES)
    return routed.select(F.col("offset").alias("msg_offset"), "topic", "dest_topic", "error")


@register("one_to_one_table", ONE_TO_ONE_SQL)
def one_to_one_table(spark, sf_dir):
    """F-05 / F-06 with a DataFrame route table (last by ``pos`` wins; joined
    by broadcast after a size check)."""
    table = spark.createDataFrame(
        [(s, d, i) for i, (s, d) in enumerate(ROUTES)], "source_topic string, destination_topic string, pos int"
    )
    routed = one_to_one(events_messages(spark, sf_dir, topic=None), table)
    return routed.select(F.col("offset").alias("msg_offset"), "topic", "dest_topic", "error")


@register(
    "route_before_process",
    f"""WITH {EV}
SELECT msg_offset, dest_topic, CASE WHEN error IS NULL THEN 'rewritten' ELSE h_dest END AS header_after
FROM evs""",
)
def route_before_process(spark, sf_dir):
    """F-08 / P-06: a processor rewriting the routing header cannot move a message."""
    routed = fan(events_messages(spark, sf_dir), HEADER)
    out = header_stamp(routed, "destination_topic", "rewritten")
    return out.select(
        F.col("offset").alias("msg_offset"), "dest_topic", F.col("headers")["destination_topic"].alias("header_after")
    )


# --------------------------------------------------------------------------
# Processors
# --------------------------------------------------------------------------

PRIORITY_SQL = f"""WITH {EV},
p AS (SELECT *, CASE WHEN is_obj THEN CAST(json_extract_string(payload, '$.k') AS BIGINT) END AS k FROM evs WHERE error IS NULL)
SELECT msg_offset,
  CASE WHEN is_obj AND coalesce(k, 0) < 50 THEN 'true' ELSE 'false' END AS filtered,
  CASE WHEN NOT is_obj THEN 'parse_error'
       WHEN coalesce(k, 0) < 50 THEN 'priority ' || CAST(coalesce(k, 0) AS VARCHAR) || ' < 50' END AS reason
FROM p"""


@register("priority_tag", PRIORITY_SQL)
def priority_tag_q(spark, sf_dir):
    """P-05 / X-09: tag by payload member ``k`` against minimum 50."""
    routed = fan(events_messages(spark, sf_dir), HEADER)
    out = deliverable(priority_tag(routed, key="k", min_priority=50))
    return out.select(
        F.col("offset").alias("msg_offset"),
        F.col("headers")["filtered"].alias("filtered"),
        F.col("headers")["reason"].alias("reason"),
    )


@register(
    "json_enrich",
    f"""WITH {EV}
SELECT msg_offset,
  CASE WHEN is_obj THEN 'true' END AS enriched,
  CASE WHEN is_obj THEN '1.0' END AS processor_version,
  CASE WHEN is_obj THEN json_extract_string(payload, '$.k') END AS k,
  CASE WHEN is_obj THEN NULL
       WHEN NOT json_valid(payload) THEN 'invalid JSON'
       WHEN json_type(payload) = 'ARRAY' THEN 'list indices must be integers or slices, not str'
       ELSE 'not a JSON object' END AS enrichment_error
FROM evs WHERE error IS NULL""",
)
def json_enrich_q(spark, sf_dir):
    """P-04 / X-06: add two members to JSON object payloads; others get a header."""
    routed = fan(events_messages(spark, sf_dir), HEADER)
    out = deliverable(json_enrich(routed))
    text = F.col("payload").cast("string")
    return out.select(
        F.col("offset").alias("msg_offset"),
        F.get_json_object(text, "$.enriched").alias("enriched"),
        F.get_json_object(text, "$.processor_version").alias("processor_version"),
        F.get_json_object(text, "$.k").alias("k"),
        F.col("headers")["enrichment_error"].alias("enrichment_error"),
    )


@register(
    "header_stamp",
    f"""WITH {EV}
SELECT msg_offset,
  CASE WHEN error IS NULL THEN '2024-05-01T12:30:45.123456' END AS processed_at,
  CASE WHEN error IS NULL THEN 'AddTimestampProcessor' END AS processor,
  CASE WHEN error IS NULL THEN 'relay' END AS stamped_by,
  CAST((CASE WHEN h_dest IS NULL THEN 0 ELSE 1 END) + (CASE WHEN error IS NULL THEN 3 ELSE 0 END) AS INTEGER) AS header_count
FROM evs""",
)
def header_stamp_q(spark, sf_dir):
    """P-03 (given time) / P-06 / X-07 / X-08; P-02: the stamp processor is
    loaded by dotted name."""
    routed = fan(events_messages(spark, sf_dir), HEADER)
    out = add_processing_time(routed, now=FIXED_NOW)
    out = process(out, "relayspark.plans.examples.StampProcessor")
    return out.select(
        F.col("offset").alias("msg_offset"),
        F.col("headers")["processed_at"].alias("processed_at"),
        F.col("headers")["processor"].alias("processor"),
        F.col("headers")["stamped_by"].alias("stamped_by"),
        F.size("headers").alias("header_count"),
    )


PARITY_SQL = f"""WITH {EV},
pe AS (SELECT *, CASE WHEN error IS NULL AND NOT is_obj THEN 'failed' END AS perr,
         CASE WHEN is_obj THEN CAST(json_extract_string(payload, '$.k') AS BIGINT) END AS k FROM evs)
SELECT 'source' AS side, 'events' AS topic, count(size)::BIGINT AS message_count,
  coalesce(sum(size), 0)::BIGINT AS total_bytes, (count(error) + count(perr))::BIGINT AS error_count
FROM pe
UNION ALL
SELECT 'destination', dest_topic, count(*)::BIGINT,
  sum(size + 8 + CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END)::BIGINT, 0::BIGINT
FROM pe WHERE error IS NULL AND perr IS NULL GROUP BY dest_topic"""


@register("processor_errors", PARITY_SQL)
def processor_errors(spark, sf_dir):
    """P-02 / P-07 / Q-09: a Python row processor loaded by name; a failing
    message is counted and adds one source error, and is not delivered."""
    routed = fan(events_messages(spark, sf_dir), HEADER)
    out = process(routed, load_processor("relayspark.plans.examples.ParityProcessor"))
    rep = topic_report(out, elapsed=1.0)
    return rep.select("side", "topic", "message_count", "total_bytes", "error_count")


@register(
    "message_size",
    f"""WITH {EV}
SELECT event_type AS topic, count(size)::BIGINT AS messages, sum(size)::BIGINT AS total_bytes,
  sum(CASE WHEN size IS NOT NULL THEN strlen(payload) END)::BIGINT AS payload_bytes,
  sum(CASE WHEN size IS NOT NULL THEN coalesce(17 + strlen(h_dest), 0) END)::BIGINT AS header_bytes,
  sum(CASE WHEN size IS NOT NULL THEN strlen(msg_key) END)::BIGINT AS key_bytes
FROM evs GROUP BY event_type""",
)
def message_size_q(spark, sf_dir):
    """X-01 / X-10: message size and its parts per topic."""
    m = events_messages(spark, sf_dir, topic=None).withColumn("size", message_size())
    ok = F.col("size").isNotNull()
    hdr = header_bytes("headers")
    return m.groupBy("topic").agg(
        F.count("size").alias("messages"),
        F.sum("size").cast("bigint").alias("total_bytes"),
        F.sum(F.when(ok, F.octet_length("payload"))).cast("bigint").alias("payload_bytes"),
        F.sum(F.when(ok, hdr)).cast("bigint").alias("header_bytes"),
        F.sum(F.when(ok, F.octet_length(F.encode("key", "UTF-8")))).cast("bigint").alias("key_bytes"),
    )


# --------------------------------------------------------------------------
# Metrics
# --------------------------------------------------------------------------

SOURCE_SQL = f"""WITH {EV}
SELECT event_type AS topic, count(size)::BIGINT AS message_count, coalesce(sum(size), 0)::BIGINT AS total_bytes,
  count(error)::BIGINT AS error_count, max(CASE WHEN size IS NOT NULL THEN ts END) AS last_message_time,
  {RATE} AS rate_per_second
FROM evs, el GROUP BY event_type, el.elapsed"""

DEST_SQL = f"""WITH {EV}
SELECT dest_topic AS topic, count(*)::BIGINT AS message_count, sum(size)::BIGINT AS total_bytes,
  0::BIGINT AS error_count, max(ts) AS last_message_time,
  CASE WHEN el.elapsed > 0 THEN count(*) / el.elapsed ELSE CAST(0 AS DOUBLE) END AS rate_per_second
FROM evs, el WHERE error IS NULL GROUP BY dest_topic, el.elapsed"""


def _fan_by_type(spark, sf_dir):
    return fan(events_messages(spark, sf_dir, topic=None), HEADER)


@register("source_metrics", SOURCE_SQL)
def source_metrics_q(spark, sf_dir):
    """M-01, M-03..M-05: per source topic; rate over the replayed event-time span."""
    return _metric_cols(source_metrics(_fan_by_type(spark, sf_dir)))


@register("destination_metrics", DEST_SQL)
def destination_metrics_q(spark, sf_dir):
    """M-02..M-05: per destination topic, after processing, on delivery."""
    return _metric_cols(destination_metrics(_fan_by_type(spark, sf_dir)))


REPORT_SQL = f"""WITH {EV},
src AS (SELECT event_type AS topic, count(size)::BIGINT AS message_count, coalesce(sum(size), 0)::BIGINT AS total_bytes,
  count(error)::BIGINT AS error_count, max(CASE WHEN size IS NOT NULL THEN ts END) AS last_message_time, {RATE} AS rate_per_second
  FROM evs, el GROUP BY event_type, el.elapsed),
dst AS (SELECT dest_topic AS topic, count(*)::BIGINT AS message_count, sum(size)::BIGINT AS total_bytes,
  0::BIGINT AS error_count, max(ts) AS last_message_time, {RATE} AS rate_per_second
  FROM evs, el WHERE error IS NULL GROUP BY dest_topic, el.elapsed)
SELECT 'source' AS side, * FROM src UNION ALL SELECT 'destination' AS side, * FROM dst"""


@register("metrics_report", REPORT_SQL)
def metrics_report_q(spark, sf_dir):
    """M-06: both sides keyed by topic, from one read of the routed rows."""
    rep = topic_report(_fan_by_type(spark, sf_dir))
    return rep.select(
        "side",
        "topic",
        "message_count",
        "total_bytes",
        "error_count",
        _ts("last_message_time").alias("last_message_time"),
        "rate_per_second",
    )


@register(
    "metrics_since_batch",
    f"""WITH {EV},
b AS (SELECT * FROM evs WHERE day(ts) - 1 > 14),
src AS (SELECT event_type AS topic, count(size)::BIGINT AS message_count, coalesce(sum(size), 0)::BIGINT AS total_bytes,
  count(error)::BIGINT AS error_count, max(CASE WHEN size IS NOT NULL THEN ts END) AS last_message_time
  FROM b GROUP BY event_type),
dst AS (SELECT dest_topic AS topic, count(*)::BIGINT AS message_count, sum(size)::BIGINT AS total_bytes,
  0::BIGINT AS error_count, max(ts) AS last_message_time FROM b WHERE error IS NULL GROUP BY dest_topic)
SELECT 'source' AS side, * FROM src UNION ALL SELECT 'destination' AS side, * FROM dst""",
)
def metrics_since_batch_q(spark, sf_dir):
    """M-07: a reset starts a new epoch; only deltas of later batches count.
    Batches here are the days of the replayed month (batch = day - 1)."""
    routed = _fan_by_type(spark, sf_dir).withColumn("batch_id", (F.dayofmonth("timestamp") - 1).cast("bigint"))
    out = metrics_since_batch(batch_deltas(routed), 14)
    return out.select(
        "side", "topic", "message_count", "total_bytes", "error_count", _ts("last_message_time").alias("last_message_time")
    )


@register(
    "counter_rows",
    f"""WITH {EV},
src AS (SELECT event_type AS topic, count(size)::BIGINT AS m, coalesce(sum(size), 0)::BIGINT AS b, count(error)::BIGINT AS e
  FROM evs GROUP BY event_type),
dst AS (SELECT dest_topic AS topic, count(*)::BIGINT AS m, sum(size)::BIGINT AS b, 0::BIGINT AS e
  FROM evs WHERE error IS NULL GROUP BY dest_topic),
u AS (
  SELECT 'relay.source.messages' AS metric, topic, m AS value FROM src
  UNION ALL SELECT 'relay.source.bytes', topic, b FROM src
  UNION ALL SELECT 'relay.source.errors', topic, e FROM src
  UNION ALL SELECT 'relay.destination.messages', topic, m FROM dst
  UNION ALL SELECT 'relay.destination.bytes', topic, b FROM dst
  UNION ALL SELECT 'relay.destination.errors', topic, e FROM dst)
SELECT metric, topic, value FROM u WHERE value <> 0""",
)
def counter_rows_q(spark, sf_dir):
    """M-08: exported counters as (metric, topic, value) rows."""
    return counter_rows(topic_report(_fan_by_type(spark, sf_dir), elapsed=1.0))


def _bucket_sql(value: str, topic: str, name: str, where: str = "") -> str:
    return f"""WITH {EV}
SELECT make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS window_start,
  make_timestamp((epoch_us(ts) // 300000000) * 300000000 + 300000000) AS window_end,
  {topic} AS topic, {value} / CAST(300 AS DOUBLE) AS {name}
FROM evs {where} GROUP BY 1, 2, 3"""


def _window_cols(df: DataFrame, name: str) -> DataFrame:
    return df.select(_ts("window_start").alias("window_start"), _ts("window_end").alias("window_end"), "topic", name)


@register("windowed_throughput", _bucket_sql("count(size)", "event_type", "messages_per_second"))
def windowed_throughput_q(spark, sf_dir):
    """M-09: 5-minute message rate per source topic."""
    return _window_cols(windowed_throughput(_fan_by_type(spark, sf_dir)), "messages_per_second")


@register("windowed_volume", _bucket_sql("sum(size)", "dest_topic", "bytes_per_second", "WHERE error IS NULL"))
def windowed_volume_q(spark, sf_dir):
    """M-10: 5-minute delivered byte rate per destination topic."""
    return _window_cols(windowed_volume(_fan_by_type(spark, sf_dir)), "bytes_per_second")


@register("windowed_errors", _bucket_sql("count(error)", "event_type", "errors_per_second"))
def windowed_errors_q(spark, sf_dir):
    """M-11: 5-minute source error rate per source topic."""
    return _window_cols(windowed_errors(_fan_by_type(spark, sf_dir)), "errors_per_second")


@register(
    "loss_check",
    f"""WITH {EV},
r AS (SELECT * FROM (VALUES ('signup','signups'), ('purchase','orders'), ('click','clicks'), ('view','views'), ('error','errors')) AS t(src, dst)),
j AS (SELECT evs.*, r.dst, CASE WHEN error IS NULL AND NOT is_obj THEN 'failed' END AS perr FROM evs JOIN r ON evs.event_type = r.src)
SELECT dst AS dest_topic, count(size)::BIGINT AS source_count,
  count(CASE WHEN error IS NULL AND perr IS NULL THEN 1 END)::BIGINT AS dest_count,
  (count(size) - count(CASE WHEN error IS NULL AND perr IS NULL THEN 1 END))::BIGINT AS lost
FROM j GROUP BY dst""",
)
def loss_check_q(spark, sf_dir):
    """M-12: source count per route against delivered count; processor
    failures show up as loss."""
    routed = one_to_one(events_messages(spark, sf_dir, topic=None), LOSS_ROUTES)
    out = process(routed, "relayspark.plans.examples.ParityProcessor")
    return loss_check(topic_report(out, elapsed=1.0), LOSS_ROUTES)


# --------------------------------------------------------------------------
# Sources
# --------------------------------------------------------------------------


@register(
    "synthetic_topics",
    """SELECT CASE (event_id) % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS topic,
  'key-' || CAST(event_id + 1 AS VARCHAR) AS msg_key,
  'Mock message ' || CAST(event_id + 1 AS VARCHAR) AS payload_text,
  'mock' AS source, CAST(event_id + 1 AS VARCHAR) AS count
FROM events""",
)
def synthetic_topics_q(spark, sf_dir):
    """S-05: message n goes round-robin to the topics (n from the events ids)."""
    ids = read_table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("id"))
    m = synthetic_messages(ids, ["alpha", "beta", "gamma"])
    return m.select(
        "topic",
        F.col("key").alias("msg_key"),
        F.col("payload").cast("string").alias("payload_text"),
        F.col("headers")["source"].alias("source"),
        F.col("headers")["count"].alias("count"),
    )


@register(
    "normalise_kafka",
    """WITH e AS (SELECT *, CASE event_id % 10 WHEN 0 THEN substr(props, 2) WHEN 1 THEN '[1]' WHEN 3 THEN NULL ELSE props END AS payload
  FROM events)
SELECT event_id AS msg_offset, event_type AS topic,
  CASE WHEN event_id % 7 = 0 OR event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS msg_key,
  payload AS payload_text, event_type AS h_dest, CAST(event_id AS VARCHAR) AS h_dup,
  CASE WHEN event_id % 2 = 0 THEN 'None' ELSE 'v' END AS h_none,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE 'ok' END AS h_check,
  CAST(4 AS INTEGER) AS header_count,
  CASE WHEN event_id % 11 = 0 THEN 'undecodable header'
       WHEN event_id % 13 = 0 AND event_id % 7 <> 0 THEN 'undecodable key' END AS error
FROM e""",
)
def normalise_kafka_q(spark, sf_dir):
    """S-01 / N-01..N-03: Kafka rows -> messages (duplicate header: last wins;
    missing value 'None'; empty key NULL; undecodable bytes -> error row)."""
    m = from_kafka(kafka_raw_from_events(read_table(spark, sf_dir, "events")))
    h = F.col("headers")
    return m.select(
        F.col("offset").alias("msg_offset"),
        "topic",
        F.col("key").alias("msg_key"),
        F.col("payload").cast("string").alias("payload_text"),
        h["destination_topic"].alias("h_dest"),
        h["dup"].alias("h_dup"),
        h["none"].alias("h_none"),
        h["check"].alias("h_check"),
        F.size(h).alias("header_count"),
        "error",
    )


@register(
    "normalise_pulsar",
    """SELECT 'persistent://public/default/' || event_type AS topic,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS msg_key,
  props AS payload_text, event_type AS h_dest,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE date_trunc('millisecond', ts) END AS msg_time
FROM events""",
)
def normalise_pulsar_q(spark, sf_dir):
    """S-02 / N-03 / N-04: Pulsar rows -> messages (ms time, 0 -> NULL)."""
    m = from_pulsar(pulsar_raw_from_events(read_table(spark, sf_dir, "events")))
    return m.select(
        "topic",
        F.col("key").alias("msg_key"),
        F.col("payload").cast("string").alias("payload_text"),
        F.col("headers")["destination_topic"].alias("h_dest"),
        _ts("timestamp").alias("msg_time"),
    )


@register(
    "normalise_eventhubs",
    """SELECT 'eventhub-' || CAST(event_id % 4 AS VARCHAR) AS topic, CAST(event_id % 4 AS INTEGER) AS msg_partition,
  event_id AS msg_offset, props AS payload_text, 'application/json' AS content_type, event_type AS h_event_type,
  ts AS msg_time
FROM events WHERE event_id % 10 <> 5""",
)
def normalise_eventhubs_q(spark, sf_dir):
    """S-03 / N-01 / N-05: Event Hubs rows -> messages; null events skipped."""
    m = from_eventhubs(eventhubs_raw_from_events(read_table(spark, sf_dir, "events")))
    return m.select(
        "topic",
        F.col("partition").alias("msg_partition"),
        F.col("offset").alias("msg_offset"),
        F.col("payload").cast("string").alias("payload_text"),
        F.col("headers")["content-type"].alias("content_type"),
        F.col("headers")["event_type"].alias("h_event_type"),
        _ts("timestamp").alias("msg_time"),
    )


@register(
    "normalise_pubsub",
    """SELECT 'projects/demo-project/subscriptions/sub-' || event_type AS topic, props AS payload_text,
  'prod' AS env, event_type AS h_event_type, ts AS msg_time
FROM events""",
)
def normalise_pubsub_q(spark, sf_dir):
    """S-04 / N-05: Pub/Sub rows -> messages; topic is the subscription path."""
    m = from_pubsub(pubsub_raw_from_events(read_table(spark, sf_dir, "events")), project="demo-project")
    return m.select(
        "topic",
        F.col("payload").cast("string").alias("payload_text"),
        F.col("headers")["env"].alias("env"),
        F.col("headers")["event_type"].alias("h_event_type"),
        _ts("timestamp").alias("msg_time"),
    )


@register(
    "topic_subscription",
    f"""WITH {EV}
SELECT event_type AS topic, count(size)::BIGINT AS message_count, count(error)::BIGINT AS error_count
FROM evs WHERE event_type IN ('purchase', 'signup') GROUP BY event_type""",
)
def topic_subscription_q(spark, sf_dir):
    """S-07: only subscribed topics are read (the filter reaches the scan)."""
    m = subscribe(events_messages(spark, sf_dir, topic=None), ["purchase", "signup"])
    sm = source_metrics(fan(m, HEADER), elapsed=1.0)
    return sm.select("topic", "message_count", "error_count")


@register(
    "replay_from",
    """WITH e AS (SELECT event_type AS topic, CAST(event_id % 4 AS INTEGER) AS msg_partition, event_id AS msg_offset FROM events),
s AS (SELECT topic, msg_partition, min(msg_offset) + (max(msg_offset) - min(msg_offset)) // 2 AS start_offset
  FROM e WHERE topic <> 'error' GROUP BY 1, 2)
SELECT e.topic, e.msg_partition, count(*)::BIGINT AS messages, min(e.msg_offset) AS first_offset
FROM e LEFT JOIN s USING (topic, msg_partition)
WHERE s.start_offset IS NULL OR e.msg_offset >= s.start_offset
GROUP BY 1, 2""",
)
def replay_from_q(spark, sf_dir):
    """S-08: replay each (topic, partition) from a start offset (here the
    midpoint of its stored range; topic 'error' has none and replays whole)."""
    m = events_messages(spark, sf_dir, topic=None)
    starts = (
        m.filter(F.col("topic") != "error")
        .groupBy("topic", "partition")
        .agg((F.min("offset") + F.floor((F.max("offset") - F.min("offset")) / 2)).cast("bigint").alias("start_offset"))
    )
    kept = replay_from(m, starts)
    return kept.groupBy("topic", F.col("partition").alias("msg_partition")).agg(
        F.count(F.lit(1)).alias("messages"), F.min("offset").alias("first_offset")
    )


# --------------------------------------------------------------------------
# Sinks
# --------------------------------------------------------------------------


@register(
    "egress_kafka",
    f"""WITH {EV}
SELECT dest_topic AS topic, msg_key, payload AS value_text,
  CAST(CASE WHEN h_dest IS NULL THEN 0 ELSE 1 END AS INTEGER) AS header_count, h_dest
FROM evs WHERE error IS NULL""",
)
def egress_kafka_q(spark, sf_dir):
    """K-01 / X-10: key, value, byte headers, topic."""
    k = to_kafka(fan(events_messages(spark, sf_dir), HEADER))
    dest = F.filter("headers", lambda h: h["key"] == "destination_topic")
    return k.select(
        "topic",
        F.col("key").cast("string").alias("msg_key"),
        F.col("value").cast("string").alias("value_text"),
        F.size("headers").alias("header_count"),
        F.try_element_at(dest, F.lit(1))["value"].cast("string").alias("h_dest"),
    )


@register(
    "egress_pulsar",
    f"""WITH {EV}
SELECT dest_topic AS topic, msg_key AS partition_key, payload AS value_text, h_dest
FROM evs WHERE error IS NULL""",
)
def egress_pulsar_q(spark, sf_dir):
    """K-02: payload, properties, partition key, topic."""
    p = to_pulsar(fan(events_messages(spark, sf_dir), HEADER))
    return p.select(
        "topic", "partition_key", F.col("value").cast("string").alias("value_text"), F.col("properties")["destination_topic"].alias("h_dest")
    )


@register(
    "egress_eventhubs",
    f"""WITH {EV}
SELECT payload AS body_text, h_dest, CAST(CASE WHEN h_dest IS NULL THEN 0 ELSE 1 END AS INTEGER) AS header_count
FROM evs WHERE error IS NULL""",
)
def egress_eventhubs_q(spark, sf_dir):
    """K-03: payload and properties only; topic and key are not sent."""
    e = to_eventhubs(fan(events_messages(spark, sf_dir), HEADER))
    return e.select(
        F.col("body").cast("string").alias("body_text"),
        F.col("properties")["destination_topic"].alias("h_dest"),
        F.size("properties").alias("header_count"),
    )


@register(
    "egress_pubsub",
    f"""WITH {EV}
SELECT 'projects/demo-project/topics/' || dest_topic AS topic, payload AS data_text, h_dest
FROM evs WHERE error IS NULL""",
)
def egress_pubsub_q(spark, sf_dir):
    """K-04: payload and attributes to the project's topic path."""
    p = to_pubsub(fan(events_messages(spark, sf_dir), HEADER), "demo-project")
    return p.select("topic", F.col("data").cast("string").alias("data_text"), F.col("attributes")["destination_topic"].alias("h_dest"))


# --------------------------------------------------------------------------
# Documents: large text payloads, skewed topics
# --------------------------------------------------------------------------

DOCS_SQL = """SELECT {dest} AS topic, count(*)::BIGINT AS message_count,
  sum(strlen(text) + 4 + strlen(lang) + 6 + strlen(source) + strlen(CAST(doc_id AS VARCHAR)))::BIGINT AS total_bytes,
  0::BIGINT AS error_count
FROM documents WHERE text IS NOT NULL GROUP BY 1"""


@register("fan_documents_lang", DOCS_SQL.format(dest="lang"))
def fan_documents_lang(spark, sf_dir):
    """F-02 on whole documents: route by header ``lang`` (one language holds
    most rows), destination metrics."""
    routed = fan(documents_messages(spark, sf_dir), {"type": "header", "key": "lang"})
    return destination_metrics(routed, elapsed=1.0).select("topic", "message_count", "total_bytes", "error_count")


@register("fan_documents_payload", DOCS_SQL.format(dest="'default'"))
def fan_documents_payload(spark, sf_dir):
    """F-03 on whole documents: prose is not a JSON object, so all go to 'default'."""
    routed = fan(documents_messages(spark, sf_dir), {"type": "payload_key", "key": "lang"})
    return destination_metrics(routed, elapsed=1.0).select("topic", "message_count", "total_bytes", "error_count")


# --------------------------------------------------------------------------
# Checks
# --------------------------------------------------------------------------


def _delivered_events(spark, sf_dir) -> DataFrame:
    return deliverable(fan(events_messages(spark, sf_dir), HEADER))


@register(
    "check_counts",
    f"""WITH {EV},
a AS (SELECT dest_topic AS topic, count(*)::BIGINT AS actual_count FROM evs WHERE error IS NULL GROUP BY 1),
x AS (SELECT event_type AS topic, count(*)::BIGINT AS expected_count FROM events GROUP BY 1)
SELECT coalesce(a.topic, x.topic) AS topic, coalesce(actual_count, 0)::BIGINT AS actual_count,
  coalesce(expected_count, 0)::BIGINT AS expected_count,
  coalesce(actual_count, 0) = coalesce(expected_count, 0) AS ok
FROM a FULL OUTER JOIN x ON a.topic = x.topic""",
)
def check_counts_q(spark, sf_dir):
    """V-01: delivered count per topic against the raw count per event type."""
    expected = read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic")).agg(
        F.count(F.lit(1)).alias("expected_count")
    )
    return checks.check_counts(_delivered_events(spark, sf_dir), expected)


@register(
    "check_contains",
    f"""WITH {EV}
SELECT dest_topic AS topic, bool_or(coalesce(contains(payload, '"k": 7'), false)) AS found,
  count(CASE WHEN contains(payload, '"k": 7') THEN 1 END)::BIGINT AS matching
FROM evs WHERE error IS NULL GROUP BY 1""",
)
def check_contains_q(spark, sf_dir):
    """V-02: some message of the topic contains the text."""
    return checks.check_contains(_delivered_events(spark, sf_dir), '"k": 7')


@register(
    "check_header",
    f"""WITH {EV}
SELECT dest_topic AS topic, bool_or(coalesce(h_dest = 'purchase', false)) AS found,
  count(CASE WHEN h_dest = 'purchase' THEN 1 END)::BIGINT AS matching
FROM evs WHERE error IS NULL GROUP BY 1""",
)
def check_header_q(spark, sf_dir):
    """V-03: some message of the topic carries header destination_topic=purchase."""
    return checks.check_header(_delivered_events(spark, sf_dir), "destination_topic", "purchase")


@register(
    "check_equal",
    f"""WITH {EV}
SELECT dest_topic AS topic, count(CASE WHEN is_obj THEN CASE WHEN json(payload) = json('{{"k":7}}') THEN 1 END END)::BIGINT AS matching,
  bool_or(CASE WHEN is_obj THEN coalesce(json(payload) = json('{{"k":7}}'), false) ELSE false END) AS found
FROM evs WHERE error IS NULL GROUP BY 1""",
)
def check_equal_q(spark, sf_dir):
    """V-05: JSON-aware content equality (spacing and key order do not matter)."""
    return checks.check_equal(_delivered_events(spark, sf_dir), {"k": 7})


@register(
    "bounded_read",
    f"""WITH {EV},
r AS (SELECT *, row_number() OVER (PARTITION BY dest_topic ORDER BY msg_partition, msg_offset) AS rank
  FROM evs WHERE error IS NULL)
SELECT dest_topic AS topic, CAST(rank AS INTEGER) AS rank, msg_offset, payload AS payload_text FROM r WHERE rank <= 5""",
)
def bounded_read_q(spark, sf_dir):
    """V-06: the first 5 messages of each topic by (partition, offset)."""
    b = checks.bounded_read(_delivered_events(spark, sf_dir), 5)
    return b.select(
        F.col("dest_topic").alias("topic"),
        "rank",
        F.col("offset").alias("msg_offset"),
        F.col("payload").cast("string").alias("payload_text"),
    )


@register(
    "check_order",
    """WITH c AS (SELECT role AS topic, text, conv_id % 4 AS p, conv_id * 1000 + turn AS o, conv_id, turn FROM conversations),
x AS (SELECT topic, string_agg(text, '|' ORDER BY conv_id, turn) AS expected, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY conv_id, turn) AS rk FROM c) WHERE rk <= 3 GROUP BY topic),
a AS (SELECT r.topic, string_agg(r.text, '|' ORDER BY r.p, r.o) AS actual
  FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY p, o) AS rk FROM c) r JOIN x ON r.topic = x.topic
  WHERE r.rk <= x.n GROUP BY r.topic)
SELECT x.topic, md5(x.expected) AS expected_digest, md5(a.actual) AS actual_digest, x.expected = a.actual AS ok
FROM x LEFT JOIN a ON a.topic = x.topic""",
)
def check_order_q(spark, sf_dir):
    """V-04: conversations fanned by role, checked against conversation order
    (conv_id, turn). Keyed partitioning keeps order within a partition only,
    so a role whose first turns span partitions reports ``ok = false``."""
    routed = deliverable(fan(conversations_messages(spark, sf_dir), {"type": "header", "key": "role"}))
    conv = read_table(spark, sf_dir, "conversations")
    w = Window.partitionBy("role").orderBy("conv_id", "turn")
    expected = (
        conv.withColumn("rk", F.row_number().over(w))
        .filter(F.col("rk") <= 3)
        .groupBy(F.col("role").alias("topic"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "text"))), lambda s: s["text"]).alias("expected"))
    )
    res = checks.check_order(routed, expected, n=3)
    return res.select(
        "topic",
        F.md5(F.array_join("expected", "|")).alias("expected_digest"),
        F.md5(F.array_join("actual", "|")).alias("actual_digest"),
        "ok",
    )


# --------------------------------------------------------------------------
# Streaming (run to completion with availableNow, then read back)
# --------------------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    return events_to_messages(stream_table(spark, sf_dir, "events"))


@register(
    "stream_fan_drain",
    f"""WITH {EV}
SELECT dest_topic, count(*)::BIGINT AS message_count, sum(size)::BIGINT AS total_bytes
FROM evs WHERE error IS NULL GROUP BY dest_topic""",
)
def stream_fan_drain(spark, sf_dir):
    """T-01 / T-02 / K-05 / T-04: the flagship fan streamed with availableNow
    into a topic table; same answer as the batch query."""
    from relayspark.streaming.runner import read_topic_table, run_stream

    _, out = run_stream(fan(_event_stream(spark, sf_dir), HEADER))
    t = read_topic_table(spark, out)
    return t.groupBy("dest_topic").agg(
        F.count(F.lit(1)).alias("message_count"), F.sum(message_size()).cast("bigint").alias("total_bytes")
    )


@register(
    "stream_metrics",
    f"""WITH {EV},
src AS (SELECT 'events' AS topic, count(size)::BIGINT AS message_count, coalesce(sum(size), 0)::BIGINT AS total_bytes,
  count(error)::BIGINT AS error_count, max(CASE WHEN size IS NOT NULL THEN ts END) AS last_message_time FROM evs),
dst AS (SELECT dest_topic AS topic, count(*)::BIGINT AS message_count, sum(size)::BIGINT AS total_bytes,
  0::BIGINT AS error_count, max(ts) AS last_message_time FROM evs WHERE error IS NULL GROUP BY dest_topic)
SELECT 'source' AS side, * FROM src UNION ALL SELECT 'destination' AS side, * FROM dst""",
)
def stream_metrics(spark, sf_dir):
    """T-06 / M-13: per-batch metric deltas written exactly once, folded."""
    from relayspark.streaming.runner import read_stream_metrics, run_stream, with_totals

    _, out = run_stream(with_totals(fan(_event_stream(spark, sf_dir), HEADER)))
    m = read_stream_metrics(spark, out)
    return m.select(
        "side", "topic", "message_count", "total_bytes", "error_count", _ts("last_message_time").alias("last_message_time")
    )


@register("stream_windowed_throughput", _bucket_sql("count(size)", "event_type", "messages_per_second"))
def stream_windowed_throughput(spark, sf_dir):
    """M-09 streamed: 5-minute message rate per source topic with a 10-minute
    watermark, update mode, folded to the latest value per window."""
    from relayspark.streaming.runner import read_latest, run_update_stream

    routed = fan(events_to_messages(stream_table(spark, sf_dir, "events"), topic=None), HEADER)
    _, out = run_update_stream(windowed_throughput(routed, watermark="10 minutes"))
    return _window_cols(read_latest(spark, out, ["window_start", "window_end", "topic"]), "messages_per_second")


@register(
    "json_enrich_documents",
    """SELECT lang AS topic, count(*)::BIGINT AS message_count,
  sum(strlen(text) + 4 + strlen(lang) + 6 + strlen(source) + strlen(CAST(doc_id AS VARCHAR)) + 16 + 12)::BIGINT AS total_bytes,
  count(*)::BIGINT AS invalid_json
FROM documents WHERE text IS NOT NULL GROUP BY lang""",
)
def json_enrich_documents(spark, sf_dir):
    """P-04 over whole documents: prose is not JSON, so every message keeps its
    payload and gains header enrichment_error; destination bytes are measured
    after processing (Q-10)."""
    routed = fan(documents_messages(spark, sf_dir), {"type": "header", "key": "lang"})
    out = json_enrich(routed)
    ok = delivered(out)
    agg = out.groupBy(F.col("dest_topic").alias("topic")).agg(
        F.count_if(ok).alias("message_count"),
        F.coalesce(F.sum(F.when(ok, message_size())), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count_if(ok & (F.col("headers")["enrichment_error"] == F.lit("invalid JSON"))).alias("invalid_json"),
    )
    return agg.filter(F.col("message_count") > 0)


@register(
    "config_one_to_one",
    f"""WITH {EV}
SELECT r.dst AS dest_topic, count(*)::BIGINT AS message_count, sum(size)::BIGINT AS total_bytes
FROM evs JOIN (VALUES ('purchase','orders-processed'), ('signup','signups-processed'), ('view','views-processed')) AS r(src, dst)
  ON evs.event_type = r.src
WHERE error IS NULL GROUP BY r.dst""",
)
def config_one_to_one(spark, sf_dir):
    """A relay configuration run as is (mode one_to_one, table source and
    destination) over the events stored as a topic
    table in the shared folder."""
    from relayspark.plans.config import start_from_config
    from relayspark.session import shared_dir
    from relayspark.streaming.runner import read_topic_table

    stored = shared_dir(spark, "events-topic-table")
    events_messages(spark, sf_dir, topic=None).write.mode("overwrite").parquet(stored)
    cfg = {
        "mode": "one_to_one",
        "thread_pool": {"max_workers": 20, "queue_size": 2000},
        "max_per_trigger": 2000,
        "back_pressure": {"enabled": True, "queue_high_watermark": 0.8, "queue_low_watermark": 0.5},
        "one_to_one": {
            "source": {"type": "table", "connection": {"path": stored}},
            "destination": {"type": "table", "connection": {}},
            "mappings": [
                {"source_topic": "purchase", "destination_topic": "orders-processed"},
                {"source_topic": "signup", "destination_topic": "signups-processed"},
                {"source_topic": "view", "destination_topic": "views-processed"},
            ],
        },
    }
    _, out = start_from_config(spark, cfg, drain=True)
    return read_topic_table(spark, out).groupBy("dest_topic").agg(
        F.count(F.lit(1)).alias("message_count"), F.sum(message_size()).cast("bigint").alias("total_bytes")
    )


@register(
    "json_enrich_exact",
    f"""WITH {EV}
SELECT msg_offset,
  CASE WHEN is_obj THEN substr(payload, 1, strlen(payload) - 1) || ', "enriched": true, "processor_version": "1.0"}}'
       ELSE payload END AS payload_text,
  CASE WHEN is_obj THEN NULL
       WHEN payload = '[1]' THEN 'list indices must be integers or slices, not str'
       ELSE 'Extra data: line 1 column 4 (char 3)' END AS enrichment_error
FROM evs WHERE error IS NULL""",
)
def json_enrich_exact(spark, sf_dir):
    """P-04 byte-exact (Arrow-batched Python json): payloads as json.dumps
    writes them and Python's own error texts."""
    routed = fan(events_messages(spark, sf_dir), HEADER)
    out = deliverable(json_enrich(routed, exact=True))
    return out.select(
        F.col("offset").alias("msg_offset"),
        F.col("payload").cast("string").alias("payload_text"),
        F.col("headers")["enrichment_error"].alias("enrichment_error"),
    )


@register("stream_windowed_errors", _bucket_sql("count(error)", "event_type", "errors_per_second"))
def stream_windowed_errors(spark, sf_dir):
    """M-11 streamed: 5-minute source error rate per source topic with a
    10-minute watermark, update mode, folded to the latest value per window."""
    from relayspark.streaming.runner import read_latest, run_update_stream

    routed = fan(events_to_messages(stream_table(spark, sf_dir, "events"), topic=None), HEADER)
    _, out = run_update_stream(windowed_errors(routed, watermark="10 minutes"))
    return _window_cols(read_latest(spark, out, ["window_start", "window_end", "topic"]), "errors_per_second")


@register("stream_windowed_volume", _bucket_sql("sum(size)", "dest_topic", "bytes_per_second", "WHERE error IS NULL"))
def stream_windowed_volume(spark, sf_dir):
    """M-10 streamed: 5-minute delivered byte rate per destination topic with
    a 10-minute watermark, update mode, folded to the latest value per window."""
    from relayspark.streaming.runner import read_latest, run_update_stream

    routed = fan(events_to_messages(stream_table(spark, sf_dir, "events"), topic=None), HEADER)
    _, out = run_update_stream(windowed_volume(routed, watermark="10 minutes"))
    return _window_cols(read_latest(spark, out, ["window_start", "window_end", "topic"]), "bytes_per_second")
