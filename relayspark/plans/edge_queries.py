"""Registered queries of the edge cases: odd destination names, JSON members of
every type, headers that are empty, bad processor results, repeated routes and
starts, messages without a time.

The messages are the rows of ``events`` with a payload chosen by
``event_id % 12`` (see FORMS) and headers ``destination_topic`` (empty for even
ids) and ``reason``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayspark.operators.metrics import destination_metrics, loss_check, topic_report, windowed_throughput
from relayspark.operators.processors import priority_tag, process
from relayspark.operators.routing import fan, one_to_one
from relayspark.operators.runs import loss_runs as runs_of_loss
from relayspark.plans.catalog import EV, HEADER, PAYLOAD_K, _window_cols, register
from relayspark.session import shared_dir
from relayspark.sinks.egress import deliverable, to_kafka, write_topics
from relayspark.sources.replay import index_positions, read_topic_table_source, replay_from, replay_stored
from relayspark.sources.tables import documents_messages, events_messages, events_to_messages, read_table, stream_table

# Payload, destination by member ``k`` (None: a JSON null; payloads without the
# member and other JSON go to 'default'), and the priority tag of member ``p``
# against 5: filtered, reason ('kept': the header that was there).
FORMS = [
    ('{"k":null,"p":null}', None, "false", "parse_error"),
    ('{"k":true,"p":true}', "true", "true", "priority True < 5"),
    ('{"k":3,"p":3}', "3", "true", "priority 3 < 5"),
    ('{"k":{"z":1},"p":{"z":1}}', '{"z":1}', "false", "parse_error"),
    ('{"k":"007","p":"5"}', "007", "false", "parse_error"),
    ('{"k":"","p":[1]}', "", "false", "parse_error"),
    ('{"k":"1.0","p":2.5}', "1.0", "true", "priority 2.5 < 5"),
    ('{"k":"2024-01-01","p":-99999999999999999999}', "2024-01-01", "true", "priority -99999999999999999999 < 5"),
    ('{"k":"a/b=c %","p":7}', "a/b=c %", "false", "kept"),
    ('{"p":false}', "default", "true", "priority False < 5"),
    ("[1]", "default", "false", "parse_error"),
    (None, None, None, None),
]
ODD_NAMES = ["", "007", "1.0", "2024-01-01", "a/b=c %"]


def _sql_text(s: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if s is None else "'" + s.replace("'", "''") + "'"


FORMS_SQL = (
    "forms(i, payload, k_dest, filtered, reason) AS (VALUES "
    + ", ".join(f"({i}, {', '.join(map(_sql_text, form))})" for i, form in enumerate(FORMS))
    + "), fe AS (SELECT e.event_id, e.event_type, e.user_id, forms.* FROM events e JOIN forms ON e.event_id % 12 = forms.i)"
)


def form_messages(events: DataFrame) -> DataFrame:
    payload = F.element_at(F.array(*[F.lit(p) for p, *_ in FORMS]), (F.pmod("event_id", F.lit(len(FORMS))) + 1).cast("int"))
    dest = F.when(F.pmod("event_id", F.lit(2)) == 0, "").otherwise(F.col("event_type"))
    return events.select(
        F.encode(payload, "UTF-8").alias("payload"),
        F.create_map(F.lit("destination_topic"), dest, F.lit("reason"), F.lit("kept")).alias("headers"),
        F.lit("forms").alias("topic"),
        F.col("user_id").cast("string").alias("key"),
        F.pmod("event_id", F.lit(4)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_messages(read_table(spark, sf_dir, "events"))


@register(
    "fan_payload_forms",
    f"""WITH {FORMS_SQL}
SELECT k_dest AS topic, count(CASE WHEN k_dest IS NOT NULL THEN 1 END)::BIGINT AS message_count,
  count(CASE WHEN k_dest IS NULL THEN 1 END)::BIGINT AS error_count
FROM fe WHERE payload IS NOT NULL GROUP BY 1""",
)
def fan_payload_forms(spark, sf_dir):
    """Q-02, Q-03: members that are null, boolean, number, object or odd text."""
    return destination_metrics(fan(_forms(spark, sf_dir), PAYLOAD_K), elapsed=1.0).select("topic", "message_count", "error_count")


@register(
    "fan_header_empty",
    f"""WITH {FORMS_SQL}
SELECT CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS topic, count(*)::BIGINT AS message_count
FROM fe WHERE payload IS NOT NULL GROUP BY 1""",
)
def fan_header_empty(spark, sf_dir):
    """Q-01: an empty header value is a destination of its own."""
    return destination_metrics(fan(_forms(spark, sf_dir), HEADER), elapsed=1.0).select("topic", "message_count")


@register("priority_forms", f"""WITH {FORMS_SQL}
SELECT event_id AS msg_offset, filtered, reason FROM fe WHERE payload IS NOT NULL""")
def priority_forms(spark, sf_dir):
    """Q-11, Q-12, Q-13: priorities of every JSON type, beyond 64 bits, and a
    reason header that stays."""
    out = deliverable(priority_tag(fan(_forms(spark, sf_dir), HEADER), key="p", min_priority=5))
    return out.select(F.col("offset").alias("msg_offset"), F.col("headers")["filtered"].alias("filtered"), F.col("headers")["reason"].alias("reason"))


_BY_K = f"""WITH {FORMS_SQL}
SELECT k_dest AS topic, count(*)::BIGINT AS message_count, sum(strlen(payload))::BIGINT AS payload_bytes
FROM fe WHERE k_dest IS NOT NULL"""


def _by_topic(df: DataFrame, payload: str) -> DataFrame:
    return df.groupBy("topic").agg(F.count("*").alias("message_count"), F.sum(F.octet_length(payload)).alias("payload_bytes"))


@register("egress_payload_route", f"{_BY_K} GROUP BY 1")
def egress_payload_route(spark, sf_dir):
    """K-01 after a payload route: what a Kafka sink is sent."""
    return _by_topic(to_kafka(fan(_forms(spark, sf_dir), PAYLOAD_K)), "value")


@register("topic_table_payload_route", f"{_BY_K} GROUP BY 1")
def topic_table_payload_route(spark, sf_dir):
    """K-05, T-02: odd destination names through a stored topic table and back."""
    path = shared_dir(spark, "topic-names")
    write_topics(fan(_forms(spark, sf_dir), PAYLOAD_K), path)
    return _by_topic(read_topic_table_source(spark, path), "payload")


@register("topic_table_odd_names", f"{_BY_K} AND k_dest IN ({', '.join(map(_sql_text, ODD_NAMES))}) GROUP BY 1")
def topic_table_odd_names(spark, sf_dir):
    """S-07 on a stored topic table: subscription by each odd name, exact."""
    path = shared_dir(spark, "topic-names")
    write_topics(fan(_forms(spark, sf_dir), PAYLOAD_K), path)
    return _by_topic(read_topic_table_source(spark, path, ODD_NAMES), "payload")


@register("stream_topic_names", f"{_BY_K} GROUP BY 1")
def stream_topic_names(spark, sf_dir):
    """The same names through a stream's topic table."""
    from relayspark.streaming.runner import read_topic_table, run_stream

    _, out = run_stream(fan(form_messages(stream_table(spark, sf_dir, "events")), PAYLOAD_K))
    return _by_topic(read_topic_table(spark, out).drop("topic").withColumnRenamed("dest_topic", "topic"), "payload")


@register(
    "stream_report",
    f"""WITH {EV},
src AS (SELECT 'events' AS topic, count(size)::BIGINT AS message_count, count(error)::BIGINT AS error_count FROM evs),
dst AS (SELECT dest_topic AS topic, count(*)::BIGINT AS message_count, 0::BIGINT AS error_count FROM evs WHERE error IS NULL GROUP BY dest_topic)
SELECT *, CAST(10 AS DOUBLE) AS uptime_seconds, message_count / CAST(10 AS DOUBLE) AS rate_per_second
FROM (SELECT 'source' AS side, * FROM src UNION ALL SELECT 'destination' AS side, * FROM dst)""",
)
def stream_report_q(spark, sf_dir):
    """M-13: the report of a stream, for an uptime of 10 seconds."""
    from relayspark.sources.tables import events_to_messages
    from relayspark.streaming.runner import run_stream, stream_report

    _, out = run_stream(fan(events_to_messages(stream_table(spark, sf_dir, "events")), HEADER))
    return stream_report(spark, out, uptime_seconds=10.0).select("side", "topic", "message_count", "error_count", "uptime_seconds", "rate_per_second")


@register(
    "windowed_documents",
    """SELECT CAST(NULL AS TIMESTAMP) AS window_start, CAST(NULL AS TIMESTAMP) AS window_end, 'documents' AS topic,
  count(text) / CAST(300 AS DOUBLE) AS messages_per_second FROM documents""",
)
def windowed_documents(spark, sf_dir):
    """M-09: messages without a time are in a window of their own."""
    routed = fan(documents_messages(spark, sf_dir), {"type": "header", "key": "lang"})
    return _window_cols(windowed_throughput(routed), "messages_per_second")


@register(
    "processor_bad_output",
    f"""WITH {EV}
SELECT dest_topic AS topic, count(CASE WHEN msg_offset % 5 = 4 THEN 1 END)::BIGINT AS message_count,
  count(CASE WHEN msg_offset % 5 <> 4 THEN 1 END)::BIGINT AS error_count
FROM evs WHERE error IS NULL GROUP BY 1""",
)
def processor_bad_output(spark, sf_dir):
    """P-07, M-02, M-03: results that can't be sent are errors of their destination."""
    out = process(fan(events_messages(spark, sf_dir), HEADER), "relayspark.plans.examples.BadOutputProcessor")
    return destination_metrics(out, elapsed=1.0).select("topic", "message_count", "error_count")


REPEATED = [("signup", "old"), ("purchase", "orders"), ("signup", "signups"), ("click", "orders")]


@register(
    "loss_check_repeated",
    f"""WITH {EV}
SELECT dst AS dest_topic, count(size)::BIGINT AS source_count, count(size)::BIGINT AS dest_count, 0::BIGINT AS lost
FROM evs JOIN (VALUES ('signup','signups'), ('purchase','orders'), ('click','orders')) AS r(src, dst) ON evs.event_type = r.src
GROUP BY dst""",
)
def loss_check_repeated(spark, sf_dir):
    """M-12 with a repeated route: the last one counts on both sides."""
    table = spark.createDataFrame([(s, d, i) for i, (s, d) in enumerate(REPEATED)], "source_topic string, destination_topic string, pos int")
    routed = one_to_one(events_messages(spark, sf_dir, topic=None), table)
    return loss_check(topic_report(routed, elapsed=1.0), table)


@register(
    "replay_repeated_starts",
    """WITH e AS (SELECT event_type AS topic, CAST(event_id % 4 AS INTEGER) AS msg_partition, event_id AS msg_offset FROM events),
s AS (SELECT topic, msg_partition, max(msg_offset) - 100 AS start_offset FROM e GROUP BY 1, 2)
SELECT topic, msg_partition, count(*)::BIGINT AS messages FROM e JOIN s USING (topic, msg_partition)
WHERE msg_offset >= start_offset GROUP BY 1, 2""",
)
def replay_repeated_starts(spark, sf_dir):
    """S-08: of repeated starts the greatest counts, and no message is repeated."""
    m = events_messages(spark, sf_dir, topic=None)
    last = m.groupBy("topic", "partition").agg(F.max("offset").alias("last"))
    starts = last.select("topic", "partition", F.explode(F.array(F.col("last") - 100, F.col("last") - 300, F.col("last") - 100)).alias("start_offset"))
    kept = replay_from(m, starts)
    return kept.groupBy("topic", F.col("partition").alias("msg_partition")).agg(F.count("*").alias("messages"))


# Names of 300 characters and more, by event type.
_LONG = "repeat(event_type || '/', CAST(60 + 300 * (event_id % 2) AS INTEGER))"


@register(
    "topic_table_long_names",
    f"""WITH l AS (SELECT {_LONG} AS topic FROM events)
SELECT how, topic, count(*)::BIGINT AS message_count FROM l, (VALUES ('batch'), ('stream'), ('subscribed')) AS h(how) GROUP BY ALL""",
)
def topic_table_long_names(spark, sf_dir):
    """K-05, S-07: destination names that no folder can hold, through a topic table,
    a stream's topic table and a subscription."""
    from relayspark.streaming.runner import read_topic_table, run_stream

    def named(events: DataFrame) -> DataFrame:
        messages = events_to_messages(events, topic=None, faults=False)
        name = F.expr(_LONG.replace("event_type", "topic").replace("event_id", "offset"))
        return messages.withColumn("payload", F.encode(F.concat(F.lit('{"k": "'), name, F.lit('"}')), "UTF-8"))

    path = shared_dir(spark, "topic-names")
    write_topics(fan(named(read_table(spark, sf_dir, "events")), PAYLOAD_K), path)
    _, out = run_stream(fan(named(stream_table(spark, sf_dir, "events")), PAYLOAD_K))
    count = lambda df, how: df.groupBy("topic").agg(F.count("*").alias("message_count")).select(F.lit(how).alias("how"), "topic", "message_count")
    whole = read_topic_table_source(spark, path)
    names = [r["topic"] for r in whole.select("topic").distinct().collect()]
    parts = count(whole, "batch").union(count(read_topic_table(spark, out).drop("topic").withColumnRenamed("dest_topic", "topic"), "stream"))
    return parts.union(count(read_topic_table_source(spark, path, names), "subscribed"))


_PLACED = "SELECT event_type AS topic, CAST(event_id % 4 AS INTEGER) AS partition, event_id AS o FROM events"


@register(
    "loss_runs",
    f"""WITH m AS ({_PLACED})
SELECT topic, partition, count(*)::BIGINT AS sent, (count(*) FILTER (o % 97 <> 5))::BIGINT AS received, (count(*) FILTER (o % 97 = 5))::BIGINT AS lost,
       (count(*) FILTER (o % 89 = 3 AND o % 97 <> 5))::BIGINT AS duplicated, 0::BIGINT AS unexpected
FROM m GROUP BY 1, 2""",
)
def loss_runs(spark, sf_dir):
    """M-12 by offsets: lost and duplicated messages don't cancel out."""
    sent = events_messages(spark, sf_dir, topic=None)
    kept = sent.where("offset % 97 <> 5")
    return runs_of_loss(sent, kept.unionByName(kept.where("offset % 89 = 3")))


@register(
    "replay_pruned",
    f"""WITH m AS ({_PLACED}), half AS (SELECT (max(event_id) // 2)::BIGINT AS h FROM events)
SELECT topic, partition, count(*)::BIGINT AS message_count, min(o)::BIGINT AS first_offset FROM m, half WHERE partition <> 1 OR o >= h GROUP BY 1, 2""",
)
def replay_pruned(spark, sf_dir):
    """S-08 on a stored topic table through its position index."""
    path = shared_dir(spark, "topic-positions")
    events = events_messages(spark, sf_dir, topic=None, faults=False)
    write_topics(fan(events, HEADER), path)
    index_positions(spark, path)
    half = events.agg(F.max("offset")).first()[0] // 2
    starts = {(r["topic"], 1): half for r in events.select("topic").distinct().collect()}
    out = replay_stored(spark, path, starts)
    return out.groupBy("topic", "partition").agg(F.count("*").alias("message_count"), F.min("offset").alias("first_offset"))


@register(
    "stream_compacted",
    f"""WITH {EV},
src AS (SELECT 'events' AS topic, count(size)::BIGINT AS message_count, sum(size)::BIGINT AS total_bytes, count(error)::BIGINT AS error_count FROM evs),
dst AS (SELECT dest_topic AS topic, count(*)::BIGINT AS message_count, sum(size)::BIGINT AS total_bytes, 0::BIGINT AS error_count FROM evs WHERE error IS NULL GROUP BY dest_topic)
SELECT 'source' AS side, * FROM src UNION ALL SELECT 'destination' AS side, * FROM dst""",
)
def stream_compacted(spark, sf_dir):
    """M-07, T-06: totals of a stream of 16 batches whose deltas became blocks."""
    from relayspark.sources.tables import EVENTS_SCHEMA
    from relayspark.streaming.runner import read_stream_metrics, run_stream

    parts = shared_dir(spark, "event-parts")
    read_table(spark, sf_dir, "events").repartition(16).write.mode("overwrite").parquet(parts)
    events = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(parts)
    _, out = run_stream(fan(events_to_messages(events), HEADER), compact_every=3)
    return read_stream_metrics(spark, out).select("side", "topic", "message_count", "total_bytes", "error_count")


@register("stream_report_idle", "SELECT count(*)::BIGINT AS topics, 0::BIGINT AS messages, 0::DOUBLE AS last_recorded FROM events WHERE event_type = 'no such topic'")
def stream_report_idle(spark, sf_dir):
    """M-13: the report of a stream that no message came to."""
    from relayspark.operators.routing import subscribe
    from relayspark.streaming.runner import run_stream, stream_report

    messages = subscribe(events_to_messages(stream_table(spark, sf_dir, "events"), topic=None), ["no such topic"])
    _, out = run_stream(fan(messages, HEADER))
    totals = (F.coalesce(F.sum(c), F.lit(0)) for c in ("message_count", "last_recorded"))
    return stream_report(spark, out).agg(F.count("*").alias("topics"), *(t.alias(n) for t, n in zip(totals, ("messages", "last_recorded"))))
