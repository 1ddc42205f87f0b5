"""M-01 .. M-12: sums per topic, topics apart, error-only topics, rates, windows, loss."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relayspark.operators.metrics import (
    batch_deltas,
    counter_rows,
    destination_metrics,
    loss_check,
    metrics_report,
    metrics_since_batch,
    source_metrics,
    topic_report,
    windowed_errors,
    windowed_throughput,
    windowed_volume,
)
from relayspark.operators.routing import fan, one_to_one
from tests.conftest import T0, msg

HEADER = {"type": "header", "key": "d"}


def sized(n, topic, dest=None, ts=None):
    headers = {"d": dest} if dest else {}
    hb = (1 + len(dest)) if dest else 0
    return msg(b"x" * (n - hb), headers, topic=topic, timestamp=ts)


def by_topic(df):
    return {r["topic"]: r.asDict() for r in df.collect()}


def test_source_sums_per_topic(spark, make):
    df = fan(make([sized(256, "topic-a"), sized(128, "topic-a")]), HEADER)
    m = by_topic(source_metrics(df, elapsed=2.0))["topic-a"]
    assert (m["message_count"], m["total_bytes"], m["error_count"]) == (2, 384, 0)
    assert m["rate_per_second"] == 1.0


def test_destination_size(spark, make):
    df = fan(make([sized(512, "src", "dest-topic")]), HEADER)
    m = by_topic(destination_metrics(df, elapsed=1.0))["dest-topic"]
    assert (m["message_count"], m["total_bytes"]) == (1, 512)


def test_topic_seen_only_in_errors(spark, make):
    """M-03: errors only -> message_count 0."""
    df = fan(make([msg(None, topic="topic-err"), msg(None, topic="topic-err")]), HEADER)
    m = by_topic(source_metrics(df, elapsed=1.0))["topic-err"]
    assert (m["message_count"], m["error_count"], m["total_bytes"]) == (0, 2, 0)


def test_topics_kept_apart(spark, make):
    df = fan(make([sized(100, "topic-x"), sized(200, "topic-y")]), HEADER)
    m = by_topic(source_metrics(df, elapsed=1.0))
    assert m["topic-x"]["total_bytes"] == 100 and m["topic-y"]["total_bytes"] == 200


def test_rate_zero_when_no_elapsed(spark, make):
    df = fan(make([sized(10, "a", ts=T0)]), HEADER)
    assert source_metrics(df).first()["rate_per_second"] == 0.0


def test_rate_from_event_time_span(spark, make):
    rows = [sized(10, "a", ts=T0), sized(10, "a", ts=T0 + timedelta(seconds=4))]
    df = fan(make(rows), HEADER)
    assert source_metrics(df).first()["rate_per_second"] == 0.5


def test_null_destination_is_destination_error(spark, make):
    """Q-02."""
    df = fan(make([msg('{"k": null}'), msg('{"k": "x"}')]), {"type": "payload_key", "key": "k"})
    m = {r["topic"]: (r["message_count"], r["error_count"]) for r in destination_metrics(df, elapsed=1.0).collect()}
    assert m == {None: (0, 1), "x": (1, 0)}


def test_report_and_counters(spark, make):
    df = fan(make([sized(256, "topic-a", "d1"), msg(None, topic="topic-a")]), HEADER)
    rep = metrics_report(source_metrics(df, elapsed=1.0), destination_metrics(df, elapsed=1.0))
    d = {(r["side"], r["topic"]): r for r in rep.collect()}
    assert d["source", "topic-a"]["message_count"] == 1
    assert d["source", "topic-a"]["error_count"] == 1
    assert d["destination", "d1"]["total_bytes"] == 256
    rows = {(r["metric"], r["topic"]): r["value"] for r in counter_rows(rep).collect()}
    assert rows == {
        ("relay.source.messages", "topic-a"): 1,
        ("relay.source.bytes", "topic-a"): 256,
        ("relay.source.errors", "topic-a"): 1,
        ("relay.destination.messages", "d1"): 1,
        ("relay.destination.bytes", "d1"): 256,
    }


def test_metrics_epoch(spark, make):
    rows = [sized(10, "a", "d", ts=T0 + timedelta(days=i)) for i in range(4)]
    df = fan(make(rows), HEADER).withColumn("batch_id", F.dayofmonth("timestamp").cast("bigint"))
    got = {(r["side"], r["topic"]): r["message_count"] for r in metrics_since_batch(batch_deltas(df), 2).collect()}
    assert got == {("source", "a"): 2, ("destination", "d"): 2}


def test_windows(spark, make):
    rows = [sized(10, "a", "d", ts=T0 + timedelta(minutes=m)) for m in (0, 1, 6)] + [msg(None, topic="a", timestamp=T0)]
    df = fan(make(rows), HEADER)
    tp = sorted((r["window_start"], r["messages_per_second"]) for r in windowed_throughput(df).collect())
    assert tp == [(T0, 2 / 300), (T0 + timedelta(minutes=5), 1 / 300)]
    vol = sorted(r["bytes_per_second"] for r in windowed_volume(df).collect())
    assert vol == [10 / 300, 20 / 300]
    err = sorted(r["errors_per_second"] for r in windowed_errors(df).collect())
    assert err == [0.0, 1 / 300]


def test_loss_check(spark, make):
    rows = [msg("a", topic="s1"), msg("b", topic="s1"), msg("c", topic="s2")]
    routes = {"s1": "d1", "s2": "d2"}
    r = one_to_one(make(rows), routes)
    from relayspark.operators.metrics import topic_report
    from relayspark.operators.processors import row_processor

    def drop_b(m):
        if m.payload == b"b":
            raise ValueError("b")
        return m

    out = row_processor(drop_b)(r)
    got = {x["dest_topic"]: (x["source_count"], x["dest_count"], x["lost"]) for x in loss_check(topic_report(out, elapsed=1.0), routes).collect()}
    assert got == {"d1": (2, 1, 1), "d2": (1, 1, 0)}
    table = spark.createDataFrame(list(routes.items()), "source_topic string, destination_topic string")
    got2 = {x["dest_topic"]: (x["source_count"], x["dest_count"], x["lost"]) for x in loss_check(topic_report(out, elapsed=1.0), table).collect()}
    assert got2 == got


def test_source_and_destination_sizes_differ_after_processing(spark, make):
    """Q-10: source bytes before processing, destination bytes after."""
    from relayspark.operators.processors import header_stamp
    from relayspark.operators.metrics import topic_report

    df = header_stamp(fan(make([sized(100, "s", "d")]), HEADER), "x", "yz")
    rep = {(r["side"], r["topic"]): r["total_bytes"] for r in topic_report(df, elapsed=1.0).collect()}
    assert rep == {("source", "s"): 100, ("destination", "d"): 103}


def test_eventhubs_metrics_keep_resolved_topic(spark, make):
    """Q-18: the Event Hubs projection drops the topic; metrics still use it."""
    from relayspark.sinks import to_eventhubs

    df = fan(make([sized(10, "s", "resolved")]), HEADER)
    assert "topic" not in to_eventhubs(df).columns
    assert destination_metrics(df, elapsed=1.0).first()["topic"] == "resolved"


def test_topic_report_equals_separate_sides(spark, make):
    rows = [sized(50, "a", "x"), sized(70, "b", "y"), msg(None, topic="a"), msg('{"k": null}', topic="b")]
    df = fan(make(rows), HEADER)
    from relayspark.operators.metrics import topic_report

    one = sorted(tuple(r) for r in topic_report(df, elapsed=2.0).collect())
    two = sorted(tuple(r) for r in metrics_report(source_metrics(df, elapsed=2.0), destination_metrics(df, elapsed=2.0)).collect())
    assert one == two


def test_metrics_aggregate_partially_before_the_shuffle(spark, make):
    from relayspark.operators.metrics import topic_report
    from relayspark.session import plan_text

    df = fan(make([sized(10, "a", "d")]), HEADER)
    for m in (source_metrics(df, elapsed=1.0), destination_metrics(df, elapsed=1.0), topic_report(df, elapsed=1.0)):
        plan = plan_text(m)
        assert "partial_count" in plan
        assert plan.index("partial_count") > 0


def test_sliding_windows(spark, make):
    """M-09 with a slide: a message counts in every window that covers it."""
    rows = [sized(10, "a", "d", ts=T0 + timedelta(minutes=7))]
    df = fan(make(rows), HEADER)
    got = sorted(r["window_start"] for r in windowed_throughput(df, window="10 minutes", slide="5 minutes").collect())
    assert got == [T0, T0 + timedelta(minutes=5)]


def test_counter_rows_keep_zeros(spark, make):
    from relayspark.operators.metrics import topic_report

    df = fan(make([sized(10, "a", "d")]), HEADER)
    rows = counter_rows(topic_report(df, elapsed=1.0), prefix="svc", drop_zero=False).collect()
    assert len(rows) == 6
    assert {r["metric"] for r in rows} == {f"svc.{s}.{m}" for s in ("source", "destination") for m in ("messages", "bytes", "errors")}


def test_metrics_without_event_time(spark):
    """Messages without timestamps (documents): rate 0.0, no last time."""
    from relayspark.operators.metrics import topic_report
    from relayspark.sources.tables import documents_messages
    from tests.conftest import SF_SMALL

    rep = topic_report(fan(documents_messages(spark, SF_SMALL), {"type": "header", "key": "lang"})).collect()
    assert rep and all(r["rate_per_second"] == 0.0 and r["last_message_time"] is None for r in rep)


@pytest.mark.parametrize("report", [topic_report, source_metrics, destination_metrics])
def test_reports_read_their_input_once(spark, report):
    """The rate's span comes from the same aggregate as the rows."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(0, 6000, 1, 3).selectExpr(
        "cast(id as string) AS k", "encode(cast(id as string), 'UTF-8') AS payload", "map('h', cast(id % 3 as string)) AS headers", "concat('t', id % 5) AS topic",
        "cast(null as string) AS key", "0 AS partition", "id AS offset", "timestamp_seconds(1700000000 + id) AS timestamp",
    ).drop("k")
    seen = rows.mapInArrow(count, rows.schema)
    out = report(fan(seen, {"type": "header", "key": "h"})).collect()
    assert read.value == 6000
    assert abs(sum(r["rate_per_second"] for r in out) - (2 if report is topic_report else 1) * 6000 / 5999) < 1e-9
