"""T-01 .. T-06, M-13: batch/stream parity and restart without duplicates."""

import os

from pyspark.sql import functions as F

from relayspark.operators.metrics import destination_metrics, source_metrics
from relayspark.operators.routing import fan
from relayspark.sources.tables import EVENTS_SCHEMA, events_messages, events_to_messages
from relayspark.streaming import TOTALS_NAME, read_stream_metrics, read_topic_table, run_stream, with_totals
from tests.conftest import SF_SMALL

HEADER = {"type": "header", "key": "destination_topic"}


def event_stream(spark, src_dir, per_trigger=1):
    raw = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(src_dir)
    return events_to_messages(raw)


def split_events(spark, tmp_path, parts=4):
    """The small events table as several files so that a stream sees several batches."""
    d = str(tmp_path / "events_src")
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(parts, "event_id").write.parquet(d)
    return d


def test_stream_matches_batch(spark, tmp_path):
    src = split_events(spark, tmp_path)
    q, out = run_stream(with_totals(fan(event_stream(spark, src), HEADER)), out_dir=str(tmp_path / "out"))
    assert q.lastProgress is not None
    streamed = read_topic_table(spark, out).groupBy("dest_topic").count()
    batch = fan(events_messages(spark, SF_SMALL), HEADER).filter("error IS NULL").groupBy("dest_topic").count()
    assert sorted(streamed.collect()) == sorted(batch.collect())
    sm = {(r["side"], r["topic"]): (r["message_count"], r["total_bytes"], r["error_count"]) for r in read_stream_metrics(spark, out).collect()}
    b = fan(events_messages(spark, SF_SMALL), HEADER)
    for r in source_metrics(b, elapsed=1.0).collect():
        assert sm[("source", r["topic"])] == (r["message_count"], r["total_bytes"], r["error_count"])
    for r in destination_metrics(b, elapsed=1.0).collect():
        assert sm[("destination", r["topic"])] == (r["message_count"], r["total_bytes"], r["error_count"])


def test_restart_no_duplicates(spark, tmp_path):
    """Stop after some batches, restart from the checkpoint, expect every row once."""
    src = split_events(spark, tmp_path, parts=4)
    out = str(tmp_path / "out")
    # First run: one batch only, by limiting the input to the first file.
    files = sorted(f for f in os.listdir(src) if f.endswith(".parquet"))
    first_dir = str(tmp_path / "first")
    os.makedirs(first_dir)
    os.link(os.path.join(src, files[0]), os.path.join(first_dir, files[0]))
    ckpt = str(tmp_path / "ckpt")
    run_stream(fan(event_stream(spark, first_dir), HEADER), out_dir=out, checkpoint=ckpt)
    n_first = read_topic_table(spark, out).count()
    for f in files[1:]:
        os.link(os.path.join(src, f), os.path.join(first_dir, f))
    run_stream(fan(event_stream(spark, first_dir), HEADER), out_dir=out, checkpoint=ckpt)
    total = read_topic_table(spark, out)
    expected = fan(events_messages(spark, SF_SMALL), HEADER).filter("error IS NULL").count()
    assert 0 < n_first < expected
    assert total.count() == expected
    assert total.select("offset").distinct().count() == expected
    # Metric deltas are exactly-once too: folded, they equal the batch metrics.
    from relayspark.operators.metrics import topic_report

    folded = {(r["side"], r["topic"]): (r["message_count"], r["total_bytes"], r["error_count"]) for r in read_stream_metrics(spark, out).collect()}
    batch = {
        (r["side"], r["topic"]): (r["message_count"], r["total_bytes"], r["error_count"])
        for r in topic_report(fan(events_messages(spark, SF_SMALL), HEADER), elapsed=1.0).collect()
    }
    assert folded == batch


def test_replayed_batch_overwrites(spark, tmp_path):
    """T-06: writing the same batch id twice leaves one copy."""
    from relayspark.streaming.runner import _write_batch

    out = str(tmp_path / "out")
    b = fan(events_messages(spark, SF_SMALL), HEADER)
    w = _write_batch(out)
    w(b, 0)
    w(b, 0)
    w(b, 1)
    n = b.filter("error IS NULL").count()
    assert read_topic_table(spark, out).count() == 2 * n
    m = read_stream_metrics(spark, out)
    assert m.filter("side = 'source'").first()["message_count"] == 2 * b.filter("source_size IS NOT NULL").count()


def test_rate_limit_one_file_per_batch_and_totals(spark, tmp_path):
    """T-05: maxFilesPerTrigger bounds each micro-batch; M-13: observed totals."""
    src = split_events(spark, tmp_path, parts=3)
    n_files = len([f for f in os.listdir(src) if f.endswith(".parquet")])
    q, out = run_stream(with_totals(fan(event_stream(spark, src, per_trigger=1), HEADER)), out_dir=str(tmp_path / "out"))
    batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(batches) == n_files
    observed = [p["observedMetrics"][TOTALS_NAME] for p in batches]
    assert sum(o["rows"] for o in observed) == spark.read.parquet(src).count()
    assert sum(o["source_errors"] for o in observed) == fan(events_messages(spark, SF_SMALL), HEADER).filter("error IS NOT NULL").count()


def test_windowed_stream_matches_batch(spark, tmp_path):
    """M-09 streamed over several batches: with a watermark wider than the
    disorder between files, the folded updates equal the batch windows."""
    from relayspark.operators.metrics import windowed_throughput
    from relayspark.streaming import read_latest, run_update_stream

    d = str(tmp_path / "ordered")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.repartitionByRange(3, "ts").write.parquet(d)
    _, out = run_update_stream(windowed_throughput(fan(event_stream(spark, d), HEADER), watermark="60 days"), out_dir=str(tmp_path / "w"))
    got = read_latest(spark, out, ["window_start", "window_end", "topic"])
    want = windowed_throughput(fan(events_messages(spark, SF_SMALL), HEADER))
    cols = ["window_start", "topic", "messages_per_second"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_windowed_stream_drops_late_data(spark, tmp_path):
    """Rows older than the watermark at the time they arrive are not counted."""
    import shutil

    from relayspark.operators.metrics import windowed_throughput
    from relayspark.streaming import read_latest, run_update_stream

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    d = str(tmp_path / "src")
    late = str(tmp_path / "late")
    ev.filter("day(ts) >= 20").write.parquet(d)
    ev.filter("day(ts) < 10").write.parquet(late)
    ckpt, out = str(tmp_path / "ck"), str(tmp_path / "w")
    stream = lambda: windowed_throughput(fan(event_stream(spark, d), HEADER), watermark="1 hour")
    run_update_stream(stream(), out_dir=out, checkpoint=ckpt)
    for f in os.listdir(late):
        if f.endswith(".parquet"):
            shutil.copy(os.path.join(late, f), os.path.join(d, "late-" + f))
    run_update_stream(stream(), out_dir=out, checkpoint=ckpt)
    got = read_latest(spark, out, ["window_start", "window_end", "topic"])
    assert got.filter("day(window_start) < 10").count() == 0
    assert got.filter("day(window_start) >= 20").count() > 0


def test_one_to_one_stream_matches_batch(spark, tmp_path):
    from relayspark.operators.routing import one_to_one

    src = split_events(spark, tmp_path)
    routes = {"purchase": "orders", "click": "clicks"}
    raw = spark.readStream.schema(EVENTS_SCHEMA).parquet(src)
    _, out = run_stream(one_to_one(events_to_messages(raw, topic=None), routes), out_dir=str(tmp_path / "o"))
    got = read_topic_table(spark, out).groupBy("dest_topic").count()
    want = one_to_one(events_messages(spark, SF_SMALL, topic=None), routes).filter("error IS NULL").groupBy("dest_topic").count()
    assert sorted(got.collect()) == sorted(want.collect())


def test_continuous_synthetic_stream(spark, tmp_path):
    """T-01 / S-05: a stream that runs until stopped; every processed message
    follows the round-robin rule and lands exactly once."""
    from relayspark.sources import synthetic_stream

    routed = fan(synthetic_stream(spark, ["a", "b", "c"], rows_per_batch=50), {"type": "header", "key": "source"})
    q, out = run_stream(routed, out_dir=str(tmp_path / "syn"), drain=False, processing_time="0 seconds")
    try:
        while sum(p["numInputRows"] for p in q.recentProgress) < 150:
            q.awaitTermination(0.5)
    finally:
        q.stop()
    t = read_topic_table(spark, out)
    n = t.count()
    assert n >= 150 and t.select("key").distinct().count() == n
    bad = t.filter(
        F.col("topic") != F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.pmod(F.col("headers")["count"].cast("long") - 1, F.lit(3)) + 1).cast("int"))
    )
    assert bad.count() == 0
    assert {r[0] for r in t.select("dest_topic").distinct().collect()} == {"mock"}


def test_topic_files_in_partition_offset_order(spark, tmp_path):
    """T-04: within every written file, rows are in (partition, offset) order."""
    import pyarrow.parquet as pq

    src = split_events(spark, tmp_path, parts=2)
    _, out = run_stream(fan(event_stream(spark, src, per_trigger=2), HEADER), out_dir=str(tmp_path / "ord"))
    checked = 0
    for root, _, files in os.walk(os.path.join(out, "topics")):
        for f in files:
            if f.endswith(".parquet"):
                t = pq.read_table(os.path.join(root, f), columns=["partition", "offset"]).to_pylist()
                keys = [(r["partition"], r["offset"]) for r in t]
                assert keys == sorted(keys)
                checked += 1
    assert checked > 0


def test_stream_report_over_two_runs(spark, tmp_path):
    """M-13: uptime is that of all runs, however many batches; rates follow it."""
    from relayspark.streaming import stream_report
    from relayspark.streaming.runner import stream_uptime

    src = split_events(spark, tmp_path, parts=2)
    out = str(tmp_path / "rep")
    run_stream(fan(event_stream(spark, src), HEADER), out_dir=out)
    first = stream_uptime(spark, out).first()[0]
    run_stream(fan(event_stream(spark, src), HEADER), out_dir=out)  # idle: nothing new
    assert stream_uptime(spark, out).first()[0] == first > 0
    rep = {(r["side"], r["topic"]): r for r in stream_report(spark, out).collect()}
    total = spark.read.parquet(src).count()
    side = rep["source", "events"]
    assert side["message_count"] + side["error_count"] == total
    assert side["uptime_seconds"] == first and side["rate_per_second"] == side["message_count"] / first
    assert sum(r["message_count"] for (s, _), r in rep.items() if s == "destination") == side["message_count"]
    assert stream_report(spark, out, uptime_seconds=0.0).first()["rate_per_second"] is None


def test_broker_stream_needs_connector(spark, tmp_path):
    import pytest

    from relayspark.sinks import to_kafka
    from relayspark.streaming import run_broker_stream

    src = split_events(spark, tmp_path, parts=1)
    with pytest.raises(Exception) as exc:
        run_broker_stream(to_kafka(fan(event_stream(spark, src), HEADER)), "kafka", {"kafka.bootstrap.servers": "localhost:9"}, checkpoint=str(tmp_path / "k"))
    assert "kafka" in str(exc.value).lower()


def test_funnel_of_two_streams_matches_batch(spark, tmp_path):
    """F-01 streamed: a union of two file streams into one topic."""
    from relayspark.operators.routing import funnel

    src = split_events(spark, tmp_path)
    raw = spark.readStream.schema(EVENTS_SCHEMA).parquet(src)
    a = events_to_messages(raw.filter("event_type IN ('click', 'view')"), topic="ui")
    b = events_to_messages(raw.filter("event_type NOT IN ('click', 'view')"), topic="backend")
    _, out = run_stream(funnel([a, b], "all-events"), out_dir=str(tmp_path / "f"))
    got = read_topic_table(spark, out)
    batch = funnel([events_messages(spark, SF_SMALL)], "all-events").filter("error IS NULL")
    assert got.count() == batch.count()
    assert {r[0] for r in got.select("dest_topic").distinct().collect()} == {"all-events"}
    assert {r[0] for r in got.select("topic").distinct().collect()} == {"ui", "backend"}


def test_replayed_kafka_rows_stream_matches_batch(spark, tmp_path):
    """S-01 on a stream of replayed raw Kafka rows, routed by payload member."""
    from relayspark.schema import KAFKA_RAW
    from relayspark.sources import from_kafka
    from relayspark.sources.tables import kafka_raw_from_events

    raw_dir = str(tmp_path / "kafka_raw")
    kafka_raw_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet")).repartition(3).write.parquet(raw_dir)
    resolver = {"type": "payload_key", "key": "k"}
    stream = from_kafka(spark.readStream.schema(KAFKA_RAW).option("maxFilesPerTrigger", 1).parquet(raw_dir))
    _, out = run_stream(fan(stream, resolver), out_dir=str(tmp_path / "k"))
    got = sorted(read_topic_table(spark, out).groupBy("dest_topic").count().collect())
    batch = fan(from_kafka(spark.read.parquet(raw_dir)), resolver).filter("error IS NULL AND dest_topic IS NOT NULL")
    assert got == sorted(batch.groupBy("dest_topic").count().collect())
    m = {(r["side"], r["topic"]): r["error_count"] for r in read_stream_metrics(spark, out).collect()}
    errors = from_kafka(spark.read.parquet(raw_dir)).groupBy("topic").agg(F.count("error").alias("e")).collect()
    for r in errors:
        assert m[("source", r["topic"])] >= r["e"]


def test_chained_relay_from_stored_topic_table(spark, tmp_path):
    """A second relay streams from the first one's topic table, subscribed to
    one stored topic (partition-pruned), and re-routes it one-to-one."""
    from relayspark.operators.routing import one_to_one
    from relayspark.sinks import write_topics
    from relayspark.sources import read_topic_table_source

    stored = str(tmp_path / "stage1")
    write_topics(fan(events_messages(spark, SF_SMALL), HEADER), stored)
    src = read_topic_table_source(spark, stored, ["purchase"], streaming=True, max_files_per_trigger=2)
    _, out = run_stream(one_to_one(src, {"purchase": "orders"}), out_dir=str(tmp_path / "stage2"))
    got = read_topic_table(spark, out)
    want = fan(events_messages(spark, SF_SMALL), HEADER).filter("error IS NULL AND dest_topic = 'purchase'").count()
    assert got.count() == want
    assert {r[0] for r in got.select("dest_topic").distinct().collect()} == {"orders"}
