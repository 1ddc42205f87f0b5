"""Blocks of metric deltas: totals after any batch, bounded files, crashes, clocks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from relayspark.operators.routing import fan
from relayspark.sources.tables import EVENTS_SCHEMA, events_to_messages
from relayspark.streaming import files, read_stream_metrics, run_stream, stream_report
from relayspark.streaming.deltas import DELTAS, RUNS, DeltaStore, fold
from relayspark.streaming.runner import stream_uptime
from tests.conftest import SF_SMALL

HEADER = {"type": "header", "key": "destination_topic"}


def rows_of(batch):
    rng = random.Random(batch)
    return [("source", t, rng.randint(0, 9), rng.randint(0, 99), rng.randint(0, 2), None, float(batch)) for t in rng.sample("abcd", 2)]


def totals(batches):
    out = {}
    for b in batches:
        for side, topic, n, size, errors, _, at in rows_of(b):
            x = out.setdefault((side, topic), [0, 0, 0, 0.0])
            out[side, topic] = [x[0] + n, x[1] + size, x[2] + errors, max(x[3], at)]
    return out


def stored(store, after=-1):
    return {(r["side"], r["topic"]): [r["message_count"], r["total_bytes"], r["error_count"], r["last_recorded"]] for r in fold(store.deltas(after)).collect()}


def add(store, spark, batch):
    store.add(batch, spark.createDataFrame(rows_of(batch), DELTAS), spark.createDataFrame([(f"run{batch // 10}", float(batch), batch + 0.5)], RUNS))


def test_blocks_keep_every_total_and_few_files(spark, tmp_path):
    out = str(tmp_path)
    for batch in range(32):
        # A new store at times: a restart.
        store = DeltaStore(spark, out, every=3) if batch % 7 == 0 else store
        add(store, spark, batch)
        assert len(files.names(spark, f"{out}/metrics")) <= 7 and len(files.names(spark, f"{out}/metric_blocks")) <= 12
    assert {b["level"] for b in store.manifest["blocks"]} >= {0, 2}
    read = DeltaStore(spark, out)
    for after in (-1, 0, 1, 8, 9, 13, 26, 27, 30, 31):
        assert stored(read, after) == totals(range(after + 1, 32)), after
    # Run by run, from its first batch to the end of its last.
    assert stream_uptime(spark, out).first()[0] == 3 * 9.5 + 1.5


def test_a_batch_in_a_block_that_runs_again_changes_nothing(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path), every=2)
    for batch in [0, 1, 1, 2, 3, 0, 2, 3, 3]:
        add(store, spark, batch)
    assert stored(DeltaStore(spark, str(tmp_path))) == totals(range(4))


def test_what_no_manifest_names_does_not_count(spark, tmp_path, monkeypatch):
    """A crash between the block and the manifest, then the batch again."""
    store = DeltaStore(spark, str(tmp_path), every=2)
    for batch in range(2):
        add(store, spark, batch)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(files, "write_whole", crash)
        with pytest.raises(OSError, match="lost"):
            add(store, spark, 2)
    assert stored(DeltaStore(spark, str(tmp_path))) == totals(range(3))
    store = DeltaStore(spark, str(tmp_path), every=2)
    for batch in range(2, 6):
        add(store, spark, batch)
    assert stored(DeltaStore(spark, str(tmp_path))) == totals(range(6))
    assert len(files.names(spark, f"{tmp_path}/metric_blocks")) <= 3


def test_no_batch_yet(spark, tmp_path):
    """A report of a stream that has stored nothing: no rows, NULL uptime."""
    assert stream_uptime(spark, f"{tmp_path}/none").first()[0] is None
    assert stream_report(spark, f"{tmp_path}/none").collect() == [] == read_stream_metrics(spark, f"{tmp_path}/none").collect()


def test_last_recorded_by_the_relays_clock(spark, tmp_path):
    now = [100.0]

    def clock():
        now[0] += 1
        return now[0]

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    routed = fan(events_to_messages(stream), HEADER)
    _, out = run_stream(routed, out_dir=f"{tmp_path}/out", compact_every=2, clock=clock)
    report = stream_report(spark, out)
    assert {r["last_recorded"] for r in report.where("message_count > 0").collect()} <= {102.0, 103.0, 104.0, 105.0, 106.0}
    assert report.agg(F.max("last_recorded")).first()[0] == 106.0
    assert report.where("side = 'source'").first()["uptime_seconds"] == 5.0
    assert sum(r["message_count"] + r["error_count"] for r in report.where("side = 'source'").collect()) == events.count()
    assert not os.path.exists(f"{out}/metrics/batch_id=0") and len(DeltaStore(spark, out).manifest["blocks"]) >= 1
    # Only errors: never recorded.
    broken = events_to_messages(stream).withColumn("payload", F.lit(None).cast("binary"))
    _, out = run_stream(fan(broken, HEADER), out_dir=f"{tmp_path}/errors", clock=clock)
    assert {r["last_recorded"] for r in stream_report(spark, out).where("side = 'source'").collect()} == {0.0}
