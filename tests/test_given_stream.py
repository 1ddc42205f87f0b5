"""S-06 as a stream: every message once, over restarts and longer lists."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException

from relayspark.operators.routing import fan
from relayspark.sources import given_messages, given_stream, synthetic
from relayspark.streaming import read_stream_metrics, read_topic_table, run_stream

HEADER = {"type": "header", "key": "to"}


def given(first, last):
    time = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)
    return [
        (f"p{i} é".encode() if i % 5 else None, {"to": f"d{i % 3}"} if i % 4 else {}, f"t{i % 2}", f"k{i}" if i % 3 else None, i % 2, i, time + datetime.timedelta(seconds=i) if i % 7 else None)
        for i in range(first, last)
    ]


def rows_of(df):
    return sorted(df.selectExpr("dest_topic", "topic", "payload", "to_json(headers)", "key", "partition", "offset", "timestamp").collect(), key=lambda r: r["offset"])


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(synthetic, "GIVEN_PART", 7)


def test_each_message_once_over_restarts(spark, tmp_path, small_parts):
    out = str(tmp_path / "out")
    run = lambda rows: run_stream(fan(given_stream(spark, rows), HEADER), out_dir=out)
    for rows, total in ((given(0, 30), 30), (given(0, 30), 30), (given(0, 45), 45)):
        run(rows)
        assert rows_of(read_topic_table(spark, out)) == rows_of(fan(given_messages(spark, given(0, total)), HEADER).where("error is null"))
        assert sum(r["message_count"] + r["error_count"] for r in read_stream_metrics(spark, out).collect() if r["side"] == "source") == total


def test_a_shorter_list_than_seen_is_refused(spark, tmp_path):
    out = str(tmp_path / "out")
    run_stream(fan(given_stream(spark, given(0, 9)), HEADER), out_dir=out)
    with pytest.raises(StreamingQueryException):
        run_stream(fan(given_stream(spark, given(0, 4)), HEADER), out_dir=out)


def test_an_empty_list_and_dicts(spark, tmp_path):
    run_stream(fan(given_stream(spark, []), HEADER), out_dir=str(tmp_path / "none"))
    message = {"payload": b"x", "headers": {"to": "a"}, "topic": "t", "key": None, "partition": 0, "offset": 3, "timestamp": None}
    out = str(tmp_path / "one")
    run_stream(fan(given_stream(spark, [message]), HEADER), out_dir=out)
    assert [(r["dest_topic"], r["offset"]) for r in read_topic_table(spark, out).collect()] == [("a", 3)]
