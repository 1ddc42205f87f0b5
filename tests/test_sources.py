"""S-01 .. S-08 and N-01 .. N-05 on replayed raw rows (no broker needed)."""

from datetime import datetime

from pyspark.sql import functions as F

from relayspark.schema import EVENTHUBS_RAW, KAFKA_RAW, PUBSUB_RAW, PULSAR_RAW
from relayspark.sources import (
    eventhubs_reader_options,
    from_eventhubs,
    from_kafka,
    from_pubsub,
    from_pulsar,
    given_messages,
    kafka_reader_options,
    replay_from,
    synthetic_topics,
)
from relayspark.sources.tables import events_messages
from tests.conftest import SF_SMALL, T0, msg


def test_kafka_normaliser(spark):
    rows = [
        (b"k1", b"v1", [("h", b"1"), ("h", b"2"), ("n", None)], "t", 0, 5, T0),
        (b"", b"v2", [], "t", 1, 6, T0),
        (b"\xff", b"v3", None, "t", 1, 7, T0),
        (b"k4", None, [("bad", b"\xff")], "t", 1, 8, T0),
    ]
    m = from_kafka(spark.createDataFrame(rows, KAFKA_RAW)).orderBy("offset").collect()
    assert m[0]["headers"] == {"h": "2", "n": "None"}  # N-02 last wins, N-01 'None'
    assert m[0]["key"] == "k1" and m[0]["error"] is None and m[0]["partition"] == 0
    assert m[1]["key"] is None and m[1]["headers"] == {}  # N-03 empty key -> NULL
    assert m[2]["error"] == "undecodable key"  # Q-08: a row error, the stream goes on
    assert m[3]["error"] == "undecodable header" and m[3]["payload"] is None


def test_pulsar_normaliser(spark):
    rows = [(b"d", {"a": "b"}, "persistent://p/t", "", 1704067200000), (b"e", None, "persistent://p/t", "k", 0)]
    m = from_pulsar(spark.createDataFrame(rows, PULSAR_RAW)).collect()
    assert m[0]["key"] is None and m[0]["headers"] == {"a": "b"}
    assert m[0]["timestamp"] == datetime(2024, 1, 1)
    assert m[1]["timestamp"] is None and m[1]["headers"] == {}  # N-04: 0 -> NULL


def test_eventhubs_normaliser(spark):
    rows = [
        (b"body", [(b"shape", b"round")], "6", "4711", T0),
        (None, None, "6", None, None),  # null event: skipped
    ]
    m = from_eventhubs(spark.createDataFrame(rows, EVENTHUBS_RAW)).collect()
    assert len(m) == 1
    r = m[0]
    assert r["headers"] == {"shape": "round"}
    assert (r["topic"], r["partition"], r["offset"]) == ("eventhub-6", 6, 4711)


def test_pubsub_normaliser(spark):
    rows = [(b"d", {"region": "north", "lane": "7"}, T0, "ack", "s")]
    r = from_pubsub(spark.createDataFrame(rows, PUBSUB_RAW), project="p").first()
    assert r["headers"] == {"region": "north", "lane": "7"}
    assert r["topic"] == "projects/p/subscriptions/s"


def test_synthetic_round_robin(spark):
    rows = synthetic_topics(spark, 5, ["a", "b"]).collect()
    assert [r["topic"] for r in rows] == ["a", "b", "a", "b", "a"]
    assert bytes(rows[2]["payload"]) == b"Mock message 3"
    assert rows[2]["headers"] == {"source": "mock", "count": "3"} and rows[2]["key"] == "key-3"


def test_given_messages_keep_order(spark):
    df = given_messages(spark, [msg("m1", offset=1), msg("m2", offset=2)])
    assert [bytes(r["payload"]) for r in df.collect()] == [b"m1", b"m2"]


def test_replay_from(spark, make):
    rows = [msg(f"m{i}", topic="t", partition=i % 2, offset=i) for i in range(10)] + [msg("u", topic="u", partition=0, offset=0)]
    kept = replay_from(make(rows), {("t", 0): 4, ("t", 1): 7})
    assert sorted((r["topic"], r["offset"]) for r in kept.collect()) == [("t", 4), ("t", 6), ("t", 7), ("t", 8), ("t", 9), ("u", 0)]
    latest = replay_from(make(rows), {("t", 0): 4}, default="latest")
    assert sorted(r["offset"] for r in latest.collect()) == [4, 6, 8]


def test_reader_options():
    o = kafka_reader_options("b:9092", ["a", "b"], {"a": {0: 5}}, 1000)
    assert o["subscribe"] == "a,b" and o["includeHeaders"] == "true"
    assert o["startingOffsets"] == '{"a": {"0": 5}}' and o["maxOffsetsPerTrigger"] == "1000"
    assert kafka_reader_options("b", ["a"], {"timestamp": 17})["startingTimestamp"] == "17"
    e = eventhubs_reader_options("ns", "Endpoint=sb://x", "hub", "earliest")
    assert e["kafka.bootstrap.servers"] == "ns.servicebus.windows.net:9093" and e["subscribe"] == "hub"
    assert e["kafka.security.protocol"] == "SASL_SSL"


def test_events_view_keeps_every_row(spark):
    m = events_messages(spark, SF_SMALL)
    raw = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert m.count() == raw.count()
    assert m.filter(F.col("payload").isNull()).count() == raw.filter(F.pmod("event_id", F.lit(10)) == 3).count()


def test_kafka_binding_needs_connector(spark):
    """The binding is wired to format("kafka"); without the connector jar on
    the classpath Spark refuses to resolve the source."""
    import pytest

    from relayspark.sources import read_topics

    with pytest.raises(Exception) as exc:
        read_topics(spark, "kafka", kafka_reader_options("localhost:9", ["t"]), streaming=False)
    assert "kafka" in str(exc.value).lower()
