"""Relay configurations run unchanged: mode, sources, destination, routes."""

import pytest
from pyspark.sql import functions as F

from relayspark.operators.routing import one_to_one
from relayspark.plans.config import _eventhubs_parts, _starting, broker_sink, flow_from_config, start_from_config
from relayspark.sources.tables import events_messages
from relayspark.streaming import read_stream_metrics, read_topic_table
from tests.conftest import SF_SMALL


@pytest.fixture
def topic_table(spark, tmp_path):
    path = str(tmp_path / "in")
    events_messages(spark, SF_SMALL, topic=None).repartition(3).write.parquet(path)
    return path


def test_one_to_one_config(spark, tmp_path, topic_table):
    cfg = {
        "mode": "one_to_one",
        "thread_pool": {"max_workers": 20, "queue_size": 2000},
        "back_pressure": {"enabled": True},
        "one_to_one": {
            "source": {"type": "table", "connection": {"path": topic_table, "max_files_per_trigger": 1}},
            "destination": {"type": "table", "connection": {}},
            "mappings": [
                {"source_topic": "purchase", "destination_topic": "orders-processed"},
                {"source_topic": "signup", "destination_topic": "signups-processed"},
            ],
        },
    }
    q, out = start_from_config(spark, cfg, out_dir=str(tmp_path / "out"), drain=True)
    got = {r[0]: r[1] for r in read_topic_table(spark, out).groupBy("dest_topic").count().collect()}
    routes = {"purchase": "orders-processed", "signup": "signups-processed"}
    want = {r[0]: r[1] for r in one_to_one(events_messages(spark, SF_SMALL, topic=None), routes).filter("error IS NULL").groupBy("dest_topic").count().collect()}
    assert got == want
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 3  # one file per trigger
    sides = {r["side"] for r in read_stream_metrics(spark, out).collect()}
    assert sides == {"source", "destination"}


def test_funnel_config_with_processor(spark, tmp_path, topic_table):
    cfg = {
        "mode": "funnel",
        "processor_class": "relayspark.plans.examples.StampProcessor",
        "funnel": {
            "sources": [
                {"type": "table", "connection": {"path": topic_table}, "topics": ["click", "view"]},
                {"type": "table", "connection": {"path": topic_table}, "topics": ["error"]},
            ],
            "destination": {"type": "table", "connection": {}},
            "destination_topic": "aggregated-topic",
        },
    }
    _, out = start_from_config(spark, cfg, out_dir=str(tmp_path / "out"), drain=True)
    t = read_topic_table(spark, out)
    want = events_messages(spark, SF_SMALL, topic=None).filter("topic IN ('click', 'view', 'error') AND payload IS NOT NULL").count()
    assert t.count() == want
    assert t.filter(F.col("headers")["stamped_by"] == "relay").count() == want


def test_fan_config_with_mock_source(spark, tmp_path):
    cfg = {
        "mode": "fan",
        "fan": {
            "source": {"type": "mock", "connection": {}},
            "source_topic": "input-topic",
            "destination": {"type": "mock", "connection": {}},
            "destination_resolver": {"type": "header", "key": "source"},
        },
    }
    q, out = start_from_config(spark, cfg, out_dir=str(tmp_path / "out"), processing_time="0 seconds")
    try:
        while sum(p["numInputRows"] for p in q.recentProgress) < 100:
            q.awaitTermination(0.5)
    finally:
        q.stop()
    t = read_topic_table(spark, out)
    assert t.count() >= 100
    assert {r[0] for r in t.select("dest_topic").distinct().collect()} == {"mock"}
    assert {r[0] for r in t.select("topic").distinct().collect()} == {"input-topic"}


def test_option_mapping():
    assert _starting("kafka", "earliest") == "earliest" and _starting("kafka", None) == "latest"
    # An Event Hubs client's start of a partition, its default.
    assert _starting("eventhubs", "-1") == _starting("eventhubs", None) == "earliest" and _starting("eventhubs", "@latest") == "latest"
    for kind, value in (("kafka", "none"), ("kafka", "17"), ("eventhubs", "12345"), ("pulsar", "somewhere")):
        with pytest.raises(ValueError):
            _starting(kind, value)
    ns, cs, hub = _eventhubs_parts({"connection_string": "Endpoint=sb://myns.servicebus.windows.net/;SharedAccessKeyName=k;EntityPath=hub1"})
    assert (ns, hub) == ("myns", "hub1")
    assert callable(broker_sink({"type": "kafka", "connection": {"bootstrap_servers": ["a:1", "b:2"]}}))
    assert broker_sink({"type": "mock"}) is None


def test_config_errors(spark):
    with pytest.raises(ValueError):
        flow_from_config(spark, {"mode": "scatter"})
    with pytest.raises(Exception) as exc:
        flow_from_config(
            spark,
            {
                "mode": "fan",
                "fan": {
                    "source": {"type": "kafka", "connection": {"bootstrap_servers": ["localhost:9"], "group_id": "g", "auto_offset_reset": "earliest"}},
                    "source_topic": "input-topic",
                    "destination": {"type": "kafka", "connection": {"bootstrap_servers": ["localhost:9"]}},
                    "destination_resolver": {"type": "header", "key": "destination_topic"},
                },
            },
        )
    assert "kafka" in str(exc.value).lower()
