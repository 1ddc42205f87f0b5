"""Cases off the friendly path: odd names, bad results, repeated tables, rows
without times or positions, clusters without a shared folder."""

import re

import pytest
from pyspark.sql import functions as F

from relayspark.operators import checks
from relayspark.operators.metrics import destination_metrics, loss_check, topic_report, windowed_throughput
from relayspark.operators.processors import process, priority_tag
from relayspark.operators.routing import fan, one_to_one
from relayspark.plans.config import _client_options, broker_sink, read_source
from relayspark.session import plan_text
from relayspark.sinks import to_eventhubs, to_kafka, to_pubsub, to_pulsar, write_topics
from relayspark.sinks.egress import topic_rows
from relayspark.sources import from_eventhubs, kafka_reader_options, read_topic_table_source, replay_from
from tests.conftest import T0, msg

HEADER = {"type": "header", "key": "d"}
PAYLOAD = {"type": "payload_key", "key": "k"}
NAMES = ["", "007", "1", "1.0", "7", "2024-01-01", "a/b", "A", "a=b", "%20", "é"]


def by_name(make, names=NAMES):
    return fan(make([msg("p", {"d": n}, offset=i) for i, n in enumerate(names)]), HEADER)


@pytest.mark.parametrize("sink", [to_kafka, to_pulsar, to_eventhubs, lambda r: to_pubsub(r, "p"), topic_rows])
def test_sinks_do_not_repeat_the_route(make, sink):
    """The route is evaluated once per row (two wrapped parses), not once more
    for each condition of the delivered rows."""
    sent = sink(fan(make([msg('{"k": "x"}')]), PAYLOAD))
    plan = plan_text(sent, "extended").split("== Physical Plan ==")[1]
    assert len(re.findall("parse_json", plan)) <= 2
    assert sent.count() == 1


def test_topic_table_keeps_names(spark, make, tmp_path):
    path = str(tmp_path / "t")
    write_topics(by_name(make), path)
    assert sorted(r["topic"] for r in read_topic_table_source(spark, path).collect()) == sorted(NAMES)
    for n in NAMES:
        assert [r["topic"] for r in read_topic_table_source(spark, path, [n]).collect()] == [n]


def test_replay_with_a_vanished_destination_leaves_nothing(spark, make, tmp_path):
    from relayspark.streaming import read_stream_metrics, read_topic_table
    from relayspark.streaming.runner import _write_batch

    out = str(tmp_path / "o")
    write = _write_batch(out)
    write(by_name(make, ["A", "B"]), 0)
    write(by_name(make, ["A"]), 0)
    assert [r["dest_topic"] for r in read_topic_table(spark, out).collect()] == ["A"]
    assert {r["topic"] for r in read_stream_metrics(spark, out).where("side = 'destination'").collect()} == {"A"}


def test_continuous_streams_need_a_place_to_resume_from(spark, tmp_path):
    from relayspark.sources import synthetic_stream
    from relayspark.streaming import run_broker_stream, run_stream

    routed = fan(synthetic_stream(spark, ["a"], rows_per_batch=5), {"type": "header", "key": "source"})
    with pytest.raises(ValueError):
        run_stream(routed, drain=False)
    with pytest.raises(ValueError):
        run_broker_stream(to_kafka(routed), "kafka", {})


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from relayspark import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801 - the session's own name
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session._checkpoint_root(Session())


def test_windows_keep_messages_without_a_time(make):
    rows = [msg("a", timestamp=T0), msg("b"), msg("c")]
    for slide in (None, "1 minute"):
        got = windowed_throughput(fan(make(rows), HEADER), slide=slide).collect()
        assert sum(r["messages_per_second"] for r in got if r["window_start"] is None) * 300 == pytest.approx(2)
        assert sum(r["messages_per_second"] for r in got if r["window_start"]) * 300 == pytest.approx(1 if slide is None else 5)


def test_sliding_windows_equal_sparks_own(make):
    from datetime import timedelta

    rows = [msg("a", timestamp=T0 + timedelta(seconds=37 * i)) for i in range(40)]
    df = fan(make(rows), HEADER)
    for window, slide in (("5 minutes", "1 minute"), ("5 minutes", "2 minutes"), ("1 minute", None)):
        w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
        want = {(r["w"]["start"], r["w"]["end"]): r["count"] for r in df.groupBy(w.alias("w")).count().collect()}
        seconds = 60.0 * int(window.split()[0])
        got = {(r["window_start"], r["window_end"]): round(r["messages_per_second"] * seconds) for r in windowed_throughput(df, window, slide).collect()}
        assert got == want


def test_unknown_offsets_stay_exact_through_a_row_processor(make):
    class Same:
        def process(self, m):
            return m

    big = 2**53 + 1
    df = fan(make([msg("a", {"d": "x"}, offset=big, timestamp=T0), msg("b", {"d": "x"})]), HEADER)
    out = sorted(process(df, Same()).select("offset", "timestamp", "source_size").collect(), key=str)
    assert {(r["offset"], r["timestamp"]) for r in out} == {(big, T0), (None, None)}


@pytest.mark.parametrize("change", [{"headers": {"n": 1}}, {"headers": {1: "n"}}, {"payload": "text"}, {"payload": None}, {"key": 7}, {"headers": {"a": "\ud800"}}, {"headers": None}])
def test_bad_results_concern_their_row_alone(make, change):
    class Bad:
        def process(self, m):
            if m.payload == b"bad":
                for k, v in change.items():
                    setattr(m, k, v)
            return m

    out = process(fan(make([msg("bad", {"d": "x"}), msg("good", {"d": "x"})]), HEADER), Bad())
    r = destination_metrics(out, elapsed=1.0).first()
    assert (r["topic"], r["message_count"], r["error_count"]) == ("x", 1, 1)
    assert to_kafka(out).count() == 1


def test_a_payload_lost_after_routing_is_a_destination_error(make):
    out = by_name(make, ["x"]).withColumn("payload", F.lit(None).cast("binary"))
    r = destination_metrics(out, elapsed=1.0).first()
    assert (r["message_count"], r["total_bytes"], r["error_count"]) == (0, 0, 1)


def test_repeated_routes(spark, make):
    rows = make([msg("p", topic="a")])
    twice = spark.createDataFrame([("a", "x", 0), ("a", "y", 1)], "source_topic string, destination_topic string, pos int")
    routed = one_to_one(rows, twice)
    assert [r["dest_topic"] for r in routed.collect()] == ["y"]
    assert [(r["dest_topic"], r["lost"]) for r in loss_check(topic_report(routed, elapsed=1.0), twice).collect()] == [("y", 0)]
    with pytest.raises(ValueError):
        one_to_one(rows, twice.drop("pos"))
    assert one_to_one(rows, twice, broadcast_limit=0).count() == 1


def test_repeated_starts(spark, make):
    m = make([msg("p", topic="a", partition=0, offset=i) for i in range(4)])
    starts = spark.createDataFrame([("a", 0, 1), ("a", 0, 3), ("a", 0, 3)], "topic string, partition int, start_offset bigint")
    kept = replay_from(m, starts)
    assert kept.columns == m.columns and [r["offset"] for r in kept.collect()] == [3]
    with pytest.raises(ValueError):
        replay_from(spark.readStream.format("rate").load(), {}, default="latest")


def test_event_hubs_positions_that_are_no_numbers(spark):
    from relayspark.schema import EVENTHUBS_RAW

    rows = [(b"x", None, "1", "1:22:333", T0), (b"x", None, "p", "5", T0), (b"x", None, "2", "6", T0)]
    got = [(r["partition"], r["offset"], r["error"]) for r in from_eventhubs(spark.createDataFrame(rows, EVENTHUBS_RAW)).collect()]
    assert got == [(1, None, "undecodable position"), (None, 5, "undecodable position"), (2, 6, None)]


def test_priorities_beyond_64_bits(make):
    values = {"-99999999999999999999": "priority -99999999999999999999 < 5", "-1e400": "priority -inf < 5", "1e400": None, "99999999999999999999": None}
    df = priority_tag(fan(make([msg('{"priority": %s}' % v, {"v": v}) for v in values]), HEADER))
    got = {r["v"]: r["reason"] for r in df.select(F.col("headers")["v"].alias("v"), F.col("headers")["reason"].alias("reason")).collect()}
    assert got == values


def test_an_empty_expectation_is_met(make):
    t = by_name(make, ["a", "b"])
    got = {r["topic"]: (r["actual"], r["ok"]) for r in checks.check_order(t, {"a": [], "b": ["p"]}).collect()}
    assert got == {"a": ([], True), "b": (["p"], True)}


def test_first_n_is_cut_for_rows_without_positions(make):
    t = by_name(make, ["hot"] * 1).select("*")
    rows = make([msg(f"m{i}", {"d": "hot"}) for i in range(300)])
    hot = fan(rows, HEADER)
    assert checks.first_n(hot, 5).count() == 5
    salt = F.pmod(F.xxhash64("partition", "offset", "timestamp", "key", "payload"), F.lit(checks.TOP_N_SALTS))
    assert hot.select(salt).distinct().count() > 50
    assert checks.first_n(t, 5).count() == 1


def test_rate_needs_no_single_task(make):
    from relayspark.operators.metrics import source_metrics

    plan = plan_text(source_metrics(by_name(make)), "formatted").split("===== Subqueries =====")[0]
    assert "SinglePartition" not in plan and "Window" not in plan


def test_configured_sources_deliver_every_row(spark, make, monkeypatch):
    """Fan on each broker: rows carry the broker's own topic names."""
    from relayspark.plans import config

    topics = {"eventhubs": "eventhub-0", "google_pubsub": "projects/p/subscriptions/s", "pulsar": "persistent://public/default/t", "kafka": "t"}
    for kind, topic in topics.items():
        monkeypatch.setattr(config, "read_topics", lambda *a, topic=topic, **k: make([msg("p", {"d": "x"}, topic=topic)]))
        conn = {"connection_string": "Endpoint=sb://n.x/;EntityPath=t", "project_id": "p", "subscription_id": "s", "service_url": "u", "bootstrap_servers": "b"}
        cfg = {"mode": "fan", "thread_pool": {"queue_size": 7}, "fan": {"source": {"type": kind, "connection": conn}, "source_topic": "t", "destination": {"type": "mock"}, "destination_resolver": HEADER}}
        routed, _ = config.flow_from_config(spark, cfg)
        assert [r["dest_topic"] for r in routed.collect()] == ["x"]


def test_client_settings_and_limits(spark, monkeypatch):
    from relayspark.plans import config

    conn = {"bootstrap_servers": "b:1", "group_id": "g", "security_protocol": "SASL_SSL", "sasl_plain_username": "u", "sasl_plain_password": "p", "linger_ms": 5, "auto_offset_reset": "earliest"}
    opts = _client_options(conn)
    assert opts["kafka.security.protocol"] == "SASL_SSL" and opts["kafka.linger.ms"] == "5" and 'username="u"' in opts["kafka.sasl.jaas.config"]
    seen = {}
    monkeypatch.setattr(config, "read_topics", lambda spark, broker, options, **k: seen.update(options))
    read_source(spark, {"type": "kafka", "connection": conn}, ["t"], None)
    assert seen["failOnDataLoss"] == "true" and seen["kafka.group.id"] == "g" and "maxOffsetsPerTrigger" not in seen
    assert kafka_reader_options("b", ["t"], fail_on_data_loss=False)["failOnDataLoss"] == "false"
    sent = {}
    monkeypatch.setattr(config, "write_broker", lambda df, fmt, options: sent.update(options, columns=df.columns))
    broker_sink({"type": "kafka", "connection": conn})(by_name_frame(spark))
    assert sent["kafka.security.protocol"] == "SASL_SSL"
    broker_sink({"type": "pulsar", "connection": {"service_url": "u"}})(by_name_frame(spark))
    assert "__messageProperties" in sent["columns"]


def by_name_frame(spark):
    from relayspark.schema import MESSAGE

    return fan(spark.createDataFrame([msg("p", {"d": "x"})], MESSAGE), HEADER)


def test_streams_read_tables_of_many_files(spark, tmp_path):
    """The five streamed queries agree with the batch ones over a folder of files."""
    import __spark_entry__ as entry
    from tests.conftest import SF_SMALL

    sf = str(tmp_path / "sf")
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3).write.parquet(f"{sf}/events.parquet")
    q = entry.queries()
    rows = lambda name, at: sorted(map(str, q[name](spark, at).collect()))
    for name in ("stream_fan_drain", "stream_windowed_throughput", "stream_windowed_errors", "stream_windowed_volume", "stream_metrics"):
        assert rows(name, sf) == rows(name, SF_SMALL)
