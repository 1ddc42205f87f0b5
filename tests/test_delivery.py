"""Long topic names, runs of offsets, position index, order for brokers, settings."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from relayspark.operators.metrics import windowed_throughput
from relayspark.operators.routing import fan, route_table
from relayspark.operators.runs import loss_runs, offset_runs, run_differences
from relayspark.plans.config import _client_options, read_source
from relayspark.sinks import in_source_order, write_topics
from relayspark.sources.replay import index_positions, read_topic_table_source, replay_from, replay_stored
from relayspark.streaming.runner import read_topic_table, run_stream
from tests.conftest import T0, msg

HEADER = {"type": "header", "key": "d"}


@pytest.mark.parametrize("name", ["x" * 229, "x" * 230, "é" * 30, "é" * 300, "%" * 60, "*" * 120, "long/" * 400])
def test_topic_names_of_any_length(make, spark, tmp_path, name):
    """Batch, subscription and stream; names that differ at their end alone."""
    rows = make([msg("1", {"d": name}), msg("2", {"d": name + "b"}), msg("3", {"d": "s"})])
    write_topics(fan(rows, HEADER), f"{tmp_path}/t")
    got = lambda df: sorted((r["topic"], bytes(r["payload"])) for r in df.select("topic", "payload").collect())
    want = sorted([(name, b"1"), (name + "b", b"2"), ("s", b"3")])
    assert got(read_topic_table_source(spark, f"{tmp_path}/t")) == want
    assert got(read_topic_table_source(spark, f"{tmp_path}/t", [name])) == [(name, b"1")]
    rows.write.parquet(f"{tmp_path}/in")
    _, out = run_stream(fan(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), HEADER), out_dir=f"{tmp_path}/out")
    assert got(read_topic_table(spark, out).drop("topic").withColumnRenamed("dest_topic", "topic")) == want


def placed(spark, rows):
    return spark.createDataFrame(rows, "topic string, partition int, offset long")


def test_one_loss_and_one_duplicate_don_t_cancel(spark):
    sent = [("a", 0, i) for i in range(10)]
    got = [r for r in sent if r[2] != 4] + [("a", 0, 7)]
    out = loss_runs(placed(spark, sent), placed(spark, got)).collect()
    assert [tuple(r) for r in out] == [("a", 0, 10, 9, 1, 1, 0)]


def test_runs_and_differences_equal_sets(spark, monkeypatch):
    from relayspark.operators import runs

    rng = random.Random(2)
    for block in (1 << 20, 8):
        monkeypatch.setattr(runs, "BLOCK", block)
        draw = lambda n: [(rng.choice(["a", "b", None]), rng.choice([0, 1, None]), rng.choice([None, *range(-5, 60)])) for _ in range(n)]
        sent, got = draw(200), draw(150)
        of = lambda rows: {(t, p, o) for t, p, o in rows if p is not None and o is not None}
        spread = lambda df: [(r["topic"], r["partition"], o) for r in df.collect() for o in range(r["first_offset"], r["last_offset"] + 1)]
        a, b = offset_runs(placed(spark, sent)), offset_runs(placed(spark, got))
        assert sorted(map(str, spread(a))) == sorted(map(str, of(sent)))
        assert sum(r["messages"] for r in a.collect()) == sum(p is not None and o is not None for _, p, o in sent)
        firsts = {(r["topic"], r["partition"], r["first_offset"]) for r in a.collect()}
        assert not any((t, p, f - 1) in of(sent) for t, p, f in firsts)
        apart = run_differences(a, b)
        assert sorted(map(str, spread(apart.where("kind = 'lost'")))) == sorted(map(str, of(sent) - of(got)))
        assert sorted(map(str, spread(apart.where("kind = 'unexpected'")))) == sorted(map(str, of(got) - of(sent)))
    assert loss_runs(placed(spark, []), placed(spark, [])).collect() == []


def test_a_hot_partition_is_folded_in_blocks(spark):
    """The first window is keyed by block, too, and joins need no full sort."""
    from relayspark.session import plan_text

    plan = plan_text(offset_runs(spark.range(10).selectExpr("concat('t', id) AS topic", "id % 2 AS partition", "id AS offset")))
    dealt = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert len(dealt) == 2 and sum("block" in x for x in dealt) == 1


def test_runs_and_differences_go_on_over_blocks_and_are_dealt_by_block(spark, monkeypatch):
    """Where every message is a run of its own, no window holds a whole partition."""
    from relayspark.operators import runs
    from relayspark.session import plan_text

    monkeypatch.setattr(runs, "BLOCK", 8)
    top = (1 << 53) + 5
    at = [-17, *range(-9, 30), 31, 39, 40, 47, top, top + 1]
    sent, got = placed(spark, [("a", 0, i) for i in at]), placed(spark, [("a", 0, 16), ("a", 0, 50), ("a", 0, 16)])
    spans = lambda df: sorted((r["first_offset"], r["last_offset"]) for r in df.collect())
    a, b = offset_runs(sent), offset_runs(got)
    assert spans(a) == [(-17, -17), (-9, 29), (31, 31), (39, 40), (47, 47), (top, top + 1)]
    apart = run_differences(a, b)
    assert spans(apart.where("kind = 'lost'")) == [(-17, -17), (-9, 15), (17, 29), (31, 31), (39, 40), (47, 47), (top, top + 1)]
    assert spans(apart.where("kind = 'unexpected'")) == [(50, 50)]
    plan = plan_text(loss_runs(sent, got))
    windows = [x.split("]")[0] for x in plan.split("windowspecdefinition(")[1:]]
    assert windows and all("block" in x or "lot" in x for x in windows)


def test_replay_reads_only_files_at_or_after_the_start(make, spark, tmp_path):
    path = f"{tmp_path}/t"
    for begin in (0, 100, 200):
        rows = [msg(str(i), {"d": t}, topic="s", partition=p, offset=i) for i in range(begin, begin + 100) for t, p in (("a", 0), ("b", 0), ("a", 1))]
        write_topics(fan(make(rows).coalesce(1), HEADER), path)
        if begin < 200:
            assert index_positions(spark, path) == 2
    starts = {("a", 0): 150, ("a", 1): 250}
    found = replay_stored(spark, path, starts, "latest")
    table = read_topic_table_source(spark, path)
    order = ["topic", "partition", "offset"]
    assert sorted(map(str, found.select(order).collect())) == sorted(map(str, replay_from(table, starts, "latest").select(order).collect()))
    # Of the indexed files that of "a" from 100 on; those not indexed are read.
    assert len(replay_stored(spark, path, starts, "latest").inputFiles()) == 3
    assert index_positions(spark, path) == 2 and index_positions(spark, path) == 0
    assert len(replay_stored(spark, path, starts, "latest").inputFiles()) == 2
    whole = replay_stored(spark, path, starts)
    assert len(whole.inputFiles()) == 5 and sorted(map(str, whole.select(order).collect())) == sorted(map(str, replay_from(table, starts).select(order).collect()))
    assert replay_stored(spark, path, {}, "latest").count() == 0
    assert {r["topic"] for r in replay_stored(spark, path, {}, topics=["b"]).select("topic").distinct().collect()} == {"b"}


def test_a_broker_gets_each_partition_in_order(make, spark):
    """Each task's rows in the order in which a writer is given them."""
    rows = [msg(str(i), {"d": "x"}, topic=f"t{i % 2}", partition=i % 3, offset=i) for i in range(600)]
    random.Random(1).shuffle(rows)
    sent = in_source_order(fan(make(rows).repartition(7), HEADER))
    given = sent.select(F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("n"), "topic", "partition", "offset").collect()
    of = {}
    for r in sorted(given, key=lambda r: r["n"]):
        of.setdefault((r["topic"], r["partition"]), []).append((r["task"], r["offset"]))
    assert len(of) == 6
    for v in of.values():
        assert len({t for t, _ in v}) == 1 and [o for _, o in v] == sorted(o for _, o in v)


def test_windows_of_any_interval(make):
    rows = make([msg("1", topic="a", timestamp=T0)])
    for window, seconds in (("1 week", 604800), ("500 milliseconds", 0.5), ("1 hour 30 minutes", 5400), ("2 DAYS", 172800)):
        r = windowed_throughput(fan(rows, HEADER), window).first()
        assert abs(r["messages_per_second"] * seconds - 1) < 1e-9
        assert abs((r["window_end"] - r["window_start"]).total_seconds() - seconds) < 1e-9
    for window in ("1 month", "0 seconds"):
        with pytest.raises(ValueError, match="window"):
            windowed_throughput(fan(rows, HEADER), window)


def test_equal_positions_of_routes_are_refused(spark):
    table = lambda rows: spark.createDataFrame(rows, "source_topic string, destination_topic string, pos int")
    assert route_table(table([("a", "x", 1), ("a", "y", 2), ("b", "z", 1), ("b", "z", 1)])).count() == 2
    for tied in (("a", "y", 2), ("a", None, 2)):
        with pytest.raises(ValueError, match="'pos'"):
            route_table(table([("a", "x", 2), tied]))


def test_client_settings():
    with pytest.warns(UserWarning, match="enable_auto_commit"):
        assert _client_options({"enable_auto_commit": True, "linger_ms": 5, "kafka.security.protocol": "SSL"}) == {"kafka.linger.ms": "5", "kafka.security.protocol": "SSL"}
    for name in ("value_deserializer", "api_version"):
        with pytest.warns(UserWarning, match=name):
            assert _client_options({name: (2, 0)}) == {}
    with pytest.raises(ValueError, match="sasl_mechanisms"):
        _client_options({"sasl_mechanisms": ["PLAIN"]})


def test_table_sources_tell_that_messages_don_t_limit_them(make, spark, tmp_path):
    make([msg("1", topic="a")]).write.parquet(f"{tmp_path}/in")
    source = {"type": "table", "connection": {"path": f"{tmp_path}/in"}}
    with pytest.warns(UserWarning, match="max_files_per_trigger"):
        read_source(spark, source, ["a"], 10)
    source["connection"]["max_files_per_trigger"] = 1
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        read_source(spark, source, ["a"], 10)


def test_long_names_are_told_without_their_url_form(spark):
    """The form is asked for only where the name alone may fit a folder's name."""
    from relayspark.sinks.egress import FOLDER_BYTES, topic_folder

    names = ["", "x" * (FOLDER_BYTES - 1), "x" * FOLDER_BYTES, "é" * (FOLDER_BYTES // 2), "%" * 20, "%" * 50, None]
    out = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(topic_folder(F.col("n"))).collect()]
    assert [x and x[0] for x in out] == ["t", "t", "h", "h", "t", "h", None]
    condition = str(topic_folder(F.col("n"))).split("THEN")[0]
    assert condition.index("octet_length") < condition.index("url_encode")
