"""K-01 .. K-05 egress projections and the topic table writer."""

from pyspark.sql import functions as F

from relayspark.operators.routing import fan
from relayspark.sinks import to_eventhubs, to_kafka, to_pubsub, to_pulsar, write_topics
from tests.conftest import msg

HEADER = {"type": "header", "key": "d"}


def routed(make):
    return fan(make([msg("p1", {"d": "t1"}, key="", partition=0, offset=1), msg("p2", {"d": "t2"}, key="k", partition=0, offset=2), msg(None, {"d": "t1"})]), HEADER)


def test_kafka_projection(spark, make):
    rows = {r["topic"]: r for r in to_kafka(routed(make)).collect()}
    assert set(rows) == {"t1", "t2"}  # the error row is not sent
    assert rows["t1"]["key"] is None and bytes(rows["t2"]["key"]) == b"k"
    assert [(h["key"], bytes(h["value"])) for h in rows["t2"]["headers"]] == [("d", b"t2")]
    assert to_kafka(routed(make)).columns == ["key", "value", "headers", "topic"]


def test_pulsar_projection(spark, make):
    df = to_pulsar(routed(make))
    assert df.columns == ["value", "properties", "partition_key", "topic"]
    assert df.count() == 2


def test_eventhubs_projection_drops_topic_and_key(spark, make):
    df = to_eventhubs(routed(make))
    assert df.columns == ["body", "properties"]


def test_pubsub_projection(spark, make):
    rows = sorted(r["topic"] for r in to_pubsub(routed(make), "proj").collect())
    assert rows == ["projects/proj/topics/t1", "projects/proj/topics/t2"]
    assert "key" not in to_pubsub(routed(make), "proj").columns


def test_write_topics_partitioned(spark, make, tmp_path):
    path = str(tmp_path / "topics")
    write_topics(routed(make), path)
    back = spark.read.parquet(path)
    assert sorted(r["dest_topic"] for r in back.collect()) == ["t1", "t2"]
    assert back.filter(F.col("dest_topic") == "t2").count() == 1


def test_written_topic_files_keep_order(spark, make, tmp_path):
    import os

    import pyarrow.parquet as pq

    rows = [msg(f"m{i}", {"d": "t1" if i % 2 else "t2"}, partition=(7 * i) % 3, offset=(13 * i) % 50) for i in range(50)]
    path = str(tmp_path / "ordered")
    write_topics(fan(make(rows), HEADER), path)
    n = 0
    for root, _, files in os.walk(path):
        for f in files:
            if f.endswith(".parquet"):
                t = pq.read_table(os.path.join(root, f), columns=["partition", "offset"]).to_pylist()
                keys = [(r["partition"], r["offset"]) for r in t]
                assert keys == sorted(keys)
                n += 1
    assert n > 0


def test_topic_table_read_back_prunes_partitions(spark, make, tmp_path):
    """S-07 on stored topics: subscribing to a stored topic reads only its folder."""
    from relayspark.session import plan_text
    from relayspark.sources import read_topic_table_source

    path = str(tmp_path / "stored")
    write_topics(routed(make), path)
    df = read_topic_table_source(spark, path, ["t2"])
    plan = plan_text(df)
    line = next(x for x in plan.splitlines() if x.startswith("PartitionFilters"))
    assert "topic_folder" in line and "tt2" in line
    rows = df.collect()
    assert [(r["topic"], bytes(r["payload"])) for r in rows] == [("t2", b"p2")]
