"""A topic holding a large share of all rows: exact results, work spread."""

from pyspark.sql import functions as F

from relayspark.operators import checks
from relayspark.operators.metrics import topic_report
from relayspark.operators.routing import fan, one_to_one
from tests.conftest import msg

N = 600


def hot_messages(make):
    # Topic "hot" holds half of all rows; the rest spread over 20 topics.
    rows = [
        msg(f"m{i}", {"d": "x"}, topic="hot" if i % 2 == 0 else f"t{i % 20}", partition=i % 4, offset=i)
        for i in range(N)
    ]
    return make(rows).repartition(8)


def test_salted_route_join_splits_hot_topic(spark, make):
    df = hot_messages(make)
    table = spark.createDataFrame([("hot", "H")] + [(f"t{i}", f"T{i}") for i in range(20)], "source_topic string, destination_topic string")
    routed = one_to_one(df, table, broadcast_limit=0)  # force the shuffle path
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # tiny partitions would be put together
    try:
        tasks = routed.filter(F.col("topic") == "hot").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks > 1
    assert routed.filter(F.col("dest_topic") == "H").count() == N // 2
    assert routed.count() == N


def test_hot_topic_metrics_exact(spark, make):
    rep = {(r["side"], r["topic"]): r["message_count"] for r in topic_report(fan(hot_messages(make), {"type": "header", "key": "d"}), elapsed=1.0).collect()}
    assert rep[("source", "hot")] == N // 2
    assert rep[("destination", "x")] == N


def test_hot_topic_first_n_exact(spark, make):
    df = fan(hot_messages(make), {"type": "header", "key": "d"}).withColumn("dest_topic", F.col("topic"))
    got = [r["offset"] for r in checks.first_n(df.filter(F.col("topic") == "hot"), 5).orderBy("rank").collect()]
    want = sorted(((i % 4, i) for i in range(0, N, 2)))[:5]
    assert got == [o for _, o in want]
