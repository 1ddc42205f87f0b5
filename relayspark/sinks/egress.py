"""Egress projections (K-01 .. K-04) and writers (K-05).

The brokers do not receive the same fields; each projection states exactly
what its sink gets. Error rows are carried up to here (metrics need them) and
are dropped only here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relayspark.operators.metrics import delivered
from relayspark.schema import MESSAGE, MESSAGE_COLUMNS


def _sent(routed: DataFrame, *columns: Column | str) -> DataFrame:
    """The given columns of delivered rows.

    A filter on ``dest_topic`` would be pushed below the routing projection and
    evaluate the route (a JSON parse for payload routes) again for every place
    the condition names it. Yielding one row or none from an array is a
    generator, which no filter crosses: the route is evaluated once.
    """
    row = F.struct(*[F.col(c) if isinstance(c, str) else c for c in columns])
    return routed.select(F.inline(F.when(delivered(routed), F.array(row))))


def deliverable(routed: DataFrame) -> DataFrame:
    """Rows a sink sends: no source error, a destination, no delivery error."""
    return _sent(routed, *routed.columns)


def to_kafka(routed: DataFrame) -> DataFrame:
    """K-01: value, key (empty -> NULL), headers as UTF-8 bytes, topic.
    Partition, offset and timestamp are not sent."""
    return _sent(
        routed,
        F.when(F.col("key") != "", F.encode(F.col("key"), "UTF-8")).alias("key"),
        F.col("payload").alias("value"),
        F.transform(
            F.map_entries(F.col("headers")),
            lambda e: F.struct(e["key"].alias("key"), F.encode(e["value"], "UTF-8").alias("value")),
        ).alias("headers"),
        F.col("dest_topic").alias("topic"),
    )


def to_pulsar(routed: DataFrame) -> DataFrame:
    """K-02: payload, properties, partition key, topic."""
    return _sent(
        routed,
        F.col("payload").alias("value"),
        F.col("headers").alias("properties"),
        F.col("key").alias("partition_key"),
        F.col("dest_topic").alias("topic"),
    )


def to_eventhubs(routed: DataFrame) -> DataFrame:
    """K-03: payload and properties only; the resolved topic and the key are
    not sent (the hub is fixed by the connection). Metrics still count the
    resolved topic (Q-18)."""
    return _sent(routed, F.col("payload").alias("body"), F.col("headers").alias("properties"))


def to_pubsub(routed: DataFrame, project: str) -> DataFrame:
    """K-04: payload and attributes to ``projects/<project>/topics/<topic>``;
    the key is not sent."""
    return _sent(
        routed,
        F.col("payload").alias("data"),
        F.col("headers").alias("attributes"),
        F.format_string("projects/%s/topics/%s", F.lit(project), F.col("dest_topic")).alias("topic"),
    )


# A topic table keeps the destination as an ordinary column, beside a folder
# column that holds it in URL form after a letter: any name (empty, numeric, a
# date, with slashes) is a folder name. A name whose folder would be longer than
# file systems allow goes into a folder named by its hash; the column tells names
# of one folder apart, so neither length nor a collision changes what is read.
TOPIC_FOLDER = "topic_folder"
TOPIC_TABLE = T.StructType([*MESSAGE.fields, T.StructField("dest_topic", T.StringType()), T.StructField(TOPIC_FOLDER, T.StringType())])


#: Bytes of a folder's name that a topic may take; file systems allow 255, of
#: which the column's name and "=" take 13.
FOLDER_BYTES = 230


def topic_folder(topic: Column) -> Column:
    url = F.url_encode(topic)
    # In a folder's name Spark writes % and * as three characters each.
    written = F.length(url) + 2 * F.regexp_count(url, F.lit("[%*]"))
    # The form is never shorter than the name: a long name is not encoded to be told.
    short = (F.octet_length(topic) < FOLDER_BYTES) & (written < FOLDER_BYTES)
    return F.when(short, F.concat(F.lit("t"), url)).otherwise(F.concat(F.lit("h"), F.sha2(topic, 256)))


def topic_rows(routed: DataFrame) -> DataFrame:
    """Delivered rows in (partition, offset) order within each task and topic
    (T-04); a per-task sort, no shuffle. The folder leads the sort so the
    partitioned writer finds its required order and does not re-sort."""
    rows = _sent(routed, *MESSAGE_COLUMNS, "dest_topic", topic_folder(F.col("dest_topic")).alias(TOPIC_FOLDER))
    return rows.sortWithinPartitions(TOPIC_FOLDER, "partition", "offset")


def write_topics(routed: DataFrame, path: str, mode: str = "append") -> None:
    """K-05: store delivered rows as a topic table partitioned by destination."""
    topic_rows(routed).write.mode(mode).partitionBy(TOPIC_FOLDER).parquet(path)


def in_source_order(routed: DataFrame) -> DataFrame:
    """T-04 for a broker: every source partition in one task, offsets ascending.

    Needed where a read splits a partition (``minPartitions``) or a join has moved
    messages: tasks write at the same time, and only rows of one task keep their
    order. A partition is then written by one task, as its order demands; rows
    without a position come first, in no order."""
    return routed.repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset")


def write_broker(projected: DataFrame, fmt: str, options: dict[str, str]) -> None:
    """Batch write of a projection to a broker connector (``kafka`` etc.)."""
    projected.write.format(fmt).options(**options).save()
