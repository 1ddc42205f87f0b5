"""Synthetic and given-message sources (S-05, S-06)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from relayspark.schema import MESSAGE


def synthetic_messages(ids: DataFrame, topics: Sequence[str], id_col: str = "id", prefix: str = "Mock message", source: str = "mock") -> DataFrame:
    """S-05: message *n* (from 1) goes round-robin to the subscribed topics with
    payload ``"<prefix> n"``, headers ``source`` and ``count``, key ``key-n``.

    ``ids`` holds the message numbers; any DataFrame with a long ``id_col``
    (``spark.range`` or ids Spark derives from a table).
    """
    if not topics:
        raise ValueError("synthetic source needs at least one topic")
    n = F.col(id_col)
    topic_arr = F.array(*[F.lit(t) for t in topics])
    k = len(topics)
    return ids.select(
        F.encode(F.concat(F.lit(prefix + " "), n.cast("string")), "UTF-8").alias("payload"),
        F.create_map(F.lit("source"), F.lit(source), F.lit("count"), n.cast("string")).alias("headers"),
        F.element_at(topic_arr, (F.pmod(n - 1, F.lit(k)) + 1).cast("int")).alias("topic"),
        F.concat(F.lit("key-"), n.cast("string")).alias("key"),
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("bigint").alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )


def synthetic_topics(spark: SparkSession, n: int, topics: Sequence[str]) -> DataFrame:
    """S-05 over ``spark.range(1, n + 1)``."""
    return synthetic_messages(spark.range(1, n + 1), topics)


def synthetic_stream(spark: SparkSession, topics: Sequence[str], rows_per_batch: int = 1000) -> DataFrame:
    """S-05 as a stream: ``rate-micro-batch`` numbers each row (from 0), so
    message *n* = value + 1 follows the same round-robin rule."""
    rate = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", int(rows_per_batch))
        .option("numPartitions", spark.sparkContext.defaultParallelism)
        .load()
    )
    return synthetic_messages(rate.select((F.col("value") + 1).alias("id")), topics)


def given_messages(spark: SparkSession, rows: Iterable) -> DataFrame:
    """S-06: a supplied list of messages (tuples or dicts in MESSAGE order)."""
    return spark.createDataFrame(list(rows), MESSAGE)


#: Messages of a given stream that one task hands over.
GIVEN_PART = 10_000


class _GivenPart(InputPartition):
    """A run of messages; a task gets its own run only."""

    def __init__(self, rows: list[tuple]):
        super().__init__(None)
        self.rows = rows


class _GivenReader(DataSourceStreamReader):
    def __init__(self, rows: list[tuple]):
        self._rows = rows

    def initialOffset(self) -> dict:
        return {"given": 0}

    def latestOffset(self) -> dict:
        return {"given": len(self._rows)}

    def partitions(self, start: dict, end: dict) -> list[_GivenPart]:
        first, last = int(start["given"]), int(end["given"])
        if last > len(self._rows):
            raise ValueError(f"the checkpoint has seen {last} given messages, but only {len(self._rows)} are given now")
        return [_GivenPart(self._rows[a : min(a + GIVEN_PART, last)]) for a in range(first, last, GIVEN_PART)]

    def read(self, partition: _GivenPart):
        return iter(partition.rows)

    def commit(self, end: dict) -> None:
        pass


def given_stream(spark: SparkSession, rows: Iterable) -> DataFrame:
    """S-06 as a stream: the supplied list, each message once, in runs of
    GIVEN_PART. The position in the list is the stream's offset, so a stream that
    restarts from its checkpoint with the same list goes on behind the last
    message it took, and with a longer list (the old one first) delivers what is
    new. A list shorter than what the checkpoint has seen is refused. The list is
    the driver's, as with ``given_messages``; large inputs are read from a table."""
    # By way of a DataFrame's rows: the same forms and checks as in batch.
    held = [tuple(r[c] for c in MESSAGE.fieldNames()) for r in given_messages(spark, rows).collect()]
    name = f"given_messages_{uuid.uuid4().hex}"

    class Given(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return MESSAGE

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _GivenReader(held)

    spark.dataSource.register(Given)
    return spark.readStream.format(name).load()
