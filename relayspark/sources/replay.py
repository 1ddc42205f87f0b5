"""Replay from a position (S-08) on stored topic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayspark.session import materialize

# Start tables up to this many rows and bytes of topic names are broadcast.
BROADCAST_START_LIMIT = 200_000
BROADCAST_START_BYTES = 16 << 20


def replay_from(df: DataFrame, starts, default: str = "earliest") -> DataFrame:
    """Keep messages at or after a start offset per ``(topic, partition)``.

    ``starts`` is a dict ``{(topic, partition): offset}`` or a DataFrame
    ``(topic, partition, start_offset)``; of repeated starts the greatest counts.
    Partitions without a start follow ``default``: ``earliest`` keeps them whole,
    ``latest`` drops them (nothing stored is newer than the end; refused for a
    stream, whose new messages it would drop).
    """
    if default not in ("earliest", "latest"):
        raise ValueError(f"default start must be 'earliest' or 'latest', not {default!r}")
    if default == "latest" and df.isStreaming:
        raise ValueError("default='latest' would drop a stream's new messages; use the source's starting position")
    if not isinstance(starts, DataFrame):
        rows = [(t, int(p), int(o)) for (t, p), o in dict(starts).items()]
        starts = df.sparkSession.createDataFrame(rows, "topic string, partition int, start_offset bigint")
    # Computed once into the shared checkpoint folder: the size check and the
    # join then read the small result instead of recomputing it.
    starts = materialize(starts.groupBy("topic", "partition").agg(F.max("start_offset").alias("start_offset")))
    n, names = starts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("topic")), F.lit(0))).first()
    small = n <= BROADCAST_START_LIMIT and names <= BROADCAST_START_BYTES
    # Else a shuffle join; adaptive execution splits a skewed topic partition.
    joined = df.join(F.broadcast(starts) if small else starts, ["topic", "partition"], "left" if default == "earliest" else "inner")
    keep = F.col("start_offset").isNull() | (F.col("offset") >= F.col("start_offset"))
    return joined.filter(keep).select(df.columns)


def read_topic_table_source(spark, path: str, topics=None, streaming: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stored topic table (written by ``write_topics``) read back as MESSAGE rows
    whose ``topic`` is the stored destination. ``topics`` subscribes (S-07); the
    filter names the folders, so only those topics' are listed and read."""
    from relayspark.schema import MESSAGE_COLUMNS
    from relayspark.sinks.egress import TOPIC_FOLDER, TOPIC_TABLE, topic_folder

    reader = (spark.readStream if streaming else spark.read).schema(TOPIC_TABLE)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    df = reader.parquet(path)
    if topics is not None:
        names = list(topics)
        df = df.filter(F.col(TOPIC_FOLDER).isin([topic_folder(F.lit(t)) for t in names]) & F.col("dest_topic").isin(names))
    return df.select(*[F.col("dest_topic").alias("topic") if c == "topic" else F.col(c) for c in MESSAGE_COLUMNS])


#: Folder of the position index beside a topic table's own (readers of the table
#: skip names that begin with an underscore).
POSITION_INDEX = "_positions"
_INDEX = "file string, topic string, partition int, first_offset long, last_offset long"


def _table(spark, path: str, files: list[str]) -> DataFrame:
    from relayspark.sinks.egress import TOPIC_TABLE

    reader = spark.read.schema(TOPIC_TABLE).option("basePath", path)
    return reader.parquet(*files) if files else spark.createDataFrame([], TOPIC_TABLE)


def _files(spark, path: str) -> dict[str, str]:
    """The table's files by their place in it (a table may be moved)."""
    from relayspark.sinks.egress import TOPIC_FOLDER

    return {f[f.rindex(f"/{TOPIC_FOLDER}=") :]: f for f in spark.read.parquet(path).inputFiles()}


def _read_index(spark, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    at = f"{path.rstrip('/')}/{POSITION_INDEX}"
    try:
        return spark.read.schema(_INDEX).parquet(at)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _INDEX)


def index_positions(spark, path: str) -> int:
    """S-08: add the files of a stored topic table that its position index lacks:
    the least and greatest offset of each (topic, partition) in a file. Reads three
    columns of new files alone; returns how many there were. An entry is one row a
    file, topic and partition, and is valid for as long as its file is there."""
    from relayspark.sinks.egress import TOPIC_FOLDER

    known = {r["file"] for r in _read_index(spark, path).select("file").distinct().toLocalIterator()}
    new = sorted(f for at, f in _files(spark, path).items() if at not in known)
    if new:
        place = F.regexp_extract(F.col("_metadata.file_path"), f"/{TOPIC_FOLDER}=[^/]*/[^/]*$", 0)
        rows = _table(spark, path, new).select(place.alias("file"), F.col("dest_topic").alias("topic"), "partition", "offset")
        found = rows.groupBy("file", "topic", "partition").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))
        found.write.mode("append").parquet(f"{path.rstrip('/')}/{POSITION_INDEX}")
    return len(new)


def replay_stored(spark, path: str, starts, default: str = "earliest", topics=None) -> DataFrame:
    """S-08 over a stored topic table: ``replay_from`` that opens only files that may
    hold messages at or after a start. Files that the index doesn't know yet are
    read, too, so a table without an index is replayed whole."""
    from relayspark.schema import MESSAGE_COLUMNS
    from relayspark.sinks.egress import TOPIC_FOLDER, topic_folder

    if not isinstance(starts, DataFrame):
        rows = [(t, int(p), int(o)) for (t, p), o in dict(starts).items()]
        starts = spark.createDataFrame(rows, "topic string, partition int, start_offset bigint")
    names = None if topics is None else list(topics)
    index = materialize(_read_index(spark, path))
    first = starts.groupBy("topic", "partition").agg(F.max("start_offset").alias("start_offset"))
    starting = index.join(first, ["topic", "partition"], "left")
    # Without a start or an offset: by the default.
    late = (F.col("last_offset") >= F.col("start_offset")) if default == "latest" else F.coalesce(F.col("last_offset") >= F.col("start_offset"), F.lit(True))
    needed = starting.where(late if names is None else late & F.col("topic").isin(names))
    wanted = {r["file"] for r in needed.select("file").distinct().toLocalIterator()}
    known = {r["file"] for r in index.select("file").distinct().toLocalIterator()}
    files = sorted(f for at, f in _files(spark, path).items() if at in wanted or at not in known)
    df = _table(spark, path, files)
    if names is not None:
        df = df.filter(F.col(TOPIC_FOLDER).isin([topic_folder(F.lit(t)) for t in names]) & F.col("dest_topic").isin(names))
    messages = df.select(*[F.col("dest_topic").alias("topic") if c == "topic" else F.col(c) for c in MESSAGE_COLUMNS])
    return replay_from(messages, starts, default)
