"""Small files beside a stream's tables, in any store that Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    store, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    store, place = _at(spark, path)
    stream = store.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """Write under another name, then rename: the file is there whole or not at all."""
    store, place = _at(spark, path)
    other = _at(spark, f"{path}.writing")[1]
    stream = store.create(other, True)
    stream.write(text.encode())
    stream.close()
    store.delete(place, False)
    if not store.rename(other, place):
        raise OSError(f"{path} could not be written")


def delete(spark: SparkSession, path: str) -> None:
    store, place = _at(spark, path)
    store.delete(place, True)
