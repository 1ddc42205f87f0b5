"""Exact top-k search by inner product: tiles of a matrix product.

Every shard (a run of rows of the candidate table) is multiplied with blocks of
queries; from each tile a partial selection keeps the k best of each query, and
the lists of tiles are merged in two levels (within a group of tiles, then
overall). Query blocks have a fixed number of rows; a few are sent to the tasks at a
time, their results are written, and they are released before the next are sent, so
memory and plan are bounded however many queries there are.

Components are turned into integers, floor(scale * x), and products are exact:
in double precision while no partial sum can reach 2^53, in Python integers
(cut to the range of a long) beyond that.

Defined results: a vector that is null, empty or holds a null, NaN or infinite
component takes no part, nor does one without an id; a vector of another length
than the query's isn't scored against it. Candidates are every row but those
with the query's own id; of repeated query rows, the least vector counts. Rows
with equal scores rank by smaller id. No candidates: no rows for that query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayspark.llm.common import shared_dir

#: Queries in one block; a block of 64 components takes 1 MB.
QUERY_BLOCK = 2048
#: Query blocks multiplied in one pass over the candidates.
BLOCKS_PER_PASS = 8
#: Candidate rows in one tile.
TILE_ROWS = 4096
#: Groups in which tile lists meet first.
MERGE_GROUPS = 16

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part, components as doubles."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)


def _integers(flat: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(flat * scale)


def _products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    most = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * queries.shape[1]
    if most < 2.0**53:
        return (queries @ shard.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in queries], dtype=object) @ np.array([[int(x) for x in r] for r in shard], dtype=object).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def _select(scores: np.ndarray, rows: np.ndarray, query_rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile (queries by candidates, ids ascending), the k best of each
    query: queries, candidates, scores."""
    own = query_rows[:, None] == rows[None, :]
    low = np.where(own, LEAST, scores)
    if low.shape[1] > k:
        cut = np.partition(low, low.shape[1] - k, axis=1)[:, -k][:, None]
        above = low > cut
        tied = (low == cut) & ~own
        # Ties in order of columns, which is the order of ids.
        chosen = above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)))
    else:
        chosen = ~own
    query, col = np.nonzero(chosen)
    return query, col, low[query, col]


def _blocks(queries: DataFrame, size: int) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Query blocks, a few at a time: each block is (ids, row numbers, vectors) of
    one length; rows come to the driver a partition at a time."""
    held: dict[int, list] = {}
    ready: list[tuple[np.ndarray, ...]] = []
    whole = lambda own: tuple(map(np.array, zip(*own)))
    for r in queries.toLocalIterator():
        own = held.setdefault(len(r["v"]), [])
        own.append((r["vec_id"], r["row"], r["v"]))
        if len(own) == size:
            ready.append(whole(own))
            own.clear()
            if len(ready) == BLOCKS_PER_PASS:
                yield ready
                ready = []
    # At most one block of each length is left.
    for own in held.values():
        if own:
            ready.append(whole(own))
            if len(ready) == BLOCKS_PER_PASS:
                yield ready
                ready = []
    if ready:
        yield ready


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 1024.0,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k best candidates of every query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark, "top-k")
    # Written once, so that a row has one number wherever it is read.
    numbered = whole_vectors(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id())
    numbered.write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.schema("vec_id long, v array<double>, row long").parquet(f"{folder}/rows")
    result = "query_id long, rank int, vec_id long, score long"
    found = spark.createDataFrame([], result)
    for n, blocks in enumerate(_blocks(rows.where(is_query), query_block)):
        sent = spark.sparkContext.broadcast([(ids, numbers, _integers(v, scale)) for ids, numbers, v in blocks])
        lists = rows.mapInArrow(_tiles(sent, k, scale), "query_row long, query_id long, vec_id long, score long, tile int")
        ranked = Window.partitionBy("query_row", "tile").orderBy(F.desc("score"), "vec_id")
        merged = lists.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k).drop("place", "tile")
        ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        best = merged.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        best.write.mode("overwrite").parquet(f"{folder}/found/pass={n}")
        sent.destroy()
        found = spark.read.schema(f"{result}, pass int").parquet(f"{folder}/found").drop("pass")
    return found


def _tiles(sent, k: int, scale: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = TaskContext.get().partitionId()
        for batch in batches:
            for begin in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(begin, TILE_ROWS)
                ids, numbers = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
                lists = part.column("v")
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
                size, first = np.diff(ends), ends[:-1] - ends[0]
                for n in np.unique(size):
                    at = np.flatnonzero(size == n)
                    at = at[np.argsort(ids[at], kind="stable")]
                    shard = _integers(flat[first[at][:, None] + np.arange(n)], scale)
                    for query_ids, query_rows, queries in sent.value:
                        if queries.shape[1] != n:
                            continue
                        query, found, scores = _select(_products(queries, shard), numbers[at], query_rows, k)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "query_row": pa.array(query_rows[query], pa.int64()),
                                "query_id": pa.array(query_ids[query], pa.int64()),
                                "vec_id": pa.array(ids[at][found], pa.int64()),
                                "score": pa.array(scores, pa.int64()),
                                "tile": pa.array(np.full(len(query), tile % MERGE_GROUPS), pa.int32()),
                            }
                        )
                tile += 1

    return score
