"""Conversation prefix trie: one row for each distinct sequence of first turns.

A conversation is a path: the digests of its turns in order, 16 bytes each. Equal
paths become one, with the number of its conversations and their least id. Paths
are range-partitioned and sorted, so every node of the trie is a run of neighbours.

Each shard (a run of sorted paths of bounded size) is written as balanced
parentheses: from path to path, the turns that end close and those that begin
open. Blocks of excess values keep their minima in a range min-max tree; findclose
climbs and descends it for all opens at once. A node's subtree then lies between
its open and its close, and everything asked about it is a difference of cumulative
arrays over positions: members (weights of paths at their last open), leaves (rank
of pairs "()") and saved tokens (each node's share, counted at its open).

Only the first and the last path of a shard can go on in another shard. Nodes on
these two, the spine, are merged by digest: sums of members and of what the shards
counted below them off the spine, then suffix sums along the spines for what spine
nodes add to their ancestors, each counted in the first shard that holds it.

The ids that end at a node are hashed in ascending order. Their text is joined in
range partitions of (path, id) first, so that a path of very many conversations is
one row for each piece of JOINED characters where one task must hash in order.

Defined results: rows without a conversation id belong to none; a null role or text
is empty; turns are ordered by number (null first), those of one number by digest;
equal rows are turns of their own; no conversations: no nodes. A conversation's
digests and sizes are one row, so it must have fewer than some 50 million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relayspark.llm.common import materialize, shared_dir

#: Bytes of a turn's digest.
DIGEST = 16
#: Nodes of one shard (and one path more), positions of a block.
SHARD_NODES, BLOCK = 1 << 18, 64
#: Characters of joined ids in one row.
JOINED = 256 << 10

_LONGS = ("shard", "side", "depth", "conv_id", "parent_side", "parent_conv_id", "n", "bytes", "children", "leaves", "saved")
NODE = ", ".join([*(f"{c} long" for c in _LONGS), "key binary", "parent_key binary", "ends string"])
#: Sides of the spine: on both paths, on the first, on the last.
BOTH, FIRST, LAST = 0, 1, 2


def turn_paths(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, path, sizes): digests of the turns in order, bytes of their texts."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    # The role's length tells where the text begins.
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), F.left(F.sha2(whole, 256), F.lit(2 * DIGEST)).alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"),
    )
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("path"), F.col("t.size").alias("sizes"))


def rebuilt_paths(paths: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Paths whose first h turns are those of another conversation: for id c, of
    c - c % group; h is crc32 of the decimal id, modulo heads."""
    own = paths.select("*", (F.col("conv_id") - F.col("conv_id") % group).alias("of"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int").alias("h"))
    base = paths.select(F.col("conv_id").alias("of"), F.col("path").alias("of_path"), F.col("sizes").alias("of_sizes"))
    cut, rest = F.col("h") * DIGEST, F.greatest(F.size("sizes") - F.col("h"), F.lit(0))
    head = F.coalesce(F.substr("of_path", F.lit(1), cut), F.lit(b""))
    head_sizes = F.coalesce(F.slice("of_sizes", F.lit(1), F.col("h")), F.array().cast("array<bigint>"))
    return own.join(base, "of", "left").select(
        "conv_id",
        F.concat(head, F.substr("path", cut + 1, F.octet_length("path"))).alias("path"),
        F.concat(head_sizes, F.slice("sizes", F.col("h") + 1, rest)).alias("sizes"),
    )


# ---------------------------------------------------------------- ids at ends


def _joined(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Decimal ids of sorted (key, conv_id), comma-joined piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, first, held, size = ["key", "first", "ids"], None, None, [], 0

        def row():
            return pa.record_batch([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names)

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (k != key or size > limit):
                    yield row()
                    held, size = [], 0
                if not held:
                    key, first = k, c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield row()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come sorted."""
    keys, hashes, state = [], [], None

    def done():
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends"])

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if state is not None and k == keys[-1]:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                hashes.append(state.hexdigest())
            if len(keys) >= 65536:
                yield done()
                keys, hashes = [], []
            keys.append(k)
            state = hashlib.sha256(ids.encode())
    if state is not None:
        hashes.append(state.hexdigest())
        yield done()


def end_hashes(members: DataFrame, partitions: int) -> DataFrame:
    """(key, ends): hash of the ascending ids of each key's members."""
    pieces = members.select("key", "conv_id").repartitionByRange(partitions, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = pieces.mapInArrow(_joined(JOINED), "key binary, first long, ids string")
    return pieces.repartition(partitions, "key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends string")


# ------------------------------------------------------------ one shard's trie


def find_close(bits: np.ndarray, opens: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Closing positions of the opens: the first later position of less excess."""
    excess = np.cumsum(2 * bits.astype(np.int64) - 1)
    blocks = -(-len(bits) // block)
    size = 1 << max(blocks - 1, 0).bit_length()
    padded = np.full(size * block, np.iinfo(np.int64).max)
    padded[: len(bits)] = excess
    least = np.concatenate([np.zeros(size, np.int64), padded.reshape(size, block).min(axis=1)])
    for i in range(size.bit_length() - 2, -1, -1):
        level = slice(1 << i, 2 << i)
        least[level] = np.minimum(least[2 << i : 4 << i : 2], least[(2 << i) + 1 : 4 << i : 2])
    target = excess[opens] - 1
    out = np.full(len(opens), -1, np.int64)

    def scan(which: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Look through the rest of each one's block; returns those not found."""
        at = begin.copy()
        while len(which):
            hit = padded[at] == target[which]
            out[which[hit]] = at[hit]
            at += 1
            on = ~hit & (at % block != 0)
            ended = ~hit & ~on
            if ended.any():
                rest.append(which[ended])
            which, at = which[on], at[on]
        return np.concatenate(rest) if rest else which

    rest: list[np.ndarray] = []
    every = np.arange(len(opens))
    inside = (opens + 1) % block != 0
    rest.append(every[~inside])
    open_ = scan(every[inside], opens[inside] + 1)
    # The next block whose least excess is low enough: up, then down the tree.
    node, wanted = size + opens[open_] // block + 1, target[open_]
    while (high := least[node] > wanted).any():
        node = np.where(high, np.where(node & 1, (node + 1) >> 1, node + 1), node)
    while (inner := node < size).any():
        left = np.where(inner, 2 * node, node)
        node = np.where(inner & (least[left] > wanted), left + 1, left)
    rest.clear()
    scan(open_, (node - size) * block)
    return out


def _least_in(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least value in each range, by tables of doubled lengths."""
    tables = [values]
    while 2 << (len(tables) - 1) <= len(values):
        last, step = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(last[:-step], last[step:]))
    level = np.frexp((end - begin).astype(np.float64))[1] - 1
    out = np.empty(len(begin), values.dtype)
    for k, table in enumerate(tables):
        of = level == k
        out[of] = np.minimum(table[begin[of]], table[end[of] - (1 << k)])
    return out


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at the start, by halving."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * DIGEST] == b[: middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def _prefix_keys(path: bytes) -> list[bytes]:
    """Digest of each prefix, from the empty one on."""
    state = hashlib.sha256()
    keys = [state.digest()[:DIGEST]]
    for at in range(0, len(path), DIGEST):
        state.update(path[at : at + DIGEST])
        keys.append(state.copy().digest()[:DIGEST])
    return keys


def shard_nodes(shard: int, paths: list[bytes], shared: list[int], sizes: list[np.ndarray], n: list[int], least: list[int], ends: list[str]) -> dict[str, list | np.ndarray]:
    """Columns of a shard's nodes, in order of their opens. ``shared``: turns in
    common with the path before."""
    depths = np.array([len(p) // DIGEST for p in paths], np.int64)
    shared = np.array([0, *shared[1:]], np.int64)
    opening = depths - shared
    closing = np.concatenate([[0], depths[:-1] - shared[1:]])
    runs = np.stack([closing, opening], axis=1).ravel()
    steps = np.repeat(np.tile(np.array([0, 1], np.int8), len(paths)), runs)
    bits = np.concatenate([np.ones(1, np.int8), steps, np.zeros(depths[-1] + 1, np.int8)])
    opens = np.flatnonzero(bits)
    close = find_close(bits, opens)
    depth = np.cumsum(2 * bits.astype(np.int64) - 1)[opens] - 1
    count = len(opens)
    size = np.concatenate([np.zeros(1, np.int64), *(s[k:] for s, k in zip(sizes, shared))])
    # A node's parent is the last one of less depth that opened before it.
    order = np.lexsort((opens, depth))
    rank = depth[order] * (len(bits) + 1) + opens[order]
    parent = order[np.searchsorted(rank, (depth - 1) * (len(bits) + 1) + opens) - 1]
    parent[0] = -1

    last_open = np.cumsum(opening)
    ending = np.zeros(len(bits), np.int64)
    ending[opens[last_open]] = 1
    weight = np.zeros(len(bits), np.int64)
    weight[opens[last_open]] = n

    def within(values: np.ndarray) -> np.ndarray:
        """Sum of the values at each node's positions."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[close + 1] - total[opens]

    first_row = np.concatenate([[0], np.cumsum(ending)])[opens]
    members = within(weight)
    least_id = _least_in(np.array(least, np.int64), first_row, first_row + within(ending))

    side = np.full(count, -1, np.int64)
    side[: depths[0] + 1] = FIRST
    right, node = [], int(last_open[-1])
    while node >= 0:
        right.append(node)
        node = int(parent[node])
    side[right] = np.where(side[right] == FIRST, BOTH, LAST)

    spine = side >= 0
    leaf = np.zeros(len(bits), np.int64)
    leaf[opens] = (bits[opens + 1] == 0) & ~spine
    saved = np.zeros(len(bits), np.int64)
    saved[opens] = np.where(spine, 0, (members - 1) * size)
    children = np.bincount(parent[1:][~spine[1:]], minlength=count)
    keys: list[bytes | None] = [None] * count
    parent_keys: list[bytes | None] = [None] * count
    left = list(range(int(depths[0]) + 1))
    for path, nodes in ((paths[0], left), (paths[-1], right[::-1])):
        of = _prefix_keys(path)
        for d, v in enumerate(nodes):
            keys[v], parent_keys[v] = of[d], of[d - 1] if d else None
    at_end: list[str | None] = [None] * count
    for v, e in zip(last_open.tolist(), ends):
        at_end[v] = e
    parent_side = np.where(parent >= 0, side[parent], -1)
    parent_conv = pa.array(least_id[parent], mask=(parent_side >= 0) | (parent < 0))
    return {
        "shard": np.full(count, shard, np.int64), "side": side, "depth": depth, "conv_id": least_id, "parent_side": parent_side, "parent_conv_id": parent_conv,
        "n": members, "bytes": size, "children": children, "leaves": within(leaf), "saved": within(saved),
        "key": pa.array(keys, pa.binary()), "parent_key": pa.array(parent_keys, pa.binary()), "ends": pa.array(at_end, pa.string()),
    }


def _shards(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, nodes = TaskContext.get().partitionId() << 32, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            columns = shard_nodes(number, *map(list, zip(*held)))
            whole = pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns.values()], list(columns))
            for begin in range(0, whole.num_rows, 65536):
                yield whole.slice(begin, 65536)

        for batch in batches:
            names = ("path", "sizes", "n", "least", "ends")
            for path, sizes, n, least, ends in zip(*(batch.column(c) for c in names)):
                path = path.as_py()
                if nodes > limit:
                    yield from done()
                    number, held, nodes = number + 1, [], 0
                shared = _common(held[-1][0], path) if held else 0
                held.append((path, shared, sizes.values.to_numpy(zero_copy_only=False), n.as_py(), least.as_py(), ends.as_py()))
                nodes += len(path) // DIGEST - shared
        if held:
            yield from done()

    return run


# -------------------------------------------------------------- merged spines


def _merged(spine: DataFrame) -> DataFrame:
    """One row for each spine node over all shards, with what it adds itself."""
    once = spine.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"),
        F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n").alias("n_convs"),
        F.max("bytes").alias("bytes"),
        F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"),
        F.max("ends").alias("ends"),
        F.min("shard").alias("owner"),
    )
    below = once.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("on_spine"))
    whole = once.join(below, "key", "left").withColumn("n_children", F.col("children") + F.coalesce("on_spine", F.lit(0)))
    return materialize(
        whole.withColumn("own_leaf", (F.col("n_children") == 0).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("bytes"))
    )


def trie_nodes(paths: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, path, sizes): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    folder = shared_dir(spark, "prefix-trie")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = written(paths.select("conv_id", F.unhex(F.left(F.sha2("path", 256), F.lit(2 * DIGEST))).alias("key"), "path", "sizes"), "paths")
    once = keyed.groupBy("key").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    distinct = written(once.join(end_hashes(keyed, partitions), "key").drop("key"), "distinct")
    turns = distinct.agg(F.sum(F.size("sizes"))).first()[0] or 0
    shards = max(partitions, turns // (4 * SHARD_NODES) + 1)
    dealt = distinct.repartitionByRange(shards, "path").sortWithinPartitions("path")
    nodes = written(dealt.mapInArrow(_shards(SHARD_NODES), NODE), "nodes")

    spine = nodes.where("side >= 0")
    merged = _merged(spine)
    here = spine.select("shard", "side", "depth", "key").join(merged.select("key", "conv_id", "owner", "own_leaf", "own_saved"), "key")
    counted = lambda c: F.when(F.col("shard") == F.col("owner"), F.col(c)).otherwise(0)
    deeper = Window.orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    of_shard, of_side = deeper.partitionBy("shard"), deeper.partitionBy("shard", "side")
    along = lambda c: F.when(F.col("side") == BOTH, F.sum(counted(c)).over(of_shard)).otherwise(F.sum(counted(c)).over(of_side))
    added = here.select("key", along("own_leaf").alias("leaf_sum"), along("own_saved").alias("saved_sum"))
    added = added.groupBy("key").agg(F.sum("leaf_sum").alias("leaf_sum"), F.sum("saved_sum").alias("saved_sum"))
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))

    none = F.lit(hashlib.sha256(b"").hexdigest())
    on_spine = merged.join(added, "key").join(above, "parent_key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("leaf_sum")).alias("n_leaves"),
        (F.col("saved") + F.col("saved_sum")).alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"),
    )
    of_parent = here.select("shard", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("spine_conv_id"))
    off = nodes.where("side < 0").join(of_parent, ["shard", "parent_side", "depth"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "spine_conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"),
    )
    return on_spine.unionByName(off)
