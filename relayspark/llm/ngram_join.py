"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly.

Two sets link when ``100 * intersection >= share * union``. What is compared:

1. Equal sets are one class; from here on, a class is one node.
2. Prefix filter. All shingles have one fixed order, rare ones first (by a table
   of counts of hashed shingles; any order is right, this one keeps groups
   small). Two sets that link share a shingle among the first
   ``n - ceil(share * n) + 1`` of each, so nodes are grouped by these. The first
   shingle that two sets share bounds their overlap by what each has from there
   on; a pair counts only in groups where that is enough.
3. Candidates. A group of at most SMALL members gives all its pairs that sizes
   allow. In larger groups, members are cut into size bands (only sets of one
   band or of neighbouring ones can link), and each node is first tried with a
   leader of its own and of the next band: the one with the most left from the
   shingle on, which of many copies is the least changed. Parity bitmaps of
   hashed shingles bound the overlap of every pair from above: differing bits are
   at most the symmetric difference. Who passes is compared exactly, by
   intersection of sorted arrays; first each node with its closest candidate,
   then whatever pairs still join two components.
4. Tiles. Large groups that still hold several components are compared in full, in
   tiles of two blocks of neighbouring size bands: nodes outside the group's
   largest component against all, by bitmap and then exactly. Links within a
   component can't change the result, so every link between components is found,
   while a group of thousands of near copies costs about one comparison for each.

A shingle that very many sets hold is spread over several buckets, and its parts
meet through their least nodes; no task gathers all of such a group.

Shingles, and the 128 bits that name a set, are hashes (64 bits each for a
shingle); nothing else is approximate.

Defined results: null texts, empty texts and texts without words have an empty
set, link with nothing and are their own component; equal rows share a component;
rows of one id but other texts are compared each, and rows without an id like all
others; a component without any id has a null name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayspark.llm.common import shared_dir, slices, split_words, word_codes

SHINGLE_WORDS, SHARE = 5, 75
#: Cells of the table of counts (a byte each when sent to the tasks).
CELLS = 1 << 21
#: Prefix shingles in a bucket, about.
BUCKET_KEYS = 800_000
#: Holders of a shingle from which it is spread over buckets, and how far above the mean count.
HOT_HOLDERS, HOT_TIMES = 2048, 16
#: Words (of 64 bits) of a bitmap at least and at most; between, it has a bit or
#: more for each shingle, so that it bounds the overlap of long texts, too.
BITMAP_WORDS, BITMAP_MOST = 16, 2048
#: Members of a group whose pairs are all tried.
SMALL = 12
#: Partners of a node whose sets meet in one task.
PARTNERS = 256
#: Members of a group in one block when compared in full.
BLOCK = 2048
#: Ids that are sent to all tasks at most, to pick the texts that are compared.
SENT_IDS = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array, words_each: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the texts' shingles with repetitions, row of each). A text of
    fewer words has one shingle, of all its words."""
    words, rows = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, codes = word_codes(words)
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()], np.uint64)[codes]
    n = np.bincount(rows, minlength=len(texts))
    first = np.cumsum(n) - n
    length = np.minimum(n, words_each)
    last = np.maximum(n - words_each, 0)  # last start within the text
    place = np.arange(len(rows)) - first[rows]
    start = np.flatnonzero(place <= last[rows])
    of = rows[start]
    h = length[of].astype(np.uint64)
    for k in range(words_each):
        inside = k < length[of]
        h = np.where(inside, _mix(h * _ODD + hashed[np.minimum(start + k, len(hashed) - 1)]), h)
    return h, of


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text."""
    h, of = shingles(texts)
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1], ends[1:]):
        yield np.unique(h[a:b])


def set_name(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % CELLS


def _counts(texts: DataFrame) -> np.ndarray:
    """Shingles of all texts per cell: counted by task, added up by part of the table."""
    parts = 64
    size = CELLS // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(_cells(shingles(part.column("text"))[0]), minlength=CELLS)
        if total.any():
            blobs = [total[i * size : (i + 1) * size].astype("<i4").tobytes() for i in range(parts)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "counts": pa.array(blobs, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts")):
                sums[part] = sums.get(part, np.zeros(size, np.int64)) + np.frombuffer(blob.as_buffer(), "<i4")
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    schema = "part int, counts binary"
    added = texts.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    out = np.zeros(CELLS, np.int64)
    for r in added.collect():  # a table of fixed size
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["counts"], "<i8")
    return out


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Order of cells from rare to frequent, in a byte: steps of one standard
    deviation of the cells' chance load, then eighths of a doubling. A shingle
    stands out as soon as its own count does from that noise, so prefixes stay
    rare however many shingles share the table."""
    mean = counts.mean()
    z = np.maximum((counts - mean) / np.sqrt(mean + 1), 0)
    return np.minimum(np.where(z < 64, z, 64 + 8 * np.log2(np.maximum(z, 64) / 64)), 255).astype(np.uint8)


def prefix(s: np.ndarray, ranks: np.ndarray, share: int) -> np.ndarray:
    """The first shingles of a set, rare cells first, that a linked set must meet."""
    n = len(s)
    order = np.argsort(ranks[_cells(s)], kind="stable")
    return s[order[: n - (share * n + 99) // 100 + 1]]


def _sets(sent, share: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value[0]
        for batch in batches:
            for part in slices(batch, "text"):
                n, names, keys, bits = [], [], [], []
                for s in shingle_sets(part.column("text")):
                    n.append(len(s))
                    names.append(set_name(s) if len(s) else None)
                    keys.append(prefix(s, ranks, share).tobytes() if len(s) else None)
                    bits.append(bitmap(s).tobytes() if len(s) else None)
                blobs = [pa.array(x, pa.binary()) for x in (names, keys, bits)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(n, pa.int64()), *blobs], names=["id", "text_hash", "n", "name", "keys", "bits"])

    return sets


def _band(n: np.ndarray, share: int) -> np.ndarray:
    """Size bands: sets of linked documents are in one band or in neighbours."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / share) + 1e-9).astype(np.int64)


_DEALT = {"keys": np.uint64, "nodes": np.int64, "sizes": np.int32, "places": np.int32}


def _to_buckets(sent, buckets: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = sent.value[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            count = pc.binary_length(batch.column("keys")).to_numpy(zero_copy_only=False) // 8
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint64)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), count)
            size = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), count)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
            salt = _mix(node.astype(np.uint64)) & ((np.uint64(1) << salts[_cells(keys)].astype(np.uint64)) - np.uint64(1))
            bucket = (_mix(keys + salt * _ODD) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(ends))
            columns = {c: x[order].astype(kind) for (c, kind), x in zip(_DEALT.items(), (keys, node, size, place))}
            blobs = {c: pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary()) for c, x in columns.items()}
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), **blobs})

    return spread


_FOUND = "kind string, a binary, b binary, c binary"
_FOUND_ROWS = 1 << 15


def _packed(kind: str, *columns: np.ndarray) -> Iterator[dict]:
    """Rows of three numbers each, many to a row."""
    for i in range(0, len(columns[0]), _FOUND_ROWS):
        yield {"kind": kind, **{c: x[i : i + _FOUND_ROWS].astype("<i8").tobytes() for c, x in zip("abc", columns)}}


def _all_pairs(count: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within the chosen ones of groups that lie end to end."""
    begin = np.cumsum(count) - count
    x, y = [], []
    for n in np.unique(count[which]):
        i, j = np.triu_indices(n, 1)
        at = begin[which & (count == n)]
        x.append((at[:, None] + i).ravel())
        y.append((at[:, None] + j).ravel())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *x]), np.concatenate([none, *y])


def _group_bucket(sent, share: int):
    def group(table: pa.Table) -> pa.Table:
        """Groups of one bucket: pairs to try (two nodes, most overlap); of large
        groups, the members (group, node, shingles left from this one on);
        leaders of spread groups."""
        salts = sent.value[1]
        keys, node, size, place = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in _DEALT.items())
        left = size - place
        band = _band(size, share)
        order = np.lexsort((node, -left, band, keys))
        keys, node, size, left, band = (x[order].astype(x.dtype if x is keys else np.int64) for x in (keys, node, size, left, band))
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(begin, len(keys)))
        hot = salts[_cells(keys[begin])] > 0
        name = np.add.reduceat(_mix(node.astype(np.uint64)), begin)
        # Of groups of equal members, the one of the earliest shingle counts.
        early = np.lexsort((-np.add.reduceat(left, begin), name))
        once = np.zeros(len(begin), bool)
        once[early[np.concatenate([[True], name[early][1:] != name[early][:-1]])]] = True
        keep = hot | (once & (count > 1))
        name = np.where(hot, keys[begin], name).view(np.int64)
        rows, of = np.repeat(keep, count), np.repeat(np.arange(len(begin)), count)
        node, size, left, band, of = node[rows], size[rows], left[rows], band[rows], of[rows]
        kept, hot = count[keep], hot[keep]
        small = (kept <= SMALL) & ~hot
        out: list[dict] = []
        if len(node):
            x, y = _all_pairs(kept, small)
            large = ~np.repeat(small, kept)
            first = np.concatenate([[True], (of[1:] != of[:-1]) | (band[1:] != band[:-1])])
            starts, run = np.flatnonzero(first), np.cumsum(first) - 1
            after = np.append(starts[1:], 0)
            near = (of[after] == of[starts]) & (band[after] == band[starts] + 1)
            next_to = np.flatnonzero(near[run] & large)
            x = np.concatenate([x, np.flatnonzero(large), next_to])
            y = np.concatenate([y, starts[run[large]], after[run[next_to]]])
            most = np.minimum(left[x], left[y])
            fits = (x != y) & (100 * most >= share * (size[x] + size[y] - most))
            x, y, most = x[fits], y[fits], most[fits]
            pairs = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), -most], 1), axis=0)
            once = np.ones(len(pairs), bool)
            once[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(1)
            out += [*_packed("pair", *pairs[once].T), *_packed("member", name[of][large], node[large], left[large])]
            lead = np.repeat(hot, kept) & first
            out += _packed("leader", name[of][lead], node[lead], left[lead])
        return pa.Table.from_pylist(out, schema=pa.schema([("kind", pa.string()), *((c, pa.binary()) for c in "abc")]))

    return group


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in "abc")):
            yield pa.RecordBatch.from_pydict({c: pa.array(np.frombuffer(x, "<i8")) for c, x in zip("abc", row)})


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles at each hashed bit."""
    words = BITMAP_WORDS
    while 64 * words < len(s) and words < BITMAP_MOST:
        words *= 2
    bits = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each) of fewer words: a set's parities at the lower bits."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def _differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Differing bits of pairs of bitmaps, in the smaller one's size."""
    out = np.zeros(len(a), np.int64)
    size = np.array([(len(x) // 8, len(y) // 8) for x, y in zip(a, b)]).reshape(-1, 2)
    for p, q in np.unique(size, axis=0):
        at = np.flatnonzero((size[:, 0] == p) & (size[:, 1] == q))
        x, y = (folded(np.frombuffer(b"".join(side[i] for i in at), np.uint64).reshape(len(at), -1), min(p, q)) for side in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(1)
    return out


def may_link(n: np.ndarray, m: np.ndarray, differing: np.ndarray, share: int, most: np.ndarray) -> np.ndarray:
    """Whether sizes, a bound of the overlap and differing bits allow a link: the
    overlap is at most half of what the sizes have beyond the differing bits."""
    most = np.minimum((n + m - differing) // 2, most)
    return 100 * most >= share * (n + m - most)


def _bounded(share: int):
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            differing = _differing(batch.column("a_bits").to_pylist(), batch.column("b_bits").to_pylist())
            n, m, most = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a_n", "b_n", "most"))
            fits = pa.array(may_link(n, m, differing, share, most))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(differing)], names=["a", "b", "differing"]).filter(fits)

    return bound


def _close(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """(a, b, differing) of the pairs (a, b, most) that bitmaps allow."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits")), side)
    return pairs.mapInArrow(_bounded(share), "a long, b long, differing long")


_MEET = "a long, salt int, lead boolean, node long, shingles binary"


def _met_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts that carry the set name they were picked for."""
    for batch in batches:
        for part in slices(batch, "text"):
            sets = list(shingle_sets(part.column("text")))
            at = [i for i, (s, name) in enumerate(zip(sets, part.column("name").to_pylist())) if len(s) and set_name(s) == name]
            held = part.select(["a", "salt", "lead", "node"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([sets[i].tobytes() for i in at], pa.binary())], names=["a", "salt", "lead", "node", "shingles"])


def _intersect(share: int):
    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows, each set's exact overlap with the lead set before it."""
        lead, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("a", "salt", "lead", "node", "shingles")]
            for a, salt, is_lead, node, blob in zip(*columns):
                s = np.frombuffer(blob, np.uint64)
                if is_lead:
                    lead, held = (a, salt), s
                elif lead == (a, salt):
                    both = len(np.intersect1d(held, s, assume_unique=True))
                    if 100 * both >= share * (len(held) + len(s) - both):
                        found.append((a, node))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return intersect


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again: in as few tasks as its
    bytes need (a checkpoint: in as many as wrote it, empty ones, too), and of known
    size to joins. The driver keeps less of so many small jobs."""
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by exact intersection of sorted arrays.

    The sets of a node's partners meet its own in one task; a node of many
    partners meets them in several. Only texts of the pairs are read into sets.
    """
    spark = nodes.sparkSession
    pairs = _written(spark, pairs.select("a", "b").distinct(), "linked-pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    leads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("lead"), F.col("a").alias("node"))
    partners = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.lit(False).alias("lead"), F.col("b").alias("node"))
    first = nodes.select("node", "name", F.col("least.id").alias("of_id"), F.col("least.text_hash").alias("of_text"))
    wanted = _written(spark, leads.union(partners).join(first, "node"), "linked-sets")
    named = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_text"))
    picked = texts.join(F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted, named).select("a", "salt", "lead", "node", "name", "text")
    met = picked.mapInArrow(_met_sets, _MEET).repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("lead"))
    return _written(spark, met.mapInArrow(_intersect(share), "a long, b long").distinct(), "links")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose nodes are in two components."""
    for side in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")), side, "left")
    return pairs.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that links reach. Every node takes the least
    label around it and then its label's own label, until nothing changes."""
    spark, links = links.sparkSession, links.select("a", "b").where("a <> b")
    both = _written(spark, links.union(links.select("b", "a")).distinct(), "component-links")
    labels = _written(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "component-labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = _written(spark, step.join(jump, "next").select("node", "label", F.least("next", "far").alias("next")), "component-labels")
        changed = after.where("next <> label").limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, label) after more links: only the components that they join are
    labelled anew, each by its least node."""
    every = labels.union(more.select("a", "a")).union(more.select("b", "b")).groupBy("node").agg(F.min("label").alias("label"))
    joined = more
    for side in ("a", "b"):
        joined = joined.join(every.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")), side)
    anew = components(joined.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    anew = anew.select(F.col("node").alias("label"), F.col("label").alias("least"))
    return every.join(anew, "label", "left").select("node", F.coalesce("least", "label").alias("label"))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _compare_tiles(share: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a tile's two blocks, of other components, that what is left
        and the bitmaps allow."""
        for table in _runs(batches, _TILE):
            node, label, n, left = (table.column(c).to_numpy() for c in ("node", "label", "n", "left"))
            outer = table.column("outer").to_numpy(zero_copy_only=False)
            blobs = table.column("bits").to_pylist()
            words = min(map(len, blobs)) // 8
            bits = np.concatenate([folded(np.frombuffer(x, np.uint64)[None], words) for x in blobs])
            one, other = np.flatnonzero(outer), np.flatnonzero(~outer)
            for begin in range(0, len(one), 32):
                i = one[begin : begin + 32]
                differing = np.zeros((len(i), len(other)), np.int64)
                for w in range(words):
                    differing += np.bitwise_count(bits[i, w][:, None] ^ bits[other, w][None, :])
                most = np.minimum(left[i][:, None], left[other][None, :])
                fits = (label[i][:, None] != label[other][None, :]) & may_link(n[i][:, None], n[other][None, :], differing, share, most)
                x, y = np.nonzero(fits)
                a, b = node[i[x]], node[other[y]]
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return compare


_TILE = ["name", "outer_band", "outer_block", "band", "block"]


def _rest(members: DataFrame, labels: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """Pairs left to compare: members of one group, of several components."""
    labelled = members.join(labels, "node", "left").select("name", "node", "left", F.coalesce("label", "node").alias("label"))
    several = labelled.groupBy("name").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("name")
    rows = labelled.join(several, "name").groupBy("name", "node").agg(F.max("left").alias("left"), F.first("label").alias("label"))
    rows = rows.join(nodes.select("node", "n", "bits"), "node").withColumn("band", F.floor(F.ln("n") / float(np.log(100 / share)) + 1e-9).cast("int"))
    rows = _written(nodes.sparkSession, rows, "group-members")
    largest = rows.groupBy("name", "label").agg(F.count("*").alias("k")).groupBy("name").agg(F.max_by("label", F.struct("k", "label")).alias("largest"))
    sized = rows.join(largest, "name").groupBy("name", "largest", "band").agg(F.count("*").alias("k"), F.count_if(F.col("label") != F.col("largest")).alias("k_outer"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    # A map of size bands: as many as powers of 100 / share up to a set's size.
    plan = sized.groupBy("name", "largest").agg(
        F.map_from_entries(F.collect_list(F.struct("band", blocks("k")))).alias("blocks"),
        F.map_from_entries(F.collect_list(F.struct("band", blocks("k_outer")))).alias("outer_blocks"),
    )
    rows = rows.join(plan, "name")
    own = F.col("band")
    in_block = lambda m: F.pmod(F.xxhash64("node"), F.greatest(F.element_at(m, own), F.lit(1))).cast("int")
    near = F.explode(F.sequence(own - 1, own + 1))
    count = lambda m: F.coalesce(F.element_at(m, F.col("near")), F.lit(0))
    facing = lambda m: F.explode(F.when(count(m) > 0, F.sequence(F.lit(0), count(m) - 1)))
    data = ["name", "node", "label", "n", "left", "bits"]
    outer = rows.where("label <> largest").select("*", near.alias("near")).select(
        *data, own.alias("outer_band"), in_block("outer_blocks").alias("outer_block"), F.col("near").alias("band"), facing("blocks").alias("block"), F.lit(True).alias("outer")
    )
    every = rows.select("*", near.alias("near")).select(
        *data, F.col("near").alias("outer_band"), facing("outer_blocks").alias("outer_block"), own.alias("band"), in_block("blocks").alias("block"), F.lit(False).alias("outer")
    )
    dealt = outer.union(every.select(outer.columns)).repartition(*_TILE).sortWithinPartitions(*_TILE)
    return dealt.mapInArrow(_compare_tiles(share), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """(id, n_shingles, component_id, text_hash, component_hash) for each row: the
    set's size and the smallest id that links reach, the row's own included; the
    hash (xxhash64) of its text and that of the component's first row by id (rows
    without an id last) and hash, whose id is component_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))

    counts = _counts(texts)
    ranks = _ranks(counts)
    salts = np.log2(np.maximum(counts / max(HOT_HOLDERS, HOT_TIMES * counts.mean()), 1)).astype(np.uint8)
    sent = spark.sparkContext.broadcast((ranks, salts))

    rows = _written(spark, hashed.mapInArrow(_sets(sent, share), f"id {kind}, text_hash long, n long, name binary, keys binary, bits binary"), "shingle-sets")
    classes = rows.where("name is not null").groupBy("name").agg(F.min(F.struct(F.isnull("id").alias("unnamed"), "id", "text_hash")).alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = _written(spark, classes.select(F.monotonically_increasing_id().alias("node"), "name", "least", "n", "bits"), "shingle-classes")

    keys = rows.where("name is not null").groupBy("name").agg(F.first("keys").alias("keys")).join(nodes.drop("bits"), "name")
    total = rows.agg(F.sum(F.floor(F.octet_length("keys") / 8))).first()[0] or 0
    buckets = int(total // BUCKET_KEYS) + 1
    dealt = keys.select("node", "n", "keys").mapInArrow(_to_buckets(sent, buckets), "bucket int, keys binary, nodes binary, sizes binary, places binary")
    found = _written(spark, dealt.groupBy("bucket").applyInArrow(_group_bucket(sent, share), _FOUND), "shingle-groups")
    unpacked = lambda k: found.where(F.col("kind") == k).mapInArrow(_unpack, "a long, b long, c long")
    members = unpacked("member").toDF("name", "node", "left")
    leaders = unpacked("leader").toDF("name", "node", "left")
    lead = leaders.groupBy("name").agg(F.max_by("node", F.struct("left", -F.col("node"))).alias("lead"), F.max("left").alias("most"))
    across = leaders.join(lead, "name").where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"), F.col("left").alias("most"))
    pairs = unpacked("pair").select("a", "b", (-F.col("c")).alias("most")).union(across).groupBy("a", "b").agg(F.max("most").alias("most"))

    close = _written(spark, _close(pairs, nodes, share), "close-pairs")
    both = close.union(close.select("b", "a", "differing")).toDF("node", "partner", "differing")
    closest = both.groupBy("node").agg(F.min_by("partner", F.struct("differing", "partner")).alias("partner"))
    links = _linked(closest.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")), nodes, hashed, share)
    labels = components(links)
    # What both rounds find is put together once: few jobs, little for the driver to keep.
    apart = _apart(close, labels).union(_rest(members, labels, nodes, share))
    more = _linked(apart, nodes, hashed, share)
    if more.limit(1).count():
        labels = _merged(labels, more)

    joined = nodes.join(labels, "node", "left").select("name", "least", F.coalesce("label", "node").alias("label"))
    named = joined.join(joined.groupBy("label").agg(F.min("least").alias("first")), "label").select("name", "first")
    own = F.col("first").isNull()
    return rows.join(named, "name", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(own, F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        "text_hash",
        F.when(own, F.col("text_hash")).otherwise(F.col("first.text_hash")).alias("component_hash"),
    )
