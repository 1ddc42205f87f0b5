"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a run of documents of bounded size. Its words, written in the
alphabet of the benchmark's words, become one sequence; words that no benchmark
item has, and ends of documents, are separators, each sorting by its place. The
suffix array gives the Burrows-Wheeler transform, held in a wavelet matrix whose
bit levels answer rank queries. All windows of the benchmark are searched
backward at once; occurrences are located by walking to sampled suffix positions
and merged into spans of words to remove.

Benchmark windows go to the tasks in blocks of bounded size, one pass over the
documents for each block; spans of several blocks are merged per document.

Defined results: null texts and texts without words have no words and no hits;
items without words have no window; equal rows get equal results; items of one
id are one item; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayspark.llm.common import slices, split_words, word_codes

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Bytes of text in one shard's index.
SHARD_BYTES = 4 << 20
#: Every so many places of a shard, its suffix position is kept.
SAMPLE = 16
#: Benchmark words in one block that is sent to the tasks.
BLOCK_WORDS = 1_000_000


def _clean_bytes() -> np.ndarray:
    """A-Z lower-cased; bytes that are no part of a word become spaces."""
    table = np.full(256, 0x20, np.uint8)
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        table[lo:hi] = np.arange(lo, hi)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_CLEAN = _clean_bytes()


def item_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased texts: (words, row of each)."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = _CLEAN[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(body))
    return split_words(clean)


class Phrases:
    """Distinct windows of a block of benchmark items, as symbols from 1 on."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        words, rows = item_words(pa.array([t for _, t in items], pa.string()))
        self.words, codes = word_codes(words)
        ids = np.array([i for i, _ in items], np.int64)
        of: dict[tuple[int, ...], set[int]] = {}
        first = np.searchsorted(rows, np.arange(len(items) + 1))
        symbols = (codes + 1).tolist()
        for item, a, b in zip(ids.tolist(), first[:-1].tolist(), first[1:].tolist()):
            for at in range(a, max(b - window, a) + 1 if b > a else a):
                of.setdefault(tuple(symbols[at : min(at + window, b)]), set()).add(item)
        self.length = np.array([len(p) for p in of], np.int64)
        self.symbols = np.zeros((len(of), window), np.int64)  # right-aligned
        for i, p in enumerate(of):
            self.symbols[i, window - len(p) :] = p
        self.items = [np.array(sorted(x), np.int64) for x in of.values()]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of symbols in order; every 0 is a separator of its
    own, sorting by place before all symbols. Doubles the sorted depth, and
    sorts only what is still tied."""
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    rank = np.zeros(n + 1, np.int64)
    rank[zeros] = np.arange(len(zeros))
    own = np.flatnonzero(text)
    rank[own] = text[own] + len(zeros)
    width = int(rank.max(initial=1)).bit_length()
    depth = 63 // width
    key = np.zeros(len(own), np.int64)
    for k in range(depth):
        key = (key << width) | rank[np.minimum(own + k, n)]
    order = np.argsort(key)
    own, key = own[order], key[order]
    order = np.empty(n, np.int64)
    order[: len(zeros)], order[len(zeros) :] = zeros, own
    fresh = np.ones(n, bool)
    fresh[len(zeros) + 1 :] = key[1:] != key[:-1]
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = place
    while True:
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        if not len(tied):
            return order
        at = order[tied]
        group, then = rank[at], rank[np.minimum(at + depth, n)]
        by = np.lexsort((then, group))
        at, group, then = at[by], group[by], then[by]
        order[tied] = at
        fresh[tied] = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[at] = place[tied]
        depth *= 2


class BitRank:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))[:-1]])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Symbols with rank of any symbol before any place, a bit level at a time."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels, self.zeros = [], []
        self.shifts = list(range(max(int(most).bit_length(), 1) - 1, -1, -1))
        for shift in self.shifts:
            bits = (symbols >> shift) & 1
            self.levels.append(BitRank(bits))
            zero = bits == 0
            self.zeros.append(int(zero.sum()))
            symbols = np.concatenate([symbols[zero], symbols[~zero]])

    def _down(self, level: int, bit: np.ndarray, i: np.ndarray) -> np.ndarray:
        ones = self.levels[level].ones(i)
        return np.where(bit, self.zeros[level] + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for level, shift in enumerate(self.shifts):
            bit = ((symbol >> shift) & 1) == 1
            start, i = self._down(level, bit, start), self._down(level, bit, i)
        return i - start

    def symbol(self, i: np.ndarray) -> np.ndarray:
        found = np.zeros_like(i)
        for level in range(len(self.shifts)):
            bit = self.levels[level].bit(i).astype(np.int64)
            found = (found << 1) | bit
            i = self._down(level, bit == 1, i)
        return found


class FMIndex:
    """Backward search and location in one shard's sequence of symbols."""

    def __init__(self, text: np.ndarray, most: int):
        order = suffix_array(text)
        self.before = np.where(order > 0, text[order - 1], 0)  # the transform
        self.tree = WaveletMatrix(self.before, most)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        # Kept: every SAMPLE-th place, and places after a separator, where a walk can't go on.
        kept = (order % SAMPLE == 0) | (self.before == 0)
        self.kept, self.places = BitRank(kept), order[kept]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row after the last) of the phrases that occur."""
        which = np.arange(len(phrases.length))
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(self.before), np.int64)
        done = []
        for step in range(phrases.symbols.shape[1]):
            ended = phrases.length[which] == step
            done.append((which[ended], lo[ended], hi[ended]))
            which, lo, hi = which[~ended], lo[~ended], hi[~ended]
            c = phrases.symbols[which, phrases.symbols.shape[1] - 1 - step]
            lo, hi = self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
        done.append((which, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the sequence of each row's suffix."""
        out, steps, left = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(left):
            at = self.kept.bit(rows) == 1
            out[left[at]] = self.places[self.kept.ones(rows[at])] + steps[left[at]]
            left, rows = left[~at], rows[~at]
            steps[left] += 1
            c = self.tree.symbol(rows)
            rows = self.first[c] + self.tree.rank(c, rows)
        return out


def occurrences(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, words of each text, first word and length of
    each occurrence, its phrase) in a shard of texts; words count on through the shard."""
    words, rows = item_words(texts)
    n_words = np.bincount(rows, minlength=len(texts))
    begin = np.cumsum(n_words) - n_words
    none = np.zeros(0, np.int64)
    if not len(words) or not len(phrases.length):
        return begin, n_words, none, none, none
    distinct, codes = word_codes(words)
    symbol = pc.fill_null(pc.add(pc.cast(pc.index_in(distinct, value_set=phrases.words), pa.int64()), 1), 0).to_numpy(zero_copy_only=False)[codes]
    # A separator before each text; runs of separators shrink to one.
    ends = begin[(begin > 0) & (begin < len(symbol))]
    ends = np.unique(ends)
    text, place = np.insert(symbol, ends, 0), np.insert(np.arange(len(symbol)), ends, -1)
    text, place = np.concatenate([[0], text, [0]]), np.concatenate([[-1], place, [-1]])
    keep = (text != 0) | np.concatenate([[True], text[:-1] != 0])
    text, place = text[keep], place[keep]
    index = FMIndex(text, len(phrases.words))
    which, lo, hi = index.search(phrases)
    n = hi - lo
    rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    found = np.repeat(which, n)
    return begin, n_words, place[index.locate(rows)], phrases.length[found], found


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _scan(sent):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for batch in batches:
            for part in slices(batch, "text", SHARD_BYTES):
                begin, n_words, start, length, found = occurrences(part.column("text"), phrases)
                total = int(n_words.sum())
                change = np.bincount(start, minlength=total + 1) - np.bincount(start + length, minlength=total + 1)
                hit = np.cumsum(change)[:total] > 0
                row_of = np.repeat(np.arange(len(n_words)), n_words)
                # Merged spans: runs of hit words within a text.
                edge = np.ones(total, bool)
                edge[1:] = row_of[1:] != row_of[:-1]
                opens = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
                closes = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False))) + 1
                span_row = row_of[opens] if total else np.zeros(0, np.int64)
                spans = pa.StructArray.from_arrays([pa.array(opens - begin[span_row]), pa.array(closes - begin[span_row])], names=["start", "end"])
                span_ends = np.concatenate([[0], np.cumsum(np.bincount(span_row, minlength=len(n_words)))]).astype(np.int32)
                pairs = np.unique(np.stack([row_of[start], found], 1), axis=0) if len(found) else np.zeros((0, 2), np.int64)
                items = [np.zeros(0, np.int64)] * len(n_words)
                for row in np.unique(pairs[:, 0]):
                    items[row] = np.unique(np.concatenate([phrases.items[p] for p in pairs[pairs[:, 0] == row, 1]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("text_hash"),
                        pa.array(n_words.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(span_ends), spans),
                        pa.array(items, pa.list_(pa.int64())),
                    ],
                    names=["id", "text_hash", "n_words", "spans", "items"],
                )

    return scan


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, in turn."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("item is not null and text is not null")
    for r in rows.toLocalIterator():
        block.append((r["item"], r["text"]))
        size += len(r["text"]) // 4 + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _merged(spans_col: str):
    """Overlapping and touching spans as one."""
    state = f"struct<out:{_SPANS},last:struct<start:bigint,end:bigint>>"
    none = F.lit(None).cast("struct<start:bigint,end:bigint>")
    begin = F.struct(F.array().cast(_SPANS).alias("out"), none.alias("last")).cast(state)

    def step(acc, s):
        joins = acc["last"]["end"] >= s["start"]
        wider = F.struct(acc["last"]["start"].alias("start"), F.greatest(acc["last"]["end"], s["end"]).alias("end"))
        out = F.when(acc["last"].isNull() | joins, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"])))
        return F.struct(out.alias("out"), F.when(joins, wider).otherwise(s).alias("last")).cast(state)

    return F.aggregate(F.array_sort(spans_col), begin, step, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"]))))


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per document: id, text_hash (xxhash64), n_words, n_hit, n_items, items (ids, in order), spans
    (of words to remove: start, end exclusive), contaminated (n_hit > 0 and
    20 * n_hit >= n_words)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("text_hash"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text_hash long, n_words long, spans {_SPANS}, items array<bigint>"
    passes = [rows.mapInArrow(_scan(spark.sparkContext.broadcast(Phrases(block))), schema) for block in _item_blocks(benchmark, item_col, item_text_col)]
    if not passes:
        passes = [rows.mapInArrow(_scan(spark.sparkContext.broadcast(Phrases([]))), schema)]
    found = passes[0]
    if len(passes) > 1:
        # Equal rows of several passes meet: as many of each as one pass has.
        for more in passes[1:]:
            found = found.union(more)
        found = found.groupBy("id", "text_hash", "n_words").agg(
            _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.array_repeat(F.lit(0), (F.count("*") / len(passes)).cast("int")).alias("copies"),
        )
        found = found.withColumn("copy", F.explode("copies")).drop("copy", "copies")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.select("id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sort_array("items").alias("items"), "spans")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed("id", id_col)
