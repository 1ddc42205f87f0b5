"""Filter interaction audit: what each filter removes in each order of filters.

Four filters judge a text by itself; the fifth fails every row whose text a row
of a smaller id has, too. It needs whole texts to meet, by radix tries:

1. Every input partition puts its texts into tries of bounded size. A terminal
   holds the least id of its text, so rows of greater ids are settled at once and
   one row of each text (and id) of a trie goes on: a group of copies shrinks
   before it is shuffled.
2. What goes on is range-partitioned by adaptive prefixes: the first 8 bytes of a
   text, or twice as many for as long as the texts with that prefix make up
   more than a share of a partition. Heavy prefixes are found by one aggregation
   over all distinct texts, as hashes of the prefixes of each doubled length.
3. A partition's texts come sorted and go into tries of bounded size again; texts
   that are equal are neighbours, so no trie ends between them. Each trie is
   traversed, and rows above the least id of their terminal fail.

A row then is a mask of five bits. Masks are counted per part and label, and the
audit of all orders comes from these counts: at most 32 rows a part.

Defined results: a null text counts as empty, a null part as the empty string;
rows without an id have no label, never fail as copies and make no other row
fail; rows of one id with one text aren't copies of each other; of several label
rows of an id, a flag holds if any of them has it; no rows: no result rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.llm.common import shared_dir, slices

FILTERS = "ABCDE"

#: Bytes of distinct text in one trie.
TRIE_BYTES = 16 << 20
#: Bytes of the shortest prefix.
PREFIX_BYTES = 8
#: Bytes of text a partition should hold, and cells it should consist of at least.
PARTITION_BYTES, CELLS = 128 << 20, 4


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself (bit i: letter i)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    fails = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        F.rlike(text, F.lit(r"[#$%&*|]")),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


class TextTrie:
    """Compressed trie of texts (bytes). A node is [label, children by first
    byte, terminal]; a terminal is [a text's place, least id, rows of that id]."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.held = 0

    def terminal(self, text: bytes, place: int) -> list:
        """The terminal of a text, made where there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                node, at = child, len(text)
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = _shared(label, text, at)
            upper = node[1][text[at]] = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node, at = upper, at + shared
        if node[2] is None:
            node[2] = [place, None, {}]
            self.held += len(text) + 200
        return node[2]

    def terminals(self) -> Iterator[list]:
        """Depth first, children in the order of their first insertion."""
        stack = [self.root]
        while stack:
            _, children, end = stack.pop()
            if end is not None:
                yield end
            stack.extend(reversed(children.values()))


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common start of label and text from at, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def _add(trie: TextTrie, text: bytes, place: int, key, part: str, mask: int, n: int) -> list[tuple]:
    """Put a row at its text's terminal, which holds rows of the least id alone.
    Returns the rows above it: they fail whatever comes."""
    end = trie.terminal(text, place)
    if end[1] is not None and key > end[1]:
        return [(key, part, mask | 16, n, None)]
    above = []
    if end[1] is not None and key < end[1]:
        above = [(end[1], p, m | 16, k, None) for (p, m), k in end[2].items()]
        end[2] = {}
    end[1] = key
    end[2][part, mask] = end[2].get((part, mask), 0) + n
    return above


def _batches(rows: list[tuple], schema: pa.Schema, limit: int) -> tuple[list[pa.RecordBatch], list[tuple]]:
    """Rows as one batch when there are enough of them, and those left."""
    if len(rows) < limit:
        return [], rows
    return [pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)], []


def _combined(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, part, mask, n, text) of tries over a partition: settled rows
    without a text, and rows of each text's least id with it."""
    schema = pa.schema([("id", kind), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.string())])

    def least(trie: TextTrie, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for place, key, rows in trie.terminals():
            text = texts[place].decode()
            out += [(key, part, mask, n, text) for (part, mask), n in rows.items()]
            size += (len(text) + 60) * len(rows)
            done, out = _batches(out, schema, 1 if size > 4 << 20 else len(out) + 1)
            size = 0 if done else size
            yield from done
        yield from _batches(out, schema, 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, texts, settled = TextTrie(), [], []
        for whole in batches:
            for batch in slices(whole, "text"):
                raw = batch.column("text").cast(pa.binary()).to_pylist()
                for text, key, part, mask in zip(raw, *(batch.column(c).to_pylist() for c in ("id", "part", "mask"))):
                    if key is None:
                        settled.append((key, part, mask, 1, None))
                        continue
                    before = trie.held
                    settled += _add(trie, text, len(texts), key, part, mask, 1)
                    if trie.held > before:
                        texts.append(text)
                done, settled = _batches(settled, schema, 65536)
                yield from done
                if trie.held > TRIE_BYTES:
                    yield from least(trie, texts)
                    trie, texts = TextTrie(), []
        yield from least(trie, texts)
        yield from _batches(settled, schema, 1)[0]

    return run


def _settled(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Masks of rows that come sorted by text, by tries of neighbouring texts."""
    schema = pa.schema([("id", kind), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])

    def least(trie: TextTrie) -> list[tuple]:
        return [(key, part, mask, n) for _, key, rows in trie.terminals() for (part, mask), n in rows.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, out = TextTrie(), None, []
        for whole in batches:
            for batch in slices(whole, "text"):
                raw = batch.column("text").cast(pa.binary()).to_pylist()
                for text, key, part, mask, n in zip(raw, *(batch.column(c).to_pylist() for c in ("id", "part", "mask", "n"))):
                    if trie.held > TRIE_BYTES and text != last:
                        out += least(trie)
                        trie = TextTrie()
                    out += [r[:4] for r in _add(trie, text, 0, key, part, mask, n)]
                    last = text
                done, out = _batches(out, schema, 65536)
                yield from done
        yield from _batches(out + least(trie), schema, 1)[0]

    return run


def _doubled(k: Column) -> Column:
    """PREFIX_BYTES doubled k times."""
    return F.call_function("shiftleft", F.lit(PREFIX_BYTES), k)


def _prefix_hashes(raw: Column) -> Column:
    """Hashes of the proper prefixes of each doubled length, of a text's bytes."""
    deepest = F.ceil(F.log2(F.octet_length(raw) / PREFIX_BYTES)).cast("int") - 1
    levels = F.when(F.octet_length(raw) > PREFIX_BYTES, F.sequence(F.lit(0), deepest)).otherwise(F.array().cast("array<int>"))
    return F.transform(levels, lambda k: F.xxhash64(k, F.substr(raw, F.lit(1), _doubled(k))))


def adaptive_prefix(rows: DataFrame, partitions: int) -> Column:
    """The prefix that ranges of texts are cut by. Heavy prefixes are at most
    CELLS * partitions for each doubled length."""
    raw = F.col("text").cast("binary")
    weights = (
        rows.select(F.xxhash64("text").alias("of"), F.octet_length("text").alias("size"), _prefix_hashes(raw).alias("prefixes"))
        .dropDuplicates(["of"])
        .select("size", F.explode("prefixes").alias("prefix"))
        .groupBy("prefix")
        .agg(F.sum("size").alias("size"))
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    heavy = [r["prefix"] for r in weights.where(F.col("size") > max(total // (partitions * CELLS), 1)).select("prefix").collect()]
    deep = F.size(F.filter(_prefix_hashes(raw), lambda h: h.isin(heavy))) if heavy else F.lit(0)
    return F.substr(raw, F.lit(1), _doubled(deep))


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, n): n rows of an id and part fail the mask's filters."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", text_mask(F.col("text")).alias("mask"), "text")
    arrow = pa.schema([pa.field("id", _arrow(kind))]).field(0).type
    path = shared_dir(spark, "text-tries")
    one = f"id {kind.simpleString()}, part string, mask int, n long"
    rows.mapInArrow(_combined(arrow), f"{one}, text string").write.mode("overwrite").parquet(path)
    combined = spark.read.schema(f"{one}, text string").parquet(path)
    open_ = combined.where("text is not null")
    size = open_.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES + 1)
    dealt = open_.withColumn("prefix", adaptive_prefix(open_, partitions)).repartitionByRange(partitions, "prefix").sortWithinPartitions("text").drop("prefix")
    return combined.where("text is null").drop("text").union(dealt.mapInArrow(_settled(arrow), one))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def label_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows of a part with a mask, and those of
    them whose id is labelled good or toxic."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag("quality"), flag("toxic"))
    summed = masks.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).join(known, "id", "left")
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return summed.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic"))


def audit_orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from counts of masks."""
    orders = ["".join(p) for p in permutations(filters)]
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.substr("filter_order", at, F.lit(1))) - 1)
    mask, own, before, n = (F.col(c) for c in ("mask", "own", "before", "n"))
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    total = lambda what, when: F.sum(F.when(when, what).otherwise(0)).cast("long")
    each = counts.select("*", F.explode(F.split(F.lit(",".join(orders)), ",")).alias("filter_order"))
    bits = F.transform(F.sequence(F.lit(1), F.lit(len(filters))), bit)
    each = each.select("*", F.posexplode(bits).alias("place", "own"), bits.alias("bits"))
    each = each.withColumn("step", F.col("place") + 1).withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("place")), F.lit(0), lambda x, y: x + y))
    return each.groupBy("part", "filter_order", "step").agg(
        total(n, ~fails & ~gone).alias("kept"),
        total(n, fails & ~gone).alias("removed"),
        total(n, fails & gone).alias("redundant"),
        total(n, mask == own).alias("unique_fails"),
        total(F.col("good"), fails & ~gone).alias("good_lost"),
        total(F.col("toxic"), fails & ~gone).alias("toxic_lost"),
        # A filter is first among those that a row fails in one of so many orders.
        total((n * len(orders) / F.bit_count(mask)).cast("long"), fails).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the five filters over whole texts, for each part."""
    return audit_orders(label_counts(filter_masks(docs, id_col, text_col, part_col), labels, id_col))
