"""Token ids in Arrow files of fixed-size-list batches.

Documents go in ascending order of id into files; a file's ids form one stream,
cut into sequences of equal length (the last one padded, its padding masked
out). Every record batch holds the same number of sequences, so sequence i of a
memory-mapped file is found by a division and read without a copy. A second
file of the same name lists the documents: id, place in the stream, length.

Words are encoded once per task and joined: the tokenizer treats what stands
between white space alone, so a text's ids are those of its words in order.

Files are written under another name and then renamed, so a task that runs again
after an executor was lost replaces its file by an equal one.

Defined results: a null text counts as empty and holds the end id alone; rows of
equal id are ordered by the hash (xxhash64) of their text, then by text, however the
rows are dealt; ids are integers; no rows: no files, no result rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relayspark.llm.common import shared_dir, slices, split_words, text_rows, word_codes

#: Ids in a sequence, sequences in a record batch.
SEQUENCE, BATCH_SEQUENCES = 1024, 64
#: Words, and parts of words, whose ids a worker keeps.
CACHE_WORDS, CACHE_PARTS = 600_000, 400_000
#: Documents in one batch of a document list.
LIST_ROWS = 4096

MANIFEST = "part int, path string, n_docs long, n_ids long"


# The normalizer and pre-tokenizer of the tokenizer file for which
# plain words need only its merge model.
_PLAIN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words of Latin letters, digits and signs: no apostrophe (contractions), none
#: of the signs that special tokens hold, nothing that normalization changes.
_PLAIN = r"\A[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}!-&(-;=?@\[-`{}~]+\z"
#: Parts of plain words in lower case, each word ended by a line's end.
_PART = re.compile(r"[a-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+|[0-9]|\n|[^a-z0-9\xC0-\xD6\xD8-\xF6\xF8-\xFF\n]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_LETTER = _byte_letters()


def _picked(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, each from its first place on, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _laid(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all lists in a row, length of each list)."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size


class WordEncoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library, word by word.

    Plain words go straight to the tokenizer's merge model, cut into the parts
    that its pre-tokenizer would make; all other words, and all words of other
    kinds of tokenizers, go through the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        with open(tokenizer_file, encoding="utf-8") as f:
            kind = json.load(f)
        splits = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.plain = [n.get("type") for n in (kind.get("normalizer") or {}).get("normalizers", [])] == _PLAIN_NORMALIZERS and (
            splits[0].get("pattern") == {"Regex": _PLAIN_SPLIT} and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
        )
        self.forget()
        self._forget_parts()

    def forget(self) -> None:
        """Start with no word known; parts of words stay."""
        self.code: dict[str, int] = {}
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _forget_parts(self) -> None:
        # The end of a word is a part without ids.
        self.part: dict[str, int] = {"\n": 0}
        self.part_first, self.part_size, self.part_flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn_parts(self, parts: list[str]) -> None:
        letters = (x if x.isascii() else x.encode().decode("latin-1").translate(_LETTER) for x in parts)
        flat, size = _laid([[t.id for t in self.model.tokenize(x)] for x in letters])
        self.part.update(zip(parts, range(len(self.part), len(self.part) + len(parts))))
        self.part_first = np.concatenate([self.part_first, len(self.part_flat) + np.cumsum(size) - size])
        self.part_size = np.concatenate([self.part_size, size])
        self.part_flat = np.concatenate([self.part_flat, flat])

    def _plain_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of plain words in a row, number of ids of each)."""
        none, end = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        ended = pc.binary_join_element_wise(words, none, end).buffers()
        size = np.frombuffer(ended[1], "<i8")[len(words)] if len(words) else 0
        found = _PART.findall(str(memoryview(ended[2])[:size], "utf-8").lower() if size else "")
        distinct = set(found)
        if len(self.part) + len(distinct) > CACHE_PARTS:
            self._forget_parts()
        self._learn_parts(sorted(distinct.difference(self.part)))
        part = np.fromiter(map(self.part.__getitem__, found), np.int64, len(found))
        size = self.part_size[part]
        ends = np.flatnonzero(part == 0)
        return _picked(self.part_flat, self.part_first[part], size), np.diff(np.cumsum(size)[ends], prepend=0)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the words, in some order; place of each word's first id; number of its ids)."""
        plain = np.zeros(len(words), bool)
        if self.plain:
            plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        kinds = [(words.filter(pa.array(of)), np.flatnonzero(of)) for of in (plain, ~plain)]
        flat, each = self._plain_ids(kinds[0][0])
        rest, other = kinds[1][0].to_pylist(), []
        for begin in range(0, len(rest), 8192):
            other += [e.ids for e in self.tokenizer.encode_batch_fast(rest[begin : begin + 8192], add_special_tokens=False)]
        more, rest = _laid(other)
        size = np.empty(len(words), np.int64)
        size[kinds[0][1]], size[kinds[1][1]] = each, rest
        first = np.empty(len(words), np.int64)
        first[kinds[0][1]] = np.cumsum(each) - each
        first[kinds[1][1]] = len(flat) + np.cumsum(rest) - rest
        return np.concatenate([flat, more]), first, size

    def _learn(self, words: list[str]) -> None:
        flat, first, size = self._encoded(pa.array(words, pa.large_string()))
        self.code.update(zip(words, range(len(self.code), len(self.code) + len(words))))
        self.first, self.size = np.concatenate([self.first, len(self.flat) + first]), np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words without white space in a row, number of ids of each);
        the words themselves are not kept."""
        flat, first, size = self._encoded(words.cast(pa.large_string()))
        return _picked(flat, first, size), size

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        words, rows = split_words(texts)
        if len(words) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        distinct, codes = word_codes(words)
        listed = distinct.to_pylist()
        missing = [w for w in listed if w not in self.code]
        if len(self.code) + len(missing) > CACHE_WORDS:
            self.forget()
            missing = listed
        self._learn(missing)
        code = np.fromiter(map(self.code.__getitem__, listed), np.int64, len(listed))[codes]
        n = self.size[code]
        ids = _picked(self.flat, self.first[code], n)
        total = np.concatenate([[0], np.cumsum(n)])
        begin = np.searchsorted(rows, np.arange(len(texts) + 1))
        return ids, np.diff(total[begin])


_LOADED: dict[str, WordEncoder] = {}


def loaded(tokenizer_file: str) -> WordEncoder:
    """The encoder, made once per worker; it keeps the words of earlier tasks."""
    if tokenizer_file not in _LOADED:
        _LOADED[tokenizer_file] = WordEncoder(tokenizer_file)
    return _LOADED[tokenizer_file]


def _file_system(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


def _token_schema(wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([("ids", pa.list_(kind, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])


_LIST_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _sequences(ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """Whole sequences, the last padded with zeros under a false mask."""
    n = -(-len(ids) // SEQUENCE)
    full = np.zeros(n * SEQUENCE, schema.field("ids").type.value_type.to_pandas_dtype())
    full[: len(ids)] = ids
    mask = np.arange(n * SEQUENCE) < len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.FixedSizeListArray.from_arrays(pa.array(full), SEQUENCE), pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQUENCE)], schema=schema
    )


def write_token_files(
    docs: DataFrame, out_dir: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the files and their manifest; returns the manifest (part, path,
    n_docs, n_ids; one row per file, parts in order of ids)."""
    texts = text_rows(docs, id_col, text_col)
    # Files are cut by (id, hash): the order within them has to be the same.
    texts = texts.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").drop("h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = loaded(tokenizer_file), TaskContext.get().partitionId()
        schema = _token_schema(max(encoder.vocab_size, end_id + 1) > 1 << 16)
        fs, folder = _file_system(out_dir)
        name = f"{folder}/tokens-{part:06d}"
        scratch = f"{folder}/_writing-{part:06d}-{TaskContext.get().taskAttemptId()}"
        block, n_docs, n_ids, left = SEQUENCE * BATCH_SEQUENCES, 0, 0, np.zeros(0, np.uint32)
        out = None
        for batch in batches:
            for rows in slices(batch, "text"):
                if out is None:
                    fs.create_dir(folder)
                    out, lists = (fs.open_output_stream(f"{scratch}.{x}") for x in ("arrow", "docs.arrow"))
                    tokens, listed = pa.ipc.new_file(out, schema), pa.ipc.new_file(lists, _LIST_SCHEMA)
                ids, size = encoder.texts(rows.column("text"))
                ids = np.insert(ids, np.cumsum(size), end_id)
                size = size + 1
                start = n_ids + np.cumsum(size) - size
                listed.write_table(pa.table([rows.column("id").cast(pa.int64()), start, size], schema=_LIST_SCHEMA), LIST_ROWS)
                n_docs, n_ids = n_docs + len(size), n_ids + len(ids)
                left = np.concatenate([left, ids])
                while len(left) >= block:
                    tokens.write_batch(_sequences(left[:block], schema))
                    left = left[block:]
        if out is None:
            return
        if len(left):
            tokens.write_batch(_sequences(left, schema))
        for x in (tokens, listed, out, lists):
            x.close()
        for x in ("docs.arrow", "arrow"):
            fs.move(f"{scratch}.{x}", f"{name}.{x}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{out_dir}/tokens-{part:06d}"], "n_docs": [n_docs], "n_ids": [n_ids]})

    manifest = f"{out_dir}/manifest"
    texts.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(manifest)
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


class TokenFile:
    """Random access to the sequences and documents of one file."""

    def __init__(self, path: str):
        fs, name = _file_system(f"{path}.arrow")
        local = isinstance(fs, pafs.LocalFileSystem)
        lists = _file_system(f"{path}.docs.arrow")[1]
        self.tokens, self.docs = (pa.ipc.open_file(pa.memory_map(x) if local else fs.open_input_file(x)) for x in (name, lists))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (no copy) and mask of sequence i."""
        batch, row = self.tokens.get_batch(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
        flat = batch.column("ids").values.to_numpy()
        mask = batch.column("mask").slice(row, 1).flatten().to_numpy(zero_copy_only=False)
        return flat[row * SEQUENCE : (row + 1) * SEQUENCE], mask

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids from a place of the stream on."""
        block, parts = SEQUENCE * BATCH_SEQUENCES, []
        while n > 0:
            flat = self.tokens.get_batch(start // block).column("ids").values.to_numpy()
            part = flat[start % block : start % block + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (over all files), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "path", F.coalesce(before, F.lit(0)).alias("base")).repartition("part")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                held = TokenFile(path)
                for i in range(held.docs.num_record_batches):
                    docs = held.docs.get_batch(i)
                    start, size = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                    ids = held.ids(int(start[0]), int(size.sum())).astype("<u4")
                    at = start - start[0]
                    crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, size)]
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": docs.column("doc_id"), "start": pa.array(start + base, pa.int64()), "n_tokens": docs.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())}
                    )

    return files.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", out_dir: str | None = None) -> DataFrame:
    """Encode, write, read back: see ``read_token_files``."""
    out_dir = out_dir or shared_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, out_dir, tokenizer_file, end_id, id_col, text_col))
