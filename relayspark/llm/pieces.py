"""SentencePiece encoding and decoding by an Aho-Corasick automaton.

The automaton holds all pieces of a public model. It runs over a text once;
at each position it follows its output links to every piece that ends there, and
each such piece relaxes the best score of that position (Viterbi). A character
that no piece covers becomes byte pieces. Of equally good ways, the one with the
longer last piece counts.

No piece spans the place before a space, but for runs of spaces, so a text falls
into segments (spaces and what follows them) whose best ways are independent;
each distinct segment is solved once per task and kept.

Defined results: null and empty texts have no ids, and no ids decode to an empty
text. A literal U+2581 is written in byte pieces, so that it isn't taken for a
space. Decoding gives back every text exactly. Other columns stay as they are.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relayspark.llm.common import slices

SPACE = "\u2581"
#: Stands for a literal U+2581 while matching; no piece holds it.
LITERAL = "\ufdd0"
#: An unknown character scores this much less than the worst piece.
UNKNOWN_BELOW = 10.0
#: Segments that a task keeps, and the longest one worth keeping.
CACHE_SEGMENTS, CACHE_CHARS = 300_000, 32

_SEGMENT = re.compile(" +[^ ]*")


class PieceModel(dict):
    """Pieces of a model file; as a mapping, from segments to their ids (bytes
    of little-endian 32-bit integers)."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = model.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.before: dict[str, bytes] = {}
        self.byte_ids = np.zeros(256, "<i4")
        self.raw: list[bytes] = []
        worst = 0.0
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.automaton.add_word(piece, (len(piece), model.get_score(i), i))
                worst = min(worst, model.get_score(i))
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.automaton.make_automaton()
        self.unknown = worst - UNKNOWN_BELOW

    def best(self, segment: str) -> tuple[list[int], float]:
        """Ids of the best way through a segment, and its score."""
        text = segment.replace(SPACE, LITERAL).replace(" ", SPACE)
        n, unknown, nothing = len(text), self.unknown, (1, 0.0, self.size)
        score, back = [0.0] * (n + 1), [nothing] * (n + 1)
        # Matches come by their ends; at is the one being relaxed, top its best score.
        at, top, way, single = 0, None, nothing, True
        for end, match in self.automaton.iter(text):
            end += 1
            length, value, _ = match
            if end != at:
                if not single and (s := score[at - 1] + unknown) > top:
                    top, way = s, nothing
                if at:
                    score[at], back[at] = top, way
                for i in range(at + 1, end):
                    score[i] = score[i - 1] + unknown
                at, top, single = end, None, False
            s = score[end - length] + value
            if top is None or s > top:
                top, way = s, match
            if length == 1:
                single = True
        if at:
            if not single and (s := score[at - 1] + unknown) > top:
                top, way = s, nothing
            score[at], back[at] = top, way
        for i in range(at + 1, n + 1):
            score[i] = score[i - 1] + unknown
        parts, end = [], n
        while end:
            length, _, piece = back[end]
            end -= length
            parts.append([piece] if piece < self.size else self.byte_ids[list(segment[end].encode())].tolist())
        return [i for p in reversed(parts) for i in p], score[n]

    def __missing__(self, segment: str) -> bytes:
        ids = self.before.get(segment)
        if ids is None:
            found = self.best(segment)[0]
            ids = struct.pack(f"<{len(found)}i", *found)
        if len(segment) <= CACHE_CHARS:
            # Two halves: what isn't used while one fills up is forgotten.
            if len(self) >= CACHE_SEGMENTS // 2:
                self.before = dict(self)
                self.clear()
            self[segment] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, _SEGMENT.findall(f" {text}"))) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", errors="replace")[1:]


_LOADED: dict[str, PieceModel] = {}


def loaded(model_file: str) -> PieceModel:
    """The model, read once per worker."""
    if model_file not in _LOADED:
        _LOADED[model_file] = PieceModel(model_file)
    return _LOADED[model_file]


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode_pieces(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """Add the ids of a text column (array of int)."""
    if ids_col in docs.columns:
        docs = docs.drop(ids_col)
    place = docs.columns.index(text_col)
    docs = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_file)
        for batch in batches:
            for part in slices(batch, batch.schema.names[place]):
                ids = [model.encode(t) for t in part.column(place).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, ids_col])

    return docs.mapInArrow(encode, _with(docs, ids_col, T.ArrayType(T.IntegerType())))


def decode_pieces(encoded: DataFrame, model_file: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """Add the text that a column of ids stands for."""
    if text_col in encoded.columns:
        encoded = encoded.drop(text_col)
    place = encoded.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_file)
        for batch in batches:
            lists = pc.fill_null(batch.column(place), [])
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists))])
            texts = [model.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return encoded.mapInArrow(decode, _with(encoded, text_col, T.StringType()))
