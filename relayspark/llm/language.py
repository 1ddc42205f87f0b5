"""Language identification in two steps: family, then close languages.

A text's features are the shares of its hashed byte trigrams (letters only,
A-Z lower-cased). A softmax classifier picks the language family; within it, a
linear support vector machine for each pair of languages votes, one against one.

The classifiers learn on a bounded sample: at most ``per_language`` rows of each
language, those of least hash of id. Scoring takes whole texts: a linear score
is a sum over trigrams, so a text of any length costs one pass.

Defined results: null texts and texts without a letter are ``und`` with score 0;
if nothing is labelled, all texts are; with one language known, every other text
gets it. Ties go to the first language in order of name. Equal rows get equal
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayspark.llm.common import slices

# Families of common languages; any other code is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
}

UNDETERMINED = "und"
#: Hashed trigrams.
SLOTS = 1 << 13
#: Rows of each language that the classifiers learn from at most.
PER_LANGUAGE = 400


def _letter_classes() -> np.ndarray:
    """Class of each byte: 0 for what isn't a letter; bytes over 127 belong to
    letters beyond ASCII."""
    classes = np.zeros(256, np.int32)
    for i in range(26):
        classes[ord("a") + i] = classes[ord("A") + i] = i + 1
    classes[128:] = np.arange(27, 155)
    return classes


_CLASSES = _letter_classes()


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each byte's trigram, first byte of each text, trigrams with a
    letter in each text). Slot 0 stands for 'no letter'."""
    padded = pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), "  ", "")
    ends = np.frombuffer(padded.buffers()[1], np.int32)[padded.offset : padded.offset + len(padded) + 1]
    c = _CLASSES[np.frombuffer(padded.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    first = (ends - ends[0])[:-1]
    slot = c * 7127
    slot[:-1] += c[1:] * 419
    slot[:-2] += c[2:] * 31
    slot %= SLOTS
    last = (ends - ends[0])[1:]
    slot[last - 1] = slot[last - 2] = 0
    return slot, first, np.add.reduceat((slot != 0).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot, first, total = trigrams(batch.column("text"))
        at, value = [], []
        for a, b, n in zip(first, [*first[1:], len(slot)], total):
            counts = np.bincount(slot[a:b], minlength=SLOTS)
            counts[0] = 0
            full = np.flatnonzero(counts)
            at.append(full.astype("<i4").tobytes())
            value.append((counts[full] / max(n, 1)).astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "at": pa.array(at, pa.binary()), "value": pa.array(value, pa.binary())})


@dataclass
class Model:
    """Weights of all linear scores, a column each; families first, then pairs."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit_softmax(x: np.ndarray, y: np.ndarray, n: int, rounds: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], n), np.float32), np.zeros(n, np.float32)
    if n < 2:
        return w, b
    rate, balance = 2.0 / max((x * x).sum(1).mean(), 1e-6), 1 / (n * np.bincount(y, minlength=n)[y])
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        d = (_softmax(x @ w + b) - np.eye(n, dtype=np.float32)[y]) * balance[:, None].astype(np.float32)
        vw, vb = 0.9 * vw - rate * (x.T @ d + l2 * w), 0.9 * vb - rate * d.sum(0)
        w, b = w + vw, b + vb
    return w, b


def _fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared hinge loss, y of -1 and 1."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    rate, weight = 0.5 / max((x * x).sum(1).mean(), 1e-6), np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        d = -2 * np.maximum(0, 1 - y * (x @ w + b)) * y * weight
        vw, vb = 0.9 * vw - rate * (x.T @ d + l2 * w), 0.9 * vb - rate * float(d.sum())
        w, b = w + vw, b + vb
    return w, b


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows that ``learn`` (a condition on the column ``id``)
    allows and whose language isn't null."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("label"))
    usable = rows.where(learn & F.col("label").isNotNull() & F.col("id").isNotNull())
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = usable.select("id", "label").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select("id").distinct()
    parts = usable.where("text is not null").join(chosen, "id", "left_semi").select("text", "label").mapInArrow(_feature_rows, "label string, at binary, value binary").collect()
    parts.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["value"])))
    langs = sorted({r["label"] for r in parts})
    families = [[x for x in langs if family_of(x) == f] for f in dict.fromkeys(map(family_of, langs))]
    pairs = [p for f in families for p in combinations(f, 2)]
    if not langs:
        return Model([], [], np.zeros((SLOTS, 0), np.float32), np.zeros(0, np.float32))
    x = np.zeros((len(parts), SLOTS), np.float32)
    for i, r in enumerate(parts):
        x[i, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["value"], "<f4")
    scale = (1 / np.sqrt(x.mean(0) + 1e-5)).astype(np.float32)
    x *= scale
    label = np.array([langs.index(r["label"]) for r in parts])
    of_family = np.array([next(i for i, f in enumerate(families) if x in f) for x in langs])
    w, b = _fit_softmax(x, of_family[label], len(families))
    columns, bias = [w], [b]
    for one, other in pairs:
        at = np.flatnonzero((label == langs.index(one)) | (label == langs.index(other)))
        v, c = _fit_svm(x[at], np.where(label[at] == langs.index(one), 1, -1).astype(np.float32))
        columns.append(v[:, None])
        bias.append(np.array([c], np.float32))
    weights = np.concatenate(columns, 1) * scale[:, None]
    weights[0] = 0
    return Model(families, pairs, np.ascontiguousarray(weights.T, dtype=np.float32), np.concatenate(bias).astype(np.float64))


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; the score is the family's probability
    times the winner's mean probability over its pairs."""
    n, n_families = len(texts), len(model.families)
    lang, score = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
    if not n or not n_families:
        return list(lang), score
    slot, first, total = trigrams(texts)
    has_letter = total > 0
    beyond = np.flatnonzero(has_letter & ~pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False))
    for i in beyond:
        has_letter[i] = any(ch.isalpha() for ch in texts[i].as_py())
    sums = np.stack([np.add.reduceat(w[slot].astype(np.float64), first) for w in model.weights], 1) / np.maximum(total, 1)[:, None] + model.bias
    of_family = _softmax(sums[:, :n_families])
    best = of_family.argmax(1)
    for f, langs in enumerate(model.families):
        at = np.flatnonzero(has_letter & (best == f))
        votes, sure = np.zeros((len(at), len(langs))), np.zeros((len(at), len(langs)))
        for j, (one, other) in enumerate(model.pairs):
            if one in langs:
                margin = sums[at, n_families + j]
                p = 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))
                a, b = langs.index(one), langs.index(other)
                votes[:, a] += margin >= 0
                votes[:, b] += margin < 0
                sure[:, a] += p
                sure[:, b] += 1 - p
        share = sure / max(len(langs) - 1, 1) if len(langs) > 1 else np.ones((len(at), 1))
        winner = (votes + share / 10).argmax(1)
        lang[at] = np.array(langs, dtype=object)[winner]
        score[at] = of_family[at, f] * share[np.arange(len(at)), winner]
    return list(lang), np.clip(score, 0, 1)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights for each family and pair
    kind = rows.schema["id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                lang, score = predict(sent.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(label, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
