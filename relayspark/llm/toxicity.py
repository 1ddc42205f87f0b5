"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input has two parts: an embedding of the word itself and the mean
embedding of its character n-grams (bytes, with marks at both ends), both in
hashed tables, so that unseen forms of a known stem are recognised. Windows of
words overlap; the network reads each in both directions, an attention layer
weighs its states, and a window's logit is a linear function of the weighted mean
of states: words reach it through the recurrent states alone. A text's logit is
that of its highest window; its score is the logistic of the calibrated logit.

The network is trained in numpy on windows drawn by hash from whole texts of a
bounded sample of labelled rows (see ``fit``). Training starts from embeddings
whose first column holds label log odds and from one unit a direction that reads
this column; all of it is then trained. On part of the sample, which the gradient
doesn't see, the logit is calibrated. Calibration and scoring take all windows of
whole texts. The inputs of a word's gates are computed once per distinct word of a
slice.

Defined results: null texts and texts without words score as one empty window;
equal texts get equal scores; without labels of both kinds, all texts get
score 0 (or the only label there is); a null label counts as no label, and
of several labels of one id the highest counts; of several labelled texts of one
id the network learns from that of least hash; with fewer than FEW rows of a label
to train or to calibrate on, all rows of the sample serve for both.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relayspark.llm.common import materialize, slices, split_words, word_codes

#: Words of a window, words between two windows' starts.
WINDOW, STRIDE = 32, 24
#: Hashed words and character n-grams, their embedding sizes, states a direction.
WORD_SLOTS, GRAM_SLOTS, WORD_DIM, GRAM_DIM, STATES = 1 << 17, 1 << 15, 6, 10, 8
#: Parameters that are tables: plain gradient steps on the rows that a batch reads.
TABLES = ("word", "gram")
#: Bytes of a character n-gram.
GRAMS = (3, 4)
#: Log odds of a slot are drawn to 0 as if so large a share of the texts more held it.
PRIOR_SHARE = 0.05
#: Bytes of text scored at once.
SLICE = 2 << 20
#: Bounds of the sample: toxic rows to train on (and twice as many others), windows
#: of each, bytes of a window, rows of each label to calibrate on.
TRAIN_ROWS, TRAIN_WINDOWS, WINDOW_BYTES, CALIBRATE_ROWS = 900, 24, 8192, 400
#: Rows of a label below which training and calibration share them.
FEW = 20
#: Score from which a text counts as toxic.
THRESHOLD = 0.7
#: In calibration, weight of a clean text taken for toxic against the reverse.
CLEAN_WEIGHT = 3.0


def word_inputs(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: (slot of each word, slots of all their character
    n-grams, number of n-grams of each word)."""
    framed = pc.binary_join_element_wise("<", pc.utf8_lower(words), ">", "")
    slot = np.array([zlib.crc32(w) for w in framed.cast(pa.binary()).to_pylist()], np.int64) % WORD_SLOTS
    ends = np.frombuffer(framed.buffers()[1], np.int32)[framed.offset : framed.offset + len(framed) + 1].astype(np.int64)
    code = np.frombuffer(framed.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.int64)
    first, size = ends[:-1] - ends[0], np.diff(ends)
    each = [np.maximum(size - g + 1, 0) for g in GRAMS]
    n = sum(each)
    grams, at = np.zeros(int(n.sum()), np.int64), np.cumsum(n) - n
    for g, m in zip(GRAMS, each):
        h = np.zeros(max(len(code) - g + 1, 0), np.int64)
        for k in range(g):
            h = h * 1000003 + code[k : k + len(h)] + 1
        h = ((h ^ (h >> 17)) * 0x2545F491 + g >> 13) % GRAM_SLOTS
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        grams[np.repeat(at, m) + step] = h[np.repeat(first, m) + step]
        at = at + m
    return slot, grams, n


def windows(rows: np.ndarray, codes: np.ndarray, n_rows: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the words of each window, row of each window). Windows start
    every STRIDE words and cover all words; a row without words has one that is
    empty."""
    n = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(n) - n
    count = np.maximum(-(-(n - (WINDOW - STRIDE)) // STRIDE), 1)
    row = np.repeat(np.arange(n_rows), count)
    begin = STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < n[row][:, None]
    held = np.append(codes, pad)
    return np.where(inside, held[np.minimum(first[row][:, None] + at, len(codes))], pad), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each place from 0 to size - 1."""
    out, order = np.zeros((size, rows.shape[1]), np.float32), np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    out[places] = np.add.reduceat(rows[order], first, axis=0)
    return out


@dataclass
class Network:
    """Parameters, by name; ``scale`` and ``shift`` calibrate a text's logit."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, STATES
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        net = Network(
            {
                "word": draw(WORD_SLOTS, WORD_DIM, s=0.02),
                "gram": draw(GRAM_SLOTS, GRAM_DIM, s=0.02),
                "x": draw(2, d, 3 * h, s=d**-0.5),
                "b": np.zeros((2, 1, 3 * h), np.float32),
                "u": draw(2, h, 3 * h, s=h**-0.5),
                "a": draw(2 * h, 2 * h, s=(2 * h) ** -0.5),
                "v": draw(2 * h, s=0.3),
                "o": draw(2 * h, s=0.5),
                "c": np.zeros(1, np.float32),
            }
        )
        # The first unit of each direction starts as a reader of the tables' first column.
        p = net.p
        p["x"][:, [0, WORD_DIM], 2 * h] = 1.5
        p["b"][:, 0, 0] = -1.0
        p["a"][[0, h], 0] = 1.0
        p["v"][0] = 1.0
        p["o"][[0, h]] = 2.0
        return net

    def embed(self, slot: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Inputs of distinct words; one more row, of zeros, for padding."""
        total = np.zeros((len(slot), GRAM_DIM), np.float32)
        full = n > 0
        if full.any():
            total[full] = np.add.reduceat(self.p["gram"][grams], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
        return np.concatenate([np.concatenate([self.p["word"][slot], total], 1), np.zeros((1, WORD_DIM + GRAM_DIM), np.float32)])

    def forward(self, inputs: np.ndarray, codes: np.ndarray, keep: bool = False):
        """Logit of each window; with ``keep``, also what the gradient needs."""
        p, h, pad = self.p, STATES, len(inputs) - 1
        gates = inputs @ p["x"] + p["b"]  # 2 directions, distinct words, 3 gates
        n = len(codes)
        both = np.stack([codes, codes[:, ::-1]])
        state = np.zeros((2, n, h), np.float32)
        states, held = np.empty((WINDOW, 2, n, h), np.float32), []
        for t in range(WINDOW):
            x = np.stack([gates[0][both[0, :, t]], gates[1][both[1, :, t]]])
            r = state @ p["u"]
            zr = _sigmoid(x[..., : 2 * h] + r[..., : 2 * h])
            z, reset = zr[..., :h], zr[..., h:]
            new = np.tanh(x[..., 2 * h :] + reset * r[..., 2 * h :])
            real = (both[:, :, t] != pad)[..., None]
            after = np.where(real, new + z * (state - new), state)
            if keep:
                held.append((state, z, reset, r[..., 2 * h :], new, real))
            states[t] = state = after
        # Both directions' states at each word, backward ones in reading order.
        s = np.concatenate([states[:, 0], states[::-1, 1]], axis=2).transpose(1, 0, 2)
        mixed = np.tanh(s @ p["a"])
        e = np.where(codes != pad, mixed @ p["v"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True))
        weight = e / e.sum(1, keepdims=True)
        pooled = (weight[:, None, :] @ s)[:, 0]
        logit = pooled @ p["o"] + p["c"][0]
        return (logit, (both, held, s, mixed, weight, pooled)) if keep else logit

    def backward(self, inputs: np.ndarray, codes: np.ndarray, cache, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters above the embeddings, and of the inputs."""
        p, h, pad = self.p, STATES, len(inputs) - 1
        both, held, s, mixed, weight, pooled = cache
        g = {"o": pooled.T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["o"]
        d_weight = (s @ d_pooled[:, :, None])[..., 0]
        d_s = weight[..., None] * d_pooled[:, None, :]
        d_e = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        d_e[codes == pad] = 0
        g["v"] = (mixed * d_e[..., None]).sum((0, 1))
        d_mixed = d_e[..., None] * p["v"] * (1 - mixed * mixed)
        g["a"] = s.reshape(-1, 2 * h).T @ d_mixed.reshape(-1, 2 * h)
        d_s = d_s + d_mixed @ p["a"].T
        d_states = np.stack([d_s[..., :h].transpose(1, 0, 2), d_s[:, ::-1, h:].transpose(1, 0, 2)], axis=1)
        d_each = np.empty((2, WINDOW, len(codes), 3 * h), np.float32)
        g["u"], d_state = np.zeros_like(p["u"]), np.zeros_like(d_states[0])
        for t in range(WINDOW - 1, -1, -1):
            state, z, reset, rn, new, real = held[t]
            d = d_state + d_states[t]
            d_real = np.where(real, d, 0)
            d_new = d_real * (1 - z) * (1 - new * new)
            d_z = d_real * (state - new) * z * (1 - z)
            d_reset = d_new * rn * reset * (1 - reset)
            d_r = np.concatenate([d_z, d_reset, d_new * reset], axis=2)
            d_each[:, t] = np.concatenate([d_z, d_reset, d_new], axis=2)
            g["u"] += state.transpose(0, 2, 1) @ d_r
            d_state = np.where(real, d_real * z, d) + d_r @ p["u"].transpose(0, 2, 1)
        d_gates = np.stack([_sums(both[k].T.ravel(), d_each[k].reshape(-1, 3 * h), len(inputs)) for k in (0, 1)])
        d_gates[:, pad] = 0
        g["b"] = d_gates.sum(1, keepdims=True)
        g["x"] = inputs.T @ d_gates
        d_inputs = (d_gates @ p["x"].transpose(0, 2, 1)).sum(0)
        return g, d_inputs[:-1]


def _coded(texts: list[str | None] | pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    words, rows = split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    if not len(words):
        return words, rows, np.zeros(0, np.int64)
    distinct, codes = word_codes(words)
    return distinct, rows, codes.astype(np.int64)


def text_logits(net: Network, texts: list[str | None] | pa.Array) -> np.ndarray:
    """Highest window's logit of each text."""
    distinct, rows, codes = _coded(texts)
    inputs = net.embed(*word_inputs(distinct)) if len(distinct) else np.zeros((1, WORD_DIM + GRAM_DIM), np.float32)
    held, row = windows(rows, codes, len(texts), len(inputs) - 1)
    logit = np.concatenate([net.forward(inputs, held[a : a + 8192]) for a in range(0, len(held), 8192)])
    return np.maximum.reduceat(logit, np.searchsorted(row, np.arange(len(texts))))


def drawn_windows(text: str, most: int) -> list[str]:
    """At most ``most`` windows of a whole text, those of least hash (of the
    window's number and words), in the text's order; every place of a text of
    any length is as likely. Windows beyond WINDOW_BYTES aren't drawn."""
    words = split_words(pa.array([text], pa.string()))[0].to_pylist()
    count = max(-(-(len(words) - (WINDOW - STRIDE)) // STRIDE), 1)
    all_of = (" ".join(words[STRIDE * i : STRIDE * i + WINDOW]) for i in range(count))
    keyed = ((zlib.crc32(f"{i} {w}".encode()), i, w) for i, w in enumerate(all_of) if len(w) <= WINDOW_BYTES)
    return [w for _, w in sorted((i, w) for _, i, w in heapq.nsmallest(most, keyed))] or [""]


def _seed_tables(net: Network, texts: list[str], labels: np.ndarray, batch: int = 64) -> None:
    """Start the first column of each table at the log odds of the labels of texts
    that hold a slot, drawn to 0 where few do, so that training begins from what
    words and stems say by themselves."""
    held = {"word": np.zeros((2, WORD_SLOTS)), "gram": np.zeros((2, GRAM_SLOTS))}
    for a in range(0, len(texts), batch):
        distinct, rows, codes = _coded(texts[a : a + batch])
        if not len(distinct):
            continue
        slot, grams, n = word_inputs(distinct)
        pairs = np.unique(rows * len(distinct) + codes)
        rows, codes = pairs // len(distinct), pairs % len(distinct)
        n, first = n[codes], (np.cumsum(n) - n)[codes]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for name, of, slots in (("word", rows, slot[codes]), ("gram", np.repeat(rows, n), grams[np.repeat(first, n) + step])):
            size = held[name].shape[1]
            pairs = np.unique(of * size + slots)
            for label in (0, 1):
                held[name][label] += np.bincount((pairs % size)[labels[a + pairs // size] == label], minlength=size)
    for name, (zeros, ones) in held.items():
        odds = np.log((ones + 1) / ((labels == 1).sum() + 2)) - np.log((zeros + 1) / ((labels == 0).sum() + 2))
        net.p[name][:, 0] += (odds * (ones + zeros) / (ones + zeros + PRIOR_SHARE * len(texts))).astype(np.float32)


def train(texts: list[list[str]], labels: np.ndarray, rounds: int = 4, steps: int = 300, batch: int = 24, rate: float = 0.01, table_rate: float = 0.2, l2: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the logistic loss of texts, each given by its windows (of at most
    WINDOW words); a text's logit while training is the soft maximum of its
    windows', so every window gets a share of the gradient. There are ``rounds``
    rounds, or as many as make ``steps`` steps where texts are few."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    _seed_tables(net, [" ".join(t) for t in texts], labels)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in TABLES}
    step, balance = 0, np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
    for _ in range(max(rounds, -(-steps // max(-(-len(texts) // batch), 1)))):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            given = [w for i in at for w in texts[i]]
            distinct, rows, codes = _coded(given)
            if not len(distinct):
                continue
            slot, grams, n = word_inputs(distinct)
            inputs = net.embed(slot, grams, n)
            held, _ = windows(rows, codes, len(given), len(distinct))
            row = np.repeat(np.arange(len(at)), [len(texts[i]) for i in at])
            logit, cache = net.forward(inputs, held, keep=True)
            first = np.searchsorted(row, np.arange(len(at)))
            top = np.maximum.reduceat(logit, first)
            e = np.exp(2 * (logit - top[row]))
            share = e / np.add.reduceat(e, first)[row]
            text_logit = np.add.reduceat(share * logit, first)
            d_text = (_sigmoid(text_logit) - labels[at]) * balance[at] / len(at)
            g, d_inputs = net.backward(inputs, held, cache, (d_text[row] * share).astype(np.float32))
            by = -table_rate * len(at)
            np.add.at(net.p["word"], slot, by * d_inputs[:, :WORD_DIM])
            np.add.at(net.p["gram"], grams, np.repeat(by * d_inputs[:, WORD_DIM:] / np.maximum(n, 1)[:, None], n, axis=0))
            step += 1
            for k, d in g.items():
                v, (m1, m2) = net.p[k], moment[k]
                d = d + l2 * v
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return net


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray) -> None:
    """Put the cut that errs least on the sample at the threshold; between equal
    cuts, the middle. A clean text taken for toxic counts CLEAN_WEIGHT times."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order].astype(np.float64), labels[order]
    # Errors if everything from place i on counts as toxic.
    share = np.where(y == 1, 1 / max((y == 1).sum(), 1), CLEAN_WEIGHT / max((y == 0).sum(), 1))
    wrong = np.concatenate([[0], np.cumsum(share * (y == 1))]) + np.concatenate([np.cumsum((share * (y == 0))[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    i = best[len(best) // 2]
    low, high = x[max(i - 1, 0)], x[min(i, len(x) - 1)]
    net.scale = float(np.clip(4 / max(high - low, 1e-3), 0.5, 2.0))
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - net.scale * (low + high) / 2)


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS, calibrate_rows: int = CALIBRATE_ROWS,
) -> Network | float:
    """Learn from the rows that ``learn`` (a condition on the column ``id``)
    allows: of each label at most ``3 * train_rows + calibrate_rows`` ids, those of
    least hash, and of each id one text. An eighth of the ids, at most
    ``calibrate_rows`` of each label, calibrate; of the others, at most
    ``train_rows`` toxic ones and twice as many others train the network, each by
    at most TRAIN_WINDOWS windows from all places of its text. Texts of any length
    serve for both; the driver gets these windows and the calibration's logits, no
    texts. With one label only, that label is returned."""
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(learn & F.col("id").isNotNull() & F.col("label").isin(0, 1))
    ranked = marked.groupBy("id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("id"))
    most = 3 * train_rows + calibrate_rows
    chosen = ranked.where("label = 0").orderBy("h", "id").limit(most).union(ranked.where("label = 1").orderBy("h", "id").limit(most))
    # At most twice that many ids.
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")
    drawn = materialize(_one_each(texts.mapInArrow(_draw, _drawn_schema(texts)), "windows"))

    def rows(part: str) -> list:
        kinds = [drawn.where(part).where(f"label = {kind}").orderBy("h", "id").limit(train_rows * (2 - kind)) for kind in (0, 1)]
        return kinds[0].unionByName(kinds[1]).select("label", "windows").collect()

    def logits(net: Network, part: str) -> tuple[np.ndarray, np.ndarray]:
        sent = texts.sparkSession.sparkContext.broadcast(net)  # of fixed size
        kept = texts.where(part).mapInArrow(lambda batches: _logit(sent.value, batches), _logit_schema(texts))
        got = [r for kind in (0, 1) for r in _one_each(kept, "logit").where(f"label = {kind}").orderBy("h", "id").limit(calibrate_rows).select("label", "logit").collect()]
        sent.unpersist()
        return np.array([r["logit"] for r in got]), np.array([r["label"] for r in got])

    n = {(r["label"], r["held"]): r["count"] for r in drawn.groupBy("label", (F.pmod("h", F.lit(8)) == 0).alias("held")).count().collect()}
    present = sorted({kind for kind, _ in n})
    if len(present) < 2:
        return float(present[0] if present else 0)
    few = min(n.get((kind, held), 0) for kind in (0, 1) for held in (True, False)) < FEW
    used = rows("true" if few else "pmod(h, 8) != 0")
    net = train([r["windows"] for r in used], np.array([r["label"] for r in used], np.float32))
    calibrate(net, *logits(net, "true" if few else "pmod(h, 8) = 0"))
    return net


def _one_each(rows: DataFrame, value: str) -> DataFrame:
    """Of each id, the row whose text has the least hash."""
    return rows.groupBy("id", "h", "label").agg(F.min_by(value, "text_hash").alias(value))


def _drawn_schema(texts: DataFrame) -> T.StructType:
    return T.StructType([texts.schema["id"], texts.schema["h"], texts.schema["label"], T.StructField("text_hash", T.LongType()), T.StructField("windows", T.ArrayType(T.StringType()))])


def _logit_schema(texts: DataFrame) -> T.StructType:
    return T.StructType([*_drawn_schema(texts).fields[:4], T.StructField("logit", T.DoubleType())])


def _text_hashes(texts: pa.Array) -> pa.Array:
    return pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts.cast(pa.binary()).to_pylist()], pa.int64())


def _keyed(part: pa.RecordBatch, name: str, value: pa.Array) -> pa.RecordBatch:
    kept = [part.column(c) for c in ("id", "h", "label")]
    return pa.RecordBatch.from_arrays([*kept, _text_hashes(part.column("text")), value], names=["id", "h", "label", "text_hash", name])


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            yield _keyed(part, "windows", pa.array([drawn_windows(t, TRAIN_WINDOWS) for t in part.column("text").to_pylist()], pa.list_(pa.string())))


def _logit(net: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            yield _keyed(part, "logit", pa.array(text_logits(net, part.column("text")).astype(np.float64)))


def score_toxicity(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``docs``, with score and predicted (1 from THRESHOLD on)
    in place of columns of these names."""
    docs = docs.drop("score", "predicted")
    place = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for part in slices(batch, batch.schema.names[place], SLICE):
                if isinstance(net, Network):
                    logit = net.scale * text_logits(net, part.column(place)).astype(np.float64) + net.shift
                    scores = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                else:
                    scores = np.full(part.num_rows, net)
                flag = (scores >= THRESHOLD).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array(flag)], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, schema)
