"""N-gram Jaccard join, exact top-k search, benchmark decontamination."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relayspark.llm import decontaminate, ngram_join, topk
from relayspark.llm.decontaminate import FMIndex, Phrases, find_benchmark, suffix_array
from relayspark.llm.ngram_join import jaccard_components
from relayspark.llm.topk import top_k
from tests.llm import brute
from tests.llm.conftest import ODD_TEXTS


def near_copies(seed=0):
    """Families of near copies, chains, a passage that many share, exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(80)]
    for _ in range(25):
        texts.append(" ".join([word() for _ in range(rng.randint(5, 40))] + passage))
    chain = [word() for _ in range(60)]
    for i in range(20):
        chain = chain[2:] + [word(), word()]
        texts.append(" ".join(chain))
    texts += ["Same text here"] * 3 + ["same TEXT here", "a b c d e", "a b c d e f", "a b c d", "a b c d "]
    rng.shuffle(texts)
    return list(enumerate(texts))


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_components_equal_brute_force(documents):
    docs = near_copies()
    assert found(jaccard_components(documents(docs))) == brute.jaccard(docs)


def test_rows_without_an_id_link_like_all_others(documents):
    """A chain of near copies of which all but the ends have no id."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*(f"x{j}" for j in range(k)), *words[k:]]) for k in range(0, 21, 2)]
    rows = [(9 if k == 0 else 4 if k == len(texts) - 1 else None, t) for k, t in enumerate(texts)]
    got = jaccard_components(documents(rows + [rows[1], (None, "another text of no id at all")])).collect()
    want = {i: c for i, (_, c) in brute.jaccard(list(enumerate(texts))).items()}
    assert set(want.values()) == {0} and brute.jaccard([(0, texts[0]), (1, texts[-1])])[1][1] == 1
    assert sorted(str(r["component_id"]) for r in got) == ["4"] * 12 + ["None"]


def test_components_in_spread_groups_and_small_tiles(documents, monkeypatch):
    """Every shingle counts as hot and every block is tiny: same result."""
    for name, value in (("HOT_HOLDERS", 2), ("HOT_TIMES", 0), ("BLOCK", 3), ("BUCKET_KEYS", 300), ("SENT_IDS", 0), ("SMALL", 2), ("PARTNERS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    docs = near_copies(1)
    assert found(jaccard_components(documents(docs))) == brute.jaccard(docs)


def test_small_tables_between_steps_are_read_in_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        labels = ngram_join.components(spark.createDataFrame([(i, i + 7) for i in range(200)], "a long, b long"))
        assert labels.rdd.getNumPartitions() < 64
        assert {r["node"]: r["label"] for r in labels.collect()} == {i: i % 7 for i in range(207)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_more_links_merge_components_as_if_all_were_given_at_once(spark):
    rng = random.Random(5)
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    more = [(rng.randrange(300), rng.randrange(300)) for _ in range(60)] + [(400, 401), (401, 400)]
    got = ngram_join._merged(ngram_join.components(frame(links)), frame(more)).collect()
    every = {r["node"]: r["label"] for r in ngram_join.components(frame(links + more)).collect()}
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["label"] for r in got if r["node"] in every} == every
    assert all(r["node"] == r["label"] for r in got if r["node"] not in every)


def test_components_of_odd_and_no_texts(odd, none):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(odd).collect()}
    assert rows == {(None, 1, None)} | {(i, n, c) for i, (n, c) in brute.jaccard(ODD_TEXTS).items()}
    assert jaccard_components(odd).count() == len(ODD_TEXTS)
    assert jaccard_components(none).collect() == []


def test_bounds_never_drop_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60 if rng.random() < 0.8 else 5000))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, max(1, int(len(x) * 0.9)), replace=False), rng.integers(0, 2**63, int(rng.integers(0, 8))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        differing = ngram_join._differing([ngram_join.bitmap(x).tobytes()], [ngram_join.bitmap(y).tobytes()])[0]
        assert differing <= len(x) + len(y) - 2 * both
        if 100 * both >= 75 * (len(x) + len(y) - both):
            assert ngram_join.may_link(len(x), len(y), int(differing), 75, min(len(x), len(y)))
            ranks = rng.integers(0, 4, ngram_join.CELLS).astype(np.uint8)
            assert len(np.intersect1d(ngram_join.prefix(x, ranks, 75), ngram_join.prefix(y, ranks, 75)))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score long, v string")


def test_top_k_equals_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 7)
    monkeypatch.setattr(topk, "BLOCKS_PER_PASS", 2)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5]) for _ in range(3)], 0, 1, "v") for i in range(0, 900, 7)] + [(i, [0.1, 0.2, 0.3], 0, 1, "v") for i in range(1, 90)]
    rows += [(700, [0.5, 0.5, 0.5], 0, 1, "v"), (100, [1.5, -2.0], 0, 1, "v"), (3, [2.0, 1.0], 0, 1, "v")]
    rows += [(None, [0.1, 0.1, 0.1], 0, 1, "v"), (200, None, 0, 1, "v"), (300, [], 0, 1, "v"), (400, [float("nan"), 0.0, 0.0], 0, 1, "v"), (500, [None, 0.0, 0.0], 0, 1, "v"), (600, [float("inf"), 0.0, 0.0], 0, 1, "v")]
    for size in (1, 2048):
        got = sorted(tuple(r) for r in top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, query_block=size).collect())
        assert got == brute.top_k([(i, v) for i, v, *_ in rows])


def test_rows_of_one_id_are_candidates_of_each_other(spark):
    rows = [(100, [1.0, 0.0], 0, 1, "v"), (100, [0.5, 0.0], 0, 1, "v"), (3, [0.25, 0.0], 0, 1, "v"), (100, [1.0, 0.0], 0, 1, "v")]
    got = sorted(tuple(r) for r in top_k(vectors(spark, rows).repartition(3), F.col("vec_id") % 100 == 0).collect())
    assert got == brute.top_k([(i, v) for i, v, *_ in rows]) and len(got) == 9


def test_many_query_blocks_are_released(spark, monkeypatch):
    """Blocks are sent a few at a time, and one pass at a time is held."""
    held, most = set(), []
    broadcast = type(spark.sparkContext).broadcast

    def counted(self, value):
        sent = broadcast(self, value)
        held.add(sent)
        most.append(len(held))
        destroy = sent.destroy
        sent.destroy = lambda *a: (held.discard(sent), destroy(*a))
        return sent

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    monkeypatch.setattr(topk, "BLOCKS_PER_PASS", 2)
    rows = [(100 * i, [float(i % 9), 1.0], 0, 1, "v") for i in range(12)]
    assert top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, query_block=2).count() == 120
    assert len(most) == 3 and max(most) == 1 and not held


def test_top_k_of_huge_components_and_of_nothing(spark):
    rows = [(0, [3e8, 1.0], 0, 1, "v"), (1, [2e8, 1.0], 0, 1, "v"), (2, [-2e8, 0.5], 0, 1, "v")]
    floats = [(i, [float(np.float32(x)) for x in v]) for i, v, *_ in rows]
    want = [(q, r, j, min(max(s, -(2**63)), 2**63 - 1)) for q, r, j, s in brute.top_k(floats)]
    assert sorted(tuple(r) for r in top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()) == want
    assert top_k(vectors(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    assert top_k(vectors(spark, rows[:1]), F.col("vec_id") % 100 == 0).collect() == []


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    for _ in range(40):
        text = rng.integers(0, 4, int(rng.integers(1, 80)))
        n, zeros = len(text), int((text == 0).sum())
        place = iter(range(zeros))
        key = [(next(place) if x == 0 else x + zeros) for x in text]
        assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: key[i:])
    text = np.array([0, 1, 2, 1, 2, 3, 0, 2, 1, 2, 0])
    index = FMIndex(text, 3)
    phrases = Phrases([])
    phrases.length, phrases.symbols = np.array([2, 1, 3]), np.array([[0, 1, 2], [0, 0, 3], [3, 3, 3]])
    which, lo, hi = index.search(phrases)
    places = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
    assert places == {0: [1, 3, 8], 1: [5]}


ITEMS = [
    (3, "the quick brown fox jumps over the lazy dog and runs far away from the old house"),
    (11, "Short item, only five words"),
    (12, "SHORT item only: five words"),
    (20, None),
    (21, " .. "),
    (None, "no id for this one"),
    (30, "the quick brown fox jumps over the lazy dog and runs far away to sea"),
]


def contaminated_docs():
    rng = random.Random(4)
    filler = lambda n: [rng.choice(["the", "fox", "lazy", "alpha", "beta", "dog"]) for _ in range(n)]
    docs = []
    for i in range(60):
        parts = filler(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            w = ITEMS[rng.choice([0, 1, 2, 6])][1].split()
            a = rng.randint(0, 4)
            parts += w[a : rng.randint(a, len(w))] + filler(rng.randint(0, 5))
        docs.append((100 + i, "-".join(parts) if i % 2 else "\n".join(parts).upper()))
    return docs


def spans_hold(rows):
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


@pytest.mark.parametrize("block", [1_000_000, 8])
def test_contamination_equals_brute_force(spark, documents, monkeypatch, block):
    """With one block of items, and with a block for each item."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs = contaminated_docs() + ODD_TEXTS
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id bigint, text string, spans int")
    rows = find_benchmark(documents(docs), benchmark).collect()
    spans_hold(rows)
    key = lambda r: (r[0] is None, r)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows), key=key)
    assert got == sorted(brute.contamination(docs, [(i, t) for i, t in ITEMS if i is not None]), key=key)


def test_contamination_without_items_or_documents(spark, documents, none):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    rows = find_benchmark(documents([(1, "a b")]), benchmark).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in rows] == [(2, 0, False)]
    assert find_benchmark(none, benchmark).collect() == []
