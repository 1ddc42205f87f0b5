"""Filter audit against a plain version, radix tries, adaptive prefixes."""

import itertools
import random
import re
from collections import Counter

import pytest

from relayspark.llm import filter_audit
from relayspark.llm.filter_audit import TextTrie, adaptive_prefix, audit_filters, filter_masks
from tests.llm.conftest import ODD_TEXTS


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def audit(docs, labels):
    """{(part, order, step): counts} of rows (doc_id, text, lang)."""
    label = {}
    for i, quality, toxic in labels:
        if i is not None:
            good, bad = label.get(i, (False, False))
            label[i] = (good or quality == 1, bad or toxic == 1)
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        f = fails(t or "")
        f["E"] = i is not None and i > least[t or ""]
        rows.append((lang or "", {k for k, v in f.items() if v}, *label.get(i, (False, False))))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in mine) - len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), redundant, sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
                left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in rows}
    assert len(found) == len(rows)
    return found


LABELS = "doc_id bigint, quality int, toxic int, lang string"


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], LABELS)


def make_docs(seed=0, n=400):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = [rng.choice(["ab", "Cde", "fgh", "$", "XYZ", "i", "jklm", f"w{rng.randint(0, 300)}"]) for _ in range(rng.choice([0, 1, 5, 180, 260]))]
        texts.append(rng.choice(["", " ", "\n"]).join(["", " ".join(words)]))
    texts += ["head " * 50 + t for t in texts[:20]]
    rows = [(rng.randint(0, 300), rng.choice([*texts, None]), rng.choice(["en", "fr", "", None])) for _ in range(n)]
    return rows + [(None, texts[0], "en"), (None, None, None), (7, texts[0], "en"), (7, texts[0], "fr"), (7, texts[0], "en"), (-3, "", "de")]


def test_audit_equals_plain_version(documents, labels):
    docs = make_docs()
    marks = [(i, random.Random(i).choice([0, 1, None]), random.Random(i + 1).choice([0, 1])) for i in range(0, 300, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1)]
    assert got(audit_filters(documents(docs).repartition(5), labels(marks))) == audit(docs, marks)


def test_small_tries_and_one_partition_give_the_same(documents, labels, monkeypatch):
    """Tries that are cut everywhere, between all neighbours."""
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 1)
    docs = make_docs(3)
    assert got(audit_filters(documents(docs).coalesce(1), labels([]))) == audit(docs, [])


def test_odd_rows_and_empty_tables(documents, odd, none, labels):
    docs = [(i, t, None) for i, t in ODD_TEXTS]
    assert got(audit_filters(odd, labels([(1, 1, 0)]))) == audit(docs, [(1, 1, 0)])
    assert got(audit_filters(none, labels([]))) == {}


def test_text_ids(spark, labels):
    docs = spark.createDataFrame([("a", "same", "en"), ("b", "same", "en"), ("a", "same", "en"), (None, "same", "en")], "doc_id string, text string, lang string")
    masks = {(r["id"], r["mask"] >> 4): r["n"] for r in filter_masks(docs).groupBy("id", "mask").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert masks == {("a", 0): 2, ("b", 1): 1, (None, 0): 1}


def test_trie_terminals():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(3000)]
    trie, places = TextTrie(), {}
    for i, t in enumerate(texts):
        assert trie.terminal(t, i)[0] == places.setdefault(t, i)
    assert sorted(e[0] for e in trie.terminals()) == sorted(places.values())

    def shape(node, top=True):
        # Every inner node but the root ends a text or has two children at least.
        assert top or node[2] is not None or len(node[1]) > 1
        for first, child in node[1].items():
            assert child[0][0] == first
            shape(child, False)

    shape(trie.root)


def test_heavy_prefixes_are_cut_further(spark):
    """A long head that all texts share does not lead to one partition."""
    rows = spark.range(2000).selectExpr("concat(repeat('the same head ', 300), id) AS text")
    cut = rows.withColumn("prefix", adaptive_prefix(rows, 8))
    dealt = cut.repartitionByRange(8, "prefix").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 600


def test_copies_shrink_before_the_shuffle(spark):
    """One text in two thirds of all rows: one row of each trie goes on."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('own ', id), 'a copied text') AS text", "'en' AS lang").repartition(6)
    masks = filter_masks(docs)
    assert masks.where("mask >= 16").agg({"n": "sum"}).first()[0] == 1999
