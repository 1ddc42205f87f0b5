"""Personal data: base matches, disclosure by counts, sanitised texts."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from relayspark.llm import disclosure as d
from relayspark.llm.disclosure import base_matches, find_personal_data, sanitised
from relayspark.llm.queries import op13_pii
from tests.llm.conftest import ODD_TEXTS

# The contract's patterns as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, x in enumerate(reversed(digits)):
        x = int(x) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_matches_equal_the_contracts_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@x", ".", "12", "255", "256", "007", "+", "+4", " ", "-", "(", ")", "é", "%", "_", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "a@b.c", "00000000000000", "\n", "+1 (555) 010-9999"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [m[:3] for m in base_matches(text)] == plain(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 100_000, "1 " * 100_000, "+" * 200_000, "@a" * 100_000, "+1" + "-" * 200_000, "1.2.3." * 50_000, "a@" + "b" * 200_000])
def test_long_runs_take_linear_time(text):
    base_matches(text)


def words_of(text):
    return [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^ \t-\r]+", text or "")]


def term(word):
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return re.sub("[A-Z]", lambda m: m[0].lower(), core) if len(core) >= 3 else None


def plain_terms(texts):
    """{text: [(start, end, replacement)]} by the definition, over all rows."""
    places = {}
    n_t, n_c, n_tc, n_g, members, n_fc, n_f, support = (defaultdict(set) for _ in range(8))
    kinds = {}
    for row, text in enumerate(texts):
        spans = base_matches(text)
        cut, seg = [], []
        for w in words_of(text):
            seg.append(w)
            if w[2][-1] in ".!?" or len(seg) == 64:
                cut.append(seg)
                seg = []
        places[text] = found = defaultdict(list)
        for seg in [*cut, seg]:
            mine = {term(w) for s, e, w in seg if term(w) and not any(s < b and a < e for _, a, b, _ in spans)}
            for s, e, w in seg:
                if not any(s < b and a < e for _, a, b, _ in spans):
                    found[term(w)].append((s, e))
                if term(w):
                    n_t[term(w)].add(row)
            for kind, a, b, entity in spans:
                if seg and seg[0][0] <= a < seg[-1][1]:
                    kinds[entity] = kind
                    n_c[entity].add(row)
                    for g in d.generalisations(kind, entity):
                        n_g[g].add(row)
                        members[g].add(entity)
                    for t in mine:
                        n_tc[t, entity].add(row)
                        support[t, entity].add(" ".join(w[2] for w in seg))
                        n_fc[general(t), entity].add(row)
                        n_f[general(t)].add(row)
    told = defaultdict(list)
    for (t, entity), common in n_tc.items():
        g = next(g for g in d.generalisations(kinds[entity], entity) if len(members[g]) >= d.GROUP or " " not in g)

        def discloses(both, alone):
            bits = math.log2(len(both) * len(n_g[g]) / (len(alone) * len(n_c[entity])))  # noqa: B023
            return bits >= d.EXCESS_BITS and math.log2(len(alone) / len(both)) <= d.RESIDUAL_BITS

        if len(support[t, entity]) >= d.SUPPORT and discloses(common, n_t[t]):
            told[t].append(not discloses(n_fc[general(t), entity], n_f[general(t)]))
    return {
        text: sorted((s, e, general(t) if all(told[t]) else "") for t, at in found.items() if t in told for s, e in at)
        for text, found in places.items()
    }


def general(t):
    return re.sub("[0-9]", "#", t) if re.search("[0-9]", t) else t[: max(3, len(t) // 2)] + "*"


def corpus(seed=0):
    """Mailboxes of one domain, some with a name, a number or a word that goes
    with them; other texts with and without these words."""
    rng = random.Random(seed)
    common = ["the", "and", "letter", "answer", "reads", "often", "writes", "today"]
    texts = []
    for i in range(30):
        for k in range(rng.randint(2, 7)):
            words = rng.sample(common, 4) + [f"box{i}@mail.example.com" if rng.random() < 0.9 else "10.2.3.4"]
            if i % 3 == 0:
                words.append(f"Quillfeather{'abcdefghij'[i // 3]}")
            if i % 5 == 0:
                words.append(f"AC-{4700 + i},")
            rng.shuffle(words)
            texts.append(" ".join([*words, f"n{k}{rng.choice(common)}."]))
    texts += [" ".join(rng.choices(common, k=9)) + "." for _ in range(60)]
    texts += ["Nobody knows Quillfeathera. The letter is AC-4705.", "box0@mail.example.com twice box0@mail.example.com"]
    texts += [texts[0]] * 20 + [" ".join(texts[5:9]), "", None]
    return list(enumerate(texts)) + [(None, texts[0]), (3, "another text, box3@mail.example.com"), (3, texts[3])]


def test_terms_equal_the_definition(documents):
    docs = corpus()
    want = plain_terms([t or "" for _, t in docs])
    assert {r[2] for v in want.values() for r in v} > {""} and any(want[t or ""] and not plain(t) for _, t in docs)
    found = find_personal_data(documents(docs).repartition(5)).collect()
    got = sorted((str(r["doc_id"]), r["text_hash"], [tuple(s) for s in r["spans"]]) for r in found)
    hashed = lambda t: 42 if t is None else (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    assert [(i, h) for i, h, _ in got] == sorted((str(i), hashed(t)) for i, t in docs)
    by = {(str(i), hashed(t)): t or "" for i, t in docs}
    for i, h, spans in got:
        text = by[i, h]
        assert [s[:3] for s in spans if s[0] != "term"] == plain(text)
        assert sorted(s[1:] for s in spans if s[0] == "term") == want[text], text


def test_copies_prove_nothing(documents):
    """A word beside an address in 50 copies of one sentence isn't telling."""
    docs = [(i, f"copy {i}. Zanzibar one@mail.example.com is here.") for i in range(50)]
    docs += [(100 + i, f"other{i}@mail.example.com writes.") for i in range(20)]
    assert {s["kind"] for r in find_personal_data(documents(docs)).collect() for s in r["spans"]} == {"email"}


def test_sanitised_texts(documents):
    docs = corpus(1)
    frame = documents(docs).where("doc_id is not null and doc_id <> 3").select("doc_id", "text")
    found = find_personal_data(frame).select(F.col("doc_id").alias("of"), "spans")
    out = {r["doc_id"]: r["clean"] for r in frame.join(found, F.col("doc_id") == F.col("of")).select("doc_id", sanitised(F.col("text"), F.col("spans")).alias("clean")).collect()}
    for i, t in docs:
        if i in out and t is not None:
            assert not plain(out[i])
    assert any("[email @mail.example.com]" in t for t in out.values() if t) and out[docs[-4][0]] is None
    one = frame.sparkSession.createDataFrame([("ab cd ef", [("ip", 0, 4, "x"), ("card", 3, 5, "y"), ("term", 6, 8, "")])], "text string, spans array<struct<kind:string,start:bigint,end:bigint,replacement:string>>")
    assert one.select(sanitised(F.col("text"), F.col("spans"))).first()[0] == "x "


def test_odd_rows_and_the_query(odd, none, tmp_path, spark):
    found = find_personal_data(odd).collect()
    assert len(found) == len(ODD_TEXTS) and not any(r["spans"] for r in found)
    assert find_personal_data(none).collect() == []
    docs = [(i, t, None) for i, t in corpus(2)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op13_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    texts = defaultdict(list)
    for i, t, _ in docs:
        texts[i].append(t)
    for r in rows:
        want = {hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(t)).encode()).hexdigest() for t in texts[r["doc_id"]]}
        assert r["base_sha256"] in want
        base = [s for s in r["spans"].split(",") if s and not s.startswith("term")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k) for s in base) for k in d.KINDS]
