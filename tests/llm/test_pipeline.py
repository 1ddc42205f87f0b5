"""The corpus pipeline, stage by stage, over a small table with planted cases."""

import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import DOCS, ODD_TEXTS


def planted():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8)))
    text = lambda n=80: [word() for _ in range(n)]
    items = [(i, " ".join(text(20))) for i in range(3)]
    docs, labels = [], []
    for i in range(240):
        words = text()
        if i % 3 == 0:
            for _ in range(3):
                words[rng.randrange(80)] = rng.choice(["zorgblat", "vilestuff"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    near = docs[1][1].split()
    near[40] = "changed"
    docs += [(1001, " ".join(near)), (1002, docs[1][1]), (1003, docs[1][1]), (1003, docs[1][1])]
    docs.append((2000, " ".join(text(30)) + " " + items[1][1]))
    docs.append((3000, " ".join(text(30)) + " password=abcdef0123 " + " ".join(text(5))))
    return docs, labels, items


def test_stages(spark, tmp_path):
    docs, labels, items = planted()
    sf = str(tmp_path)
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 1, "x", 2, 3) for i, t in docs + [(i and 9000 + i, t) for i, t in ODD_TEXTS]]
    table = spark.createDataFrame(rows, DOCS)
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    held, sizes = table, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, sf)
        path = f"{sf}/stage-{name}"
        out.write.parquet(path)
        held = spark.read.parquet(path)
        sizes[name] = {r["doc_id"]: r for r in held.collect()}
        if name != "pieces":
            assert held.columns == table.columns
    toxic = {i for i in range(240) if i % 3 == 0}
    kept = sizes["toxicity"].keys()
    assert len(toxic & kept) <= 4 and len({i for i in range(240) if i % 3} - kept) <= 4
    # Of each component of what the first stage kept, the smallest id stays.
    components = brute.jaccard([(r["doc_id"], r["text"]) for r in sizes["toxicity"].values()])
    assert {i for i in sizes["near_duplicates"] if i is not None} == {i for i, (_, c) in components.items() if i == c}
    assert not {1001, 1002, 1003} & sizes["near_duplicates"].keys()
    assert set(sizes["near_duplicates"]) - set(sizes["decontamination"]) == {2000}
    assert "abcdef0123" not in sizes["secrets"][3000]["text"] and sizes["secrets"][3000]["n_chars"] == len(sizes["secrets"][3000]["text"])
    clean = [i for i in sizes["secrets"] if i not in (3000,)]
    assert [i for i in clean if sizes["secrets"][i]["text"] != sizes["decontamination"][i]["text"]] == []
    assert set(sizes["pieces"]) == set(sizes["secrets"]) and {9001, 9002, 9003} <= {i for i in sizes["pieces"] if i is not None}


def test_rows_of_one_id_and_rows_without_an_id_have_their_own_verdicts(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n=60: [rng.choice("abcdefgh") + str(rng.randrange(999)) for _ in range(n)]
    near = lambda words: " ".join([*words[:50], "changed", *words[51:]])
    a, b, c, d, item = text(), text(), text(), text(), text(20)
    full = {k: " ".join(v) for k, v in zip("abcd", (a, b, c, d))}
    dirty = " ".join(text(20) + item)
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 1, "x", 2, 3) for i, t in rows], DOCS)
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    rows = [(1, full["a"]), (3, near(a)), (3, full["b"]), (7, near(b)), (3, full["c"]), (9, near(c)), (None, full["d"]), (None, full["d"]), (5, full["d"]), (None, None), (None, None), (None, " "), (None, " ")]
    kept = left(corpus_pipeline.near_duplicates(spark, table(rows), str(tmp_path)))
    assert kept == sorted([(1, full["a"]), (3, full["b"]), (3, full["c"]), (5, full["d"]), (None, None), (None, None), (None, " "), (None, " ")], key=str)
    rows = [(4, full["a"]), (4, dirty), (None, dirty), (None, full["b"]), (6, None), (None, None)]
    kept = left(corpus_pipeline.decontamination(spark, table(rows), str(tmp_path)))
    assert kept == sorted([(4, full["a"]), (None, full["b"]), (6, None), (None, None)], key=str)


def test_stages_of_an_empty_table(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    held = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, held, sf).collect() == []


def test_columns_of_any_name(spark, tmp_path):
    """Names that stages or operators use themselves go through all stages."""
    docs, labels, items = planted()
    sf = str(tmp_path)
    more = "score double, documents_score double, predicted int, of_id long, of_text long, own_copy_number int, secret_spans string, spans string, row string, place int, id long, text_hash long, c0 string"
    rows = [(i, t, None, 0.25, 0.75, 3, 4, 5, 6, "a", "b", "c", 7, 8, 9, "d") for i, t in docs]
    held = spark.createDataFrame(rows, f"doc_id long, text string, n_chars int, {more}")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, sf)
        assert out.columns == held.columns
        out.write.parquet(f"{sf}/{name}")
        held = spark.read.parquet(f"{sf}/{name}")
    kept = held.collect()
    assert kept and {tuple(r)[3:] for r in kept} == {rows[0][3:]} and {r["doc_id"] for r in kept} >= {3000} and len(kept) == len({r["doc_id"] for r in kept})
