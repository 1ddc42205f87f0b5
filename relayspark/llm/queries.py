"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayspark.llm import language, toxicity
from relayspark.llm.common import fold, read
from relayspark.llm.decontaminate import find_benchmark
from relayspark.llm.disclosure import KINDS, find_personal_data
from relayspark.llm.filter_audit import audit_filters
from relayspark.llm.lm_score import lm_scores
from relayspark.llm.ngram_join import jaccard_components
from relayspark.llm.pieces import decode_pieces, encode_pieces
from relayspark.llm.prefix_trie import rebuilt_paths, trie_nodes, turn_paths
from relayspark.llm.secret_scan import BASE_KINDS, base_digest, scan_secrets
from relayspark.llm.token_files import token_table
from relayspark.llm.topk import top_k
from relayspark.llm.url_filter import filter_urls
from relayspark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return run

    return wrap


@register()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs, fold("id", 4) != 2)
    return language.identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@register()
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register()
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


@register()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold("id", 3) != 1)
    return toxicity.score_toxicity(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@register()
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # The tokenizer's own marks of start and end of a text.
    return lm_scores(docs, fold("id", 7) == 2, tokenizer_path("word_bpe_49k.json"), start_id=49406, end_id=49407)


# Fixed values of the contract: host, path and verdict of each rule.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@register(
    r"""
    WITH rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    rest AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    parts AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    fits AS (SELECT n, page_id, host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
             FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
    SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM fits WHERE k = 1
    """
)
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("host", "path", "verdict")
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, r))) for r in URL_RULES))))
    return filter_urls(read(spark, sf_dir, "pages"), rules)


@register()
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [k for k, *_ in BASE_KINDS]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = base_digest(F.col("spans"), kinds)
    return scan_secrets(read(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, kinds), F.sha2(base, 256).alias("base_sha256"), base_digest(F.col("spans")).alias("spans")
    )


@register(
    """
    WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.n <> c.n AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """
)
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


@register()
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text (count and hash), and whether they decode to it."""
    model = tokenizer_path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode_pieces(encode_pieces(docs, model), model)
    return back.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_ids"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


@register(
    r"""
    WITH one AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 CASE WHEN len(w) < 200 THEN 1 ELSE 0 END AS a,
                 CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 1 ELSE 0 END AS b,
                 CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 1 ELSE 0 END AS c,
                 CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
                 CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 1 ELSE 0 END AS e
          FROM d LEFT JOIN one USING (doc_id)),
    f AS (SELECT part, [a, b, c, d, e] AS v, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
    l(x) AS (VALUES (1), (2), (3), (4), (5)),
    o AS (SELECT [p.x, q.x, r.x, s.x, u.x] AS ord FROM l p, l q, l r, l s, l u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
    steps AS (SELECT array_to_string(list_transform(ord, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, x AS step, ord[x] AS own, ord[1:x - 1] AS before FROM o, l),
    j AS (SELECT part, filter_order, step, v[own] = 1 AS fails, len(list_filter(before, lambda i: v[i] = 1)) > 0 AS gone, list_sum(v) = 1 AS alone, n, good, toxic, own FROM f, steps),
    r AS (SELECT part, filter_order, step, any_value(own) AS own, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
                 CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
                 CAST(coalesce(sum(n) FILTER (fails AND alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
                 CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
          FROM j GROUP BY part, filter_order, step)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
    """
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register(
    r"""
    WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS w
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    h AS (SELECT conv_id, w, conv_id - conv_id % 5 AS base,
                 xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
                     lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)::UBIGINT[]),
                     lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)), 4294967295::UBIGINT) % 9 AS h FROM t),
    s AS (SELECT h.conv_id, list_concat(coalesce(b.w[1:h], []), h.w[h + 1:]) AS s FROM h LEFT JOIN t b ON b.conv_id = h.base),
    m AS (SELECT conv_id, d, sha256(CAST(to_json(s[1:d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN sha256(CAST(to_json(s[1:d - 1]) AS VARCHAR)) END AS pk,
                 CASE WHEN d > 0 THEN strlen(s[d].x) ELSE 0 END AS size, d = len(s) AS fin FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM s)),
    n AS (SELECT k, any_value(d) AS depth, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (fin), '')) AS ends_sha256 FROM m GROUP BY k),
    c AS (SELECT pk AS k, count(*) AS n_children FROM n WHERE pk IS NOT NULL GROUP BY pk),
    a AS (SELECT m.k, sum((n.n_convs - 1) * n.size) AS saved_tokens, count(*) FILTER (c.k IS NULL) AS n_leaves
          FROM n LEFT JOIN c ON c.k = n.k JOIN m ON m.conv_id = n.conv_id AND m.d <= n.depth GROUP BY m.k)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, a.n_leaves,
           CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM n JOIN a USING (k) LEFT JOIN c USING (k) LEFT JOIN n p ON p.k = n.pk
    """
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(rebuilt_paths(turn_paths(read(spark, sf_dir, "conversations"))))


@register()
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = base_digest(F.col("spans"), KINDS)
    return find_personal_data(read(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), base_digest(F.col("spans")).alias("spans")
    )
