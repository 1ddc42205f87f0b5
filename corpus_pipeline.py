"""Corpus pipeline: documents to training ids, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. Every row that a stage
keeps goes on whole; all stages but the last return the columns of documents.

1. toxicity: documents that the classifier rejects go; it learns from the labels
   of the rows given (of their crc32 folds 0 and 2).
2. near_duplicates: of each component of rows that link (five-word shingles,
   similarity of 0.75 or more), one row stays: that of the smallest id (rows
   without an id come last), then of the least hash of its text. Rows without
   words have empty sets and stay; of equal rows of one id, one.
3. decontamination: rows whose text the benchmark contaminates go.
4. secrets: spans of secrets are replaced by a mark, and n_chars is counted anew;
   no document goes.
5. pieces: each document's SentencePiece ids.

Defined results: null texts pass stages 1 to 4 as they are and have no ids; empty
tables give empty results; additional columns go through stages 1 to 4;
rows are judged by id and text, so that rows of one id with other texts and rows
without an id have verdicts of their own; of rows of equal id and text that differ in
other columns, stage 2 keeps the one of least hash; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relayspark.llm.common import fold, read, shared_dir
from relayspark.llm.decontaminate import find_benchmark
from relayspark.llm.ngram_join import jaccard_components
from relayspark.llm.pieces import encode_pieces
from relayspark.llm.queries import tokenizer_path
from relayspark.llm.secret_scan import redact, scan_secrets
from relayspark.llm.toxicity import fit, score_toxicity
from relayspark.session import configure


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns under numbers: no name that a stage adds can clash with them."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, id, text_hash): each row whole, with what decisions name it by."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    model = fit(docs, read(spark, sf_dir, "labels"), fold("id", 3) != 1)
    scored = score_toxicity(_numbered(docs), model, text_col=f"c{docs.columns.index('text')}")
    return scored.where("predicted = 0").drop("score", "predicted").toDF(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows but those whose id and text are among (doc_id, text_hash)."""
    named = gone.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_text")).distinct()
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_text"))
    return _keyed(docs).join(named, same, "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    found = jaccard_components(docs.select("doc_id", "text"))
    # The first row of a component is named by id and hash; others go.
    kept = _keyed(_without(docs, found.where("not (component_id <=> doc_id and component_hash = text_hash)")))
    # Without an id and words nothing says that rows are copies: each is its own.
    wordless = F.col("id").isNull() & ~F.coalesce(F.col("row.text").rlike("[^ \\t-\\r]"), F.lit(False))
    once = Window.partitionBy("id", "text_hash").orderBy(F.xxhash64("row"))
    copies = kept.where(~wordless).select("row", F.row_number().over(once).alias("place")).where("place = 1")
    return copies.select("row").union(kept.where(wordless).select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    found = find_benchmark(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    found = scan_secrets(docs.select("doc_id", "text"))
    spans = found.where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_text")).agg(F.first("spans").alias("spans"))
    joined = _keyed(docs).join(spans, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_text")), "left")
    hit = F.col("spans").isNotNull()
    clean = joined.select("row", "spans", F.when(hit, redact(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text")).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(hit, F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return clean.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    encoded = encode_pieces(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("piece_ids").cast("long").alias("n_ids"), "piece_ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pieces", pieces),
]

#: Stages 1 and 5 (a trained network, a subword vocabulary) have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = shared_dir(spark, "corpus-pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i + 1}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
