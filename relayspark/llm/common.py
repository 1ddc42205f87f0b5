"""Helpers shared by the corpus operators: table reads, fold rule, word splits.

Words are split with Arrow kernels over whole text columns, so that Python sees
arrays of word codes and never a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relayspark.session import materialize, shared_dir

__all__ = ["fold", "materialize", "read", "shared_dir", "slices", "split_words", "text_rows", "word_codes"]

#: Text bytes that one pass over Arrow kernels works on; bounds a task's memory.
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split of learning and held-out rows."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names: other columns can't clash."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each
    (one row at least)."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts: (all words, row of each word)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), rows.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)


def word_codes(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, code of each word)."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
