"""Delivery checks (V-01 .. V-06) as reconciliation queries over a topic table.

A topic table has ``topic_col`` (default ``dest_topic``), ``partition``,
``offset``, ``key``, ``payload`` and ``headers``. Every check is an aggregate
with a partial form or a bounded per-topic top-n, so a hot topic never lands
whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relayspark.functions.message import utf8_text
from relayspark.functions.strict_json import with_strict_json
from relayspark.session import materialize

# Parts that a topic's messages are cut into before its first n are ranked.
TOP_N_SALTS = 256


def _expectations(df: DataFrame, expected, value_name: str) -> DataFrame:
    if isinstance(expected, DataFrame):
        return expected
    rows = [(k, v) for k, v in dict(expected).items()]
    return df.sparkSession.createDataFrame(rows, f"topic string, {value_name} bigint")


def check_counts(df: DataFrame, expected, topic_col: str = "dest_topic") -> DataFrame:
    """V-01: message count per topic equals the expectation (topics of both
    sides appear; a missing side counts 0)."""
    actual = df.groupBy(F.col(topic_col).alias("topic")).agg(F.count(F.lit(1)).alias("actual_count"))
    exp = _expectations(df, expected, "expected_count")
    j = actual.join(exp, "topic", "full_outer")
    a = F.coalesce("actual_count", F.lit(0)).cast("bigint")
    e = F.coalesce("expected_count", F.lit(0)).cast("bigint")
    return j.select("topic", a.alias("actual_count"), e.alias("expected_count"), (a == e).alias("ok"))


def check_contains(df: DataFrame, text: str, topic_col: str = "dest_topic") -> DataFrame:
    """V-02: per topic, does some message payload contain ``text``; with the
    number that do."""
    hit = F.coalesce(F.contains(utf8_text("payload"), F.lit(text)), F.lit(False))
    return df.groupBy(F.col(topic_col).alias("topic")).agg(
        F.bool_or(hit).alias("found"), F.count_if(hit).alias("matching")
    )


def check_header(df: DataFrame, key: str, value: str, topic_col: str = "dest_topic") -> DataFrame:
    """V-03: per topic, does some message carry header ``key`` = ``value``."""
    hit = F.coalesce(F.col("headers").getItem(key) == F.lit(value), F.lit(False))
    return df.groupBy(F.col(topic_col).alias("topic")).agg(
        F.bool_or(hit).alias("found"), F.count_if(hit).alias("matching")
    )


def first_n(df: DataFrame, n: int, topic_col: str = "dest_topic", order: Sequence[str] = ("partition", "offset")) -> DataFrame:
    """V-06: the first ``n`` messages of each topic by ``order``, with ``rank``.

    Each topic is cut into parts by a hash of the message; the first ``n`` of
    each part are ranked, then the first ``n`` of the topic, so a hot topic's
    messages are never sorted in one task. The result is exact.
    """
    ordering = [F.col(c).asc_nulls_first() for c in order]
    # Ties (sources without partitions or offsets) are broken by the message
    # itself, so that a retried task ranks the same rows first.
    ties = [c for c in ("timestamp", "key") if c in df.columns and c not in order]
    ordering += [F.col(c).asc_nulls_first() for c in ties]
    if "payload" in df.columns:
        ordering.append(F.xxhash64("payload").asc())
    salt = F.pmod(F.xxhash64(*order, *ties, *(["payload"] if "payload" in df.columns else [])), F.lit(TOP_N_SALTS))
    parts = Window.partitionBy(topic_col, "__salt").orderBy(*ordering)
    df = df.withColumn("__salt", salt).withColumn("__place", F.row_number().over(parts)).filter(F.col("__place") <= n).drop("__salt", "__place")
    w = Window.partitionBy(topic_col).orderBy(*ordering)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def check_order(
    df: DataFrame,
    expected,
    topic_col: str = "dest_topic",
    order: Sequence[str] = ("partition", "offset"),
    n: int | None = None,
) -> DataFrame:
    """V-04: the first messages of each topic arrive in the expected order.

    ``expected`` maps topic -> list of payload texts, or is a DataFrame
    ``(topic, expected array<string>)`` (one row per checked topic). The first
    ``len(expected)`` messages of each topic by ``order`` are compared with it.
    ``n`` bounds the expected lengths; for a DataFrame without it, the
    expectations are materialized once and their longest list is read.
    """
    if isinstance(expected, DataFrame):
        exp = expected.select("topic", "expected")
        if n is None:
            exp = materialize(exp)
            n = exp.select(F.max(F.size("expected"))).first()[0] or 0
    else:
        n = n or max((len(v) for v in expected.values()), default=0)
        exp = df.sparkSession.createDataFrame(
            [(t, list(v)) for t, v in expected.items()], "topic string, expected array<string>"
        )
    head = first_n(df, int(n), topic_col, order)
    got = head.groupBy(F.col(topic_col).alias("topic")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", utf8_text("payload").alias("v")))), lambda s: s["v"]
        ).alias("actual")
    )
    # One row per checked topic on each side, but a row holds n texts: no
    # hint, AQE picks a broadcast at run time only when the measured size is
    # under its threshold.
    j = exp.join(got, "topic", "left")
    actual = F.slice(F.coalesce("actual", F.array().cast("array<string>")), 1, F.size("expected"))
    return j.select("topic", "expected", actual.alias("actual"), (actual == F.col("expected")).alias("ok"))


def check_equal(df: DataFrame, expected, topic_col: str = "dest_topic") -> DataFrame:
    """V-05: per topic, how many messages equal ``expected``. A dict/list is
    compared as JSON (same value, any spacing or key order); a string by text."""
    text = utf8_text("payload")
    if isinstance(expected, (dict, list)):
        import json

        want = json.dumps(expected)
        df = with_strict_json(df, text, "__eq_j", objects_only=False)
        canon_want = F.to_json(F.parse_json(F.lit(want)))
        hit = F.coalesce(F.to_json(F.col("__eq_j")) == canon_want, F.lit(False))
    else:
        hit = F.coalesce(text == F.lit(str(expected)), F.lit(False))
    return df.groupBy(F.col(topic_col).alias("topic")).agg(
        F.count_if(hit).alias("matching"), F.bool_or(hit).alias("found")
    )


def bounded_read(df: DataFrame, n: int, topic_col: str = "dest_topic") -> DataFrame:
    """V-06: read at most ``n`` messages of each topic, first by (partition, offset)."""
    return first_n(df, n, topic_col)
