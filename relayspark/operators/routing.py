"""Routing operators (F-01 .. F-08, S-07).

Every router is narrow: a projection (fan, funnel) or a lookup that never
shuffles the message side (one-to-one through a literal map or a broadcast of a
size-checked route table). Rows therefore stay in their input partitions, keep
their (partition, offset) order, and cross no shuffle until a metrics
aggregate.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.functions.message import message_size_sql
from relayspark.functions.strict_json import json_key, json_key_route, object_gate, with_strict_json
from relayspark.schema import MESSAGE_COLUMNS
from relayspark.session import materialize

log = logging.getLogger(__name__)

# Route tables (restricted to the topics that the messages have) up to this many
# rows and bytes of topic names are broadcast; larger ones are joined by shuffle.
BROADCAST_ROUTE_LIMIT = 100_000
BROADCAST_ROUTE_BYTES = 16 << 20
# A topic with at least one part in so many of all messages is hot: in the shuffle
# join, its messages go to as many tasks as it has such parts.
HOT_PARTS = 32


def prepare(df: DataFrame) -> DataFrame:
    """Measure each message before any processing (source side of metrics).

    ``source_size`` is NULL and ``error`` is set when the message cannot be
    measured: a null payload (Q-05), a null header value, or an ingest error
    already set by a normaliser (Q-08).
    """
    prior = "error" if "error" in df.columns else "CAST(NULL AS STRING)"
    df = df.withColumns({"__size": F.expr(message_size_sql()), "__prior": F.expr(prior)})
    error = F.expr(
        "coalesce(__prior, CASE WHEN payload IS NULL THEN 'null payload' "
        "WHEN __size IS NULL THEN 'invalid header' END)"
    )
    skip = set(MESSAGE_COLUMNS) | {"__size", "__prior", "error", "source_size", "dest_topic", "delivery_error"}
    extra = [c for c in df.columns if c not in skip]
    return df.select(
        *MESSAGE_COLUMNS,
        *extra,
        F.expr("CASE WHEN __prior IS NULL THEN __size END").alias("source_size"),
        error.alias("error"),
    )


def _finish(df: DataFrame, dest: Column) -> DataFrame:
    """Attach the destination; errored rows get none (they are never delivered)."""
    return df.withColumns(
        {"dest_topic": F.when(F.col("error").isNull(), dest), "delivery_error": F.lit(None).cast("string")}
    )


def funnel(sources: Iterable[DataFrame], destination_topic: str) -> DataFrame:
    """F-01: every message of every source to one topic (UNION ALL, no dedup)."""
    frames = [s.select(*MESSAGE_COLUMNS, *[c for c in s.columns if c == "error"]) for s in sources]
    if not frames:
        raise ValueError("funnel needs at least one source")
    if any("error" in f.columns for f in frames):
        frames = [f if "error" in f.columns else f.withColumn("error", F.lit(None).cast("string")) for f in frames]
    union = reduce(lambda a, b: a.unionByName(b), frames)
    return _finish(prepare(union), F.lit(destination_topic))


def resolver_expr(df: DataFrame, resolver: Mapping[str, str]) -> tuple[DataFrame, Column]:
    """Column expression for a fan resolver ``{type, key}`` (F-02 .. F-04)."""
    if "type" not in resolver or "key" not in resolver:
        # Q-07: a missing field is a plan-time error, not a per-message failure.
        raise ValueError(f"resolver needs 'type' and 'key': {dict(resolver)!r}")
    kind, key = resolver["type"], resolver["key"]
    if kind == "header":
        return df, F.coalesce(F.col("headers").getItem(key), F.lit("default"))
    if kind == "payload_key":
        df = with_strict_json(
            df, "try_validate_utf8(CAST(payload AS STRING))", "__route_json", objects_only=True, gate=object_gate()
        )
        df = df.withColumn("__route_member", json_key("__route_json", key))
        return df, json_key_route("__route_member")
    log.warning("Unknown resolver type %r: every message goes to 'default'", kind)
    return df, F.lit("default")


def fan(df: DataFrame, resolver: Mapping[str, str]) -> DataFrame:
    """F-02 .. F-04: one source to many topics, chosen from message content.

    ``{"type": "header", "key": k}``: the header's value, ``'default'`` when absent
    (an empty value routes to ``''``). ``{"type": "payload_key", "key": k}``: the
    top-level JSON member (JSON text for non-strings, NULL for a JSON null),
    ``'default'`` when absent or when the payload is not one JSON object.
    """
    routed = prepare(df)
    routed, dest = resolver_expr(routed, resolver)
    out = _finish(routed, dest)
    return out.drop(*[c for c in out.columns if c.startswith("__route")])


def _route_pairs(routes) -> dict[str, str]:
    """F-06: a repeated source topic keeps its last destination."""
    if isinstance(routes, Mapping):
        return dict(routes)
    table: dict[str, str] = {}
    for src, dst in routes:
        table[src] = dst
    return table


def subscribe(df: DataFrame, topics: Iterable[str]) -> DataFrame:
    """S-07: keep only the subscribed topics (pushed to the scan; prunes topic partitions)."""
    return df.filter(F.col("topic").isin(list(topics)))


def route_table(routes: DataFrame) -> DataFrame:
    """F-06 for a DataFrame route table, computed once: with a ``pos`` column the
    last row per source topic wins; rows of one ``pos`` that name different
    destinations, or a repeated source topic without ``pos``, have no defined
    winner and are refused."""
    if "pos" in routes.columns:
        named = F.coalesce(F.concat(F.lit("t"), "destination_topic"), F.lit(""))
        at = routes.groupBy("source_topic", "pos").agg(F.min("destination_topic").alias("destination_topic"), F.min(named).alias("a"), F.max(named).alias("b"))
        # A null position comes before all others.
        last = at.groupBy("source_topic").agg(F.max(F.struct("pos", "a", "b", "destination_topic")).alias("r"))
        table = materialize(last.select("source_topic", "r.destination_topic", (F.col("r.a") != F.col("r.b")).alias("tie")))
        if table.where("tie").limit(1).count():
            raise ValueError("the route table has rows of one source topic and one 'pos' with different destinations")
        return table.drop("tie")
    table = materialize(routes.select("source_topic", "destination_topic").distinct())
    if table.groupBy("source_topic").count().where("count > 1").limit(1).count():
        raise ValueError("the route table repeats a source topic; give it a 'pos' column (the last one wins)")
    return table


def one_to_one(df: DataFrame, routes, broadcast_limit: int = BROADCAST_ROUTE_LIMIT) -> DataFrame:
    """F-05: look the destination up by source topic; unmapped messages are
    skipped before they are counted (Q-06).

    ``routes`` is a mapping / list of pairs (compiled into a literal map and an
    ``IN`` filter, so there is no join and the filter reaches the scan) or a
    DataFrame ``(source_topic, destination_topic[, pos])``. A DataFrame table is
    restricted to the topics that stored messages have (one aggregate over the
    topic column) and broadcast when it is within ``broadcast_limit`` rows and
    BROADCAST_ROUTE_BYTES; messages then stay in their partitions. Beyond that
    it is a shuffle join in which hot topics are salted; messages of a partition
    then spread over tasks, and only ``topic_rows`` restores their order within
    each file.
    """
    if not isinstance(routes, DataFrame):
        table = _route_pairs(routes)
        if not table:
            return _finish(prepare(df.filter(F.lit(False))), F.lit(None).cast("string"))
        lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        kept = subscribe(df, table.keys())
        return _finish(prepare(kept), F.element_at(lookup, F.col("topic")))

    table = route_table(routes).withColumnsRenamed({"source_topic": "topic", "destination_topic": "__dest"})

    def size() -> tuple[int, int]:
        names = F.coalesce(F.sum(F.octet_length("topic") + F.octet_length("__dest")), F.lit(0))
        return tuple(table.agg(F.count("*"), names).first())

    within = lambda s: s[0] <= broadcast_limit and s[1] <= BROADCAST_ROUTE_BYTES
    small = within(size())
    hot: dict[str, int] = {}
    if not small and not df.isStreaming:
        counts = materialize(df.groupBy("topic").agg(F.count("*").alias("n")))
        table = materialize(table.join(counts.select("topic"), "topic", "left_semi"))
        small = within(size())
        # At most HOT_PARTS topics have so large a share.
        shares = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
        hot = {r["topic"]: r["parts"] for r in shares.select("topic", F.floor(F.col("n") * HOT_PARTS / F.col("total")).alias("parts")).where("parts > 1").collect()}
    if small:
        joined = df.join(F.broadcast(table), "topic", "inner")
    else:
        parts = F.lit(1)
        if hot:
            parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col("topic")), F.lit(1))
        # The part is a hash of the message itself, so that a retried task routes the same way.
        part = F.pmod(F.xxhash64("partition", "offset", "key", "timestamp", "payload"), parts).cast("int")
        copies = table.withColumn("__part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
        joined = df.withColumn("__part", part).join(copies, ["topic", "__part"], "inner").drop("__part")
    return _finish(prepare(joined), F.col("__dest")).drop("__dest")
