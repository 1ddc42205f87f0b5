"""Loss and duplication by runs of offsets (M-12).

A count per topic hides one loss behind one duplicate. Here the offsets of a source
partition are folded into runs without a gap, on both sides, and the runs of one side
are subtracted from those of the other. Runs are few where little is lost, whatever
the number of messages.

Offsets are folded, and runs subtracted, per block of BLOCK offsets, so a partition that
holds a third of all messages is spread over as many tasks as it has blocks. Only runs
that touch the edge of their block can go on in the next one: these, two a block at most,
are joined afterwards, and all others stay with their block. So no task gets all runs of
a partition, even where every message is a run of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets folded by one task at a time.
BLOCK = 1 << 16
#: Tasks that blocks are dealt to, at least. Given as a number, so that adaptive
#: execution doesn't put partitions together until each core has one: windows hold
#: and sort what their task has.
TASKS = 64

_AT = ["topic", "partition"]


def _islands(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Rows numbered by island: a row begins one unless it touches those before."""
    along = Window.partitionBy(*keys).orderBy(first, last)
    reach = F.max(last).over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = (reach.isNull() | (F.col(first) > reach + 1)).cast("int")
    return df.withColumn("begins", begins).withColumn("island", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(max(TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _block(offset: str) -> Column:
    # Whole numbers: a quotient as a double is wrong for the largest offsets.
    return F.expr(f"({offset} - pmod({offset}, {BLOCK}L)) div {BLOCK}L")


def _across(pieces: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Islands of pieces (each within its ``block``) over all blocks: rows numbered by
    island within ``keys`` and ``lot``. A lot is one block's pieces between its edges, or
    (null) the pieces at edges of all blocks."""
    edge = (F.pmod(first, F.lit(BLOCK)) == 0) | (F.pmod(last, F.lit(BLOCK)) == BLOCK - 1)
    lots = _dealt(pieces.withColumn("lot", F.when(~edge, F.col("block"))).drop("block"), *keys, "lot")
    return _islands(lots, [*keys, "lot"], first, last)


def offset_runs(messages: DataFrame) -> DataFrame:
    """``(topic, partition, first_offset, last_offset, messages)``: runs of offsets
    without a gap, and the messages in each (more than its length where some came
    more than once). Messages without a partition or an offset have no place in a
    run and are left out."""
    placed = messages.where("partition IS NOT NULL AND offset IS NOT NULL").select(
        "topic", "partition", _block("offset").alias("block"), F.col("offset").alias("first"), F.col("offset").alias("last")
    )
    blocks = _islands(_dealt(placed, *_AT, "block"), [*_AT, "block"], "first", "last").groupBy(*_AT, "block", "island")
    runs = blocks.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n"))
    whole = _across(runs.drop("island"), _AT, "first", "last").groupBy(*_AT, "lot", "island")
    return whole.agg(F.min("first").alias("first_offset"), F.max("last").alias("last_offset"), F.sum("n").alias("messages")).drop("lot", "island")


def _cut(runs: DataFrame) -> DataFrame:
    """Runs as pieces (block, first, last), none longer than its block."""
    each = runs.withColumn("block", F.explode(F.sequence(_block("first_offset"), _block("last_offset"))))
    begin = F.col("block") * BLOCK
    return each.select(*_AT, "block", F.greatest("first_offset", begin).alias("first"), F.least("last_offset", begin + (BLOCK - 1)).alias("last"))


def run_differences(source: DataFrame, delivered: DataFrame) -> DataFrame:
    """``(topic, partition, first_offset, last_offset, kind)`` of what only one side
    has: ``lost`` (in the source's runs alone) or ``unexpected`` (delivered alone).
    Takes two tables of ``offset_runs``; topics are compared null-safe."""

    def bounds(runs: DataFrame, side: str) -> DataFrame:
        step = lambda at, n: F.struct(at.alias("at"), F.lit(n if side == "s" else 0).alias("s"), F.lit(n if side == "d" else 0).alias("d"))
        return _cut(runs).select(*_AT, "block", F.inline(F.array(step(F.col("first"), 1), step(F.col("last") + 1, -1))))

    both = _dealt(bounds(source, "s").unionByName(bounds(delivered, "d")), *_AT, "block")
    steps = both.groupBy(*_AT, "block", "at").agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
    along = Window.partitionBy(*_AT, "block").orderBy("at")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = steps.select(*_AT, "block", "at", F.sum("s").over(so_far).alias("s"), F.sum("d").over(so_far).alias("d"), (F.lead("at").over(along) - 1).alias("last"))
    kind = F.when(F.col("d") == 0, F.lit("lost")).otherwise(F.lit("unexpected"))
    apart = state.where("s <> d").select(*_AT, "block", F.col("at").alias("first"), "last", kind.alias("kind"))
    whole = _across(apart, [*_AT, "kind"], "first", "last").groupBy(*_AT, "kind", "lot", "island")
    return whole.agg(F.min("first").alias("first_offset"), F.max("last").alias("last_offset")).select(*_AT, "first_offset", "last_offset", "kind")


def _length() -> Column:
    return F.col("last_offset") - F.col("first_offset") + 1


def loss_runs(source: DataFrame, delivered: DataFrame) -> DataFrame:
    """M-12 by offsets: ``(topic, partition, sent, received, lost, duplicated,
    unexpected)`` for each source partition. ``source`` are the messages routed to a
    destination, ``delivered`` those read back there, both with the source's topic,
    partition and offset. ``sent`` and ``received`` count different offsets;
    ``duplicated`` counts deliveries beyond the first."""
    sent, got = offset_runs(source), offset_runs(delivered)
    zero = F.lit(0).cast("long")
    columns = ("sent", "received", "lost", "duplicated", "unexpected")

    def entries(df: DataFrame, **values: Column) -> DataFrame:
        return df.select(*_AT, *(values.get(c, zero).cast("long").alias(c) for c in columns))

    apart = run_differences(sent, got)
    of = lambda kind: F.when(F.col("kind") == kind, _length()).otherwise(zero)
    all_ = (
        entries(sent, sent=_length())
        .unionByName(entries(got, received=_length(), duplicated=F.col("messages") - _length()))
        .unionByName(entries(apart, lost=of("lost"), unexpected=of("unexpected")))
    )
    return all_.groupBy(*_AT).agg(*(F.sum(c).alias(c) for c in columns))
