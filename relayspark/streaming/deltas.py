"""Stored metric deltas of a stream (M-05, M-07, M-13, T-06): batches and blocks.

Every micro-batch stores its deltas, one row per side and topic, and when it ran. A
stream of years would leave millions of folders, so whenever there are ``every``
batches beside the last one, they become a block: one file with the rows of each
batch (a reset may name any batch), one with their fold, one with the times. As many
blocks of one level become a block of the next. At most 2 * every batch folders and
every blocks for each level are there at any time.

A manifest, replaced as a whole, names the blocks and the last batch in them; what it
doesn't name doesn't count. Folders that it has replaced are removed at the next
compaction, so a reader that began before one still finds its files. Only batches
before the current one are compacted, as they are never run again; one that is, from
an older checkpoint, changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayspark.streaming import files

DELTAS = "side string, topic string, message_count long, total_bytes long, error_count long, last_message_time timestamp, last_recorded double"
RUNS = "run string, began double, ended double"

#: Batches in a block, blocks in one of the next level.
EVERY = 100


def fold(deltas: DataFrame) -> DataFrame:
    """One row per side and topic."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    last = lambda c: F.max(c).alias(c)
    return deltas.groupBy("side", "topic").agg(*map(total, ("message_count", "total_bytes", "error_count")), *map(last, ("last_message_time", "last_recorded")))


def _fold_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run").agg(F.min("began").alias("began"), F.max("ended").alias("ended"))


class DeltaStore:
    """Deltas and run times of the stream that writes to ``out_dir``."""

    def __init__(self, spark: SparkSession, out_dir: str, every: int = EVERY):
        if every < 2:
            raise ValueError("a block needs two batches or more")
        self.spark, self.out_dir, self.every = spark, out_dir.rstrip("/"), every
        self.manifest = self._read_manifest()

    # -------------------------------------------------------------- writing

    def add(self, batch_id: int, deltas: DataFrame, runs: DataFrame) -> None:
        """Store a batch; a batch that is run again replaces what it stored, and one
        that is in a block already is left as it is."""
        if batch_id <= self.manifest["upto"]:
            return
        deltas.select(DELTAS_COLUMNS).write.mode("overwrite").parquet(f"{self.out_dir}/metrics/batch_id={batch_id}")
        runs.write.mode("overwrite").parquet(f"{self.out_dir}/runs/batch_id={batch_id}")
        if batch_id - self.manifest["upto"] > self.every:
            self.compact(batch_id - 1)

    def compact(self, last: int) -> None:
        """Put all batches up to ``last`` that are in no block into one."""
        self._remove_replaced()
        old = self.manifest
        tail = F.col("batch_id").between(old["upto"] + 1, last)
        block = self._write_block(0, old["upto"] + 1, last, self._batches("metrics", DELTAS).where(tail), self._batches("runs", RUNS).where(tail))
        blocks, level = [*old["blocks"], block], 0
        while len(same := [b for b in blocks if b["level"] == level]) >= self.every:
            deltas = self._read([f"{b['path']}/rows" for b in same], f"batch_id long, {DELTAS}")
            runs = self._read([f"{b['path']}/runs" for b in same], RUNS)
            whole = self._write_block(level + 1, same[0]["first"], same[-1]["last"], deltas, runs)
            blocks = [b for b in blocks if b["level"] != level] + [whole]
            level += 1
        manifest = {"version": old["version"] + 1, "upto": last, "blocks": sorted(blocks, key=lambda b: b["first"])}
        files.write_whole(self.spark, f"{self._manifests}/{manifest['version']:012d}.json", json.dumps(manifest))
        self.manifest = manifest

    def _write_block(self, level: int, first: int, last: int, deltas: DataFrame, runs: DataFrame) -> dict:
        path = f"{self.out_dir}/metric_blocks/{uuid.uuid4().hex}"
        deltas.select("batch_id", *DELTAS_COLUMNS).coalesce(1).sortWithinPartitions("batch_id").write.parquet(f"{path}/rows")
        fold(self._read([f"{path}/rows"], DELTAS)).coalesce(1).write.parquet(f"{path}/fold")
        _fold_runs(runs).coalesce(1).write.parquet(f"{path}/runs")
        return {"level": level, "first": first, "last": last, "path": path}

    def _remove_replaced(self) -> None:
        """What the manifest in force (one compaction old) has replaced."""
        kept = {b["path"].rsplit("/", 1)[1] for b in self.manifest["blocks"]}
        gone = [f"metric_blocks/{n}" for n in files.names(self.spark, f"{self.out_dir}/metric_blocks") if n not in kept]
        for folder in ("metrics", "runs"):
            for name in files.names(self.spark, f"{self.out_dir}/{folder}"):
                if name.startswith("batch_id=") and int(name[9:]) <= self.manifest["upto"]:
                    gone.append(f"{folder}/{name}")
        versions = [n for n in files.names(self.spark, self._manifests) if n.endswith(".json")]
        gone += [f"metric_manifest/{n}" for n in versions[:-1]]
        for name in gone:
            files.delete(self.spark, f"{self.out_dir}/{name}")

    # -------------------------------------------------------------- reading

    @property
    def _manifests(self) -> str:
        return f"{self.out_dir}/metric_manifest"

    def _read_manifest(self) -> dict:
        versions = [n for n in files.names(self.spark, self._manifests) if n.endswith(".json")]
        if not versions:
            return {"version": 0, "upto": -1, "blocks": []}
        return json.loads(files.read_text(self.spark, f"{self._manifests}/{versions[-1]}"))

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _batches(self, folder: str, schema: str) -> DataFrame:
        """The batch folders, with their ``batch_id``; none yet: no rows."""
        path = f"{self.out_dir}/{folder}"
        there = any(n.startswith("batch_id=") for n in files.names(self.spark, path))
        return self._read([path] if there else [], f"{schema}, batch_id long")

    def deltas(self, after_batch: int = -1) -> DataFrame:
        """Rows to fold for the batches after one (M-07): folds of whole blocks, rows
        of the block that the batch lies in, and of batches that are in none."""
        blocks = self.manifest["blocks"]
        whole = [f"{b['path']}/fold" for b in blocks if b["first"] > after_batch]
        cut = [f"{b['path']}/rows" for b in blocks if b["first"] <= after_batch < b["last"]]
        rows = self._read(cut, f"batch_id long, {DELTAS}").unionByName(self._batches("metrics", DELTAS).where(F.col("batch_id") > self.manifest["upto"]))
        return self._read(whole, DELTAS).unionByName(rows.where(F.col("batch_id") > after_batch).drop("batch_id"))

    def runs(self) -> DataFrame:
        """(run, began, ended), one row for each start of the stream."""
        blocks = self._read([f"{b['path']}/runs" for b in self.manifest["blocks"]], RUNS)
        tail = self._batches("runs", RUNS).where(F.col("batch_id") > self.manifest["upto"]).drop("batch_id")
        return _fold_runs(blocks.unionByName(tail))


DELTAS_COLUMNS = [c.split()[0] for c in DELTAS.split(", ")]
