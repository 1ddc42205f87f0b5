"""Session settings the engine relies on, and the shared folder for state."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

# Fixed settings every query depends on:
# - a repeated header key keeps its last value (a Python dict build does that),
# - a repeated JSON object key keeps its last value (json.loads does that),
# - event times are read and written as UTC wall clock,
# - batches that go to Python are bounded in bytes, as messages and texts may be long.
REQUIRED_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: Bytes of a Parquet row group, which each writing task holds; 32 MB unless set.
ROW_GROUP = "parquet.block.size"

_SHIP_LOCK = threading.Lock()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators rely on (all are
    session-settable) and make the package importable by Python workers."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    if spark.conf.get(ROW_GROUP, None) is None:
        spark.conf.set(ROW_GROUP, str(32 << 20))
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Add this package to the Python workers' path once per SparkContext
    (what ``--py-files`` does), so that row processors and their helpers
    unpickle on executors that do not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_relayspark_shipped", False):
        return
    with _SHIP_LOCK:
        if getattr(sc, "_relayspark_shipped", False):
            return
        _ship(spark, sc)


def _ship(spark: SparkSession, sc) -> None:
    import zipfile

    import relayspark

    pkg_dir = os.path.dirname(os.path.abspath(relayspark.__file__))
    root = spark.conf.get("spark.checkpoint.dir", None) or ""
    local_root = root.replace("file:", "") if root and ("://" not in root or root.startswith("file:")) else ""
    base = os.path.join(local_root, "relayspark", "pyfiles") if local_root else tempfile.mkdtemp(prefix="relayspark-pyfiles-")
    target = os.path.join(base, uuid.uuid4().hex[:12])
    os.makedirs(target, exist_ok=True)
    zpath = os.path.join(target, "relayspark.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    sc._relayspark_shipped = True


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "relayspark",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with AQE on, the UI off and the required settings applied.

    On a cluster leave ``master`` unset (the launcher decides) and size
    ``shuffle_partitions`` to the data: metrics aggregate to one row per topic,
    so the final stage is small, but the partial stage runs per input split.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **REQUIRED_CONF,
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return configure(spark)


def _checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: tables and checkpoints need a folder that all executors share")
        # One machine only: its own temporary folder is shared by all tasks.
        root = tempfile.mkdtemp(prefix="relayspark-state-")
    if not sc.getCheckpointDir():
        # Named only as a session setting: register it for checkpoint() too.
        sc.setCheckpointDir(root)
    return root


def materialize(df):
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the
    session's shared checkpoint folder (never a machine-local copy), so that
    a size check and the query that uses the result do not both recompute it,
    and a lost executor does not force a recompute from the source. Data
    already held on the driver (a local relation, e.g. a route table built
    from a dict) has no lineage to cut and is returned as it is."""
    try:
        if df.isLocal():
            return df
    except Exception:  # noqa: BLE001 - not decidable here: checkpoint
        pass
    _checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint root.

    Streaming checkpoints, topic tables and metric deltas go here, so that they
    survive the loss of any executor (the root is the cluster's shared folder
    named by ``spark.checkpoint.dir``).
    """
    root = _checkpoint_root(spark)
    path = f"{root.rstrip('/')}/relayspark/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", ""), exist_ok=True)
    return path


def plan_text(df, mode: str = "formatted") -> str:
    """The physical plan as text (for checks on pushdown, joins and shuffles)."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()
