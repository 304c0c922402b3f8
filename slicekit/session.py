"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint folder that cuts lineage on a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Bounds of the Arrow batches that go to Python workers: both sides hold a batch outside the JVM's heap, and
#: 10,000 rows with long texts, Spark's default, are hundreds of megabytes.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch bounds to ``ARROW_BATCH`` where they are higher."""
    for key, most in ARROW_BATCH.items():
        now = spark.conf.get(key) or ""
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "slicekit", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("SPARK_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    filesystem).  Only when it is unset (local tests) do we create one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; "
                               f"a folder of this machine would not do on {master or 'a cluster'}")
        # the setting cannot be changed while the session runs: the folder stays with the context
        holder = spark.sparkContext
        root = getattr(holder, "_slicekit_checkpoints", None) or tempfile.mkdtemp(prefix="slicekit-ckpt-")
        holder._slicekit_checkpoints = root
    try:  # classic sessions: RDD checkpoints go to the same folder
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext
        pass
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Make ``slicekit`` importable in the Python workers (once per context), and bound their batches.

    User functions and helpers are pickled by reference, so every executor
    needs the package; ``addPyFile`` distributes a zip of it through Spark.
    """
    import shutil

    import slicekit
    bound_batches(spark)
    try:
        holder = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: ship as a session artifact
        holder = spark
    if getattr(holder, "_slicekit_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(slicekit.__file__)))
    out = tempfile.mkdtemp(prefix="slicekit-pkg-")
    archive = shutil.make_archive(os.path.join(out, "slicekit"), "zip", root_dir=root, base_dir="slicekit")
    if holder is spark:
        spark.addArtifacts(archive, pyfile=True)
    else:
        holder.addPyFile(archive)
    holder._slicekit_shipped = True


def materialize(df, name: str):
    """Write ``df`` once as a Parquet table under the shared checkpoint folder
    and return a DataFrame reading it back.

    Cuts the lineage (later failures recompute from the table, not from the
    sources -- and never call a user function twice) and, unlike an RDD
    checkpoint, later scans still prune columns and push filters.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
