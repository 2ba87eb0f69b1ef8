"""Spark session settings and the shared work folder.

Results that must outlive one task (landed tables, streaming checkpoints,
lineage cuts) go to the folder named by ``spark.checkpoint.dir``.  On a
cluster that setting must point at shared storage (HDFS, S3, ...); we only
pick a scratch folder ourselves when it is unset and Spark runs in local
mode, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "citeweave", extra: dict | None = None) -> SparkSession:
    """Session with the settings every job here assumes.

    AQE re-plans joins and coalesces shuffle partitions at runtime, splits
    skewed sort-merge join partitions, and turns a sort-merge join into a hash
    join where every measured build partition is small.  Sizes (shuffle
    partitions, driver memory) are set in local mode only; on a cluster, and with
    ``master=None``, they are the deployment's.  The UI stays off.
    """
    b = (SparkSession.builder.appName(app_name)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(64 * 1024 * 1024))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master is not None:
        b = b.master(master)
    if master is not None and master.startswith("local"):
        b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
             .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for landed tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).
    When neither is set, a scratch folder is created only for local mode;
    a cluster without the setting is a configuration error.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder (HDFS/S3) on a cluster")
        path = tempfile.mkdtemp(prefix="citeweave-ckpt-")
        try:
            spark.conf.set(CHECKPOINT_CONF, path)
        except Exception:  # a deployment may refuse runtime changes of core settings
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def work_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder, scoped to this application."""
    base = shared_dir(spark)
    return "/".join([base, "citeweave", spark.sparkContext.applicationId, *parts])


RELEASE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released_shuffles(spark: SparkSession):
    """Executions inside give their shuffle files back when they end: for frames that are written and not run again."""
    before = spark.conf.get(RELEASE_CONF, "false")
    spark.conf.set(RELEASE_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE_CONF, before)


COMPACT = "zstd"              # of landed texts: a third less disk than the default codec


def materialize(df, name: str, compression: str | None = None):
    """Write ``df`` as Parquet below the shared folder and read it back.

    For an intermediate that a plan consumes more than once (Spark would
    otherwise recompute it per consumer): it is computed once, the lineage is
    cut, and a lost executor re-reads files instead of recomputing.  The
    shuffles that made it are not needed any more and are released.
    """
    path = work_path(df.sparkSession, "stage", f"{name}-{uuid.uuid4().hex[:12]}")
    with released_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def release(df) -> None:
    """Remove what ``materialize`` wrote for ``df``, once everything made of it is written."""
    spark = df.sparkSession
    stage = work_path(spark, "stage")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if stage.split(":", 1)[-1].lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize_bucketed(df, name: str, buckets: int, by: str):
    """``materialize`` as a table bucketed by a column: rows of one value lie in one bucket and scans say so, so that
    grouping, windows and joins on the column (and more) need no exchange.  A bucket is one file."""
    table = f"citeweave_{name}_{uuid.uuid4().hex[:12]}"
    path = work_path(df.sparkSession, "stage", table)
    (df.repartition(buckets, by).write.mode("overwrite").option("path", path).bucketBy(buckets, by).saveAsTable(table))
    return df.sparkSession.table(table)


def spread(df, factor: int = 1):
    """Round-robin rows over at least ``defaultParallelism * factor`` partitions, only
    when the input has fewer: for CPU-heavy per-row work (regexes over whole pages)
    on inputs stored in a few large files.  Inputs that already come in enough
    splits are left alone, so no shuffle is added at scale."""
    want = df.sparkSession.sparkContext.defaultParallelism * factor
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


_LANDINGS: list[dict] = []


def landings() -> dict:
    """A dictionary of what has been landed, which ``clear_work`` empties."""
    _LANDINGS.append({})
    return _LANDINGS[-1]


def clear_work(spark: SparkSession) -> None:
    """Remove what this application has landed below the shared folder, once its results have been read; what is asked
    for after that is landed anew."""
    for known in _LANDINGS:
        known.clear()
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_path(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
