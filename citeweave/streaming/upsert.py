"""A title-unique table with bounded reads: hash buckets, copy-on-write, published by manifests.

A row lives in the bucket of its title's hash.  A batch rewrites only the buckets in which it changes something and
publishes a manifest that names the files of every bucket; a reader takes the newest manifest and scans just those
files, one version of each bucket, so a read costs the same after any number of batches and never reduces old ones.

    <table>/data/<batch>-<attempt>/bucket=<n>/...   rows, title-unique within the table
    <table>/manifests/<batch>/...                   (bucket, path, buckets), complete when Spark's _SUCCESS is there

Keep-first: of a title's rows the one with the smallest ``ingest_id`` stays, whatever batch it comes in.  A batch
that runs again (lost executor or driver) finds its manifest and does nothing, or starts from the manifest before it
in folders of its own: files are never changed in place.  One writer at a time, as a streaming query is; readers
need no lock.  Files that no kept manifest names are removed by ``vacuum``.

Disk: a batch is landed as Parquet, titles and ids alone decide what changes, and the touched buckets are rewritten
in STEPS steps of some of them, each of which gives its shuffles back; the landed batch goes at the end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import COMPACT, materialize, release, released_shuffles

BUCKETS = 64                  # of a new table: choose it for the table's final size (256 MB a bucket)
STEPS = 4                     # in which a batch's buckets are rewritten, at most: a step has a bucket for every core
MANIFEST = "bucket int, path string, buckets int"


def bucket_of(title: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(title), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _folder(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, table: str) -> list[int]:
    """Published batches, in order."""
    fs, _ = _folder(spark, table)
    done = [n for n in _names(spark, f"{table}/manifests") if n.isdigit()
            and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/manifests/{n}/_SUCCESS"))]
    return sorted(map(int, done))


def manifest(spark: SparkSession, table: str, before: int | None = None) -> tuple[dict[int, str], int | None]:
    """Path of every bucket that holds rows, and the table's number of buckets, by the newest manifest (of the
    batches before ``before``).  A row for each bucket reaches the driver."""
    known = [v for v in versions(spark, table) if before is None or v < before]
    if not known:
        return {}, None
    rows = spark.read.schema(MANIFEST).json(f"{table}/manifests/{known[-1]}").collect()
    return {r["bucket"]: r["path"] for r in rows if r["path"]}, rows[0]["buckets"]


def read_table(spark: SparkSession, table: str, schema: StructType, paths: list[str] | None = None) -> DataFrame:
    """The table as of the newest manifest (or the given buckets' files)."""
    paths = sorted(manifest(spark, table)[0].values()) if paths is None else paths
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, table: str, batch: int, buckets: int = BUCKETS, key: str = "title", order: str = "ingest_id") -> int:
    """Bring a batch into the table; returns the number of buckets rewritten.  ``buckets`` counts for a new table only."""
    spark = rows.sparkSession
    if batch in versions(spark, table):
        return 0
    held, of_table = manifest(spark, table, before=batch)
    buckets = of_table or buckets
    schema, names = rows.schema, rows.columns
    new = materialize(rows.where(F.col(order).isNotNull()).withColumn("bucket", bucket_of(F.col(key), buckets)), "upsert-rows", COMPACT)
    landed = [new]
    try:
        first = new.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_least"))
        asked = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        if own := [held[b] for b in sorted(asked & held.keys())]:
            ids = read_table(spark, table, schema, own).select(F.col(key).alias("_own"), F.col(order).alias("_held"))
            # what the table does not have yet, or has with a larger id: re-delivered rows rewrite nothing
            first = (first.join(ids, F.col("_key").eqNullSafe(F.col("_own")), "left")
                     .where(F.col("_held").isNull() | (F.col("_least") < F.col("_held"))).select("_key", "_least"))
        landed.append(first := materialize(first.select("_least", bucket_of(F.col("_key"), buckets).alias("bucket")), "upsert-ids"))
        touched = sorted(r["bucket"] for r in first.select("bucket").distinct().collect())
        steps = max(1, min(STEPS, len(touched) // spark.sparkContext.defaultParallelism))
        one_each = Window.partitionBy("bucket", key).orderBy(order)
        for step in filter(None, (touched[i::steps] for i in range(steps))):
            least = first.where(F.col("bucket").isin(step)).select("_least").distinct()
            # by the unique id first: a title that many rows of a batch share brings one of them to its bucket
            whole = new.where(F.col("bucket").isin(step)).join(least, F.col(order) == F.col("_least"), "left_semi")
            if own := [held[b] for b in step if b in held]:
                whole = read_table(spark, table, schema, own).withColumn("bucket", bucket_of(F.col(key), buckets)).unionByName(whole)
            out = f"{table}/data/{batch}-{uuid.uuid4().hex[:12]}"
            kept = (whole.repartition(len(step), "bucket").withColumn("_copy", F.row_number().over(one_each))
                    .where("_copy = 1").select(*names, "bucket"))
            with released_shuffles(spark):
                kept.write.partitionBy("bucket").parquet(out, compression=COMPACT)
            held |= {b: f"{out}/bucket={b}" for b in step}
        # an empty table's manifest still tells its number of buckets
        spark.createDataFrame([(b, p, buckets) for b, p in sorted(held.items())] or [(None, None, buckets)], MANIFEST) \
            .coalesce(1).write.mode("overwrite").json(f"{table}/manifests/{batch}")
        return len(touched)
    finally:
        for df in landed:
            release(df)


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Remove all manifests but the last ``keep`` and the bucket folders that these do not name; returns how many
    folders went.  Not while a reader still scans an older version."""
    fs, _ = _folder(spark, table)
    path = spark._jvm.org.apache.hadoop.fs.Path
    known = versions(spark, table)
    used: set[str] = set()
    for v in known[-keep:]:
        used |= set(manifest(spark, table, before=v + 1)[0].values())
    for v in known[:-keep]:
        fs.delete(path(f"{table}/manifests/{v}"), True)
    gone = 0
    for folder in _names(spark, f"{table}/data"):
        own = [n for n in _names(spark, f"{table}/data/{folder}") if n.startswith("bucket=")]
        for n in own:
            if f"{table}/data/{folder}/{n}" not in used:
                gone += bool(fs.delete(path(f"{table}/data/{folder}/{n}"), True))
        if not any(f"{table}/data/{folder}/{n}" in used for n in own):
            fs.delete(path(f"{table}/data/{folder}"), True)
    return gone
