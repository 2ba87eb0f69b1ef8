"""Continuous article ingest with title dedupe.

Collectors drop JSON-lines files into a landing folder; a Structured
Streaming query picks up new files.  Contract: whatever files meet in one
micro-batch, and in whatever order batches come, the ingested collection is
the keep-first one, for each title the row of the smallest ``ingest_id``
delivered.

Batches are brought into a table of hash buckets (``upsert``): a batch rewrites
the buckets in which it changes something and publishes a manifest, one that
runs again after a lost executor or driver changes nothing, and ``ingested``
scans one version of each bucket however many batches there were.

``start_title_ingest_stateful`` is the state-store form: the titles seen are
kept in the RocksDB state store (on local disk of the executors, checkpointed
to the shared folder) as fixed-width fingerprints, and the file sink commits
each batch exactly once.  Its contract is the set of titles; which copy of a
title survives is not fixed.  ``start_title_ingest_keep_first`` fixes it: the
state holds the least id of each title and the stream emits corrections.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import dedupe_landed, dedupe_titles
from ..schema import COLLECTION_SCHEMA
from ..session import COMPACT, RELEASE_CONF, materialize, release, released_shuffles
from .upsert import BUCKETS, read_table, upsert

COLUMNS = COLLECTION_SCHEMA.fieldNames()


def _stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(COLLECTION_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(landing)


def start_title_ingest(spark: SparkSession, landing: str, table_path: str, checkpoint: str,
                       max_files_per_trigger: int | None = None, buckets: int = BUCKETS):
    """Start an ``availableNow`` ingest of every file in ``landing`` not seen before.

    ``max_files_per_trigger`` sizes the micro-batches; the result does not depend on it.  ``buckets`` is taken when
    the table is new."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.select(*COLUMNS), table_path, batch_id, buckets)

    return (_stream(spark, landing, max_files_per_trigger).writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingested(spark: SparkSession, table_path: str) -> DataFrame:
    """The ingested collection, as of the last batch."""
    return read_table(spark, table_path, COLLECTION_SCHEMA)


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_title_ingest_stateful(spark: SparkSession, landing: str, table_path: str, checkpoint: str,
                                max_files_per_trigger: int | None = None, state_partitions: int | None = None):
    """Title-unique ingest with the dedupe state in the RocksDB state store.

    ``state_partitions`` (default: the session's shuffle partitions) is fixed by a checkpoint's first run:
    choose it for the table's final size.  The session's settings are put back once the query has started."""
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER}
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    rows = _stream(spark, landing, max_files_per_trigger).withColumn("_key", fingerprint(F.col("title")))
    with session_settings(spark, settings):
        return (rows.dropDuplicates(["_key"]).drop("_key")
                .writeStream.format("parquet").outputMode("append")
                .option("path", table_path).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())


def fingerprint(title: Column) -> Column:
    """A key of 32 bytes for a title; NULL has one of its own."""
    return F.coalesce(F.unhex(F.sha2(title, 256)), F.lit(bytes(32)))


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]):
    """Session settings for the start of a query, which takes them along; put back after."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


OTHERS = 200_000               # rows of a batch that are no corrections, by id, title and file: sent to all tasks at most


def start_title_ingest_keep_first(spark: SparkSession, landing: str, log_path: str, checkpoint: str, max_files_per_trigger: int | None = None,
                                  state_partitions: int | None = None):
    """Keep-first ingest with the least id of every title in the state store.

    For each title fingerprint the state holds the least ``ingest_id`` seen, the time of the batch that brought it and
    a hash of its file's path: keys and values are of fixed width.  A row with a smaller id, the first included, is a correction: its least id bears its own batch's time.  It
    goes to the log (Parquet, a folder a batch, which a batch that runs again replaces), and ``kept_first`` reads the
    collection from the log.  Which files meet in a batch, and in what order, does not matter: the last correction of a
    title is its row of least id.  Only keys meet the state; the rows come from the batch's files, where they stay while
    few of them are no corrections (``OTHERS``), else by a join.  Rows without an id take no part.  Titles stay in the state (processing-time timers would keep an ``availableNow`` run
    from ever ending)."""
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER}
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    file, batch_time = F.xxhash64("_metadata.file_path"), F.current_timestamp()      # one time for a batch, also when it runs again

    def log_corrections(found: DataFrame, batch_id: int) -> None:
        found.persist()                  # the state is updated once
        try:
            files = [r["_file"] for r in found.select("_file").distinct().collect()]
            rows = (found.sparkSession.read.schema(COLLECTION_SCHEMA).json(landing).where(file.isin(files)).where("ingest_id IS NOT NULL")
                    .withColumns({"_key": fingerprint(F.col("title")), "_file": file}))
            of_row = ["ingest_id", "_key", "_file"]
            others = materialize(rows.select(*of_row).join(found, of_row, "left_anti").distinct(), "no-corrections")
            kept = (rows.join(F.broadcast(others), of_row, "left_anti") if others.count() <= OTHERS
                    else rows.join(found, of_row, "left_semi"))
            with released_shuffles(found.sparkSession):
                kept.select(*COLUMNS).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}", compression=COMPACT)
            release(others)
        finally:
            found.unpersist()

    rows = (_stream(spark, landing, max_files_per_trigger).where("ingest_id IS NOT NULL")
            .select(fingerprint(F.col("title")).alias("_key"), "ingest_id", batch_time.alias("_seen"), file.alias("_file")))
    least = (rows.groupBy("_key").agg(F.min(F.struct("ingest_id", "_seen", "_file")).alias("least"))
             .where(F.col("least._seen") == batch_time).select("_key", "least.ingest_id", "least._file"))
    with session_settings(spark, settings | {RELEASE_CONF: "true"}):
        return (least.writeStream.outputMode("update").foreachBatch(log_corrections)
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())


def kept_first(spark: SparkSession, log_path: str) -> DataFrame:
    """The collection that a log of corrections gives: of each title the row of least id.  Rows move only where the log
    holds an id twice."""
    log = spark.read.schema(COLLECTION_SCHEMA).parquet(log_path).select(*COLUMNS)
    ids = materialize(log.groupBy("ingest_id").count().where("count > 1").select("ingest_id"), "repeated_ids")
    return dedupe_landed(log) if ids.isEmpty() else dedupe_titles(log.dropDuplicates(["ingest_id"]))


STATE_ROWS = 250_000           # titles of a state partition; each also takes about 10 MB of a local disk whatever it holds


def state_partitions_for(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))


def _deliveries(collection: DataFrame, overlap: int) -> list[DataFrame]:
    """Upper half of the ingest ids, then the lower half plus the first ``overlap`` ids of the upper again: late rows
    with smaller ids, and an at-least-once re-delivery."""
    bounds = collection.agg(F.min("ingest_id").alias("lo"), F.max("ingest_id").alias("hi")).first()
    if bounds["lo"] is None:
        return []
    mid = (bounds["lo"] + bounds["hi"]) // 2 + 1
    return [collection.where(F.col("ingest_id") >= mid), collection.where(F.col("ingest_id") < mid + overlap)]


def run_title_ingest(spark: SparkSession, collection: DataFrame, base: str, overlap: int = 100,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Replay a collection through the stream in two deliveries and return the ingested table.

    Both are landed as JSON files; the stream runs once per delivery on the same checkpoint, so the second run
    reads only the new files.  The result equals keep-first dedupe of the whole collection."""
    landing, table_path, ckpt = f"{base}/landing", f"{base}/table", f"{base}/checkpoint"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in _deliveries(collection, overlap):
        part.select(*COLUMNS).write.mode("append").json(landing, compression="gzip")
        start_title_ingest(spark, landing, table_path, ckpt, max_files_per_trigger, buckets).awaitTermination()
    return ingested(spark, table_path)


def run_title_ingest_keep_first(spark: SparkSession, collection: DataFrame, base: str, overlap: int = 100,
                                max_files_per_trigger: int | None = None) -> DataFrame:
    """The same two deliveries through ``start_title_ingest_keep_first``; returns the collection of its log."""
    landing, log_path, ckpt = f"{base}/landing", f"{base}/log", f"{base}/checkpoint"
    deliveries = _deliveries(collection, overlap)
    if not deliveries:
        return spark.createDataFrame([], COLLECTION_SCHEMA)
    partitions = state_partitions_for(spark, collection.count())
    for part in deliveries:
        part.select(*COLUMNS).write.mode("append").json(landing, compression="gzip")
        start_title_ingest_keep_first(spark, landing, log_path, ckpt, max_files_per_trigger, partitions).awaitTermination()
    return kept_first(spark, log_path)


def run_title_ingest_stateful(spark: SparkSession, collection: DataFrame, base: str,
                              overlap: int = 100) -> DataFrame:
    """The same two deliveries through ``start_title_ingest_stateful``; returns the ingested table."""
    landing, table_path, ckpt = f"{base}/landing", f"{base}/table", f"{base}/checkpoint"
    deliveries = _deliveries(collection, overlap)
    if not deliveries:
        return spark.createDataFrame([], COLLECTION_SCHEMA)
    for part in deliveries:
        part.select(*COLUMNS).write.mode("append").json(landing, compression="gzip")
        start_title_ingest_stateful(spark, landing, table_path, ckpt).awaitTermination()
    return spark.read.schema(COLLECTION_SCHEMA).parquet(table_path)
