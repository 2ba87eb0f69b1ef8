"""Title-level deduplication and unique-title ingest.

Keep-first means "the copy with the smallest ``ingest_id``".  Per-title
work is a hash aggregation over (title, id) with map-side partial
aggregation, so a title that holds a third of all rows (the blank title,
say) is reduced to one partial row per map task before the shuffle; rows
are then selected by a join on the unique id, where no key can be hot.
No group is ever collected into a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Ingest ids of merged sources: source position times this stride plus the
# source's own id, so ids stay unique and ordered by run order, then by id.
# A source's own ids must stay below 2^48 (page ids: 2^32 pages x 2^16
# containers); 2^63 leaves room for 2^15 sources.
SOURCE_ID_STRIDE = 1 << 48


def kept_ids(df: DataFrame, key: str = "title", order: str = "ingest_id") -> DataFrame:
    """The smallest ``order`` per title: a fixed-width hash aggregate over two
    columns, partial-aggregated map-side (a hot title costs one row per task)."""
    return df.groupBy(key).agg(F.min(order).alias("_keep")).select("_keep")


def dedupe_titles(df: DataFrame, key: str = "title", order: str = "ingest_id") -> DataFrame:
    """A2: one row per title (NULL titles form one group), the one with the smallest ``order``.

    Two steps instead of ``min_by(struct(*), order)``, which Spark can only
    run as a sort aggregate that sorts every row with its whole payload:
    (1) the kept id per title (``kept_ids``), (2) a semi-join of the rows on
    their unique id.  The join key is unique, so no partition can be hot.  The
    join strategy is left to Spark, which turns it into a hash join where the
    measured partitions of ids are small enough (the local-map threshold that
    ``build_session`` sets) and else sorts, which can spill.
    ``order`` must be unique per row.
    """
    keep = kept_ids(df, key, order)
    return df.join(keep, df[order] == keep["_keep"], "left_semi")


SURPLUS_IDS = 2_000_000        # sent to all tasks at most, 16 MB of ids


def dedupe_landed(df: DataFrame, key: str = "title", order: str = "ingest_id", most: int = SURPLUS_IDS) -> DataFrame:
    """The rows of ``dedupe_titles``, for a landed collection: the ids that go are found and counted first, and up to
    ``most`` of them are sent to the rows, which then stay where they are.  More go by ``dedupe_titles``."""
    keep, own = kept_ids(df, key, order), df.select(F.col(order).alias("_gone")).where("_gone IS NOT NULL")
    gone = materialize(own.join(keep, own["_gone"] == keep["_keep"], "left_anti").distinct(), "surplus_ids")
    if gone.count() > most:
        return dedupe_titles(df, key, order)
    return df.where(F.col(order).isNotNull()).join(F.broadcast(gone), df[order] == gone["_gone"], "left_anti")


def duplicate_titles(df: DataFrame, key: str = "title", order: str = "ingest_id") -> DataFrame:
    """A1: titles held by more than one row, with copy count, kept id and surplus count.

    The reference lists every id of a duplicate group; a list per group is
    unbounded, so the ids that go are given in long form by ``surplus_rows``.
    """
    return (df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("kept_id"))
            .where(F.col("copies") > 1)
            .select(key, "copies", "kept_id", (F.col("copies") - 1).alias("surplus")))


def surplus_rows(df: DataFrame, key: str = "title", order: str = "ingest_id") -> DataFrame:
    """Rows keep-first removes (the delete-where-id-in list), as a join on the unique id."""
    keep = kept_ids(df, key, order)
    return df.join(keep, df[order] == keep["_keep"], "left_anti")


def title_uniqueness(df: DataFrame, key: str = "title") -> DataFrame:
    """Whether a unique index on the title would hold: rows, distinct titles (NULL is one), titles held twice or
    more, and the verdict."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"), F.count(F.lit(1)).alias("titles"),
                   F.count_if(F.col("n") > 1).alias("repeated")).withColumn("is_unique", F.col("repeated") == 0)


def dedupe_report(df: DataFrame, key: str = "title") -> DataFrame:
    """Initial and final row counts, rows deleted and titles that had copies, in one job."""
    per_title = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_title.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("initial_count"),
        F.count(F.lit(1)).alias("final_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("deleted_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_titles"),
    )


def insert_if_absent(batch: DataFrame, existing: DataFrame, key: str = "title",
                     order: str = "ingest_id") -> DataFrame:
    """Rows of ``batch`` whose title the table does not hold yet.

    The batch is deduplicated first (one insert per title, the first one);
    the title test is NULL-safe, like a unique index that treats a missing
    title as one value.  Append the result to the table to apply it.  The
    table's distinct titles, reduced map-side, are joined against the batch's
    titles and first ids; the batch's rows move once, to meet the ids that stay.
    Spark broadcasts a side only by its measured size.
    """
    keys = ["_k", "_kn"]
    # distinct, first ids and anti-join share the hash partitioning on (_k, _kn)
    present = _null_safe_keys(existing, key).distinct()
    first = _null_safe_keys(batch, key, order).groupBy(*keys).agg(F.min(order).alias(order))
    rows = batch.withColumns({"_k": F.coalesce(F.col(key), F.lit("")), "_kn": F.col(key).isNull()})
    return (rows.join(first.join(present, keys, "left_anti"), [order, *keys], "left_semi")
            .select(*batch.columns))


def _null_safe_keys(df: DataFrame, key: str, *keep: str) -> DataFrame:
    """(coalesce(key, ''), key IS NULL): equal exactly when the keys are equal or both NULL,
    as plain equi-join columns (a ``<=>`` condition is rewritten to keys that do not match
    the partitioning of a preceding distinct)."""
    return df.select(F.coalesce(F.col(key), F.lit("")).alias("_k"), F.col(key).isNull().alias("_kn"), *keep)


def union_sources(frames: list[DataFrame], order: str = "ingest_id") -> DataFrame:
    """Merge collector outputs by column name; missing columns become NULL.

    ``ingest_id`` is re-based so that rows of an earlier source come first
    (run order), then by the source's own id.
    """
    rebased = [f.withColumn(order, F.lit(i * SOURCE_ID_STRIDE).cast("bigint") + F.col(order))
               for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rebased)
