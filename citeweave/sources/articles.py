"""The article collection, built from the driver's tables and landed once.

The driver's tables hold no articles, so one article is derived per order
(FIXTURES.md part 3): title from the order's document or the part of its
first line, authors from the suppliers of its lines, year from the order
date, source from the document, affiliations from the customer segment.  A
title names its article: the whole first line of a document with a
fingerprint of its whole text, so only true copies share one, or the part
and the order.  The measures that the warehouse needs come along: the
customer's nation, the quantity ordered and the order's price.

The derived collection is written once per application as Parquet into the
shared folder (``spark.checkpoint.dir``), the way the collectors land their
records in one store before any analysis runs; every query then scans the
landed table, with column pruning and pushed filters, instead of re-running
the joins.  A lost executor only costs the re-read of the landed files.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MISSING_ABSTRACT, UNKNOWN_AUTHORS, UNKNOWN_TITLE
from ..session import COMPACT, landings, materialize, release, released_shuffles, spread, work_path
from .tables import table

MEASURES = ("country", "citations", "impact_score", "lang")

_LANDED: dict[tuple[str, str], str] = landings()
_LOCK = threading.Lock()


def _author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: supplier names of its lines in line order, and the first line's part."""
    # spread: a table stored as one row group is read by one task
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    order_key: list[Column] = [F.col("l_linenumber"), F.col("l_suppkey"), F.col("s_name"), F.col("l_partkey")]
    # dealt out by order before the lists are built: a task lists what one partition holds, not all lines of a split
    return (lines.join(sup, lines.l_suppkey == sup.s_suppkey).repartition("l_orderkey")
            .groupBy("l_orderkey")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order_key))),
                                          lambda x: x["s_name"]), ", ").alias("authors"),
                 F.min_by("l_partkey", F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("first_part"),
                 F.sum("l_quantity").cast("bigint").alias("quantity")))


def build_articles(spark: SparkSession, sf_dir: str, auth: DataFrame | None = None) -> DataFrame:
    """Articles derived from orders: the collection's columns and ``MEASURES``.  ``auth``: the author lists, if landed."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("source").alias("doc_source"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # narrow rows meet the dimensions first; the joins on the order's key come last and share one partitioning, so that
    # authors and texts move once whatever the sizes of the dimensions
    auth = _author_lists(spark, sf_dir) if auth is None else auth
    auth = auth.join(part, auth.first_part == part.p_partkey, "left")
    head = (orders.join(cust, orders.o_custkey == cust.c_custkey)
            .join(nation, cust.c_nationkey == nation.n_nationkey, "left"))
    j = (head.join(auth, orders.o_orderkey == auth.l_orderkey, "left")
         .join(docs, orders.o_orderkey == docs.doc_id, "left"))
    return j.select(
        F.col("o_orderkey").cast("bigint").alias("ingest_id"),
        F.coalesce(F.concat(F.substring_index("text", "\n", 1), F.lit(" #"), F.md5("text")),
                   F.concat(F.coalesce(F.col("p_name"), F.lit(UNKNOWN_TITLE)), F.lit(" (order "),
                            F.col("o_orderkey").cast("string"), F.lit(")"))).alias("title"),
        F.coalesce(F.col("authors"), F.lit(UNKNOWN_AUTHORS)).alias("authors"),
        F.year("o_orderdate").cast("string").alias("date_pub"),
        F.coalesce(F.col("doc_source"),
                   F.concat(F.lit("src"), (F.col("o_orderkey") % 3).cast("string"))).alias("source"),
        F.col("o_orderpriority").alias("journal"),
        F.coalesce(F.col("text"), F.lit(MISSING_ABSTRACT)).alias("abstract_"),
        F.concat(F.lit("Lab, "), F.col("c_mktsegment")).alias("affiliations"),
        F.col("n_name").alias("country"),
        F.coalesce("quantity", F.lit(0)).cast("bigint").alias("citations"),
        # whole cents of a ten-thousandth of the price: the same number in every engine
        (F.floor(F.round(F.col("o_totalprice") * 100).cast("bigint") / 10000) / 100).alias("impact_score"),
        F.col("lang"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article collection for ``sf_dir``, without the measures."""
    return measured_articles(spark, sf_dir).drop(*MEASURES)


def measured_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed collection with its measures (built on first use in this application)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:                       # callers may run queries from several threads
        path = _LANDED.get(key)
        if path is None:
            tag = hashlib.sha1(key[1].encode()).hexdigest()[:12]
            path = work_path(spark, f"articles_{tag}")
            auth = materialize(_author_lists(spark, sf_dir), "author_lists")       # the lines' shuffles go before texts move
            with released_shuffles(spark):
                build_articles(spark, sf_dir, auth).write.mode("overwrite").parquet(path, compression=COMPACT)
            release(auth)
            _LANDED[key] = path
    return spark.read.parquet(path)
