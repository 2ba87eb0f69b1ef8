"""Corpus statistics of the analysis stage.

Counts are hash aggregations with partial aggregation before the shuffle
(a dominant key such as the ``Unknown`` author costs one row per map task);
top-k is ``orderBy().limit()``, which Spark plans as TakeOrderedAndProject
(per-partition heaps, no global sort).  Ties are broken by key ascending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_valid_text, raw_author_parts, trailing_country
from ..functions.years import is_exact_year


def trends(df: DataFrame) -> DataFrame:
    """A3: articles per exact four-digit ``date_pub``, by year."""
    return (df.where(is_exact_year(F.col("date_pub")))
            .groupBy("date_pub").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("date_pub"))


def top_authors_raw(df: DataFrame, n: int = 20) -> DataFrame:
    """A4: the n most frequent comma parts of ``authors``, untrimmed (``" Wei Cai"`` and ``"Wei Cai"`` differ)."""
    if "authors" not in df.columns:
        return df.sparkSession.createDataFrame([], "author string, count bigint")
    return (df.select(F.explode(raw_author_parts(F.col("authors"))).alias("author"))
            .groupBy("author").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("author")).limit(n))


def geography(df: DataFrame, n: int = 20) -> DataFrame:
    """A5: the n most frequent trailing countries of ``affiliations`` (``''`` = no match is a group)."""
    if "affiliations" not in df.columns:
        return df.sparkSession.createDataFrame([], "country string, count bigint")
    return (df.select(trailing_country(F.col("affiliations")).alias("country"))
            .groupBy("country").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_first("country")).limit(n))


def source_counts(df: DataFrame) -> DataFrame:
    """Articles per source, most first."""
    return (df.groupBy(F.col("source").alias("Source"))
            .agg(F.count(F.lit(1)).alias("Count"))
            .orderBy(F.desc("Count"), F.asc("Source")))


def text_column(df: DataFrame) -> str | None:
    """P5: ``abstract_`` if present, else ``abstract``, else none."""
    for c in ("abstract_", "abstract"):
        if c in df.columns:
            return c
    return None


def quality_counts(df: DataFrame, key: str = "title") -> DataFrame:
    """Raw rows, rows with a valid abstract, distinct titles and surplus copies, in one job.

    Conditional counts are computed on the per-title partial groups, so
    the whole collection is scanned once.
    """
    tc = text_column(df)
    valid = is_valid_text(F.col(tc)) if tc else F.lit(False)
    per_title = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                                    F.count_if(valid).alias("v"))
    return per_title.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_articles"),
        F.coalesce(F.sum("v"), F.lit(0)).cast("bigint").alias("valid_abstracts"),
        F.count(F.lit(1)).alias("distinct_titles"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )
