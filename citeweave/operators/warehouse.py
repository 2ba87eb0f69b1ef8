"""Fact table F_Publications.

Built from the deduplicated collection: one fact row per title.  The time
dimension is ``clean_year(date_pub)``; ``Journal`` copies ``source`` (not
the item's journal).  ``Pays``, ``Citations`` and ``Impact_Score`` are the
collection's own ``country``, ``citations`` and ``impact_score``; a
collection without one of these has NULL there.  ``Quartile`` ranks the
articles by their impact score.  ``ingest_id`` is kept as the row order of
the exported collection ("first 50 papers").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import QUARTILES
from ..functions.years import clean_year
from ..schema import FACT_COLUMNS
from ..session import materialize
from .dedupe import dedupe_titles
from .selection import percentiles


def quartile(value: Column, rows: DataFrame) -> Column:
    """Q1 above the upper quartile of ``value`` over ``rows``, Q2 above the median, Q3 above the lower
    quartile, else Q4; NULL without a value.

    The cut points are exact, by distributed selection over the landed values: no task holds the column's
    distinct values, and no window runs over all rows."""
    values = materialize(rows.select(value.alias("v")).where("v IS NOT NULL"), "ranked_values")
    cuts = percentiles(values, "v", [0.75, 0.5, 0.25])
    if not cuts:
        return F.lit(None).cast("string")
    high, middle, low = cuts[None].points
    best, good, fair, rest = QUARTILES
    return (F.when(value.isNull(), F.lit(None)).when(value > high, best).when(value > middle, good)
            .when(value > low, fair).otherwise(rest))


def fact_from_collection(coll: DataFrame) -> DataFrame:
    """Fact columns over an already title-unique collection."""
    def own(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in coll.columns else F.lit(None).cast(kind)
    impact = own("impact_score", "double")
    return coll.select(
        "ingest_id", "title", "authors",
        clean_year(F.col("date_pub")).alias("Annee"),
        F.nullif(own("country", "string"), F.lit("")).alias("Pays"),
        F.col("source").alias("Journal"),
        quartile(F.round(impact * 100).cast("bigint"), coll).cast("string").alias("Quartile"),
        own("citations", "bigint").alias("Citations"),
        impact.alias("Impact_Score"),
        "abstract_",
    )


def fact_publications(articles: DataFrame) -> DataFrame:
    """Dedupe the collection (keep first per title) and derive the fact columns."""
    return fact_from_collection(dedupe_titles(articles))


def fact_columns(fact: DataFrame) -> DataFrame:
    """The nine published fact columns, without the ingest order."""
    return fact.select(*FACT_COLUMNS)
