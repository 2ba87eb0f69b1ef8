"""Explicit schemas: no inference on any read path."""

from __future__ import annotations

from pyspark.sql import types as T

# Article record as the collectors emit it: every field is a string.
ARTICLE_FIELDS = ["title", "authors", "date_pub", "source", "journal", "abstract_"]

ARTICLE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in ARTICLE_FIELDS])

# The wide collector declares four more, never-filled fields.
WIDE_ARTICLE_SCHEMA = T.StructType(ARTICLE_SCHEMA.fields + [
    T.StructField("topic", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("longitude", T.DoubleType(), True),
])

# Landed collection: explicit ingest order (keep-first needs it) + affiliations.
COLLECTION_SCHEMA = T.StructType(
    [T.StructField("ingest_id", T.LongType(), False)]
    + ARTICLE_SCHEMA.fields
    + [T.StructField("affiliations", T.StringType(), True)]
)

# Fact table F_Publications (nine columns) plus the ingest order.
FACT_COLUMNS = ["title", "authors", "Annee", "Pays", "Journal", "Quartile",
                "Citations", "Impact_Score", "abstract_"]

FACT_SCHEMA = T.StructType([
    T.StructField("title", T.StringType(), True),
    T.StructField("authors", T.StringType(), True),
    T.StructField("Annee", T.IntegerType(), True),
    T.StructField("Pays", T.StringType(), True),
    T.StructField("Journal", T.StringType(), True),
    T.StructField("Quartile", T.StringType(), True),
    T.StructField("Citations", T.LongType(), True),
    T.StructField("Impact_Score", T.DoubleType(), True),
    T.StructField("abstract_", T.StringType(), True),
])

TOPIC_DIST_SCHEMA = T.StructType([
    T.StructField("Topic", T.StringType(), True),
    T.StructField("Count", T.LongType(), True),
])

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType(), False),
    T.StructField("url", T.StringType(), True),
    T.StructField("html", T.StringType(), True),
])
