"""The reference's batch runs as result writers.

``analysis``: trends, raw top authors, geography and LDA topics of a
collection, one CSV folder each.  ``warehouse``: the fact table plus the
tables the dashboard reads beside it (topic distribution, articles per
source, mean citations per year).  ``dashboard``: the data behind every view
of the dashboard for one sidebar state, read from the warehouse's Parquet
fact.  The fact is landed once as Parquet with its ``ingest_id``; its CSV is an
export.  Results bounded by construction (top-k, one row per
year/source/topic/quartile/country) are written as one file; unbounded ones
(the fact table, the slice, edges) by every task in parallel.

Usage::

    python -m citeweave.plans.reports analysis  --json final_data.json --out results
    python -m citeweave.plans.reports warehouse --json final_data.json --out results
    python -m citeweave.plans.reports dashboard --warehouse results --out views --years 2020 2025
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import graph, olap, stats, textmine, warehouse
from ..operators.lda import lda_topics
from ..schema import COLLECTION_SCHEMA, FACT_SCHEMA, TOPIC_DIST_SCHEMA
from ..session import build_session, clear_work
from ..sources.readers import input_files, land, read_csv_optional, read_json_positions
from ..sources.writers import write_csv

FACT = "F_Publications.parquet"
BOUNDED = {"trends", "authors", "geography", "topics", "topics_dist", "impact", "kpis",
           "pubs_per_year", "year_quartile_pivot", "quartile_counts", "impact_box_stats", "pubs_per_country",
           "top_authors", "dimension_members", "coauthor_sample"}


POSITION_BITS = 33          # records of one file, as a power of two


def collection_from_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON-array exports as a collection: ``ingest_id`` follows file name, then position.

    The position comes from the array itself, the file's rank from the listing of
    the input, sorted by path (one row per file, which the driver holds anyway).
    Missing fields are NULL.  ``affiliations`` is kept only when some record has
    it: the collectors do not emit it, and geography runs only where the field exists.
    """
    fields = StructType([f for f in COLLECTION_SCHEMA.fields if f.name != "ingest_id"])
    df = read_json_positions(spark, path, fields)
    files = spark.createDataFrame(list(enumerate(input_files(spark, path))), "rank bigint, file string")
    df = (df.join(files, "file")
          .withColumn("ingest_id", F.shiftleft(F.col("rank"), POSITION_BITS) + F.col("pos"))
          .select(*COLLECTION_SCHEMA.fieldNames()))
    if df.where(F.col("affiliations").isNotNull()).isEmpty():
        df = df.drop("affiliations")
    return df


def analysis_results(coll: DataFrame) -> dict[str, DataFrame]:
    out = {"trends": stats.trends(coll), "authors": stats.top_authors_raw(coll)}
    if "affiliations" in coll.columns:
        out["geography"] = stats.geography(coll)
    toks = textmine.tokenize(textmine.valid_abstracts(coll))
    if not toks.isEmpty():
        out["topics"] = lda_topics(toks)
    return out


def warehouse_results(coll: DataFrame, out_dir: str) -> dict[str, DataFrame]:
    """The fact, landed as Parquet below ``out_dir``, and the tables read beside it."""
    fact = land(warehouse.fact_publications(coll), f"{out_dir.rstrip('/')}/{FACT}")
    return {
        "F_Publications": warehouse.fact_columns(fact),
        "topics_dist": olap.topic_distribution(fact),
        "sources": stats.source_counts(coll),
        "impact": olap.impact_by_year(fact),
    }


def dashboard_results(fact: DataFrame, topics_dist: DataFrame, s: olap.Slice,
                      topic: str | None = None) -> dict[str, DataFrame]:
    """Every dashboard view for one sidebar state.

    ``fact`` has the nine columns and the ``ingest_id`` that "first 50 papers"
    follows; ``topics_dist`` is shown as read.
    """
    sl = olap.olap_slice(fact, s)
    edges = graph.coauthor_edges(sl)
    out = {
        "kpis": olap.kpis(sl), "pubs_per_year": olap.pubs_per_year(sl),
        "year_quartile_pivot": olap.year_quartile_pivot(sl), "quartile_counts": olap.quartile_counts(sl),
        "impact_box_stats": olap.impact_box_stats(sl), "pubs_per_country": olap.pubs_per_country(sl),
        "top_authors": olap.top_authors(sl), "dimension_members": olap.dimension_members(fact),
        "topics_dist": topics_dist, "coauthor_sample": graph.coauthor_sample(sl),
        "coauthor_edges": edges, "author_degree": graph.author_degree(edges),
    }
    if topic is not None:
        out["topic_articles"] = olap.topic_articles(sl, topic)
    return out


def read_warehouse(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The warehouse's output: the Parquet fact and the topic distribution (S4), empty when absent."""
    schema = StructType([COLLECTION_SCHEMA["ingest_id"], *FACT_SCHEMA.fields])
    fact = spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{FACT}")
    return fact, read_csv_optional(spark, f"{folder.rstrip('/')}/topics_dist.csv", TOPIC_DIST_SCHEMA)


def write_results(results: dict[str, DataFrame], out_dir: str) -> list[str]:
    paths = []
    for name, df in results.items():
        path = f"{out_dir.rstrip('/')}/{name}.csv"
        write_csv(df, path, single_file=name in BOUNDED)
        paths.append(path)
    return paths


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("run", choices=["analysis", "warehouse", "dashboard"])
    ap.add_argument("--json", help="JSON-array export of the collection (analysis, warehouse)")
    ap.add_argument("--warehouse", help="folder written by the warehouse run (dashboard)")
    ap.add_argument("--out", required=True, help="output folder")
    ap.add_argument("--years", nargs=2, type=int, default=[2020, 2025])
    ap.add_argument("--quartiles", nargs="*", default=None)
    ap.add_argument("--countries", nargs="*", default=None)
    ap.add_argument("--topic", default=None, help="topic to drill down into")
    ap.add_argument("--master", default=None, help="Spark master (default: the deployment's, as under spark-submit)")
    a = ap.parse_args(argv)
    spark = build_session(a.master)
    if a.run == "dashboard":
        fact, topics = read_warehouse(spark, a.warehouse)
        s = olap.Slice(years=tuple(a.years), quartiles=a.quartiles and tuple(a.quartiles),
                       countries=a.countries and tuple(a.countries))
        res = dashboard_results(fact, topics, s, a.topic)
    else:
        coll = collection_from_json(spark, a.json)
        res = analysis_results(coll) if a.run == "analysis" else warehouse_results(coll, a.out)
    for p in write_results(res, a.out):
        print(p)
    clear_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()
