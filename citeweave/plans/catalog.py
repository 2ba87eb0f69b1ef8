"""Named queries: each takes (spark, sf_dir) and returns a lazy DataFrame.

The collection (``sources.articles``) and the warehouse fact are landed
once per application in the shared folder, the way the reference lands its
collection and its fact table before analysing them; the fact is written
partitioned by ``Annee`` so the year slider of every dashboard view prunes
directories at the scan.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MISSING_ABSTRACT
from ..functions.topics import topic_label
from ..functions.years import clean_year, is_exact_year
from ..operators import cube_states, dedupe, graph, olap, stats, textmine, warehouse
from ..operators.lda import lda_topics, topic_facts
from ..operators.warehouse import fact_columns
from ..session import COMPACT, landings, materialize, released_shuffles, work_path
from ..schema import FACT_SCHEMA
from ..sources.articles import articles, measured_articles
from ..sources.documents import columns, fields, land_documents, write_arrays
from ..sources.extract import DEFAULT_RULES, extract_articles
from ..sources.readers import read_csv_optional
from ..sources.tables import table
from ..sources.writers import csv_round_trip, export_by_source, json_round_trip, write_csv
from ..streaming.ingest import run_title_ingest, run_title_ingest_keep_first, run_title_ingest_stateful

# --- fixed query parameters --------------------------------------------------
# The fixture's years are 1995-2001; clean_year maps 1995-1999 to 2024, so the
# dashboard slice spans 2000-2024 to keep several years.
DASHBOARD = olap.Slice(years=(2000, 2024))
OLAP_SLICE = olap.Slice(years=(2000, 2024), quartiles=("Q1", "Q2", "Q3"),
                        countries=tuple(f"NATION_{i}" for i in range(0, 25, 3)))
DRILL_TOPIC = "AI & Blockchain"
INSERT_SHARE = 3             # batch = the ids of the lowest third of their range, table = the others
KEYWORDS_PER_DOC = 5
WORD_CLOUD_TERMS = 100
WEAK_SIGNALS = 20

_FACTS: dict[tuple[str, str], str] = landings()
_LOCK = threading.Lock()


def fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed fact (ingest_id, the nine fact columns), partitioned by ``Annee``.

    Rebalanced on the year before the write: a year's rows come in files of the advisory size, and a year that
    holds most rows is written by many tasks."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:                       # callers may run queries from several threads
        path = _FACTS.get(key)
        if path is None:
            tag = hashlib.sha1(key[1].encode()).hexdigest()[:12]
            path = work_path(spark, f"fact_{tag}")
            fact = warehouse.fact_from_collection(dedupe.dedupe_landed(measured_articles(spark, sf_dir)))
            with released_shuffles(spark):
                fact.hint("rebalance", "Annee").write.mode("overwrite").partitionBy("Annee").parquet(path, compression=COMPACT)
            _FACTS[key] = path
    f = spark.read.parquet(path)
    return f.select("ingest_id", "title", "authors", F.col("Annee").cast("int"), "Pays", "Journal",
                    "Quartile", "Citations", "Impact_Score", "abstract_")


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return olap.olap_slice(fact_table(spark, sf_dir), DASHBOARD)


_CELLS: dict[tuple[str, str], DataFrame] = landings()


def cube_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube's cells with their states, landed once per application; the views of a slice read these alone."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    fact = fact_table(spark, sf_dir)
    with _LOCK:
        if key not in _CELLS:
            _CELLS[key] = materialize(cube_states.cells(fact), "cube_cells")
        return _CELLS[key]


def dashboard_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return olap.olap_slice(cube_table(spark, sf_dir), DASHBOARD)


def _cube_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the box statistics read from the cube lie within three times its stated error of the exact ones."""
    e = cube_states.rank_errors(dashboard_cells(spark, sf_dir), dashboard(spark, sf_dir))
    near = [(F.col(f"{c}_error") <= 3 * cube_states.RANK_ERROR).alias(f"{c}_near") for c in ("q1", "median", "q3", "outlier")]
    return e.select("Quartile", "n", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), *near).orderBy("Quartile")


def pages_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "pages"), DEFAULT_RULES)


def _tokens(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return textmine.tokenize(textmine.valid_abstracts(articles(spark, sf_dir), keep=keep))


_TERMS: dict[tuple[str, str], DataFrame] = landings()


def terms_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term counts of every document, landed once per application in buckets of documents."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:
        if key not in _TERMS:
            _TERMS[key] = textmine.land_terms(_docs(spark, sf_dir))
        return _TERMS[key]


def _dtc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms_table(spark, sf_dir)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textmine.valid_abstracts(articles(spark, sf_dir))


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    dtc = _dtc(spark, sf_dir)
    return textmine.term_frequencies(dtc, textmine.vocabulary(dtc))


def _tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    dtc = _dtc(spark, sf_dir)
    return textmine.tfidf(dtc, textmine.vocabulary(dtc), _docs(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coauthor_edges(dashboard(spark, sf_dir))


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.union_sources([articles(spark, sf_dir), pages_articles(spark, sf_dir)])


def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    r = a.agg(F.min("ingest_id").alias("lo"), F.max("ingest_id").alias("hi")).first()
    split = 0 if r["lo"] is None else r["lo"] + (r["hi"] - r["lo"]) // INSERT_SHARE
    return dedupe.insert_if_absent(a.where(F.col("ingest_id") < split), a.where(F.col("ingest_id") >= split))


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_round_trip(articles(spark, sf_dir), work_path(spark, f"json-{uuid.uuid4().hex[:12]}"))


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_round_trip(fact_table(spark, sf_dir), work_path(spark, f"csv-{uuid.uuid4().hex[:12]}"))


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection as JSON arrays whose objects lack fields and bring some that no schema names, read back."""
    own = measured_articles(spark, sf_dir).withColumn("abstract_", F.nullif("abstract_", F.lit(MISSING_ABSTRACT))).drop("impact_score", "lang")
    path = work_path(spark, f"arrays-{uuid.uuid4().hex[:12]}")
    write_arrays(own, path)
    docs = land_documents(spark, path)
    return columns(docs, fields(docs))


def _guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come of optional inputs: the text column under either name or none, topics of an empty corpus, and a
    result table that is there or missing."""
    coll = articles(spark, sf_dir)
    other = coll.withColumnRenamed("abstract_", "abstract")
    fact = work_path(spark, f"fact-csv-{uuid.uuid4().hex[:12]}")
    write_csv(fact_columns(fact_table(spark, sf_dir)), fact)
    empty = lda_topics(textmine.tokenize(textmine.valid_abstracts(coll.where(F.col("abstract_") == MISSING_ABSTRACT))))
    cases = {"abstract_": textmine.valid_abstracts(coll), "abstract": textmine.valid_abstracts(other),
             "no text column": textmine.valid_abstracts(coll.drop("abstract_")), "topics of no text": empty,
             "result table": read_csv_optional(spark, fact, FACT_SCHEMA), "missing table": read_csv_optional(spark, f"{fact}-none", FACT_SCHEMA)}
    counted = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("input"), "rows") for name, df in cases.items()]
    return reduce(DataFrame.unionByName, counted)


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, f"export_by_source-{uuid.uuid4().hex[:12]}")
    return export_by_source(articles(spark, sf_dir), out)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a fresh landing folder, table and checkpoint per run
    base = work_path(spark, f"stream_ingest-{uuid.uuid4().hex[:12]}")
    return run_title_ingest(spark, articles(spark, sf_dir), base)


def _stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_path(spark, f"stream_ingest_state-{uuid.uuid4().hex[:12]}")
    return run_title_ingest_stateful(spark, articles(spark, sf_dir), base).select("title")


def _stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_path(spark, f"stream_ingest_first-{uuid.uuid4().hex[:12]}")
    return run_title_ingest_keep_first(spark, articles(spark, sf_dir), base)


def _weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the period of a document is its exact publication year; sentinels such as
    # "Unknown Date" give no period (a plain cast would fail under ANSI mode)
    period = F.when(is_exact_year(F.col("date_pub")), F.col("date_pub").cast("int"))
    toks = textmine.tokenize(textmine.valid_abstracts(articles(spark, sf_dir), keep=(period.alias("period"),)))
    return textmine.weak_signals(toks, "period", WEAK_SIGNALS)


def _language_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = textmine.valid_abstracts(measured_articles(spark, sf_dir), keep=("lang",))
    return textmine.tokenize_by_language(docs)


_LANGUAGE_VOCABULARIES: dict[tuple[str, str], DataFrame] = landings()


def _language_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary without the stop words of each document's language, landed once per application."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    docs = textmine.valid_abstracts(measured_articles(spark, sf_dir), keep=("lang",))
    with _LOCK:
        if key not in _LANGUAGE_VOCABULARIES:
            terms = textmine.land_terms(docs, textmine.tokenize_by_language)
            _LANGUAGE_VOCABULARIES[key] = materialize(textmine.vocabulary(terms), "lda_vocabulary")
        return _LANGUAGE_VOCABULARIES[key]


def _lda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lda_topics(_language_tokens(spark, sf_dir), _language_vocabulary(spark, sf_dir))


def _lda_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = _language_vocabulary(spark, sf_dir)
    return topic_facts(lda_topics(_language_tokens(spark, sf_dir), vocab), vocab)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # analysis stage: corpus statistics
    "trends": lambda s, d: stats.trends(articles(s, d)),
    "top_authors_raw": lambda s, d: stats.top_authors_raw(articles(s, d)),
    "geography": lambda s, d: stats.geography(articles(s, d)),
    "source_counts": lambda s, d: stats.source_counts(articles(s, d)),
    "quality_counts": lambda s, d: stats.quality_counts(articles(s, d)),
    # collection: dedupe and ingest
    "duplicate_titles": lambda s, d: dedupe.duplicate_titles(articles(s, d)),
    "dedupe_titles": lambda s, d: dedupe.dedupe_titles(articles(s, d)),
    "surplus_rows": lambda s, d: dedupe.surplus_rows(articles(s, d)).select("ingest_id", "title"),
    "dedupe_report": lambda s, d: dedupe.dedupe_report(articles(s, d)),
    "title_uniqueness": lambda s, d: dedupe.title_uniqueness(dedupe.dedupe_titles(articles(s, d))),
    "insert_if_absent": _insert,
    "union_sources": _union,
    "export_by_source": _export,
    "json_round_trip": _json,
    "csv_round_trip": _csv,
    "json_array_scan": _arrays,
    "input_guards": _guards,
    "extract_articles": pages_articles,
    "stream_ingest": _stream,
    "stream_ingest_state": _stream_state,
    "stream_ingest_first": _stream_first,
    # warehouse: dimensions and fact
    "clean_year": lambda s, d: articles(s, d).select("ingest_id", "date_pub",
                                                     clean_year(F.col("date_pub")).alias("Annee")),
    "topic_label": lambda s, d: articles(s, d).select("ingest_id", "title",
                                                      topic_label(F.col("title")).alias("Topic")),
    "topic_label_words": lambda s, d: articles(s, d).select(
        "ingest_id", "title", topic_label(F.col("title"), whole_word=True).alias("Topic")),
    "fact_publications": lambda s, d: warehouse.fact_publications(measured_articles(s, d)),
    # dashboard views
    "olap_slice": lambda s, d: olap.olap_slice(fact_table(s, d), OLAP_SLICE),
    "kpis": lambda s, d: olap.kpis(dashboard(s, d)),
    "pubs_per_year": lambda s, d: olap.pubs_per_year(dashboard(s, d)),
    "year_quartile_pivot": lambda s, d: olap.year_quartile_pivot(dashboard(s, d)),
    "quartile_counts": lambda s, d: olap.quartile_counts(dashboard(s, d)),
    "impact_box_stats": lambda s, d: olap.impact_box_stats(dashboard(s, d)),
    "pubs_per_country": lambda s, d: olap.pubs_per_country(dashboard(s, d)),
    "impact_by_year": lambda s, d: olap.impact_by_year(dashboard(s, d)),
    "top_authors": lambda s, d: olap.top_authors(dashboard(s, d)),
    "dimension_members": lambda s, d: olap.dimension_members(fact_table(s, d)),
    "topic_distribution": lambda s, d: olap.topic_distribution(fact_table(s, d)),
    "topic_articles": lambda s, d: olap.topic_articles(dashboard(s, d), DRILL_TOPIC),
    "olap_cube": lambda s, d: olap.olap_cube(fact_table(s, d)),
    "cube_groupings": lambda s, d: cube_states.groupings(cube_table(s, d)),
    "cube_kpis": lambda s, d: cube_states.kpis(dashboard_cells(s, d)),
    "cube_box_errors": _cube_errors,
    # co-author graph
    "coauthor_edges": _edges,
    "coauthor_sample": lambda s, d: graph.coauthor_sample(dashboard(s, d)),
    "coauthor_top_edges": lambda s, d: graph.coauthor_top_edges(_edges(s, d)),
    "author_degree": lambda s, d: graph.author_degree(_edges(s, d)),
    # text
    "valid_abstracts": lambda s, d: textmine.valid_abstracts(articles(s, d)),
    "vocabulary": lambda s, d: textmine.vocabulary(_dtc(s, d)),
    "term_frequencies": _tf,
    "tfidf": _tfidf,
    "doc_keywords": lambda s, d: textmine.doc_keywords(_dtc(s, d), _docs(s, d), KEYWORDS_PER_DOC),
    "word_cloud_terms": lambda s, d: textmine.word_cloud_terms(_tokens(s, d), WORD_CLOUD_TERMS),
    "weak_signals": _weak,
    "lda_topics": _lda,
    "lda_topic_facts": _lda_facts,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)

