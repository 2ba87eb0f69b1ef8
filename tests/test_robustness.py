"""Every operator over a messy collection, under ANSI mode (Spark 4 default)."""

from pyspark.sql import functions as F

from citeweave.functions.years import is_exact_year
from citeweave.operators import dedupe, graph, olap, stats, textmine, warehouse
from citeweave.operators.lda import lda_topics
from conftest import collection

TEXT = "Ledger consensus for  supply chains and health records, 2021 edition. "
MESSY = [
    (1, "", "", "Unknown Date", "ACM Digital Library", "ACM", "N/A", None),
    (2, None, None, None, None, None, None, None),
    (3, "Blockchain A", "A, B, + 4", "2025", "IEEE Xplore", "IEEE", TEXT * 3, "Lab, USA"),
    (4, "Blockchain A", "NA", "12034 in 2021", "IEEE Xplore", "IEEE", "x" * 20, "Lab, United States"),
    (5, "Unknown Title", "Unknown", "Unknown", "ScienceDirect", "SD", TEXT, "no comma"),
    (6, "IoT edge", "C\nD, C\nD", "1999", "ScienceDirect", "SD", "   " * 10, "Lab, France"),
    (7, "Privacy", "E, F", "2024", "ACM Digital Library", "ACM", TEXT + "privacy", "Lab, Canada"),
]


def test_every_operator_runs_on_messy_rows(spark):
    coll = collection(spark, MESSY)
    fact = warehouse.fact_publications(coll)
    sl = olap.olap_slice(fact, olap.Slice(years=(1900, 2100)))
    toks = textmine.tokenize(textmine.valid_abstracts(coll))
    dtc = textmine.doc_term_counts(toks)
    vocab = textmine.vocabulary(dtc)
    period = F.when(is_exact_year(F.col("date_pub")), F.col("date_pub").cast("int")).alias("period")
    ptoks = textmine.tokenize(textmine.valid_abstracts(coll, keep=(period,)))
    edges = graph.coauthor_edges(sl)
    frames = [
        stats.trends(coll), stats.top_authors_raw(coll), stats.geography(coll), stats.source_counts(coll),
        stats.quality_counts(coll), dedupe.duplicate_titles(coll), dedupe.dedupe_titles(coll),
        dedupe.surplus_rows(coll), dedupe.dedupe_report(coll),
        dedupe.insert_if_absent(coll, coll.where("ingest_id > 3")), fact, sl, olap.kpis(sl),
        olap.pubs_per_year(sl), olap.year_quartile_pivot(sl), olap.quartile_counts(sl),
        olap.impact_box_stats(sl), olap.pubs_per_country(sl), olap.impact_by_year(sl), olap.top_authors(sl),
        olap.dimension_members(fact), olap.topic_distribution(fact), olap.topic_articles(sl, "IoT & Edge"),
        olap.olap_cube(fact), edges, graph.coauthor_sample(sl), graph.coauthor_top_edges(edges),
        graph.author_degree(edges), vocab, textmine.term_frequencies(dtc, vocab),
        textmine.tfidf(dtc, vocab, toks), textmine.doc_keywords(dtc, toks),
        textmine.word_cloud_terms(toks), textmine.weak_signals(ptoks, "period", max_doc_share=1.0),
        lda_topics(toks, vocab, k=2, max_iter=2),
    ]
    counts = [f.count() for f in frames]
    assert all(c >= 0 for c in counts)
    assert stats.trends(coll).count() == 3                         # exact years 2025, 1999, 2024
    assert {r["title"] for r in dedupe.dedupe_titles(coll).collect()} == {
        "", None, "Blockchain A", "Unknown Title", "IoT edge", "Privacy"}
    # 20 characters is too short; 30 blanks pass the length rule (the reference keeps them too)
    assert sorted(r["doc_id"] for r in textmine.valid_abstracts(coll).collect()) == [3, 5, 6, 7]
