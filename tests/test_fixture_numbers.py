
import pytest
from pyspark.sql import functions as F

from citeweave.functions.topics import topic_label
from citeweave.operators import dedupe, graph
from citeweave.sources.articles import articles
from citeweave.sources.extract import extract_articles
from citeweave.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def arts(spark):
    return articles(spark, SF)


def test_article_view(arts):
    assert arts.count() == 15000
    # 927 distinct texts, and an own title for every order without a document
    with_text = arts.where(F.col("abstract_") != "N/A")
    assert with_text.select("title").distinct().count() == with_text.select("abstract_").distinct().count() == 927
    assert arts.select("title").distinct().count() == 927 + 14000
    assert arts.where(F.col("abstract_") == "N/A").count() == 14000
    assert arts.where(F.col("authors") == "Unknown").count() == 257


def test_topic_labels_on_document_text(spark):
    docs = table(spark, SF, "documents")
    got = {r[0]: r[1] for r in docs.groupBy(topic_label(F.col("text"))).count().collect()}
    assert got == {"AI & Blockchain": 632, "IoT & Edge": 8, "General Blockchain": 360}


def test_coauthor_edges_over_all_articles(arts):
    assert graph.coauthor_edges(arts).count() == 5050


def test_insert_if_absent_split(arts):
    batch, existing = arts.where("ingest_id < 500"), arts.where("ingest_id >= 500")
    absent = batch.join(existing.select(F.col("title").alias("t")), batch.title.eqNullSafe(F.col("t")), "left_anti")
    got = dedupe.insert_if_absent(batch, existing)
    assert got.count() == absent.select("title").distinct().count() < batch.count()


def test_pages_extract_one_article_each(spark):
    assert extract_articles(table(spark, SF, "pages")).count() == 250
