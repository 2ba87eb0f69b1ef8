"""LDA topic model over TF-IDF weights (M5-M7).

The vocabulary comes from ``textmine.vocabulary`` (stable at the cut), or is
taken as given; its strings are the only data that reach the driver, where
``CountVectorizerModel`` needs them anyway.  Vectors, IDF and the online LDA
fit are Spark ML jobs; topic descriptions are turned into keyword strings by
a join with the vocabulary, not a driver loop.

The fit sees the documents in a layout that follows from the corpus alone:
dealt by id over a number of partitions that their count gives, and sorted
within.  Its sums then add up in the same order whatever partitions the corpus
came in and whatever the cluster, and the number of tasks grows with the corpus.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LDA_K, LDA_MAX_ITER, LDA_SEED, TOPIC_TERMS
from . import textmine

TOPICS_SCHEMA = "Topic int, Keywords string"
DOCS_PER_TASK, MILLION = 200, 1_000_000
READ_ALL = 1.0              # share of the documents that an iteration reads


def layout_of(n_docs: int) -> int:
    """Partitions of the fit: two hundred documents each, and beyond a million documents more in each, as the square
    root grows (10^10 documents: 500,000 partitions of 20,000)."""
    return max(1, math.ceil(n_docs / (DOCS_PER_TASK * max(1.0, math.sqrt(n_docs / MILLION)))))


def lda_topics(tokens: DataFrame, vocab: DataFrame | None = None, k: int = LDA_K,
               max_iter: int = LDA_MAX_ITER, seed: int = LDA_SEED, n_terms: int = TOPIC_TERMS,
               rate: float = READ_ALL, layout: int | None = None) -> DataFrame:
    """(Topic, Keywords): the ``n_terms`` heaviest terms of each of ``k`` topics, joined by ``", "``.

    ``tokens`` has ``doc_id`` and ``content`` (tokens without stop words); without
    ``vocab`` the vocabulary is built from the same tokens.  ``rate`` is the
    optimizer's mini-batch: 1 reads every document in every iteration, smaller
    values a sample of them.  The laid-out tokens and the sparse vectors are kept
    (memory, spilling to disk) for the iterations; a lost block is recomputed from
    the landed collection.  M7: an empty corpus gives an empty result instead of a
    failed fit.
    """
    spark = tokens.sparkSession
    n_docs = tokens.select("doc_id").count()
    if n_docs == 0:
        return spark.createDataFrame([], TOPICS_SCHEMA)
    laid = tokens.select("doc_id", "content").repartition(layout or layout_of(n_docs), "doc_id").sortWithinPartitions("doc_id", "content")
    docs = laid.persist(StorageLevel.MEMORY_AND_DISK)
    tf = None
    try:
        if vocab is None:
            vocab = textmine.vocabulary(textmine.doc_term_counts(docs))
        terms = [r["term"] for r in vocab.orderBy("term_index").collect()]
        cv = CountVectorizerModel.from_vocabulary(terms, inputCol="content", outputCol="counts")
        tf = cv.transform(docs).select("counts").persist(StorageLevel.MEMORY_AND_DISK)
        weighted = IDF(inputCol="counts", outputCol="weights").fit(tf).transform(tf)
        model = LDA(k=k, maxIter=max_iter, optimizer="online", seed=seed, subsamplingRate=rate,
                    featuresCol="weights").fit(weighted)
        picked = model.describeTopics(n_terms).select(F.col("topic").alias("Topic"),
                                                      F.posexplode("termIndices").alias("pos", "term_index"))
        # the vocabulary is already on the driver for CountVectorizerModel; the
        # result must not depend on the released caches
        named = picked.join(spark.createDataFrame(list(enumerate(terms)), "term_index int, term string"), "term_index")
        return (named.groupBy("Topic")
                .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))),
                                              lambda x: x["term"]), ", ").alias("Keywords"))
                .select(F.col("Topic").cast("int"), "Keywords").orderBy("Topic"))
    finally:
        docs.unpersist()
        if tf is not None:
            tf.unpersist()


def topic_facts(topics: DataFrame, vocab: DataFrame) -> DataFrame:
    """What holds of any fit: per topic its number of terms, of distinct ones, and of those in the vocabulary."""
    each = topics.select("Topic", F.explode(F.split("Keywords", ", ")).alias("term"))
    known = vocab.select("term", F.lit(1).alias("known"))
    return each.join(known, "term", "left").groupBy("Topic").agg(
        F.count(F.lit(1)).alias("terms"), F.countDistinct("term").alias("distinct_terms"), F.count("known").alias("in_vocabulary"))
