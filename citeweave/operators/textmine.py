"""Text operators of the analysis stage.

Tokens follow Spark ML's ``Tokenizer`` (lower-case, split on each
whitespace character, trailing empty tokens dropped as Java's
``String.split`` does) and ``StopWordsRemover`` (Spark's English list,
case-insensitive), written as native expressions: unlike the ML
transformers (opaque Scala UDFs) they join whole-stage codegen and let Spark
reuse one tokenisation exchange for several branches of a plan.
``tests/test_text.py`` checks both forms give the same tokens.  Everything
after that is long-form DataFrame work keyed by (doc, term), so no
per-document vector or vocabulary map ever sits in a Python worker or the
driver:

* term frequency  = count per (doc, term); where the documents come dealt out by
                    id (``land_terms``) no row moves for it
* vocabulary      = top ``VOCAB_SIZE`` terms by (count desc, term asc), counted map-side
                    first (the stable tie-break replaces CountVectorizer's arbitrary
                    order at the cut)
* idf             = ln((N + 1) / (df + 1)), as Spark ML's IDF
* tf-idf          = tf * idf
* keywords        = bounds of every document frequency from a table of bounded
                    size; only terms that can be among a document's first meet
                    exact frequencies

Global counts enter as scalar subqueries (one value each), not joins; whether
a vocabulary or period table is broadcast is left to its measured size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ENGLISH_STOP_WORDS, MIN_DF, VOCAB_SIZE
from ..functions.text import is_valid_text
from ..session import materialize, materialize_bucketed
from .stats import text_column


def valid_abstracts(df: DataFrame, id_col: str = "ingest_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents with a usable abstract as (doc_id, text_content)."""
    tc = text_column(df)
    if tc is None:
        return df.sparkSession.createDataFrame([], "doc_id bigint, text_content string")
    return (df.where(is_valid_text(F.col(tc)))
            .select(F.col(id_col).alias("doc_id"), *keep, F.col(tc).alias("text_content")))


# --- fixed values: the characters of Java's ``\s`` class -----------------
JAVA_WHITESPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """M1: ``Tokenizer`` semantics: lower-case, split at each whitespace character,
    trailing empty tokens dropped (``""`` gives one empty token, all-blank text none)."""
    low = F.lower(text)
    body = F.rtrim(low, F.lit(JAVA_WHITESPACE))
    return (F.when(text == "", F.array(F.lit("")))
            .when(body == "", F.array().cast("array<string>"))
            .otherwise(F.split(body, r"\s")))


def drop_stop_words(tokens: Column, stop_words: list[str] = ENGLISH_STOP_WORDS) -> Column:
    """M2: ``StopWordsRemover`` semantics, case-insensitive (the list is lower case)."""
    stop = sorted({w.lower() for w in stop_words})
    return F.filter(tokens, lambda x: ~F.lower(x).isin(stop))


def tokenize(docs: DataFrame, stop_words: list[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """M1/M2: adds ``words`` (all tokens) and ``content`` (stop words removed)."""
    return (docs.withColumn("words", words(F.col("text_content")))
            .withColumn("content", drop_stop_words(F.col("words"), stop_words)))


# Spark's own stop-word lists by the language code of a document.
STOP_WORD_LISTS = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}


def tokenize_by_language(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """M1/M2 with the stop words of each document's own language (English where it is unknown or not listed)."""
    from pyspark.ml.feature import StopWordsRemover
    w = F.col("words")
    content = F.when(F.lit(False), w)
    for code, name in STOP_WORD_LISTS.items():
        content = content.when(F.col(lang) == code, drop_stop_words(w, StopWordsRemover.loadDefaultStopWords(name)))
    return docs.withColumn("words", words(F.col("text_content"))) \
        .withColumn("content", content.otherwise(drop_stop_words(w)))


def content_terms(tokens: DataFrame, *keep: str, stop_words: list[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """One row per kept token: ``words`` exploded, stop words dropped by a hash-set
    ``NOT IN`` (tokens are already lower case), all inside whole-stage codegen.

    A document without tokens gives no rows."""
    stop = sorted({w.lower() for w in stop_words})
    # explode_outer: an inner explode makes the optimizer add a size(words) > 0
    # filter below it, which would tokenise every document twice
    return (tokens.select(*keep, F.explode_outer("words").alias("term"))
            .where(F.col("term").isNotNull() & ~F.col("term").isin(stop)))


def doc_term_counts(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf) over the tokens without stop words."""
    # explode_outer, as above
    rows = tokens.select("doc_id", F.explode_outer("content").alias("term")).where(F.col("term").isNotNull())
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def land_terms(docs: DataFrame, tokenizer=tokenize) -> DataFrame:
    """``doc_term_counts`` of documents (doc_id, text_content), landed in buckets of documents.

    Texts are dealt out by document once, before they are split into words: counting then needs no exchange, and
    neither do windows over a document in what is read from here.  Stop words of one list go after the split, in
    whole-stage codegen; those of a document's own language go by ``tokenizer``."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = tokenizer(docs.repartition(n, "doc_id"))
    counts = content_terms(tokens, "doc_id").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")) if tokenizer is tokenize \
        else doc_term_counts(tokens)
    return materialize_bucketed(counts, "terms", n, "doc_id")


def term_stats(dtc: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """(term, term_count, doc_freq) of every term."""
    return (dtc.groupBy("term")
            .agg(F.sum("tf").cast("bigint").alias("term_count"), F.count(F.lit(1)).alias("doc_freq"))
            .where(F.col("doc_freq") >= min_df))


TRACKED = 98_304             # items that a frequent-items sketch follows: three quarters of its map


def frequent(items: DataFrame, k: int, tracked: int = TRACKED) -> tuple[list[str], int]:
    """At most ``k`` frequent values of the one column of ``items``, and a number of rows that no other value exceeds.

    A frequent-items sketch (Misra-Gries with a hash map) per task, merged in two steps, so that no task gets one from
    every other.  With a map of M places it is off by at most 3.5 / M of the rows, whatever the order of merges; a
    value is left out only if it has at most twice that, or fewer than the last one taken.  M is the power of two
    from 4/3 of ``tracked`` on."""
    name = items.columns[0]
    at_once = math.isqrt(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    each = (items.select(F.col(name).alias("v"), (F.spark_partition_id() % at_once).alias("g")).groupBy("g")
            .agg(F.expr(f"approx_top_k_accumulate(v, {tracked})").alias("s"), F.count(F.lit(1)).alias("n")))
    # grouped by a constant: without rows there is nothing to combine
    found = (each.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("n").alias("n"))
             .select(F.expr(f"approx_top_k_estimate(s, {k})").alias("top"), "n").first())
    if found is None:
        return [], 0
    off = int(3.5 * found["n"] / 2 ** math.ceil(math.log2(tracked / 0.75)))
    top = found["top"]
    return [r["item"] for r in top], max(2 * off, top[-1]["count"] if len(top) == k else 0)


def vocabulary(dtc: DataFrame, size: int = VOCAB_SIZE, min_df: int = MIN_DF) -> DataFrame:
    """M3: (term_index, term, term_count, doc_freq) of the ``size`` most frequent terms.

    All terms are counted, reduced map-side: one pass in whole-stage codegen, where a sketch of candidates first took
    a pass over every token and then another to count them."""
    top = term_stats(dtc, min_df).orderBy(F.desc("term_count"), F.asc("term")).limit(size)
    # at most ``size`` rows: one small partition for the index numbering
    rank = F.row_number().over(Window.orderBy(F.desc("term_count"), F.asc("term"))) - 1
    return top.select(rank.alias("term_index"), "term", "term_count", "doc_freq")


def term_frequencies(dtc: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, term_index, term, tf) restricted to the vocabulary (CountVectorizer in long form)."""
    return dtc.join(vocab.select("term", "term_index"), "term").select("doc_id", "term_index", "term", "tf")


def with_weight(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """M4: ``rows`` (tf and doc_freq at least) with idf = ln((N+1)/(df+1)) and tfidf.

    ``df`` counts the documents holding the term and ``N`` all documents,
    including those without any vocabulary term, as Spark ML's IDF does.
    """
    n_docs = docs.agg(F.count(F.lit(1))).scalar()          # scalar subquery, one value
    return (rows.withColumn("_idf", F.log((n_docs + 1) / (F.col("doc_freq") + 1)))
            .withColumns({"idf": F.round("_idf", 9), "tfidf": F.round(F.col("tf") * F.col("_idf"), 9)}).drop("_idf"))


def tfidf(dtc: DataFrame, vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """M4 over the vocabulary: (doc_id, term_index, term, tf, idf, tfidf)."""
    return with_weight(dtc.join(vocab, "term"), docs).select("doc_id", "term_index", "term", "tf", "idf", "tfidf")


HEAVY_TERMS = 24_576         # terms with a slot of their own
SLOTS = 1 << 20              # slots that the other terms share


def _in_slots(dtc: DataFrame, heavy: list[str], slots: int) -> DataFrame:
    """``dtc`` with each term's slot: its own for a heavy term, by hash for the others."""
    own = dtc.sparkSession.createDataFrame([(t, slots + i) for i, t in enumerate(heavy)], "term string, own bigint")
    return (dtc.join(F.broadcast(own), "term", "left")
            .withColumn("slot", F.coalesce("own", F.pmod(F.xxhash64("term"), F.lit(slots)))).drop("own"))


def frequency_bounds(placed: DataFrame) -> DataFrame:
    """(slot, low, high): the document frequency of every term in a slot is at least ``low`` and at most ``high``.

    A slot that holds one term (all its 128 bits of hashes are equal) knows its frequency; in a shared one a term is
    in one document at least and in as many as the slot has rows at most."""
    h1, h2 = F.xxhash64("term"), F.xxhash64(F.lit(1), F.col("term"))
    s = placed.groupBy("slot").agg(F.count(F.lit(1)).alias("high"), F.min(h1).alias("a"), F.max(h1).alias("b"), F.min(h2).alias("c"),
                                   F.max(h2).alias("d"))
    return s.select("slot", F.when((F.col("a") == F.col("b")) & (F.col("c") == F.col("d")), F.col("high")).otherwise(1).alias("low"), "high")


def possible_keywords(placed: DataFrame, bounds: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The rows of ``placed`` that may be among the ``n`` highest of their document, with low and high.

    A term's weight lies between those for its highest and its lowest frequency.  A document's ``n`` terms of highest
    lower weight (ties by term) are better than every term whose upper weight comes after the last of them."""
    # at most SLOTS + HEAVY_TERMS rows of three numbers
    rows = placed.join(F.broadcast(bounds), "slot")
    rows = with_weight(rows.withColumn("doc_freq", F.col("high")), docs).withColumnRenamed("tfidf", "least").drop("idf", "doc_freq")
    rows = with_weight(rows.withColumn("doc_freq", F.col("low")), docs).withColumnRenamed("tfidf", "most").drop("idf", "doc_freq")
    whole = Window.partitionBy("doc_id").orderBy(F.desc("least"), F.asc("term")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = rows.withColumn("last", F.nth_value(F.struct("least", "term"), n).over(whole))
    beaten = (F.col("last.least") > F.col("most")) | ((F.col("last.least") == F.col("most")) & (F.col("last.term") < F.col("term")))
    return last.where(F.col("last").isNull() | ~beaten).select("doc_id", "term", "tf", "slot", "low", "high")


def doc_keywords(dtc: DataFrame, docs: DataFrame, n: int = 5, heavy_terms: int = HEAVY_TERMS, slots: int = SLOTS) -> DataFrame:
    """The ``n`` highest tf-idf terms of each document (ties by term), over all terms of the corpus.

    The frequencies of all terms are never joined to the corpus.  Frequent terms (from a sketch) are counted exactly,
    the others share ``slots`` counters, which bound every frequency from both sides; the table of both is broadcast
    and has at most ``slots + heavy_terms`` rows.  A document keeps the terms that may be among its ``n`` highest.
    Of these only the ones in shared slots need their exact frequency: the terms of such slots are counted and joined.
    The window partition of a document holds its own distinct terms."""
    placed = _in_slots(dtc, frequent(dtc.select("term"), heavy_terms, 3 * heavy_terms)[0], slots)
    bounds = materialize(frequency_bounds(placed), "frequency_bounds")
    kept = materialize(possible_keywords(placed, bounds, docs, n), "possible_keywords")
    unsure = kept.where("low < high")
    asked = placed.join(F.broadcast(unsure.select("slot").distinct()), "slot", "left_semi")      # at most ``slots`` rows
    exact = asked.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    known = (kept.where("low = high").select("doc_id", "term", "tf", F.col("high").alias("doc_freq"))
             .unionByName(unsure.join(exact, "term").select("doc_id", "term", "tf", "doc_freq")))
    w = Window.partitionBy("doc_id").orderBy(F.desc("tfidf"), F.asc("term"))
    return (with_weight(known, docs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("doc_id", "rank", "term", "tfidf"))


def word_cloud_terms(tokens: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` most frequent non-empty terms of the corpus after stop words, counted without documents."""
    return (content_terms(tokens).where(F.col("term") != "").groupBy("term")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("term")).limit(n))


def weak_signals(tokens: DataFrame, period: str = "period", n: int = 20,
                 max_doc_share: float = 0.05, min_docs: int = 2) -> DataFrame:
    """Rare terms whose share of documents grew most in the last period.

    Per term and period, share = documents with the term / documents of the
    period.  Growth is the last period's share minus the mean share over all
    earlier periods (periods without the term count as 0).  A term is rare
    when it appears in at least ``min_docs`` and at most ``max_doc_share`` of
    all documents.  Returns the ``n`` terms with the highest positive growth.
    Documents without a period take no part.
    """
    tokens = tokens.where(F.col(period).isNotNull())
    # a document is one row, so its distinct terms come from array_distinct in
    # the row: no shuffle of token-level data before the (term, period) count
    distinct_words = tokens.select(period, F.array_distinct("words").alias("words"))
    dt = (content_terms(distinct_words, period).withColumnRenamed(period, "period")
          .where(F.col("term") != ""))
    per_period = tokens.groupBy(F.col(period).alias("period")).agg(F.count(F.lit(1)).alias("period_docs"))
    # last period, number of earlier periods and all documents: one scalar subquery
    b = per_period.agg(F.struct(F.max("period").alias("last"), (F.count(F.lit(1)) - 1).alias("n_earlier"),
                                F.sum("period_docs").alias("n_docs"))).scalar()
    tp = (dt.groupBy("term", "period").agg(F.count(F.lit(1)).alias("docs"))
          .join(per_period, "period")
          .withColumn("share", F.col("docs") / F.col("period_docs")))
    last = F.col("period") == b["last"]
    # earlier shares are added in period order (a term has at most one entry per
    # period, so the list is bounded by the number of periods): the sum then does
    # not depend on the order in which partial aggregates meet
    g = (tp.withColumn("earlier_share", F.when(~last, F.col("share")))
         .groupBy("term").agg(
             F.sum("docs").alias("term_docs"),
             F.coalesce(F.sum(F.when(last, F.col("share"))), F.lit(0.0)).alias("last_share"),
             F.sort_array(F.collect_list(F.struct("period", "earlier_share"))).alias("_earlier"))
         .withColumn("earlier_sum", F.aggregate(
             "_earlier", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["earlier_share"], F.lit(0.0)))))
    earlier_mean = F.when(b["n_earlier"] > 0, F.col("earlier_sum") / b["n_earlier"]).otherwise(0.0)
    return (g.where((F.col("term_docs") >= min_docs) & (F.col("term_docs") <= b["n_docs"] * max_doc_share))
            .select("term", "term_docs",
                    F.round("last_share", 9).alias("last_share"),
                    F.round(earlier_mean, 9).alias("earlier_mean_share"),
                    F.round(F.col("last_share") - earlier_mean, 9).alias("growth"))
            .where(F.col("growth") > 0)
            .orderBy(F.desc("growth"), F.asc("term")).limit(n))
