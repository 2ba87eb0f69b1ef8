import math

from pyspark.ml.feature import IDF, CountVectorizerModel, StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from citeweave.constants import ENGLISH_STOP_WORDS
from citeweave.operators import textmine
from citeweave.operators.lda import lda_topics, topic_facts

DOCS = [
    (1, "The chain of blocks  and the chain of trust "),
    (2, "Blocks, blocks and more blocks.\tTrust me"),
    (3, "   Leading blanks count; trailing do not   "),
    (4, "I'll say it: THE END"),
]


def tokenize_ml(docs, stop_words=ENGLISH_STOP_WORDS):
    """The same tokens through the ML transformers."""
    tok = Tokenizer(inputCol="text_content", outputCol="words").transform(docs)
    return StopWordsRemover(inputCol="words", outputCol="content", stopWords=stop_words,
                            caseSensitive=False, locale="en_US").transform(tok)


def docs(spark, data=DOCS):
    return spark.createDataFrame(data, "doc_id long, text_content string")


def test_native_tokens_equal_ml_transformers(spark):
    d = docs(spark, DOCS + [(5, ""), (6, "     "), (7, "a\u000bb  c")])
    a = {r["doc_id"]: (r["words"], r["content"]) for r in textmine.tokenize(d).collect()}
    b = {r["doc_id"]: (r["words"], r["content"]) for r in tokenize_ml(d).collect()}
    assert a == b
    assert a[1][0][4] == ""          # double blank gives an empty token
    assert a[6][0] == []             # all blank: no tokens


def test_vocabulary_ties_are_stable(spark):
    dtc = textmine.doc_term_counts(textmine.tokenize(docs(spark)))
    v = [tuple(r) for r in textmine.vocabulary(dtc, size=3).collect()]
    assert [x[0] for x in v] == [0, 1, 2]
    full = sorted(((r["term_count"], r["term"]) for r in textmine.vocabulary(dtc, size=100).collect()),
                  key=lambda t: (-t[0], t[1]))
    assert [x[1] for x in v] == [t for _, t in full[:3]]


def test_tfidf_matches_spark_ml(spark):
    toks = textmine.tokenize(docs(spark))
    dtc = textmine.doc_term_counts(toks)
    vocab = textmine.vocabulary(dtc)
    ours = {(r["doc_id"], r["term"]): r["tfidf"]
            for r in textmine.tfidf(dtc, vocab, toks).collect()}
    terms = [r["term"] for r in vocab.orderBy("term_index").collect()]
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol="content", outputCol="tf")
    tf = cv.transform(toks)
    ml = IDF(inputCol="tf", outputCol="w").fit(tf).transform(tf)
    for r in ml.collect():
        for idx, val in zip(r["w"].indices, r["w"].values):
            assert math.isclose(ours[(r["doc_id"], terms[idx])], val, abs_tol=1e-8)
    assert len(ours) == sum(len(r["w"].indices) for r in ml.collect())


def test_keywords_cloud_and_weak_signals(spark):
    toks = textmine.tokenize(docs(spark))
    dtc = textmine.doc_term_counts(toks)
    kw = textmine.doc_keywords(dtc, toks, 2)
    assert kw.groupBy("doc_id").count().where(F.col("count") > 2).count() == 0
    cloud = textmine.word_cloud_terms(toks, 3).collect()
    assert cloud[0]["term"] == "blocks" and all(r["term"] != "" for r in cloud)
    data = [(i, 2020 + (i % 3), f"common word{i % 5} " + ("rising " if i % 3 == 2 and i > 20 else ""))
            for i in range(60)]
    d = spark.createDataFrame(data, "doc_id long, period int, text_content string")
    ws = textmine.weak_signals(textmine.tokenize(d), "period", n=5, max_doc_share=0.5).collect()
    assert ws[0]["term"] == "rising" and ws[0]["growth"] > 0


def test_lda_topics_shape_and_empty_guard(spark):
    data = [(i, ("ledger token consensus mining " if i % 2 else "patient record hospital care ") * 3)
            for i in range(40)]
    toks = textmine.tokenize(docs(spark, data))
    vocab = textmine.vocabulary(textmine.doc_term_counts(toks))
    t = lda_topics(toks, vocab, k=2, max_iter=3)
    got = t.collect()
    assert [r["Topic"] for r in got] == [0, 1] and all(len(r["Keywords"].split(", ")) == 5 for r in got)
    empty = textmine.tokenize(docs(spark, [(1, "x")]).where(F.lit(False)))
    assert lda_topics(empty, vocab).count() == 0


def test_long_form_counts_equal_count_vectorizer(spark):
    from pyspark.ml.feature import CountVectorizer
    data = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 30)) + " the and of") for i in range(50)]
    toks = tokenize_ml(docs(spark, data))
    cvm = CountVectorizer(inputCol="content", outputCol="tf", vocabSize=10_000, minDF=1.0).fit(toks)
    ml = {(r["doc_id"], cvm.vocabulary[i]): int(v)
          for r in cvm.transform(toks).collect() for i, v in zip(r["tf"].indices, r["tf"].values)}
    dtc = textmine.doc_term_counts(textmine.tokenize(docs(spark, data)))
    ours = {(r["doc_id"], r["term"]): r["tf"] for r in dtc.collect()}
    assert ours == ml
    vocab = textmine.vocabulary(dtc, size=10_000)
    assert {r["term"] for r in vocab.collect()} == set(cvm.vocabulary)


def test_lda_is_repeatable_with_its_seed(spark):
    data = [(i, ("ledger token consensus mining block " if i % 3 else "patient record hospital care ward ") * 4
             + f"doc{i % 5}") for i in range(60)]
    toks = textmine.tokenize(docs(spark, data))
    a = [tuple(r) for r in lda_topics(toks, k=3, max_iter=4).collect()]
    b = [tuple(r) for r in lda_topics(toks, k=3, max_iter=4).collect()]
    assert a == b and len(a) == 3


def test_lda_does_not_depend_on_the_partitions(spark):
    data = [(i, ("ledger token consensus mining block " if i % 3 else "patient record hospital care ward ") * 4
             + f"doc{i % 5}") for i in range(60)]
    toks = textmine.tokenize(docs(spark, data))
    a = [tuple(r) for r in lda_topics(toks, k=3, max_iter=4).collect()]
    assert [tuple(r) for r in lda_topics(toks.repartition(7), k=3, max_iter=4).collect()] == a
    assert [tuple(r) for r in lda_topics(toks.coalesce(1).orderBy(F.desc("doc_id")), k=3, max_iter=4).collect()] == a


def test_lda_takes_a_vocabulary_as_given(spark):
    data = [(i, " ".join(f"t{(i + j) % 1200:04d}" for j in range(30))) for i in range(1200)]
    toks = textmine.tokenize(docs(spark, data))
    vocab = textmine.vocabulary(textmine.doc_term_counts(toks), size=1200)
    assert vocab.count() == 1200
    facts = topic_facts(lda_topics(toks, vocab, k=2, max_iter=1), vocab).collect()
    assert sorted(tuple(r) for r in facts) == [(0, 5, 5, 5), (1, 5, 5, 5)]


def test_stop_words_follow_the_language(spark):
    d = spark.createDataFrame([(1, "en", "the die and"), (2, "de", "the die und"), (3, "fr", "les the"), (4, "es", "los the"),
                               (5, None, "the die"), (6, "xx", "the die")], "doc_id long, lang string, text_content string")
    got = {r["doc_id"]: r["content"] for r in textmine.tokenize_by_language(d).collect()}
    assert got == {1: ["die"], 2: ["the"], 3: ["the"], 4: ["the"], 5: ["die"], 6: ["die"]}


def test_one_vocabulary_and_no_document_shuffle(spark):
    import __spark_entry__ as E
    queries = E.queries()
    tfidf = queries["tfidf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert tfidf.count("TakeOrderedAndProject") == 1
    assert "hashpartitioning(doc_id" not in queries["vocabulary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def zipf_docs(spark, n=300, seed=4):
    """Documents of skewed words: a few in most documents, many in one only."""
    import random
    rnd = random.Random(seed)
    data = [(i, " ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(rnd.randrange(3, 60))) + f" only{i}") for i in range(n)]
    return docs(spark, [*data, (n, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (n + 1, "the of and")])


def plain_keywords(spark, toks, n):
    """All frequencies joined to all terms, as the definition says."""
    dtc = textmine.doc_term_counts(toks)
    w = textmine.with_weight(dtc.join(textmine.term_stats(dtc), "term"), toks).collect()
    out = []
    for doc in {r["doc_id"] for r in w}:
        own = sorted((-r["tfidf"], r["term"]) for r in w if r["doc_id"] == doc)[:n]
        out += [(doc, i + 1, t, -v) for i, (v, t) in enumerate(own)]
    return sorted(out)


def test_keywords_equal_the_full_join(spark):
    toks = textmine.tokenize(zipf_docs(spark))
    want = plain_keywords(spark, toks, 5)
    dtc = textmine.doc_term_counts(toks)
    # roomy slots, slots that nearly all terms share, a single slot, no heavy terms to speak of
    for heavy, slots in ((textmine.HEAVY_TERMS, textmine.SLOTS), (20, 16), (1, 1), (5, 1 << 12)):
        got = sorted(tuple(r) for r in textmine.doc_keywords(dtc, toks, 5, heavy, slots).collect())
        assert got == want, (heavy, slots)


def test_frequency_bounds_hold(spark):
    dtc = textmine.doc_term_counts(textmine.tokenize(zipf_docs(spark)))
    placed = textmine._in_slots(dtc, ["w1", "w2"], 64)
    b = placed.select("term", "slot").distinct().join(textmine.frequency_bounds(placed), "slot").join(textmine.term_stats(dtc), "term").collect()
    assert all(r["low"] <= r["doc_freq"] <= r["high"] for r in b)
    assert {r["low"] == r["high"] for r in b if r["term"] in ("w1", "w2")} == {True} and any(r["low"] < r["high"] for r in b)


def test_pruning_keeps_few_rows(spark):
    toks = textmine.tokenize(zipf_docs(spark))
    dtc = textmine.doc_term_counts(toks)
    placed = textmine._in_slots(dtc, textmine.frequent(dtc.select("term"), 100)[0], 1 << 16)
    kept = textmine.possible_keywords(placed, textmine.frequency_bounds(placed), toks, 2)
    assert kept.count() * 4 < dtc.count()


def test_vocabulary_by_candidates_equals_full_counts(spark):
    dtc = textmine.doc_term_counts(textmine.tokenize(zipf_docs(spark, 600)))
    for size in (3, 20, 10_000):               # the sketch separates the first, not the last
        want = sorted((-r["term_count"], r["term"], r["doc_freq"]) for r in textmine.term_stats(dtc).collect())[:size]
        got = [(-r["term_count"], r["term"], r["doc_freq"]) for r in textmine.vocabulary(dtc, size).orderBy("term_index").collect()]
        assert got == want
    assert textmine.vocabulary(dtc.limit(0)).count() == 0
    rare = textmine.vocabulary(dtc, 10, min_df=100).collect()
    assert rare and all(r["doc_freq"] >= 100 for r in rare)


def test_sketch_bound_holds_when_it_overflows(spark):
    # 200,000 values beside 40 frequent ones, with a map far too small for them
    items = spark.range(0, 400_000, numPartitions=6).selectExpr("cast(if(id % 2 = 0, id % 80, id) as string) as v")
    names, bound = textmine.frequent(items, 50, tracked=1000)
    counts = {r["v"]: r["count"] for r in items.groupBy("v").count().collect()}
    assert bound >= max(c for v, c in counts.items() if v not in set(names))
    assert {str(i) for i in range(0, 80, 2)} <= set(names)
    assert textmine.frequent(items.limit(0), 5) == ([], 0)


def test_landed_terms_need_no_exchange(spark):
    d = zipf_docs(spark)
    landed = textmine.land_terms(d)
    assert sorted(map(tuple, landed.collect())) == sorted(map(tuple, textmine.doc_term_counts(textmine.tokenize(d)).collect()))
    by_doc = landed.groupBy("doc_id").agg(F.sum("tf"))
    assert "Exchange" not in by_doc._jdf.queryExecution().executedPlan().toString()


def test_vocabulary_takes_no_sketch(spark, monkeypatch):
    dtc = textmine.doc_term_counts(textmine.tokenize(zipf_docs(spark)))
    monkeypatch.setattr(textmine, "frequent", None)          # a pass over every token
    assert textmine.vocabulary(dtc, 5).count() == 5


def test_language_vocabulary_is_landed_once(spark):
    from citeweave.plans import catalog
    sf = "/root/testdata/sf0.001"
    once = catalog._language_vocabulary(spark, sf)
    assert catalog._language_vocabulary(spark, sf) is once
    own = textmine.vocabulary(textmine.doc_term_counts(catalog._language_tokens(spark, sf)))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, own.collect()))
