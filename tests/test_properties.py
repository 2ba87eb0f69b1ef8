"""Property tests: Spark expressions against plain-Python statements of the semantics.

Each example is a batch of random values evaluated in one Spark job.
"""

import itertools
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeweave.constants import TOPIC_DEFAULT, TOPIC_RULES
from citeweave.functions.text import graph_author_parts, raw_author_parts, trimmed_author_parts
from citeweave.functions.topics import topic_label
from citeweave.functions.years import clean_year
from citeweave.operators import graph

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
ASCII = st.characters(min_codepoint=32, max_codepoint=126)
TEXTY = st.sampled_from(list("abcdefghijklmnopqrstuvwxyz ,.-+0123456789AIéèüß") + ["ai", "learning", "iot",
                                                                                  "health", "defi", "20"])


def evaluate(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def py_clean_year(v):
    m = re.search(r"20[0-9]{2}", str(v))
    return int(m.group(0)) if m else 2024


def py_topic(v):
    t = str(v).lower()
    for label, words in TOPIC_RULES:
        if any(w in t for w in words):
            return label
    return TOPIC_DEFAULT


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.text(ASCII, max_size=12)), min_size=1, max_size=40))
def test_clean_year(spark, values):
    assert evaluate(spark, values, clean_year) == [py_clean_year(v) for v in values]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.lists(TEXTY, max_size=8).map("".join)), min_size=1, max_size=40))
def test_topic_label(spark, values):
    # NULL title: str(None) has no keyword either, so both give the default
    assert evaluate(spark, values, topic_label) == [py_topic(v) for v in values]


NAMES = st.lists(st.sampled_from(["Ann", " Bob", "Li", " + 1", "", "  Cy ", "Dee\n", "Ann"]), max_size=6)


@SETTINGS
@given(st.lists(st.one_of(st.none(), NAMES.map(",".join)), min_size=1, max_size=30))
def test_author_splits(spark, values):
    assert evaluate(spark, values, raw_author_parts) == [None if v is None else v.split(",") for v in values]
    missing = {None, "", "NA", "N/A"}
    assert evaluate(spark, values, trimmed_author_parts) == [
        None if v in missing else [a.strip() for a in v.split(",")] for v in values]
    assert evaluate(spark, values, graph_author_parts) == [
        None if v in missing else [a.strip() for a in v.split(",") if len(a) > 2] for v in values]


@SETTINGS
@given(st.lists(st.lists(st.sampled_from([f"N{i}" for i in range(12)]), max_size=9), min_size=1, max_size=25),
       st.sampled_from([1, 2, 3, 256]))
def test_edges_any_chunk(spark, papers, chunk):
    rows = [(i, ", ".join(p)) for i, p in enumerate(papers)]
    df = spark.createDataFrame(rows, "ingest_id long, authors string")
    got = {(r["src"], r["dst"]): r["papers"] for r in graph.coauthor_edges(df, chunk=chunk).collect()}
    want = {}
    for _, a in rows:
        names = [x.strip() for x in a.split(",") if len(x) > 2] if a else []
        for e in {tuple(sorted(p)) for p in itertools.combinations(names, 2)}:
            want[e] = want.get(e, 0) + 1
    assert got == want
