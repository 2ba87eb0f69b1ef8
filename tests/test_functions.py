from pyspark.sql import functions as F

from citeweave.functions.text import (graph_author_parts, is_valid_text, raw_author_parts, trailing_country,
                                      trimmed_author_parts)
from citeweave.functions.topics import topic_label
from citeweave.functions.years import clean_year, is_exact_year, year_in_text


def one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_exact_year(spark):
    got = one_col(spark, ["2025", "Unknown Date", "Unknown", "12034 in 2021", None, "1999", "202"], is_exact_year)
    assert got == [True, False, False, False, None, True, False]


def test_year_in_text_defaults_and_boundaries(spark):
    vals = ["Published 2019 in X", "no year", None, "a12019b 2003.", "é2019 then 2020", "1850 1999"]
    got = one_col(spark, vals, lambda c: year_in_text(c, "Unknown Date"))
    # Unicode letters are word characters, like Python's \b
    assert got == ["2019", "Unknown Date", "Unknown Date", "2003", "2020", "1999"]


def test_clean_year(spark):
    vals = ["2025", "Unknown Date", "12034 in 2021", None, "1999", "x2001y"]
    assert one_col(spark, vals, clean_year) == [2025, 2024, 2034, 2024, 2024, 2001]


def test_valid_text(spark):
    vals = ["N/A", None, "x" * 20, "x" * 21, "a  b  c  d  e  f  g  h  i"]
    assert one_col(spark, vals, is_valid_text) == [False, False, False, True, True]


def test_author_splits(spark):
    vals = ["Lijun Wei, Wei Cai, + 1", "Unknown", "", None, "A\nB, A\nB"]
    raw = one_col(spark, vals, raw_author_parts)
    assert raw[0] == ["Lijun Wei", " Wei Cai", " + 1"]           # F6: no trimming
    assert raw[2] == [""] and raw[3] is None
    trimmed = one_col(spark, vals, trimmed_author_parts)
    assert trimmed[0] == ["Lijun Wei", "Wei Cai", "+ 1"]
    assert trimmed[2] is None                                    # '' is missing after a CSV round trip
    graph = one_col(spark, ["Li, Wei Cai, + 1, ab, A, Bob"], graph_author_parts)
    # length tested before trimming: " + 1" (4 chars) passes, "Li" and " A" do not, " ab" does
    assert graph[0] == ["Wei Cai", "+ 1", "ab", "Bob"]


def test_trailing_country(spark):
    vals = ["Lab, USA", "Lab, United States", None, "X, Y, France"]
    assert one_col(spark, vals, trailing_country) == ["USA", "", None, "France"]


def test_topic_rules_order_and_substring(spark):
    vals = ["Blockchain for voting", "Security of IoT", "IoT at the edge", "Health records", "Supply networks",
            "DeFi lending", "Smart contracts", None, "Privacy in healthcare", "Federated Learning"]
    got = one_col(spark, vals, topic_label)
    # "ai" matches inside "blockchain", so every blockchain title is AI & Blockchain
    assert got == ["AI & Blockchain", "Security & Privacy", "IoT & Edge", "Healthcare", "Supply Chain",
                   "DeFi & Finance", "General Blockchain", "General Blockchain", "Security & Privacy",
                   "AI & Blockchain"]
    words = one_col(spark, vals, lambda c: topic_label(c, whole_word=True))
    assert words[0] == "General Blockchain" and words[9] == "AI & Blockchain"
    assert one_col(spark, ["AI for chains", "maïs ai"], lambda c: topic_label(c, whole_word=True)) == \
        ["AI & Blockchain", "AI & Blockchain"]
