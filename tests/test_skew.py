"""Hot keys: a third of all rows on one title, one author, one paper's list."""

import itertools

from pyspark.sql import functions as F

from citeweave.operators import dedupe, graph, olap, stats
from conftest import collection, rows

N = 3000


def skewed(spark):
    data = []
    for i in range(N):
        hot = i % 3 == 0
        title = "" if hot else f"T{i % 400}"
        authors = "Unknown" if hot else f"A{i % 50}, A{(i + 7) % 50}"
        data.append((i, title, authors, str(1995 + i % 7), f"src{i % 3}", "J", "N/A", "Lab, BUILDING"))
    return collection(spark, data).repartition(6)


def test_hot_title_dedupe_and_report(spark):
    df = skewed(spark)
    kept = {r["title"]: r["ingest_id"] for r in dedupe.dedupe_titles(df).collect()}
    assert kept[""] == 0 and len(kept) == 1 + 400
    rep = dedupe.dedupe_report(df).first()
    assert rep["initial_count"] == N and rep["final_count"] == 401
    assert rows(dedupe.surplus_rows(df).select("ingest_id")) == rows(
        df.join(dedupe.dedupe_titles(df).select("ingest_id"), "ingest_id", "left_anti").select("ingest_id"))


def test_hot_author_counts(spark):
    top = stats.top_authors_raw(skewed(spark), 1).first()
    assert (top["author"], top["count"]) == ("Unknown", N // 3)


def test_hot_plan_aggregates_partially(spark):
    plan = skewed(spark).groupBy("title").agg(F.min("ingest_id"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_one_paper_with_a_huge_author_list(spark):
    names = [f"P{i:04d}" for i in range(600)] + ["P0001", "P0002"]       # 600 distinct + two repeats
    df = spark.createDataFrame([(1, ", ".join(names)), (2, "P0001, P0002")], "ingest_id long, authors string")
    got = {(r["src"], r["dst"]): r["papers"] for r in graph.coauthor_edges(df).collect()}
    distinct = sorted(set(names))
    expect = {(a, b): 1 for a, b in itertools.combinations(distinct, 2)}
    expect[("P0001", "P0001")] = 1
    expect[("P0002", "P0002")] = 1
    expect[("P0001", "P0002")] = 2
    assert got == expect


def test_box_stats_hot_group(spark):
    f = skewed(spark).select("ingest_id", F.lit("Q1").alias("Quartile"),
                             ((F.col("ingest_id") % 951 + 50) / 100).alias("Impact_Score"))
    b = olap.impact_box_stats(f).first()
    assert b["n"] == N and b["outliers"] == 0
