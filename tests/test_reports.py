import json
import os

from citeweave.operators import olap
from citeweave.plans import reports
from citeweave.schema import FACT_SCHEMA
from citeweave.sources.readers import read_csv_typed


def test_analysis_and_warehouse_runs(spark, scratch):
    arts = [{"title": f"Blockchain {i % 4}", "authors": "Ann, Bob" if i % 2 else "Unknown",
             "date_pub": str(2020 + i % 3) if i % 5 else "Unknown Date", "source": "IEEE Xplore",
             "journal": "IEEE", "abstract_": "N/A" if i % 3 else f"ledger consensus token number {i} of many"}
            for i in range(30)]
    p = os.path.join(scratch, "final_data.json")
    with open(p, "w") as f:
        json.dump(arts, f)
    coll = reports.collection_from_json(spark, p)
    assert sorted(r["ingest_id"] for r in coll.collect()) == sorted(set(r["ingest_id"] for r in coll.collect()))
    out = os.path.join(scratch, "results")
    written = reports.write_results(reports.analysis_results(coll), out)
    assert [os.path.basename(x) for x in written] == ["trends.csv", "authors.csv", "topics.csv"]
    written = reports.write_results(reports.warehouse_results(coll, out), out)
    fact = read_csv_typed(spark, os.path.join(out, "F_Publications.csv"), FACT_SCHEMA)
    assert fact.count() == 4                       # one row per title
    assert {r["title"] for r in fact.collect()} == {f"Blockchain {i}" for i in range(4)}


def test_dashboard_run_from_the_warehouse(spark, scratch):
    arts = [{"title": f"Blockchain {i}", "authors": "Ann, Bob, Cy" if i % 2 else "Dee, Eve",
             "date_pub": "2021" if i % 3 else "2024", "source": "IEEE Xplore", "journal": "IEEE"}
            for i in range(40)]
    p = os.path.join(scratch, "final_data.json")
    with open(p, "w") as f:
        json.dump(arts, f)
    wh = os.path.join(scratch, "warehouse")
    reports.write_results(reports.warehouse_results(reports.collection_from_json(spark, p), wh), wh)
    views = os.path.join(scratch, "views")
    fact, topics = reports.read_warehouse(spark, wh)
    reports.write_results(reports.dashboard_results(fact, topics, olap.Slice(years=(2020, 2025)),
                                                    "AI & Blockchain"), views)
    kpis = spark.read.option("header", True).csv(os.path.join(views, "kpis.csv")).first()
    assert int(kpis["publications"]) == 40
    edges = spark.read.option("header", True).csv(os.path.join(views, "coauthor_edges.csv"))
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("Ann", "Bob"), ("Ann", "Cy"), ("Bob", "Cy"),
                                                              ("Dee", "Eve")}
    assert spark.read.option("header", True).csv(os.path.join(views, "topic_articles.csv")).count() == 40


def test_dashboard_first_papers_follow_collection_order(spark, scratch):
    from citeweave.operators import graph
    arts = [{"title": f"T{i:03d}", "authors": f"A{i % 7}, A{(i * 3) % 11}, A{(i * 5) % 13}",
             "date_pub": "2021", "source": "S", "journal": "J"} for i in range(300)]
    p = os.path.join(scratch, "final_data.json")
    with open(p, "w") as f:
        json.dump(arts, f)
    coll = reports.collection_from_json(spark, p)
    wh = os.path.join(scratch, "warehouse")
    reports.warehouse_results(coll.repartition(7), wh)
    fact, _ = reports.read_warehouse(spark, wh)
    landed = {tuple(r) for r in graph.coauthor_sample(fact).collect()}
    direct = {tuple(r) for r in graph.coauthor_sample(reports.warehouse.fact_publications(coll)).collect()}
    assert landed == direct


def test_ingest_ids_follow_file_then_position(spark, scratch):
    folder = os.path.join(scratch, "exports")
    os.makedirs(folder)
    sizes = {"a.json": 3, "b.json": 40, "c.json": 5}           # b is read first (largest)
    for name, n in sizes.items():
        with open(os.path.join(folder, name), "w") as f:
            json.dump([{"title": f"{name}-{i}", "source": "S"} for i in range(n)], f)
    coll = reports.collection_from_json(spark, folder)
    order = [r["title"] for r in coll.orderBy("ingest_id").collect()]
    assert order == [f"{n}-{i}" for n in sorted(sizes) for i in range(sizes[n])]
