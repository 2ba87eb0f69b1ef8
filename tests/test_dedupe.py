from pyspark.sql import functions as F

from citeweave.operators import dedupe
from conftest import collection, rows

DATA = [
    (1, "", "", "Unknown Date", "ACM Digital Library", "ACM", "N/A", None),
    (2, "", "", "Unknown Date", "ACM Digital Library", "ACM", "N/A", None),
    (3, "Blockchain A", "X, Y", "2025", "ACM Digital Library", "ACM", "N/A", None),
    (4, "Blockchain A", "X, Y", "2025", "IEEE Xplore", "IEEE", "N/A", None),
    (5, None, "Z", "2024", "IEEE Xplore", "IEEE", "N/A", None),
    (6, None, "W", "2023", "IEEE Xplore", "IEEE", "N/A", None),
    (7, "Solo", "Q", "2022", "ScienceDirect", "ScienceDirect Journal", "N/A", None),
    (0, "Blockchain A", "first", "2020", "ScienceDirect", "ScienceDirect Journal", "N/A", None),
]


def test_landed_rows_are_deduplicated_where_they_are(spark):
    odd = [*DATA, DATA[2], (7, "Blockchain A", "id of another title", "2020", "s", "j", "N/A", None)]
    df = collection(spark, odd).union(collection(spark, odd[:1]).withColumn("ingest_id", F.lit(None).cast("bigint")))
    want = rows(dedupe.dedupe_titles(df))
    assert len(want) == 5
    for most, moved in ((dedupe.SURPLUS_IDS, False), (0, True)):
        got = dedupe.dedupe_landed(df, most=most)
        assert rows(got) == want and got.columns == df.columns
        assert ("LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()) == moved
    assert dedupe.dedupe_landed(df.limit(0)).count() == 0


def test_keep_first_per_title_with_blank_and_null(spark):
    df = collection(spark, DATA)
    got = {r["title"]: r["ingest_id"] for r in dedupe.dedupe_titles(df).collect()}
    # F8: blank titles collapse to one row; NULL titles form one group too
    assert got == {"": 1, "Blockchain A": 0, None: 5, "Solo": 7}
    assert dedupe.dedupe_titles(df).columns == df.columns


def test_dedupe_is_partitioning_invariant(spark):
    df = collection(spark, DATA * 1)
    assert rows(dedupe.dedupe_titles(df)) == rows(dedupe.dedupe_titles(df.repartition(7)))


def test_duplicate_report_and_surplus(spark):
    df = collection(spark, DATA)
    rep = {r["title"]: (r["copies"], r["kept_id"], r["surplus"]) for r in dedupe.duplicate_titles(df).collect()}
    assert rep == {"": (2, 1, 1), "Blockchain A": (3, 0, 2), None: (2, 5, 1)}
    assert sorted(r["ingest_id"] for r in dedupe.surplus_rows(df).collect()) == [2, 3, 4, 6]
    r = dedupe.dedupe_report(df).first()
    assert (r["initial_count"], r["final_count"], r["deleted_count"], r["duplicate_titles"]) == (8, 4, 4, 3)


def test_report_on_empty(spark):
    r = dedupe.dedupe_report(collection(spark, [])).first()
    assert (r["initial_count"], r["final_count"], r["deleted_count"], r["duplicate_titles"]) == (0, 0, 0, 0)


def test_insert_if_absent_is_null_safe(spark):
    table = collection(spark, [DATA[0], DATA[4]])               # holds "" and NULL
    batch = collection(spark, DATA[1:4] + DATA[5:])
    got = sorted(r["ingest_id"] for r in dedupe.insert_if_absent(batch, table).collect())
    # "" and NULL are present already; "Blockchain A" enters once (id 0, the first), "Solo" enters
    assert got == [0, 7]


def test_title_uniqueness(spark):
    df = collection(spark, DATA)
    assert tuple(dedupe.title_uniqueness(df).first()) == (8, 4, 3, False)
    assert tuple(dedupe.title_uniqueness(dedupe.dedupe_titles(df)).first()) == (4, 4, 0, True)
    assert tuple(dedupe.title_uniqueness(collection(spark, [])).first()) == (0, 0, 0, True)


def test_no_forced_join_strategy(spark):
    for out in (dedupe.dedupe_titles(collection(spark, DATA)), dedupe.surplus_rows(collection(spark, DATA))):
        assert "hint" not in out._jdf.queryExecution().logical().toString().lower()


def test_union_sources_rebases_ids_and_fills_missing(spark):
    a = collection(spark, DATA[:2])
    b = spark.createDataFrame([(1, "T", "A", "2020", "web", "web", "N/A")],
                              "ingest_id long, title string, authors string, date_pub string, source string, "
                              "journal string, abstract_ string")
    u = dedupe.union_sources([a, b])
    got = sorted((r["ingest_id"], r["affiliations"]) for r in u.collect())
    assert got == [(1, None), (2, None), ((1 << 48) + 1, None)]
    assert dedupe.dedupe_titles(u.where(F.col("title") == "")).first()["ingest_id"] == 1


def test_insert_moves_rows_once(spark):
    data = [(1, "A", "a", "2021", "s", "j", "N/A", None), (2, "A", "b", "2021", "s", "j", "N/A", None), (3, None, "c", "2021", "s", "j", "N/A", None),
            (4, None, "d", "2021", "s", "j", "N/A", None), (5, "B", "e", "2021", "s", "j", "N/A", None)]
    out = dedupe.insert_if_absent(collection(spark, data), collection(spark, [(9, "B", "z", "2021", "s", "j", "N/A", None)]))
    assert sorted(r["ingest_id"] for r in out.collect()) == [1, 3]
    # only the join with the ids that stay meets whole rows
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in next(line for line in plan.splitlines() if "Join " in line)
