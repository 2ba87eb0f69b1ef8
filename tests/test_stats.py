from citeweave.operators import stats
from conftest import collection


def test_trends_keeps_exact_years(spark):
    df = collection(spark, [
        (1, "a", "x", "2025", "s", "j", "N/A", None), (2, "b", "x", "2025", "s", "j", "N/A", None),
        (3, "c", "x", "Unknown Date", "s", "j", "N/A", None), (4, "d", "x", "12034 in 2021", "s", "j", "N/A", None),
        (5, "e", "x", None, "s", "j", "N/A", None), (6, "f", "x", "1999", "s", "j", "N/A", None)])
    assert [tuple(r) for r in stats.trends(df).collect()] == [("1999", 1), ("2025", 2)]


def test_top_authors_raw_counts_untrimmed_keys(spark):
    df = collection(spark, [
        (1, "a", "Lijun Wei, Wei Cai, + 1", "2025", "s", "j", "N/A", None),
        (2, "b", "Wei Cai, Lijun Wei", "2025", "s", "j", "N/A", None),
        (3, "c", "Unknown", "2025", "s", "j", "N/A", None),
        (4, "d", None, "2025", "s", "j", "N/A", None)])
    got = {r["author"]: r["count"] for r in stats.top_authors_raw(df).collect()}
    # " Wei Cai" and "Wei Cai" are different keys; " + 1" counts as an author
    assert got == {"Lijun Wei": 1, " Wei Cai": 1, " + 1": 1, "Wei Cai": 1, " Lijun Wei": 1, "Unknown": 1}
    assert stats.top_authors_raw(df, n=2).count() == 2


def test_geography_and_missing_column(spark):
    df = collection(spark, [
        (1, "a", "x", "2025", "s", "j", "N/A", "Lab, USA"), (2, "b", "x", "2025", "s", "j", "N/A", "Lab, USA"),
        (3, "c", "x", "2025", "s", "j", "N/A", "Lab, United States"), (4, "d", "x", "2025", "s", "j", "N/A", None)])
    got = {r["country"]: r["count"] for r in stats.geography(df).collect()}
    assert got == {"USA": 2, "": 1, None: 1}
    assert stats.geography(df.drop("affiliations")).count() == 0      # F2: column absent -> skipped


def test_quality_counts_one_pass(spark):
    df = collection(spark, [
        (1, "a", "x", "2025", "s", "j", "N/A", None), (2, "a", "x", "2025", "s", "j", "x" * 21, None),
        (3, "b", "x", "2025", "s", "j", "short", None), (4, None, "x", "2025", "s", "j", None, None)])
    r = stats.quality_counts(df).first()
    assert (r["total_articles"], r["valid_abstracts"], r["distinct_titles"], r["duplicate_rows"]) == (4, 1, 3, 1)
    assert [tuple(x) for x in stats.source_counts(df).collect()] == [("s", 4)]
