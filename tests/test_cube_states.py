"""The cube's views against the same views of the fact."""

import random

import numpy as np
import pytest

from citeweave.operators import cube_states, olap

SCHEMA = ("ingest_id long, title string, authors string, Annee int, Pays string, Journal string, Quartile string, "
          "Citations long, Impact_Score double, abstract_ string")


@pytest.fixture(scope="module")
def fact(spark):
    rnd = random.Random(2)
    rows = [(i, f"t{i}", rnd.choice([None, "", "A, B", f"N{rnd.randrange(300)}, N{rnd.randrange(300)}"]), rnd.choice([None, 2020, 2021, 2022]),
             rnd.choice([None, "X", "Y", "Z"]), "J", rnd.choice([None, "Q1", "Q2", "Q3"]), rnd.choice([None, 3, 7]),
             rnd.choice([None, round(rnd.lognormvariate(0, 1), 2)]), "N/A") for i in range(6000)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("s", [olap.Slice((2000, 2030)), olap.Slice((2021, 2022), ("Q1", "Q3"), ("X",)), olap.Slice((1900, 1901))])
def test_kpis_of_any_slice(spark, fact, s):
    want = olap.kpis(olap.olap_slice(fact, s)).first()
    got = cube_states.kpis(olap.olap_slice(cube_states.cells(fact), s)).first()
    assert tuple(got)[:4] == tuple(want)
    names = {n.strip() for r in olap.olap_slice(fact, s).collect() if r["authors"] for n in r["authors"].split(",")}
    assert got["active_authors"] == len(names)


def test_groupings_equal_the_exact_cube(spark, fact):
    def key(r):
        return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    cols = ["Annee", "Quartile", "Pays", "gid", "publications", "total_citations", "mean_impact"]
    got = sorted((tuple(r) for r in cube_states.groupings(cube_states.cells(fact)).select(*cols).collect()), key=repr)
    assert got == sorted((tuple(r) for r in olap.olap_cube(fact).select(*cols).collect()), key=repr)


def test_box_statistics_within_the_stated_error(spark, fact):
    b = {r["Quartile"]: r for r in cube_states.box_stats(cube_states.cells(fact)).collect()}
    rows = [r for r in fact.collect() if r["Quartile"] and r["Impact_Score"] is not None]
    assert set(b) == {"Q1", "Q2", "Q3"}
    for q, r in b.items():
        v = np.array([x["Impact_Score"] for x in rows if x["Quartile"] == q])
        assert (r["n"], r["min"], r["max"]) == (len(v), v.min(), v.max())
        for c, p in (("q1", .25), ("median", .5), ("q3", .75)):
            assert (v < r[c]).mean() - 3 * cube_states.RANK_ERROR <= p <= (v <= r[c]).mean() + 3 * cube_states.RANK_ERROR
    for e in cube_states.rank_errors(cube_states.cells(fact), fact).collect():
        assert max(tuple(e)[4:]) <= 3 * cube_states.RANK_ERROR


def test_empty_fact(spark, fact):
    none = cube_states.cells(fact.limit(0))
    assert none.count() == 0 and cube_states.box_stats(none).count() == 0
    assert tuple(cube_states.kpis(none).first()) == (0, 0, None, 0, 0)


def test_distinct_members_beyond_the_exact_bound(spark):
    n = 60_000
    df = spark.range(n).selectExpr("id as ingest_id", "'t' as title", "concat('A', id) as authors", "2020 as Annee", "'X' as Pays", "'J' as Journal",
                                   "'Q1' as Quartile", "1L as Citations", "1.0D as Impact_Score", "'N/A' as abstract_")
    got = cube_states.kpis(cube_states.cells(df)).first()["active_authors"]
    assert got != n and abs(got - n) <= cube_states.DISTINCT_ERROR * n
