"""JSON arrays of objects that differ in their fields."""

import json
import os

import pytest

from citeweave.sources import documents as D


def write(scratch, name, text):
    os.makedirs(f"{scratch}/in", exist_ok=True)
    with open(f"{scratch}/in/{name}.json", "w") as f:
        f.write(text)
    return f"{scratch}/in"


def test_fields_are_probed_from_the_data(spark, scratch):
    a = [{"title": "A", "year": 2020, "authors": ["x", "y"]}, {"title": "B", "doi": "10/1", "year": "2021"}, {}]
    path = write(scratch, "a", json.dumps(a, indent=2))
    write(scratch, "b", json.dumps([{"title": None, "place": {"lat": 1.5}, "it's \\ odd": True, "what's \"that\"?": 7}]))
    write(scratch, "c", "[\n]")
    docs = D.land_documents(spark, path)
    assert docs.count() == 4
    assert set(D.fields(docs)) == {"title", "year", "authors", "doi", "place", "it's \\ odd", "what's \"that\"?"}
    rows = {r["title"]: r for r in D.columns(docs, {"title": "string", "year": "int", "doi": "string", "it's \\ odd": "boolean", "none": "string"}).collect()}
    assert rows["A"]["year"] == 2020 and rows["A"]["doi"] is None and rows["B"]["doi"] == "10/1" and rows["B"]["year"] == 2021
    assert rows[None]["none"] is None
    everything = D.columns(docs).collect()
    assert len(everything) == 4 and any(r["it's \\ odd"] for r in everything) and any(r["authors"] == ["x", "y"] for r in everything)
    assert [r["what's \"that\"?"] for r in everything if r["it's \\ odd"]] == [7]


def test_values_of_another_type_are_null(spark, scratch):
    docs = D.read_documents(spark, write(scratch, "a", '[{"n": 1}, {"n": "many"}, {"n": [1]}, {"n": null}]'))
    assert [r["n"] for r in D.columns(docs, {"n": "bigint"}).collect()] == [1, None, None, None]


def test_no_documents(spark, scratch):
    docs = D.read_documents(spark, write(scratch, "a", "[]"))
    assert docs.count() == 0 and D.fields(docs) == {}


@pytest.mark.parametrize("text", ['[{"title": "a"}, {"title": ', '[{"title" "a"}]'])
def test_malformed_arrays_fail(spark, scratch, text):
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        D.read_documents(spark, write(scratch, "a", text)).collect()


def test_arrays_written_and_read(spark, scratch):
    df = spark.createDataFrame([(i, f"t{i}" if i % 3 else None, i * 1.5 if i % 2 else None) for i in range(50)], "ingest_id long, title string, w double")
    D.write_arrays(df, f"{scratch}/out")
    docs = D.read_documents(spark, f"{scratch}/out")
    got = D.columns(docs, {"ingest_id": "bigint", "title": "string", "w": "double"})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
