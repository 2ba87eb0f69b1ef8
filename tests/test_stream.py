import os

import pytest

from pyspark.sql import functions as F

from citeweave.operators import dedupe
from citeweave.streaming import ingest
from citeweave.streaming.ingest import (ingested, kept_first, run_title_ingest, run_title_ingest_keep_first, run_title_ingest_stateful,
                                        start_title_ingest, start_title_ingest_keep_first)
from conftest import collection, rows

DATA = [(i, f"T{i % 7}" if i % 5 else None, "A", "2021", "s", "j", "N/A", None) for i in range(60)]


@pytest.mark.parametrize("files_per_batch", [1, 3, None])
def test_result_does_not_depend_on_the_batches(spark, scratch, files_per_batch):
    coll = collection(spark, DATA).repartition(6)
    got = run_title_ingest(spark, coll, scratch, overlap=10, max_files_per_trigger=files_per_batch)
    assert rows(got) == rows(dedupe.dedupe_titles(coll))
    # restarting on the same checkpoint reads no new files and changes nothing
    start_title_ingest(spark, f"{scratch}/landing", f"{scratch}/table", f"{scratch}/checkpoint").awaitTermination()
    assert rows(ingested(spark, f"{scratch}/table")) == rows(dedupe.dedupe_titles(coll))


def test_redelivered_and_late_rows(spark, scratch):
    coll = collection(spark, DATA)
    run_title_ingest(spark, coll, scratch, overlap=10)
    # the same rows again as a new file, and a late row with a smaller id for a title that is held already
    late = collection(spark, [(-5, "T1", "late", "2020", "s", "j", "N/A", None)])
    coll.unionByName(late).write.mode("append").json(f"{scratch}/landing")
    start_title_ingest(spark, f"{scratch}/landing", f"{scratch}/table", f"{scratch}/checkpoint").awaitTermination()
    assert rows(ingested(spark, f"{scratch}/table")) == rows(dedupe.dedupe_titles(coll.unionByName(late)))


def test_nothing_delivered(spark, scratch):
    assert run_title_ingest(spark, collection(spark, []), scratch).count() == 0


def test_state_store_form_keeps_every_title_once(spark, scratch):
    coll = collection(spark, DATA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = run_title_ingest_stateful(spark, coll, scratch, overlap=10)
    titles = [r["title"] for r in got.collect()]
    assert len(titles) == len(set(titles))
    assert sorted(titles, key=str) == sorted({r[1] for r in DATA}, key=str)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


@pytest.mark.parametrize("files_per_batch", [1, None])
def test_state_store_keeps_the_first_for_any_order(spark, scratch, files_per_batch):
    coll = collection(spark, DATA).repartition(5)
    got = run_title_ingest_keep_first(spark, coll, scratch, overlap=10, max_files_per_trigger=files_per_batch)
    assert rows(got) == rows(dedupe.dedupe_titles(coll))
    # a late row of a smaller id corrects, one of a larger id and a re-delivery log nothing
    log = spark.read.parquet(f"{scratch}/log").count()
    late = collection(spark, [(-5, "T1", "late", "2020", "s", "j", "N/A", None), (900, "T2", "later", "2020", "s", "j", "N/A", None)])
    coll.limit(7).unionByName(late).write.mode("append").json(f"{scratch}/landing")
    start_title_ingest_keep_first(spark, f"{scratch}/landing", f"{scratch}/log", f"{scratch}/checkpoint", files_per_batch).awaitTermination()
    assert rows(kept_first(spark, f"{scratch}/log")) == rows(dedupe.dedupe_titles(coll.unionByName(late)))
    assert spark.read.parquet(f"{scratch}/log").count() == log + 1


def test_no_deliveries_to_the_state(spark, scratch):
    assert run_title_ingest_keep_first(spark, collection(spark, []), scratch).count() == 0


def test_keep_first_state_is_sparks_own(spark, scratch):
    """Titles meet the state in Spark's own aggregate: one call into Python for a title took minutes at scale."""
    coll = collection(spark, DATA + [DATA[3]])
    coll.repartition(3).write.json(f"{scratch}/landing")
    spark.createDataFrame([('{"title": "no id", "authors": "A"}',)], "value string").write.mode("append").text(f"{scratch}/landing")
    q = start_title_ingest_keep_first(spark, f"{scratch}/landing", f"{scratch}/log", f"{scratch}/checkpoint")
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["operatorName"] == "stateStoreSave"
    assert rows(kept_first(spark, f"{scratch}/log")) == rows(dedupe.dedupe_titles(collection(spark, DATA)))


@pytest.mark.parametrize("others", [ingest.OTHERS, 0])
def test_keep_first_leaves_rows_where_they_are(spark, scratch, monkeypatch, others):
    """Rows moved for every batch, and twice for the result, lay on disk beside the log and the state."""
    monkeypatch.setattr(ingest, "OTHERS", others)
    coll = collection(spark, DATA).repartition(3)
    got = run_title_ingest_keep_first(spark, coll, scratch, overlap=10)
    assert rows(got) == rows(dedupe.dedupe_titles(coll))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hash" not in plan
    # an id that the log holds twice
    spark.read.parquet(f"{scratch}/log/batch=1").write.parquet(f"{scratch}/log/batch=7")
    assert rows(kept_first(spark, f"{scratch}/log")) == rows(dedupe.dedupe_titles(coll))


def test_state_partitions_follow_the_titles(spark, scratch, monkeypatch):
    """A state partition takes local disk by itself: their number is not the session's shuffle partitions."""
    cores = spark.sparkContext.defaultParallelism
    assert [ingest.state_partitions_for(spark, n) for n in (0, 60, 10**9)] == [cores, cores, max(cores, 4000)]
    monkeypatch.setattr(ingest, "STATE_ROWS", 1 + 60 // (cores + 3))
    coll = collection(spark, DATA)
    assert rows(run_title_ingest_keep_first(spark, coll, scratch, overlap=10)) == rows(dedupe.dedupe_titles(coll))
    want = -(-len(DATA) // ingest.STATE_ROWS)
    assert len([d for d in os.listdir(f"{scratch}/checkpoint/state/0") if d.isdigit()]) == max(cores, want)


def test_keys_and_files_of_the_state_have_a_fixed_width(spark, scratch):
    keys = [r[0] for r in spark.createDataFrame([(None,), ("",), ("T" * 500,), ("é",)], "title string").select(ingest.fingerprint(F.col("title"))).collect()]
    assert len(set(map(bytes, keys))) == 4 and {len(k) for k in keys} == {32}
    # a batch's files are told by a hash of their paths, before any is opened
    for i in range(3):
        spark.range(5).write.mode("append").json(f"{scratch}/in")
    file = F.xxhash64("_metadata.file_path")
    df = spark.read.schema("id bigint").json(f"{scratch}/in")
    one = df.select(file.alias("f")).first()["f"]
    some = df.where(file.isin([one]))
    assert 0 < some.count() < df.count()
    plan = some._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert plan.collectLeaves().head().metrics().apply("numFiles").value() == 1


@pytest.mark.parametrize("run", [run_title_ingest, run_title_ingest_keep_first, run_title_ingest_stateful])
def test_deliveries_land_compressed(spark, scratch, run):
    coll = collection(spark, DATA)
    assert run(spark, coll, scratch, overlap=10).count() == dedupe.dedupe_titles(coll).count()
    landed = [f for f in os.listdir(f"{scratch}/landing") if f.startswith("part-")]
    assert landed and all(f.endswith(".json.gz") for f in landed)
