"""The bucketed table: keep-first over any batches, bounded rewrites and reads, batches that run again."""

import os
import random
import time

from pyspark.sql import functions as F

from citeweave.operators.dedupe import dedupe_titles
from citeweave.schema import COLLECTION_SCHEMA
from citeweave.session import work_path
from citeweave.streaming import upsert as U
from conftest import collection, rows


def article(i, title):
    return (i, title, f"A{i}", "2021", "s", "j", "N/A", None)


def read(spark, table):
    return U.read_table(spark, table, COLLECTION_SCHEMA)


def test_any_batches_give_keep_first(spark, scratch):
    rnd = random.Random(1)
    data = [article(i, rnd.choice([None, "", *[f"T{k}" for k in range(40)]])) for i in range(300)]
    for n in (1, 4, 11):
        order, table = rnd.sample(data, len(data)), f"{scratch}/t{n}"
        parts = [order[i::n] for i in range(n)]
        for b, part in enumerate(parts):
            U.upsert(collection(spark, part + part[:3]), table, b, buckets=8)        # with rows delivered twice
        assert rows(read(spark, table)) == rows(dedupe_titles(collection(spark, data)))
    assert len(rows(read(spark, f"{scratch}/t4"))) == 42


def test_a_batch_rewrites_its_own_buckets_only(spark, scratch):
    table = f"{scratch}/t"
    U.upsert(collection(spark, [article(i, f"T{i}") for i in range(200)]), table, 0, buckets=16)
    before, n = U.manifest(spark, table)
    assert n == 16 and len(before) == 16
    assert U.upsert(collection(spark, [article(i + 1000, f"T{i}") for i in range(200)]), table, 1) == 0      # all held with smaller ids
    assert U.manifest(spark, table)[0] == before
    assert U.upsert(collection(spark, [article(-1, "T7"), article(999, "new"), article(998, "T8")]), table, 2, buckets=99) in (1, 2)
    after, n = U.manifest(spark, table)
    changed = {b for b in after if after[b] != before[b]}
    assert n == 16 and 1 <= len(changed) <= 2
    got = {r["title"]: r["ingest_id"] for r in read(spark, table).collect()}
    assert got["T7"] == -1 and got["T8"] == 8 and got["new"] == 999 and len(got) == 201


def test_reads_do_not_grow_with_the_batches(spark, scratch):
    table = f"{scratch}/t"
    for b in range(12):
        U.upsert(collection(spark, [article(100 * b + i, f"T{i % 7}-{b % 3}") for i in range(20)]), table, b, buckets=4)
    df = read(spark, table)
    assert len(df.inputFiles()) <= 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert df.count() == 21


def test_a_batch_that_runs_again_changes_nothing(spark, scratch, monkeypatch):
    table = f"{scratch}/t"
    U.upsert(collection(spark, [article(1, "A"), article(2, "B")]), table, 0, buckets=2)
    late = collection(spark, [article(0, "A"), article(3, "C")])

    def lost(*a, **k):
        raise RuntimeError("lost before the manifest")
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", lost, raising=False)
        try:
            U.upsert(late, table, 1)
        except RuntimeError:
            pass
    assert rows(read(spark, table)) == rows(collection(spark, [article(1, "A"), article(2, "B")]))     # unpublished files are not seen
    U.upsert(late, table, 1)
    want = rows(collection(spark, [article(0, "A"), article(2, "B"), article(3, "C")]))
    assert rows(read(spark, table)) == want
    files = sorted(read(spark, table).inputFiles())
    assert U.upsert(late, table, 1) == 0 and sorted(read(spark, table).inputFiles()) == files
    os.remove(f"{table}/manifests/1/_SUCCESS")                      # a manifest that was not finished does not count
    assert len(rows(read(spark, table))) == 2 and U.upsert(late, table, 1) > 0
    assert rows(read(spark, table)) == want


def test_vacuum_keeps_what_is_named(spark, scratch):
    table = f"{scratch}/t"
    for b in range(5):
        U.upsert(collection(spark, [article(10 - b, "A"), article(20 + b, f"B{b}")]), table, b, buckets=2)
    want = rows(read(spark, table))
    assert U.vacuum(spark, table, keep=1) > 0 and U.versions(spark, table) == [4]
    assert rows(read(spark, table)) == want and U.vacuum(spark, table, keep=1) == 0
    U.upsert(collection(spark, [article(1, "Z")]), table, 5)
    assert len(rows(read(spark, table))) == len(want) + 1


def test_buckets_are_rewritten_in_steps_that_leave_nothing_behind(spark, scratch):
    """Shuffles and persisted rows of a batch would lie on disk beside the table."""
    def local():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        files = [files.apply(i) for i in range(files.size())]
        return {f.getName(): f.length() for f in files if f.getName().endswith(".data") or f.getName().startswith("rdd_")}
    rnd, table, buckets = random.Random(2), f"{scratch}/t", U.STEPS * spark.sparkContext.defaultParallelism
    data = [(i, f"T{rnd.randrange(2000)}" if i % 9 else "hot", f"A{i}", "2021", "s", "j", "%x" % rnd.getrandbits(8000), None) for i in range(3000)]
    data += [(i, "of id %d too" % i, "", "2021", "s", "j", None, None) for i in (2000, 2001)]              # ids of two titles
    before = local()
    for b, part in enumerate((data[1500:], data[:1600])):
        assert U.upsert(collection(spark, part).repartition(4), table, b, buckets=buckets) == buckets
        assert len([d for d in os.listdir(f"{table}/data") if d.startswith(f"{b}-")]) == U.STEPS
        size = sum(os.path.getsize(f.removeprefix("file://")) for f in read(spark, table).inputFiles())
        for _ in range(50):
            if sum(n for f, n in local().items() if f not in before) > size / 10:
                time.sleep(0.2)
        assert sum(n for f, n in local().items() if f not in before) <= size / 10
    want: dict = {}
    for r in data:
        want[r[1]] = min(r, want.get(r[1], r), key=lambda x: x[0])
    assert {r["title"]: tuple(r) for r in read(spark, table).collect()} == want and read(spark, table).count() == len(want)
    stage = work_path(spark, "stage")
    assert not os.path.isdir(stage) or not [d for d in os.listdir(stage) if d.startswith("upsert-")]


def test_rows_without_an_id_take_no_part(spark, scratch):
    df = collection(spark, [article(1, "A")])
    U.upsert(df.union(df.withColumn("ingest_id", F.lit(None).cast("bigint"))).union(df.selectExpr("CAST(NULL AS bigint)", "'B'", *df.columns[2:])),
             f"{scratch}/t", 0, buckets=2)
    assert rows(read(spark, f"{scratch}/t")) == rows(df)


def test_nothing_yet(spark, scratch):
    assert read(spark, f"{scratch}/none").count() == 0
    U.upsert(collection(spark, []), f"{scratch}/t", 0, buckets=3)
    assert read(spark, f"{scratch}/t").count() == 0 and U.manifest(spark, f"{scratch}/t") == ({}, 3)
