from citeweave.session import materialize, shared_dir, spread, work_path


def test_shared_dir_and_work_path(spark):
    base = shared_dir(spark)
    assert base and spark.sparkContext.getCheckpointDir()
    p = work_path(spark, "x")
    assert p.startswith(base) and spark.sparkContext.applicationId in p


def test_spread_only_when_too_few_splits(spark):
    par = spark.sparkContext.defaultParallelism
    few = spark.range(100).coalesce(1)
    assert spread(few).rdd.getNumPartitions() == par
    many = spark.range(100).repartition(par * 2)
    assert spread(many) is many


def test_materialize_round_trip(spark):
    df = spark.range(50).selectExpr("id", "id % 7 AS k")
    back = materialize(df, "probe")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert "stage" in back.inputFiles()[0]


def test_clear_work_removes_what_was_landed(spark):
    import os

    from citeweave.session import clear_work
    path = materialize(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    clear_work(spark)
    assert not os.path.exists(path)
    from citeweave.plans import catalog
    from citeweave.sources import articles
    articles._LANDED.clear()
    catalog._FACTS.clear()


def test_cleared_work_is_landed_anew(spark):
    from citeweave.plans import catalog
    from citeweave.session import clear_work
    sf = "/root/testdata/sf0.001"
    first = catalog.terms_table(spark, sf).count()
    clear_work(spark)
    assert catalog.terms_table(spark, sf).count() == first > 0
