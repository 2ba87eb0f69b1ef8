"""Distributed selection against numpy and Spark's own percentile."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.constants import QUARTILES
from citeweave.operators import olap, warehouse
from citeweave.operators.selection import percentiles

POINTS = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]


def plain(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] if lo == hi else (hi - at) * v[lo] + (at - lo) * v[hi]


SHAPES = {
    "distinct": lambda r, i: r.random() * 1e6,
    "ties": lambda r, i: float(r.randrange(7)),
    "one value": lambda r, i: 3.5,
    "heavy tail": lambda r, i: 10.0 ** r.uniform(-300, 300),
    "far ends": lambda r, i: (-1.7e308, 1.7e308, r.random())[min(i, 2)],
    "infinite": lambda r, i: (math.inf, -math.inf, math.inf, r.random())[min(i, 3)],
    "half in one place": lambda r, i: 1.0 if i % 2 else 1 + r.random() * 1e-9,
}


@pytest.mark.parametrize("shape", list(SHAPES))
def test_percentiles_equal_sorting(spark, shape):
    rnd = random.Random(7)
    values = [SHAPES[shape](rnd, i) for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    got = percentiles(df, "x", POINTS, buckets=16, few=10)[None]
    assert got.n == 3000 and (got.low, got.high) == (min(values), max(values))
    assert got.points == [plain(values, p) for p in POINTS]


def test_percentiles_per_group_equal_sparks(spark):
    rnd = random.Random(8)
    rows = [(f"g{min(int(rnd.expovariate(1)), 3)}", rnd.randrange(10 ** 12)) for _ in range(2000)] + [("one", 5), (None, 1), (None, 4), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x long")
    want = {r["k"]: r["q"] for r in df.where("x is not null").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, [0.25, 0.5, 0.75]))).alias("q")).collect()}
    got = percentiles(df, "x", [0.25, 0.5, 0.75], "k", buckets=8, few=5)
    assert {k: s.points for k, s in got.items()} == want
    assert percentiles(df.limit(0), "x", [0.5]) == {}


def test_quartile_of_distinct_doubles(spark):
    rnd = random.Random(9)
    values = [rnd.gauss(0, 1) for _ in range(4000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i long, x double")
    got = {r["i"]: r["q"] for r in df.select("i", warehouse.quartile(F.col("x"), df).alias("q")).collect()}
    cuts = np.quantile(values, [0.75, 0.5, 0.25])
    want = {i: QUARTILES[sum(v <= c for c in cuts)] for i, v in enumerate(values)} | {-1: None}
    assert got == want


def test_box_statistics_of_distinct_doubles(spark):
    rnd = random.Random(10)
    rows = [("A" if i % 3 else "B", rnd.lognormvariate(0, 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "Quartile string, Impact_Score double")
    for r in olap.impact_box_stats(df).collect():
        v = np.array([x for q, x in rows if q == r["Quartile"]])
        q1, q3 = np.quantile(v, [0.25, 0.75])
        out = (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
        assert (r["n"], r["outliers"]) == (len(v), out.sum())
        assert np.allclose([r["q1"], r["median"], r["q3"], r["whisker_high"]], [q1, np.median(v), q3, v[~out].max()], atol=1e-6)
