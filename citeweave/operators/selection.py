"""Exact order statistics by distributed selection.

The wanted ranks of a column are narrowed pass by pass: the value range of each is cut into buckets, tasks count
their rows per bucket (partial aggregation), and the bucket that holds the rank becomes the next range, until a range
holds few rows or one value; these rows decide.  No task sorts or holds the column: a pass reads it once, a task
keeps at most a count for each bucket, and the driver gets the buckets of the open ranges.  A pass divides the rows
of an even column by ``BUCKETS``; a range's extreme values have buckets of their own, so every pass gets on whatever
the values are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096               # per range and pass
FEW = 20_000                 # rows of a range that are taken as they are


@dataclass
class Range:
    """A group's values from ``low`` to ``high``, ``rows`` of them, with ``below`` smaller ones in the group."""
    group: object
    low: object
    high: object
    below: int
    rows: int
    ranks: list[int]


@dataclass(frozen=True)
class Summary:
    n: int
    low: object
    high: object
    points: list[float]


def _within(rows: DataFrame, ranges: list[Range]) -> DataFrame:
    """The rows (g, v) that lie in one of the ranges, with its number; one broadcast row for each range."""
    fields = rows.schema
    table = rows.sparkSession.createDataFrame([(i, r.group, r.low, r.high) for i, r in enumerate(ranges)],
                                              f"id int, own {fields['g'].dataType.simpleString()}, low {fields['v'].dataType.simpleString()}, "
                                              f"high {fields['v'].dataType.simpleString()}")
    return rows.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("own")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))


def _narrowed(rows: DataFrame, ranges: list[Range], buckets: int) -> list[Range]:
    """One pass: each range replaced by its buckets that hold one of its ranks."""
    def scaled(c: str):                          # so that no width and no product with it overflows
        return F.col(c).cast("double") / (4 * buckets)
    bucket = (F.when(F.col("v") <= F.col("low"), 0).when(F.col("v") >= F.col("high"), buckets + 1)
              .otherwise(F.coalesce(F.width_bucket(scaled("v"), scaled("low"), scaled("high"), F.lit(buckets)), F.lit(buckets))))
    counted = (_within(rows, ranges).withColumn("bucket", bucket).groupBy("id", "bucket")
               .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
    out: dict[tuple, Range] = {}
    by_range: dict[int, list] = {}
    for c in counted:
        by_range.setdefault(c["id"], []).append(c)
    for i, own in by_range.items():
        r, below = ranges[i], ranges[i].below
        for c in sorted(own, key=lambda c: c["bucket"]):
            if ranks := [k for k in r.ranks if below <= k < below + c["n"]]:
                out[i, c["bucket"]] = Range(r.group, c["low"], c["high"], below, c["n"], ranks)
            below += c["n"]
    return list(out.values())


def percentiles(df: DataFrame, value: str, points: Sequence[float], group: str | None = None,
                buckets: int = BUCKETS, few: int = FEW) -> dict[object, Summary]:
    """For each group (the whole frame, under None, without one): rows with a value, least, greatest, and the exact
    percentiles with linear interpolation, as SQL's ``percentile``.

    ``df`` is read once for each pass: hand in a landed table.  Groups are the members of a dimension: the driver
    keeps a few numbers for each."""
    g = F.lit(None).cast("string") if group is None else F.col(group)
    rows = df.select(g.alias("g"), F.col(value).alias("v")).where(F.col("v").isNotNull())
    first = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()

    def ranks(n: int) -> list[int]:
        return sorted({f(p * (n - 1)) for p in points for f in (math.floor, math.ceil)})
    todo = [Range(r["g"], r["low"], r["high"], 0, r["n"], ranks(r["n"])) for r in first]
    found: dict[tuple, object] = {}
    small: list[Range] = []
    while todo:
        for r in todo:
            if r.low == r.high:
                found.update({(r.group, k): r.low for k in r.ranks})
            elif r.rows <= few:
                small.append(r)
        todo = [r for r in todo if r.low != r.high and r.rows > few]
        todo = _narrowed(rows, todo, buckets) if todo else []
    if small:
        taken: dict[int, list] = {}
        for r in _within(rows, small).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n")).collect():     # at most few a range
            taken.setdefault(r["id"], []).append((r["v"], r["n"]))
        for i, own in taken.items():
            at = small[i].below
            for v, n in sorted(own):
                found.update({(small[i].group, k): v for k in small[i].ranks if at <= k < at + n})
                at += n

    def interpolated(name: object, n: int, p: float) -> float:
        place = p * (n - 1)
        lo, hi = math.floor(place), math.ceil(place)
        a, b = float(found[name, lo]), float(found[name, hi])
        return a if lo == hi or a == b else (hi - place) * a + (place - lo) * b
    return {r["g"]: Summary(r["n"], r["low"], r["high"], [interpolated(r["g"], r["n"], p) for p in points]) for r in first}
