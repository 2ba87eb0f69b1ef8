"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_dir, work_path  # noqa: F401

ROW = "_row"


def as_row(df: DataFrame) -> DataFrame:
    """``df``'s rows as one struct column, so that added columns cannot clash with its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def sized(spark, rows: int, per_task: int) -> int:
    """Tasks for ``rows`` rows: at least the session's shuffle partitions, more as the data grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)


def environment() -> None:
    """Workers encode on one thread each: Spark deals out the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), applied to every element."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values (len(v) - width + 1 of them)."""
    span = 1
    while 2 * span <= width:
        v = np.minimum(v[:len(v) - span], v[span:])
        span *= 2
    rest = width - span
    return np.minimum(v[:len(v) - rest], v[rest:]) if rest else v


# A filter of keys: at most 2^MAX_BITS bits (64 MB), whatever the number of keys.  Fuller filters let more
# through, which costs rows of later shuffles and never a result: those joins are exact.
MIN_BITS, MAX_BITS, SLICES = 18, 29, 64


def key_filter(keys: DataFrame):
    """Broadcast bit array of the keys (one bigint column): ``maybe`` tells for each key whether it may be there.

    Slices of the array are filled where their keys are; the driver gets the bytes of the array only."""
    spark = keys.sparkSession
    name = keys.columns[0]
    n = keys.count()
    bits = min(MAX_BITS, max(MIN_BITS, int(16 * n).bit_length()))
    own = bits - SLICES.bit_length() + 1                      # bits of a slice, as a power of two

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = mix64(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(own)).astype(np.int32)),
                                              pa.array((at & np.uint64((1 << own) - 1)).astype(np.int32))], names=["slice", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            slices, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in np.unique(slices).tolist():
                held.setdefault(s, np.zeros(1 << own, bool))[at[slices == s]] = True
        for s, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array(
                [np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])
    filled = keys.select(name).mapInArrow(place, "slice int, at int").repartition(SLICES, "slice").mapInArrow(fill, "slice int, bits binary")
    table, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (own - 3)
    for r in filled.collect():                                # 2^bits bits, at most 64 MB
        table[r["slice"] * size:(r["slice"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast((bits, table))


def maybe(held: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Flags of the keys (int64 or uint64) that may be in the filter ``held``."""
    bits, table = held
    at = mix64(keys.view(np.uint64)) >> np.uint64(64 - bits)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


LINKS_IN_TASK = 500_000        # links of which one task finds the components; more are joined in steps


def joined_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) by union-find, for links that fit one task."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            above[max(u, v)] = min(u, v)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node reachable, itself included.

    Up to LINKS_IN_TASK links are joined in one task, whose size that bounds.  More go through alternating
    large-star and small-star steps, each a grouped minimum (combined before the shuffle) joined back to the
    links; every step is written to the shared folder.  The driver sees counts only."""
    e = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    if e.count() <= LINKS_IN_TASK:
        return materialize(e.coalesce(1).mapInArrow(joined_links, "node bigint, component bigint"), tag)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = materialize(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(both.filter("v > u").join(low, "u").filter("m < u").select("u", F.col("m").alias("v")))
                        .filter("u > v").distinct(), tag)
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = materialize(e.join(low, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v"))
                        .unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), tag)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
