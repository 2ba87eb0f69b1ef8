"""Exact Jaccard self-join on word n-grams with PartEnum signatures.

A document's set holds the 64-bit fingerprints of its distinct n-word shingles.
Sets are banded by size.  Two sets of a band pair with similarity of at least
the threshold differ in at most k features, k following from the sizes.  The
feature domain is dealt into n1 first-level partitions of N2 second-level ones
each, and a set's signatures are fingerprints of its features in every subset of
N2 - K2 second-level partitions of every first-level one.  With N2 = 2 and K2 = 1
these are N2 * n1 > k + 1 single parts, of which a similar pair differs in k at
most, so it shares at least one; parts are a tenth more than that, and empty ones
are signed only by sets that have more of them than that tenth.

Sets that are equal are one node from the start.  Signatures seen once are left
out by a broadcast bit filter of bounded size, part by part of the signatures.  Of
signatures that the same nodes have one is kept.  The nodes of a signature are
first compared with one leader, its smallest node, so a group of n costs n
comparisons; real copies come together here.  Groups that still hold several
components are then compared whole, in tiles: a task gets two tiles of at most
SMALL_GROUP nodes with their sizes and parity sketches and compares all pairs
with numpy.  A sketch rules out a pair by a bound that never errs, so only pairs
that may be similar become rows; a wider sketch of each set, in proportion to its
size, rules out most of these, and the rest are compared exactly on their fingerprint
sets.  The nodes of groups larger than a tile (texts that share a passage fill
some parts with nothing else) are grouped anew before, by the rarest features of
each set: of sets with a share of the threshold in common, some feature lies
among each one's rarest 1 - threshold.  No link between components is lost,
whatever the group sizes.

Cases: a null or empty text, or one without words, has an empty set and links
with nothing; fewer words than n form one shingle; repeated rows are one node
and each gets its own result row; rows of null id take part and are reported; rows of
one id and different texts are documents of their own; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import release
from .common import ROW, as_row, components, key_filter, materialize, maybe, mix64

SHINGLE = 3                       # words, fixed by the contract of op2
THRESHOLD = 90                    # 100 * intersection >= THRESHOLD * union, fixed by the contract of op2
BAND = 1.25                       # ratio of a band's size limits
N2, K2 = 2, 1                     # second-level partitions, differences allowed in them
SLOTS = 1 << 20                   # counters that order the features of large groups
SKETCH = 512                      # bits of a set's parity sketch, a power of two
WIDEST = 1 << 16                  # bits of a set's wide sketch, at most; else 2 to 4 bits a feature
KNOWN_SIGS = 16                   # least signatures of a node that a row of a tile carries
SMALL_GROUP = 1024                # nodes of a tile, of which a task compares all pairs
COUNTED = (1 << 44) - 1           # bits by which signatures are counted; equal ones of different sets cost rows, no result
COLUMNS = 8                       # columns that signatures are landed in, so that a part of them is read alone
SIGNED_AT_ONCE = 16_000_000       # signatures counted at once, up to COLUMNS parts
PASSES = 8                        # most parts of the groups that are compared one after the other
MEMBERS_AT_ONCE = 4_000_000       # rows of a part, up to PASSES parts
FEATURES_IN_STEP = 8_000_000      # features of pairs whose sets are moved at once, or an eighth of all if that is more
STRIP = 64                        # rows of a tile that are compared with another at once
PAIRS_AT_ONCE = 100_000           # pairs of which a task drops repeated ones at once
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct fingerprints of the n-word shingles (A-Z lower-cased, words [^\\x20\\x09-\\x0D]+)."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s = mix64(s * _M + h[i:len(h) - n + 1 + i])
    return np.unique(s)


def node_of(s: np.ndarray) -> int:
    """The 64-bit fingerprint of a set (signed)."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def bands(size: int, threshold: int) -> list[tuple[int, int]]:
    """(band, k) of the bands a set takes part in.

    A band is for pairs whose smaller set has its sizes [low, high); the larger set may be larger by
    100 / threshold.  k is the largest symmetric difference of such a pair."""
    out, b, low = [], 0, 1
    while low <= size:
        high = max(low + 1, int(low * BAND))
        largest = (high - 1) * 100 // threshold
        if size <= largest:
            out.append((b, (high - 1 + largest) * (100 - threshold) // (100 + threshold)))
        b, low = b + 1, high
    return out


def signatures(s: np.ndarray, threshold: int) -> np.ndarray:
    """The set's signatures over its bands; none where only an equal set can be similar (k = 0)."""
    out = []
    own = mix64(s ^ _M)
    for band, k in bands(len(s), threshold):
        if k:
            spare = -(-(k + 1) // 10)                             # parts that may be empty in a set without being signed
            n1 = -(-(k + 1 + spare) // N2)
            part = ((s >> np.uint64(11)) % np.uint64(n1 * N2)).astype(np.int64)
            sums = np.zeros(n1 * N2, np.uint64)
            np.add.at(sums, part, own)
            full = (np.bincount(part, minlength=n1 * N2) > 0).reshape(n1, N2)
            all_ = int((~full).sum()) > n1 * N2 - k - 1            # too many empty parts: an empty one may be all a pair shares
            sums = sums.reshape(n1, N2)
            first = mix64(np.arange(n1, dtype=np.uint64) + np.uint64((band + 1) << 32))
            for c, subset in enumerate(combinations(range(N2), N2 - K2)):
                x = first + np.uint64(c + 1)
                for j in subset:
                    x = mix64(x * _M + sums[:, j])
                out.append(x if all_ else x[full[:, list(subset)].any(1)])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows: a text's signatures take kilobytes, and a task's arrays stay small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _dealt(arrays: list[np.ndarray]) -> list[pa.ListArray]:
    """The arrays' values dealt into COLUMNS columns of lists by their lowest bits."""
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    row, column = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays]), flat & np.uint64(COLUMNS - 1)
    out = []
    for c in range(COLUMNS):
        own = column == c
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=len(arrays)))]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[own].view(np.int64))))
    return out


def sets(docs: DataFrame, text: str, doc_id: str, n: int, threshold: int) -> DataFrame:
    """doc_id, digest (of the text, null for null), n_shingles, node (null for an empty set) and the signatures in
    COLUMNS columns sigs0, sigs1, ...; no texts."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.md5(text).alias("digest"), F.col(text).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [shingles(t, n) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in got], pa.int64()),
                 pa.array([node_of(s) if len(s) else None for s in got], pa.int64()),
                 *_dealt([signatures(s, threshold) for s in got])], names=["doc_id", "digest", "n_shingles", "node", *names])
    names = [f"sigs{c}" for c in range(COLUMNS)]
    return df.mapInArrow(made, StructType(df.schema.fields[:2] + StructType.fromDDL(
        "n_shingles bigint, node bigint, " + ", ".join(f"{c} array<bigint>" for c in names)).fields))


def sketch(s: np.ndarray, bits: int = SKETCH) -> bytes:
    """Parities of the features by ``bits`` hash values, packed: two sets' sketches differ in as many bits as the sets
    differ in features, at most."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_sketch(s: np.ndarray) -> bytes:
    """A sketch of 2 to 4 bits a feature, SKETCH at least: one of fixed width is full of odd bits by chance where sets are
    large, and rules nothing out."""
    return sketch(s, min(WIDEST, max(SKETCH, 1 << (2 * len(s) - 1).bit_length())))


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two wide sketches differ; the wider one is folded to the other's width."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def chosen_sets(docs: DataFrame, text: str, n: int, wanted, several) -> DataFrame:
    """(node, n, items, sketch, wide) of the nodes that pass the filter ``wanted``, one row each; landed.

    Nodes that are not in the filter ``several``, of nodes with more than one row, stay where they are; only sets of
    the others are moved to find their copies, those of one task once."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()                                 # copied nodes of this task's rows
        for b in slices(batches):
            got = {node_of(s): s for s in (shingles(t, n) for t in b.column(0).to_pylist()) if len(s)}
            keys = np.fromiter((k for k in got if k not in done), np.int64)
            keys = keys[maybe(wanted.value, keys)]
            copied = maybe(several.value, keys)
            done.update(keys[copied].tolist())
            sets = [got[k] for k in keys.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), _lists(sets), pa.array(
                [sketch(s) for s in sets], pa.binary()), pa.array([wide_sketch(s) for s in sets], pa.binary()), pa.array(copied)],
                names=["node", "n", "items", "sketch", "wide", "copied"])
    found = materialize(docs.select(text).mapInArrow(
        made, "node bigint, n bigint, items array<bigint>, sketch binary, wide binary, copied boolean"), "join-found")
    once = materialize(found.filter("copied").drop("copied").dropDuplicates(["node"]), "join-sets")
    return found.filter("NOT copied").drop("copied").unionByName(once)


def may_link(nx: np.ndarray, x: np.ndarray, ny: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    """Flags of the pairs of sets (sizes and sketches; broadcast) that size and sketch do not rule out: similar sets
    differ in at most (|x| + |y|) * (100 - threshold) / (100 + threshold) features."""
    differ = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)
    return (100 * np.minimum(nx, ny) >= threshold * np.maximum(nx, ny)) & ((100 + threshold) * differ <= (100 - threshold) * (nx + ny))


MEMBER = ("sig", "node", "component", "n", "sketch")


def _arrays(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns of members as arrays; sketches as rows of 64-bit words, lists as arrays of arrays."""
    out = {c: b.column(c).to_numpy() for c in b.schema.names if c not in ("sketch", "sigs")}
    if "sigs" in b.schema.names:
        own = b.column("sigs")
        out["sigs"] = np.empty(b.num_rows, object)
        for i, x in enumerate(np.split(own.flatten().to_numpy(), np.cumsum(own.value_lengths().to_numpy())[:-1])):
            out["sigs"][i] = x
    out["sketch"] = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(b.num_rows, SKETCH // 64)
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct (a, b), the smaller first."""
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def with_leaders(threshold: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each group's first node with those of other components that may be similar; rows sorted by (sig, node)."""
    last = None                                        # the leader of the group that the batch before ended with
    for batch in batches:
        if not batch.num_rows:
            continue
        m = _arrays(batch)
        sig = m["sig"]
        start = np.concatenate([[True], sig[1:] != sig[:-1]])
        lead = np.maximum.accumulate(np.where(start, np.arange(len(sig)), 0))
        cols = {c: m[c][lead] for c in MEMBER[1:]}
        if last is not None and last["sig"] == sig[0]:
            own = sig == sig[0]
            for c in MEMBER[1:]:
                cols[c][own] = last[c]
        last = {"sig": sig[-1], **{c: cols[c][-1].copy() for c in MEMBER[1:]}}
        good = (cols["component"] != m["component"]) & may_link(cols["n"], cols["sketch"], m["n"], m["sketch"], threshold)
        if good.any():
            yield _pairs(cols["node"][good], m["node"][good])


def in_tiles(threshold: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of two tiles that may be similar and lie in several components; rows sorted by (sig, i, j, tile).

    Two nodes may meet in many groups: they become a row in that of their least common signature (of this part), and in
    those of which their KNOWN_SIGS least signatures show no lesser one in common."""
    def compared(parts: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
        t = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        out = []
        same = t["i"][0] == t["j"][0]
        left = np.arange(len(t["node"])) if same else np.flatnonzero(t["tile"] == t["i"][0])
        right = left if same else np.flatnonzero(t["tile"] == t["j"][0])
        for k in range(0, len(left), STRIP):
            x = left[k:k + STRIP]
            y = right[k + 1:] if same else right
            good = (t["component"][x][:, None] != t["component"][y][None]) & may_link(
                t["n"][x][:, None], t["sketch"][x][:, None], t["n"][y][None], t["sketch"][y][None], threshold)
            if same:
                good &= y[None] > x[:, None]
            p, q = np.nonzero(good)
            p, q = x[p], y[q]
            sigs, own = t["sigs"], t["sig"][0]
            once = [not (np.intersect1d(sigs[u], sigs[v], assume_unique=True) < own).any() for u, v in zip(p.tolist(), q.tolist(), strict=True)]
            if any(once):
                out.append((t["node"][p[once]], t["node"][q[once]]))
        return out
    key, parts, found, held = None, [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        m = _arrays(batch)
        change = (m["sig"][1:] != m["sig"][:-1]) | (m["i"][1:] != m["i"][:-1]) | (m["j"][1:] != m["j"][:-1])
        ends = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for s, e in zip(ends, ends[1:], strict=False):
            own = {c: v[s:e] for c, v in m.items()}
            k = (int(own["sig"][0]), int(own["i"][0]), int(own["j"][0]))
            if k != key and parts:
                new = compared(parts)
                found, held, parts = found + new, held + sum(len(a) for a, _ in new), []
                if held > PAIRS_AT_ONCE:
                    yield _pairs(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
                    found, held = [], 0
            key = k
            parts.append(own)
    if parts:
        found += compared(parts)
    if found:
        yield _pairs(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))


def of_pairs(pairs: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """These columns of ``items``, for the nodes of the pairs (and a few that a filter lets through)."""
    wanted = key_filter(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe(wanted.value, b.column(0).to_numpy())))
    sets = items.select("node", *columns)
    return sets.mapInArrow(only, sets.schema)


def not_ruled_out(pairs: DataFrame, items: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that the sets' wide sketches leave: what they move is a small part of the sets."""
    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nx, ny = b.column(2).to_numpy(), b.column(4).to_numpy()
            differ = np.fromiter(map(differing, b.column(3).to_pylist(), b.column(5).to_pylist()), np.int64, b.num_rows)
            yield b.filter(pa.array((100 + threshold) * differ <= (100 - threshold) * (nx + ny))).select(["a", "b"])
    known = of_pairs(pairs, items, "n", "wide")
    return pairs.join(known.select(F.col("node").alias("a"), F.col("n").alias("nx"), F.col("wide").alias("x")), "a") \
        .join(known.select(F.col("node").alias("b"), F.col("n").alias("ny"), F.col("wide").alias("y")), "b") \
        .select("a", "b", "nx", "x", "ny", "y").mapInArrow(left, "a bigint, b bigint")


def similar(pairs: DataFrame, items: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, compared exactly; only the sets of these nodes are moved."""
    sets = of_pairs(pairs, items, "items")
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a") \
        .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b") \
        .filter(100 * common >= threshold * (F.size("x") + F.size("y") - common)).select("a", "b")


def rare_features(items: DataFrame, threshold: int) -> DataFrame:
    """(sig, node): the first features of each set in one order of all features, as many as any similar pair of these
    sets must share one of.

    Any fixed order will do; this one goes by how often a feature's slot (one of SLOTS) occurs in an eighth of the
    sets, then by the feature, so that what many texts share comes last.  The counts, SLOTS numbers at most, are
    sent to the tasks; the features themselves stay where they are."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(i).to_numpy().astype("<i8").tobytes()], pa.binary()) for i in (0, 1)],
                                             names=["slot", "n"])
    often = items.filter(F.pmod("node", F.lit(8)) == 0).select(F.explode("items").alias("f")) \
        .groupBy(F.pmod("f", F.lit(SLOTS)).alias("slot")).agg(F.count("*").alias("n")).filter("n > 1")
    counts = np.zeros(SLOTS, np.int64)
    for r in often.mapInArrow(packed, "slot binary, n binary").collect():
        counts[np.frombuffer(r["slot"], "<i8")] = np.frombuffer(r["n"], "<i8")
    sent = items.sparkSession.sparkContext.broadcast(counts.astype(np.uint32))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, lists = b.column(0).to_numpy(), b.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            sig, node = [], []
            for k, s, e in zip(nodes.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                f = flat[s:e]
                own = f[np.lexsort((f, sent.value[f % SLOTS]))][:len(f) * (100 - threshold) // 100 + 1]
                sig.append(own)
                node.append(np.full(len(own), k))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(node))], names=["sig", "node"])
    return items.select("node", "items").mapInArrow(first, "sig bigint, node bigint")


class Links:
    """The components found so far, and the pairs of a grouping (sig, node) still to be compared."""

    def __init__(self, docs: DataFrame, text: str, n: int, threshold: int):
        self.docs, self.text, self.n, self.threshold = docs, text, n, threshold
        self.labels: DataFrame | None = None          # (node, component) of the links found, None before the first
        self.items: DataFrame | None = None
        self.nodes = self.features = 0                # rows of items, and features in them

    def open(self, members: DataFrame) -> DataFrame:
        """Members with their components, of the groups that hold several; with the group's size."""
        if self.labels is None:
            state = members.withColumn("component", F.col("node"))
        else:
            state = members.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        group = state.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
        return materialize(state.join(group.filter("lo <> hi").select("sig", "size"), "sig"), "join-open")

    def compare(self, pairs: DataFrame) -> None:
        """Adds the links among the pairs; in steps, as each pair that the wide sketches leave moves its two sets."""
        met = materialize(pairs.distinct(), "join-pairs")
        if met.isEmpty():
            return release(met)
        pairs = materialize(not_ruled_out(met, self.items, self.threshold), "join-near")
        release(met)
        if rows := pairs.count():
            steps = min(2 * PASSES, -(-rows * self.features // self.nodes // max(FEATURES_IN_STEP, self.features // 8)))
            new = [materialize(similar(part, self.items, self.threshold), "join-links") for part in dealt(pairs, steps, "a", "b")]
            known = [] if self.labels is None else [self.labels.select(F.col("node").alias("a"), F.col("component").alias("b"))]
            if any([not links.isEmpty() for links in new]):
                self.labels = components(reduce(DataFrame.unionByName, [*new, *known]), "join-comp")
            for links in new:
                release(links)
        release(pairs)

    def described(self, open_: DataFrame) -> DataFrame:
        return open_.join(self.items.select("node", "n", "sketch"), "node")

    def leaders(self, members: DataFrame) -> None:
        """Compares each open group's smallest node with its others."""
        open_, threshold = self.open(members), self.threshold
        rows = self.described(open_).select(*MEMBER)
        self.compare(rows.repartition("sig").sortWithinPartitions("sig", "node")
                     .mapInArrow(lambda it: with_leaders(threshold, it), "a bigint, b bigint"))
        release(open_)

    def tiles(self, members: DataFrame, at_most: int | None = None) -> DataFrame:
        """Compares all pairs across components in open groups (of at most so many nodes), and returns the nodes of the
        other open groups.  A group of m tiles is m * (m + 1) / 2 pairs of tiles, each of which gets its own copy of the rows."""
        open_ = self.open(members)
        own = open_ if at_most is None else open_.filter(F.col("size") <= at_most)
        # a few of a node's open signatures: all of them in each of its rows would grow with the square of their number
        known = own.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, KNOWN_SIGS).alias("sigs"))
        rows = self.described(own).join(known, "node")
        m = F.ceil(F.col("size") / SMALL_GROUP).cast("int")
        rows = rows.select(*MEMBER, "sigs", F.pmod(F.xxhash64("node"), m).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), m - 1)).alias("other")) \
            .select(*MEMBER, "sigs", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
        threshold = self.threshold
        self.compare(rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "tile", "node")
                     .mapInArrow(lambda it: in_tiles(threshold, it), "a bigint, b bigint"))
        rest = materialize(open_.filter(F.lit(False) if at_most is None else F.col("size") > at_most).select("node").distinct(), "join-rest")
        release(open_)
        return rest

    def members(self, signed: DataFrame) -> DataFrame:
        """(sig, node) of signatures that several nodes have, of all groups of the same nodes one; part by part of the
        signatures, as their count moves them all.  Releases ``signed``."""
        total = COLUMNS * (signed.agg(F.sum(F.size("sigs0"))).first()[0] or 0)
        steps, found = min(COLUMNS, 1 + total // SIGNED_AT_ONCE), []
        for i in range(steps):
            own = signed.select("node", F.concat(*[f"sigs{c}" for c in range(i, COLUMNS, steps)]).alias("sigs"))
            each = own.select(F.explode("sigs").alias("sig")).select(F.col("sig").bitwiseAND(F.lit(COUNTED)).alias("sig"))
            twice = materialize(each.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1").select("sig"), "join-repeated")
            seen = key_filter(twice)
            found.append(materialize(own.mapInArrow(lambda it, seen=seen: repeated(seen, it), "sig bigint, node bigint").distinct(), "join-members"))
            release(twice)
            seen.unpersist()
        release(signed)
        members = materialize(one_of_each(reduce(DataFrame.unionByName, found)), "join-members")
        for part in found:
            release(part)
        return members

    def find(self, own: DataFrame, signed: DataFrame) -> DataFrame:
        """(node, component) of the nodes that some similar pair links.  ``own``: (node) of each row; ``signed``: its
        node and signatures, which are released."""
        members = self.members(signed)
        several = own.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("rows")).filter("rows > 1").select("node")
        self.items = chosen_sets(self.docs, self.text, self.n, key_filter(members.select("node").distinct()), key_filter(several))
        self.nodes, self.features = (x or 0 for x in self.items.agg(F.count("*"), F.sum("n")).first())

        def parts(of: DataFrame) -> list[DataFrame]:
            return dealt(of, min(PASSES, 1 + of.count() // MEMBERS_AT_ONCE), "sig")
        # what a few groups link need not be compared again in the others, and takes no room there
        few = F.pmod(F.xxhash64("sig", F.lit(1)), F.lit(8)) == 0
        for part in [members.filter(few), *parts(members.filter(~few))]:
            self.leaders(part)
        rest = reduce(DataFrame.unionByName, [self.tiles(part, SMALL_GROUP) for part in parts(members)]).distinct()
        release(members)
        if not rest.isEmpty():
            # groups larger than a tile that still hold several components: their nodes again, by the rarest features
            rare = materialize(one_of_each(rare_features(self.items.join(rest, "node", "left_semi"), self.threshold)), "join-rare")
            for part in parts(rare):
                self.leaders(part)
            for part in parts(rare):
                self.tiles(part)
            release(rare)
        release(self.items)
        if self.labels is None:
            return own.sparkSession.createDataFrame([], "node bigint, component bigint")
        return self.labels


def dealt(rows: DataFrame, parts: int, *by: str) -> list[DataFrame]:
    """The rows in so many parts by the hash of some columns."""
    return [rows.filter(F.pmod(F.xxhash64(*by), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [rows]


def one_of_each(members: DataFrame) -> DataFrame:
    """The (sig, node) of groups with several nodes; of groups of the same nodes, told by two 64-bit fingerprints, size and
    ends, the one of least sig: all of them would be compared alike.  Rows of the others pass a filter where they are."""
    group = members.repartition("sig").groupBy("sig").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("lo <> hi")
    least = materialize(group.groupBy("lo", "hi", "size", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "join-groups")
    chosen = key_filter(least)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe(chosen.value, b.column(0).to_numpy())))
    return members.select("sig", "node").mapInArrow(only, "sig bigint, node bigint").join(least, "sig", "left_semi")


def repeated(seen, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, node) of the signatures that may occur more than once."""
    for b in slices(batches):
        x = b.column(1).flatten().to_numpy()
        keep = maybe(seen.value, x & np.int64(COUNTED))
        at = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]), b.column(0).take(pa.array(at[keep]))], names=["sig", "node"])


def documents(docs: DataFrame, text: str, doc_id: str, n: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_shingles, node) of every row, and (node, component) of the nodes that have links."""
    signed = materialize(sets(docs, text, doc_id, n, threshold), "join-signed")
    own = materialize(signed.select("doc_id", "digest", "n_shingles", "node"), "join-own")
    # ``find`` releases the signatures when it has grouped them
    return own, Links(docs, text, n, threshold).find(own.select("node"), signed.filter("node IS NOT NULL"))


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = SHINGLE,
         threshold: int = THRESHOLD) -> DataFrame:
    """A row per row of ``docs``: its id as doc_id, n_shingles, and component_id, the smallest id reachable by
    links (the row's own id if nothing links)."""
    own, labels = documents(docs, text, doc_id, n, threshold)
    named = own.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")) \
        .join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "component").select("node", "component_id")
    return own.join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not a component's further members.

    A document is an id with a text (two texts of one id are two): of each component the one of least id stays (null
    ids last), of equal ids the one of least digest; rows that repeat it go.  Texts without words stay, once for each id and text.
    Only rows that go or repeat are looked up; the others pass a filter where they are, and their texts stay put."""
    own, labels = documents(docs, text, doc_id, n, threshold)
    each = own.groupBy("doc_id", "digest").agg(F.first("node").alias("node"), F.count("*").alias("rows"))
    each = each.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = each.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"))
    each = each.join(first, "component", "left").withColumn("stays", F.col("node").isNull() | (
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("digest").eqNullSafe(F.col("first.digest"))))
    asked = materialize(each.filter("NOT stays OR rows > 1").select(F.xxhash64("doc_id", "digest").alias("key"), "doc_id", "digest", "stays"), "join-asked")
    held = key_filter(asked.select("key"))
    rows = as_row(docs)
    at = F.xxhash64(f"{ROW}.`{doc_id}`", F.md5(f"{ROW}.`{text}`")).alias("key")

    def picked(found: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(maybe(held.value, b.column(0).to_numpy()) == found)).select([1])
        return rows.select(at, ROW).mapInArrow(pick, rows.schema).select(f"{ROW}.*")
    stay = asked.filter("stays").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    gone = asked.filter("NOT stays").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & F.md5(text).eqNullSafe(F.col("_digest"))
    looked = picked(True)
    once = looked.join(stay, same, "left_semi").dropDuplicates([doc_id, text])
    other = looked.join(gone, same, "left_anti").join(stay, same, "left_anti")          # let through by the filter, but not asked for
    return picked(False).unionByName(once).unionByName(other)
