"""Exact substring dedup by externally sorted, induced suffixes.

A byte goes if it lies in a ``LENGTH``-byte string that also starts earlier in the
collection.  Equal strings are found as equal prefixes of sorted suffixes:

* sample: of the K-byte grams of every string of LENGTH bytes the one of least
  hash is its anchor, so equal strings have equal anchors at equal distances.
  Strings with one anchor follow each other; such a run is one row, about
  LENGTH + 39 bytes, instead of 39 suffixes.  Runs whose anchor gram occurs once
  in the collection are left out by a broadcast bit filter of bounded size.
* external sort: Spark's disk-backed sorter deals the runs out by anchor gram and
  brings them in order; a task takes whole groups of bounded total size.  There
  the suffixes at the anchors are ranked with their common prefixes, and the
  parts before the anchors likewise, read backwards.
* induction: a string that starts t bytes before its anchor equals another one
  where the anchors' common prefix is at least LENGTH - t and t bytes before
  them agree.  For t = 0, 1, 2, ... both classes follow from the ranks and
  common prefixes at hand, so no other suffix is ever sorted; the first start of
  each class stays and the others are marked.
* equal runs of one batch are marked at once but for the first; a group beyond
  ``GROUP_ROWS`` different runs (a very common gram) is taken apart into its
  strings, which are compared by 128-bit fingerprints with a grouped minimum.

Every step is exact but for the fingerprints of those oversized groups.

Cases: a null or empty text has no bytes; texts under LENGTH bytes lose nothing;
rows of one id and different texts are documents of their own, ordered by a hash
of the text; rows equal in id and text are one document, reported once per row;
null ids come first; long texts are cut into overlapping segments; other columns
travel in a struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_row, key_filter, materialize, maybe, mix64, sized, window_min

LENGTH = 100                       # bytes, fixed by the contract of op9
GRAM = 24                          # bytes of an anchor gram
SEGMENT = 1 << 20                  # bytes handled at once
GROUP_ROWS = 150_000               # different runs of one gram compared in one task
CHUNK_ROWS = 50_000                # runs of whole groups compared at once
_B = np.uint64(0x9E3779B97F4A7C15)
RUN = "kind int, gram bigint, doc_id bigint, hash bigint, start bigint, off int, n int, bytes binary"
MARK = "kind int, doc_id bigint, hash bigint, start bigint, stop bigint, g1 bigint, g2 bigint"


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Polynomial hash of the 24 bytes from each position, by doubling."""
    x, base, at = b.astype(np.uint64) + np.uint64(1), _B, {}
    for span in (1, 2, 4, 8):
        x = x[:len(x) - span] * base + x[span:]
        base = base * base
        at[2 * span] = (x, base)
    x8, base8 = at[8]
    x16 = at[16][0]
    return x16[:len(x16) - 8] * base8 + x8[16:]


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, number of strings, offset of the anchor, gram) of the runs, for some texts at a time."""
    with np.errstate(over="ignore"):
        todo, size = [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t) - LENGTH + 1, SEGMENT):
                piece = t[at:at + SEGMENT + LENGTH - 1]
                todo.append((i, at, piece))
                size += len(piece)
                if size >= SEGMENT:
                    yield _runs(todo)
                    todo, size = [], 0
        if todo:
            yield _runs(todo)


def _runs(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    flat = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    length = np.asarray([len(p) for _, _, p in pieces])
    end = np.cumsum(length)
    h = gram_hashes(flat)
    order = (mix64(h) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = (window_min(order, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    p = np.arange(len(anchor))
    piece = np.repeat(np.arange(len(pieces)), length)[:len(anchor)]
    ok = p + LENGTH <= end[piece]                              # strings that stay inside their text
    p, anchor, piece = p[ok], anchor[ok], piece[ok]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)]))
    n = np.diff(np.concatenate([first, [len(p)]]))
    own = piece[first]
    text = np.asarray([i for i, _, _ in pieces])[own]
    start = p[first] - (end - length)[own] + np.asarray([a for _, a, _ in pieces])[own]
    return text, start, n, anchor[first] - p[first], mix64(h[anchor[first]])


def raw_texts(column) -> list[bytes]:
    return [(t or "").encode("utf-8") if not isinstance(t, bytes) else t for t in column.to_pylist()]


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [g for *_, g in runs(raw_texts(b.column(0)))]
        if got:
            k, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["gram", "n"])


def repeated_runs(seen, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of grams that may repeat (kind 0), one of each batch's equal ones, and the extents that the others cover
    (kind 1, as few rows as there are gaps between them, dealt out by document)."""
    for b in batches:
        ids, hashes, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), raw_texts(b.column(2))
        first: dict[bytes, tuple] = {}
        again: dict[tuple, list] = {}
        for found in runs(texts):
            keep = maybe(seen.value, found[4])
            for i, start, n, off, gram in zip(*(x[keep].tolist() for x in (*found[:4], found[4].view(np.int64))), strict=True):
                own = texts[i][start:start + n + LENGTH - 1]
                new = (ids[i], hashes[i], start, gram, off, n)
                old = first.get(own)
                if old is None or new < old:
                    first[own], new = new, old
                if new is not None and new[:3] != first[own][:3]:
                    again.setdefault(new[:2], []).append((new[2], new[2] + new[5] + LENGTH - 1))
        out = [(1, h ^ s, d, h, s, 0, e - s - LENGTH + 1, None) for (d, h), x in again.items() for s, e in merged(x)]
        out += [(0, g, d, h, s, off, n, own) for own, (d, h, s, g, off, n) in first.items()]
        for at in range(0, len(out), 20_000):
            part = out[at:at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (
                pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                names=["kind", "gram", "doc_id", "hash", "start", "off", "n", "bytes"])


def ranked(strings: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups, and each one's common prefix with the one before it (-1 at a
    group's first)."""
    length = np.asarray([len(x) for x in strings])
    padded = -(-width // 8) * 8
    m = np.frombuffer(b"".join(x.ljust(padded, b"\0") for x in strings), np.uint8).reshape(-1, padded)
    words = np.ascontiguousarray(m).view(">u8")
    order = np.lexsort((length, *(words[:, j] for j in range(words.shape[1] - 1, -1, -1)), group))
    a, b = m[order[:-1]], m[order[1:]]
    differ = a != b
    common = np.where(differ.any(1), differ.argmax(1), padded)
    common = np.minimum(common, np.minimum(length[order[:-1]], length[order[1:]]))
    common = np.where(group[order[:-1]] == group[order[1:]], common, -1)
    return order, np.concatenate([[-1], common])


def induced(gram: np.ndarray, rank: np.ndarray, off: np.ndarray, n: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last string of each run that has an equal one of lower ``rank`` (last < first: none)."""
    turn = np.argsort(rank, kind="stable")
    size = len(strings)
    right, right_common = ranked([x[o:] for x, o in zip(strings, off.tolist(), strict=True)], gram, LENGTH)
    left, left_common = ranked([x[:o][::-1] for x, o in zip(strings, off.tolist(), strict=True)], gram, LENGTH)
    low, high = np.full(size, LENGTH), np.full(size, -1)
    r_class, l_class = np.empty(size, np.int64), np.empty(size, np.int64)
    for t in range(int(off.max()) + 1):
        there = turn[(off[turn] - n[turn] < t) & (t <= off[turn])]      # runs with a string t bytes before the anchor
        if len(there) > 1:
            r_class[right] = np.cumsum(right_common < LENGTH - t)
            l_class[left] = np.cumsum(left_common < t)
            key = r_class[there] * (size + 1) + l_class[there]
            order = np.argsort(key, kind="stable")
            again = there[order[1:][key[order[1:]] == key[order[:-1]]]]
            at = off[again] - t
            low[again] = np.minimum(low[again], at)
            high[again] = np.maximum(high[again], at)
    return low, high


def compare(group_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked extents (kind 1) of runs sorted by gram, and the strings of oversized groups (kind 2)."""
    from xxhash import xxh3_128_digest

    names = ["kind", "doc_id", "hash", "start", "stop", "g1", "g2"]

    def batch(kind, doc_id, h, start, stop, g1=None, g2=None):
        k = len(start)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), *(pa.array(x, pa.int64()) for x in (doc_id, h, start, stop)),
                                           pa.array([None] * k if g1 is None else g1, pa.int64()),
                                           pa.array([None] * k if g2 is None else g2, pa.int64())], names=names)

    def apart(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, rows.num_rows, 1000):
            part = rows.slice(at, 1000)
            d, h, s, n = (part[c].to_numpy() for c in ("doc_id", "hash", "start", "n"))
            g = np.frombuffer(b"".join(xxh3_128_digest(x[j:j + LENGTH]) for x, k in zip(part["bytes"].to_pylist(), n.tolist(), strict=True)
                                       for j in range(k)), ">i8").astype(np.int64)
            start = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield batch(2, np.repeat(d, n), np.repeat(h, n), start, start + LENGTH, g[::2], g[1::2])

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows > 1:
            gram, d, h, s, off, n = (rows[c].to_numpy() for c in ("gram", "doc_id", "hash", "start", "off", "n"))
            rank = np.empty(len(gram), np.int64)
            rank[np.lexsort((s + off, h, d))] = np.arange(len(gram))
            low, high = induced(gram, rank, off.astype(np.int64), n.astype(np.int64), rows["bytes"].to_pylist())
            m = high >= 0
            yield batch(1, d[m], h[m], s[m] + low[m], s[m] + high[m] + LENGTH)

    held, big = None, None                                        # runs not yet compared; the gram being taken apart
    for b in batches:
        t = pa.Table.from_batches([b])
        kind = t["kind"].to_numpy()
        if (kind == 1).any():
            m = t.filter(pa.array(kind == 1))
            yield batch(1, m["doc_id"], m["hash"], m["start"], m["start"].to_numpy() + m["n"].to_numpy() + LENGTH - 1)
        t = t.filter(pa.array(kind == 0))
        if big is not None:
            own = t["gram"].to_numpy() == big
            yield from apart(t.filter(pa.array(own)))
            t = t.filter(pa.array(~own))
            big = None if t.num_rows else big
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= CHUNK_ROWS or held.num_rows > group_rows:
            gram = held["gram"].to_numpy()
            first = int(np.searchsorted(gram, gram[-1]))          # whole groups but for the last
            yield from split_large(held.slice(0, first), group_rows, solve, apart)
            held = held.slice(first)
            if held.num_rows > group_rows:
                big = held["gram"][0].as_py()
                yield from apart(held)
                held = None
    if held is not None:
        yield from split_large(held, group_rows, solve, apart)


def split_large(rows: pa.Table, group_rows: int, solve, apart) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    gram = rows["gram"].to_numpy()
    _, at, n = np.unique(gram, return_index=True, return_counts=True)
    large = np.repeat(n > group_rows, n)
    if large.any():
        yield from apart(rows.filter(pa.array(large)))
        rows = rows.filter(pa.array(~large))
    yield from solve(rows.combine_chunks())


def marks(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Marked extents (doc_id, hash, start, stop) of ``docs`` (doc_id bigint not null, hash, text); they overlap."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(gram_counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    seen = key_filter(materialize(counts.filter("n > 1").select("gram"), "suffix-grams"))
    found = docs.select("doc_id", "hash", "text").mapInArrow(lambda it: repeated_runs(seen, it), RUN)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = sized(spark, size, 16 << 20)
    done = materialize(found.repartition(tasks, "gram").sortWithinPartitions("gram")
                       .mapInArrow(lambda it: compare(group_rows, it), MARK), "suffix-marks")
    own = done.filter("kind = 1").select("doc_id", "hash", "start", "stop")
    apart = done.filter("kind = 2")
    if apart.isEmpty():
        return own
    at = F.struct("doc_id", "hash", "start")
    first = apart.groupBy("g1", "g2").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return own.unionByName(apart.join(first, ["g1", "g2"]).filter(at > F.col("first")).select("doc_id", "hash", "start", "stop"))


def merged(extents) -> list[tuple[int, int]]:
    """Union of (start, stop), as maximal runs."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(extents):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` in ``_row`` with n_bytes, n_removed, spans (removed byte ranges), kept (the other bytes) and kept_sha256."""
    rows = as_row(docs)
    t = F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))
    keyed = rows.select("_row", F.coalesce(F.col(f"_row.`{doc_id}`").cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"),
                        F.xxhash64(t).alias("hash"), t.alias("text"))
    extents = marks(keyed.select("doc_id", "hash", "text"), group_rows).groupBy("doc_id", "hash").agg(
        F.collect_set(F.struct("start", "stop")).alias("extents"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept, n = [], [], []
            for x, found in zip(raw_texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                own = merged((e["start"], e["stop"]) for e in found or ())
                edges = [0, *(y for s in own for y in s), len(x)]
                kept.append(b"".join(x[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)) if own else x)
                spans.append([{"start": s, "stop": e} for s, e in own])
                n.append(len(x))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(n, pa.int64()), pa.array([a - len(k) for a, k in zip(n, kept, strict=True)], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                names=["_row", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])
    return keyed.join(extents, ["doc_id", "hash"], "left").select("_row", "text", "extents").mapInArrow(
        cut, StructType(rows.schema.fields + StructType.fromDDL(
            "n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary, kept_sha256 string").fields))
