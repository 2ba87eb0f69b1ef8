"""Fuzzy passages that repeat across documents, by chaining shared word k-mers.

* seeds: of every ``WINDOW`` neighbouring k-mers of words the one of least hash is
  a seed, so two texts that share K + WINDOW - 1 words in a row share a seed; and
  every k-mer of a hash in the least 1 / ``SHARE`` is one wherever it stands, so edits
  beside it do not move it.  Seeds of one document alone are left out by a broadcast bit filter of bounded
  size.
* matches: each seed of a document is joined with the seed's first place in the
  collection, so a seed that many documents hold gives one match for each, never
  a pair of each two.
* chains: the matches of a document with an earlier one are chained by position in
  both.  A match adds ``GAIN``; the words between two matches cost ``GAP`` each, on
  both sides.  The best predecessor is a prefix maximum of a Fenwick tree.
* alignment: between the matches of a chain, and outwards from its ends, the words
  of both documents are aligned with insertions and deletions, up to ``BAND`` more of
  one than of the other; runs of more than ``BREAK`` unmatched words end a piece, and
  a piece needs ``IDENTITY`` of its words matched; of one that has less, the runs that
  have it are taken.

Pieces that touch, of whichever earlier documents, make one passage; passages of
at least ``MIN_WORDS`` words are repeated, and ``remove`` cuts them from the later
document.  The first document keeps its text.

Cases: null or empty texts have no passages; passages repeated inside one document
alone do not count; rows of one id and different texts are documents of their own,
ordered by a hash of the text; rows equal in id and text are one document and do
not remove each other; null ids come first; other columns travel in a struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_row, key_filter, materialize, maybe, mix64, sized, window_min

K = 6                              # words of a k-mer
WINDOW = 10                        # neighbouring k-mers of which one is a seed
SHARE = 8                          # one of so many k-mers is a seed in any case
MIN_WORDS = 50                     # words of a repeated passage, at least
GAIN, GAP = 5.0, 0.1               # of a match; of a word between matches, on either side
BREAK = 8                          # unmatched words in a row inside a piece, at most
IDENTITY = 0.8                     # matched words of a piece, at least
DROP = 12                          # score lost at which an end is no longer extended
BAND = 16                          # words inserted or deleted in one extension, at most (net)
PAD = 400                          # words of the earlier document kept beyond a chain's ends
SOME_WORDS = 200_000               # words handled at once
SOME_ROWS = 256                    # rows with texts or chains taken out of a batch at once
_M = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_hashes(text: str | None) -> np.ndarray:
    """Fingerprints of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest
    words = (text or "").encode("utf-8").lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def seeds(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, seed) for some texts at a time."""
    held, size = [], 0
    for i, t in enumerate(texts):
        h = word_hashes(t)
        if len(h) >= K + WINDOW - 1:
            held.append((i, h))
            size += len(h)
        if size >= SOME_WORDS or (i == len(texts) - 1 and held):
            yield _seeds(held)
            held, size = [], 0


def _seeds(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = np.concatenate([x for _, x in held])
    length = np.asarray([len(x) for _, x in held])
    end = np.cumsum(length)
    kmer = np.full(len(h) - K + 1, np.uint64(K))
    for j in range(K):
        kmer = mix64(kmer * _M + h[j:len(h) - K + 1 + j])
    order = (kmer & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(kmer), dtype=np.uint64)
    least = (window_min(order, WINDOW) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    own = np.repeat(np.arange(len(held)), length)
    p = np.arange(len(least))
    low = np.flatnonzero(kmer < np.uint64((1 << 64) // SHARE))
    at = np.unique(np.concatenate([least[p + K + WINDOW - 1 <= end[own[:len(least)]]], low[low + K <= end[own[low]]]]))
    return np.asarray([i for i, _ in held])[own[at]], at - (end - length)[own[at]], kmer[at]


def seed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, n): documents of the batch with the seed."""
    for b in batches:
        got = [once_per_text(i, s) for i, _, s in seeds(b.column(0).to_pylist())]
        if got:
            k, n = np.unique(np.concatenate(got), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["seed", "n"])


def once_per_text(i: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Each text's distinct seeds."""
    order = np.lexsort((s, i))
    i, s = i[order], s[order]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (s[1:] != s[:-1])])
    return s[new].view(np.int64)


def shared_seeds(seen, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, at, s in seeds(b.column(2).to_pylist()):
            keep = maybe(seen.value, s)
            rows = pa.array(i[keep])
            yield pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), b.column(0).take(rows), b.column(1).take(rows),
                                              pa.array(at[keep].astype(np.int32))], names=["seed", "doc_id", "hash", "at"])


class PrefixMax:
    """Fenwick tree of the best (value, index) up to a rank."""

    def __init__(self, size: int):
        self.best = [(float("-inf"), -1)] * (size + 1)

    def put(self, rank: int, entry: tuple[float, int]) -> None:
        rank += 1
        while rank < len(self.best):
            if entry > self.best[rank]:
                self.best[rank] = entry
            rank += rank & -rank

    def upto(self, rank: int) -> tuple[float, int]:
        """Best entry of the ranks below ``rank``."""
        out = self.best[0]
        while rank > 0:
            if self.best[rank] > out:
                out = self.best[rank]
            rank -= rank & -rank
        return out


def chains(y: np.ndarray, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Disjoint chains of at least two matches, best first: positions in the document and in the earlier one.

    score(j) = GAIN + max(0, max over i before j in both of score(i) - GAP * (y_j - y_i + x_j - x_i)); the part
    of i is a prefix maximum by x, over matches in order of y."""
    order = np.lexsort((-x, y))                                   # of equal y, larger x first: they never chain
    y, x = y[order], x[order]
    rank = np.searchsorted(np.unique(x), x).tolist()
    tree = PrefixMax(max(rank) + 1)
    score, before = [], []
    for j, (a, b, r) in enumerate(zip(y.tolist(), x.tolist(), rank, strict=True)):
        value, i = tree.upto(r)
        gain = value - GAP * (a + b)
        score.append(GAIN + max(0.0, gain))
        before.append(i if gain > 0 else -1)
        tree.put(r, (score[j] + GAP * (a + b), j))
    out, used = [], [False] * len(score)
    for j in sorted(range(len(score)), key=lambda j: -score[j]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if len(chain) > 1:
            chain = np.asarray(chain[::-1])
            out.append((y[chain], x[chain]))
    return out


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of matches that come sorted by document and earlier document."""
    names = ["doc_id", "hash", "of_id", "of_hash"]

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [t[c].to_numpy() for c in names]
        y, x = t["at"].to_numpy(), t["of_at"].to_numpy()
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        cut = np.append(np.flatnonzero(new), len(y))
        rows = [(s, *(a.astype("<i4").tobytes() for a in c)) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
                if e - s > 1 for c in chains(y[s:e], x[s:e])]
        if rows:
            at, ys, xs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(k[list(at)]) for k in keys), pa.array(ys, pa.binary()), pa.array(xs, pa.binary())],
                                             names=[*names, "ys", "xs"])
    held = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held.num_rows >= 50_000:
            keys = [held[c].to_numpy() for c in names]
            same = np.all([k == k[-1] for k in keys], axis=0)
            first = held.num_rows - int(same[::-1].argmin()) if not same.all() else 0
            if first:
                yield from solve(held.slice(0, first))
                held = held.slice(first)
    if held is not None and held.num_rows:
        yield from solve(held)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SOME_ROWS rows, as a hot document's chains each carry its text."""
    for b in batches:
        for at in range(0, b.num_rows, SOME_ROWS):
            yield b.slice(at, SOME_ROWS)


def earlier_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chain with the earlier document's words around it (``first``: position of the first one)."""
    for b in sliced(batches):
        words, first, last_text, h = [], [], None, None
        for xs, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if text is not last_text and text != last_text:
                last_text, h = text, word_hashes(text)
            x = np.frombuffer(xs, "<i4")
            start = max(0, int(x[0]) - PAD)
            first.append(start)
            words.append(h[start:int(x[-1]) + K + PAD].tobytes())
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(first, pa.int64()), pa.array(words, pa.binary())],
                                         names=["doc_id", "hash", "ys", "xs", "first", "words"])


def paired(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words of ``a`` and ``b`` matched from their common start: furthest reaching points of each
    number of edits and diagonal, up to the best score; ends where all are DROP below it.  A match scores 1, a
    replaced word -2, an inserted or deleted one -2.5."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    run = int(differ[0]) if len(differ) else n                # the part without edits
    u, v = a[run:len(b) + BAND].tolist(), b[run:len(a) + BAND].tolist()
    nu, nv = len(u), len(v)
    best, end = 0.0, (0, 0)                                   # edits, diagonal
    rows = [{0: 0}]                                           # diagonal (i - j) -> i, for each number of edits
    while rows[-1] and (nu or nv):
        d, row = len(rows), {}
        last = rows[-1]
        for k in range(max(min(last) - 1, -BAND), min(max(last) + 1, BAND) + 1):
            i = max(last.get(k, -2) + 1, last.get(k - 1, -2) + 1, last.get(k + 1, -2))
            i = min(i, nu, nv + k)
            if i < 0 or i < k or i <= last.get(k, -1):
                continue
            while i < nu and i - k < nv and u[i] == v[i - k]:
                i += 1
            score = i - k / 2 - 3 * d
            if score > best - DROP:
                row[k] = i
                if score > best:
                    best, end = score, (d, k)
        rows.append(row)
    d, k = end
    i, pairs = rows[d][k], []
    while d:
        last = rows[d - 1]
        come, of = max((last.get(k, -2) + 1, k), (last.get(k - 1, -2) + 1, k - 1), (last.get(k + 1, -2), k + 1))
        pairs.extend((x, x - k) for x in range(i - 1, min(come, nu, nv + k) - 1, -1))
        i, k, d = last[of], of, d - 1
    pairs.extend((x, x) for x in range(i - 1, -1, -1))
    x, y = zip(*pairs[::-1], strict=True) if pairs else ((), ())
    first = np.arange(run)
    return np.concatenate([first, np.asarray(x, np.int64) + run]), np.concatenate([first, np.asarray(y, np.int64) + run])


def extend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matched flags of ``a`` against ``b`` from their common start, up to the last match."""
    at, _ = paired(a, b)
    out = np.zeros(int(at[-1]) + 1 if len(at) else 0, bool)
    out[at] = True
    return out


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matched flags of ``a`` against ``b``, in a longest common subsequence if both are short; else of what is
    matched from their common start and from their common end, as much as does not cross."""
    if len(a) == len(b):
        same = a == b
        if 2 * same.sum() >= len(a):
            return same
    out = np.zeros(len(a), bool)
    if len(a) > 64 or len(b) > 64:
        i, j = paired(a, b)
        x, y = paired(a[::-1], b[::-1])
        x, y = len(a) - 1 - x[::-1], len(b) - 1 - y[::-1]
        behind = np.append(0, np.maximum(np.searchsorted(x, i, "right"), np.searchsorted(y, j, "right")))
        m = int((np.arange(len(i) + 1) + len(x) - behind).argmax())
        out[i[:m]] = out[x[behind[m]:]] = True
        return out
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out[i] = True
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(own: np.ndarray, other: np.ndarray, first: int, ys: np.ndarray, xs: np.ndarray) -> tuple[int, np.ndarray]:
    """Start in the document, and matched flags from there, of a chain; ``other`` begins at word ``first``."""
    xs = xs - first
    left = extend(own[:ys[0]][::-1], other[:xs[0]][::-1])[::-1]
    parts, y, x = [left], int(ys[0]), int(xs[0])
    for a, b in zip(ys.tolist(), xs.tolist(), strict=True):
        if a > y or b > x:
            skip = min(y - a, x - b)                              # overlapping matches on two diagonals
            if skip > 0:
                continue
            if a < y or b < x:
                a, b = a + max(0, y - a, x - b), b + max(0, y - a, x - b)
            parts.append(between(own[y:a], other[x:b]))
            y, x = a, b
            end = min(K, len(own) - y, len(other) - x)
        else:
            end = K - (y - a)
        if end > 0:
            parts.append(own[y:y + end] == other[x:x + end])
            y, x = y + end, x + end
    parts.append(extend(own[y:], other[x:]))
    return int(ys[0]) - len(left), np.concatenate(parts)


def runs(matched: np.ndarray) -> list[tuple[int, int]]:
    """[start, stop) of the maximal runs of which IDENTITY is matched, and of their beginnings and ends too (Ruzzo and Tompa)."""
    total, held = 0.0, []                                     # start, stop, sums before and behind
    for at, m in enumerate(matched.tolist()):
        if not m:
            total -= IDENTITY
            continue
        own = [at, at + 1, total, total + 1 - IDENTITY]
        total = own[3]
        while True:
            j = next((j for j in range(len(held) - 1, -1, -1) if held[j][2] < own[2]), -1)
            if j < 0 or held[j][3] >= own[3]:
                break
            own[0], own[2] = held[j][0], held[j][2]
            del held[j:]
        held.append(own)
    return [(s, e) for s, e, *_ in held]


def pieces(start: int, matched: np.ndarray) -> list[tuple[int, int]]:
    """[start, stop) of the well matched pieces of an alignment."""
    at = np.flatnonzero(matched)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > BREAK + 1)
    out = []
    for s, e in zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + 1).tolist(), strict=True):
        part = matched[s:e]
        out += [(start + s + x, start + s + y) for x, y in ([(0, e - s)] if part.mean() >= IDENTITY else
                                                            [r for r in runs(part) if r[1] - r[0] >= K])]
    return out


def passages(own: np.ndarray, found: list[dict]) -> list[tuple[int, int]]:
    """Repeated passages of a document, [start, stop) in words."""
    spans = sorted(p for c in found for p in pieces(*aligned(
        own, np.frombuffer(c["words"], np.uint64), c["first"], np.frombuffer(c["ys"], "<i4"), np.frombuffer(c["xs"], "<i4"))))
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1] + 2:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s >= MIN_WORDS]


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` in ``_row`` with n_words, passages (word ranges and character ranges) and rest, the text without them."""
    spark = docs.sparkSession
    rows = as_row(docs)
    keyed = rows.select("_row", F.coalesce(F.col(f"_row.`{doc_id}`").cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"),
                        F.xxhash64(F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))).alias("hash"), F.col(f"_row.`{text}`").alias("text"))
    counts = keyed.select("text").mapInArrow(seed_counts, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    seen = key_filter(materialize(counts.filter("n > 1").select("seed"), "passage-seeds"))
    places = materialize(keyed.select("doc_id", "hash", "text").mapInArrow(
        lambda it: shared_seeds(seen, it), "seed bigint, doc_id bigint, hash bigint, at int"), "passage-places")
    first = places.groupBy("seed").agg(F.min(F.struct("doc_id", "hash", "at")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    match = places.join(first.select("seed", "f"), "seed").filter("NOT (doc_id = f.doc_id AND hash = f.hash)").select(
        "doc_id", "hash", F.col("f.doc_id").alias("of_id"), F.col("f.hash").alias("of_hash"), "at", F.col("f.at").alias("of_at"))
    names = ["doc_id", "hash", "of_id", "of_hash"]
    tasks = sized(spark, places.count(), 500_000)
    made = materialize(match.repartition(tasks, "doc_id", "hash").sortWithinPartitions(*names).mapInArrow(
        chained, "doc_id bigint, hash bigint, of_id bigint, of_hash bigint, ys binary, xs binary"), "passage-chains")
    chain = F.struct("ys", "xs", "first", "words")
    leaders = key_filter(made.select(F.xxhash64("of_id", "of_hash").alias("k")).distinct())

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = maybe(leaders.value, b.column(0).to_numpy())
            yield b.filter(pa.array(keep)).select(["of_id", "of_hash", "text"])
    texts = keyed.select(F.xxhash64("doc_id", "hash").alias("k"), F.col("doc_id").alias("of_id"), F.col("hash").alias("of_hash"), "text") \
        .mapInArrow(only, "of_id bigint, of_hash bigint, text string").dropDuplicates(["of_id", "of_hash"])
    found = made.join(texts, ["of_id", "of_hash"]).select("doc_id", "hash", "ys", "xs", "text") \
        .mapInArrow(earlier_words, "doc_id bigint, hash bigint, ys binary, xs binary, first bigint, words binary") \
        .groupBy("doc_id", "hash").agg(F.collect_list(chain).alias("chains"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n, spans, rest = [], [], []
            for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8")
                own, keep, at = [], [], 0
                if c:
                    words = [m.span() for m in WORD.finditer(raw)]
                    for s, e in passages(word_hashes(t), c):
                        a, z = words[s][0], words[e - 1][1]
                        own.append({"first_word": s, "n_words": e - s, "start": len(raw[:a].decode()), "stop": len(raw[:z].decode())})
                        keep.append(raw[at:a])
                        at = z
                n.append(len(raw.split()))
                spans.append(own)
                rest.append((b"".join(keep) + raw[at:]).decode() if own else t)
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("first_word", "n_words", "start", "stop")]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(rest, pa.string())],
                                             names=["_row", "n_words", "passages", "rest"])
    return keyed.join(found, ["doc_id", "hash"], "left").select("_row", "text", "chains").mapInArrow(decided, StructType(
        rows.schema.fields + StructType.fromDDL(
            "n_words bigint, passages array<struct<first_word:bigint,n_words:bigint,start:bigint,stop:bigint>>, rest string").fields))


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: str | None = None) -> DataFrame:
    """``docs`` without their repeated passages; a document of which no word is left goes, one without passages stays
    as it is.  A column ``length`` is lessened by the characters cut."""
    found = find(docs, text, doc_id).filter(r"size(passages) = 0 OR rest RLIKE '[^\\x20\\x09-\\x0D]'")
    cut = F.aggregate("passages", F.lit(0).cast("bigint"), lambda a, p: a + p["stop"] - p["start"])
    own = {text: F.col("rest")} | ({length: F.col(f"_row.`{length}`") - cut} if length else {})
    return found.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
