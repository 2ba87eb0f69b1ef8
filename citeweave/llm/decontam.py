"""Benchmark decontamination with an Aho-Corasick automaton.

Every benchmark item is normalised to its words; its windows of ``window``
consecutive words (or the whole item, if shorter) are the patterns.  One
automaton over all patterns scans each normalised document once; an
occurrence marks its words, and the marked words are mapped back to character
offsets of the original text.

The automaton travels as the items' texts, whose size is measured first: items
are dealt into shards of at most ``SHARD_CHARS`` characters, one automaton
each, and the documents are scanned shard after shard within one narrow job.
Real benchmarks fit one shard.  Documents are never shuffled, so hot sources
and groups of copies cost nothing extra.

Cases: null and empty texts have no words; an item without words has no
windows; items of one text all count; an empty benchmark leaves every document
clean; other columns travel in a struct and cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WINDOW = 10                    # words of a window, fixed by the contract
SHARD_CHARS = 1_000_000        # characters of benchmark text per automaton
# Words are the runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z (fixed by the contract):
# on UTF-8 bytes, digits, letters and every byte of a non-ASCII character.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BUILT: dict[str, object] = {}        # the last automaton of this worker


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def automaton(items: tuple[tuple[str, str], ...], window: int):
    """Pattern text -> (words, item ids); every pattern is framed by blanks, so
    occurrences start and end at word borders."""
    import ahocorasick

    found: dict[str, tuple[int, set]] = {}
    for item_id, text in items:
        w = words(text.encode("utf-8"))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            key = (b" " + b" ".join(w[i:i + n]) + b" ").decode("latin-1")
            found.setdefault(key, (n, set()))[1].add(item_id)
    a = ahocorasick.Automaton()
    for key, (n, ids) in found.items():
        a.add_word(key, (n, tuple(sorted(ids))))
    if found:
        a.make_automaton()
    return a if found else None


def built(items: tuple[tuple[str, str], ...], window: int):
    """``automaton``, kept for the next batch of this worker while the items are the same."""
    if _BUILT.get("of") != (items, window):
        _BUILT.clear()
        _BUILT.update(of=(items, window), automaton=automaton(items, window))
    return _BUILT["automaton"]


def occurrences(raw: bytes, a) -> tuple[int, list[tuple[int, int, tuple]]]:
    """Number of words, and (first word, last word, item ids) of each occurrence."""
    w = words(raw)
    if a is None or not w:
        return len(w), []
    flat = b" " + b" ".join(w) + b" "
    got = list(a.iter(flat.decode("latin-1")))
    if not got:
        return len(w), []
    blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    ends = np.searchsorted(blanks, [e for e, _ in got])          # blank k follows word k - 1
    return len(w), [(int(k) - n, int(k) - 1, ids) for k, (_, (n, ids)) in zip(ends, got, strict=True)]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [first, last] of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(s), int(e) - 1) for s, e in zip(edge[::2], edge[1::2], strict=True)]


def summary(raw: bytes, found: list[list[tuple[int, int, tuple]]], n_words: int) -> dict:
    """Marked words, items, and the marked passages as character offsets [start, end) of the original."""
    mark = np.zeros(n_words + 1, np.int64)
    items: set[str] = set()
    for first, last, ids in (x for y in found for x in y):
        mark[first] += 1
        mark[last + 1] -= 1
        items.update(ids)
    hit = np.cumsum(mark[:-1]) > 0
    spans = []
    if items:
        at = [m.span() for m in _WORD.finditer(raw)]
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        spans = [{"start": int(chars[at[s][0]]), "end": int(chars[at[e][1]])} for s, e in runs(hit)]
    return {"n_words": n_words, "n_hit": int(hit.sum()), "items": sorted(items), "spans": spans}


def shards(benchmark: DataFrame, shard_chars: int) -> list[tuple[tuple[str, str], ...]]:
    """The items in groups of bounded size, each read from the cluster on its own."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // shard_chars) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [tuple(map(tuple, items.filter(part == k).distinct().collect())) for k in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
         shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``docs`` in ``_row`` with n_words, n_hit, items (sorted ids) and spans (offsets of the original)."""
    spark = docs.sparkSession
    sent = [spark.sparkContext.broadcast(s) for s in shards(benchmark, shard_chars)]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            texts = [(t or "").encode("utf-8") for t in rows.field(names.index(text)).to_pylist()]
            found: list[list] = [[] for _ in texts]
            n_words = [0] * len(texts)
            for bc in sent:                                       # one automaton in memory at a time
                a = built(bc.value, window)
                for i, t in enumerate(texts):
                    n_words[i], x = occurrences(t, a)
                    found[i].append(x)
            out = [summary(t, f, n) for t, f, n in zip(texts, found, n_words, strict=True)]
            yield pa.RecordBatch.from_arrays([rows] + [pa.array([o[k] for o in out], kind) for k, kind in kinds.items()],
                                             names=["_row", *kinds])

    names = docs.columns
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()),
             "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    schema = StructType(df.schema.fields + StructType.fromDDL(
        "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>").fields)
    return df.mapInArrow(scanned, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window."""
    return scan(docs, benchmark, text).filter("n_hit = 0").select("_row.*")


