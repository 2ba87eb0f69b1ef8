"""Bulk-synchronous best-fit packing of token sequences.

A document is its token ids and an end id.  Longer ones than ``capacity`` are
cut so that only the first piece is shorter than the capacity; full pieces fill
a sequence each, the others are packed in rounds:

* sizes are cut into narrow ranges of about equal numbers of documents; a range
  that one size fills is dealt over several slots by the rank of a hash;
* each slot holds the documents of its range and the gaps dealt to it, both
  sorted by size, and sweeps downwards: every document takes its successor, the
  smallest gap that holds it, and the rest of that gap stays in the sweep.
  Where several documents want one gap the higher-ranked (larger, then smaller
  id) gets it, the next takes the next gap;
* after the sweeps, a table of one row per slot (documents left, gaps left,
  their sizes) decides how many of the gaps that are left, by rank, go to which
  slot of smaller documents, and how many new sequences each slot opens; gaps
  are updated and the next round begins.  Rounds end when no document is left.

Every round moves only (id, size) rows; the texts are read once.  The driver
sees one row per slot, of which there are ``slots``.

Cases: a null or empty text is one end id; repeated rows are packed one by one;
an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_count import byte_symbols
from .common import environment, materialize, sized

CAPACITY = 1024
END_ID = 2
DOCS_PER_SLOT = 50_000
PLACED, DOC, GAP, FRESH = 0, 1, 2, 3     # kinds of rows of a round; fresh gaps go to the range of their new size
MEMO_ENTRIES, MEMO_CHARS = 800_000, 64     # pre-tokens remembered per worker, and their length, at most
_LOADED: dict[str, Ids] = {}


class Ids(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit bytes, computed by the library's model when missing."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        environment()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.stand_in = self.tokenizer.model, byte_symbols()
        chars = [chr(c) for c in range(0x80, 0x180)]
        white = r"\t\n\x0b\x0c\r \x85\xa0"
        word = "A-Za-z" + "".join(c for c in chars if regex.match(r"\p{L}", c))
        num = "0-9" + "".join(c for c in chars if regex.match(r"\p{N}", c))
        # the file's pattern, for characters up to U+017F; other texts go to the library whole
        self.split = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{word}]+| ?[{num}]+| ?[^{white}{word}{num}]+"
                                rf"|[{white}]+(?![^{white}])|[{white}]+").findall
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.library = re.compile("|".join([r"[^\x00-ſ]", *special])).search

    def __missing__(self, piece: str) -> bytes:
        own = "".join(map(self.stand_in.__getitem__, piece.encode("utf-8")))
        ids = np.asarray([t.id for t in self.model.tokenize(own)], "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        whole = [t for t in texts if self.library(t)]
        by_library = iter(self.tokenizer.encode_batch(whole, add_special_tokens=False) if whole else ())
        return [np.asarray(next(by_library).ids, "<u4").tobytes() if self.library(t)
                else b"".join(map(self.__getitem__, self.split(t))) for t in texts]


def library(path: str) -> Ids:
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every piece."""
    tail = np.asarray([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    if with_ids:
        out["ids"] = pa.binary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(path)
        for batch in batches:
            at, rows = [], {k: [] for k in out}
            for i, b in enumerate(lib.ids([t or "" for t in batch.column(1).to_pylist()])):
                b += tail
                n = len(b) // 4
                first = (n - 1) % capacity + 1
                bounds = [0, *range(first, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    at.append(i)
                    own = b[4 * s:4 * e]
                    for key, v in zip(out, (k, s, e - s, zlib.crc32(own), own), strict=False):
                        rows[key].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(rows[k], t) for k, t in out.items()],
                names=["doc_id", *out])
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select("doc_id", text).mapInArrow(cut, schema)


def size_ranges(counts: dict[int, int], slots: int) -> list[tuple[int, int, int, int]]:
    """(low size, high size, first slot, number of slots), largest sizes first.  ``counts``: documents by size."""
    total, out, run = sum(counts.values()), [], []
    share = max(1, -(-total // slots))
    sizes = sorted(counts, reverse=True)
    for i, s in enumerate(sizes):
        run.append(s)
        n = sum(counts[x] for x in run)
        if n >= share or i == len(sizes) - 1 or counts[sizes[i + 1]] >= share:
            first = out[-1][2] + out[-1][3] if out else 0
            out.append((run[-1], run[0], first, max(1, n // share) if len(run) == 1 else 1))
            run = []
    return out


def sweep(sizes: list[int], gaps: list[tuple[int, int]]) -> tuple[list[int], list[int], dict[int, int]]:
    """Best fit of documents (sizes, descending) into ``gaps`` (sequence, gap): for each document the
    sequence or -1 and the gap it found, and the gaps afterwards."""
    held: dict[int, list[int]] = defaultdict(list)
    mask = 0                                          # bit s: some gap of size s is open
    for seq, gap in sorted(gaps, key=lambda x: -x[0]):
        held[gap].append(seq)
        mask |= 1 << gap
    took, found, rest = [], [], dict(gaps)
    for size in sizes:
        above = mask >> size
        if not above:
            took.append(-1)
            found.append(0)
            continue
        gap = size + (above & -above).bit_length() - 1
        seq = held[gap].pop()
        if not held[gap]:
            mask &= ~(1 << gap)
        if gap > size:
            held[gap - size].append(seq)
            mask |= 1 << (gap - size)
        rest[seq] = gap - size
        took.append(seq)
        found.append(gap)
    return took, found, rest


def deal(left: list[dict], capacity: int) -> tuple[dict, dict[int, int]]:
    """Who gets the gaps that are left: {slot: [(from rank, to rank, new slot)]}, and {slot: new sequences}.

    ``left``: a row per slot, largest sizes first: slot, docs, tokens and largest of the documents left, the
    gaps left of the slot's own sizes with their sum, and ``fresh``, the sum of those that go to the range of
    their new size first.  Gaps of larger sizes wait on a stack and go to the next smaller slots in need.
    New sequences are opened for the largest of the documents that no gap holds, as many as the tokens of
    all these fill beyond the fresh gaps (half of that after the first time, as what is opened leaves
    gaps again); the smaller ones wait for what those leave."""
    moves, stack, unmet = defaultdict(list), [], []
    for r in left:
        docs = r["docs"]
        while docs > 0 and stack:
            top = stack[-1]
            fit = max(1, int(top[3] // r["largest"]))  # documents of this slot that such a gap takes
            n = min(top[2] - top[1], -(-docs // fit))
            moves[top[0]].append((top[1], top[1] + n, r["slot"]))
            top[1] += n
            docs -= n * fit
            if top[1] == top[2]:
                stack.pop()
        if r["gaps"]:
            stack.append([r["slot"], 0, r["gaps"], r["gap_tokens"] / r["gaps"]])
        if docs > 0:
            unmet.append((r["slot"], docs, docs * r["tokens"] / r["docs"], max(1, capacity // r["largest"])))
    fresh = sum(r["fresh"] for r in left)
    started = any(r["gaps"] or r["fresh"] for r in left)
    budget = -int(-(sum(u[2] for u in unmet) - fresh) // (capacity * (2 if started else 1)))
    budget = max(budget, int(not moves and not fresh))
    opened = {}
    for slot, docs, _, fit in unmet:
        if budget > 0:
            opened[slot] = n = min(-(-docs // fit), budget)
            budget -= n
    return moves, opened


def pack(items: DataFrame, capacity: int = CAPACITY, slots: int | None = None) -> DataFrame:
    """Places of ``items`` (id bigint, size int, 1 to capacity): id, sequence_id, offset.

    A sequence's id is (round, slot, number), so no two slots or rounds open the same one."""
    spark = items.sparkSession
    items = materialize(items.select("id", F.col("size").cast("int").alias("size")), "pack-items")
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    n_docs = sum(counts.values())
    ranges = size_ranges(counts, slots or min(sized(spark, n_docs, DOCS_PER_SLOT), max(1, n_docs // 500)))
    lows = sorted((low, first, n) for low, _, first, n in ranges)
    last = max((f + n for _, f, n in lows), default=0)
    # the range of each size: the one with the largest lower bound up to it (capacity rows at most)
    home = F.broadcast(spark.createDataFrame(
        [(s, *max(x for x in lows if x[0] <= s)[1:]) for s in range(1, capacity + 1) if lows and s >= lows[0][0]],
        "size int, first int, n int"))
    slot = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))).cast("int").alias("slot")
    todo = items.join(home, "size").select(slot, F.lit(DOC).alias("kind"), "id", "size")
    placed, opened, turn = [], {}, 0
    while n_docs:
        done = materialize(todo.groupBy("slot").applyInPandas(
            sweeper(turn, opened, lows, capacity), "slot int, kind int, id bigint, size int, rank int, seq bigint, at bigint"),
            f"pack-{turn}")
        placed.append(done.filter(F.col("kind") == PLACED).select("id", F.col("seq").alias("sequence_id"), F.col("at").alias("offset")))
        total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("size"))), F.lit(0))
        left = {r["slot"]: r.asDict() for r in done.filter(F.col("kind") != PLACED).groupBy("slot").agg(
            F.count(F.when(F.col("kind") == DOC, 1)).alias("docs"), total(DOC).alias("tokens"),
            F.coalesce(F.max(F.when(F.col("kind") == DOC, F.col("size"))), F.lit(1)).alias("largest"),
            F.count(F.when(F.col("kind") == GAP, 1)).alias("gaps"), total(GAP).alias("gap_tokens"),
            total(FRESH).alias("fresh")).collect()}                                      # a row per slot
        n_docs = sum(r["docs"] for r in left.values())
        if n_docs:
            moves, opened = deal([left[s] for s in range(last) if s in left], capacity)
            sent = spark.createDataFrame([(s, a, b, t) for s, m in moves.items() for a, b, t in m],
                                         "slot int, a int, b int, to int")
            moved = done.filter(F.col("kind") == GAP).join(F.broadcast(sent), "slot").filter("rank >= a AND rank < b") \
                .select(F.col("to").alias("slot"), F.lit(GAP).alias("kind"), "id", "size")
            stay = done.filter(F.col("kind") == GAP).join(F.broadcast(sent.groupBy("slot").agg(F.max("b").alias("b"))), "slot", "left") \
                .filter("b IS NULL OR rank >= b").select("slot", "kind", "id", "size")
            fresh = done.filter(F.col("kind") == FRESH).join(home, "size").select(slot, F.lit(GAP).alias("kind"), "id", "size")
            todo = done.filter(F.col("kind") == DOC).select("slot", "kind", "id", "size") \
                .unionByName(moved).unionByName(stay).unionByName(fresh)
            idle = set(opened) - {s for s, r in left.items() if r["docs"]}
            assert not idle
        turn += 1
    out = items.sparkSession.createDataFrame([], "id bigint, sequence_id bigint, offset bigint")
    for p in placed:
        out = out.unionByName(p)
    return out


def sweeper(turn: int, opened: dict[int, int], lows: list[tuple[int, int, int]], capacity: int):
    """The sweep of one slot: its documents placed or left, its gaps left in or outside its own range."""
    def swept(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        slot = int(key[0])
        own, above = max((x for x in lows if x[1] <= slot), key=lambda x: x[1]), capacity + 1
        for low, _, _ in reversed(lows):
            if low > own[0]:
                above = low                              # the next range's lower bound
        docs = d[d["kind"] == DOC].sort_values(["size", "id"], ascending=[False, True])
        gaps = list(d.loc[d["kind"] == GAP, ["id", "size"]].itertuples(index=False, name=None))
        gaps += [((turn << 44) + (slot << 24) + k, capacity) for k in range(opened.get(slot, 0))]
        took, found, rest = sweep(docs["size"].tolist(), gaps)
        took, sizes = np.asarray(took, np.int64), np.asarray(docs["size"], np.int64)
        a = pd.DataFrame({"slot": slot, "kind": np.where(took < 0, DOC, PLACED), "id": docs["id"].to_numpy(), "size": sizes,
                          "rank": 0, "seq": took, "at": capacity - np.asarray(found, np.int64)})
        open_ = sorted((g, s) for s, g in rest.items() if g >= lows[0][0])   # smaller ones hold no document
        g = np.asarray([x[0] for x in open_], np.int64)
        homed = (g >= own[0]) & (g < above)
        b = pd.DataFrame({"slot": slot, "kind": np.where(homed, GAP, FRESH), "id": np.asarray([x[1] for x in open_], np.int64),
                          "size": g, "rank": np.cumsum(homed) - 1, "seq": 0, "at": 0})
        return pd.concat([a, b]) if len(b) else a
    return swept


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its place: the columns of ``pieces``, sequence_id and offset.

    Pieces are numbered by (partition, position) of a written table, so repeated ids stay apart."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, capacity, end_id, text, with_ids)
                      .withColumn("key", F.monotonically_increasing_id()), "pack-pieces")
    full = cut.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.col("key"), "offset": F.lit(0).cast("bigint")})
    places = pack(cut.filter(F.col("length") < capacity).select(F.col("key").alias("id"), F.col("length").alias("size")), capacity)
    rest = cut.filter(F.col("length") < capacity).join(places.withColumnRenamed("id", "key"), "key")
    return full.unionByName(rest.select(full.columns)).drop("key")
