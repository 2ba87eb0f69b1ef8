"""N-gram language-model scores from a log-frequency Bloom filter.

Training counts every token and every pair of neighbouring tokens (a text is its
words and one end token; the end token is also the context of a first word).
Tokens are known by 64-bit fingerprints.  A pair's count c is quantised to the
level 1 + floor(log2 c), and the pair enters the filter once for each level up
to its own; a query probes level after level until one is missing, and takes
2^(level - 1) as the count.  Filter errors only ever raise a level, by chance of
about ``2^-PROBES`` a probe.  Probabilities are smoothed with a Dirichlet prior

    P(w | h) = (count(h, w) + MU * P1(w)) / (c(h) + MU),   P1(w) = (c(w) + 1) / (N + V + 1)

Scale: workers count a batch of texts at a time and send one block of keys per
shard of the key space, so a frequent word is one entry per batch; each shard is
merged, and its part of the filter built, in one task of bounded size.  The
filter and the token counts are broadcast if they measure at most
``max_broadcast`` bytes; beyond that they stay where they are, and each group of
texts sends its distinct keys to their shards and gets the token counts and the
levels probed there in return (``sharded_scores``).  Neighbouring shards answer
together, all groups at once, so that the work follows the keys and not the number
of groups times that of shards.  Both ask the same filter.

Cases: a null or empty text has the end token alone; a null id counts as an
empty one for the training split; every row is scored by itself; an empty
training set gives counts of zero; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import release
from .common import as_row, materialize, mix64

MU = 20.0                        # weight of the prior, in tokens
PROBES, BITS = 5, 8              # probes, and bits of the filter per entry
SOME_TOKENS, SOME_CHARS = 200_000, 2_000_000    # held as separate words, and scored, at once
GROUP_CHARS = 8_000_000          # of texts that ask the shards together
JOINT_SHARDS = 4                 # neighbouring shards that answer together
SHARD_TOKENS = 1_000_000         # tokens of text per shard of the key space, at most
MAX_BROADCAST = 512 << 20        # bytes
HELD = 2                         # remainder mod 7 of held-out ids, fixed by the contract of op10
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == HELD


def end_key() -> int:
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(b"\n")                        # no word holds white space


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all tokens of the texts (A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, then the end), and
    the position behind each text's end token."""
    from xxhash import xxh3_64_intdigest

    flat, parts, ends, n = [], [np.empty(0, np.uint64)], [], 0
    for t in texts:
        if t:
            flat.extend(t.encode("utf-8").lower().split())
        flat.append(b"\n")
        ends.append(n + len(flat))
        if len(flat) >= SOME_TOKENS or len(ends) == len(texts):
            n += len(flat)
            parts.append(np.fromiter(map(xxh3_64_intdigest, flat), np.uint64, len(flat)))
            flat = []
    return np.concatenate(parts), np.asarray(ends, np.int64)


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in groups of about SOME_CHARS characters, or of one longer text."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= SOME_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_keys(t: np.ndarray) -> np.ndarray:
    return t & ~_ONE                                       # even


def pair_keys(t: np.ndarray) -> np.ndarray:
    """Key of (previous token, token) for each token; a text follows an end token."""
    before = np.concatenate([np.asarray([end_key()], np.uint64), t[:-1]])
    return mix64(before * _PAIR + t) | _ONE                # odd


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def counted(train: DataFrame, text: str, shards: int) -> DataFrame:
    """(shard, keys, counts): sorted distinct keys of words and pairs of each batch, by shard."""
    shift = np.uint64(64 - (shards - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, _ = tokens(b.column(0).to_pylist())
            keys, n = np.unique(np.concatenate([word_keys(t), pair_keys(t)]), return_counts=True)
            shard = (keys >> shift).astype(np.int64)
            cut = np.searchsorted(shard, np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cut))
            n = n.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array(full.astype(np.int32)), pa.array([keys[cut[s]:cut[s + 1]].tobytes() for s in full], pa.binary()),
                pa.array([n[cut[s]:cut[s + 1]].tobytes() for s in full], pa.binary())], names=["shard", "keys", "counts"])
    return train.select(text).mapInArrow(count, "shard int, keys binary, counts binary")


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, counts) over all blocks of a partition that holds its shards whole."""
    held: dict[int, list] = {}
    for b in batches:
        for s, k, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            held.setdefault(s, []).append((np.frombuffer(k, "<u8"), np.frombuffer(n, "<u4")))
    for s in sorted(held):
        blocks = held.pop(s)
        yield s, *summed(np.concatenate([k for k, _ in blocks]), np.concatenate([n for _, n in blocks]).astype(np.uint64))


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]          # 1 + floor(log2 c)


def places(keys: np.ndarray, level: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit positions of (key, level) in a filter of ``size`` bits, one array per probe."""
    x = mix64(keys + np.uint64(level * int(_PAIR) & (1 << 64) - 1))
    step = (mix64(x ^ _PAIR) >> np.uint64(32)) | _ONE
    x >>= np.uint64(32)
    for i in range(PROBES):
        yield ((x + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) % np.asarray(size, np.uint64)


def build(bits_per_entry: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's words with their counts, and its filter of pairs."""
    for shard, keys, n in merged(batches):
        word = keys & _ONE == 0
        pairs, lv = keys[~word], levels(n[~word])
        size = -(-max(1, bits_per_entry * int(lv.sum())) // 64) * 64
        bits = np.zeros(size, bool)
        for level in range(1, int(lv.max(initial=0)) + 1):
            for at in places(pairs[lv >= level], level, size):
                bits[at.astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([keys[word].tobytes()], pa.binary()),
            pa.array([n[word].astype("<u8").tobytes()], pa.binary()),
            pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
            pa.array([int(word.sum())], pa.int64()), pa.array([int(n[word].sum())], pa.int64())],
            names=["shard", "words", "counts", "bits", "n_words", "n_tokens"])


def probed(keys: np.ndarray, bits: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Levels of pairs, by probing level after level; each key's filter is the ``size`` bits from ``start``."""
    out = np.zeros(len(keys), np.uint8)
    alive, level = np.flatnonzero(size), 0
    while len(alive):
        level += 1
        there = np.ones(len(alive), bool)
        for at in places(keys[alive], level, size[alive]):
            at = start[alive] + at.astype(np.int64)
            there &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        alive = alive[there]
        out[alive] = level
    return out


def quantised(lv: np.ndarray) -> np.ndarray:
    return np.where(lv > 0, 2.0 ** (lv.astype(np.float64) - 1), 0.0)


def found(words: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts of the keys among sorted ``words``."""
    if not len(words):
        return np.zeros(len(keys), counts.dtype)
    at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
    return np.where(words[at] == keys, counts[at], 0)


class Model:
    """Token counts and the filter, filled in shard by shard."""

    def __init__(self, shards: int, words: int, tokens: int, bits: dict[int, int]):
        """``bits``: bytes of the filter of each shard."""
        self.shift = np.uint64(64 - (shards - 1).bit_length())
        self.n, self.v = tokens, words
        self.words, self.counts = np.empty(words, np.uint64), np.empty(words, np.uint32 if tokens < 1 << 32 else np.uint64)
        size = np.zeros(shards, np.int64)
        for shard, n in bits.items():
            size[shard] = 8 * n
        self.size, self.start = size, np.concatenate([[0], np.cumsum(size)[:-1]])
        self.bits = np.empty(int(size.sum()) // 8, np.uint8)

    def put(self, at: int, shard: int, words: bytes, counts: bytes, bits: bytes) -> None:
        """A shard's words, the first of which is the ``at``-th, and its filter."""
        k = np.frombuffer(words, "<u8")
        self.words[at:at + len(k)], self.counts[at:at + len(k)] = k, np.frombuffer(counts, "<u8")
        first = int(self.start[shard]) // 8
        self.bits[first:first + len(bits)] = np.frombuffer(bits, np.uint8)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts of words."""
        return found(self.words, self.counts, keys).astype(np.float64)

    def pair_count(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts of pairs."""
        shard = (keys >> self.shift).astype(np.int64)
        return quantised(probed(keys, self.bits, self.start[shard], self.size[shard]))


class Answers:
    """What the shards say of a group of texts: counts of its sorted words, levels of its sorted pairs."""

    def __init__(self, n: int, v: int, counts: np.ndarray, lv: np.ndarray):
        self.n, self.v, self.counts, self.lv = n, v, counts, lv

    def count(self, keys: np.ndarray) -> np.ndarray:
        return fitting(self.counts, keys).astype(np.float64)

    def pair_count(self, keys: np.ndarray) -> np.ndarray:
        return quantised(fitting(self.lv, keys))


def fitting(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if len(values) != len(keys):
        raise ValueError("the shards' answers do not fit the texts")
    return values


def log_sums(t: np.ndarray, ends: np.ndarray, model: Model) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    words, at = np.unique(word_keys(t), return_inverse=True)
    c = model.count(words)[at]
    pairs, at = np.unique(pair_keys(t), return_inverse=True)
    both = model.pair_count(pairs)[at]
    context = np.concatenate([c[ends[0] - 1:ends[0]], c[:-1]])          # an end token is the first word's
    p1 = (c + 1) / (model.n + model.v + 1)
    starts = np.concatenate([[0], ends[:-1]])
    log_p = np.log10((np.minimum(both, context) + MU * p1) / (context + MU))
    return [ends - starts, np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(np.log10(p1), starts),
            np.add.reduceat(log_p, starts)]


RESULT = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def filter_scores(docs: DataFrame, text: str, model) -> DataFrame:
    df = as_row(docs)
    at = docs.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            if b.num_rows:
                sums = [log_sums(*tokens(g), m) for g in groups(b.column(0).field(at).to_pylist())]
                n, known, base, score = (np.concatenate(x) for x in zip(*sums, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), m.n, np.int64)), pa.array(base),
                     pa.array(score)], names=["_row", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return df.mapInArrow(scored, StructType(df.schema.fields + StructType.fromDDL(RESULT).fields))


def own_keys(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of the words and of the pairs of the tokens."""
    return np.unique(word_keys(t)), np.unique(pair_keys(t))


def blocks_of(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of ``values`` as binary values, cut at ``edges``."""
    at = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def answers_of(raw: list[bytes], part: pa.Table, first: int, joint: int, shift: np.uint64, kind: str) -> tuple[pa.Array, pa.Array]:
    """Counts and levels for blocks of keys of the ``joint`` shards from ``first``: a key is looked up once, however
    many blocks hold it."""
    part = part.sort_by("shard")
    words, counts, bits = (np.frombuffer(b"".join(part[c].to_pylist()), k) for c, k in (("words", "<u8"), ("counts", "<u8"), ("bits", np.uint8)))
    size = np.zeros(joint, np.int64)
    size[part["shard"].to_numpy() - first] = [8 * len(x) for x in part["bits"].to_pylist()]
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    keys, at = np.unique(np.frombuffer(b"".join(raw), "<u8"), return_inverse=True)
    word = keys & _ONE == 0
    said = np.zeros(len(keys), np.uint64)
    said[word] = found(words, counts, keys[word])
    pairs = keys[~word]
    shard = (pairs >> shift).astype(np.int64) - first
    said[~word] = probed(pairs, bits, start[shard], size[shard])
    said, word = said[at], word[at]
    edges = np.cumsum([0, *(len(x) // 8 for x in raw)])
    words_before = np.concatenate([[0], np.cumsum(word)])[edges]
    return blocks_of(said[word].astype(kind), words_before), blocks_of(said[~word].astype(np.uint8), edges - words_before)


def sharded_scores(docs: DataFrame, text: str, parts: DataFrame, shards: int, n: int, v: int) -> DataFrame:
    """The same scores where the model is too large to send: the keys of each group of texts go to their shards,
    a block for each JOINT_SHARDS neighbours, and their counts and levels come back in the order of the keys."""
    at, bits, joint = docs.columns.index(text), (shards - 1).bit_length(), min(JOINT_SHARDS, shards)
    shift, slots = np.uint64(64 - bits), shards // joint
    slot_shift = np.uint64(64 - bits + joint.bit_length() - 1)
    kind = "<u4" if n < 1 << 32 else "<u8"
    rows = as_row(docs).withColumn("_key", F.monotonically_increasing_id())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = size = 0
        for b in batches:
            out = []
            for k, t in zip(b.column(1).to_pylist(), b.column(0).field(at).to_pylist(), strict=True):
                if not size:
                    group = k                              # the first row's key
                out.append(group)
                size += len(t or "") + 64
                size = size if size < GROUP_CHARS else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["_row", "_key", "_group"])
    rows = materialize(rows.mapInArrow(dealt, StructType(rows.schema.fields + StructType.fromDDL("_group bigint").fields)), "lm-rows")

    # files may be read in pieces: a group asks once for each run of its rows that comes at once, named by its first row
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, row, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                keys = np.sort(np.concatenate(own_keys(tokens(texts[s:e])[0])))
                edge = np.searchsorted((keys >> slot_shift).astype(np.int64), np.arange(slots + 1))
                full = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), group[s])), pa.array(np.full(len(full), row[s])),
                     pa.array([keys[edge[x]:edge[x + 1]].tobytes() for x in full], pa.binary())], names=["slot", "_group", "_first", "keys"])
    asks = rows.select("_group", "_key", F.col(f"_row.`{text}`")).mapInArrow(
        asked, "slot int, _group bigint, _first bigint, keys binary")

    def answered(asks: pa.Table, part: pa.Table) -> pa.Table:
        slot = asks["slot"][0].as_py() if asks.num_rows else 0
        counts, lv = answers_of(asks["keys"].to_pylist(), part.slice(0, part.num_rows if asks.num_rows else 0), slot * joint, joint, shift, kind)
        return pa.table({"_group": asks["_group"], "_first": asks["_first"], "slot": asks["slot"], "counts": counts, "levels": lv})
    held = parts.select(F.expr(f"shard div {joint}").cast("int").alias("slot"), "shard", "words", "counts", "bits")
    # landed: the keys' shuffle is given back before texts move
    answers = materialize(asks.groupBy("slot").cogroup(held.groupBy("slot"))
                          .applyInArrow(answered, "_group bigint, _first bigint, slot int, counts binary, levels binary"), "lm-answers")
    release(parts)

    def scored(own: pa.Table, said: pa.Table) -> pa.Table:
        own, said = own.sort_by("_key"), said.sort_by([("_first", "ascending"), ("slot", "ascending")])
        row = own["_row"].combine_chunks()
        texts = (row.chunk(0) if isinstance(row, pa.ChunkedArray) else row).field(at).to_pylist() if own.num_rows else []
        first = said["_first"].to_numpy()
        start, block = np.unique(first, return_index=True)
        cut = np.append(np.searchsorted(own["_key"].to_numpy(), start), len(texts))
        counts, lv = said["counts"].to_pylist(), said["levels"].to_pylist()
        block = np.append(block, len(first))
        sums = []
        for i in range(len(start)):
            of, x = slice(block[i], block[i + 1]), texts[cut[i]:cut[i + 1]]
            sums.append(log_sums(*tokens(x), Answers(n, v, np.frombuffer(b"".join(counts[of]), kind), np.frombuffer(b"".join(lv[of]), np.uint8))))
        size, known, base, score = (np.concatenate(x) for x in zip(*sums, strict=True))
        return pa.table({"_row": own["_row"], "n_tokens": size, "n_known": known, "train_tokens": np.full(len(size), n, np.int64),
                         "base_score": base, "score": score})
    schema = StructType([f for f in rows.schema.fields if f.name == "_row"] + StructType.fromDDL(RESULT).fields)
    return rows.groupBy("_group").cogroup(answers.groupBy("_group")).applyInArrow(scored, schema)


def score(docs: DataFrame, train: DataFrame, text: str = "text", max_broadcast: int = MAX_BROADCAST,
          bits: int = BITS) -> DataFrame:
    """``docs`` in ``_row`` with n_tokens, n_known, train_tokens, base_score and score, learning from ``train``."""
    spark = docs.sparkSession
    size = train.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = 1 << max(10, (size // 4 // SHARD_TOKENS).bit_length())
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 64)
    blocks = counted(train, text, shards)
    parts = materialize(blocks.repartition(partitions, "shard").mapInArrow(
        lambda it: build(bits, it), "shard int, words binary, counts binary, bits binary, n_words bigint, n_tokens bigint"), "lm-parts")
    shape = sorted(map(tuple, parts.select("shard", "n_words", "n_tokens", F.octet_length("bits")).collect()))   # numbers of each shard
    if sum(12 * w + b for _, w, _, b in shape) > max_broadcast:
        return sharded_scores(docs, text, parts, shards, sum(t for _, _, t, _ in shape), sum(w for _, w, _, _ in shape))
    model = Model(shards, sum(w for _, w, _, _ in shape), sum(t for _, _, t, _ in shape), {s: b for s, _, _, b in shape})
    at = dict(zip([s for s, *_ in shape], np.cumsum([0, *[w for _, w, _, _ in shape]]).tolist(), strict=False))
    for r in parts.select("shard", "words", "counts", "bits").toLocalIterator():       # one file of shards at a time
        model.put(at[r["shard"]], r["shard"], bytes(r["words"]), bytes(r["counts"]), bytes(r["bits"]))
    return filter_scores(docs, text, spark.sparkContext.broadcast(model))
