"""Operators over the whole collection against brute force: n-gram join, substring and passage dedup, LM, pages."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeweave.llm import common, html_tree, ngram_join, ngram_lm, passages, suffix_dedup

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(2000)]


def words(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def edited(w, k):
    w = list(w)
    for _ in range(k):
        w[RNG.randrange(len(w))] = RNG.choice(WORDS)
    return w


def near_copies():
    """Chains of near copies (each like its neighbours only), large groups, small texts, copies, nulls."""
    out = []
    for n in (3, 12, 25, 60, 400):
        w = words(n)
        for _ in range(12):
            out.append(" ".join(w))
            w = edited(w, RNG.choice((0, 1, 1, 2, n // 60)))
    base = words(300)
    out += [" ".join(edited(base, RNG.choice((1, 2, 3, 6)))) for _ in range(80)]
    out += ["", None, " ", "one", "ONE", "one two", "One\tTwo", "one two three"] + [" ".join(words(40)) for _ in range(20)]
    RNG.shuffle(out)
    return out


def shingle_sets(texts):
    for t in texts:
        w = (t or "").encode().lower().split()
        yield frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute_components(ids, sets):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 10 ** 9)
    for i, d in enumerate(ids):
        least[root(i)] = min(least[root(i)], d)
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize("small_group", [2, 16])
def test_ngram_join_equals_brute_force(spark, monkeypatch, small_group):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", small_group)
    texts = near_copies()
    ids = [1000 - i for i in range(len(texts))]
    sets = list(shingle_sets(texts))
    want = Counter(zip(ids, map(len, sets), brute_components(ids, sets), strict=True))
    df = spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "doc_id bigint, text string, node string").repartition(7)
    assert Counter(map(tuple, ngram_join.join(df).collect())) == want


def test_ngram_join_nulls_and_repeats(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, None), (3, "A B C D")], "doc_id bigint, text string")
    assert Counter(map(tuple, ngram_join.join(df).collect())) == Counter(
        {(5, 2, 3): 2, (None, 2, 3): 1, (7, 0, 7): 1, (3, 2, 3): 1})
    kept = ngram_join.keep_one(df.withColumn("node", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "node"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter({7: 1, 3: 1})
    assert ngram_join.join(df.limit(0)).count() == 0


def test_ngram_join_groups_of_the_same_nodes_are_one(spark):
    rows = [(1, 10), (1, 11), (2, 10), (2, 11), (3, 10), (4, 11), (4, 12), (5, 10), (5, 11), (5, 12)]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "sig bigint, node bigint")).collect()
    assert Counter((r.sig, r.node) for r in got) == Counter([(1, 10), (1, 11), (4, 11), (4, 12), (5, 10), (5, 11), (5, 12)])


def test_ngram_join_lands_few_steps_and_moves_copies_only(spark, monkeypatch):
    """Small groups take few jobs, not some for every part; two near copies meet in few groups of their many signatures."""
    steps, rows, land = [], {}, common.materialize

    def landed(df, name):
        out = land(df, name)
        steps.append(name)
        rows[name] = out.count()
        return out
    monkeypatch.setattr(common, "materialize", landed)
    monkeypatch.setattr(ngram_join, "materialize", landed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:k] + ["x"] + words[k + 1:]) for k in (30, 370)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    assert {r.component_id for r in ngram_join.join(df).collect()} == {0}
    assert len(steps) <= 24
    assert rows["join-members"] == 2 and rows["join-sets"] == 2


def described_sets(spark, sets):
    return spark.createDataFrame([(i, len(s), s.view(np.int64).tolist(), bytearray(ngram_join.sketch(s)), bytearray(ngram_join.wide_sketch(s)))
                                  for i, s in enumerate(sets)], "node bigint, n bigint, items array<bigint>, sketch binary, wide binary")


def test_tiles_carry_few_signatures_of_each_node(spark, monkeypatch):
    """A node's rows, one for each of its open signatures, do not each carry all of them; a pair is still one row."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2 ** 63, 400).astype(np.uint64))
    links = ngram_join.Links(None, "text", 3, 90)
    links.items = described_sets(spark, [base, base[1:], base[:-1]])
    members = spark.createDataFrame([(sig, node) for sig in range(200) for node in range(3)], "sig bigint, node bigint")
    carried, pairs, frame = [], [], type(members)
    mapped = frame.mapInArrow

    def spied(self, *a, **k):
        if "sigs" in self.columns:
            carried.append(tuple(self.agg(F.max(F.size("sigs")), F.count("*")).first()))
        return mapped(self, *a, **k)
    monkeypatch.setattr(frame, "mapInArrow", spied)
    monkeypatch.setattr(links, "compare", lambda found: pairs.extend((r.a, r.b) for r in found.collect()))
    links.tiles(members)
    assert carried == [(ngram_join.KNOWN_SIGS, 600)]
    assert sorted(pairs) == [(0, 1), (0, 2), (1, 2)]


def test_wide_sketches_never_err_and_tell_large_sets_apart(spark):
    rng = np.random.default_rng(4)
    made = lambda n: np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
    for n in [1, 5, 200, 257, 1000, 5000, 40_000] * 4:
        a = made(n)
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.choice([0, .05, .3, .9])], made(int(rng.integers(1, n + 2)))]))
        assert ngram_join.differing(ngram_join.wide_sketch(a), ngram_join.wide_sketch(b)) <= len(np.setxor1d(a, b))
    x, y = made(5000), made(5000)
    assert ngram_join.may_link(*(np.asarray(v) for v in (5000, np.frombuffer(ngram_join.sketch(x), np.uint64),
                                                         5000, np.frombuffer(ngram_join.sketch(y), np.uint64))), 80)
    items = described_sets(spark, [x, x[:4600], y])
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a bigint, b bigint")
    assert [(r.a, r.b) for r in ngram_join.not_ruled_out(pairs, items, 80).collect()] == [(0, 1)]


def test_rows_of_groups_that_go_are_not_joined(spark, monkeypatch):
    """Of a thousand groups of the same two nodes, the rows of a few get to the join that keeps one group."""
    joined, frame = [], type(spark.range(1))
    join = frame.join

    def spied(self, other, on=None, how=None):
        joined.append(self.count())
        return join(self, other, on, how)
    members = spark.range(2000).selectExpr("id div 2 AS sig", "id % 2 AS node")
    monkeypatch.setattr(frame, "join", spied)
    assert sorted(map(tuple, ngram_join.one_of_each(members).collect())) == [(0, 0), (0, 1)]
    assert len(joined) == 1 and joined[0] < 20


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(1)
    for n in [9, 10, 11, 19, 20, 21, 57, 100, 500] * 8:
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.choice([0, .03, .06])],
                                      rng.integers(0, 2 ** 63, int(rng.integers(0, n // 15 + 2))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both < len(a) + len(b) - both and 100 * both >= 90 * (len(a) + len(b) - both):
            assert set(ngram_join.signatures(a, 90).tolist()) & set(ngram_join.signatures(b, 90).tolist())


@pytest.mark.parametrize("in_task", [common.LINKS_IN_TASK, 0])
def test_components(spark, monkeypatch, in_task):
    monkeypatch.setattr(common, "LINKS_IN_TASK", in_task)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)]
    adj = defaultdict(set)
    for a, b in links:
        adj[a].add(b)
        adj[b].add(a)
    want = {}
    for n in sorted(adj):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += adj[x]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if len(adj[k] - {k})}


def byte_docs():
    base = ["".join(RNG.choice("abcdé") for _ in range(300)) for _ in range(5)]
    out = []
    for i in range(50):
        t = "".join(RNG.choice("abcd") for _ in range(RNG.randint(0, 200)))
        for _ in range(RNG.randint(0, 3)):
            b, s = RNG.choice(base), RNG.randint(0, 150)
            t += b[s:s + RNG.randint(80, 300)] + "".join(RNG.choice("xyz") for _ in range(RNG.randint(0, 30)))
        out.append((RNG.randint(0, 30) * 2, t))
    return out + [(99, "ab" * 300), (1, "ab" * 200), (97, "x" * 99), (95, ""), (93, None), (None, base[0]), (91, base[0] * 2), (91, base[0] * 2)]


def brute_removed(docs):
    from xxhash import xxh64
    seen, out = set(), {}
    order = sorted({(-2 ** 63 if d is None else d, h, t or "") for d, h, t in docs})
    del xxh64
    for d, h, t in order:
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                gone[p:p + 100] = True
            seen.add(raw[p:p + 100])
        out[(d, h)] = (raw, gone)
    return out


@pytest.mark.parametrize("group_rows", [suffix_dedup.GROUP_ROWS, 3])
def test_suffix_dedup_equals_brute_force(spark, group_rows):
    df = spark.createDataFrame(byte_docs(), "doc_id bigint, text string").withColumn("hash", F.lit("x")).repartition(5)
    hashed = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").collect()
    want = brute_removed([tuple(r) for r in hashed])
    got = suffix_dedup.dedup(df, group_rows=group_rows).select(
        "_row.*", F.xxhash64(F.coalesce("_row.text", F.lit(""))).alias("h"), "n_bytes", "n_removed", "spans", "kept", "kept_sha256").collect()
    assert len(got) == len(hashed)
    for r in got:
        raw, gone = want[(-2 ** 63 if r.doc_id is None else r.doc_id, r.h)]
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        assert (r.n_bytes, r.n_removed, bytes(r.kept), r.kept_sha256) == (len(raw), int(gone.sum()), kept, hashlib.sha256(kept).hexdigest())
        assert len(r.spans) == int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_segments_do_not_change_runs(monkeypatch):
    text = "".join(RNG.choice("abcdef") for _ in range(5000)).encode()

    def strings(found):
        return {(p + j, int(g)) for _, s, n, _, gr in found for p, m, g in zip(s.tolist(), n.tolist(), gr, strict=True) for j in range(m)}
    whole = strings(suffix_dedup.runs([text, text[:50], b""]))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 333)
    assert strings(suffix_dedup.runs([text, text[:50], b""])) == whole and len(whole) == 4901


def brute_lm(docs, held):
    toks = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in docs}
    c, p = Counter(), Counter()
    for i, t in toks.items():
        if not held(i):
            c.update(t)
            p.update(zip([b"\n", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        base = score = 0.0
        for h, w in zip([b"\n", *t], t, strict=False):
            p1 = (c[w] + 1) / (n + v + 1)
            both = min(2 ** (p[h, w].bit_length() - 1) if p[h, w] else 0, c[h])
            base += np.log10(p1)
            score += np.log10((both + ngram_lm.MU * p1) / (c[h] + ngram_lm.MU))
        yield i, (len(t), sum(c[w] > 0 for w in t), n, base, score)


@pytest.mark.parametrize("max_broadcast", [ngram_lm.MAX_BROADCAST, 0])
def test_lm_scores(spark, max_broadcast):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(5001, ""), (5002, None), (5003, "The THE the")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("x")).repartition(4)
    got = ngram_lm.score(df, df.filter(~ngram_lm.held_out(F.col("doc_id"))), max_broadcast=max_broadcast,
                         bits=64).collect()                  # so wide a filter does not err
    want = dict(brute_lm(docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2))
    assert len(got) == len(docs)
    for r in got:
        w = want[r["_row"]["doc_id"]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3]) and r["score"] == pytest.approx(w[4])
    assert ngram_lm.score(df.limit(0), df.limit(0)).count() == 0
    empty = ngram_lm.score(df.limit(2), df.limit(0)).collect()
    assert [r.train_tokens for r in empty] == [0, 0]


def test_lm_routes_ask_one_filter(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "GROUP_CHARS", 20_000)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    train = df.filter(~ngram_lm.held_out(F.col("doc_id")))

    def scores(max_broadcast, bits):
        got = ngram_lm.score(df, train, max_broadcast=max_broadcast, bits=bits).collect()
        return {r["_row"]["doc_id"]: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got}
    sent, kept = scores(ngram_lm.MAX_BROADCAST, ngram_lm.BITS), scores(0, ngram_lm.BITS)
    assert sent.keys() == kept.keys()
    for d, want in sent.items():
        assert kept[d] == pytest.approx(want, rel=1e-12)
    wide = scores(0, 64)
    assert any(abs(wide[d][4] - kept[d][4]) > 1e-6 for d in wide)      # at 8 bits an entry the filter errs


def test_lm_shards_look_a_key_up_once_for_all_groups(monkeypatch):
    """A look-up for each group and shard grows with the square of the input."""
    rng, shards, joint = np.random.default_rng(5), 1024, ngram_lm.JOINT_SHARDS
    shift, first = np.uint64(54), 8
    keys = np.unique(rng.integers(0, 1 << 54, 600, np.uint64) | rng.integers(first, first + joint, 600).astype(np.uint64) << shift)
    n = rng.integers(1, 40, len(keys))
    some = (keys >> shift) != first + 2                      # a shard that nothing trained
    batch = pa.record_batch([pa.array((keys >> shift).astype(np.int32)[some]), pa.array([k.tobytes() for k in keys[some]], pa.binary()),
                             pa.array([x.astype("<u4").tobytes() for x in n[some]], pa.binary())], names=["shard", "keys", "counts"])
    part = pa.Table.from_batches([*ngram_lm.build(ngram_lm.BITS, iter([batch]))])
    model = ngram_lm.Model(shards, sum(part["n_words"].to_pylist()), 10**6, {r["shard"]: len(r["bits"]) for r in part.to_pylist()})
    at = 0
    for r in part.to_pylist():
        model.put(at, r["shard"], r["words"], r["counts"], r["bits"])
        at += r["n_words"]
    absent = rng.integers(first << 54, first + joint << 54, 400, np.uint64)
    blocks = [np.unique(rng.choice(np.concatenate([keys, absent]), 200)) for _ in range(50)]
    asked, probed = [], ngram_lm.probed
    monkeypatch.setattr(ngram_lm, "probed", lambda k, *a: asked.append(len(k)) or probed(k, *a))
    counts, lv = ngram_lm.answers_of([b.tobytes() for b in blocks], part.take(list(range(len(part)))[::-1]), first, joint, shift, "<u4")
    assert asked == [len({k for b in blocks for k in b.tolist() if k % 2})]
    for b, c, v in zip(blocks, counts.to_pylist(), lv.to_pylist(), strict=True):
        word = b % np.uint64(2) == 0
        assert np.frombuffer(c, "<u4").tolist() == model.count(b[word]).tolist()
        assert ngram_lm.quantised(np.frombuffer(v, np.uint8)).tolist() == model.pair_count(b[~word]).tolist()
    counts, lv = ngram_lm.answers_of([blocks[0].tobytes()], part.slice(0, 0), first, joint, shift, "<u4")     # nothing trained
    assert not any(counts[0].as_py()) and not any(lv[0].as_py())


def test_lm_beats_the_base_on_held_out_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = ngram_lm.held_out(F.col("doc_id"))
    r = ngram_lm.score(df, df.filter(~held)).filter(ngram_lm.held_out(F.col("_row.doc_id"))).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_passages_are_found_and_clean_documents_stay(spark):
    shared = [words(n) for n in (52, 80, 200, 400)]
    docs, plain = [], {}
    for i in range(60):
        body = words(RNG.randint(5, 150))
        if i % 3 == 0:
            plain[i] = " ".join(body)
            docs.append((i, plain[i]))
        else:
            docs.append((i, " ".join(body + edited(shared[i % 4], (i % 7 == 1) * 2) + words(RNG.randint(0, 80)))))
    docs += [(100, ""), (101, None), (102, docs[1][1]), (102, docs[1][1]), (None, " ".join(words(60)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("passages", F.lit("x")).repartition(6)
    got = passages.find(df).collect()
    assert len(got) == len(docs)
    seen = set()
    for r in sorted(got, key=lambda r: -1 if r["_row"]["doc_id"] is None else r["_row"]["doc_id"]):
        d, t = r["_row"]["doc_id"], r["_row"]["text"]
        assert r.n_words == len((t or "").split())
        if d in plain or not t:
            assert not r.passages and r.rest == t
        elif d is not None and d < 100:
            k = d % 4
            n = sum(p.n_words for p in r.passages)
            assert (n >= 0.85 * len(shared[k])) == (k in seen) and all(p.n_words >= 50 for p in r.passages)
            seen.add(k)
        for p in r.passages:
            assert len(t[p.start:p.stop].split()) == p.n_words and t[p.start:p.stop] not in r.rest
    kept = passages.remove(df)
    assert kept.columns == df.columns and 102 not in {r.doc_id for r in kept.collect()}
    assert {r.doc_id: r.text for r in kept.collect() if r.doc_id in plain} == plain
    assert passages.remove(df.limit(0)).count() == 0


def mixed_edits(w, rate, rng):
    """A word in 1 / rate replaced, left out or followed by another."""
    return [x for v in w for x in (((rng.choice(WORDS),), (), (v, rng.choice(WORDS)))[rng.randrange(3)] if rng.random() < rate else (v,))]


@pytest.mark.parametrize("rate", [0.05, 0.1])
def test_edited_passages_are_found(spark, rate):
    rng, docs, want = random.Random(3), [], {}
    for i in range(150):
        shared = [rng.choice(WORDS) for _ in range(rng.randint(53, 100))]
        around = [[rng.choice(WORDS) for _ in range(60)] for _ in range(4)]
        copy = mixed_edits(shared, rate, rng)
        docs += [(i, " ".join(around[0] + shared + around[1])), (1000 + i, " ".join(around[2] + copy + around[3]))]
        want[1000 + i] = 60, 60 + len(copy)
    found = whole = other = 0
    for r in passages.find(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect():
        s, e = want.get(r["_row"]["doc_id"], (0, 0))
        whole += e - s
        for p in r.passages:
            own = [x for x in range(p.first_word, p.first_word + p.n_words) if s <= x < e]
            found, other = found + len(own), other + (p.n_words - len(own))
    assert found >= (0.95 if rate < 0.1 else 0.9) * whole and other <= 0.01 * whole


def test_alignment_of_long_gaps_and_weak_pieces():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2 ** 62, 300).astype(np.uint64)
    b = np.concatenate([a[:120], rng.integers(0, 2 ** 62, 30).astype(np.uint64), a[120:]])
    assert passages.between(a, b).all()
    got = passages.between(b, a)
    assert got[:120].all() and not got[120:150].any() and got[150:].all()
    weak = np.concatenate([np.ones(60, bool), np.tile([True, False, False], 30), np.ones(60, bool)])
    spans = passages.pieces(7, weak)
    assert (spans[0][0], spans[-1][1]) == (7, 7 + 210) and all(weak[s - 7:e - 7].mean() >= passages.IDENTITY for s, e in spans)


def brute_chain(y, x):
    """Best chain score by trying all predecessors."""
    best = []
    for j in range(len(y)):
        own = [best[i] - passages.GAP * (y[j] - y[i] + x[j] - x[i]) for i in range(j) if y[i] < y[j] and x[i] < x[j]]
        best.append(passages.GAIN + max([0.0, *own]))
    return max(best)


def test_chains_are_optimal():
    for _ in range(60):
        n = RNG.randint(2, 40)
        pts = sorted({(RNG.randint(0, 60), RNG.randint(0, 60)) for _ in range(n)})
        y, x = (np.asarray(c) for c in zip(*pts, strict=True))
        got = passages.chains(y, x)
        top = brute_chain(y.tolist(), x.tolist())
        if got:
            a, b = got[0]
            score = len(a) * passages.GAIN - passages.GAP * ((a[-1] - a[0]) + (b[-1] - b[0]))
            assert score == pytest.approx(top) and (np.diff(a) > 0).all() and (np.diff(b) > 0).all()
        else:
            assert top == pytest.approx(passages.GAIN)


PAGE = ("<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a href=/a>Home</a></nav>{top}"
        "<article><h1>Head {i}</h1><p>Body {i} &amp; more<br>line<p>Two  {i}</p><div class='share'>Share</div>"
        "<section id=comments><p>Nice!</p></section></article><aside>Side</aside><form><input>Send</form><footer>&copy; x</footer>")


@pytest.mark.parametrize("tree_rows", [html_tree.TREE_ROWS, 0])
def test_pages(spark, tree_rows):
    rows = [(i, f"https://u@Host.example:80/{i}", PAGE.format(i=i, top="<div class=ad>Buy</div>")) for i in range(8)]
    # no part is marked: what every page of the host shows goes, what one page shows stays
    rows += [(100 + i, f"http://plain/{i}", f"<div><div><p>All rights <b>kept</b></p></div><div><p>Only {i} here</p><p>and {i * 7}</p></div></div>")
             for i in range(12)]
    rows += [(200, None, None), (201, "", ""), (202, "x", "plain text &lt;b&gt;"), (203, "x", "<p>one<p>two</p></p></div>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).repartition(3)
    got = {r["_row"]["page_id"]: r.text for r in html_tree.extract(df, tree_rows=tree_rows).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i] == f"Head {i} Body {i} & more line Two {i}"
    for i in range(12):
        assert got[100 + i] == f"Only {i} here and {i * 7}"
    assert (got[200], got[201], got[202], got[203]) == ("", "", "plain text <b>", "one two")
    assert html_tree.extract(df.limit(0), tree_rows=tree_rows).count() == 0


@pytest.mark.parametrize("tree_rows", [html_tree.TREE_ROWS, 0])
def test_unmarked_pages_of_any_length(spark, tree_rows):
    rows, want = [], {}
    for n in (1, 16, 200):
        for i in range(8):
            own = [f"Text {n} {i} {k}" for k in range(n)]
            rows.append((1000 * n + i, f"http://h{n}/{i}", "<div><h1>Head {0}</h1><ul>{1}<li>Item {0}</ul><div>{2}</div><p>All rights</div>".format(
                i, "".join(f"<li>Menu {k}" for k in range(12)), "".join(f"<p>{t}</p>" for t in own))))
            want[1000 * n + i] = " ".join([f"Head {i}", f"Item {i}", *own])
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    assert {r["_row"]["page_id"]: r.text for r in html_tree.extract(df, tree_rows=tree_rows).collect()} == want


@pytest.mark.parametrize("tree_rows", [html_tree.TREE_ROWS, 0])
def test_tree_decides_in_marked_parts(spark, tree_rows):
    # what all pages of a host show goes from a marked part, too; copies of one article stay whole
    rows = [(i, "http://a/", f"<article><h1>Head {i}</h1><div><p>Read <a href=/x>more</a></p></div><p>Body {i} of a <b>text</b></p></article>out")
            for i in range(8)]
    rows += [(100 + i, "http://b/", f"<main><p>One and the same long text</p><p>No {i // 4}</p></main>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r["_row"]["page_id"]: r.text for r in html_tree.extract(df, tree_rows=tree_rows).collect()}
    assert got == {i: f"Head {i} Body {i} of a text" for i in range(8)} | {100 + i: f"One and the same long text No {i // 4}" for i in range(8)}


def test_page_repairs():
    def text(s):
        return html_tree.main_text(html_tree.Page(s), {})
    assert text("<ul><li>x<li>y</ul>z") == "x y z"
    assert text("<p>a<b>b</b>c<p>d&nbsp; e") == "abc d e"
    assert text("<div a='open>x</div> y <") == "x y <"
    assert text("<main>m<nav>n</nav></main>out") == "m"
    assert text("<div>" * 20000 + "x") == "x" and text("<a b='" * 5000).startswith("<a b")


def test_keep_one_takes_texts_of_one_id_apart(spark):
    a = " ".join(f"w{i}" for i in range(60))
    near, other = a + " end", " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (5, other), (5, near), (7, a.upper()), (3, near), (5, other), (None, a), (None, None), (None, None), (8, ""), (8, " "), (9, other + " x")]
    df = spark.createDataFrame([(*r, "k", "s") for r in rows], "doc_id long, text string, key string, stays string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    # (None, a), (3, near), (5, near) and (7, A) go with (1, a); 9 goes with (5, other)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (None, None), (5, other), (8, ""), (8, " ")], key=str)
    assert ngram_join.keep_one(df.limit(0)).count() == 0
