"""The pipeline on a small collection against a brute-force version of its stages."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from citeweave.llm import decontam, quality
from test_small_ops import brute_quality

SF = "/root/testdata/sf0.001"
RNG = random.Random(21)
WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in ("ar", "el", "ion", "ou") for c in ("ta", "se", "lin", "dor", "mi")]


def prose(n):
    return [RNG.choice(quality.STOP_WORDS) if RNG.random() < 0.25 else RNG.choice(WORDS) + RNG.choice(WORDS) for _ in range(n)]


def cases():
    """(text, what becomes of it): kept as it is, gone, or the text that is left."""
    out = [(" ".join(prose(n)), "same") for n in (12, 40, 300, 2000)]
    base = prose(240)
    out.append((" ".join(base), "same"))
    out += [(" ".join(base[:k] + ["changed"] + base[k + 1:]), "gone") for k in (10, 100, 200)]
    out += [(out[1][0], "gone"), (out[2][0].upper(), "gone")]
    passage = prose(90)
    a, b, c = prose(60), prose(150), prose(33)
    out.append((" ".join(a + passage), "same"))
    out.append((" ".join(b + passage + c), " ".join(b) + "  " + " ".join(c)))
    item = prose(14)
    out.append((" ".join(prose(50) + item + prose(50)), "gone"))
    out.append(("### $$$ %%% " * 40, "gone"))
    out += [("", "gone"), (None, "gone"), ("too short", "gone"), ("same words here again now " * 30, "gone")]
    return out, " ".join(item).title()


def test_pipeline_equals_brute_force(spark, scratch):
    made, item = cases()
    docs = [(i, t, "en", "src", len(t or "")) for i, (t, _) in enumerate(made)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, names).repartition(3).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "too few")], "item_id bigint, text string").write.parquet(f"{scratch}/benchmark.parquet")
    frame = spark.read.parquet(f"{scratch}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in frame.collect()}
        path = f"{scratch}/{name}"
        out = stage(spark, frame, scratch)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(path)
        frame = spark.read.parquet(path)
        kept = {r.doc_id: r.text for r in frame.collect()}
        assert set(kept) <= set(before) and all(r.n_chars == len(r.text) for r in frame.collect())
        if name == "quality_rules":
            for d, t in before.items():
                n, _, symbols, _, repeat = brute_quality(t)
                assert (d in kept) == (n >= 10 and 100 * repeat <= 20 * n and symbols <= 0.1 * n)
        if name == "ngram_join":
            ids = sorted(before)
            sets = [frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (before[d].lower().split() for d in ids)]
            assert set(kept) == set(brute_similar(ids, sets))
        if name == "decontamination":
            hits = {d for d, t in before.items() if decontam.occurrences(t.encode(), decontam.automaton((("1", item),), 10))[1]}
            assert set(kept) == set(before) - hits and hits
    for i, (t, what) in enumerate(made):
        assert kept.get(i) == (t if what == "same" else None if what == "gone" else what)
    packed = corpus_pipeline.best_fit_packing(spark, frame, scratch).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(kept)
    for d, rows in by_doc.items():
        ids = np.asarray([*lib.encode(kept[d], add_special_tokens=False).ids, 2], "<u4")
        rows.sort(key=lambda r: r.piece)
        assert [r.start for r in rows] == list(np.cumsum([0, *[r.length for r in rows[:-1]]])) and sum(r.length for r in rows) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in rows)
    for places in by_seq.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0, *[n for _, n in places[:-1]]])) and sum(n for _, n in places) <= 1024


def brute_similar(ids, sets):
    """Component of each document for a Jaccard similarity of 0.8 or more."""
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return [ids[min(k for k in range(len(ids)) if root(k) == root(i))] for i in range(len(ids))]


def test_pipeline_over_the_test_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.select("doc_id").distinct().count() <= 200


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage(spark, docs, SF).count() == 0
