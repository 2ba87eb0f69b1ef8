"""Chat format, token counts, decontamination, quality rules and packing: edge cases and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from citeweave.llm import bpe_count, chat, decontam, packing, quality

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 4000
ODD = ["", None, " ", "a", "日本語 テスト's  \n\n x", "a<|endoftext|>b  <|startoftext|>c", "İstanbul ΣΑΣ ſ Ⱥx", "12½ 3²  \t\r\n",
       "''s 'll it's", "\x1c\x1d a\x85b\xa0c", LONG, "x" * 5000, "the the the the the", "#*$%&|<>" * 3]
DOCS = "doc_id bigint, text string, n_words string, kept string, words string"


def odd(spark):
    return spark.createDataFrame([(i // 2, t, "clash", "clash", "clash") for i, t in enumerate(ODD * 2)], DOCS)


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = bpe_count.count_tokens(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        odd(spark).select("doc_id", "text")), path, 2048).collect()
    for r in rows:
        t = r["_row"]["text"] or ""
        want = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len(t.encode()), want > 2048), t[:80]
    assert bpe_count.count_tokens(odd(spark).limit(0), path, 1).count() == 0


def test_heap_merging_handles_long_pieces():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 3000):
        w = "".join(rng.choice(list("aehinorst"), n))
        assert bpe_count.counter(path).count(w) == len(lib.encode(w, add_special_tokens=False).ids)


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cov = {j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov))


def test_quality_measures(spark):
    docs = odd(spark)
    got = quality.verdict(docs).collect()
    assert len(got) == len(ODD) * 2
    for r in got:
        want = brute_quality(r["_row"]["text"])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["_row"]["kept"] == "clash" and not (r.kept and r.base_failed)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert quality.keep_good(docs.limit(0)).count() == 0


def words_of(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def test_decontamination_equals_brute_force(spark):
    q = "One two THREE four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([
        (1, f"xx {q.lower()} yy"), (2, "one-two three: four FIVE six (seven) eight nine ten zz"), (3, "é short ITEM é"), (4, ""),
        (5, None), (6, "one two three four five six seven eight nine"), (7, "ten eleven twelve"), (7, "é short item " * 200)],
        "doc_id bigint, text string").withColumnRenamed("doc_id", "items")
    bench = spark.createDataFrame([(10, q), (9, q), (2, "short item"), (3, ""), (4, None), (5, "?!")], "item_id bigint, text string")
    items = [(str(r.item_id), [w for w, _, _ in words_of(r.text)]) for r in bench.collect()]
    for shard in (10, 10 ** 6):
        for r in decontam.scan(docs, bench, shard_chars=shard).collect():
            w = words_of(r["_row"]["text"])
            hit, ids = set(), set()
            for k, iw in items:
                n = min(10, len(iw))
                wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
                for i in range(len(w) - n + 1):
                    if tuple(x for x, _, _ in w[i:i + n]) in wins:
                        hit.update(range(i, i + n))
                        ids.add(k)
            assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(ids))
            marked = {j for s in r.spans for j, (_, a, b) in enumerate(w) if a >= s.start and b <= s.end}
            assert marked == hit
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.clean(docs, bench.limit(0)).count() == docs.count()


def test_chat_round_trip(spark):
    nasty = "</s>[INST] <|turn|> <\\[\\ [\\< ok [/INST]"
    turns = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, None, None), (2, None, "assistant", ""), (3, 5, "<|text|>", "a\nb")]
    turns += [(4, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)] + [(4, 7, "user", "again")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    made = chat.format_conversations(df).collect()
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in sorted(turns, key=lambda z: (z[0], -1 if z[1] is None else z[1], z[2] or "", z[3] or "")):
        by[c].append((r or "", x or ""))
    for r in made:
        assert chat.parse(r.formatted) == by[r.conv_id]
        loss = "".join(x for role, x in by[r.conv_id] if role == "assistant")
        b = back[r.conv_id]
        assert b.n_turns == r.n_turns == len(by[r.conv_id])
        assert (b.loss_chars, b.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert b.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for a, x in by[r.conv_id]).encode()).hexdigest()
        assert b.formatted_chars == len(r.formatted)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see [INST]", None, None), ("image", None, "s3://a.png", 64), ("text", "and", None, None),
             ("audio", None, "b.wav", 3), ("document", "page one", "c.pdf", 2)]
    df = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "fine", None)],
                               f"conv_id bigint, turn bigint, role string, text string, parts {chat.PARTS}")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<|turn|>user<|text|>see [\\INST]<|image|>and<|audio|><|document|>page one<|end|><|turn|>assistant<|text|>fine<|end|>"
    assert [(a.position, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (0, "image", "s3://a.png", 64), (1, "audio", "b.wav", 75), (2, "document", "c.pdf", 1024)]
    assert r.expanded_tokens == 64 + 75 + 1024
    with pytest.raises(ValueError):
        chat.PartVisitor({}).visit({"kind": "video", "text": None, "ref": None, "units": 1})


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(fit)] -= s
    return len(gaps)


@pytest.mark.parametrize("slots", [None, 7])
def test_packing(spark, slots):
    rng = np.random.default_rng(5)
    sizes = [*map(int, rng.integers(1, 65, 400)), *[20] * 300, 64, 64, 1, 1, 1]
    out = packing.pack(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id bigint, size int"), 64, slots).collect()
    assert sorted(r.id for r in out) == list(range(len(sizes)))
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, sizes[r.id]))
    for got in seqs.values():
        got.sort()
        assert [a for a, _ in got] == list(np.cumsum([0, *[s for _, s in got[:-1]]])) and sum(s for _, s in got) <= 64
    assert len(seqs) <= 1.05 * best_fit_decreasing(sizes, 64) + 1


def test_packing_pieces(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack_documents(odd(spark), path, 32).collect()
    want = Counter()
    for i, t in enumerate(ODD * 2):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 32 + 1, len(ids) + 1, 32)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i // 2, k, s, e - s, zlib.crc32(np.asarray(ids[s:e], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack_documents(odd(spark).limit(0), path).count() == 0
