"""Merkle manifest, conversation repair and personal data against brute-force versions."""

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.llm import merkle, pii, queries, repair


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- merkle -------------------------------------------------------------------------------------------------------
def plain_tree(leaves):
    """Levels of a tree by the definition."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_proof(levels, i):
    out = []
    for level in levels[:-1]:
        run = range(i - i % 16, min(i - i % 16 + 16, len(level)))
        out.append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        i //= 16
    return out


def plain_manifest(rows):
    """{(key, leaf): [(subroot, root, proof)]} of (tree, key, leaf) rows."""
    trees = {}
    for t, k, d in rows:
        trees.setdefault(t, []).append((k is not None, k or 0, d))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    levels = {t: plain_tree([x[2] for x in sorted(trees[t])]) for t in names}
    top = plain_tree([levels[t][-1][0] for t in names])
    out = []
    for n, t in enumerate(names):
        for i, (has, k, d) in enumerate(sorted(trees[t])):
            out.append((k if has else None, t, d, levels[t][-1][0], top[-1][0], plain_proof(levels[t], i) + plain_proof(top, n)))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_manifest_equals_plain(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr(merkle, "ROWS_IN_TASK", 150)          # trees that go on in several tasks
    sizes = {None: 3, "": 17, "a": 1, "é": 16, "Z": 4096 if seed == 1 else 4500, "b": 256, "zz": 257}
    data = [(k if rnd.random() > 0.02 else None, t, rnd.choice(["x", "y", None]), rnd.randrange(9)) for t, n in sizes.items() for k in range(n)]
    data += [data[-1]] * 3                                      # repeated rows
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "id long, source string, digest string, idx long")     # clashing names
    leaf = merkle.row_digest([F.col("id"), F.col("source"), F.col("digest")])
    got = merkle.manifest(df, "id", "source", leaf).withColumn("folded", merkle.folded(F.col("claim"), F.col("proof"))) \
        .withColumn("p", merkle.proof_digest(F.col("proof"))).collect()

    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = plain_manifest([(t, k, sha(enc(k), enc(t), enc(d))) for k, t, d, _ in data])
    assert order((r["key"], r["tree"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["proof"]]) for r in got) == order(want)
    assert all(r["folded"] == r["root"] for r in got)
    assert all(r["p"] == sha(*[x["left"] + x["right"] for x in r["proof"]]) for r in got)


def test_manifest_small_and_tampered(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema), "doc_id", "source", merkle.row_digest([F.col("text")])).count() == 0
    one = spark.createDataFrame([(7, None, None, None, None)], schema)
    r = merkle.manifest(one, "doc_id", "source", merkle.row_digest([F.col("doc_id"), F.col("text")]), F.lit("other")).first()
    assert (r["leaf"], r["subroot"], r["root"], r["proof"], r["claim"]) == (sha("1:7-"),) * 3 + ([], "other")


def test_levels_keep_to_their_block():
    nodes = [str(i) for i in range(5)]
    assert merkle.levels_of(nodes, True) == [nodes, [sha(*nodes)]]
    assert [len(x) for x in merkle.levels_of(nodes, False)] == [5, 1, 1, 1]     # one-node runs are digested too
    assert merkle.levels_of(["a"], True) == [["a"]]


# --- repair -------------------------------------------------------------------------------------------------------
def plain_faults(rows):
    """Rows (turn, role, text) in order, with their first fault."""
    seen, out = set(), []
    for turn, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_repair(rows):
    """Cheapest (cost, audit, repaired) over all edits with up to two inserts anywhere."""
    best = [(10 ** 9, "", None)]
    inserts = [[]] + [[a] for a in ("user", "assistant")] + [["user", "assistant"], ["assistant", "user"]]

    def edits(role, fault):
        yield 3, "D", None
        if fault not in ("blank", "duplicate"):
            cut = fault == "truncated"
            yield cut, "K", role
            yield 2 + cut, "R", "user"
            yield 2 + cut, "R", "assistant"
    for gaps in product(inserts, repeat=len(rows) + 1):
        if sum(map(len, gaps)) * 2 > 3 * len(rows):
            continue
        for how in product(*[list(edits(r, f)) for r, _, f in rows]):
            cost = sum(h[0] for h in how) + 2 * sum(map(len, gaps))
            if cost > best[0][0]:
                continue
            audit, out = "", []
            for i in range(len(rows) + 1):
                audit += "I" * len(gaps[i])
                out += [f"{r}:" for r in gaps[i]]
                if i < len(rows):
                    audit += how[i][1]
                    out += [f"{how[i][2]}:{rows[i][1]}"] if how[i][2] is not None else []
            if re.fullmatch("(s?(ua)+)?", "".join(x[:1] if not x.startswith(":") else "?" for x in out)) and (cost, audit) < best[0][:2]:
                best[0] = (cost, audit, out)
    return best[0]


def collected(spark, rows, schema="conv_id long, turn long, role string, text string", conversations=None):
    got = repair.read_back(repair.repair(spark.createDataFrame(rows, schema), conversations)).collect()
    return {r["conv_id"]: r.asDict() for r in got}


def test_repair_equals_brute_force(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for conv in range(150):
        own = [(t, rnd.choice(["user", "assistant", "system", "user", "assistant", "x", ""]), rnd.choice(["Hi.", "Yes", " \t", "No!", "ok?"]))
               for t in range(rnd.randrange(1, 4))]
        rows += [(conv, *r) for r in own]
        cost, audit, out = plain_repair(plain_faults(own))
        want[conv] = (cost, audit, sha("\n".join(out)))
    got = collected(spark, rows)
    assert {c: (r["cost"], r["audit"], r["repaired_sha256"]) for c, r in got.items()} == want


def plain_paths(rows):
    """(cost, audit) by the same states, with whole letter strings and no windows."""
    best = {repair.START: (0, "")}
    for role, _, fault in rows:
        new = {}
        for state, (cost, audit) in best.items():
            for to, more, k in repair.moves(role[:1], fault)[state]:
                new[to] = min(new.get(to, (10 ** 9, "")), (cost + more, audit + repair.OPTIONS[k]))
        best = new
    ends = [best[s] for s in (repair.START, repair.ASSISTANT) if s in best]
    ends += [(best[repair.USER][0] + 2, best[repair.USER][1] + "I")] if repair.USER in best else []
    return min(ends)


def test_repair_of_long_conversations(spark):
    rnd = random.Random(6)
    rows, want = [], {}
    for conv, roles in enumerate([["user"], ["user", "assistant"], ["system", "user", "assistant", "x"], ["assistant"]]):
        own = [(t, rnd.choice(roles) if conv else "user", f"{t if rnd.random() < .9 else 0}{rnd.choice('.!?,')}") for t in range(500 + conv)]
        rows += [(conv, *r) for r in own]
        want[conv] = plain_paths(plain_faults(own))
    got = collected(spark, rows)
    assert {c: (r["cost"], r["audit"]) for c, r in got.items()} == want


def test_repair_cases(spark):
    ids = spark.createDataFrame([(1,), (2,), (9,), (None,)], "conv_id long")
    rows = [(1, 4, "user", "Hi."), (1, 9, "assistant", "Yes."), (1, 4, "user", "Hi."), (1, None, None, None),
            (None, 1, "user", "A."), (None, 2, "assistant", "B."), (2, None, "user", "Q?")]
    got = collected(spark, rows, conversations=ids)
    empty = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": sha("")}
    assert {k: v for k, v in got[9].items() if k != "conv_id"} == empty
    assert got[None]["audit"] == "KK" and got[None]["illegal"] == 0
    assert got[1]["gaps"] == 4 and got[1]["blank"] == 1 and got[1]["duplicate"] == 1 and got[1]["audit"] == "DKDK"
    assert got[1]["illegal"] == 2 and got[1]["repaired_sha256"] == sha("user:Hi.\nassistant:Yes.")
    assert (got[2]["gaps"], got[2]["cost"], got[2]["audit"]) == (0, 2, "KI")
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, edit string")
    assert repair.read_back(repair.repair(none)).count() == 0


def test_damage_follows_the_crc(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in range(5)] + [(None, None, None, None)]
    got = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert order(tuple(r) for r in got) == order(want)


# --- personal data ------------------------------------------------------------------------------------------------
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                  "phone": lambda: 9 <= len(d) <= 15}[kind]()
            out += [(kind, *m.span())] if ok else []
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_strict_spans_equal_the_patterns():
    rnd = random.Random(3)
    parts = ["a.b@c.d", "a@b@c.de", "@x.y", "é@b.co", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (555) 123-4567", "+12", "+1234567890123456", "0", "7", ".", "-", " ", "@", "x", "+", "1.2", "a@b-.c-d..e"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 8)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("piece", ["a", "1", "1.", "@", "a@", "+1", "1 ", ". ", " at ", "1-1.", "a.b@"])
def test_long_texts_take_linear_time(piece):
    import time
    text = piece * (400_000 // len(piece))
    began = time.time()
    pii.base_spans(text)
    pii.proposals(text)
    assert time.time() - began < 20


@pytest.fixture(scope="module")
def trained(spark):
    rnd = random.Random(11)
    words = "lorem ipsum dolor sit amet at dot the of und que call mail version order page".split()

    def card():
        d = [rnd.randrange(10) for _ in range(15)]
        body = "".join(map(str, d))
        return body + next(str(c) for c in range(10) if pii.luhn(body + str(c)))

    def strict():
        return rnd.choice([f"{rnd.choice(words)}.{rnd.randrange(99)}@mail{rnd.randrange(9)}.example.com", card(),
                           ".".join(str(rnd.randrange(256)) for _ in range(4)), f"+1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)}"])

    def noise():
        return rnd.choice([str(rnd.randrange(10 ** 15, 10 ** 16)), f"{rnd.randrange(9)}.{rnd.randrange(99)}.", str(rnd.randrange(1900, 2030)),
                           f"{rnd.randrange(300, 999)}.{rnd.randrange(300, 999)}.1.2", "".join(rnd.choice("0123456789abcdef") for _ in range(40))])
    docs = []
    for i in range(600):
        text = [rnd.choice(words) for _ in range(40)]
        for _ in range(rnd.randrange(3)):
            text[rnd.randrange(40)] = strict()
        text[rnd.randrange(40)] = noise()
        docs.append((i, " ".join(text)))
    return pii.fit(spark.createDataFrame(docs, "doc_id long, text string"))


LOOSE = [("email", "write to jane.doe [at] example [dot] org today", "jane.doe [at] example [dot] org"), ("email", "mail zoë.ñu@mail4.example.com now", "zoë.ñu@mail4.example.com"),
         ("email", "ask bob(at)site.example.com or not", "bob(at)site.example.com"), ("ip", "reach it under 10[.]20[.]30[.]44 again", "10[.]20[.]30[.]44"),
         ("card", "paid by 4111.1111.1111.1111 then", "4111.1111.1111.1111"), ("phone", "call 001 (555) 555-0199 later", "001 (555) 555-0199")]


def test_trees_add_loose_forms(trained):
    assert set(trained.thresholds) == set(pii.KINDS)
    for kind, text, want in LOOSE:
        got = [(k, text[s:e].strip()) for k, s, e, base, _ in pii.chosen(text, trained) if not base and k == kind]
        assert (kind, want) in got, (text, got)


def test_trees_leave_plain_text_alone(trained):
    rnd = random.Random(12)
    clean = ["The end of 1999. Section 2.1. of page 17, order 20230114.", "We met at noon. The dot at end. See version 1.2.3 and 4.5.",
             "sum 4111111111111112 is no card", "ratio 300.400.1.2 is no host", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"']
    clean += [" ".join(str(rnd.randrange(10 ** rnd.randrange(1, 6))) + "," for _ in range(10)) for _ in range(50)]
    hit = [t for t in clean if pii.chosen(t, trained)]
    assert len(hit) <= 2, hit


def test_trees_repeat_and_find_in_spark(spark, trained):
    rows = [(1, LOOSE[0][1] + " and a@b.co", "x", "x"), (1, LOOSE[0][1] + " and a@b.co", "x", "x"), (2, None, "x", "x"), (3, "", "x", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, _row string")           # clashing names
    got = pii.redact(pii.find(df, trained)).collect()
    assert [r["redacted"] for r in got] == ["write to [EMAIL] today and [EMAIL]"] * 2 + [None, ""]
    assert [len(r["spans"]) for r in got] == [2, 2, 0, 0] and got[0]["_row"]["spans"] == "x"
    assert pii.fit(df.limit(0).select("doc_id", "text")) is None
    assert pii.find(df.limit(0), None).count() == 0


def test_isotonic_is_monotone():
    rnd = np.random.default_rng(1)
    margin, label = rnd.normal(size=300), (rnd.random(300) < .5).astype(float)
    at, chance = pii.isotonic(margin, label)
    assert (np.diff(at) > 0).all() and (np.diff(chance) > 0).all() and chance.min() >= 0 and chance.max() <= 1


def test_pii_query_equals_plain_patterns(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op11_pii(spark, d).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = plain_base(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in base) for k in PLAIN]
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))
