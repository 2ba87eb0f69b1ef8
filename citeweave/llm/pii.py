"""Personal data: proposed spans, boosted trees, calibrated thresholds.

Strict patterns find e-mail and IP addresses, card and phone numbers (``base_spans``); these always count.  Beside
them generators of high recall propose overlapping spans in looser forms (``proposals``): addresses with letters of
any alphabet or with "at" and "dot" spelled out, numbers in other groupings, phones without a plus, IPv6.  Gradient
boosted trees judge each proposal by its format (lengths, digit groups, separators, checksum, ...) and its context
(neighbouring characters, digits and words in front); a proposal is taken where its calibrated probability reaches
the threshold of its kind.

The trees are fitted here, on a bounded sample of documents (``SAMPLE_DOCS``, ``TRAIN_ROWS``), with labels that need
no hand: a proposal that covers a strict match of its kind is positive, any other negative.  Strict matches of the
sample are also written in looser forms (positive) and spoiled ones (negative: a wrong checksum, a part over 255, too
few digits) in their own context, so that the trees learn more than the strict patterns.  One document in three is
held out: for each kind an isotonic fit over it turns margins into probabilities, and the kind's threshold is
the least of these probabilities that reaches ``PRECISION``.  A kind without enough held-out positives there, or a
sample without both labels, adds nothing.

Scale: the sample is read by id ranges that reach the Parquet scan; the fitted trees are a few kB and go with the
code.  Finding is one narrow pass, and a text's work grows with its length: no pattern scans a run of characters twice.

Cases: a null or empty text has no spans; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, as_row, materialize

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_RANGES, TRAIN_ROWS = 4000, 16, 20_000      # bounds of the labelled sample
HELD_OUT = 3                                                   # one document in three calibrates
PRECISION, LEAST = 0.95, 8                                     # a threshold's probability; held-out positives it needs
TREES, DEPTH, STEP, SEED = 20, 4, 0.3, 7
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"

Span = tuple[str, int, int]

# --- strict patterns, fixed by their contract; possessive where that changes no match, so that runs are read once
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Strict matches, leftmost and non-overlapping for each kind, by start and then kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- generators ---------------------------------------------------------------------------------------------------
AROUND = re.compile(r"[^\s@<>()\[\]{}\"',;:|]{1,64}+@[^\s@<>()\[\]{}\"',;:|]{3,}+")
SPELLED = re.compile(r"(?i)[ \t]?[\[({<][ \t]?(?:at|@)[ \t]?[\])}>][ \t]?|[ \t](?:at|@)[ \t]")
DOT = r"(?:\.|[ \t]?[\[({<][ \t]?(?:dot|\.)[ \t]?[\])}>][ \t]?|[ \t]dot[ \t])"
SPELLED_DOMAIN = re.compile(rf"(?i)[\w-]{{1,63}}(?:{DOT}[\w-]{{1,63}})+")
NAME = re.compile(r"[\w.+%-]{1,64}\Z")
LOOSE = {
    "ip": [re.compile(r"(?<![\w.])\d{1,5}+(?:[ ]?(?:[.,:_-]|\[\.\]|\(\.\))[ ]?\d{1,5}+){3,7}(?![\w])"),
           re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![\w:])")],
    "card": [re.compile(r"(?<!\w)\d(?:[ \t._/-]{0,2}\d){11,18}(?!\w)")],
    "phone": [re.compile(r"(?<![\w+])[+(]{0,2}\d(?:[ \t()./-]{0,3}\d){6,15}(?!\w)")],
}


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data, of all kinds, overlapping."""
    out: list[Span] = []
    if "@" in text:
        for m in AROUND.finditer(text):
            out.append(("email", m.start(), m.start() + len(m[0].rstrip(".!?*#%&$"))))
    for m in SPELLED.finditer(text):
        name = NAME.search(text[max(0, m.start() - 64):m.start()])
        domain = SPELLED_DOMAIN.match(text, m.end()) if name else None
        if domain:
            out.append(("email", m.start() - len(name[0]), domain.end()))
    for kind, patterns in LOOSE.items():
        for p in patterns:
            out += [(kind, *m.span()) for m in p.finditer(text)]
    return out


# --- features -----------------------------------------------------------------------------------------------------
WORDS = {
    "mail": re.compile(r"(?i)mail|contact|correo|courriel|write to"),
    "phone": re.compile(r"(?i)phone|tel|call|fax|mobil|handy|\bsms\b"),
    "net": re.compile(r"(?i)\bip\b|host|server|address|adresse|\bnode\b"),
    "card": re.compile(r"(?i)card|visa|iban|carte|karte|tarjeta|account"),
    "code": re.compile(r"(?i)version|\bv\b|order|isbn|\bid\b|\bno\b|token|key|page|section"),
}
CONTEXT = 32
RUN = re.compile(r"\d+")


def char_class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal, as numbers."""
    kind, start, end = span
    raw = text[start:end]
    runs = RUN.findall(raw)
    digits = "".join(runs)
    parts = re.split(r"(?i)\.|\bdot\b|[\[\](){}]", raw)
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    plain = digits if digits.isascii() else ""
    return [float(x) for x in (
        *(kind == k for k in KINDS), len(raw), len(digits), sum(c.isalpha() for c in raw), len(runs),
        max(map(len, runs), default=0), min(map(len, runs), default=0), max((int(r[:6]) for r in runs[:8]), default=0),
        raw.count("."), raw.count(" "), raw.count("-"), raw.count(":"), raw.count("/") + raw.count("_") + raw.count(","),
        sum(c in "()[]{}<>" for c in raw), raw.startswith("+"), raw.startswith("00"), raw.startswith("("), raw.count("@"),
        luhn(plain) if plain else 0, sum(not c.isascii() for c in raw), len(parts), len(parts[-1].strip()),
        parts[-1].strip().isalpha(), len(set(digits)), char_class(before[-1:]), char_class(after[:1]),
        *(bool(w.search(before)) for w in WORDS.values()), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after))]


# --- labels -------------------------------------------------------------------------------------------------------
def rewritten(kind: str, raw: str) -> list[tuple[str, bool]]:
    """Other forms of a strict match: loose ones (True) and spoiled ones (False)."""
    digits = "".join(DIGITS.findall(raw))
    if kind == "email":
        name, domain = raw.split("@", 1)
        return [(f"{name} [at] {domain.replace('.', ' [dot] ')}", True), (f"{name}(at){domain}", True),
                (f"{name} at {domain.replace('.', ' dot ')}", True), (f"é{name}ñ@{domain}", True),
                (f"{name} at {domain.replace('.', ' ')}", False), (f"{name}@{domain.replace('.', '')}", False)]
    if kind == "ip":
        parts = raw.split(".")
        return [(".".join(parts).replace(".", "[.]"), True), (" . ".join(parts), True),
                (".".join([parts[0], str(int(parts[1]) + 256), *parts[2:]]), False), (",".join(p + "0" for p in parts), False),
                (".".join([*parts, parts[0], parts[1]]), False), (", ".join(parts), False), (", ".join(parts + parts), False),
                ("-".join(parts), False)]
    if kind == "card":
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [(".".join(fours), True), ("  ".join(fours), True), ("/".join(fours), True), (wrong, False),
                (".".join(wrong[i:i + 4] for i in range(0, len(wrong), 4)), False)]
    own = raw.removeprefix("+")
    return [(own, True), ("00" + own, True), ("+" + own.replace("-", "/"), True), (digits[:8], False), (digits + digits[:5], False),
            (digits[::-1] + digits[0] + digits, False)]


def labelled(text: str) -> Iterator[tuple[list[float], int]]:
    """(features, label) of the proposals of a text and of its strict matches' other forms."""
    strict = base_spans(text)
    for p in proposals(text):
        cover = any(k == p[0] and p[1] <= s and e <= p[2] and 2 * (e - s) >= p[2] - p[1] for k, s, e in strict)
        yield features(text, p), int(cover)
    for kind, s, e in strict:
        left, right = text[max(0, s - 2 * CONTEXT):s], text[e:e + 2 * CONTEXT]
        for form, good in rewritten(kind, text[s:e]):
            window, lo, hi = left + form + right, len(left), len(left) + len(form)
            for p in proposals(window):
                if p[1] < hi and lo < p[2]:
                    same = p[0] == kind and p[1] <= lo + 1 and hi - 1 <= p[2] and p[2] - p[1] <= hi - lo + 2
                    if same or not good:
                        yield features(window, p), int(good and same)


# --- model --------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Model:
    """Trees as node arrays (a leaf's children are itself) and, for each kind, calibration steps and threshold."""
    weights: np.ndarray                 # of each tree
    feature: np.ndarray                 # tree x node
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    steps: dict[str, tuple[np.ndarray, np.ndarray]]    # from these margins on, these probabilities
    thresholds: dict[str, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t, w in enumerate(self.weights):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = np.where(x[np.arange(len(x)), self.feature[t, at]] <= self.split[t, at], self.left[t, at], self.right[t, at])
            total += w * self.value[t, at]
        return total

    def chance(self, x: np.ndarray) -> np.ndarray:
        margin, out = self.margin(x), np.zeros(len(x))
        for i, kind in enumerate(KINDS):
            if kind in self.steps:
                own, (at, chance) = x[:, i] == 1, self.steps[kind]
                out[own] = chance[np.maximum(np.searchsorted(at, margin[own], "right") - 1, 0)]
        return out


IF, PREDICT, TREE = re.compile(r"If \(feature (\d+) <= ([-\d.eE]+)\)"), re.compile(r"Predict: ([-\d.eE]+)"), re.compile(r"Tree \d+ \(weight ([-\d.eE]+)\)")


def read_trees(description: str):
    """Weights and node arrays from a fitted model's description."""
    weights, trees = [], []
    lines = iter(x.strip() for x in description.splitlines())

    def node(tree: list) -> int:
        line, own = next(lines), len(tree)
        if m := IF.match(line):
            tree.append([int(m[1]), float(m[2]), own, own, 0.0])
            tree[own][2] = node(tree)
            next(lines)                                        # Else
            tree[own][3] = node(tree)
        else:
            tree.append([0, 0.0, own, own, float(PREDICT.match(line)[1])])
        return own
    for line in lines:
        if m := TREE.match(line):
            weights.append(float(m[1]))
            trees.append([])
            node(trees[-1])
    size = max(map(len, trees))
    full = np.array([t + [[0, 0.0, i, i, 0.0] for i in range(len(t), size)] for t in trees])
    return np.array(weights), full[:, :, 0].astype(int), full[:, :, 1], full[:, :, 2].astype(int), full[:, :, 3].astype(int), full[:, :, 4]


def isotonic(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step fit of the labels over the margins: pooled neighbours."""
    pools: list[list[float]] = []                              # first margin, rows, positives
    for m in np.unique(margin):
        own = label[margin == m]
        pools.append([m, len(own), own.sum()])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, n, p = pools.pop()
            pools[-1][1] += n
            pools[-1][2] += p
    return np.array([p[0] for p in pools]), np.array([p[2] / p[1] for p in pools])


def sample(docs: DataFrame, key: str = "doc_id", rows: int = SAMPLE_DOCS, ranges: int = SAMPLE_RANGES) -> DataFrame:
    """About ``rows`` rows, in ranges spread evenly over an integer key (conditions that Parquet scans use)."""
    lo, hi = docs.agg(F.min(key), F.max(key)).first()
    if lo is None or hi - lo < rows:
        return docs
    k, width, step = F.col(key), rows // ranges, (hi - lo + 1) / ranges
    keep = F.lit(False)
    for i in range(ranges):
        keep = keep | k.between(lo + int(i * step), lo + int(i * step) + width - 1)
    return docs.filter(keep)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", trees: int = TREES) -> Model | None:
    """Trees fitted on a bounded sample of documents; None where it does not hold both labels."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(x, y, zlib.crc32(str(k).encode()) % HELD_OUT == 0, zlib.crc32(repr((k, i, x)).encode()))
                   for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                   for i, (x, y) in enumerate(labelled(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.list_(pa.float64())), pa.array([r[1] for r in out], pa.float64()),
                                              pa.array([r[2] for r in out], pa.bool_()), pa.array([r[3] for r in out], pa.int64())],
                                             names=["x", "label", "held", "mark"])
    found = materialize(docs.select(key, text).mapInArrow(rows, "x array<double>, label double, held boolean, mark bigint")
                        .orderBy("mark", "label", "x").limit(TRAIN_ROWS).coalesce(1), "pii-rows")
    counts = {(r["held"], r["label"]): r["count"] for r in found.groupBy("held", "label").count().collect()}
    if min((counts.get((h, y), 0) for h in (True, False) for y in (0.0, 1.0))) < LEAST:
        return None
    few = min(counts[False, 0.0], counts[False, 1.0])
    train = found.filter("not held").withColumn("w", few / F.when(F.col("label") == 1, counts[False, 1.0]).otherwise(counts[False, 0.0])) \
        .select(array_to_vector("x").alias("features"), "label", "w")
    fitted = GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=STEP, seed=SEED, weightCol="w", minInstancesPerNode=3).fit(train)
    nodes = read_trees(fitted.toDebugString)
    held = found.filter("held").select("x", "label").toPandas()        # at most TRAIN_ROWS rows
    x, y = np.array(held["x"].tolist()), held["label"].to_numpy()
    margin = Model(*nodes, {}, {}).margin(x)
    steps, thresholds = {}, {}
    for i, kind in enumerate(KINDS):
        own = x[:, i] == 1
        if own.any():
            at, chance = steps[kind] = isotonic(margin[own], y[own])
            good = chance >= PRECISION
            if good.any() and y[own & (margin >= at[good][0])].sum() >= LEAST:
                thresholds[kind] = float(chance[good][0])
    return Model(*nodes, steps, thresholds)


def chosen(text: str, model: Model | None) -> list[tuple[str, int, int, bool, float]]:
    """All spans of a text: strict matches, and the proposals that the model takes, best first, without overlaps
    among the added ones of a kind; by start, then kind."""
    strict = base_spans(text)
    out = [(*s, True, 1.0) for s in strict]
    known = set(strict)
    wide = sorted({p for p in proposals(text) if p not in known}) if model and model.thresholds else []
    if wide:
        chance = model.chance(np.array([features(text, p) for p in wide]))
        taken: dict[str, list[tuple[int, int]]] = {}
        for c, (kind, s, e) in sorted(zip(chance.tolist(), wide, strict=True), key=lambda x: (-x[0], x[1][1], -x[1][2])):
            if c >= model.thresholds.get(kind, 2.0) and all(e <= a or b <= s for a, b in taken.setdefault(kind, [])):
                taken[kind].append((s, e))
                out.append((kind, s, e, False, c))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``_row`` (the row of ``docs``) and ``spans`` (code points, end exclusive; ``base``: a strict match)."""
    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "base", "score")
        return pd.Series([[dict(zip(names, s, strict=True)) for s in chosen(t or "", model)] for t in texts])
    rows = as_row(docs)
    return rows.select(ROW, spans(F.col(f"{ROW}.`{text}`")).alias("spans"))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` (of ``find``) with ``redacted``: each run of overlapping spans replaced by its first kind in brackets."""
    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, spans, strict=True):
            pieces, at = [], 0
            for s in own if t else ():
                if s["start"] >= at:
                    pieces += [t[at:s["start"]], f"[{s['kind'].upper()}]"]
                at = max(at, s["end"])
            out.append(t and "".join(pieces) + t[at:])
        return pd.Series(out, dtype=object)
    return found.withColumn("redacted", replaced(F.col(f"{ROW}.`{text}`"), "spans"))
