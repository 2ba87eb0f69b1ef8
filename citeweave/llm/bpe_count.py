"""Token counts by heap-and-linked-list byte-pair merging, without emitting ids.

A pre-token's bytes are the initial symbols, the last one carrying the
end-of-word suffix.  All adjacent pairs that have a merge rank go on a heap;
the lowest (rank, position) is popped again and again, its two symbols become
one in a linked list, and the pairs with the new neighbours are pushed.  The
count is the number of initial symbols less the number of merges.  A pre-token
of n bytes costs O(n log n), so a text without any white space is no problem.

Merge table, normaliser and splitting pattern come from the tokenizer file.
Counts of pre-tokens seen before are kept in a bounded table per worker; this
table holds nothing that results depend on.

Cases: a null or empty text counts 0 tokens; special strings inside a text
count one token each, as the library does by default; every row is counted by
itself, so skew, repeats and clashing columns do not matter.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MEMO_ENTRIES = 400_000          # pre-tokens remembered per worker process
MEMO_BYTES = 64                 # longer pre-tokens are counted anew each time
_LOADED: dict[str, PairCounter] = {}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def latin_pattern(latin: str, digits: str, one_digit: bool) -> re.Pattern:
    """The file's pattern for texts up to U+017F, whose lower case stays there, as a plain ``re`` pattern."""
    white = r"\t\n\x0b\x0c\r \x85\xa0"
    word, num = "A-Za-z" + re.escape(latin), "0-9" + digits
    return re.compile(rf"'(?:[stmd]|re|ve|ll)|[{word}]+|[{num}]{'' if one_digit else '+'}|[^{white}{word}{num}]+")


class PairCounter(dict):
    """pre-token -> number of tokens (a dict that computes what it misses)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rank = {tuple(p if isinstance(p, list) else p.split(" ")): i for i, p in enumerate(spec["model"]["merges"])}
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        tok = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tok.normalizer, tok.pre_tokenizer
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(re.escape(s) for s in special)) if special else None
        chars = [chr(c) for c in range(0x80, 0x180)]
        self.fast = latin_pattern("".join(c for c in chars if regex.match(r"\p{L}", c)),
                                  "".join(c for c in chars if regex.match(r"\p{N}", c)), True)
        self.beyond = re.compile("[^\x00-\u017f]")
        self.stand_in = {s: b for b, s in enumerate(self.symbols)}

    def __missing__(self, piece: str) -> int:
        raw = piece.encode("utf-8")
        n = self.merged(raw)
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = n
        return n

    def merged(self, raw: bytes) -> int:
        """Symbols left of ``raw`` after all merges."""
        sym: list[str | None] = [self.symbols[b] for b in raw]
        n = len(sym)
        if not n:
            return 0
        sym[-1] += self.suffix
        rank, last = self.rank, n - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(last) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            if sym[i] is None or (j := after[i]) > last or rank.get((sym[i], sym[j])) != r:
                continue                               # one of the two has been merged since
            sym[i], sym[j] = sym[i] + sym[j], None
            left -= 1
            k = after[i] = after[j]
            if k <= last:
                before[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def count(self, text: str) -> int:
        if not text:
            return 0
        n, parts = 0, [text]
        if self.special is not None and (found := self.special.findall(text)):
            n, parts = len(found), self.special.split(text)
        for part in parts:
            if self.beyond.search(part) is None:
                n += sum(map(self.__getitem__, self.fast.findall(part.lower())))
            else:                                      # normalise and split as the file says
                for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    n += self.merged(bytes(self.stand_in[c] for c in piece))
        return n


def counter(path: str) -> PairCounter:
    if path not in _LOADED:
        _LOADED[path] = PairCounter(path)
    return _LOADED[path]


def n_tokens(text: Column, path: str) -> Column:
    """Token count of a text column."""
    @F.pandas_udf(LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for s in batches:
            yield pd.Series([c.count(t) if t else 0 for t in s], dtype="int64")
    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` in ``_row`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``)."""
    t = F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return df.select("_row", F.octet_length(t).cast("bigint").alias("n_bytes"), n_tokens(t, path).alias("n_tokens")) \
        .withColumn("over_limit", F.col("n_tokens") > limit)
