"""Rule-based topic label (P10) as one native CASE expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NOT_WORD, TOPIC_DEFAULT, TOPIC_RULES


def whole_word_pattern(word: str) -> str:
    return f"(?:^|{NOT_WORD}){word}(?:{NOT_WORD}|$)"


def topic_label(title: Column, rules=TOPIC_RULES, default: str = TOPIC_DEFAULT,
                whole_word: bool = False) -> Column:
    """First rule whose keyword occurs in the lower-cased title, else ``default``.

    By default keywords match as substrings, as in the dashboard ("ai" hits
    "blockchain"); ``whole_word=True`` matches a keyword only between
    non-word characters (Unicode letters, digits and ``_`` are word characters).
    A NULL title falls through to the default.
    """
    t = F.lower(title)
    expr = None
    for label, words in rules:
        cond = None
        for w in words:
            hit = t.rlike(whole_word_pattern(w)) if whole_word else t.contains(w)
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))
