"""Quality rules: a threshold table compiled into one projection of native columns.

A rule is a row of ``RULES``: a measure (a column expression over the base
measures), an inclusive minimum and/or maximum.  ``compile_rules`` turns the
table into column expressions; ``measure`` adds the measures; ``verdict`` adds
``base_failed`` and ``kept``.  No user function runs: words, lines and windows
are arrays inside the row, so a document never leaves its row and nothing is
shuffled, whatever the source sizes are.

Cases: a null or empty text has no words, zero measures and fails the base
rule.  Very long texts are measured whole.  Repeated rows are judged one by
one.  Other columns of the input travel in a struct and cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"                       # the input row, whole
WORD_SPLIT = r"[\x20\x09-\x0D]+"   # fixed by the contract
SYMBOLS = r"[#*$%&|<>]"            # fixed by the contract
WINDOW = 5                         # words of a repeat window, fixed by the contract
MIN_WORDS = 10                     # base rule, fixed by the contract
MAX_REPEAT_PCT = 20                # base rule, fixed by the contract

# Common function words of the four languages of the collection.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "on", "as", "by", "it", "are", "be",
    "le", "la", "les", "de", "des", "et", "un", "une", "en", "que", "qui", "du", "est", "pour", "dans", "par",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "im", "ein", "eine", "auf", "nicht",
    "el", "los", "las", "y", "se", "su", "con", "para", "no", "lo", "al", "del",
)


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; a bound of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


# Ratios over the measures of ``measure``; a document with no words has been
# failed by the base rule before, so the divisions guard only against zero.
RULES = (
    Rule("word_length", "word_chars / greatest(n_words, 1)", 2.0, 20.0),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", None, 0.1),
    # one more than seen: a text of a few words may well hold no stop word
    Rule("stop_words", "(n_stop + 1) / greatest(n_words, 1)", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.4),
    Rule("ellipsis_lines", "n_ellipsis / greatest(n_lines, 1)", None, 0.3),
    Rule("bullet_lines", "n_bullets / greatest(n_lines, 1)", None, 0.9),
)


def measure(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``_row`` (the input row as a struct) and the measures, all bigint.

    ``n_repeat_words`` counts the words lying in a 5-word window that occurs
    at least twice: window strings with their positions are sorted inside the
    row, equal neighbours give the start positions, and each start covers 5
    words or as many as remain before the next start.
    """
    t = F.coalesce(F.col(f"{ROW}.`{text}`"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))
    df = df.select(ROW, F.filter(F.split(t, WORD_SPLIT), lambda w: w != "").alias("words"),
                   F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.select(ROW, "words", "lines",
                   F.when(F.size("words") >= WINDOW, F.transform(
                       F.sequence(F.lit(0), F.size("words") - F.lit(WINDOW)),
                       lambda i: F.concat_ws(" ", *[F.get("words", i + k) for k in range(WINDOW)])))
                   .otherwise(F.array().cast("array<string>")).alias("wins"))
    df = df.select(ROW, "words", "lines",
                   F.when(F.size(F.array_distinct("wins")) < F.size("wins"),
                          F.array_sort(F.transform("wins", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
                   .alias("order"))
    starts = F.array_sort(F.filter(F.transform("order", lambda s, k: F.when(
        (s["w"] == F.get("order", k - 1)["w"]) | (s["w"] == F.get("order", k + 1)["w"]), s["i"])),
        lambda i: i.isNotNull()))
    df = df.select(ROW, "words", "lines", F.when(F.col("order").isNotNull(), starts).alias("starts"))
    covered = F.aggregate(F.transform("starts", lambda s, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        ROW,
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*stop_words))).cast("bigint").alias("n_stop"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("bigint").alias("n_ellipsis"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣·]"))).cast("bigint").alias("n_bullets"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of the names of the violated rules, as one expression."""
    def broken(r: Rule) -> Column:
        m, bad = F.expr(r.measure), F.lit(False)
        if r.low is not None:
            bad = bad | (m < F.lit(r.low))
        if r.high is not None:
            bad = bad | (m > F.lit(r.high))
        return F.when(bad, F.lit(r.name))
    return F.filter(F.array(*[broken(r) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")


def verdict(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``measure`` plus base_failed, failed_rules and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    df = measure(docs, text).withColumns({"base_failed": base, "failed_rules": compile_rules(rules)})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    # the verdict is tied to a row number, so that the filter is not pushed below the projections: there it
    # would repeat the window arrays inside each other's lambdas
    held = verdict(docs, rules, text).select(ROW, F.when(F.monotonically_increasing_id() >= 0, F.col("kept")).alias("_keep"))
    return held.filter("_keep").select(f"{ROW}.*")
