"""Fixed values.

Everything in this module is a value that results depend on: sentinels the
collectors write, the ordered topic rules of the dashboard, and Spark's default English stop-word
list (``StopWordsRemover.loadDefaultStopWords("english")``), written out so
that the SQL oracle can inline the same list.
"""

from __future__ import annotations

# --- fixed values: sentinels written by the article collectors -------------
UNKNOWN_TITLE = "Unknown Title"
UNKNOWN_AUTHORS = "Unknown"
UNKNOWN_DATE = "Unknown Date"
UNKNOWN_DATE_SHORT = "Unknown"
MISSING_ABSTRACT = "N/A"

# --- fixed values: patterns ------------------------------------------------
EXACT_YEAR = r"^\d{4}$"                    # trends keeps only exact years
# Word boundaries are spelled out as Unicode classes (letters, digits, "_"),
# the meaning of ``\b`` in the collectors' Python regexes; the same pattern
# then reads alike in Java and RE2.
NOT_WORD = r"[^\p{L}\p{N}_]"
YEAR_IN_TEXT = r"(?:^|" + NOT_WORD + r")((?:19|20)\d{2})(?:" + NOT_WORD + r"|$)"   # group 1
CLEAN_YEAR = r"20\d{2}"                    # warehouse year, no word boundary
CLEAN_YEAR_DEFAULT = 2024
TRAILING_COUNTRY = r",\s([A-Za-z]+)$"      # last one-word country of an affiliation
MIN_ABSTRACT_CHARS = 20                    # valid abstracts are longer than this
MIN_AUTHOR_CHARS = 2                       # graph keeps names longer than this

# --- fixed values: ordered topic rules (first match wins) -------------------
TOPIC_RULES = [
    ("AI & Blockchain", ["ai", "learning"]),
    ("Security & Privacy", ["security", "privacy"]),
    ("IoT & Edge", ["iot", "edge"]),
    ("Healthcare", ["health"]),
    ("Supply Chain", ["supply"]),
    ("DeFi & Finance", ["finance", "defi"]),
]
TOPIC_DEFAULT = "General Blockchain"

# --- fixed values: quality classes of the warehouse, best first --------------
QUARTILES = ["Q1", "Q2", "Q3", "Q4"]

# --- fixed values: text model settings --------------------------------------
VOCAB_SIZE = 1000
MIN_DF = 1
LDA_K = 5
LDA_MAX_ITER = 5
LDA_SEED = 42
TOPIC_TERMS = 5

# --- fixed values: Spark's default English stop words (181, in list order) ---
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is
are was were be been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how all any both each few
more most other some such no nor not only own same so than too very s t can will just don should now i'll
you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()
