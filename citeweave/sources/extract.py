"""Article extraction from stored result pages.

The collectors drive a browser over search-result pages and read repeated
result containers with CSS selectors.  Here the pages are already stored
(``pages(page_id, url, html)``) and the same selectors (tags, classes,
descendants, alternatives) are applied to them in native expressions, no Python
UDF: one ``regexp_extract_all`` cuts a page into comments, scripts, tags and
texts, and an element runs from its tag to the end tag that balances it, found
by folding a depth counter over the later tags of its name.  Containers may
nest: an inner result is an article of its own and the outer one keeps its tail.
Attributes may be quoted either way or not at all, names are read in any case,
and a text is what a browser shows: comments, scripts and styles are left out
and character references are decoded.

A page's work grows with its tags times its matching elements.  Pages stored in
fewer splits than the cluster has cores are spread round-robin first
(``session.spread``), since the work is CPU-bound per page.

Per field, as in the collectors: the first element in the container that
matches; a missing one gives the field's default (``Unknown Title``,
``Unknown``, a per-source date sentinel), a present but empty one ``''``.  Rows
whose title is ``Unknown Title`` are dropped; blank titles are kept.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MISSING_ABSTRACT, UNKNOWN_AUTHORS, UNKNOWN_DATE, UNKNOWN_DATE_SHORT, UNKNOWN_TITLE
from ..functions.years import year_in_text
from ..session import spread

# Page id times this stride plus the container's position gives the ingest id.
CONTAINER_STRIDE = 1 << 16


@dataclass(frozen=True)
class ExtractRule:
    """How to read one source's result pages.

    ``url_pattern`` selects the pages of the source; ``container``, ``title`` and ``authors`` are CSS selectors
    (``tag.class``, descendants, commas).  ``source``/``journal`` of ``None`` take the page's host name.
    """
    name: str
    url_pattern: str
    container: str
    title: str
    authors: str
    source: str | None
    journal: str | None
    date_default: str


# --- fixed values: the collectors' selectors ---------------------------------
ACM_RULE = ExtractRule(
    "acm", r"^https?://dl\.acm\.org/", ".issue-item, .search-result__item", ".issue-item__title a, .hlFld-Title a",
    "ul.rlist--inline, .issue-item__detail .rlist--inline", "ACM Digital Library", "ACM", UNKNOWN_DATE)
IEEE_RULE = ExtractRule(
    "ieee", r"^https?://ieeexplore\.ieee\.org/", "div.List-results-items .xpl-results-item, div.result-item",
    "h3.text-md-md-lh a, h2 a, .result-item-title a", "p.author, .xpl-authors-name-list", "IEEE Xplore", "IEEE", UNKNOWN_DATE)
SCIENCEDIRECT_RULE = ExtractRule(
    "sciencedirect", r"^https?://(?:www\.)?sciencedirect\.com/", "div.result-item-content", "a.result-list-title-link, h2",
    "ol.authors-list, div.Authors", "ScienceDirect", "ScienceDirect Journal", UNKNOWN_DATE_SHORT)
# Any other page: each <article> is one result, its <h1> the title.
GENERIC_RULE = ExtractRule("web", r"^https?://", "article", "h1", ".author, .authors", None, None, UNKNOWN_DATE)
DEFAULT_RULES = [ACM_RULE, IEEE_RULE, SCIENCEDIRECT_RULE, GENERIC_RULE]

# --- fixed values: elements without an end tag, and elements whose content is no text
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
HIDDEN = ["script", "style", "template", "noscript"]

_INSIDE = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""            # of a tag, after its name
TOKEN = (rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(HIDDEN)})(?=[\s/>]){_INSIDE}.*?(?:</\1\s*>|\z)"
         rf"|</?[a-z]{_INSIDE}|</?[a-z][^>]*>|<[!?/][^>]*>|[^<]++|<")
NAME = r"^</?([a-zA-Z][^\s/>]*)"


def tokens(html: Column) -> Column:
    """A page as (at, raw, name, close): tags have a lower-case name, texts ``''``, comments and hidden elements ``!``."""
    def kind(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, NAME, 1))
        return (F.when(~t.startswith("<") | (t == "<"), "").when((name == "") | (name.isin(HIDDEN) & ~t.startswith("</")), "!").otherwise(name))
    return F.transform(F.regexp_extract_all(html, F.lit(TOKEN), 0), lambda t, i: F.struct(
        i.alias("at"), t.alias("raw"), kind(t).alias("name"), t.startswith("</").alias("close")))


def has_class(name: str) -> str:
    """Regex for a ``class`` attribute that holds ``name`` as a whole word, in any quoting."""
    c = re.escape(name)
    return (rf"""\s(?i:class)\s*=\s*(?:"(?:[^"]*\s)?{c}(?:\s[^"]*)?"|'(?:[^']*\s)?{c}(?:\s[^']*)?'|{c}(?=[\s/>]))""")


SIMPLE = "struct<tag:string,classes:string>"
SELECTOR = f"array<struct<outer:array<{SIMPLE}>,last:{SIMPLE}>>"
NO_CLASS = ""                    # matches every tag


def _simple(text: str) -> dict:
    """One ``tag.class.class`` as a tag (or none) and one pattern over an opening tag."""
    tag, *classes = text.split(".")
    return {"tag": tag.lower() or None, "classes": "".join(f"(?=(?s:.)*{has_class(c)})" for c in classes) or NO_CLASS}


def _selectors(rules: list[ExtractRule], field: str) -> Column:
    """The rules' CSS selectors of a field, as data: one expression then serves all rules."""
    parsed = [[{"outer": [_simple(o) for o in outer], "last": _simple(last)} for *outer, last in map(str.split, getattr(r, field).split(","))]
              for r in rules]
    return F.from_json(F.lit(json.dumps(parsed)), f"array<{SELECTOR}>")


def _elements(tags: Column, simple: Column, size: Column) -> Column:
    """(start, stop) of the elements of a simple selector: token positions of the tag and of the end tag that balances
    it (one past the page's last without one).  A paragraph also ends where the next one begins."""
    def stop(o: Column) -> Column:
        later = F.filter(tags, lambda t: (t["name"] == o["name"]) & (t["at"] > o["at"]))
        start = F.struct(F.lit(1).alias("depth"), F.lit(None).cast("int").alias("stop"))

        def step(s: Column, t: Column) -> Column:
            depth = F.when((o["name"] == "p") | t["close"], s["depth"] - 1).otherwise(s["depth"] + 1)
            # the fold goes on after the end: what was found stays
            return F.when(s["stop"].isNotNull(), s).otherwise(F.struct(depth.alias("depth"), F.when(depth == 0, t["at"]).alias("stop")))
        return F.when(o["name"].isin(VOID), o["at"]).otherwise(F.coalesce(F.aggregate(later, start, step)["stop"], size))
    opens = F.filter(tags, lambda t: ~t["close"] & (simple["tag"].isNull() | (t["name"] == simple["tag"])) & F.rlike(t["raw"], simple["classes"]))
    return F.transform(opens, lambda o: F.struct(o["at"].alias("start"), stop(o).alias("stop")))


def _inside(inner: Column, outer: Column) -> Column:
    return F.filter(inner, lambda e: F.exists(outer, lambda x: (x["start"] < e["start"]) & (e["start"] < x["stop"])))


def select(tags: Column, size: Column, selector: Column) -> Column:
    """(start, stop) of the page's elements that match a selector (``SELECTOR``), in page order.

    Each outer element has to hold the match; with two or more of them their own order is not asked."""
    def one(s: Column) -> Column:
        return F.aggregate(s["outer"], _elements(tags, s["last"], size), lambda own, o: _inside(own, _elements(tags, o, size)))
    return F.sort_array(F.array_distinct(F.flatten(F.transform(selector, one))))


# --- character references: Python's own table of HTML5 names (``html.entities``), with the older names that need no
# semicolon; numbers by code point, with U+FFFD for what is none
REFERENCE = r"&(?:#[0-9]{1,8};?|#[xX][0-9a-fA-F]{1,8};?|[a-zA-Z][a-zA-Z0-9]*;|(?:%s)(?![a-zA-Z0-9=;]))" % "|".join(
    sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))


COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\u00a0", "&#39;": "'"}      # looked at first


def _names() -> Column:
    """The table of names as one map literal (a string that Spark folds)."""
    return F.str_to_map(F.lit("\x01".join(f"&{n}\x02{ch}" for n, ch in html5.items())), F.lit("\x01"), F.lit("\x02"))


def _referred(r: Column) -> Column:
    """The character of one reference; a name that is none stays."""
    number = (F.when(r.rlike("^&#[xX]"), F.conv(F.regexp_extract(r, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10))
              .otherwise(F.regexp_extract(r, "^&#([0-9]+)", 1)).try_cast("bigint"))
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    common = None
    for ref, ch in COMMON.items():
        common = F.when(r == ref, ch) if common is None else common.when(r == ref, ch)
    return (common.when(r.startswith("&#"), F.when(valid, char).otherwise("\ufffd"))
            .otherwise(F.coalesce(F.try_element_at(_names(), r), r)))


def decoded(text: Column) -> Column:
    """A text with its character references replaced."""
    pieces, refs = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), 0)
    return F.when(~text.contains("&"), text).otherwise(
        F.array_join(F.zip_with(pieces, refs, lambda p, r: F.concat(p, F.when(r.isNull(), "").otherwise(_referred(r)))), ""))


def visible_text(toks: Column) -> Column:
    """Rendered text of tokens: tags become blanks, references are decoded, whitespace runs collapsed, ends stripped,
    no blank before punctuation."""
    t = F.array_join(F.transform(toks, lambda x: F.when(x["name"] == "", decoded(x["raw"])).otherwise(" ")), "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s\u00a0]+", " "), r"^ | $", "")
    return F.regexp_replace(t, r" ([,.;:!?])", "$1")


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def _pick(rule_idx: Column, values: list[Column]) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(rule_idx == i, v) if expr is None else expr.when(rule_idx == i, v)
    return expr


def _content(element: Column) -> Column:
    """The tokens inside an element of the row's page."""
    return F.slice("toks", element["start"] + 2, F.greatest(element["stop"] - element["start"] - 1, F.lit(0)))


def _field(selector: Column, default: str) -> Column:
    """Visible text of the container's first element of the selector; ``default`` if there is none."""
    found = _inside(select(F.col("tags"), F.size("toks"), selector), F.array("c"))
    first = F.get(found, F.lit(0))
    return F.when(first.isNull(), default).otherwise(visible_text(_content(first)))


def extract_articles(pages: DataFrame, rules: list[ExtractRule] = DEFAULT_RULES) -> DataFrame:
    """Articles of the result containers of every page: the collection schema plus ``ingest_id``."""
    url = F.col("url")
    idx = None
    for i, r in enumerate(rules):
        idx = F.when(url.rlike(r.url_pattern), i) if idx is None else idx.when(url.rlike(r.url_pattern), i)
    host = F.regexp_extract(url, HOST, 1)
    rule = F.col("rule")
    cut = (spread(pages.select("page_id", "url", "html", idx.alias("rule"))).where(rule.isNotNull())
           .select("page_id", "url", "rule", tokens(F.col("html")).alias("toks"))
           .withColumn("tags", F.filter("toks", lambda x: (x["name"] != "") & (x["name"] != "!"))))
    containers = select(F.col("tags"), F.size("toks"), F.get(_selectors(rules, "container"), rule))
    found = cut.select("page_id", "url", "rule", "toks", "tags", F.posexplode(containers).alias("pos", "c"))
    out = found.select(
        (F.col("page_id") * CONTAINER_STRIDE + F.col("pos")).cast("bigint").alias("ingest_id"),
        _field(F.get(_selectors(rules, "title"), rule), UNKNOWN_TITLE).alias("title"),
        _field(F.get(_selectors(rules, "authors"), rule), UNKNOWN_AUTHORS).alias("authors"),
        visible_text(_content(F.col("c"))).alias("text"),
        _pick(rule, [F.lit(r.source) if r.source else host for r in rules]).alias("source"),
        _pick(rule, [F.lit(r.journal) if r.journal else host for r in rules]).alias("journal"), "rule")
    out = out.select("ingest_id", "title", "authors",
                     _pick(rule, [year_in_text(F.col("text"), r.date_default) for r in rules]).alias("date_pub"),
                     "source", "journal", F.lit(MISSING_ABSTRACT).alias("abstract_"))
    return out.where(F.col("title") != UNKNOWN_TITLE)
