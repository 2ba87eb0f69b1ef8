"""Main text of web pages, by a site style tree.

The DOMs of a host are merged: block elements with one path of tags and classes
are one style node.  A leaf is a text of an element (inline elements and line breaks
are part of it); of the m pages of the host with its node, n show that text there, and
the entropy of that to the base of m makes it worth 1 - log n / log m: 0 where all
pages show it, 1 where a single one does.  The importance of an element is composed
upwards, (1 - G^l) of its presentation, the entropy of its l distinct sequences of
child tags, with G^l of the mean of its children and texts.  A branch is noise if it
and everything in it is below ``LOW``; noise is removed.

What a page says about itself is a prior: navigation, footers, forms, adverts,
notices, comments and the like are known by tag, role, class or id and are no part
of the tree; where a page marks an article or main part that holds text, only that
part is, and its branches go below ``LOW_MARKED``.  If more than half the words of a
marked part would go, or all of an unmarked page, its pages are copies of each other,
which no tree can tell from noise, and the text stays whole.

Scale: style nodes are counted per batch of pages and then by grouped sums, so a
host with a third of all pages costs few rows; the tree (a row per host and
path, with the texts below ``LOW`` there, of each more than m^(1 - LOW) pages) is
broadcast up to ``TREE_ROWS`` rows and texts and joined to the pages' paths beyond.  Pages are parsed where they are read, without recursion.

Cases: null or empty html gives an empty text, a null url an empty host; unclosed
and stray tags are repaired as browsers do for paragraphs and list items; rows
that repeat are extracted one by one; other columns travel in a struct.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_row, materialize

GAMMA = 0.9                        # weight of a node's children falls with their number as GAMMA ** l
LOW = 0.2                          # branches of less importance go
LOW_MARKED = 0.05                  # of those in a part that the page marks
MIN_PAGES = 5                      # pages of a host with a node, below which its importance is 1
TREE_ROWS = 200_000                # style nodes and their noise texts to broadcast, at most
KEEP, DROP, MAIN = 0, 1, 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|title"
DEPTH = 512                        # deeper elements lie in the one of this depth, as in browsers
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
        "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("datalist",))}
DROP_TAGS = frozenset("nav footer aside form button head dialog menu select svg object".split())
ARTICLE_DROP = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related".split())
PAGE_FLAG = re.compile(r"\b(?:has|with|no|is)[-_]\S+")
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar footer "
    "header masthead banner cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus reply replies "
    "social share sharing related recommended breadcrumb breadcrumbs subscribe subscription newsletter signup login search widget "
    "toolbar pagination pager copyright legal disclaimer form skip".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?P<rattr>(?>[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?>[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", re.I)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def key(s: str) -> int:
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """A page's nodes in document order, and its texts as (node, text); text None ends a block."""

    def __init__(self, source: str):
        self.parent, self.tag, self.kind, self.path, self.block, self.inside = [-1], ["#"], [KEEP], [0], [0], [False]
        self.texts: list[tuple[int, str | None]] = []
        stack = [0]
        for m in TOKEN.finditer(source):
            if (text := m["text"]) is not None:
                self.texts.append((stack[-1], entities.unescape(text) if "&" in text else text))
            elif m["tag"]:
                tag = m["tag"].lower()
                if m["end"]:
                    self.close(tag, stack)
                else:
                    self.open(tag, m["attr"] or "", stack)

    def open(self, tag: str, attr: str, stack: list[int]) -> None:
        if tag in ("html", "body") and tag in [self.tag[i] for i in stack[:8]]:
            return
        if tag in CLOSES_P:
            self.shut(("p",), CLOSES_P - {"p"}, stack)
        if tag in SAME:
            tags, border = SAME[tag]
            self.shut(tags.split(), border, stack)
        if tag == "body":
            del stack[1:]
        block = tag not in INLINE
        if block:
            self.texts.append((stack[-1], None))
        given = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attr)} if "=" in attr else {}
        names = f"{given.get('class', '')} {given.get('id', '')}"
        own = tag + ("." + ".".join(sorted(given["class"].split())) if given.get("class") else "")
        self.parent.append(stack[-1])
        self.tag.append(tag)
        self.path.append(key(f"{self.path[stack[-1]]}>{own}") if block else self.path[stack[-1]])
        self.block.append(len(self.tag) - 1 if block else self.block[stack[-1]])
        self.kind.append(self.judge(tag, names, given, attr, self.inside[stack[-1]]))
        self.inside.append(self.inside[stack[-1]] or self.kind[-1] == MAIN)
        if tag not in VOID and not attr.endswith("/") and len(stack) < DEPTH:
            stack.append(len(self.tag) - 1)

    def judge(self, tag: str, names: str, given: dict, attr: str, inside: bool) -> int:
        """What the tag, its role and its names say; ``inside``: of a main part."""
        role = given.get("role", "").lower()
        if tag in DROP_TAGS or role in DROP_ROLES or given.get("aria-hidden") == "true" or HIDDEN.search(given.get("style", "")) \
                or "hidden" in attr and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attr):
            return DROP
        if tag == "header" and not inside:
            return DROP
        own = MAIN if tag in ("article", "main") or role in ("main", "article") else KEEP
        if names.strip() and tag not in ("html", "body"):
            words = {w.lower() for w in PARTS.findall(PAGE_FLAG.sub("", names))} - ({"header", "banner"} if inside else set())
            if words & (ARTICLE_DROP if own == MAIN else DROP_WORDS):
                return DROP
        return own

    def close(self, tag: str, stack: list[int]) -> None:
        if tag == "br":
            self.texts.append((stack[-1], None))
            return
        for at in range(len(stack) - 1, 0, -1):
            if self.tag[stack[at]] == tag:
                if tag not in INLINE:
                    self.texts.append((stack[at], None))
                del stack[at:]
                return
            if tag in INLINE and self.tag[stack[at]] not in INLINE:
                return                                     # an inline end does not end a block

    def shut(self, tags, border, stack: list[int]) -> None:
        """Ends an open element of ``tags`` unless one of ``border`` stands between."""
        for at in range(len(stack) - 1, 0, -1):
            if self.tag[stack[at]] in tags:
                self.texts.append((stack[at], None))
                del stack[at:]
                return
            if self.tag[stack[at]] in border:
                return

    def part(self) -> tuple[list[bool], list[tuple[int, str]], bool]:
        """Flags of the nodes that count, their texts as (element, text), and whether the page marks them as main."""
        size = len(self.tag)
        gone, main = [False] * size, [False] * size
        for i in range(1, size):
            p = self.parent[i]
            gone[i] = gone[p] or self.kind[i] == DROP
            main[i] = main[p] or (self.kind[i] == MAIN and not gone[i])
        marked = [m and not g for m, g in zip(main, gone, strict=True)]
        if leaves := self.leaves(marked):
            return marked, leaves, True
        keep = [not g for g in gone]
        return keep, self.leaves(keep), False

    def leaves(self, keep: list[bool]) -> list[tuple[int, str]]:
        """(element, text) in document order; the lines of an element that stand together are one text."""
        out: list[tuple[int, str]] = []
        part, at = [], 0
        for i, t in [*self.texts, (0, None)]:
            if t is None:
                if words := "".join(part).split():
                    text = " ".join(words)
                    if out and out[-1][0] == at:
                        out[-1] = at, f"{out[-1][1]} {text}"
                    else:
                        out.append((at, text))
                part = []
            elif keep[i]:
                if not part or not "".join(part).strip():
                    at = self.block[i]
                part.append(t)
        return out

    def children(self, keep: list[bool]) -> dict[int, list[int]]:
        """The child elements of each element that counts and has any; inline elements are not told apart from it."""
        out: dict[int, list[int]] = {}
        for i in range(1, len(self.tag)):
            if keep[i] and self.block[i] == i:
                out.setdefault(self.block[self.parent[i]], []).append(i)
        return out


def style_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, what, value, n): pages of the batch with a node (what 0), a text (1), a sequence of children (2)."""
    for b in batches:
        found: Counter = Counter()
        for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            page, host = Page(source or ""), host_of(url)
            paths = page.path
            keep, leaves, _ = page.part()
            rows = {(host, p, 0, 0) for p, k in zip(paths, keep, strict=True) if k} | {(host, paths[i], 0, 0) for i, _ in leaves}
            rows |= {(host, paths[i], 1, key(t)) for i, t in leaves}
            rows |= {(host, paths[i], 2, key(" ".join(dict.fromkeys(page.tag[c] for c in own)))) for i, own in page.children(keep).items() if keep[i]}
            found.update(rows)
        if found:
            host, path, what, value = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(path), pa.array(what, pa.int32()), pa.array(value),
                                              pa.array(list(found.values()), pa.int64())], names=["host", "path", "what", "value", "n"])


def style_tree(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, path, pages, presentation, styles, texts) of every style node that MIN_PAGES pages have: the entropy of its
    sequences of children and their number, and the texts that are worth less than LOW there, as value -> pages."""
    n = pages.select(url, html).mapInArrow(style_counts, "host string, path bigint, what int, value bigint, n bigint") \
        .groupBy("host", "path", "what", "value").agg(F.sum("n").alias("n"))
    # few pages show a text that others do not: such texts are worth 1 and need not be kept
    n = materialize(n.filter(f"what <> 1 OR n >= {MIN_PAGES ** (1 - LOW)}"), "html-styles")
    x = F.col("n") * F.log("n")
    nodes = n.filter("what <> 1").groupBy("host", "path").agg(
        F.max(F.when(F.col("what") == 0, F.col("n"))).alias("pages"), F.sum(F.when(F.col("what") == 2, F.col("n"))).alias("n2"),
        F.sum(F.when(F.col("what") == 2, x)).alias("x2"), F.sum(F.when(F.col("what") == 2, 1).otherwise(0)).alias("styles")) \
        .filter(F.col("pages") >= MIN_PAGES).select("host", "path", "pages", F.coalesce(
            (F.log("n2") - F.col("x2") / F.col("n2")) / F.log("pages"), F.lit(1.0)).alias("presentation"), "styles")
    texts = n.filter("what = 1").join(nodes.select("host", "path", "pages"), ["host", "path"]) \
        .filter(1 - F.log("n") / F.log("pages") < LOW) \
        .groupBy("host", "path").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("texts"))
    return nodes.join(texts, ["host", "path"], "left")


def noise(page: Page, keep: list[bool], leaves: list[tuple[int, str]], nodes: dict[int, tuple], low: float) -> list[bool]:
    """Flags of the texts in noise; ``nodes``: path key -> (pages, presentation, styles, texts)."""
    texts: dict[int, list[float]] = {}
    for i, t in leaves:
        pages, _, _, common = nodes.get(page.path[i], (0, 1.0, 0, None))
        texts.setdefault(i, []).append(1 - log(common.get(key(t), 1)) / log(pages) if common else 1.0)
    below, worth, low_all = page.children(keep), {}, {}
    for i in sorted({*below, *texts, *(c for own in below.values() for c in own)}, reverse=True):      # children stand behind their parents
        _, presentation, styles, _ = nodes.get(page.path[i], (0, 1.0, 0, None))
        own = below.get(i, [])
        parts = [worth[c] for c in own] + texts.get(i, [])
        weight = GAMMA ** styles if page.path[i] in nodes else 1.0
        worth[i] = (1 - weight) * presentation + weight * (sum(parts) / len(parts) if parts else 0.0)
        low_all[i] = worth[i] < low and all(low_all[c] for c in own) and all(w < low for w in texts.get(i, []))
    gone: dict[int, bool] = {}
    for i in sorted(worth):
        gone[i] = low_all[i] or gone.get(page.block[page.parent[i]] if i else -1, False)
    at = {i: iter(w) for i, w in texts.items()}
    return [next(at[i]) < low or gone[i] for i, _ in leaves]


def main_text(page: Page, nodes: dict[int, tuple]) -> str:
    """The page's texts that are left, joined by blanks."""
    keep, leaves, marked = page.part()
    bad = noise(page, keep, leaves, nodes, LOW_MARKED if marked else LOW) if nodes else [False] * len(leaves)
    left = [t for (_, t), b in zip(leaves, bad, strict=True) if not b]
    if not left or marked and 2 * sum(map(len, left)) < sum(len(t) for _, t in leaves):
        left = [t for _, t in leaves]
    return " ".join(left)


def extract(pages: DataFrame, url: str = "url", html: str = "html", tree_rows: int = TREE_ROWS) -> DataFrame:
    """``pages`` in ``_row`` with text."""
    spark = pages.sparkSession
    rows = as_row(pages)
    schema = StructType(rows.schema.fields + StructType.fromDDL("text string").fields)
    tree = materialize(style_tree(pages, url, html), "html-tree")
    at_url, at_html = pages.columns.index(url), pages.columns.index(html)
    if (tree.agg(F.sum(1 + F.greatest(F.size("texts"), F.lit(0)))).first()[0] or 0) <= tree_rows:
        sites: dict[str, dict] = {}
        for r in tree.toLocalIterator():
            sites.setdefault(r["host"], {})[r["path"]] = (r["pages"], r["presentation"], r["styles"], r["texts"])
        sent = spark.sparkContext.broadcast(sites)

        def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                urls, sources = (b.column(0).field(k).to_pylist() for k in (at_url, at_html))
                out = [main_text(Page(s or ""), sent.value.get(host_of(u), {})) for u, s in zip(urls, sources, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["_row", "text"])
        return rows.mapInArrow(extracted, schema)

    # a tree too large to send: each page brings its paths to the style nodes of its host
    keyed = materialize(rows.withColumn("_key", F.monotonically_increasing_id()), "html-pages")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, u, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                p = list(set(Page(s or "").path))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(p)), pa.array([host_of(u)] * len(p)), pa.array(p)], names=["_key", "host", "path"])

    def with_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(Page(s or ""), {n["path"]: (n["pages"], n["presentation"], n["styles"], dict(n["texts"] or ())) for n in nodes or ()})
                   for s, nodes in zip(b.column(0).field(at_html).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["_row", "text"])
    nodes = keyed.select("_key", F.col(f"_row.`{url}`"), F.col(f"_row.`{html}`")).mapInArrow(paths, "_key bigint, host string, path bigint") \
        .join(tree, ["host", "path"]).groupBy("_key").agg(F.collect_list(F.struct("path", "pages", "presentation", "styles", "texts")).alias("nodes"))
    return keyed.join(nodes, "_key", "left").select("_row", "nodes").mapInArrow(with_nodes, schema)
