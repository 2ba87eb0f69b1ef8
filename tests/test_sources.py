import json
import os
import time

import pytest

from pyspark.sql import functions as F

from citeweave.schema import ARTICLE_SCHEMA, FACT_SCHEMA, PAGE_SCHEMA, TOPIC_DIST_SCHEMA
from citeweave.sources import readers, writers
from citeweave.sources.extract import DEFAULT_RULES, extract_articles
from conftest import collection


def test_json_array_and_empty_array(spark, scratch):
    arts = [{"title": "A", "authors": "X, Y", "date_pub": "2025", "source": "ACM Digital Library",
             "journal": "ACM", "abstract_": "N/A"},
            {"title": "", "authors": "", "date_pub": "Unknown Date", "source": "ACM Digital Library",
             "journal": "ACM"}]
    p = os.path.join(scratch, "data.json")
    with open(p, "w") as f:
        json.dump(arts, f, indent=4)
    e = os.path.join(scratch, "empty.json")
    with open(e, "w") as f:
        f.write("[\n\n]")
    df = readers.read_json_array(spark, p)
    assert df.schema == ARTICLE_SCHEMA and df.count() == 2
    assert df.where(F.col("title") == "").first()["abstract_"] is None      # missing field -> NULL
    assert readers.read_json_array(spark, e).count() == 0
    landed = readers.land(df, os.path.join(scratch, "landed"))
    assert landed.count() == 2


def test_csv_round_trip_with_quoted_newline(spark, scratch):
    df = spark.createDataFrame([("Q1 paper", 'A, "B"\nHighlights', 2021, "USA", "IEEE", "Q1", 12, 3.5, "N/A")],
                               FACT_SCHEMA)
    out = os.path.join(scratch, "fact_csv")
    writers.write_csv(df, out, single_file=True)
    back = readers.read_csv_typed(spark, out, FACT_SCHEMA)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]
    missing = readers.read_csv_optional(spark, os.path.join(scratch, "nope.csv"), TOPIC_DIST_SCHEMA)
    assert missing.count() == 0 and missing.schema == TOPIC_DIST_SCHEMA


def test_exports(spark, scratch):
    df = collection(spark, [(1, "a", "x", "2025", "IEEE Xplore", "IEEE", "N/A", None),
                            (2, "b", "y", "2024", "ACM Digital Library", "ACM", "N/A", "Lab, USA")])
    writers.export_collection(df, os.path.join(scratch, "all"))
    back = spark.read.json(os.path.join(scratch, "all"))
    assert "ingest_id" not in back.columns and back.count() == 2
    writers.export_source(df, "IEEE Xplore", os.path.join(scratch, "ieee"))
    assert [r["title"] for r in spark.read.json(os.path.join(scratch, "ieee")).collect()] == ["a"]
    by = writers.export_by_source(df, os.path.join(scratch, "by_source"))
    assert sorted(x for x in os.listdir(os.path.join(scratch, "by_source")) if x.startswith("by=")) == [
        "by=ACM Digital Library", "by=IEEE Xplore"]
    assert sorted((r["title"], r["source"]) for r in by.collect()) == [("a", "IEEE Xplore"),
                                                                       ("b", "ACM Digital Library")]


ODD = [(1, "", "", "2025", "", "j", None, None), (2, None, "NULL", None, None, "", 'quote " and \\ back', "Lab, USA"),
       (3, "two\nlines", "a,b", "", "IEEE Xplore", " j ", "N/A", ""), (4, 'x "y", z', "\t", "2024", "", None, "é", "null")]


def same_rows(a, b):
    return sorted((tuple(r) for r in a.collect()), key=str) == sorted((tuple(r) for r in b.collect()), key=str)


def test_round_trips_keep_every_value(spark, scratch):
    df = collection(spark, ODD)
    assert same_rows(writers.json_round_trip(df, os.path.join(scratch, "json")), df.drop("ingest_id"))
    assert same_rows(writers.csv_round_trip(df, os.path.join(scratch, "csv")), df)
    back = writers.export_by_source(df, os.path.join(scratch, "by_source"))
    assert same_rows(back, df.select(*back.columns))


@pytest.mark.parametrize("text", ['[{"title": "a"}, {"title": ', '{"title" "a"}'])
def test_malformed_json_fails(spark, scratch, text):
    p = os.path.join(scratch, "bad.json")
    with open(p, "w") as f:
        f.write(text)
    for read in (readers.read_json_array, readers.read_json_positions, readers.read_json_lines):
        with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
            read(spark, p).collect()


ACM = "https://dl.acm.org/action/doSearch?q=x"
IEEE = "https://ieeexplore.ieee.org/search/searchresult.jsp"
SD = "https://www.sciencedirect.com/search?qs=y"
PAGES = {
    # every alternative of the containers, titles and authors, defaults and dropped rows: (url, html, expected)
    "acm": (ACM, """<ul>
      <li class="search__item"><div class="issue-item x"><h5 class="issue-item__title"><span><a href="/1">Blockchain &amp; Trust</a></span></h5>
        <ul class="rlist--inline loa"><li>Ann Lee</li>, <li>Bob Wu</li></ul><span>Published: 12 May 2023</span></div></li>
      <li><article class="search-result__item"><span class="hlFld-Title"><a>Second</a></span>
        <div class="issue-item__detail"><div class="rlist--inline">Cy Day</div></div></article></li>
      <li><div class="issue-item"><h5 class="issue-item__title"><a>   </a></h5><span>no year 12034 here</span></div></li>
      <li><div class="issue-item"><p>no title</p><a>elsewhere</a></div></li></ul>""",
            [("Blockchain & Trust", "Ann Lee, Bob Wu", "2023"), ("Second", "Cy Day", "Unknown Date"), ("", "Unknown", "Unknown Date")]),
    "ieee": (IEEE, """<div class="List-results-items"><xpl-results-item class="xpl-results-item"><h3 class="text-md-md-lh"><a href="/d/1">Edge ledgers</a></h3>
        <p class="author"><span>Kim Ode</span>; <span>Lu Pan</span></p><div>Year: 2021</div></xpl-results-item></div>
      <div class="result-item hide-mobile"><h2><b><a>Second</a></b></h2><div class="xpl-authors-name-list"><span>Mo</span></div></div>
      <div class="result-item"><div class="result-item-title"><a>Third</a></div><p>1999</p></div>
      <span class="result-item"><h2><a>Not a result</a></h2></span>
      <div class="result-item"><h2>No link</h2><p class="authors">Nobody</p></div>""",
             [("Edge ledgers", "Kim Ode; Lu Pan", "2021"), ("Second", "Mo", "Unknown Date"), ("Third", "Unknown", "1999")]),
    "sciencedirect": (SD, """<ol><li class="ResultItem"><h2><a>Not a result</a></h2></li><li><div class="result-item-content"><h2><span><a class="result-list-title-link u-font" href="#">Supply chains</a></span></h2>
        <ol class="authors-list hor"><li>C. Day</li></ol><span>May 2020</span></div></li>
      <li><div class="result-item-content"><h2>Bare title</h2><div class="Authors">D. Eve, F. Gil</div></div></li>
      <li><div class="result-item-content"><a class="result-list-title-link">Link title</a></div></li>
      <li><div class="result-item-content"><p>no title</p></div></li></ol>""",
                      [("Supply chains", "C. Day", "2020"), ("Bare title", "D. Eve, F. Gil", "Unknown"), ("Link title", "Unknown", "Unknown")]),
    "web": ("http://blog.example.org/p/3", """<title>T</title><nav>2001</nav><article><h1>Edge <b>AI</b> today</h1>
      <p class="author">Dee</p><p>Written in 1999.</p></article><article><p>untitled</p></article>""",
            [("Edge AI today", "Dee", "1999")]),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_extraction_rules(spark, name):
    url, html, want = PAGES[name]
    got = extract_articles(spark.createDataFrame([(7, url, html), (8, "ftp://nope/x", html)], PAGE_SCHEMA), DEFAULT_RULES)
    rows = sorted(got.collect(), key=lambda r: r.ingest_id)
    assert [(r.title, r.authors, r.date_pub) for r in rows] == want
    source, journal = {"acm": ("ACM Digital Library", "ACM"), "ieee": ("IEEE Xplore", "IEEE"),
                       "sciencedirect": ("ScienceDirect", "ScienceDirect Journal"), "web": ("blog.example.org",) * 2}[name]
    assert {(r.source, r.journal, r.abstract_) for r in rows} == {(source, journal, "N/A")}
    assert all(r.ingest_id // 65536 == 7 for r in rows)


def test_long_elements_do_not_nest_the_matcher(spark):
    html = '<div class="issue-item"><h5 class="issue-item__title">' + "<b>x</b> y" * 20000 + "<a>T</a></h5></div>"
    assert [r.title for r in extract_articles(spark.createDataFrame([(1, ACM, html)], PAGE_SCHEMA)).collect()] == ["T"]


def extracted(spark, url, html):
    got = extract_articles(spark.createDataFrame([(1, url, html)], PAGE_SCHEMA)).orderBy("ingest_id").collect()
    return [(r.title, r.authors, r.date_pub) for r in got]


@pytest.mark.parametrize("tag", ['<div class="issue-item">', "<div class='issue-item'>", "<div class=issue-item>", '<DIV CLASS="a issue-item b">',
                                 "<div id=x\n class = 'issue-item wide'>", '<div title="a > b" class="issue-item">', "<div class=issue-item/>"])
def test_any_attribute_quoting(spark, tag):
    title = '<H5 Class=\'issue-item__title\'><A HREF=/1>Any</A></H5>'
    assert extracted(spark, ACM, f"{tag}{title}<p>2022</p></div>") == [("Any", "Unknown", "2022")]
    assert extracted(spark, ACM, tag.replace("issue-item", "issue-items") + title + "</div>") == []


def test_nested_results_keep_the_outer_tail(spark):
    html = """<div class="issue-item"><div><h5 class="issue-item__title"><a>Outer</a></h5>
      <div class="issue-item"><h5 class="issue-item__title"><a>Inner</a></h5><ul class="rlist--inline"><li>In Ner</li></ul></div></div>
      <ul class="rlist--inline"><li>Out Er</li></ul><p>tail 2019</p></div><p>2001</p>"""
    assert extracted(spark, ACM, html) == [("Outer", "In Ner", "2019"), ("Inner", "In Ner", "Unknown Date")]


def test_descendant_selectors(spark):
    # authors need a list, or an ancestor with the detail class; results need theirs
    item = '<div class="issue-item"><h5 class="issue-item__title"><a>T</a></h5>{}</div>'
    assert extracted(spark, ACM, item.format('<div class="rlist--inline">No</div>')) == [("T", "Unknown", "Unknown Date")]
    assert extracted(spark, ACM, item.format('<div class="issue-item__detail"><p><span class="rlist--inline">Yes</span></p></div>')) == [
        ("T", "Yes", "Unknown Date")]
    assert extracted(spark, IEEE, '<div class="xpl-results-item"><h2><a>T</a></h2></div>') == []
    assert extracted(spark, IEEE, '<div class="List-results-items"><i class="xpl-results-item"><h2><a>T</a></h2></i></div>') == [("T", "Unknown", "Unknown Date")]


def test_hidden_text_is_no_text(spark):
    html = """<div class="issue-item"><!-- <div class="issue-item"><h5 class="issue-item__title"><a>Ghost</a></h5></div> 1901 -->
      <script>if (a < b) { year = "1902"; x = '</div>' }</script><style>p:after { content: "1903" }</style>
      <h5 class="issue-item__title"><a>Shown<script>var t = "</a>"</script></a></h5><template><p>1904</p></template> 2020</div>"""
    assert extracted(spark, ACM, html) == [("Shown", "Unknown", "2020")]
    assert extracted(spark, ACM, '<div class="issue-item"><h5 class="issue-item__title"><a>T</a><!-- open 1905') == [("T", "Unknown", "Unknown Date")]


def test_character_references(spark):
    raw = "&lt;b&gt; &amp;amp; &eacute;&#233;&#xE9; &#128512; &nbsp;&hearts; &copy 1 &unknown; &#0;&#xD800; AT&T &notin; a&b &ThickSpace;x"
    want = "<b> &amp; ééé \U0001f600 ♥ © 1 &unknown; �� AT&T ∉ a&b   x"
    got = extracted(spark, ACM, f'<div class="issue-item"><h5 class="issue-item__title"><a>{raw}</a></h5></div>')
    assert got[0][0] == want


def test_open_elements(spark):
    # no end tags at all; paragraphs end where the next begins; void elements hold nothing
    assert extracted(spark, ACM, '<div class=issue-item><h5 class=issue-item__title><a>T') == [("T", "Unknown", "Unknown Date")]
    assert extracted(spark, IEEE, '<div class="result-item"><h2><a>T<br>U</a></h2><p class="author">Ann<p>Bob 2018</div>') == [("T U", "Ann", "2018")]
    assert extracted(spark, ACM, "") == [] and extracted(spark, ACM, "a < b <> <3") == []


def test_pages_without_html(spark):
    assert extract_articles(spark.createDataFrame([(1, ACM, None), (2, None, "<article><h1>x</h1></article>")], PAGE_SCHEMA)).count() == 0


def test_csv_round_trip_lands_compressed(spark, scratch):
    df = collection(spark, ODD)
    assert same_rows(writers.csv_round_trip(df, os.path.join(scratch, "csv")), df)
    landed = [f for f in os.listdir(os.path.join(scratch, "csv")) if f.startswith("part-")]
    assert landed and all(f.endswith(".csv.gz") for f in landed)


def test_landing_leaves_no_shuffle_behind(spark):
    """The shuffles that made the collection and the fact would lie on disk beside them until the driver collects garbage:
    what stays is of counts and quantiles."""
    from citeweave.plans import catalog
    from citeweave.session import clear_work

    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        files = [files.apply(i) for i in range(files.size())]
        return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}
    clear_work(spark)
    before = shuffled()
    fact = [f.removeprefix("file://") for f in catalog.fact_table(spark, "/root/testdata/sf0.001").inputFiles()]
    for _ in range(50):
        own = sum(n for f, n in shuffled().items() if f not in before)
        if own > sum(map(os.path.getsize, fact)) / 4:
            time.sleep(0.2)
    assert own <= sum(map(os.path.getsize, fact)) / 4


def test_texts_join_last(spark):
    """Whatever the sizes of the dimensions, a text moves once: the join with the documents is the topmost."""
    from citeweave.sources.articles import build_articles
    plan = build_articles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 6 and "doc_id" in joins[0]
