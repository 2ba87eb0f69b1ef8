"""DuckDB SQL twins of the named queries (the correctness oracle).

Each statement sees only the driver's base tables and rebuilds the article
collection with the ``articles`` CTE (FIXTURES.md part 3), so the Spark
side and the oracle share no code path and no pattern, only Spark's public
stop-word list.  LDA itself has no twin (iterative, seeded model); the facts
that hold of any fit have one.
"""

from __future__ import annotations

from ..constants import ENGLISH_STOP_WORDS

# --- fixed values, spelled out again so that a wrong one on the Spark side shows
QUARTILES = ["Q1", "Q2", "Q3", "Q4"]
TOPIC_RULES = [("AI & Blockchain", ["ai", "learning"]), ("Security & Privacy", ["security", "privacy"]),
               ("IoT & Edge", ["iot", "edge"]), ("Healthcare", ["health"]), ("Supply Chain", ["supply"]),
               ("DeFi & Finance", ["finance", "defi"])]
TOPIC_DEFAULT = "General Blockchain"
YEAR_IN_TEXT = r"(?:^|[^\p{L}\p{N}_])((?:19|20)\d{2})(?:[^\p{L}\p{N}_]|$)"
CSV_NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                  "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SOURCE_ID_STRIDE = 281474976710656


def whole_word_pattern(word: str) -> str:
    return rf"(?:^|[^\p{{L}}\p{{N}}_]){word}(?:[^\p{{L}}\p{{N}}_]|$)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


ARTICLES = r"""
auth AS (
  SELECT l_orderkey,
         string_agg(s_name, ', ' ORDER BY l_linenumber, l_suppkey, s_name, l_partkey) AS authors,
         arg_min(l_partkey, (l_linenumber, l_suppkey, l_partkey)) AS first_part,
         CAST(sum(l_quantity) AS BIGINT) AS quantity
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  GROUP BY l_orderkey),
articles AS (
  SELECT CAST(o.o_orderkey AS BIGINT) AS ingest_id,
         coalesce(split_part(d.text, chr(10), 1) || ' #' || md5(d.text),
                  coalesce(p.p_name, 'Unknown Title') || ' (order ' || CAST(o.o_orderkey AS VARCHAR) || ')') AS title,
         coalesce(a.authors, 'Unknown') AS authors,
         CAST(year(o.o_orderdate) AS VARCHAR) AS date_pub,
         coalesce(d.source, 'src' || CAST(o.o_orderkey % 3 AS VARCHAR)) AS source,
         o.o_orderpriority AS journal,
         coalesce(d.text, 'N/A') AS abstract_,
         'Lab, ' || c.c_mktsegment AS affiliations,
         n.n_name AS country, coalesce(a.quantity, 0) AS citations,
         CAST(floor(CAST(round(o.o_totalprice * 100) AS BIGINT) / 10000) AS BIGINT) AS cents
  FROM orders o
  LEFT JOIN documents d ON d.doc_id = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN auth a ON a.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON p.p_partkey = a.first_part)"""

DEDUP = """
dedup AS (
  SELECT * FROM articles
  QUALIFY row_number() OVER (PARTITION BY title ORDER BY ingest_id) = 1)"""


CLEAN_YEAR_SQL = r"CAST(coalesce(nullif(regexp_extract({c}, '20\d{{2}}', 0), ''), '2024') AS INTEGER)"

FACT = f"""
cuts AS (SELECT quantile_cont(cents, 0.75) AS c1, quantile_cont(cents, 0.5) AS c2, quantile_cont(cents, 0.25) AS c3 FROM dedup),
fact AS (
  SELECT ingest_id, title, authors,
         {CLEAN_YEAR_SQL.format(c='date_pub')} AS Annee,
         country AS Pays,
         source AS Journal,
         CASE WHEN cents > c1 THEN 'Q1' WHEN cents > c2 THEN 'Q2' WHEN cents > c3 THEN 'Q3' ELSE 'Q4' END AS Quartile,
         citations AS Citations,
         CAST(cents AS DOUBLE) / 100 AS Impact_Score,
         abstract_
  FROM dedup, cuts)"""


DASH = """
dash AS (SELECT * FROM fact WHERE Annee BETWEEN 2000 AND 2024)"""
OLAP = """
olap AS (SELECT * FROM fact WHERE Annee BETWEEN 2000 AND 2024 AND Quartile IN ('Q1', 'Q2', 'Q3')
         AND Pays IN ('NATION_0', 'NATION_3', 'NATION_6', 'NATION_9', 'NATION_12', 'NATION_15', 'NATION_18', 'NATION_21', 'NATION_24'))"""


def topic_sql(col: str, whole_word: bool = False) -> str:
    t = f"lower({col})"
    whens = []
    for label, words in TOPIC_RULES:
        if whole_word:
            cond = " OR ".join(f"regexp_matches({t}, {q(whole_word_pattern(w))})" for w in words)
        else:
            cond = " OR ".join(f"contains({t}, {q(w)})" for w in words)
        whens.append(f"WHEN {cond} THEN {q(label)}")
    return "CASE " + " ".join(whens) + f" ELSE {q(TOPIC_DEFAULT)} END"


CSV_NULL_AUTHORS = f"CASE WHEN authors IN {in_list(CSV_NA_STRINGS)} THEN NULL ELSE authors END"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def edges_sql(src: str) -> str:
    """CTEs pos/pairs/edges: co-author pairs by self-join on the paper (i < j)."""
    return f"""
names AS (
  SELECT ingest_id AS paper,
         list_transform(list_filter(string_split(a, ','), lambda x: length(x) > 2),
                        lambda x: {STRIP.format(x='x')}) AS nm
  FROM (SELECT ingest_id, {CSV_NULL_AUTHORS} AS a FROM {src}) WHERE a IS NOT NULL),
pos AS (SELECT paper, unnest(nm) AS name, unnest(range(len(nm))) AS p FROM names),
pairs AS (
  SELECT DISTINCT l.paper, least(l.name, r.name) AS src, greatest(l.name, r.name) AS dst
  FROM pos l JOIN pos r ON l.paper = r.paper AND l.p < r.p),
edges AS (SELECT src, dst, count(*) AS papers FROM pairs GROUP BY src, dst)"""


STOP = in_list(ENGLISH_STOP_WORDS)
VALID = "abstract_ IS NOT NULL AND abstract_ <> 'N/A' AND length(abstract_) > 20"
TOKENS = r"regexp_split_to_array(regexp_replace(lower(text_content), '\s+$', ''), '\s')"

TEXT = f"""
docs AS (SELECT ingest_id AS doc_id, abstract_ AS text_content FROM articles WHERE {VALID}),
toks AS (SELECT doc_id, unnest({TOKENS}) AS term FROM docs),
dtc AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term NOT IN {STOP} GROUP BY doc_id, term),
vstats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS term_count, count(*) AS doc_freq
           FROM dtc GROUP BY term HAVING count(*) >= 1),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY term_count DESC, term) - 1 AS INTEGER) AS term_index,
         term, term_count, doc_freq
  FROM (SELECT * FROM vstats ORDER BY term_count DESC, term LIMIT 1000)),
tf AS (SELECT doc_id, term_index, term, tf FROM dtc JOIN vocab USING (term)),
idf AS (SELECT term, ln((n + 1) / (doc_freq + 1)) AS idf
        FROM vocab, (SELECT count(*) AS n FROM docs)),
tfidf AS (SELECT doc_id, term_index, term, tf, round(idf, 9) AS idf, round(tf * idf, 9) AS tfidf
          FROM tf JOIN idf USING (term))"""

# --- page extraction, generic rule only (the pages of the fixture) ----------
_ENT = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def visible_sql(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for ent, ch in _ENT:
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    t = rf"regexp_replace(regexp_replace({t}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
    return rf"regexp_replace({t}, ' ([,.;:!?])', '\1', 'g')"


CONTAINER = r"(?s)<article[^>]*>(.*?)</article>"
TITLE = r"(?s)<h1[^>]*>(.*?)</h1>"
AUTHORS = r'(?s)<[a-z]+[^>]*class="[^"]*\bauthors?\b[^"]*"[^>]*>(.*?)</[a-z]+>'
SITE_URLS = [r"^https?://dl\.acm\.org/", r"^https?://ieeexplore\.ieee\.org/",
             r"^https?://(?:www\.)?sciencedirect\.com/"]
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def _field_sql(pat: str, default: str) -> str:
    return (f"CASE WHEN regexp_matches(c, {q(pat)}) THEN {visible_sql(f'regexp_extract(c, {q(pat)}, 1)')} "
            f"ELSE {q(default)} END")


_YEAR = "regexp_extract(" + visible_sql("c") + f", {q(YEAR_IN_TEXT)}, 1)"
PAGES = f"""
page_rows AS (
  SELECT page_id, url, regexp_extract_all(html, {q(CONTAINER)}, 1) AS arr FROM pages
  WHERE regexp_matches(url, '^https?://')
    AND NOT ({' OR '.join(f'regexp_matches(url, {q(u)})' for u in SITE_URLS)})),
page_items AS (SELECT page_id, url, i, arr[i + 1] AS c
               FROM (SELECT page_id, url, arr, unnest(range(len(arr))) AS i FROM page_rows)),
extracted AS (
  SELECT * FROM (
    SELECT CAST(page_id * 65536 + i AS BIGINT) AS ingest_id,
           {_field_sql(TITLE, 'Unknown Title')} AS title,
           {_field_sql(AUTHORS, 'Unknown')} AS authors,
           CASE WHEN coalesce({_YEAR}, '') = '' THEN 'Unknown Date' ELSE {_YEAR} END AS date_pub,
           regexp_extract(url, {q(HOST)}, 1) AS source,
           regexp_extract(url, {q(HOST)}, 1) AS journal,
           'N/A' AS abstract_
    FROM page_items)
  WHERE title <> 'Unknown Title')"""

FACT_COLS = "ingest_id, title, authors, Annee, Pays, Journal, Quartile, Citations, Impact_Score, abstract_"
ART_COLS = "ingest_id, title, authors, date_pub, source, journal, abstract_, affiliations"
TRIMMED_AUTHORS = (f"SELECT unnest(list_transform(string_split(a, ','), lambda x: {STRIP.format(x='x')})) AS author "
                   f"FROM (SELECT {CSV_NULL_AUTHORS} AS a FROM dash) WHERE a IS NOT NULL")


def _names(src: str) -> str:
    """CTE people: the dimensions and each trimmed author of ``src``'s rows."""
    return f"""
people AS (SELECT Annee, Quartile, Pays, unnest(list_transform(string_split(a, ','), lambda x: {STRIP.format(x='x')})) AS author
           FROM (SELECT *, {CSV_NULL_AUTHORS} AS a FROM {src}) WHERE a IS NOT NULL)"""


BOX = f"""
box AS (
  SELECT Quartile, count(*) AS n, min(Impact_Score) AS mn, max(Impact_Score) AS mx,
         quantile_cont(Impact_Score, 0.25) AS q1, quantile_cont(Impact_Score, 0.5) AS med,
         quantile_cont(Impact_Score, 0.75) AS q3
  FROM dash WHERE Quartile IS NOT NULL AND Impact_Score IS NOT NULL GROUP BY Quartile),
fences AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM box)"""


def _stmt(ctes: list[str], body: str) -> str:
    return with_(*ctes) + "\n" + body


WEAK = f"""
wdocs AS (SELECT ingest_id AS doc_id, CAST(date_pub AS INTEGER) AS period, abstract_ AS text_content
          FROM articles WHERE {VALID} AND regexp_matches(date_pub, '^\\d{{4}}$')),
wt AS (SELECT DISTINCT doc_id, period, term
       FROM (SELECT doc_id, period, unnest({TOKENS}) AS term FROM wdocs)
       WHERE term <> '' AND term NOT IN {STOP}),
per_period AS (SELECT period, count(*) AS period_docs FROM wdocs GROUP BY period),
bounds AS (SELECT max(period) AS last, count(*) - 1 AS n_earlier, sum(period_docs) AS n_docs FROM per_period),
tp AS (SELECT term, period, docs, docs / period_docs AS share
       FROM (SELECT term, period, count(*) AS docs FROM wt GROUP BY term, period)
       JOIN per_period USING (period)),
g AS (SELECT term, sum(docs) AS term_docs, any_value(n_docs) AS n_docs, any_value(n_earlier) AS n_earlier,
             coalesce(sum(CASE WHEN period = last THEN share END), 0) AS last_share,
             list_reduce(list_prepend(CAST(0 AS DOUBLE),
                                      list(coalesce(CASE WHEN period <> last THEN share END, CAST(0 AS DOUBLE))
                                           ORDER BY period)),
                         lambda a, b: a + b) AS earlier_sum
      FROM tp, bounds GROUP BY term),
s AS (SELECT term, term_docs, n_docs, last_share,
             CASE WHEN n_earlier > 0 THEN earlier_sum / n_earlier ELSE 0 END AS em FROM g)"""


A, D, F_ = ARTICLES, DEDUP, FACT

ORACLE: dict[str, str] = {
    "trends": _stmt([A], r"""SELECT date_pub, count(*) AS count FROM articles
        WHERE regexp_matches(date_pub, '^\d{4}$') GROUP BY date_pub"""),
    "top_authors_raw": _stmt([A], """SELECT author, count(*) AS count
        FROM (SELECT unnest(string_split(authors, ',')) AS author FROM articles)
        GROUP BY author ORDER BY count DESC, author LIMIT 20"""),
    "geography": _stmt([A], r"""SELECT regexp_extract(affiliations, ',\s([A-Za-z]+)$', 1) AS country,
        count(*) AS count FROM articles GROUP BY 1 ORDER BY count DESC, country NULLS FIRST LIMIT 20"""),
    "source_counts": _stmt([A], "SELECT source AS Source, count(*) AS Count FROM articles GROUP BY source"),
    "quality_counts": _stmt([A], f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_articles,
        CAST(coalesce(sum(v), 0) AS BIGINT) AS valid_abstracts, count(*) AS distinct_titles,
        CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
        FROM (SELECT title, count(*) AS n, count(*) FILTER (WHERE {VALID}) AS v FROM articles GROUP BY title)"""),
    "duplicate_titles": _stmt([A], """SELECT title, count(*) AS copies, min(ingest_id) AS kept_id,
        count(*) - 1 AS surplus FROM articles GROUP BY title HAVING count(*) > 1"""),
    "dedupe_titles": _stmt([A, D], f"SELECT {ART_COLS} FROM dedup"),
    "surplus_rows": _stmt([A], """SELECT ingest_id, title FROM articles
        QUALIFY row_number() OVER (PARTITION BY title ORDER BY ingest_id) > 1"""),
    "dedupe_report": _stmt([A], """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS initial_count,
        count(*) AS final_count, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS deleted_count,
        count(*) FILTER (WHERE n > 1) AS duplicate_titles
        FROM (SELECT title, count(*) AS n FROM articles GROUP BY title)"""),
    "insert_if_absent": _stmt([A], f"""SELECT {ART_COLS} FROM (
          SELECT * FROM articles WHERE ingest_id < (SELECT min(ingest_id) + (max(ingest_id) - min(ingest_id)) // 3 FROM articles)
          QUALIFY row_number() OVER (PARTITION BY title ORDER BY ingest_id) = 1) b
        WHERE NOT EXISTS (SELECT 1 FROM articles t
                          WHERE t.title IS NOT DISTINCT FROM b.title AND t.ingest_id >=
                            (SELECT min(ingest_id) + (max(ingest_id) - min(ingest_id)) // 3 FROM articles))"""),
    "union_sources": _stmt([A, PAGES], f"""SELECT {ART_COLS} FROM articles
        UNION ALL
        SELECT CAST(ingest_id + {SOURCE_ID_STRIDE} AS BIGINT), title, authors, date_pub, source, journal, abstract_,
               CAST(NULL AS VARCHAR) FROM extracted"""),
    "title_uniqueness": _stmt([A, D], """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS titles,
        count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE n > 1) = 0 AS is_unique
        FROM (SELECT title, count(*) AS n FROM dedup GROUP BY title)"""),
    "json_round_trip": _stmt([A], "SELECT title, authors, date_pub, source, journal, abstract_, affiliations FROM articles"),
    "csv_round_trip": _stmt([A, D, F_], f"SELECT {FACT_COLS} FROM fact"),
    "json_array_scan": _stmt([A], f"""SELECT {ART_COLS.replace('abstract_', "nullif(abstract_, 'N/A') AS abstract_")}, country,
        CAST(citations AS BIGINT) AS citations FROM articles"""),
    "input_guards": _stmt([A, D], f"""SELECT i.input, CASE i.input WHEN 'abstract_' THEN v.n WHEN 'abstract' THEN v.n WHEN 'result table' THEN t.n ELSE 0 END AS rows
        FROM (VALUES ('abstract_'), ('abstract'), ('no text column'), ('topics of no text'), ('result table'), ('missing table')) AS i(input),
             (SELECT count(*) AS n FROM articles WHERE {VALID}) AS v, (SELECT count(*) AS n FROM dedup) AS t"""),
    "export_by_source": _stmt([A], """SELECT title, authors, date_pub, journal, abstract_, affiliations, source
        FROM articles"""),
    "extract_articles": _stmt([PAGES], "SELECT * FROM extracted"),
    "stream_ingest": _stmt([A, D], f"SELECT {ART_COLS} FROM dedup"),
    "stream_ingest_first": _stmt([A, D], f"SELECT {ART_COLS} FROM dedup"),
    "stream_ingest_state": _stmt([A], "SELECT DISTINCT title FROM articles"),
    "clean_year": _stmt([A], f"SELECT ingest_id, date_pub, {CLEAN_YEAR_SQL.format(c='date_pub')} AS Annee "
                             "FROM articles"),
    "topic_label": _stmt([A], f"SELECT ingest_id, title, {topic_sql('title')} AS Topic FROM articles"),
    "topic_label_words": _stmt([A], f"SELECT ingest_id, title, {topic_sql('title', True)} AS Topic "
                                    "FROM articles"),
    "fact_publications": _stmt([A, D, F_], f"SELECT {FACT_COLS} FROM fact"),
    "olap_slice": _stmt([A, D, F_, OLAP], f"SELECT {FACT_COLS} FROM olap"),
    "kpis": _stmt([A, D, F_, DASH], """SELECT count(*) AS publications,
        CAST(coalesce(sum(Citations), 0) AS BIGINT) AS total_citations,
        round(sum(CAST(round(Impact_Score * 100) AS BIGINT)) / count(Impact_Score)) / 100 AS mean_impact,
        count(DISTINCT Pays) AS active_countries FROM dash"""),
    "pubs_per_year": _stmt([A, D, F_, DASH], """SELECT Annee, count(*) AS Publications FROM dash
        WHERE Annee IS NOT NULL GROUP BY Annee"""),
    "year_quartile_pivot": _stmt([A, D, F_, DASH], "SELECT Annee, " + ", ".join(
        f"count(*) FILTER (WHERE Quartile = {q(x)}) AS {x}" for x in QUARTILES)
        + " FROM dash WHERE Annee IS NOT NULL AND Quartile IS NOT NULL GROUP BY Annee"),
    "quartile_counts": _stmt([A, D, F_, DASH], """SELECT Quartile, count(*) AS Count,
        count(*) / sum(count(*)) OVER () AS share
        FROM dash WHERE Quartile IS NOT NULL GROUP BY Quartile"""),
    "impact_box_stats": _stmt([A, D, F_, DASH, BOX], """SELECT f.Quartile, any_value(f.n) AS n,
        round(any_value(f.mn), 6) AS min, round(any_value(f.q1), 6) AS q1, round(any_value(f.med), 6) AS median,
        round(any_value(f.q3), 6) AS q3, round(any_value(f.mx), 6) AS max,
        round(any_value(f.lf), 6) AS lower_fence, round(any_value(f.uf), 6) AS upper_fence,
        round(min(CASE WHEN d.Impact_Score BETWEEN f.lf AND f.uf THEN d.Impact_Score END), 6) AS whisker_low,
        round(max(CASE WHEN d.Impact_Score BETWEEN f.lf AND f.uf THEN d.Impact_Score END), 6) AS whisker_high,
        count(*) FILTER (WHERE NOT (d.Impact_Score BETWEEN f.lf AND f.uf)) AS outliers
        FROM fences f JOIN dash d ON d.Quartile = f.Quartile AND d.Impact_Score IS NOT NULL
        GROUP BY f.Quartile"""),
    "pubs_per_country": _stmt([A, D, F_, DASH], """SELECT Pays, count(*) AS Count FROM dash
        WHERE Pays IS NOT NULL GROUP BY Pays"""),
    "impact_by_year": _stmt([A, D, F_, DASH], """SELECT Annee AS Year, sum(Citations) / count(Citations) AS Avg_Citations
        FROM dash WHERE Annee IS NOT NULL GROUP BY Annee"""),
    "top_authors": _stmt([A, D, F_, DASH], f"""SELECT author, count(*) AS publications
        FROM ({TRIMMED_AUTHORS}) GROUP BY author ORDER BY publications DESC, author LIMIT 10"""),
    "dimension_members": _stmt([A, D, F_], f"""SELECT DISTINCT dimension, member FROM (
          SELECT 'Annee' AS dimension, CAST(Annee AS VARCHAR) AS member FROM fact
          UNION ALL SELECT 'Pays', Pays FROM fact
          UNION ALL SELECT 'Quartile', Quartile FROM fact
          UNION ALL SELECT 'Topic', {topic_sql('title')} FROM fact) WHERE member IS NOT NULL"""),
    "topic_distribution": _stmt([A, D, F_], f"SELECT {topic_sql('title')} AS Topic, count(*) AS Count "
                                            "FROM fact GROUP BY 1"),
    "topic_articles": _stmt([A, D, F_, DASH], f"""SELECT title, Annee, Journal, Citations FROM dash
        WHERE {topic_sql('title')} = 'AI & Blockchain'"""),
    "olap_cube": _stmt([A, D, F_], """SELECT Annee, Quartile, Pays,
        CAST(grouping(Annee, Quartile, Pays) AS BIGINT) AS gid, count(*) AS publications,
        CAST(coalesce(sum(Citations), 0) AS BIGINT) AS total_citations,
        sum(CAST(round(Impact_Score * 100) AS BIGINT)) / count(Impact_Score) / 100 AS mean_impact
        FROM fact GROUP BY CUBE (Annee, Quartile, Pays)"""),
    "cube_groupings": _stmt([A, D, F_, _names("fact")], """SELECT g.*, coalesce(p.active_authors, 0) AS active_authors FROM (
          SELECT Annee, Quartile, Pays, CAST(grouping(Annee, Quartile, Pays) AS BIGINT) AS gid, count(*) AS publications,
                 CAST(coalesce(sum(Citations), 0) AS BIGINT) AS total_citations,
                 sum(CAST(round(Impact_Score * 100) AS BIGINT)) / count(Impact_Score) / 100 AS mean_impact,
                 min(Impact_Score) AS min_impact, max(Impact_Score) AS max_impact, count(DISTINCT Pays) AS active_countries
          FROM fact GROUP BY CUBE (Annee, Quartile, Pays)) g
        LEFT JOIN (SELECT Annee, Quartile, Pays, CAST(grouping(Annee, Quartile, Pays) AS BIGINT) AS gid, count(DISTINCT author) AS active_authors
                   FROM people GROUP BY CUBE (Annee, Quartile, Pays)) p
          ON g.gid = p.gid AND g.Annee IS NOT DISTINCT FROM p.Annee AND g.Quartile IS NOT DISTINCT FROM p.Quartile
             AND g.Pays IS NOT DISTINCT FROM p.Pays"""),
    "cube_kpis": _stmt([A, D, F_, DASH, _names("dash")], """SELECT count(*) AS publications,
        CAST(coalesce(sum(Citations), 0) AS BIGINT) AS total_citations,
        round(sum(CAST(round(Impact_Score * 100) AS BIGINT)) / count(Impact_Score)) / 100 AS mean_impact,
        count(DISTINCT Pays) AS active_countries, (SELECT count(DISTINCT author) FROM people) AS active_authors FROM dash"""),
    "cube_box_errors": _stmt([A, D, F_, DASH], """SELECT Quartile, count(*) AS n, round(min(Impact_Score), 6) AS min,
        round(max(Impact_Score), 6) AS max, true AS q1_near, true AS median_near, true AS q3_near, true AS outlier_near
        FROM dash WHERE Quartile IS NOT NULL AND Impact_Score IS NOT NULL GROUP BY Quartile"""),
    "coauthor_edges": _stmt([A, D, F_, DASH, edges_sql("dash")], "SELECT src, dst, papers FROM edges"),
    "coauthor_sample": _stmt([A, D, F_, DASH, "first50 AS (SELECT * FROM dash ORDER BY ingest_id LIMIT 50)",
                              edges_sql("first50")], "SELECT src, dst, papers FROM edges"),
    "coauthor_top_edges": _stmt([A, D, F_, DASH, edges_sql("dash")],
                                "SELECT src, dst, papers FROM edges ORDER BY papers DESC, src, dst LIMIT 50"),
    "author_degree": _stmt([A, D, F_, DASH, edges_sql("dash")], """SELECT author, count(*) AS degree FROM (
          SELECT src AS author FROM edges UNION ALL SELECT dst FROM edges WHERE dst <> src)
        GROUP BY author"""),
    "valid_abstracts": _stmt([A], f"SELECT ingest_id AS doc_id, abstract_ AS text_content FROM articles "
                                  f"WHERE {VALID}"),
    "vocabulary": _stmt([A, TEXT], "SELECT term_index, term, term_count, doc_freq FROM vocab"),
    "term_frequencies": _stmt([A, TEXT], "SELECT doc_id, term_index, term, tf FROM tf"),
    "tfidf": _stmt([A, TEXT], "SELECT doc_id, term_index, term, tf, idf, tfidf FROM tfidf"),
    "doc_keywords": _stmt([A, TEXT], """SELECT doc_id, rank, term, tfidf FROM (
          SELECT doc_id, term, tfidf,
                 CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS INTEGER) AS rank
          FROM (SELECT doc_id, term, round(tf * ln((n + 1) / (doc_freq + 1)), 9) AS tfidf
                FROM dtc JOIN vstats USING (term), (SELECT count(*) AS n FROM docs))) WHERE rank <= 5"""),
    "word_cloud_terms": _stmt([A, TEXT], """SELECT term, CAST(sum(tf) AS BIGINT) AS count FROM dtc
        WHERE term <> '' GROUP BY term ORDER BY count DESC, term LIMIT 100"""),
    "lda_topic_facts": """SELECT CAST(t AS INTEGER) AS Topic, CAST(5 AS BIGINT) AS terms, CAST(5 AS BIGINT) AS distinct_terms,
        CAST(5 AS BIGINT) AS in_vocabulary FROM range(5) AS r(t) WHERE EXISTS (SELECT 1 FROM documents)""",
    "weak_signals": _stmt([A, WEAK], f"""SELECT term, CAST(term_docs AS BIGINT) AS term_docs,
        round(last_share, 9) AS last_share, round(em, 9) AS earlier_mean_share,
        round(last_share - em, 9) AS growth
        FROM s WHERE term_docs >= 2 AND term_docs <= CAST(n_docs AS DOUBLE) * CAST(0.05 AS DOUBLE)
          AND round(last_share - em, 9) > 0
        ORDER BY growth DESC, term LIMIT 20"""),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
