import itertools
import random

from citeweave.operators import graph


def brute_edges(papers):
    """Reference semantics: for each paper, the names longer than 2 chars (before strip),
    stripped; add_edge(a_i, a_j) for i < j into a simple undirected graph."""
    edges = {}
    for pid, authors in papers:
        if authors is None or authors in ("", "NA", "N/A"):
            continue
        names = [a.strip() for a in authors.split(",") if len(a) > 2]
        seen = set()
        for i, j in itertools.combinations(range(len(names)), 2):
            e = tuple(sorted((names[i], names[j])))
            if e not in seen:
                seen.add(e)
                edges[e] = edges.get(e, 0) + 1
    return edges


def frame(spark, papers):
    return spark.createDataFrame(papers, "ingest_id long, authors string")


PAPERS = [
    (1, "Ann, Bob, Cid"),
    (2, "Bob, Ann"),
    (3, "Ann, Ann, Dan"),        # same name twice: self-loop
    (4, "Eve"),                  # lone author: no node
    (5, None),
    (6, "Li, Bob, + 1"),         # "Li" is dropped, " + 1" kept
]


def test_edges_match_brute_force(spark):
    got = {(r["src"], r["dst"]): r["papers"] for r in graph.coauthor_edges(frame(spark, PAPERS)).collect()}
    assert got == brute_edges(PAPERS)
    assert got[("Ann", "Ann")] == 1 and got[("Ann", "Bob")] == 2


def test_long_lists_are_split_into_chunks(spark):
    rnd = random.Random(7)
    pool = [f"N{i:03d}" for i in range(60)]
    papers = [(i, ", ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 40)))) for i in range(80)]
    df = frame(spark, papers)
    small = {(r["src"], r["dst"]): r["papers"] for r in graph.coauthor_edges(df, chunk=3).collect()}
    big = {(r["src"], r["dst"]): r["papers"] for r in graph.coauthor_edges(df).collect()}
    assert small == big == brute_edges(papers)


def test_degree_sample_and_top(spark):
    df = frame(spark, PAPERS)
    edges = graph.coauthor_edges(df)
    deg = {r["author"]: r["degree"] for r in graph.author_degree(edges).collect()}
    # Ann: Bob, Cid, Dan and herself (self-loop counted once)
    assert deg["Ann"] == 4 and deg["Bob"] == 3 and "Eve" not in deg
    top = graph.coauthor_top_edges(edges, 1).first()
    assert (top["src"], top["dst"], top["papers"]) == ("Ann", "Bob", 2)
    sample = {(r["src"], r["dst"]) for r in graph.coauthor_sample(df, n=2).collect()}
    assert sample == {("Ann", "Bob"), ("Ann", "Cid"), ("Bob", "Cid")}


def test_one_scan_and_bounded_rows(spark, scratch):
    frame(spark, PAPERS).write.parquet(f"{scratch}/papers")
    plan = graph.coauthor_edges(spark.read.parquet(f"{scratch}/papers"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    # a paper with 20,000 names: all pairs, never more than chunk * chunk in one row
    n = 20_000
    df = frame(spark, [(1, ", ".join(f"N{i:05d}" for i in range(n)))])
    tiles = graph.pair_tiles(df)
    sizes = tiles.selectExpr("max(size(a)) x", "max(size(b)) y", "count(*) n").first()
    last = -(-n // graph.PAIR_CHUNK)
    assert (sizes.x, sizes.y, sizes.n) == (graph.PAIR_CHUNK, graph.PAIR_CHUNK, last * (last + 1) // 2)


def test_pairs_by_rows_over_tiles(spark):
    names = ["Ann", "Bob", "Cid", "Dan", "Eve", "Fay", "Eve", "Ann"]
    pairs = graph.paper_pairs(frame(spark, [(1, ", ".join(names)), (2, "Solo"), (3, None)]), chunk=2)
    d = sorted(set(names))
    assert sorted((r["src"], r["dst"]) for r in pairs.collect()) == sorted(
        [(a, b) for i, a in enumerate(d) for b in d[i + 1:]] + [("Ann", "Ann"), ("Eve", "Eve")])
    assert "posexplode" in pairs._jdf.queryExecution().executedPlan().toString()
