"""Co-author graph.

An edge joins two names that appear on one paper; the graph is undirected
and simple (parallel edges merged, ``papers`` counts the papers behind an
edge), and a name listed twice on a paper gives a self-loop.

Pairs come from each paper's own author list, inside the row: the list is
made distinct and sorted, so pair (d[i], d[j]) with i < j is already
normalised (src < dst) and appears once per paper, and the edge count is a
plain partial-aggregated ``count``.  There is no self-join on the paper id,
hence no shuffle before the edge aggregation.  The pair work of one paper
is quadratic in its list length, so a list is cut into tiles of ``chunk``
names, and one scan gives a row for each pair of tiles that holds just their
names: at most chunk * chunk pairs are ever built at once.  Where some list
is longer than a tile, these rows are dealt out by paper and tiles, so a very
long list is spread over many tasks.  All pairs are produced, nothing is
capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import graph_author_parts

PAIR_CHUNK = 256


def _names(df: DataFrame, id_col: str) -> DataFrame:
    """Per paper: sorted distinct names ``d``, their count ``m``, and names listed twice or more."""
    s = F.col("s")
    dup_pos = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))),
                       lambda k: (k < F.size(s)) & (F.element_at(s, k) == F.element_at(s, k + 1)))
    return (df.select(F.col(id_col).alias("paper"), F.array_sort(graph_author_parts(F.col("authors"))).alias("s"))
            .where(F.col("s").isNotNull())
            .select("paper",
                    F.array_distinct("s").alias("d"),
                    F.array_distinct(F.transform(dup_pos, lambda k: F.element_at(F.col("s"), k))).alias("loops"))
            .withColumn("m", F.size("d")))


def pair_tiles(df: DataFrame, id_col: str = "ingest_id", chunk: int = PAIR_CHUNK) -> DataFrame:
    """One row per paper and pair of tiles x <= y of its sorted distinct names: the names ``a`` and ``b`` of the two
    tiles, and (where these are one tile) the paper's names listed twice."""
    last = F.greatest(F.floor((F.col("m") - 1) / chunk).cast("int"), F.lit(0))
    tiles = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(
        F.sequence(i, last), lambda j: F.struct(i.alias("x"), j.alias("y")))))
    return (_names(df, id_col).select("paper", "d", "loops", F.explode_outer(tiles).alias("t"))
            .select("paper", F.col("t.x").alias("x"), F.col("t.y").alias("y"),
                    F.slice("d", F.col("t.x") * chunk + 1, F.lit(chunk)).alias("a"),
                    F.slice("d", F.col("t.y") * chunk + 1, F.lit(chunk)).alias("b"),
                    F.when(F.col("t.x") == F.col("t.y"), F.col("loops")).otherwise(F.array().cast("array<string>")).alias("loops")))


def paper_pairs(df: DataFrame, id_col: str = "ingest_id", chunk: int = PAIR_CHUNK) -> DataFrame:
    """One row per (paper, src, dst) with src <= dst, self-loops included.

    ``explode_outer`` plus a NULL filter keeps the optimizer from copying the
    pair expression into an inferred ``size(p) > 0`` filter, which would
    build every pair list twice.
    """
    rows = pair_tiles(df, id_col, chunk)
    if not df.where(F.size(F.split("authors", ",")) > chunk).isEmpty():
        rows = rows.repartition("paper", "x", "y")
    # a row per name, then per partner: both in whole-stage codegen, where nested lambdas are interpreted
    same = F.concat(F.slice("b", F.col("i") + 2, F.size("b")), F.when(F.array_contains("loops", F.col("src")), F.array("src"))
                    .otherwise(F.array().cast("array<string>")))
    return (rows.select("paper", "x", "y", "b", "loops", F.posexplode_outer("a").alias("i", "src"))
            .select("paper", "src", F.explode_outer(F.when(F.col("x") == F.col("y"), same).otherwise(F.col("b"))).alias("dst"))
            .where(F.col("dst").isNotNull()))


def coauthor_edges(df: DataFrame, id_col: str = "ingest_id", chunk: int = PAIR_CHUNK) -> DataFrame:
    """G1: (src, dst, papers) with src <= dst."""
    return (paper_pairs(df, id_col, chunk).groupBy("src", "dst")
            .agg(F.count(F.lit(1)).alias("papers")))


def coauthor_sample(sl: DataFrame, n: int = 50, id_col: str = "ingest_id") -> DataFrame:
    """The graph of the first ``n`` papers of the slice (in ingest order)."""
    return coauthor_edges(sl.orderBy(id_col).limit(n), id_col)


def coauthor_top_edges(edges: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` edges with most papers behind them."""
    return edges.orderBy(F.desc("papers"), F.asc("src"), F.asc("dst")).limit(n)


def author_degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours per author (a self-loop counts the author once).

    Edges are unique, so the degree is a count of incident edges.
    """
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    return (edges.select(F.explode(ends).alias("author"))
            .groupBy("author").agg(F.count(F.lit(1)).alias("degree")))
