"""The OLAP cube with mergeable states: one landed table of cells answers every dashboard view.

A cell is a combination of (Annee, Quartile, Pays).  Beside the additive measures it holds states that merge: theta
sketches of its authors and countries, a KLL sketch of its impact scores.  A view of a slice filters cells, merges
them and reads the states; the fact table is not touched again.  Counts, sums, extremes and means are exact; distinct
counts are exact up to ``2 ** DISTINCT_LG`` members and within ``DISTINCT_ERROR`` beyond; quantiles are within
``RANK_ERROR`` of the wanted rank (99 %).

States are partial-aggregated where the rows are and cells are few (a row for each combination of members), so a hot
year or country costs one state for each task.  Rows with a NULL dimension are cells like others, as in the cube.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed_author_parts
from .olap import impact_cents

DIMENSIONS = ("Annee", "Quartile", "Pays")
DISTINCT_LG, IMPACT_K = 14, 1000
DISTINCT_ERROR = 3 / 2 ** (DISTINCT_LG / 2)            # three standard errors of a theta sketch
GRID = 1000                                            # steps in which outliers are counted
RANK_ERROR = 2.296 / IMPACT_K ** 0.9021                # of a KLL sketch, published by its authors


def cells(fact: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """The base cuboid: measures and states of every combination of ``dims``."""
    own = fact.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("publications"), F.sum("Citations").cast("bigint").alias("citations"),
        F.sum(impact_cents()).alias("cents"), F.count("Impact_Score").alias("scored"),
        F.min("Impact_Score").alias("min_impact"), F.max("Impact_Score").alias("max_impact"),
        F.kll_sketch_agg_double("Impact_Score", IMPACT_K).alias("impact_state"),
        F.theta_sketch_agg("Pays", DISTINCT_LG).alias("country_state"))
    # explode drops papers without authors: their cells keep a NULL state, which merges as empty
    people = (fact.select(*dims, F.explode(trimmed_author_parts(F.col("authors"))).alias("_author"))
              .groupBy(*[F.col(d).alias(f"_{d}") for d in dims]).agg(F.theta_sketch_agg("_author", DISTINCT_LG).alias("author_state")))
    same = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in dims]
    return own.join(people, same, "left").drop(*[f"_{d}" for d in dims])


def _merged() -> list[Column]:
    """The aggregates that merge cells into a cell of a coarser grouping."""
    return [F.sum("publications").alias("publications"), F.sum("citations").alias("citations"), F.sum("cents").alias("cents"),
            F.sum("scored").alias("scored"), F.min("min_impact").alias("min_impact"), F.max("max_impact").alias("max_impact"),
            F.kll_merge_agg_double("impact_state", IMPACT_K).alias("impact_state"),
            F.theta_union_agg("country_state", DISTINCT_LG).alias("country_state"),
            F.theta_union_agg("author_state", DISTINCT_LG).alias("author_state")]


def roll_up(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells merged over all dimensions but ``by``."""
    return table.groupBy(*by).agg(*_merged())


def cube(table: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Every grouping of ``dims`` as merged cells, with ``gid`` (``grouping_id()``)."""
    return table.cube(*dims).agg(F.grouping_id().alias("gid"), *_merged())


def _read(table: DataFrame) -> DataFrame:
    """Merged cells with what their states tell: totals, means and distinct members."""
    return table.select("*", F.coalesce("publications", F.lit(0)).cast("bigint").alias("_publications"),
                        F.coalesce("citations", F.lit(0)).cast("bigint").alias("total_citations"),
                        F.theta_sketch_estimate("country_state").alias("active_countries"),
                        F.theta_sketch_estimate("author_state").alias("active_authors"))


def kpis(table: DataFrame) -> DataFrame:
    """A6 from cells: publications, total citations, mean impact to 2 places, active countries and authors."""
    return _read(roll_up(table)).select(
        F.col("_publications").alias("publications"), "total_citations",
        (F.round(F.col("cents") / F.col("scored"), 0) / 100).alias("mean_impact"), "active_countries", "active_authors")


def groupings(table: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """The readable cube: every grouping with its totals, mean and extreme impact, countries and authors."""
    return _read(cube(table, dims)).select(
        *dims, "gid", F.col("_publications").alias("publications"), "total_citations",
        (F.col("cents") / F.col("scored") / 100).alias("mean_impact"), "min_impact", "max_impact", "active_countries", "active_authors")


def box_stats(table: DataFrame, group: str = "Quartile") -> DataFrame:
    """A10 from cells: as ``olap.impact_box_stats`` but for the whiskers; quartiles and outliers are read from the
    merged impact states (ranks within ``RANK_ERROR``), n, min and max are exact."""
    g = roll_up(table.where(F.col(group).isNotNull() & (F.col("scored") > 0)), [group])
    q = g.withColumn("_q", F.kll_sketch_get_quantile_double("impact_state", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    q = q.select(group, F.col("scored").alias("n"), F.col("min_impact").alias("min"), F.col("max_impact").alias("max"), "impact_state",
                 *[F.col("_q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    q = (q.withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
         .withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    # ranks are only told for constants, so the fences are placed among GRID + 1 even quantiles of the state
    even = F.kll_sketch_get_quantile_double("impact_state", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    beyond = F.size(F.filter("_even", lambda x: (x < F.col("lower_fence")) | (x > F.col("upper_fence"))))
    return q.withColumn("_even", even).select(
        group, "n", "min", "q1", "median", "q3", "max", "lower_fence", "upper_fence",
        F.round(F.col("n") * beyond / (GRID + 1)).cast("bigint").alias("outliers"))


def rank_errors(table: DataFrame, slice_rows: DataFrame, group: str = "Quartile", value: str = "Impact_Score") -> DataFrame:
    """For each group of ``box_stats``, how far its quartiles lie from the wanted ranks among the slice's own rows (0
    where the wanted rank falls on the value), and the outliers' distance, as shares of the group."""
    b = box_stats(table, group)
    rows = slice_rows.select(F.col(group).alias("_g"), F.col(value).alias("_v")).where("_v IS NOT NULL")
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    counts = [F.count(F.when(F.col("_v") < F.col(c), 1)).alias(f"{c}_below") for c in points]
    counts += [F.count(F.when(F.col("_v") <= F.col(c), 1)).alias(f"{c}_upto") for c in points]
    out = F.count(F.when((F.col("_v") < F.col("lower_fence")) | (F.col("_v") > F.col("upper_fence")), 1)).alias("_out")
    e = rows.join(b, F.col("_g") == F.col(group)).groupBy(group, "n", "min", "max", "outliers").agg(*counts, out)
    far = [F.greatest(F.col(f"{c}_below") / F.col("n") - p, p - F.col(f"{c}_upto") / F.col("n"), F.lit(0.0)).alias(f"{c}_error")
           for c, p in points.items()]
    return e.select(group, "n", "min", "max", *far, (F.abs(F.col("outliers") - F.col("_out")) / F.col("n")).alias("outlier_error"))
