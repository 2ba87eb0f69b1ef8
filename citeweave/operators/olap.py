"""Dashboard views over the fact table (P13, P14, A6-A14, cube).

Each view is one DataFrame over an OLAP slice.  The dashboard works on a
pandas frame read back from CSV, so NULL keys drop out of its group-bys;
the views filter NULL keys to match.  Every aggregate keeps map-side
partial aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import QUARTILES
from ..functions.text import trimmed_author_parts
from ..functions.topics import topic_label
from .selection import percentiles


@dataclass(frozen=True)
class Slice:
    """Sidebar state: year range (inclusive) and selected quartiles and countries (None: all)."""
    years: tuple[int, int] = (2020, 2025)
    quartiles: tuple[str, ...] | None = None
    countries: tuple[str, ...] | None = None


def olap_slice(fact: DataFrame, s: Slice = Slice()) -> DataFrame:
    """AND of year range, quartile set and country set (all reach the parquet scan)."""
    out = fact.where(F.col("Annee").between(*s.years))
    for name, members in (("Quartile", s.quartiles), ("Pays", s.countries)):
        if members is not None:
            out = out.where(F.col(name).isin(list(members)))
    return out


def with_topic(fact: DataFrame) -> DataFrame:
    """The dashboard's ``Topic`` column, derived from the title unless the fact has one."""
    if "Topic" in fact.columns:
        return fact
    return fact.withColumn("Topic", topic_label(F.col("title")))


def impact_cents(c: str = "Impact_Score"):
    """Impact scores have two decimals: summing whole cents is exact and order-free,
    where a sum of doubles depends on how rows meet in partial aggregates."""
    return F.round(F.col(c) * 100).cast("bigint")


def kpis(sl: DataFrame) -> DataFrame:
    """Publications, total citations (0 on empty), mean impact to 2 places, active countries.

    The mean is the exact mean in cents rounded half-up to a whole cent, so it
    does not move with the partitioning of the slice.
    """
    k = sl.agg(
        F.count(F.lit(1)).alias("publications"),
        F.coalesce(F.sum("Citations"), F.lit(0)).cast("bigint").alias("total_citations"),
        F.sum(impact_cents()).alias("_cents"), F.count("Impact_Score").alias("_n"),
        F.countDistinct("Pays").alias("active_countries"),
    )
    return k.select("publications", "total_citations",
                    (F.round(F.col("_cents") / F.col("_n"), 0) / 100).alias("mean_impact"),
                    "active_countries")


def pubs_per_year(sl: DataFrame) -> DataFrame:
    """Publications per year."""
    return (sl.where(F.col("Annee").isNotNull()).groupBy("Annee")
            .agg(F.count(F.lit(1)).alias("Publications")).orderBy("Annee"))


def year_quartile_pivot(sl: DataFrame) -> DataFrame:
    """Crosstab year x quartile; the quartile list is fixed, so one job and a stable schema."""
    return (sl.where(F.col("Annee").isNotNull() & F.col("Quartile").isNotNull())
            .groupBy("Annee").pivot("Quartile", QUARTILES).agg(F.count(F.lit(1)))
            .fillna(0, subset=QUARTILES).orderBy("Annee"))


def quartile_counts(sl: DataFrame) -> DataFrame:
    """Rows per quartile, most first, with each quartile's share of the slice.

    The share's total is a window over the grouped result, which has at most
    one row per quartile, so the single window partition stays tiny.
    """
    g = sl.where(F.col("Quartile").isNotNull()).groupBy("Quartile").agg(F.count(F.lit(1)).alias("Count"))
    total = F.sum("Count").over(Window.partitionBy())
    return (g.withColumn("share", F.col("Count") / total)
            .orderBy(F.desc("Count"), F.asc("Quartile")))


def impact_box_stats(sl: DataFrame, group: str = "Quartile", value: str = "Impact_Score",
                     accuracy: int | None = None) -> DataFrame:
    """A10: five-number summary per group with Tukey fences, whiskers and outlier count.

    Quartiles are exact, with linear interpolation, by distributed selection
    (``selection.percentiles``), whatever the number of distinct values.
    ``accuracy`` instead takes ``percentile_approx`` of the rows with that
    accuracy (an actual value each, in one pass).
    Fences are q1 - 1.5 IQR and q3 + 1.5 IQR; whiskers are the extreme values
    inside the fences.
    """
    base = sl.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, value)
    points = [0.25, 0.5, 0.75]
    if accuracy is None:
        kind = base.schema[group].dataType.simpleString()
        found = [(g, s.n, float(s.low), float(s.high), *s.points) for g, s in percentiles(base, value, points, group).items()]
        st = base.sparkSession.createDataFrame(found, f"{group} {kind}, n bigint, min double, max double, q1 double, median double, q3 double")
    else:
        st = base.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
                                     F.percentile_approx(value, points, accuracy).alias("_q"))
        st = st.select(group, "n", "min", "max", *[F.col("_q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    st = (st.withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
          .withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    inside = (F.col(value) >= F.col("lower_fence")) & (F.col(value) <= F.col("upper_fence"))
    cols = ["n", "min", "q1", "median", "q3", "max", "lower_fence", "upper_fence"]
    # the statistics are functions of the group, so grouping by them as well
    # keeps one row per group and needs no second join
    w = (base.join(st, group)
         .groupBy(group, *cols)
         .agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"),
              F.max(F.when(inside, F.col(value))).alias("whisker_high"),
              F.count(F.when(~inside, 1)).alias("outliers")))
    return (w.select(group, "n", *[F.round(c, 6).alias(c) for c in cols[1:]],
                     F.round("whisker_low", 6).alias("whisker_low"),
                     F.round("whisker_high", 6).alias("whisker_high"), "outliers")
            .orderBy(group))


def pubs_per_country(sl: DataFrame) -> DataFrame:
    """Publications per country."""
    return (sl.where(F.col("Pays").isNotNull()).groupBy("Pays")
            .agg(F.count(F.lit(1)).alias("Count")).orderBy(F.desc("Count"), F.asc("Pays")))


def impact_by_year(sl: DataFrame) -> DataFrame:
    """Mean citations per year (exact integer sum, one division)."""
    return (sl.where(F.col("Annee").isNotNull()).groupBy(F.col("Annee").alias("Year"))
            .agg((F.sum("Citations") / F.count("Citations")).alias("Avg_Citations")).orderBy("Year"))


def top_authors(sl: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent trimmed author names of the slice (missing lists dropped)."""
    return (sl.select(F.explode(trimmed_author_parts(F.col("authors"))).alias("author"))
            .groupBy("author").agg(F.count(F.lit(1)).alias("publications"))
            .orderBy(F.desc("publications"), F.asc("author")).limit(n))


def dimension_members(fact: DataFrame) -> DataFrame:
    """Members of each dimension (year, country, quartile, topic) in one pass.

    Slider bounds are the min and max ``Annee`` member; option lists are the
    sorted members of the other dimensions.
    """
    f = with_topic(fact)
    pairs = F.array(
        F.struct(F.lit("Annee").alias("dimension"), F.col("Annee").cast("string").alias("member")),
        F.struct(F.lit("Pays").alias("dimension"), F.col("Pays").alias("member")),
        F.struct(F.lit("Quartile").alias("dimension"), F.col("Quartile").alias("member")),
        F.struct(F.lit("Topic").alias("dimension"), F.col("Topic").alias("member")),
    )
    return (f.select(F.explode(pairs).alias("p")).select("p.*")
            .where(F.col("member").isNotNull()).distinct()
            .orderBy("dimension", "member"))


def topic_distribution(df: DataFrame) -> DataFrame:
    """Articles per topic label, most first (the consumed ``Topic,Count`` table)."""
    return (with_topic(df).groupBy("Topic").agg(F.count(F.lit(1)).alias("Count"))
            .orderBy(F.desc("Count"), F.asc("Topic")))


def topic_articles(sl: DataFrame, topic: str) -> DataFrame:
    """Drill-down to one topic: title, year, journal, citations."""
    return (with_topic(sl).where(F.col("Topic") == topic)
            .select("title", "Annee", "Journal", "Citations"))


def olap_cube(fact: DataFrame) -> DataFrame:
    """All group-by combinations of (Annee, Quartile, Pays) with count, citations and mean impact.

    One materialised cube answers every sidebar state's totals; ``gid`` is
    ``grouping_id()`` (bit 2 = Annee rolled up, bit 1 = Quartile, bit 0 = Pays).
    The mean impact is the exact cents mean divided once, not an average of doubles.
    """
    return (fact.cube("Annee", "Quartile", "Pays")
            .agg(F.grouping_id().alias("gid"),
                 F.count(F.lit(1)).alias("publications"),
                 F.coalesce(F.sum("Citations"), F.lit(0)).cast("bigint").alias("total_citations"),
                 F.sum(impact_cents()).alias("_cents"), F.count("Impact_Score").alias("_n"))
            .select("Annee", "Quartile", "Pays", "gid", "publications", "total_citations",
                    (F.col("_cents") / F.col("_n") / 100).alias("mean_impact")))
