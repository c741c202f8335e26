"""Trends, matrices and topics of annotated papers (see papers.annotate)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.operators.papers import counted, members, ranked

FIRST_TREND_YEAR = 2015


def top_members(papers: DataFrame, column: str, most: int = 20) -> DataFrame:
    return ranked(counted(papers, column), most).select("member", "n", "rank")


def learning_share(papers: DataFrame) -> DataFrame:
    """(papers, dl_papers, dl_ratio): records that name a method, and their percentage."""
    counts = papers.agg(F.count("*").alias("papers"), F.count_if(F.size("methods") > 0).alias("dl_papers"))
    return counts.withColumn("dl_ratio", t.ratio_percent("dl_papers", "papers"))


def trend_years(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("year") >= FIRST_TREND_YEAR).groupBy("year").agg(F.count("*").alias("total"))


def trend_methods(papers: DataFrame, most: int = 5) -> DataFrame:
    """Per year its total and best methods; a year without methods has one row of nulls.

    A null beside a paper's methods stands for the paper itself, so one pass counts both.
    """
    every = F.concat(F.array(F.lit(None).cast("string")), "methods")
    rows = papers.where(F.col("year") >= FIRST_TREND_YEAR).select("year", "pos", F.posexplode_outer(every).alias("i", "method"))  # outer as in members()
    counts = rows.groupBy("year", "method").agg(F.count("*").alias("n"), F.min(F.struct("pos", "i")).alias("first"))
    of_year, own = Window.partitionBy("year"), F.col("method").isNull()
    ranked = counts.withColumns({"total": F.max(F.when(own, F.col("n"))).over(of_year), "named": F.count("method").over(of_year), "rank": F.row_number().over(of_year.orderBy(own, F.desc("n"), "first"))})
    kept = ranked.where((~own & (F.col("rank") <= most)) | (own & (F.col("named") == 0)))
    return kept.select("year", "total", "method", F.when(~own, F.col("n")).alias("n"), F.when(~own, F.col("rank")).alias("rank"))


def newest_trend(papers: DataFrame, years: int = 5) -> DataFrame:
    """The newest of the trend's years that have papers, newest first, with their best methods."""
    rank = F.row_number().over(Window.orderBy(F.desc("year")))
    kept = trend_years(papers).orderBy(F.desc("year")).limit(years).select("year", rank.alias("place"))
    return trend_methods(papers).join(F.broadcast(kept), "year").orderBy("place", "rank")


def growth(papers: DataFrame, as_of: int) -> DataFrame:
    """(year, total, before_year, before, percent) of the newest of the last years against the present year before it."""
    return pace(trend_years(papers), as_of)


def pace(totals: DataFrame, as_of: int) -> DataFrame:
    """growth() of the totals of years (year, total)."""
    years = totals.where(F.col("year") >= as_of - 3)
    order = Window.orderBy("year")
    paired = years.withColumns({"before": F.lag("total").over(order), "before_year": F.lag("year").over(order), "last": F.lead("year").over(order)}).where("last is null")
    gain = F.bround((F.col("total") - F.col("before")) / F.greatest("before", F.lit(1)) * 100, 0).cast("long")
    return paired.select("year", "total", "before_year", "before", F.when(F.col("total") > F.col("before"), gain).alias("percent"))


def landscape(papers: DataFrame) -> DataFrame:
    """(method, category, n); a method whose papers have no category has a null category and 0."""
    rows = members(papers.select("methods", "categories"), "methods", name="method").select("method", F.explode_outer("categories").alias("category"))
    counts = rows.groupBy("method", "category").agg(F.count("category").alias("n"))
    with_any = F.max("n").over(Window.partitionBy("method"))
    return counts.withColumn("any", with_any).where("category is not null or any = 0").drop("any")


def landscape_matrix(papers: DataFrame, categories: list[str]) -> DataFrame:
    """The landscape as a matrix, with a column for each of the given categories."""
    return landscape(papers).groupBy("method").pivot("category", categories).agg(F.sum("n")).na.fill(0)


def hot_topics(papers: DataFrame, as_of: int, most: int = 10, fallback: int = 50) -> DataFrame:
    """The commonest (method, category) pairs of papers of the last two years; of the first papers if there are none."""
    recent = papers.where(F.col("year") >= as_of - 1)
    chosen = papers.orderBy("pos").limit(fallback) if recent.isEmpty() else recent  # reads years up to the first recent one
    rows = chosen.select("pos", "methods", "categories")
    rows = members(members(rows, "methods", "i", "method"), "categories", "j", "category")
    counts = rows.groupBy(F.concat("method", F.lit(" for "), "category").alias("topic")).agg(F.count("*").alias("n"), F.min(F.struct("pos", "i", "j")).alias("first"))
    return ranked(counts.withColumnRenamed("topic", "member"), most).select(F.col("member").alias("topic"), "n", "rank")


def category_insights(papers: DataFrame, as_of: int) -> DataFrame:
    """One sentence per category: how many papers, their years, and how recent they are."""
    rows = papers.select(F.coalesce("categories", F.array(F.lit("Other"))).alias("categories"), F.nullif("year", F.lit(0)).alias("year"))
    rows = members(rows, "categories", name="category")
    per = rows.groupBy("category").agg(F.count("*").alias("n"), F.min("year").alias("oldest"), F.max("year").alias("newest"), F.count_if(F.col("year") >= as_of - 1).alias("recent"))
    return told(per)


def told(per: DataFrame) -> DataFrame:
    """The sentences of categories (category, n, oldest, newest, recent)."""
    trend = F.when(F.col("recent") > F.col("n") * 0.5, "rapidly growing").when(F.col("recent") > F.col("n") * 0.25, "actively researched").when(F.col("recent") > 0, "moderately active").otherwise("established")
    plain = F.format_string("%d papers", "n")
    full = F.concat(plain, F.format_string(" (%d-%d), ", "oldest", "newest"), trend, F.format_string(", %d recent", "recent"))
    return per.select("category", F.when(F.col("newest").isNull(), plain).otherwise(full).alias("insight"))
