"""Statistics of a collection as one small table that updates add to.

A state has a row (kind, a, b, year, n, first) for everything that the statistics count: years,
sources, categories, methods, tools and pairs of method and category, each with where it was
met first. It comes from annotated papers in one pass with one shuffle of partial counts; two
states add up to that of both collections. So an update reads its own papers alone, and all
statistics are read off the state, whose size follows the vocabulary and not the papers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.operators import analysis as an
from citeloom.operators import papers as pp

SCHEMA = "kind string, a string, b string, year int, n long, first struct<pos: bigint, i: int, j: int>"
_ENTRY = "array<struct<kind: string, a: string, b: string, year: int, n: bigint, i: int, j: int>>"
_KEYS = ["kind", "a", "b", "year"]


def _entry(kind: str, a: Column | str = "", b: Column | str | None = None, year: Column | None = None, n: Column | int = 1, i: Column | int = 0, j: Column | int = 0) -> Column:
    lit = lambda x, kind="string": (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(F.lit(kind).alias("kind"), lit(a).alias("a"), lit(b).alias("b"), lit(year, "int").alias("year"), lit(n, "long").alias("n"), lit(i, "int").alias("i"), lit(j, "int").alias("j"))


def _pairs() -> Column:
    """An entry for each method and category of a paper; a method alone counts none."""
    year, cats = F.col("year"), F.coalesce("categories", F.array().cast("array<string>"))
    alone = lambda m, i: F.array(_entry("pair", m, None, year, 0, i))
    both = lambda m, i: F.transform(cats, lambda c, j: _entry("pair", m, c, year, 1, i, j))
    return F.flatten(F.transform("methods", lambda m, i: F.when(F.size(cats) == 0, alone(m, i)).otherwise(both(m, i))))


def state(annotated: DataFrame) -> DataFrame:
    """The state of papers with categories, methods and tools (see papers.annotate)."""
    year, some = F.col("year"), F.nullif("year", F.lit(0))
    missing = F.array(_entry("category", "Other", "missing", year))
    entries = F.concat(
        F.array(_entry("all"), _entry("learning", n=(F.size("methods") > 0).cast("long")), _entry("year", year=some), _entry("source", F.coalesce("source", F.lit("unknown")))).cast(_ENTRY),
        F.coalesce(F.transform("categories", lambda c, i: _entry("category", c, None, some, i=i)), missing).cast(_ENTRY),
        F.transform("methods", lambda m, i: _entry("method", m, None, year, i=i)).cast(_ENTRY),
        F.transform("tools", lambda m, i: _entry("tool", m, i=i)).cast(_ENTRY),
        _pairs().cast(_ENTRY),
    )
    rows = annotated.join(_early_bound(annotated)).select("pos", F.explode_outer(F.concat(entries, _early())).alias("e"))
    return rows.select("e.kind", "e.a", "e.b", "e.year", "e.n", F.struct("pos", "e.i", "e.j").alias("first")).groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


#: Papers whose topics stand in for those of recent years where there are none.
EARLY = 50


def _early_bound(annotated: DataFrame) -> DataFrame:
    """The place of the last of the first papers; found from places alone, so that no text is classified for it."""
    return F.broadcast(annotated.select("pos").orderBy("pos").limit(EARLY).agg(F.max("pos").alias("_bound")))  # one row


def _early() -> Column:
    """The entries of one of the first papers: its place, and each of its pairs; no two of these are added up."""
    own = lambda e: F.concat_ws(":", F.col("pos").cast("string"), e["kind"], e["i"].cast("string"), e["j"].cast("string"))
    entries = F.concat(F.array(_entry("place")).cast(_ENTRY), F.filter(_pairs(), lambda e: e["n"] > 0).cast(_ENTRY))
    rows = F.transform(entries, lambda e: _entry("early", own(e), F.concat(e["a"], F.lit(" for "), e["b"]), None, 1, e["i"], e["j"]))
    return F.when(F.col("pos") <= F.col("_bound"), rows.cast(_ENTRY)).otherwise(F.array().cast(_ENTRY))


def combined(*states: DataFrame) -> DataFrame:
    """The state of all papers together, whose places (pos) say which came first."""
    added = reduce(DataFrame.unionByName, states).groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    place = F.dense_rank().over(Window.partitionBy(F.col("kind") == "early").orderBy("first.pos"))  # of EARLY papers in each state
    return added.withColumn("_place", place).where((F.col("kind") != "early") | (F.col("_place") <= EARLY)).drop("_place")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _of(totals: DataFrame, kind: str, *keys: str) -> DataFrame:
    return totals.where(F.col("kind") == kind).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def total(totals: DataFrame) -> DataFrame:
    return totals.agg(F.coalesce(F.sum(F.when(F.col("kind") == "all", F.col("n"))), F.lit(0)).alias("total"))


def learning_share(totals: DataFrame) -> DataFrame:
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    counts = totals.agg(count("all").alias("papers"), count("learning").alias("dl_papers"))
    return counts.withColumn("dl_ratio", pp.t.ratio_percent("dl_papers", "papers"))


def by_year(totals: DataFrame) -> DataFrame:
    return _of(totals, "year", "year").where("year is not null").select("year", "n")


def by_source(totals: DataFrame) -> DataFrame:
    return _of(totals, "source", "a").select(F.col("a").alias("source"), "n", F.row_number().over(Window.orderBy("first")).alias("rank"))


def by_category(totals: DataFrame) -> DataFrame:
    counts = _of(totals.where("b is null"), "category", "a").withColumnRenamed("a", "member")
    return pp.ranked(counts).select(F.col("member").alias("category"), "n", "rank")


def top_members(totals: DataFrame, kind: str, most: int = 20) -> DataFrame:
    """The commonest members of a kind: method or tool."""
    return pp.ranked(_of(totals, kind, "a").withColumnRenamed("a", "member"), most).select("member", "n", "rank")


def trend_years(totals: DataFrame) -> DataFrame:
    return by_year(totals).where(F.col("year") >= an.FIRST_TREND_YEAR).withColumnRenamed("n", "total")


def trend_methods(totals: DataFrame, most: int = 5) -> DataFrame:
    counts = _of(totals.where(F.col("year") >= an.FIRST_TREND_YEAR), "method", "year", "a").withColumnRenamed("a", "member")
    best = pp.ranked(counts, most, "year").select("year", F.col("member").alias("method"), "n", "rank")
    return trend_years(totals).join(best, "year", "left")


def landscape(totals: DataFrame) -> DataFrame:
    counts = _of(totals, "pair", "a", "b").select(F.col("a").alias("method"), F.col("b").alias("category"), "n")
    with_any = F.max("n").over(Window.partitionBy("method"))
    return counts.withColumn("any", with_any).where("category is not null or any = 0").drop("any")


def hot_topics(totals: DataFrame, as_of: int, most: int = 10) -> DataFrame:
    """The commonest pairs of the last two years; of the first papers if no paper is so recent."""
    recent = F.col("year") >= as_of - 1
    if totals.where((F.col("kind") == "year") & recent).isEmpty():
        counts = _of(totals.where("b is not null"), "early", "b").withColumnRenamed("b", "member")
    else:
        counts = _of(totals.where(recent & F.col("b").isNotNull()).withColumn("topic", F.concat("a", F.lit(" for "), "b")), "pair", "topic").withColumnRenamed("topic", "member")
    return pp.ranked(counts, most).select(F.col("member").alias("topic"), "n", "rank")


def growth(totals: DataFrame, as_of: int) -> DataFrame:
    return an.pace(trend_years(totals), as_of)


def category_insights(totals: DataFrame, as_of: int) -> DataFrame:
    rows = totals.where("kind = 'category'").withColumnRenamed("a", "category").withColumn("year", F.nullif("year", F.lit(0)))
    recent = F.sum(F.when(F.col("year") >= as_of - 1, F.col("n")).otherwise(0))
    return an.told(rows.groupBy("category").agg(F.sum("n").alias("n"), F.min("year").alias("oldest"), F.max("year").alias("newest"), recent.alias("recent")))
