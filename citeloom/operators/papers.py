"""Merging, classification and statistics of paper collections.

Every order ends in `pos`, so equal keys keep their places in the collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import taxonomy as tx
from citeloom.functions import text as t
from citeloom.operators import keywords
from citeloom.operators.ordering import numbered
from citeloom.schema import QUERY_PLACES


def first_by_key(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first record of each non-empty key."""
    ranked = df.withColumn("_key", key).where("_key <> ''")
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*(order or ("pos",))))
    return ranked.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def fetch_union(batches: list[DataFrame]) -> DataFrame:
    """The different records of query results: earlier queries first, ids normalised; pos runs anew.

    A query's own places are below QUERY_PLACES, but for the last one's.
    """
    union = None
    for i, batch in enumerate(batches):
        part = batch.withColumn("_query", F.lit(i))
        union = part if union is None else union.unionByName(part)
    return first_of_all(union.withColumn("pos", (F.col("_query").cast("long") * F.lit(QUERY_PLACES)) + F.col("pos")).drop("_query"))


def first_of_all(found: DataFrame) -> DataFrame:
    """The different records by normalised id, each where it stands first; records without an id go."""
    return first_by_key(found, t.fetch_key("id")).withColumn("id", F.col("_key")).drop("_key")


def merge(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all, actually new): existing records first, then new ones with unseen keys; known records are never refreshed.

    New records keep their order but take places after all existing ones.
    """
    top = existing.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("_top"))
    after = new.join(F.broadcast(top)).withColumn("pos", F.col("pos") + F.col("_top")).drop("_top")  # one row
    both = existing.withColumn("_new", F.lit(0)).unionByName(after.withColumn("_new", F.lit(1)))
    merged = first_by_key(both, t.merge_key("id"), "_new", "pos").drop("_key")
    return merged.drop("_new"), merged.where("_new = 1").drop("_new")


def paper_text() -> Column:
    return t.match_text("title", "abstract")


#: Keywords from which papers are joined with them; below, one expression seeks each in turn, without a shuffle.
MANY_KEYWORDS = 2_000


def categorize(papers: DataFrame, taxonomy: tx.Taxonomy) -> DataFrame:
    """Papers with the (up to three) groups whose keywords they hold most of, else Other."""
    if sum(map(len, taxonomy.groups.values())) < MANY_KEYWORDS:
        return papers.withColumn("categories", tx.categories(paper_text(), taxonomy))
    best = keywords.best_groups(papers.select("pos", paper_text().alias("text")), taxonomy)
    found = papers.drop("categories").join(best, "pos", "left").withColumn("categories", F.coalesce("categories", F.array(F.lit("Other"))))
    return found.select(*dict.fromkeys([*papers.columns, "categories"]))


def annotate(papers: DataFrame) -> DataFrame:
    """Add the methods and tools that a paper's text names."""
    return papers.withColumns({"methods": tx.groups_hit(paper_text(), tx.METHODS), "tools": tx.groups_hit(paper_text(), tx.TOOLS)})


def members(df: DataFrame, column: str, place: str = "i", name: str = "member") -> DataFrame:
    """One row per member of an array column, which gives way to (place, name).

    Rows without members go after the explosion: a plain explode lets Spark derive a filter on
    the array, a second copy of the dear expression that makes it, which sinks below the
    dealing of rows into a scan of few tasks.
    """
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode_outer(column).alias(place, name)).where(F.col(name).isNotNull())


def counted(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Count the members of an array column: (keys, member, n, first), first being where it was met first."""
    rows = members(df.select(*keys, "pos", column), column)
    return rows.groupBy(*keys, "member").agg(F.count("*").alias("n"), F.min(F.struct("pos", "i")).alias("first"))


def ranked(counts: DataFrame, most: int | None = None, *keys: str) -> DataFrame:
    """Add rank: by count, ties to the member met first; only the `most` best."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first") if keys else Window.orderBy(F.desc("n"), "first")
    if most is not None and not keys:
        counts = counts.orderBy(F.desc("n"), "first").limit(most)
    out = counts.withColumn("rank", F.row_number().over(order))
    return out if most is None else out.where(F.col("rank") <= most)


def total(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count("*").alias("total"))


def by_year(papers: DataFrame) -> DataFrame:
    return papers.where("year is not null and year <> 0").groupBy("year").agg(F.count("*").alias("n"))


def by_source(papers: DataFrame) -> DataFrame:
    """Counts in the order in which sources are met."""
    source = F.coalesce("source", F.lit("unknown")).alias("source")
    counts = papers.groupBy(source).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy("first"))).select("source", "n", "rank")


def by_category(papers: DataFrame) -> DataFrame:
    return ranked(counted(papers, "categories")).select(F.col("member").alias("category"), "n", "rank")


def group_places(papers: DataFrame, taxonomy: tx.Taxonomy) -> DataFrame:
    """(pos, category, date, description, grp_ord, rn): each paper's number in each of its categories, newest first.

    grp_ord is the category's place in the taxonomy, those that it doesn't know coming last. A
    category of any size is numbered by many tasks (see numbered).
    """
    none = F.array(F.lit("Other"))
    rows = papers.select("pos", t.text("date").alias("date"), F.explode_outer(F.coalesce("categories", none)).alias("category")).where("category is not null")  # as in members()
    ranked_rows = numbered(rows, [F.desc("date"), "pos"], "rn", ["category"])
    order = F.broadcast(taxonomy.order(papers.sparkSession))  # one row per group of the taxonomy
    return ranked_rows.join(order, "category", "left").withColumn("grp_ord", F.coalesce("grp_ord", F.lit(2**31 - 1)))


def grouped(papers: DataFrame, taxonomy: tx.Taxonomy) -> DataFrame:
    """Papers by category, newest first: adds category, description, grp_ord and rn; groups in taxonomy order, others by name."""
    return papers.join(group_places(papers, taxonomy).drop("date"), "pos")


def compacted(papers: DataFrame) -> DataFrame:
    """The papers in the same order with places 0, 1, 2, ..., computed once."""
    return numbered(papers, ["pos"], "_place").withColumn("pos", F.col("_place") - 1).drop("_place")


def facets(papers: DataFrame) -> DataFrame:
    """Values to filter by: (facet, value)."""
    part = lambda name, c, rows=papers: rows.select(F.lit(name).alias("facet"), c.cast("string").alias("value")).where("value is not null").distinct()
    return part("year", F.nullif("year", F.lit(0))).unionByName(part("source", F.col("source"))).unionByName(part("category", F.col("category"), members(papers.select("categories"), "categories", name="category")))


def kpis(papers: DataFrame) -> DataFrame:
    cats = members(papers.select("categories"), "categories").agg(F.countDistinct("member").alias("categories"))
    rest = papers.agg(F.count("*").alias("total"), F.countDistinct("source").alias("sources"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return rest.join(F.broadcast(cats))  # one row each


def tag_cloud(papers: DataFrame) -> DataFrame:
    """Category counts with their share of the largest, font size and cap-30 bar."""
    counts = by_category(papers)
    return counts.select("category", "n", t.percent_of("n", F.max("n").over(Window.partitionBy())).alias("percent"), t.tag_size("n").alias("size"), t.bar("n", 30).alias("bar"))
