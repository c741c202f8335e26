"""Pages of a collection in an order, read where they stand.

A listing holds the places of papers in one order, numbered, in folders of RANGE numbers each,
with what they are filtered by; a guide counts the papers of each folder by these facets. The
guide tells in which folders a page of any filter lies, so that the thousandth page reads what
the first does: the guide, one or two folders of narrow rows, and the page's own papers.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.operators.ordering import numbered
from citeloom.operators.search import PAGE, allowed_years

#: Numbers to a folder.
RANGE = 1 << 14
_ROWS = "rn long, pos long, source string, year int, categories array<string>, range long"
_GUIDE = "range long, source string, year int, category string, n long"


#: Orders whose key falls; places rise in all of them where keys are equal.
FALLING = ("date_desc",)


def orders() -> dict[str, list[Column | str]]:
    return {"date_desc": [t.text("date"), "pos"], "date_asc": [t.text("date"), "pos"], "title": [F.collate(F.col("title"), "UNICODE"), "pos"]}


def build(papers: DataFrame, folder: str, order: str = "date_desc", size: int = RANGE) -> Listing:
    """List papers in an order (date_desc, date_asc, title) in a new folder."""
    spark = papers.sparkSession
    key, *rest = orders()[order]
    rows = papers.select("pos", "source", "year", "categories", key.alias("_key"))
    ranked = numbered(rows, [F.desc("_key") if order in FALLING else "_key", *rest]).drop("_key").withColumn("range", F.expr(f"(rn - 1) div {size}"))
    ranked.repartition("range").sortWithinPartitions("range", "rn").write.partitionBy("range").parquet(f"{folder}/rows")
    listing = Listing(spark, folder)
    cats = F.array_distinct(F.coalesce("categories", F.array().cast("array<string>")))
    each = listing.rows().select("range", "source", "year", F.explode(F.array_append(cats, F.lit(None))).alias("category"))
    each.groupBy("range", "source", "year", "category").agg(F.count("*").alias("n")).repartitionByRange("category", "source", "range").sortWithinPartitions("category", "source", "range").write.parquet(f"{folder}/guide")
    return listing


class Kept(NamedTuple):
    """What papers are filtered by; a paper without a year passes any range of years."""

    source: str | None = None
    first: int | None = None
    last: int | None = None
    category: str | None = None

    def where(self, rows: DataFrame) -> DataFrame:
        kept = rows.where(F.col("source") == self.source) if self.source else rows
        return kept.where(allowed_years(self.first, self.last))


class Listing(NamedTuple):
    """A listing's folder."""

    spark: SparkSession
    folder: str

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(f"{self.folder}/rows")

    def guide(self) -> DataFrame:
        return self.spark.read.schema(_GUIDE).parquet(f"{self.folder}/guide")

    def ranges(self, kept: Kept) -> DataFrame:
        """(range, n, upto): how many papers of a filter each folder holds, and how many it and those before do."""
        counts = kept.where(self.guide().where(F.col("category").eqNullSafe(F.lit(kept.category or None)))).groupBy("range").agg(F.sum("n").alias("n"))
        return counts.withColumn("upto", F.sum("n").over(Window.orderBy("range")))  # a row per folder

    def places(self, kept: Kept, number: int, size: int = PAGE) -> list[int]:
        """The places (pos) of a page's papers, in order; beyond the last page it is the last."""
        ranges = self.ranges(kept)
        total = ranges.agg(F.max("upto")).first()[0] or 0
        skip = (min(max(1, number), max(1, -(-total // size))) - 1) * size
        wanted = ranges.where((F.col("upto") > skip) & (F.col("upto") - F.col("n") < skip + size)).orderBy("range").collect()
        if not wanted:
            return []
        rows = kept.where(self.rows().where(F.col("range").isin([r["range"] for r in wanted])))
        if kept.category:
            rows = rows.where(F.array_contains("categories", kept.category))
        before = wanted[0]["upto"] - wanted[0]["n"]
        found = rows.orderBy("rn").limit(skip - before + size).select("pos").collect()  # of a folder at most, or a page
        return [r["pos"] for r in found[skip - before :]]


def page(papers: DataFrame, listing: Listing, number: int, size: int = PAGE, **kept: object) -> DataFrame:
    """What search.page(search.browse(papers, ...)) gives, by a listing of just these papers."""
    places = listing.places(Kept(**kept), number, size)
    order = F.array_position(F.lit(places).cast("array<bigint>") if places else F.array().cast("array<bigint>"), F.col("pos"))
    return papers.where(F.col("pos").isin(places)).orderBy(order)
