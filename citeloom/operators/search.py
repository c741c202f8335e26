"""Keyword search, the provider-side keyword filter, and faceted browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.functions.taxonomy import bound

PAGE = 25


def _hits(text: Column, terms: list[str]) -> Column:
    if not terms:
        return F.lit(0)
    return bound(text, lambda x: F.size(F.filter(F.array(*map(F.lit, terms)), lambda k: F.contains(x, k))))


def searched_text() -> Column:
    """The lower-cased text of a paper that a search's terms are sought in."""
    return t.match_text("title", "abstract", F.array_join(F.coalesce("categories", F.array().cast("array<string>")), " "))


def search(papers: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Papers with the most query terms in title, abstract and categories; an empty query finds nothing.

    Papers without a hit go last and are dropped after the cut: a filter before it would be
    pushed, categorisation included, into the scan.
    """
    scored = papers.withColumn("score", _hits(searched_text(), t.terms_of(query)))
    return scored.orderBy(F.desc("score"), "pos").limit(limit).where("score > 0")


def provider_filter(rows: DataFrame, query: str | Column) -> DataFrame:
    """Rows with at least two of the query's words of three letters and more, or the one if it has one; all if it has none.

    The query may be a column, so that the answers of many searches are filtered together.
    """
    words = F.split(F.lower(query if isinstance(query, Column) else F.lit(query)), r"\s+")
    return rows.where(
        bound(
            F.struct(F.filter(words, lambda w: F.length(w) > 2).alias("terms"), t.match_text("title", "abstract").alias("text")),
            lambda x: F.size(F.filter(x["terms"], lambda k: F.contains(x["text"], k))) >= F.least(F.lit(2), F.size(x["terms"])),
        )
    )


def allowed_years(first: int | None, last: int | None) -> Column:
    """Whether a year lies in a range; a missing one does."""
    outside = (F.col("year") < (first or 0)) | (F.col("year") > (last or 9999))
    return ~F.coalesce(outside, F.lit(False))


def browse(papers: DataFrame, source: str | None = None, first: int | None = None, last: int | None = None, category: str | None = None, order: str = "date_desc") -> DataFrame:
    """Papers by facets. A missing year passes the year range. Orders: date_desc, date_asc, title."""
    kept = papers
    if source:
        kept = kept.where(F.col("source") == source)
    kept = kept.where(allowed_years(first, last))
    if category:
        kept = kept.where(F.array_contains("categories", category))
    date = t.text("date")
    return kept.orderBy(*{"date_desc": (F.desc(date), "pos"), "date_asc": (date, "pos"), "title": (F.collate(F.col("title"), "UNICODE"), "pos")}[order])


def page(ordered: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """A page, from 1; beyond the last it is the last."""
    last = max(1, -(-ordered.count() // size))
    number = min(max(1, number), last)
    return ordered.offset((number - 1) * size).limit(size)


def page_strip(number: int, pages: int, around: int = 2) -> list[int | None]:
    """Page numbers to show; None is an ellipsis."""
    shown = sorted({1, pages, *range(max(1, number - around), min(pages, number + around) + 1)})
    out: list[int | None] = []
    for a, b in zip([0, *shown], shown):
        out += [None, b] if b - a > 1 else [b]
    return out
