"""The library's answers as JSON texts, for any server or notebook to pass on."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.taxonomy import Taxonomy
from citeloom.operators import papers as pp
from citeloom.operators import report
from citeloom.operators.search import search
from citeloom.schema import FIELDS


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def paper_lines(papers: DataFrame) -> DataFrame:
    """(pos, value): each paper as a JSON object, made where the rows are."""
    return papers.select("pos", F.to_json(F.struct(*(c for c in FIELDS if c != "pos")), {"ignoreNullFields": "false"}).alias("value"))


def found(papers: DataFrame, query: str, limit: int = 50) -> str:
    """A JSON array of the papers that a search finds, best first."""
    rows = paper_lines(search(papers, query, limit).withColumn("pos", -F.col("score"))) if query.split() else None
    return "[" + ", ".join(r["value"] for r in rows.collect()) + "]" if rows else "[]"


def statistics(papers: DataFrame, taxonomy: Taxonomy) -> dict:
    """Counts by year, source and category, and the values to filter by."""
    years = {r["year"]: r["n"] for r in pp.by_year(papers).collect()}
    sources = {r["source"]: r["n"] for r in pp.by_source(papers).orderBy("rank").collect()}
    by_category = {r["category"]: r["n"] for r in pp.by_category(papers).orderBy("rank").collect()}
    places = {g: i for i, g in enumerate(taxonomy.groups)}
    grouped = dict(sorted(by_category.items(), key=lambda x: (places.get(x[0], len(places)), x[0])))
    return {
        "total_papers": papers.count(),
        "by_year": years,
        "by_source": sources,
        "by_category": by_category,
        "category_counts": grouped,
        "years": sorted(years, reverse=True),
        "sources": sorted(sources),
        "categories": list(grouped),
    }


def digest(new: DataFrame, papers: DataFrame, taxonomy: Taxonomy, generated: str) -> dict:
    counts = report.digest_counts(new, taxonomy).collect()
    return {
        "summary_text": report.digest_text(new, papers, taxonomy, generated),
        "new_papers_by_category": {r["category"]: r["n"] for r in counts},
        "statistics": statistics(papers, taxonomy),
        "new_statistics": statistics(new, taxonomy),
        "generated_at": generated,
    }
