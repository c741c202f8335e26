"""Digests and reports, rendered on the driver from small aggregates."""

from __future__ import annotations

from functools import reduce
from html import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.functions.taxonomy import Taxonomy
from citeloom.operators import papers as pp
from citeloom.operators import totals as tt
from citeloom.shared import cut


def digest_counts(new: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(category, n, place): new papers by category, in group order."""
    return pp.grouped(new, taxonomy).groupBy("category", "grp_ord").agg(F.count("*").alias("n")).orderBy("grp_ord", "category").select("category", "n")


def digest_top(new: DataFrame, most: int = 5) -> DataFrame:
    """The newest papers as two lines of text."""
    newest = new.orderBy(F.desc(t.text("date")), "pos").limit(most)
    head = F.format_string("  * [%s] %s", F.coalesce(F.col("year").cast("string"), F.lit("None")), "title")
    return newest.select("pos", t.text("date").alias("date"), head.alias("head"), F.concat(F.lit("    "), t.authors_digest("authors"), F.lit(" | "), t.text("journal")).alias("tail"))


# The wordings of the digest and of the research summary.
DIGEST_TITLE, DIGEST_MADE = "Literature Update", "Generated: %s"
DIGEST_TOTAL, DIGEST_NEW, DIGEST_NONE = "Total papers in database: %s", "New papers in this update: %s", "No new papers found in this update."
DIGEST_GROUP, DIGEST_HEADINGS = "  - %s: %s paper(s)", {2: "New Papers by Category:", 3: "Highlights (most recent new papers):"}
SUMMARY_NONE, SUMMARY_TITLE, SUMMARY_RULE = "No papers to analyze.", "RESEARCH LANDSCAPE", "=" * 60
SUMMARY_TOTAL, SUMMARY_LEARNING = "Total papers tracked: %s", "Deep learning-related: %s (%s%%)"
SUMMARY_METHOD, SUMMARY_TOOL = "  %-25s %4d %s", "  %-25s %4d"
SUMMARY_YEAR, SUMMARY_TOPIC = "  %s: %s papers | Top methods: %s", "  • %s (%s papers)"
SUMMARY_FACTS = ("  • %s is the most widely used architecture", "  • %s is the most referenced tool/model", "  • %s%% growth from %s to %s", "  • Publication pace slowing from %s to %s")
SUMMARY_HEADINGS = {2: "--- Most Used DL Architectures ---", 3: "--- Most Referenced Tools ---", 4: "--- Recent Trends ---", 5: "--- Hot Research Directions ---", 6: "--- Key Observations ---"}


def _lines(part: int, rows: DataFrame, rank: Column | int, *lines: Column) -> DataFrame:
    """(part, rank, line): the given lines of each row."""
    told = F.posexplode(F.array(*lines)).alias("i", "line")
    return rows.select((rank if isinstance(rank, Column) else F.lit(rank)).cast("int").alias("r"), told).select(F.lit(part).alias("part"), (100 * F.col("r") + F.col("i")).alias("rank"), "line")


def paragraphs(lines: DataFrame, headings: dict[int, str]) -> list[str]:
    """The parts in order under their headings; the lines are as few as the limits of their parts."""
    told: dict[int, list[str]] = {}
    for r in lines.where("line is not null").orderBy("part", "rank").collect():
        told.setdefault(r["part"], []).append(r["line"])
    return ["\n".join([headings[p], *x] if p in headings else x) for p, x in told.items()]


def digest_lines(new: DataFrame, everything: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(part, rank, line) of the digest: counts, new papers by category, the newest papers."""
    totals = everything.agg(F.count("*").alias("total")).join(F.broadcast(new.agg(F.count("*").alias("n"))))  # one row each
    counts = _lines(1, totals, 0, F.format_string(DIGEST_TOTAL, "total"), F.format_string(DIGEST_NEW, "n"))
    none = _lines(4, totals.where("n = 0"), 0, F.lit(DIGEST_NONE))
    place = F.row_number().over(Window.orderBy("grp_ord", "category"))
    groups = pp.grouped(new, taxonomy).groupBy("category", "grp_ord").agg(F.count("*").alias("n")).withColumn("place", place)
    newest = digest_top(new).withColumn("place", F.row_number().over(Window.orderBy(F.desc("date"), "pos")))
    top = _lines(3, newest, F.col("place"), F.col("head"), F.col("tail"))
    return counts.unionByName(_lines(2, groups, F.col("place"), F.format_string(DIGEST_GROUP, "category", "n"))).unionByName(top).unionByName(none)


def digest_text(new: DataFrame, everything: DataFrame, taxonomy: Taxonomy, generated: str) -> str:
    head = "\n".join([DIGEST_TITLE, DIGEST_MADE % generated])
    return "\n\n".join([head, *paragraphs(digest_lines(new, everything, taxonomy), DIGEST_HEADINGS)])


def entries(papers: DataFrame) -> DataFrame:
    """(pos, entry): papers as numbered text entries."""
    doi = F.when(t.text("doi") != "", F.concat(F.lit("\n   DOI: "), "doi")).otherwise("")
    abstract = F.when(t.text("abstract") != "", F.concat(F.lit("\n   > "), t.truncated("abstract", 200, 197))).otherwise("")
    year = F.coalesce(F.col("year").cast("string"), F.lit("None"))
    return papers.select("pos", F.concat(F.col("pos").cast("string"), F.lit(". **"), "title", F.lit("**\n   "), t.authors_entry("authors"), F.lit("\n   *"), t.text("journal"), F.lit("* ("), year, F.lit(")"), doi, abstract).alias("entry"))


def category_rows(papers: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(category, grp_ord, rn, line): the rows of the report's tables."""
    rows = pp.grouped(papers, taxonomy)
    cell = lambda c: F.concat(F.lit(" "), c, F.lit(" |"))
    line = F.concat(F.lit("|"), cell(F.col("rn").cast("string")), cell(t.title_cell("title")), cell(t.authors_readme("authors")), cell(t.escaped_cell("journal")), cell(F.coalesce(F.col("year").cast("string"), F.lit(""))), cell(t.links("url", "doi")))
    return rows.select("category", "grp_ord", "description", "rn", line.alias("line"))


def readme_lines(papers: DataFrame, taxonomy: Taxonomy, date: str, title: str = "Literature") -> DataFrame:
    """(part, grp_ord, category, rn, line): the Markdown report, in that order: contents, statistics, and a table per category."""
    rows = category_rows(papers, taxonomy)
    groups = rows.groupBy("category", "grp_ord", "description").agg(F.count("*").alias("n"))

    def lines(part: int, df: DataFrame, rn: Column | int, *texts: Column | str) -> DataFrame:
        """Texts of each row one after the other, from rn on; of the whole report where df has no category."""
        of = {"category": "string", "grp_ord": "int"}
        known = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in of.items()]
        every = F.array(*(x if isinstance(x, Column) else F.lit(x) for x in texts))
        told = df.select(*known, (rn if isinstance(rn, Column) else F.lit(rn)).cast("long").alias("_rn"), F.posexplode(every).alias("_i", "line"))
        return told.select(F.lit(part).alias("part"), "grp_ord", "category", (F.col("_rn") + F.col("_i")).alias("rn"), "line")

    one = papers.sparkSession.range(1)
    counts = papers.agg(F.count("*").alias("papers")).join(groups.agg(F.count("*").alias("groups")))  # one row each
    head = lines(0, counts, 0, f"# {title}", "", F.format_string(f"Last updated {date}. %d papers in %d categories.", "papers", "groups"), "", "## Table of Contents", "")
    contents = lines(1, groups, 0, F.format_string("- [%s](#%s) (%d papers)", "category", t.anchor("category"), "n"))
    years = lines(3, pp.by_year(papers), -F.col("year"), F.format_string("| %d | %d %s |", "year", "n", t.bar("n", 50)))
    sources = lines(5, pp.by_source(papers), F.col("rank"), F.format_string("| %s | %d |", "source", "n"))
    tables = [lines(2, one, 0, "", "## Statistics", "", "### Papers by Year", "| Year | Count |", "|------|-------|"), years, lines(4, one, 0, "", "### Papers by Source", "| Source | Count |", "|--------|-------|"), sources]
    told = F.when(F.col("description") != "", F.concat(F.lit("> "), "description", F.lit("\n\n"))).otherwise("")  # with the blank line after it
    opened = lines(6, groups, -6, "", F.concat(F.lit("## "), "category"), "", F.concat(told, F.format_string("<details><summary>Show %d papers</summary>", "n")), "", "| # | Title | Authors | Journal | Year | Links |", "|---|-------|---------|---------|------|-------|")
    body = rows.select(F.lit(6).alias("part"), "grp_ord", "category", "rn", "line")
    return reduce(DataFrame.unionByName, [head, contents, *tables, opened, body, lines(6, groups, 1 << 62, "", "</details>")])


README_ORDER = ("part", "grp_ord", "category", "rn")


def digest_page(new: DataFrame, everything: DataFrame, taxonomy: Taxonomy, generated: str) -> DataFrame:
    """(part, date, pos, line) of the digest as an HTML page: counts by category, then papers; in order by part, falling date and pos."""
    counts = "".join(f"<li><strong>{escape(r['category'])}</strong>: {r['n']} paper(s)</li>" for r in digest_counts(new, taxonomy).collect())
    head = f"<!DOCTYPE html>\n<html><body><h1>Literature Update {escape(generated[:10])}</h1><p>Total papers tracked: {everything.count()}</p><p>New papers this update: {new.count()}</p><ul>{counts}</ul><table>"
    safe = lambda c: F.replace(t.html_escaped(c), F.lit("'"), F.lit("&#x27;"))
    year = F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit(""))
    link = F.concat(F.lit('<tr><td><a href="'), F.when(t.text("url") == "", "#").otherwise(safe("url")), F.lit('">'), safe("title"), F.lit("</a><br>"))
    told = F.concat(safe(t.authors_email("authors")), F.lit(" | "), safe("journal"), F.lit(" ("), year, F.lit(")<br>"))
    rest = F.concat(safe(F.array_join("categories", ", ")), F.lit("<br>"), safe(t.truncated("abstract", 200, 200)), F.lit("</td></tr>"))
    rows = new.select(F.lit(1).alias("part"), t.text("date").alias("date"), "pos", F.concat(link, told, rest).alias("line"))
    ends = [(0, "", None, head), (2, "", None, "</table></body></html>")]
    return rows.unionByName(new.sparkSession.createDataFrame(ends, "part int, date string, pos long, line string"))


def summary_lines(totals: DataFrame, as_of: int) -> DataFrame:
    """(part, rank, line) of the research summary, read off the collection's totals: shares, best methods and tools, recent years, topics, facts."""
    share = tt.learning_share(totals).where("papers > 0")
    head = _lines(1, share, 0, F.format_string(SUMMARY_TOTAL, "papers"), F.format_string(SUMMARY_LEARNING, "dl_papers", F.col("dl_ratio").cast("string")))
    methods, tools = tt.top_members(totals, "method", 8), tt.top_members(totals, "tool", 8)
    best = _lines(2, methods, F.col("rank"), F.format_string(SUMMARY_METHOD, "member", "n", t.bar("n", 30)))
    named = _lines(3, tools, F.col("rank"), F.format_string(SUMMARY_TOOL, "member", "n"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("method").isNotNull(), F.struct("rank", "method", "n")))), lambda x: F.format_string("%s(%s)", x["method"], x["n"]))
    years = tt.trend_methods(totals).where(F.col("year") >= as_of - 3).groupBy("year", "total").agg(F.array_join(listed, ", ").alias("best"))
    recent = _lines(4, years, as_of - F.col("year") + 100, F.format_string(SUMMARY_YEAR, "year", "total", "best"))
    topics = _lines(5, tt.hot_topics(totals, as_of).where("rank <= 6"), F.col("rank"), F.format_string(SUMMARY_TOPIC, "topic", "n"))
    change = tt.growth(totals, as_of).where("before <> total")
    pace = F.when(F.col("percent").isNotNull(), F.format_string(SUMMARY_FACTS[2], "percent", "before_year", "year")).otherwise(F.format_string(SUMMARY_FACTS[3], "before_year", "year"))
    facts = [_lines(6, methods.where("rank = 1"), 1, F.format_string(SUMMARY_FACTS[0], "member")), _lines(6, tools.where("rank = 1"), 2, F.format_string(SUMMARY_FACTS[1], "member")), _lines(6, change, 3, pace)]
    return reduce(DataFrame.unionByName, [head, best, named, recent, topics, *facts])


def summary(totals: DataFrame, as_of: int, generated: str, title: str = SUMMARY_TITLE) -> str:
    told = paragraphs(summary_lines(totals, as_of), SUMMARY_HEADINGS)
    return "\n\n".join(["\n".join([SUMMARY_RULE, title, SUMMARY_RULE]), *told, DIGEST_MADE % generated]) if told else SUMMARY_NONE


def analyze(papers: DataFrame, as_of: int, generated: str) -> dict:
    """All analyses of categorised papers."""
    return analysis(cut(tt.state(pp.annotate(papers))), as_of, generated)


def analysis(totals: DataFrame, as_of: int, generated: str) -> dict:
    """All analyses of a collection's totals; every value is a small aggregate of methods, tools, years and categories."""
    share = tt.learning_share(totals).first()
    if not share["papers"]:
        return {"research_summary": SUMMARY_NONE, "dl_method_distribution": {}}
    trend: dict[int, dict] = {}
    for r in tt.trend_methods(totals).orderBy("year", "rank").collect():
        methods = trend.setdefault(r["year"], {"total": r["total"], "top_methods": {}})["top_methods"]
        if r["method"] is not None:
            methods[r["method"]] = r["n"]
    matrix: dict[str, dict[str, int]] = {}
    for r in tt.landscape(totals).where("category is not null").orderBy("method", F.desc("n"), "category").collect():
        matrix.setdefault(r["method"], {})[r["category"]] = r["n"]
    # The names of the results.
    return {
        "research_summary": summary(totals, as_of, generated),
        "dl_method_distribution": {r["member"]: r["n"] for r in tt.top_members(totals, "method").orderBy("rank").collect()},
        "tool_mentions": {r["member"]: r["n"] for r in tt.top_members(totals, "tool").orderBy("rank").collect()},
        "trend_analysis": trend,
        "landscape_matrix": matrix,
        "hot_topics": [{"topic": r["topic"], "count": r["n"]} for r in tt.hot_topics(totals, as_of).orderBy("rank").collect()],
        "category_insights": {r["category"]: r["insight"] for r in tt.category_insights(totals, as_of).collect()},
        "dl_paper_count": share["dl_papers"],
        "dl_ratio": share["dl_ratio"],
        "total_papers": share["papers"],
        "generated_at": generated,
    }


def analysis_rows(totals: DataFrame, as_of: int) -> DataFrame:
    """(section, name, part, n): the counts of analysis() as rows, for results of any number of names."""
    row = lambda section, name, part, n: (F.lit(section).alias("section"), name.cast("string").alias("name"), part.cast("string").alias("part"), n.cast("long").alias("n"))
    none, c = F.lit(None), F.col
    parts = [
        tt.top_members(totals, "method").select(*row("dl_method_distribution", c("member"), none, c("n"))),
        tt.top_members(totals, "tool").select(*row("tool_mentions", c("member"), none, c("n"))),
        tt.trend_methods(totals).select(*row("trend_analysis", c("year"), c("method"), F.coalesce(c("n"), F.lit(0)))),
        tt.trend_years(totals).select(*row("trend_totals", c("year"), none, c("total"))),
        tt.landscape(totals).select(*row("landscape_matrix", c("method"), c("category"), c("n"))),
        tt.hot_topics(totals, as_of).select(*row("hot_topics", c("topic"), none, c("n"))),
        tt.category_insights(totals, as_of).select(*row("category_insights", c("category"), c("insight"), none)),
        tt.learning_share(totals).select(*row("total_papers", F.lit(""), c("dl_ratio"), c("papers"))),
        tt.learning_share(totals).select(*row("dl_paper_count", F.lit(""), none, c("dl_papers"))),
    ]
    return reduce(DataFrame.unionByName, parts)
