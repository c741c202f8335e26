"""The registered queries over the paper-shaped documents, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import taxonomy as tx
from citeloom.functions import text as t
from citeloom.operators import analysis as an
from citeloom.operators import papers as pp
from citeloom.operators import keywords, listing, report, search, substrings, totals
from citeloom.plans import pipeline, tables
from citeloom.shared import cut, shared_dir
from citeloom.sources import payloads, store
from citeloom.sources.documents import papers

AS_OF = 2025
FIX = tx.FIXTURE
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _values(taxonomy: tx.Taxonomy) -> str:
    rows = [f"({i}, '{g}', '{k}')" for i, (g, kws) in enumerate(taxonomy.groups.items()) for k in kws]
    return "(VALUES " + ", ".join(rows) + ") AS k(ord, grp, kw)"


def _hits(name: str, taxonomy: tx.Taxonomy) -> str:
    return f"{name} AS (SELECT pos, year, ord, grp, count(*) AS score FROM papers JOIN {_values(taxonomy)} ON contains(txt, kw) GROUP BY ALL)"


_PAPERS = r"""raw AS (SELECT *, '10.1101/' || md5(text) AS doi, strpos(text, chr(10)) AS nl FROM documents),
cut AS (SELECT *, CASE WHEN nl > 0 THEN substr(text, 1, nl - 1) ELSE text END AS title, CASE WHEN nl > 0 THEN substr(text, nl + 1) ELSE '' END AS abstract, CASE WHEN doc_id % 29 <> 0 THEN 2010 + doc_id % 17 END AS y FROM raw),
papers AS (SELECT doc_id AS pos, CASE doc_id % 3 WHEN 0 THEN doi WHEN 1 THEN 'https://doi.org/' || upper(doi) ELSE '  ' || doi || ' ' END AS id, title, abstract, 'J ' || lang AS journal, CAST(y AS INTEGER) AS year,
  CASE WHEN y IS NULL THEN '' ELSE y || '-' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') END AS date, doi, 'https://doi.org/' || doi AS url, source,
  list_filter(string_split(title, ' '), lambda x: x <> '')[1:doc_id % 5] AS authors, lower(title || ' ' || abstract) AS txt FROM cut)"""
_CATS = (
    _hits("fx", FIX)
    + """, cats AS (SELECT pos, grp AS category, i FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, ord) AS i FROM fx) WHERE i <= 3
  UNION ALL SELECT pos, 'Other', 1 FROM papers WHERE pos NOT IN (SELECT pos FROM fx))"""
)
_METHODS = _hits("mx", tx.METHODS) + ", methods AS (SELECT pos, year, grp AS method, row_number() OVER (PARTITION BY pos ORDER BY ord) AS i FROM mx)"


def _add(name: str, query: Query, sql: str | None, *parts: str) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = "WITH " + ", ".join((_PAPERS, *parts)) + "\n" + sql


def _cat(spark: SparkSession, sf: str) -> DataFrame:
    return pp.categorize(papers(spark, sf), FIX)


def _ann(spark: SparkSession, sf: str) -> DataFrame:
    return pp.annotate(papers(spark, sf))


def _both(spark: SparkSession, sf: str) -> DataFrame:
    return pp.annotate(_cat(spark, sf))


def _state(spark: SparkSession, sf: str) -> DataFrame:
    """The totals of all papers, counted once."""
    return cut(totals.state(_both(spark, sf)))


def _advanced(spark: SparkSession, sf: str) -> DataFrame:
    """The totals of the papers as three updates in turn leave them."""
    rows = _both(spark, sf)
    out = totals.empty(spark)
    for low, high in ((0, 2), (2, 7), (7, 10)):
        out = cut(totals.combined(out, totals.state(rows.where(f"pos % 10 >= {low} and pos % 10 < {high}"))))
    return out


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = papers(spark, sf)
    return pp.merge(rows.where("pos % 10 < 6"), rows.where("pos % 10 >= 6"))


def _column(name: str, column: Callable[[], object], sql: str) -> None:
    _add(name, lambda s, d: papers(s, d).select("pos", column().alias("out")), f"SELECT pos, {sql} AS out FROM papers")


_column("norm_id", lambda: t.fetch_key("id"), "replace(replace(lower(trim(id)), 'https://doi.org/', ''), 'http://doi.org/', '')")
_column("merge_key", lambda: t.merge_key("id"), "lower(trim(id))")
_column("clean_text", lambda: t.clean_text("abstract"), r"trim(regexp_replace(abstract, '\s+', ' ', 'g'))")


def _authors_sql(most: int, none: str, shown: int) -> str:
    return f"CASE WHEN len(authors) = 0 THEN '{none}' WHEN len(authors) <= {most} THEN array_to_string(authors, ', ') ELSE array_to_string(authors[1:{shown}], ', ') || ' et al.' END"


for _name, _form, _args in (("readme", t.authors_readme, (2, "Unknown", 1)), ("digest", t.authors_digest, (1, "Unknown", 1)), ("entry", t.authors_entry, (3, "", 3)), ("search", t.authors_search, (1, "?", 1)), ("email", t.authors_email, (1, "Unknown", 1)), ("template", t.authors_template, (1, "", 1)), ("page", t.authors_page, (2, "Unknown", 1))):
    _column(f"author_short_{_name}", lambda form=_form: form("authors"), _authors_sql(*_args))

_column("title_truncate_escape", lambda: t.title_cell("title"), r"CASE WHEN length(replace(replace(title, '|', '\|'), chr(10), ' ')) > 100 THEN substr(replace(replace(title, '|', '\|'), chr(10), ' '), 1, 97) || '...' ELSE replace(replace(title, '|', '\|'), chr(10), ' ') END")
_column("abstract_truncate", lambda: t.truncated("abstract", 300, 300), "CASE WHEN length(abstract) > 300 THEN substr(abstract, 1, 300) || '...' ELSE abstract END")
_column("link_cell", lambda: t.links("url", "doi"), "'[Paper](' || url || ') / [DOI](https://doi.org/' || doi || ')'")
_column("html_escape", lambda: t.html_escaped("title"), "replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')")
_column("title_url_encoded", lambda: F.url_encode(F.substring("journal", 1, 20)), "replace(journal, ' ', '+')")
_column("year_from_date", lambda: t.year_of("date", AS_OF), f"coalesce(TRY_CAST(substr(date, 1, 4) AS INTEGER), {AS_OF})")

_join = lambda c: F.array_join(c, ";")
_add("categorize_fixture", lambda s, d: _cat(s, d).select("pos", _join("categories").alias("categories")), "SELECT pos, string_agg(category, ';' ORDER BY i) AS categories FROM cats GROUP BY pos", _CATS)
_add("categorize_methods_top3", lambda s, d: pp.categorize(papers(s, d), tx.METHODS).select("pos", _join("categories").alias("categories")), "SELECT papers.pos, coalesce(c, 'Other') AS categories FROM papers LEFT JOIN (SELECT pos, string_agg(grp, ';' ORDER BY i) AS c FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, ord) AS i FROM mx) WHERE i <= 3 GROUP BY pos) USING (pos)", _METHODS)
for _name, _tax in (("methods_real", tx.METHODS), ("methods_fixture", FIX), ("tools_real", tx.TOOLS)):
    _add(_name, lambda s, d, tax=_tax: papers(s, d).select("pos", _join(tx.groups_hit(pp.paper_text(), tax)).alias("groups")), "SELECT papers.pos, coalesce(g, '') AS groups FROM papers LEFT JOIN (SELECT pos, string_agg(grp, ';' ORDER BY ord) AS g FROM h GROUP BY pos) USING (pos)", _hits("h", _tax))
_terms = lambda words: " + ".join(f"CAST(contains(txt, '{w}') AS INTEGER)" for w in words)
_add("relevance_score", lambda s, d: papers(s, d).select("pos", F.round(tx.relevance(pp.paper_text(), tx.METHODS), 6).alias("score")), f"SELECT papers.pos, round(least(1.0::DOUBLE, (15 * coalesce(m, 0) + 5 * ({_terms(tx.LEARNING_TERMS)}) + CASE WHEN {_terms(tx.DOMAIN_TERMS)} >= 2 THEN 10 ELSE 0 END) / 100.0::DOUBLE), 6) AS score FROM papers LEFT JOIN (SELECT pos, count(*) AS m FROM mx GROUP BY pos) USING (pos)", _METHODS)

_FIRST = "SELECT pos, k AS key FROM (SELECT pos, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM papers) WHERE rn = 1 AND k <> ''"
_KEY = "lower(trim(id))"
_add("dedup_first_wins", lambda s, d: pp.first_by_key(papers(s, d), t.merge_key("id")).select("pos", F.col("_key").alias("key")), _FIRST.format(key=_KEY, order="pos"))
_MERGED = "(" + _FIRST.format(key=_KEY, order="pos % 10 >= 6, pos") + ")"
_PLACE = "CASE WHEN pos % 10 < 6 THEN pos ELSE pos + 1 + (SELECT max(pos) FROM papers WHERE pos % 10 < 6) END"  # new ones after all existing ones
_add("merge_all", lambda s, d: _split(s, d)[0].select("pos", t.merge_key("id").alias("key")), f"SELECT {_PLACE} AS pos, key FROM {_MERGED}")
_add("merge_new", lambda s, d: _split(s, d)[1].select("pos", t.merge_key("id").alias("key")), f"SELECT {_PLACE} AS pos, key FROM {_MERGED} WHERE pos % 10 >= 6")


def _stored(s: SparkSession, d: str) -> str:
    """A store in the shared folder: first three fifths of the papers, then the rest as an update."""
    rows, path = papers(s, d), f"{shared_dir(s).rstrip('/')}/store-{uuid.uuid4().hex}"
    store.add_papers(s, path, rows.where("pos % 10 < 6"))
    store.add_papers(s, path, rows.where("pos % 10 >= 6"))
    return path


_OLD = "(SELECT max(pos) FROM (SELECT pos, key FROM (" + _FIRST.format(key=_KEY, order="pos % 10 >= 6, pos") + ") WHERE pos % 10 < 6))"
_STORED = f"SELECT CASE WHEN pos % 10 < 6 THEN pos ELSE pos + 1 + {_OLD} END AS pos, key FROM {_MERGED}"
_add("store_all", lambda s, d: store.read_snapshot(s, _stored(s, d)).select("pos", t.merge_key("id").alias("key")), _STORED)
_add("store_added", lambda s, d: store.read_added(s, _stored(s, d)).select("pos", t.merge_key("id").alias("key")), _STORED + " WHERE pos % 10 >= 6")


def _union(s: SparkSession, d: str) -> DataFrame:
    rows = papers(s, d)
    return pp.fetch_union([rows.where("pos % 2 = 1"), rows.where("pos % 2 = 0")]).select("id", "title")


_FETCH = "replace(replace(lower(trim(id)), 'https://doi.org/', ''), 'http://doi.org/', '')"
_add("fetch_union_dedup", _union, f"SELECT k AS id, title FROM (SELECT title, {_FETCH} AS k, row_number() OVER (PARTITION BY {_FETCH} ORDER BY pos % 2 = 0, pos) AS rn FROM papers) WHERE rn = 1 AND k <> ''")

_add("stats_total", lambda s, d: pp.total(papers(s, d)), "SELECT count(*) AS total FROM papers")
_add("stats_by_year", lambda s, d: pp.by_year(papers(s, d)), "SELECT year, count(*) AS n FROM papers WHERE year IS NOT NULL GROUP BY year")
_add("year_bars", lambda s, d: pp.by_year(papers(s, d)).select("year", t.bar("n", 50).alias("bar")), "SELECT year, repeat('█', least(count(*), 50)) AS bar FROM papers WHERE year IS NOT NULL GROUP BY year")
_add("stats_by_source", lambda s, d: pp.by_source(papers(s, d)), "SELECT source, n, row_number() OVER (ORDER BY f) AS rank FROM (SELECT source, count(*) AS n, min(pos) AS f FROM papers GROUP BY source)")
_add("stats_by_category", lambda s, d: pp.by_category(_cat(s, d)), "SELECT category, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM (SELECT category, count(*) AS n, min((pos, i)) AS f FROM cats GROUP BY category)", _CATS)
_add("tag_cloud", lambda s, d: pp.tag_cloud(_cat(s, d)), "SELECT category, n, CAST(floor(100.0::DOUBLE * n / max(n) OVER () + 0.5) AS BIGINT) AS percent, least(greatest(10 + 2 * n, 12), 24) AS size, repeat('█', least(n, 30)) AS bar FROM (SELECT category, count(*) AS n FROM cats GROUP BY category)", _CATS)
_add("group_ranked", lambda s, d: pp.group_places(_cat(s, d), FIX).select("category", "rn", "pos"), "SELECT category, row_number() OVER (PARTITION BY category ORDER BY date DESC, pos) AS rn, pos FROM cats JOIN papers USING (pos)", _CATS)
_add("toc_anchor", lambda s, d: pp.by_category(pp.categorize(papers(s, d), tx.METHODS)).select("category", t.anchor("category").alias("anchor")), "SELECT category, regexp_replace(replace(replace(replace(replace(lower(category), ' ', '-'), '&', ''), '/', ''), '--', '-'), '^$', '') AS anchor FROM (SELECT DISTINCT grp AS category FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, ord) AS i FROM mx) WHERE i <= 3 UNION SELECT 'Other' WHERE (SELECT count(*) FROM papers) > (SELECT count(DISTINCT pos) FROM mx))", _METHODS)
_add("method_top20", lambda s, d: an.top_members(_ann(s, d), "methods"), "SELECT * FROM (SELECT method AS member, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM (SELECT method, count(*) AS n, min((pos, i)) AS f FROM methods GROUP BY method)) WHERE rank <= 20", _METHODS)
_add("tool_top20", lambda s, d: an.top_members(_ann(s, d), "tools"), "SELECT grp AS member, count(*) AS n, row_number() OVER () AS rank FROM h GROUP BY grp", _hits("h", tx.TOOLS))
_TOLD = ["akita", "orca model", "c.origami and dip-c", "hic-plus", ""]
_TOLD_HITS = f"h AS (SELECT pos, ord, grp FROM (SELECT pos, txt || ' ' || {_TOLD}[pos % 5 + 1] AS txt FROM papers) JOIN {_values(tx.TOOLS)} ON contains(txt, kw) GROUP BY ALL)"


def _told(s: SparkSession, d: str) -> DataFrame:
    """Annotated papers whose titles also name tools, which the prose never does."""
    named = F.element_at(F.array(*map(F.lit, _TOLD)), (F.col("pos") % 5 + 1).cast("int"))
    return pp.annotate(papers(s, d).withColumn("title", F.concat("title", F.lit(" "), named)))


_add("tools_named", lambda s, d: _told(s, d).select("pos", _join("tools").alias("tools")), "SELECT papers.pos, coalesce(g, '') AS tools FROM papers LEFT JOIN (SELECT pos, string_agg(grp, ';' ORDER BY ord) AS g FROM h GROUP BY pos) USING (pos)", _TOLD_HITS)
_add("tool_top20_named", lambda s, d: an.top_members(_told(s, d), "tools"), "SELECT grp AS member, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM (SELECT grp, count(*) AS n, min((pos, ord)) AS f FROM h GROUP BY grp)", _TOLD_HITS)
_add("dl_ratio", lambda s, d: an.learning_share(_ann(s, d)), "SELECT count(*) AS papers, count(m.pos) AS dl_papers, round_even(count(m.pos) / count(*) * 100, 1) AS dl_ratio FROM papers LEFT JOIN (SELECT DISTINCT pos FROM mx) m USING (pos)", _METHODS)
_add("trend_by_year", lambda s, d: an.trend_years(papers(s, d)), "SELECT year, count(*) AS total FROM papers WHERE year >= 2015 GROUP BY year")
_add("trend_top5", lambda s, d: an.trend_methods(_ann(s, d)), "SELECT y.year, y.total, r.method, r.n, r.rank FROM (SELECT year, count(*) AS total FROM papers WHERE year >= 2015 GROUP BY year) y LEFT JOIN (SELECT * FROM (SELECT year, method, n, row_number() OVER (PARTITION BY year ORDER BY n DESC, f) AS rank FROM (SELECT year, method, count(*) AS n, min((pos, i)) AS f FROM methods GROUP BY ALL)) WHERE rank <= 5) r USING (year)", _METHODS)
_add("yoy_growth", lambda s, d: an.growth(papers(s, d), AS_OF).drop("before_year"), f"SELECT year, total, before, CASE WHEN total > before THEN CAST(round_even((total - before) / greatest(before, 1) * 100, 0) AS BIGINT) END AS percent FROM (SELECT *, lag(total) OVER (ORDER BY year) AS before, lead(year) OVER (ORDER BY year) AS nxt FROM (SELECT year, count(*) AS total FROM papers WHERE year >= {AS_OF - 3} GROUP BY year)) WHERE nxt IS NULL")
_add("landscape", lambda s, d: an.landscape(_both(s, d)), "SELECT method, category, count(*) AS n FROM methods JOIN cats USING (pos) GROUP BY ALL", _METHODS, _CATS)
_pivot = ", ".join(f"coalesce(count(*) FILTER (WHERE category = '{g}'), 0) AS {g}" for g in FIX.groups)
_add("landscape_matrix", lambda s, d: an.landscape_matrix(_both(s, d), list(FIX.groups)), f"SELECT method, {_pivot} FROM methods JOIN cats USING (pos) GROUP BY method", _METHODS, _CATS)
_HOT = "SELECT * FROM (SELECT topic, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM (SELECT method || ' for ' || category AS topic, count(*) AS n, min((pos, methods.i, cats.i)) AS f FROM methods JOIN cats USING (pos) WHERE pos IN (SELECT pos FROM papers WHERE {}) GROUP BY ALL)) WHERE rank <= 10"
_add("hot_topics_recent", lambda s, d: an.hot_topics(_both(s, d), AS_OF), _HOT.format(f"year >= {AS_OF - 1}"), _METHODS, _CATS)
_add("hot_topics_fallback", lambda s, d: an.hot_topics(_both(s, d), 2100), _HOT.format("pos IN (SELECT pos FROM papers ORDER BY pos LIMIT 50)"), _METHODS, _CATS)
_TREND = f"CASE WHEN r > n * 0.5 THEN 'rapidly growing' WHEN r > n * 0.25 THEN 'actively researched' WHEN r > 0 THEN 'moderately active' ELSE 'established' END"
_INSIGHT = f"SELECT category, n || ' papers' || CASE WHEN hi IS NULL THEN '' ELSE ' (' || lo || '-' || hi || '), ' || {_TREND} || ', ' || r || ' recent' END AS insight FROM (SELECT category, count(*) AS n, min(year) AS lo, max(year) AS hi, count(*) FILTER (WHERE year >= {AS_OF - 1}) AS r FROM cats JOIN papers USING (pos) GROUP BY category)"
_add("category_insights", lambda s, d: an.category_insights(_cat(s, d), AS_OF), _INSIGHT, _CATS)
_add("insight_colours", lambda s, d: an.category_insights(_cat(s, d), AS_OF).select("category", t.insight_colour("insight").alias("colour")), f"SELECT category, CASE WHEN contains(insight, 'rapidly') THEN '#34d399' WHEN contains(insight, 'actively') THEN '#fbbf24' ELSE '#94a3b8' END AS colour FROM ({_INSIGHT})", _CATS)


def _search_sql(query: str, limit: int) -> str:
    score = " + ".join(f"CAST(contains(t, '{w}') AS BIGINT)" for w in query.split())
    return f"SELECT pos, score FROM (SELECT pos, {score} AS score FROM (SELECT pos, txt || ' ' || c AS t FROM papers JOIN (SELECT pos, string_agg(category, ' ' ORDER BY i) AS c FROM cats GROUP BY pos) USING (pos))) WHERE score > 0 ORDER BY score DESC, pos LIMIT {limit}"


for _name, _query, _limit in (("search_cli20", "gan gat der", 20), ("search_web50", "llm bert vit fx_de", 50), ("search_dup_terms", "gan gan lad", 20)):
    _add(_name, lambda s, d, q=_query, n=_limit: search.search(_cat(s, d), q, n).select("pos", F.col("score").cast("long").alias("score")), _search_sql(_query, _limit), _CATS)


def _indexed(spark: SparkSession, sf: str, query: str, limit: int) -> DataFrame:
    """A search by an index of all papers, made for it in the shared folder."""
    rows = _cat(spark, sf)
    index = substrings.Index(spark, [substrings.build(rows, f"{shared_dir(spark).rstrip('/')}/substrings-{uuid.uuid4().hex}")])
    return substrings.search(rows, index, query, limit).select("pos", F.col("score").cast("long").alias("score"))


for _name, _query, _limit in (("search_indexed_cli20", "gan gat der", 20), ("search_indexed_rare", "llm bert zq", 50)):
    _add(_name, lambda s, d, q=_query, n=_limit: _indexed(s, d, q, n), _search_sql(_query, _limit), _CATS)
_add("provider_filter", lambda s, d: search.provider_filter(papers(s, d), "gan tion ment ia").select("pos"), "SELECT pos FROM papers WHERE CAST(contains(txt, 'gan') AS INT) + CAST(contains(txt, 'tion') AS INT) + CAST(contains(txt, 'ment') AS INT) >= 2")
_add("provider_filter_zero_terms", lambda s, d: search.provider_filter(papers(s, d), "3D").select("pos"), "SELECT pos FROM papers")
_BROWSE = "SELECT pos, row_number() OVER (ORDER BY date DESC, pos) AS rn, 10 * least(1, greatest(0, (count(*) OVER () - 1) // 10)) AS skip FROM papers WHERE source = 'src3' AND NOT coalesce(year < 2012 OR year > 2024, false) AND pos IN (SELECT pos FROM cats WHERE category = 'fx_suffix_en')"
_add("browse_filter_page", lambda s, d: search.page(search.browse(_cat(s, d), "src3", 2012, 2024, "fx_suffix_en"), 2, 10).select("pos"), f"SELECT pos FROM ({_BROWSE}) WHERE rn > skip AND rn <= skip + 10", _CATS)
_add("browse_date_asc", lambda s, d: search.page(search.browse(papers(s, d), order="date_asc"), 3).select("pos"), "SELECT pos FROM papers ORDER BY date, pos LIMIT 25 OFFSET 50")
_add("browse_title_collated", lambda s, d: search.page(search.browse(papers(s, d), order="title"), 1).select("pos", "title"), "SELECT pos, title FROM papers ORDER BY title COLLATE icu_noaccent, pos LIMIT 25")


def _listed(s: SparkSession, d: str, order: str, number: int, size: int = search.PAGE, **kept: object) -> DataFrame:
    """A page by a listing of all papers, made for it in the shared folder."""
    rows = _cat(s, d)
    return listing.page(rows, listing.build(rows, f"{shared_dir(s).rstrip('/')}/listing-{uuid.uuid4().hex}", order), number, size, **kept)


for _name, _order, _number, _size, _kept in (
    ("browse_filter_page", "date_desc", 2, 10, {"source": "src3", "first": 2012, "last": 2024, "category": "fx_suffix_en"}),
    ("browse_date_asc", "date_asc", 3, 25, {}),
    ("browse_title_collated", "title", 1, 25, {}),
):
    QUERIES[f"listed_{_name}"] = lambda s, d, o=_order, n=_number, z=_size, k=_kept, c=("pos", "title") if _order == "title" else ("pos",): _listed(s, d, o, n, z, **k).select(*c)
    SQL[f"listed_{_name}"] = SQL[_name]
_add("facets", lambda s, d: pp.facets(_cat(s, d)), "SELECT DISTINCT 'year' AS facet, CAST(year AS VARCHAR) AS value FROM papers WHERE year IS NOT NULL UNION ALL SELECT DISTINCT 'source', source FROM papers UNION ALL SELECT DISTINCT 'category', category FROM cats", _CATS)
_add("kpis", lambda s, d: pp.kpis(_cat(s, d)), "SELECT count(*) AS total, count(DISTINCT source) AS sources, min(year) AS first_year, max(year) AS last_year, (SELECT count(DISTINCT category) FROM cats) AS categories FROM papers", _CATS)
_new = lambda s, d: pp.categorize(_split(s, d)[1], FIX)
_NEWPOS = "new AS (SELECT pos FROM (" + _FIRST.format(key=_KEY, order="pos % 10 >= 6, pos") + ") WHERE pos % 10 >= 6)"
_add("digest_counts", lambda s, d: report.digest_counts(_new(s, d), FIX), "SELECT category, count(*) AS n FROM cats JOIN new USING (pos) GROUP BY category", _CATS, _NEWPOS)
_add("digest_top5", lambda s, d: report.digest_top(_new(s, d)).drop("date"), f"SELECT {_PLACE} AS pos, '  * [' || coalesce(CAST(year AS VARCHAR), 'None') || '] ' || title AS head, '    ' || {_authors_sql(1, 'Unknown', 1)} || ' | ' || journal AS tail FROM papers JOIN new USING (pos) ORDER BY date DESC, papers.pos LIMIT 5", _NEWPOS)
_add("text_entries", lambda s, d: report.entries(papers(s, d)), f"SELECT pos, pos || '. **' || title || '**' || chr(10) || '   ' || {_authors_sql(3, '', 3)} || chr(10) || '   *' || journal || '* (' || coalesce(CAST(year AS VARCHAR), 'None') || ')' || chr(10) || '   DOI: ' || doi || CASE WHEN abstract = '' THEN '' ELSE chr(10) || '   > ' || CASE WHEN length(abstract) > 200 THEN substr(abstract, 1, 197) || '...' ELSE abstract END END AS entry FROM papers")
_CELL = lambda c: f"replace(replace({c}, '|', '\\|'), chr(10), ' ')"
_ORDS = "ords AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', {i}, '{FIX.descriptions.get(g, '')}')" for i, g in enumerate(FIX.groups)) + ") AS o(category, grp_ord, description))"
_LINE = f"'| ' || rn || ' | ' || CASE WHEN length({_CELL('title')}) > 100 THEN substr({_CELL('title')}, 1, 97) || '...' ELSE {_CELL('title')} END || ' | ' || {_authors_sql(2, 'Unknown', 1)} || ' | ' || {_CELL('journal')} || ' | ' || coalesce(CAST(year AS VARCHAR), '') || ' | [Paper](' || url || ') / [DOI](https://doi.org/' || doi || ') |'"
_add("report_rows", lambda s, d: report.category_rows(_cat(s, d), FIX), f"SELECT category, coalesce(grp_ord, 2147483647) AS grp_ord, description, rn, {_LINE} AS line FROM (SELECT papers.*, category, row_number() OVER (PARTITION BY category ORDER BY date DESC, pos) AS rn FROM cats JOIN papers USING (pos)) LEFT JOIN ords USING (category)", _CATS, _ORDS)
_ANCHOR = "regexp_replace(replace(replace(replace(replace(lower(category), ' ', '-'), '&', ''), '/', ''), '--', '-'), '^$', '')"
_SEVERAL = "SELECT {part} AS part, {ord} AS grp_ord, {cat} AS category, CAST({rn} + i - 1 AS BIGINT) AS rn, lines[i] AS line FROM (SELECT *, [{lines}] AS lines, unnest(range(1, {n} + 1)) AS i FROM {rows})"


def _said(part: int, rows: str, rn: str, *lines: str) -> str:
    whole = "grp_ord" not in rows
    return _SEVERAL.format(part=part, ord="CAST(NULL AS INTEGER)" if whole else "grp_ord", cat="CAST(NULL AS VARCHAR)" if whole else "category", rn=rn, lines=", ".join(lines), n=len(lines), rows=rows)


_quoted = lambda *texts: [f"'{x}'" for x in texts]
_REPORT = " UNION ALL ".join(
    [
        _said(0, "(SELECT (SELECT count(*) FROM papers) AS p, count(*) AS g FROM gg)", "0", "'# Literature'", "''", "'Last updated 2025-06-15. ' || p || ' papers in ' || g || ' categories.'", "''", "'## Table of Contents'", "''"),
        _said(1, "(SELECT category, grp_ord, n FROM gg)", "0", f"'- [' || category || '](#' || {_ANCHOR} || ') (' || n || ' papers)'"),
        _said(2, "(SELECT 1)", "0", *_quoted("", "## Statistics", "", "### Papers by Year", "| Year | Count |", "|------|-------|")),
        _said(3, "(SELECT year, count(*) AS n FROM papers WHERE year IS NOT NULL GROUP BY year)", "-year", "'| ' || year || ' | ' || n || ' ' || repeat('█', least(n, 50)) || ' |'"),
        _said(4, "(SELECT 1)", "0", *_quoted("", "### Papers by Source", "| Source | Count |", "|--------|-------|")),
        _said(5, "(SELECT source, n, row_number() OVER (ORDER BY f) AS k FROM (SELECT source, count(*) AS n, min(pos) AS f FROM papers GROUP BY source))", "k", "'| ' || source || ' | ' || n || ' |'"),
        _said(6, "(SELECT category, grp_ord, description, n FROM gg)", "-6", "''", "'## ' || category", "''", "CASE WHEN description <> '' THEN '> ' || description || chr(10) || chr(10) ELSE '' END || '<details><summary>Show ' || n || ' papers</summary>'", *_quoted("", "| # | Title | Authors | Journal | Year | Links |", "|---|-------|---------|---------|------|-------|")),
        "SELECT 6, grp_ord, category, rn, line FROM body",
        _said(6, "(SELECT category, grp_ord, n FROM gg)", str(1 << 62), "''", "'</details>'"),
    ]
)
_BODY = f"body AS (SELECT category, coalesce(grp_ord, 2147483647) AS grp_ord, description, rn, {_LINE} AS line FROM (SELECT papers.*, category, row_number() OVER (PARTITION BY category ORDER BY date DESC, pos) AS rn FROM cats JOIN papers USING (pos)) LEFT JOIN ords USING (category)), gg AS (SELECT category, grp_ord, description, count(*) AS n FROM body GROUP BY ALL)"
_add("report_lines", lambda s, d: report.readme_lines(_cat(s, d), FIX, "2025-06-15"), _REPORT, _CATS, _ORDS, _BODY)
_YEARS = "ty AS (SELECT year, count(*) AS total FROM papers WHERE year >= 2015 GROUP BY year), tm AS (SELECT * FROM (SELECT year, method, n, row_number() OVER (PARTITION BY year ORDER BY n DESC, f) AS rank FROM (SELECT year, method, count(*) AS n, min((pos, i)) AS f FROM methods GROUP BY ALL)) WHERE rank <= 5)"
_add("trend_newest5", lambda s, d: an.newest_trend(_ann(s, d)).select("year", "total", "method", "n", "rank"), "SELECT year, total, method, n, rank FROM (SELECT * FROM ty ORDER BY year DESC LIMIT 5) LEFT JOIN tm USING (year)", _METHODS, _YEARS)
_TOP = "(SELECT member, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM (SELECT method AS member, count(*) AS n, min((pos, i)) AS f FROM methods GROUP BY method))"
_SUMMARY = f"""SELECT 1 AS part, 0 AS rank, 'Total papers tracked: ' || (SELECT count(*) FROM papers) AS line
UNION ALL SELECT 1, 1, 'Deep learning-related: ' || count(DISTINCT pos) || ' (' || round_even(count(DISTINCT pos) / (SELECT count(*) FROM papers) * 100, 1) || '%)' FROM methods
UNION ALL SELECT 2, CAST(100 * rank AS INTEGER), '  ' || rpad(member, 25, ' ') || ' ' || repeat(' ', greatest(0, 4 - length(CAST(n AS VARCHAR)))) || n || ' ' || repeat('█', least(n, 30)) FROM {_TOP} WHERE rank <= 8
UNION ALL SELECT 4, CAST(100 * ({AS_OF} - year + 100) AS INTEGER), '  ' || year || ': ' || any_value(total) || ' papers | Top methods: ' || coalesce(string_agg(method || '(' || n || ')', ', ' ORDER BY rank), '') FROM ty LEFT JOIN tm USING (year) WHERE year >= {AS_OF - 3} GROUP BY year
UNION ALL SELECT 5, CAST(100 * rank AS INTEGER), '  • ' || topic || ' (' || n || ' papers)' FROM ({_HOT.format(f"year >= {AS_OF - 1}")}) WHERE rank <= 6
UNION ALL SELECT 6, 100, '  • ' || member || ' is the most widely used architecture' FROM {_TOP} WHERE rank = 1
UNION ALL SELECT 6, 300, CASE WHEN total > before THEN '  • ' || CAST(round_even((total - before) / greatest(before, 1) * 100, 0) AS BIGINT) || '% growth from ' ELSE '  • Publication pace slowing from ' END || was || ' to ' || year
  FROM (SELECT *, lag(total) OVER (ORDER BY year) AS before, lag(year) OVER (ORDER BY year) AS was, lead(year) OVER (ORDER BY year) AS nxt FROM ty WHERE year >= {AS_OF - 3}) WHERE nxt IS NULL AND total <> before"""
_add("summary_lines", lambda s, d: report.summary_lines(_state(s, d), AS_OF), _SUMMARY, _METHODS, _CATS, _YEARS)
_ROWS = " UNION ALL ".join(
    f"SELECT '{section}' AS section, CAST({name} AS VARCHAR) AS name, CAST({part} AS VARCHAR) AS part, CAST({n} AS BIGINT) AS n FROM ({sql})"
    for section, name, part, n, sql in (
        ("dl_method_distribution", "member", "NULL", "n", f"SELECT * FROM {_TOP} WHERE rank <= 20"),
        ("trend_analysis", "year", "method", "coalesce(n, 0)", "SELECT * FROM ty LEFT JOIN tm USING (year)"),
        ("trend_totals", "year", "NULL", "total", "SELECT * FROM ty"),
        ("landscape_matrix", "method", "category", "n", "SELECT method, category, count(*) AS n FROM methods JOIN cats USING (pos) GROUP BY ALL"),
        ("hot_topics", "topic", "NULL", "n", _HOT.format(f"year >= {AS_OF - 1}")),
        ("category_insights", "category", "insight", "NULL", _INSIGHT),
        ("total_papers", "''", "dl_ratio", "papers", "SELECT count(*) AS papers, round_even(count(m.pos) / count(*) * 100, 1) AS dl_ratio FROM papers LEFT JOIN (SELECT DISTINCT pos FROM mx) m USING (pos)"),
        ("dl_paper_count", "''", "NULL", "n", "SELECT count(DISTINCT pos) AS n FROM mx"),
    )
)
_add("analysis_rows", lambda s, d: report.analysis_rows(_state(s, d), AS_OF), _ROWS, _METHODS, _CATS, _YEARS)


def _job(s: SparkSession, d: str) -> DataFrame:
    """What two updates of a new store say: the first three fifths of the papers, then all of them."""
    rows, path = papers(s, d), f"{shared_dir(s).rstrip('/')}/job-{uuid.uuid4().hex}"
    sent: list[int] = []
    told = [pipeline.run(s, path, new, FIX, notify=lambda n, text, html: not sent.append(n)) for new in (rows.where("pos % 10 < 6"), rows)]
    kinds = "run int, existing_count long, fetched_count long, new_count long, total_count long, email_sent boolean, success boolean"
    return s.createDataFrame([(i, *(x[k] for k in ("existing_count", "fetched_count", "new_count", "total_count", "email_sent", "success"))) for i, x in enumerate(told)], kinds)


_SOME = "(SELECT count(DISTINCT lower(trim(id))) FROM papers WHERE pos % 10 < 6)"
_EVERY = "(SELECT count(DISTINCT lower(trim(id))) FROM papers)"
_add("update_job", _job, f"SELECT 0 AS run, 0 AS existing_count, (SELECT count(*) FROM papers WHERE pos % 10 < 6) AS fetched_count, {_SOME} AS new_count, {_SOME} AS total_count, true AS email_sent, true AS success UNION ALL SELECT 1, {_SOME}, (SELECT count(*) FROM papers), {_EVERY} - {_SOME}, {_EVERY}, true, true")
for _name, _query in (
    ("stats_by_source", totals.by_source),
    ("stats_by_category", totals.by_category),
    ("stats_by_year", totals.by_year),
    ("dl_ratio", totals.learning_share),
    ("method_top20", lambda x: totals.top_members(x, "method")),
    ("trend_top5", totals.trend_methods),
    ("landscape", totals.landscape),
    ("hot_topics_recent", lambda x: totals.hot_topics(x, AS_OF)),
    ("hot_topics_fallback", lambda x: totals.hot_topics(x, 2100)),
    ("yoy_growth", lambda x: totals.growth(x, AS_OF).drop("before_year")),
    ("category_insights", lambda x: totals.category_insights(x, AS_OF)),
):
    QUERIES[f"totals_{_name}"] = lambda s, d, q=_query: q(_advanced(s, d))
    SQL[f"totals_{_name}"] = SQL[_name]


def _table_function(text: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        tables.register(s, _cat(s, d))
        return s.sql(text)

    return run


for _name, _text in (("search_cli20", "SELECT pos, score FROM search_papers('gan gat der', 20)"), ("trend_top5", "SELECT * FROM paper_trends(5)"), ("stats_by_category", "SELECT name AS category, n, place AS rank FROM paper_counts() WHERE kind = 'category'")):
    QUERIES[f"sql_{_name}"] = _table_function(_text)
    SQL[f"sql_{_name}"] = SQL[_name]


def _json_kept(s: SparkSession, d: str) -> DataFrame:
    """The papers written as a JSON array and read back: places run anew."""
    path = f"{shared_dir(s).rstrip('/')}/papers-{uuid.uuid4().hex}.json"
    store.write_json(papers(s, d), path)
    return store.read_json(s, path).select("pos", "id", "title", "abstract", "year", "date", _join("authors").alias("authors"), "fetched_at")


_add("json_kept", _json_kept, "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, title, abstract, year, date, array_to_string(authors, ';') AS authors, CAST(NULL AS VARCHAR) AS fetched_at FROM papers")
_flat = "array_to_string(authors, '; ') AS authors, journal, year, date, doi, url, source, c AS categories"
_CSV = "FROM papers JOIN (SELECT pos, string_agg(category, '; ' ORDER BY i) AS c FROM cats GROUP BY pos) USING (pos)"
_add("export_csv_rows", lambda s, d: store.export_rows(_cat(s, d)), f"SELECT id, title, {_flat} {_CSV}", _CATS)
_add("export_web_rows", lambda s, d: store.export_rows(_cat(s, d), store.WEB_COLUMNS), f"SELECT title, {_flat}, abstract {_CSV}", _CATS)


def _theta(s: SparkSession, d: str) -> DataFrame:
    kw = F.broadcast(FIX.frame(s).select("grp", "kw"))  # one row per keyword
    rows = papers(s, d).select("pos", pp.paper_text().alias("txt"))
    return rows.join(kw, F.contains("txt", "kw")).groupBy("pos", "grp").agg(F.count("*").alias("score"))


_add("theta_taxonomy_join", _theta, "SELECT pos, grp, score FROM fx", _hits("fx", FIX))
_texts = lambda s, d: papers(s, d).select("pos", pp.paper_text().alias("text"))
_add("keyword_join", lambda s, d: keywords.group_hits(_texts(s, d), FIX).drop("grp_ord"), "SELECT pos, grp, score FROM fx", _hits("fx", FIX))
_add("keyword_join_methods", lambda s, d: keywords.all_groups(_texts(s, d), tx.METHODS).select("pos", _join("groups").alias("groups")), "SELECT pos, string_agg(grp, ';' ORDER BY ord) AS groups FROM mx GROUP BY pos", _METHODS)


def _mentions(s: SparkSession, d: str) -> DataFrame:
    """How many different author names of the collection stand in each paper's text: a taxonomy that grows with the papers."""
    rows = papers(s, d)
    names = pp.members(rows.select("pos", "authors"), "authors").select(F.lower("member").alias("kw")).where("length(kw) > 3").distinct()
    return keywords.holding(_texts(s, d), names).groupBy("pos").agg(F.count("*").alias("names"))


_add("author_mentions", _mentions, "SELECT pos, count(*) AS names FROM papers JOIN (SELECT DISTINCT lower(a) AS kw FROM (SELECT unnest(authors) AS a FROM papers) WHERE length(a) > 3) ON contains(txt, kw) GROUP BY pos")

_NOW = "2025-06-15 12:00:00"
_QUERY = "ing the ti 3d"  # bioRxiv's records must hold two of its words of three letters and more
_FIELDS = ["pos", "id", "title", "authors", "abstract", "journal", "year", "date", "doi", "url", "source"]


def _element(name: str, *inside: Column | str, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), *(F.lit(x) if isinstance(x, str) else x for x in inside), F.lit(f"</{name}>"))


def _escaped(c: str) -> Column:
    return t.html_escaped(F.col(c))


def _each_author(inside: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform("authors", inside), "")


def _authors_of(*names: str) -> Column:
    """The authors as JSON objects that hold each name as given, the last token of it doubled where two names are asked for."""
    return F.transform("authors", lambda a: F.struct(*(a.alias(n) for n in names)))


def _xml_record(source: str) -> Column:
    """A paper as an XML record of a service; every third has another form of date, and every second no DOI."""
    day = lambda at, n: F.substring("date", at, n)
    some = lambda column, other="": F.when(F.col("date") != "", column).otherwise(other)
    if source == "arxiv":
        link = F.when(F.col("pos") % 2 == 0, F.concat(F.lit('<link href="https://doi.org/'), "doi", F.lit('"/>'))).otherwise("")
        names = _each_author(lambda a: F.concat(F.lit("<author><name>"), t.html_escaped(a), F.lit("</name></author>")))
        return _element("entry", _element("id", "http://arxiv.org/abs/", F.col("pos").cast("string"), "v1"), _element("title", _escaped("title")), _element("summary", _escaped("abstract")), _element("published", some(F.concat("date", F.lit("T00:00:00Z")))), names, link)
    form = F.col("pos") % 3
    months = F.array(*(F.lit(m.capitalize() + "x") for m in payloads.MONTHS))
    month = F.element_at(months, F.greatest(F.lit(1), F.coalesce(day(6, 2).try_cast("int"), F.lit(1))))
    online = F.when(form == 0, some(_element("ArticleDate", _element("Year", day(1, 4)), _element("Month", day(6, 2)), _element("Day", day(9, 2))))).otherwise("")
    printed = _element("Journal", _element("JournalIssue", _element("PubDate", F.when(form == 1, some(F.concat(_element("Year", day(1, 4)), _element("Month", month)))).otherwise(""))), _element("Title", F.col("journal")))
    names = _element("AuthorList", _each_author(lambda a: F.concat(F.lit("<Author><LastName>"), t.html_escaped(a), F.lit("</LastName><ForeName>F</ForeName></Author>"))))
    text = _element("Abstract", _element("AbstractText", _escaped("title"), attributes=' Label="BACKGROUND"'), _element("AbstractText", "<b>", _escaped("abstract"), "</b>"))
    article = _element("Article", printed, _element("ArticleTitle", "<i>", _escaped("title"), "</i>"), text, names, online)
    ids = F.when(F.col("pos") % 2 == 0, _element("ArticleIdList", _element("ArticleId", F.col("doi"), attributes=' IdType="doi"'))).otherwise("")
    return _element("PubmedArticle", _element("MedlineCitation", _element("PMID", F.col("pos").cast("string")), article), _element("PubmedData", ids))


def _json_record(source: str) -> Column:
    """A paper as a JSON object of a service, null where a paper has no value."""
    doi, date = F.when(F.col("pos") % 2 == 0, F.col("doi")), F.nullif("date", F.lit(""))
    if source == "biorxiv":
        bare = F.when(F.col("pos") % 2 == 0, F.col("doi")).otherwise(F.substring("doi", 9, 99))
        return F.struct("title", "abstract", bare.alias("doi"), "date", F.array_join("authors", "; ").alias("authors"))
    if source == "semantic_scholar":
        ids = F.struct(doi.alias("DOI"), F.when(F.col("pos") % 3 == 0, F.col("pos").cast("string")).alias("PubMed"), F.when(F.col("pos") % 5 == 0, F.lit("5")).alias("ArXiv"))
        return F.struct(F.col("pos").cast("string").alias("paperId"), "title", _authors_of("name").alias("authors"), "abstract", "year", F.col("journal").alias("venue"), date.alias("publicationDate"), "url", ids.alias("externalIds"))
    if source == "europepmc":
        return F.struct(F.col("pos").cast("string").alias("id"), "title", doi.alias("doi"), F.when(F.col("pos") % 3 == 0, F.col("pos").cast("string")).alias("pmid"), F.struct(_authors_of("fullName").alias("author")).alias("authorList"), date.alias("firstPublicationDate"), F.col("year").cast("string").alias("pubYear"), F.col("abstract").alias("abstractText"), F.col("journal").alias("journalTitle"))
    parts = F.when(date.isNotNull(), F.array(F.array(F.col("year"), F.substring("date", 6, 2).try_cast("int"))))
    return F.struct(doi.alias("DOI"), F.array("title").alias("title"), _authors_of("given", "family").alias("author"), F.concat(F.lit("<jats:p>"), "abstract", F.lit("</jats:p>")).alias("abstract"), F.array("journal").alias("container-title"), F.struct(parts.alias("date-parts")).alias("published"), F.col("url").alias("URL"))


def service_answers(spark: SparkSession, sf: str, source: str) -> DataFrame:
    """What a service would answer for each paper of the documents: (place, query, value), a record in each."""
    rows = papers(spark, sf)
    if source in payloads.RECORD_TAGS:
        value = _element("answer", _xml_record(source))
    else:
        lists = {"biorxiv": "collection", "semantic_scholar": "data", "europepmc": "resultList.result", "crossref": "message.items"}[source].split(".")
        nested = F.array(_json_record(source))
        for name in reversed(lists):
            nested = F.struct(nested.alias(name))
        value = F.to_json(nested, {"ignoreNullFields": "false"})
    return rows.select(F.col("pos").alias("place"), F.lit(_QUERY).alias("query"), value.alias("value"))


def _parse(source: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = payloads.PARSERS[source](service_answers(spark, sf, source), F.lit(_NOW).cast("timestamp"))
        return found.withColumn("authors", _join("authors")).select(*_FIELDS)

    return run


_clean = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_HALF = "CASE WHEN pos % 2 = 0 THEN doi ELSE '' END"
_FOUND = "'https://doi.org/' || doi"
_ONE = "array_to_string(authors, ';')"
_DATED = "CASE WHEN date = '' THEN coalesce(year, 2025) || '-01-01' ELSE date END"
_PARSED = {
    "pubmed": f"""SELECT pos, CASE WHEN pos % 2 = 0 THEN doi ELSE 'pmid:' || pos END AS id, {_clean('title')} AS title, array_to_string(list_transform(authors, lambda a: a || ' F'), ';') AS authors,
  {_clean("'BACKGROUND: ' || trim(title) || ' ' || abstract")} AS abstract, journal, CASE WHEN date = '' OR pos % 3 = 2 THEN 2025 ELSE year END AS year,
  CASE WHEN date = '' OR pos % 3 = 2 THEN '2025-06-15' WHEN pos % 3 = 0 THEN date ELSE substr(date, 1, 8) || '01' END AS date, {_HALF} AS doi, CASE WHEN pos % 2 = 0 THEN {_FOUND} ELSE 'https://pubmed.ncbi.nlm.nih.gov/' || pos || '/' END AS url, 'pubmed' AS source
  FROM papers WHERE {_clean('title')} <> ''""",
    "arxiv": f"SELECT pos, CASE WHEN pos % 2 = 0 THEN doi ELSE 'arxiv:' || pos || 'v1' END AS id, {_clean('title')} AS title, {_ONE} AS authors, {_clean('abstract')} AS abstract, 'arXiv (preprint)' AS journal, coalesce(year, 2025) AS year, date, {_HALF} AS doi, 'http://arxiv.org/abs/' || pos || 'v1' AS url, 'arxiv' AS source FROM papers",
    "biorxiv": f"SELECT pos, doi AS id, {_clean('title')} AS title, {_ONE} AS authors, {_clean('abstract')} AS abstract, 'bioRxiv (preprint)' AS journal, coalesce(year, 2025) AS year, date, doi, {_FOUND} AS url, 'biorxiv' AS source FROM papers WHERE contains(txt, 'ing') AND contains(txt, 'the')",
    "semantic_scholar": f"SELECT pos, CASE WHEN pos % 2 = 0 THEN doi WHEN pos % 3 = 0 THEN 'pmid:' || pos WHEN pos % 5 = 0 THEN 'arxiv:5' ELSE 's2:' || pos END AS id, {_clean('title')} AS title, {_ONE} AS authors, {_clean('abstract')} AS abstract, journal, coalesce(year, 2025) AS year, {_DATED} AS date, {_HALF} AS doi, CASE WHEN pos % 2 = 0 THEN {_FOUND} ELSE url END AS url, 'semantic_scholar' AS source FROM papers WHERE title <> ''",
    "europepmc": f"SELECT pos, CASE WHEN pos % 2 = 0 THEN doi WHEN pos % 3 = 0 THEN 'pmid:' || pos ELSE 'epmc:' || pos END AS id, {_clean('title')} AS title, {_ONE} AS authors, {_clean('abstract')} AS abstract, journal, coalesce(year, 2025) AS year, {_DATED} AS date, {_HALF} AS doi, CASE WHEN pos % 2 = 0 THEN {_FOUND} ELSE 'https://europepmc.org/article/MED/' || CASE WHEN pos % 3 = 0 THEN CAST(pos AS VARCHAR) ELSE '' END END AS url, 'europepmc' AS source FROM papers WHERE title <> ''",
    "crossref": f"SELECT pos, {_HALF} AS id, {_clean('title')} AS title, array_to_string(list_transform(authors, lambda a: a || ' ' || a), ';') AS authors, {_clean('abstract')} AS abstract, journal, coalesce(year, 2025) AS year, CASE WHEN date = '' THEN '2025-01-01' ELSE substr(date, 1, 8) || '01' END AS date, {_HALF} AS doi, CASE WHEN pos % 2 = 0 THEN {_FOUND} ELSE url END AS url, 'crossref' AS source FROM papers WHERE title <> ''",
}
for _source, _sql in _PARSED.items():
    _add(f"parse_{_source}", _parse(_source), _sql)
