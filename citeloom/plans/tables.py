"""The library's answers as table functions of SQL.

`register` gives a session a view of papers and functions on it, which any SQL can join, filter
and aggregate:

    SELECT * FROM search_papers('gan gat der', 20);
    SELECT * FROM paper_counts() WHERE kind = 'year';
    SELECT * FROM paper_trends(5);

Their bodies are queries, so Spark plans them with the query around them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import papers as pp
from citeloom.operators import totals
from citeloom.operators.search import searched_text
from citeloom.shared import cut

#: Shares of the papers that are ranked apart before the best of each are ranked together.
SHARES = 1024

_FUNCTIONS = (
    # Papers with the most of a query's words, best first; each share keeps as many as are wanted, so no task ranks all hits.
    # A text is bound and scored once: an alias in a lambda is computed for each word, and one that a filter reads for that again.
    f"""search_papers(query STRING COMMENT 'words', most INT COMMENT 'papers at most')
    RETURNS TABLE(pos BIGINT, score BIGINT, title STRING, year INT, url STRING)
    RETURN SELECT pos, score, title, year, url FROM (
      SELECT *, row_number() OVER (ORDER BY score DESC, pos) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY pmod(xxhash64(pos), {SHARES}) ORDER BY score DESC, pos) AS own FROM (
          SELECT pos, title, year, url, score FROM (
            SELECT pos, title, year, url, filter(transform(array(_searched), s -> CAST(size(filter(split(lower(search_papers.query), r'\\s+'), w -> w <> '' AND contains(s, w))) AS BIGINT)), n -> n > 0) AS hits FROM citeloom_papers)
          LATERAL VIEW OUTER explode(hits) AS score WHERE score IS NOT NULL))
      WHERE own <= search_papers.most)
    WHERE place <= search_papers.most""",
    # Counts of papers: by year, source, category, method and tool, the commonest first (years: the newest).
    """paper_counts()
    RETURNS TABLE(kind STRING, name STRING, n BIGINT, place INT)
    RETURN SELECT kind, name, n, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'year' THEN -CAST(name AS INT) WHEN kind = 'source' THEN 0 ELSE -n END, first) AS place FROM (
      SELECT kind, CASE WHEN kind = 'year' THEN CAST(year AS STRING) ELSE a END AS name, sum(n) AS n, min(first) AS first FROM citeloom_totals
      WHERE kind IN ('year', 'source', 'category', 'method', 'tool') AND b IS NULL AND (kind <> 'year' OR year IS NOT NULL) GROUP BY 1, 2)""",
    # The best methods of each year of the trend; a year without methods has one row of nulls.
    """paper_trends(most INT COMMENT 'methods of a year')
    RETURNS TABLE(year INT, total BIGINT, method STRING, n BIGINT, rank INT)
    RETURN SELECT y.year, y.total, m.method, m.n, m.rank FROM (SELECT year, sum(n) AS total FROM citeloom_totals WHERE kind = 'year' AND year >= 2015 GROUP BY year) AS y
      LEFT JOIN (SELECT year, method, n, row_number() OVER (PARTITION BY year ORDER BY n DESC, first) AS rank FROM (
        SELECT year, a AS method, sum(n) AS n, min(first) AS first FROM citeloom_totals WHERE kind = 'method' GROUP BY 1, 2)) AS m ON m.year = y.year AND m.rank <= paper_trends.most""",
)


def register(spark: SparkSession, papers: DataFrame, known: DataFrame | None = None) -> None:
    """Give a session the functions over papers; their totals are counted once, or taken as given."""
    papers.withColumn("_searched", searched_text()).createOrReplaceTempView("citeloom_papers")
    counts = cut(totals.state(pp.annotate(papers))) if known is None else known
    counts.withColumn("year", F.col("year")).createOrReplaceTempView("citeloom_totals")
    for function in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}")
