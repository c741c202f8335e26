"""The table functions against the operators."""

from test_literature import frame, paper

from citeloom.functions import taxonomy as tx
from citeloom.operators import papers as pp
from citeloom.operators import search, totals
from citeloom.plans import tables


def test_functions(spark):
    rows = pp.categorize(frame(spark, *(paper(i, str(i), f"{'gan ' if i % 3 else ''}the tion {'gat' if i % 7 == 0 else 'cnn'} akita", "" if i % 2 else "der", 2015 + i % 4 if i % 5 else None) for i in range(50))), tx.FIXTURE)
    tables.register(spark, rows)
    for query, n in (("gan gat der", 20), ("gan GAN  b", 7), (" ", 5), ("zzz", 3)):
        want = [(r["pos"], r["score"]) for r in search.search(rows, query, n).collect()]
        got = spark.sql("SELECT pos, score FROM search_papers(?, ?) ORDER BY score DESC, pos", [query, n]).collect()
        assert [tuple(r) for r in got] == want
    state = totals.state(pp.annotate(rows))
    count = lambda kind: [tuple(r) for r in spark.sql(f"SELECT name, n, place FROM paper_counts() WHERE kind = '{kind}' ORDER BY place").collect()]
    assert count("category") == [tuple(r) for r in totals.by_category(state).orderBy("rank").collect()]
    assert count("method") == [tuple(r) for r in totals.top_members(state, "method").orderBy("rank").collect()]
    assert count("source") == [("s", 50, 1)] and [int(x) for x, _, _ in count("year")] == [2018, 2017, 2016, 2015]
    want = sorted(map(str, totals.trend_methods(state, 2).collect()))
    assert sorted(map(str, spark.sql("SELECT * FROM paper_trends(2)").collect())) == want
    joined = spark.sql("SELECT t.year, count(*) AS n FROM search_papers('gat', 100) AS s JOIN paper_trends(1) AS t USING (year) GROUP BY t.year").count()
    assert joined > 0
