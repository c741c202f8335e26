import email
import email.policy
import json
import re

import pytest
from compare import oracle, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import taxonomy as tx
from citeloom.functions import text as t
from citeloom.operators import analysis as an
from citeloom.operators import papers as pp
from citeloom.operators import report, search, totals
from citeloom.plans import answers, mail, pipeline
from citeloom.plans.queries import QUERIES, SQL
from citeloom.schema import PAPER
from citeloom.sources import store
from citeloom.streaming.merge import merge_stream

SF = "/root/testdata/sf0.001"


def paper(pos, id="", title="", abstract="", year=None, date="", authors=(), categories=(), source="s", **rest):
    row = dict(pos=pos, id=id, title=title, authors=list(authors), abstract=abstract, journal="J", year=year, date=date, doi="", url="", source=source, categories=None if categories is None else list(categories), fetched_at=None) | rest
    return tuple(row[f] for f in PAPER.fieldNames())


def frame(spark, *papers):
    return spark.createDataFrame(list(papers), PAPER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    assert rows(out, columns) == oracle(SQL[name], SF, columns)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_keys_and_text(spark):
    lit = F.lit
    assert value(spark, t.fetch_key(lit(" HTTPS://DOI.ORG/10.1/ABC "))) == "10.1/abc"
    assert value(spark, t.fetch_key(lit("http://dx.doi.org/10.1/x"))) == "http://dx.doi.org/10.1/x"
    assert value(spark, t.merge_key(lit("https://doi.org/10.1/A "))) == "https://doi.org/10.1/a"
    assert value(spark, t.clean_text(lit("a \n\t  b "))) == "a b"
    assert value(spark, t.anchor(lit("TAD & Compartment Detection"))) == "tad-compartment-detection"
    names = [[], ["A"], ["A", "B"], ["A", "B", "C"]]
    forms = lambda f: [value(spark, f(F.array(*map(lit, n)).cast("array<string>"))) for n in names]
    assert forms(t.authors_readme) == ["Unknown", "A", "A, B", "A et al."]
    assert forms(t.authors_digest) == ["Unknown", "A", "A et al.", "A et al."]
    for n, size in ((100, 100), (101, 100)):
        assert len(value(spark, t.title_cell(lit("x" * n)))) == size
    assert [value(spark, t.ratio_percent(lit(a), lit(b))) for a, b in ((1, 8), (1, 16), (0, 0))] == [12.5, 6.2, 0.0]


def test_classification(spark):
    one = lambda text, c: spark.createDataFrame([(text,)], "x string").select(c.alias("c")).first()["c"]
    x = F.col("x")
    assert one("investigate activity", tx.groups_hit(x, tx.METHODS)) == ["Transformer", "GNN"]
    assert one("zzz", tx.categories(x, tx.FIXTURE)) == ["Other"]
    assert one("deep learning hi-c chromatin", tx.relevance(x, tx.METHODS)) == 0.05 + 0.1
    assert one("shicluster", tx.groups_hit(x, tx.TOOLS)) == ["scHiCluster"]


def test_merge(spark):
    old = frame(spark, paper(0, "A"), paper(1, "a"), paper(2, ""))
    new = frame(spark, paper(0, "a"), paper(1, "B"), paper(2, "b"), paper(3, ""))
    everything, added = pp.merge(old, new)
    assert sorted(r["id"] for r in everything.collect()) == ["A", "B"]
    assert [r["id"] for r in added.collect()] == ["B"]
    assert pp.merge(everything, new)[1].isEmpty()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["a", "A ", "b", "", "https://doi.org/a", "c"]), max_size=8))
def test_first_wins(spark, ids):
    out = pp.first_by_key(frame(spark, *(paper(i, x) for i, x in enumerate(ids))), t.merge_key("id"))
    want = {}
    for i, x in enumerate(ids):
        if x.strip():
            want.setdefault(x.strip().lower(), i)
    assert {r["_key"]: r["pos"] for r in out.collect()} == want


def test_insights(spark):
    def told(*years):
        return an.category_insights(frame(spark, *(paper(i, year=y, categories=["c"]) for i, y in enumerate(years))), 2025).first()["insight"]

    assert told(2025, 2025, 2024, 2010) == "4 papers (2010-2025), rapidly growing, 3 recent"
    assert "actively researched, 2" in told(2025, 2024, 2010, 2011)
    assert "moderately active, 1" in told(2025, 2012, 2010, 2011)
    assert "established" in told(2013, 2012, 2010, 2011)
    assert told(None) == "1 papers"


def test_trends_and_growth(spark):
    df = pp.annotate(frame(spark, paper(0, title="cnn vae", year=2024), paper(1, title="vae", year=2024), paper(2, title="z", year=2023), paper(3, title="cnn", year=2010)))
    assert [(r["year"], r["method"], r["n"]) for r in an.trend_methods(df).orderBy("year", "rank").collect()] == [(2023, None, None), (2024, "Autoencoder", 2), (2024, "CNN", 1)]
    assert an.growth(df, 2025).first()["percent"] == 100
    assert an.landscape(df).count() == 2
    assert "50% growth" not in report.summary(totals.state(df), 2025, "now")


def test_search_and_browse(spark):
    df = frame(spark, paper(0, title="gan", year=2020, date="2020-01-01"), paper(1, title="x", abstract="Gan b", date="2021-01-01"))
    assert [(r["pos"], r["score"]) for r in search.search(df, "gan GAN b").collect()] == [(1, 3), (0, 2)]
    assert search.search(df, "  ").isEmpty()
    assert [r["pos"] for r in search.browse(df, first=2022).collect()] == [1]
    assert [r["pos"] for r in search.page(search.browse(df), 9, 1).collect()] == [0]
    assert search.page_strip(5, 9) == [1, None, 3, 4, 5, 6, 7, None, 9]


def test_store_pipeline_and_stream(spark, tmp_path):
    path = str(tmp_path / "store")
    new = frame(spark, paper(0, "A", "the tion", "x", 2024, "2024-01-01", ["N"]), paper(1, "B", "Gö", "", None), paper(2, "a"))
    first = pipeline.run(spark, path, new, tx.FIXTURE, str(tmp_path / "R.md"), lambda n, text, html: n == 2 and 'the tion' in html)
    assert (first["new_count"], first["total_count"], first["email_sent"]) == (2, 2, True)
    assert "the tion" in (tmp_path / "R.md").read_text()
    again = pipeline.run(spark, path, new, tx.FIXTURE)
    assert (again["existing_count"], again["new_count"]) == (2, 0) and "No new papers" in again["digest"]
    kept = store.read_snapshot(spark, path)
    store.write_json(kept, str(tmp_path / "p.json"))
    assert [p["title"] for p in json.loads((tmp_path / "p.json").read_text())] == ["the tion", "Gö"]
    assert store.read_json(spark, str(tmp_path / "p.json")).count() == 2
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        store.read_json(spark, str(tmp_path / "bad.json")).collect()
    store.write_csv(kept, str(tmp_path / "csv"))
    assert "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv")).startswith("id,title,authors")
    source = str(tmp_path / "in")
    frame(spark, paper(5, "C"), paper(6, "b")).write.parquet(source)
    merge_stream(spark.readStream.schema(PAPER).parquet(source), path, tx.FIXTURE, str(tmp_path / "cp"), str(tmp_path / "delta")).awaitTermination()
    assert store.read_snapshot(spark, path).count() == 3
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "delta")).collect()] == ["C"]


def test_two_runs_keep_the_order(spark, tmp_path):
    path = str(tmp_path / "store")
    pipeline.run(spark, path, frame(spark, paper(0, "A"), paper(1, "B")), tx.FIXTURE)
    pipeline.run(spark, path, frame(spark, paper(0, "C"), paper(1, "b"), paper(2, "D")), tx.FIXTURE)
    assert [r["id"] for r in store.read_snapshot(spark, path).orderBy("pos").collect()] == ["A", "B", "C", "D"]
    assert sorted(r["id"] for r in pipeline.latest_delta(spark, path).collect()) == ["C", "D"]
    for i in range(6):
        store.write_snapshot(store.read_snapshot(spark, path), path, keep=3)
    assert len(list((tmp_path / "store").glob("snapshot-*"))) == 3 and store.read_snapshot(spark, path).count() == 4


def test_repeated_batch(spark, tmp_path, monkeypatch):
    """A batch that fails after its snapshot was written gives the same snapshot and delta when repeated."""
    path, source, delta = (str(tmp_path / x) for x in ("store", "in", "delta"))
    store.write_snapshot(frame(spark, paper(0, "A")), path)
    frame(spark, paper(0, "a"), paper(1, "B")).write.parquet(source)
    whole = store.add_papers

    def broken(*args, **more):
        whole(*args, **more)
        raise RuntimeError("lost")

    def stream():
        return merge_stream(spark.readStream.schema(PAPER).parquet(source), path, tx.FIXTURE, str(tmp_path / "cp"), delta)

    monkeypatch.setattr(store, "add_papers", broken)
    with pytest.raises(Exception, match="lost"):
        stream().awaitTermination()
    assert store.read_snapshot(spark, path).count() == 2
    monkeypatch.setattr(store, "add_papers", whole)
    stream().awaitTermination()
    assert [r["id"] for r in store.read_snapshot(spark, path).orderBy("pos").collect()] == ["A", "B"]
    assert [r["id"] for r in spark.read.parquet(delta).collect()] == ["B"]


def test_analysis_and_answers(spark):
    rows = pp.categorize(frame(spark, paper(0, title="cnn the tion", year=2024), paper(1, title="akita vae", year=2025), paper(2, title="z")), tx.FIXTURE)
    got = report.analyze(rows, 2025, "now")
    assert got["dl_method_distribution"] == {"CNN": 1, "Autoencoder": 1} and got["tool_mentions"] == {"Akita": 1}
    assert got["trend_analysis"][2025] == {"total": 1, "top_methods": {"Autoencoder": 1}} and got["total_papers"] == 3
    assert got["landscape_matrix"]["CNN"] == {"fx_articles": 1, "fx_suffix_en": 1} and got["dl_ratio"] == 66.7
    assert "--- Recent Trends ---\n  2025: 1 papers | Top methods: Autoencoder(1)\n  2024:" in got["research_summary"]
    assert got["research_summary"].endswith("  • Akita is the most referenced tool/model\n\nGenerated: now")
    assert report.analyze(rows.limit(0), 2025, "now")["research_summary"] == "No papers to analyze."
    told = answers.statistics(rows, tx.FIXTURE)
    assert told["categories"] == ["fx_articles", "fx_suffix_en", "Other"] and told["years"] == [2025, 2024]
    assert [p["title"] for p in json.loads(answers.found(rows, "akita"))] == ["akita vae"] and answers.found(rows, " ") == "[]"
    assert json.loads(answers.as_json(answers.digest(rows, rows, tx.FIXTURE, "now")))["new_papers_by_category"]["Other"] == 2


def test_mail_and_commands(spark, tmp_path, monkeypatch, capsys):
    sent = []

    class Server:
        def __init__(self, host, port):
            self.to = (host, port)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        starttls = login = lambda self, *_: None

        def send_message(self, m):
            sent.append(m)

    tax, fresh, path = tmp_path / "t.json", tmp_path / "new.json", str(tmp_path / "store")
    tax.write_text(json.dumps({"g": ["gö"]}))
    fresh.write_text(json.dumps([{"id": "A", "title": "Gö", "authors": ["N"], "year": 2024, "date": "2024-01-01"}]))
    common = ["--store", path, "--taxonomy", str(tax)]
    pipeline.main(["fetch", *common, "--new", str(fresh)])
    pipeline.main(["send-email", *common, "--to", "x@y.z"], Server)
    assert not sent  # no account
    monkeypatch.setenv("SMTP_USER", "u")
    monkeypatch.setenv("SMTP_PASSWORD", "p")
    pipeline.main(["send-email", *common, "--to", "x@y.z"], Server)
    assert [p.get_content_type() for p in sent[0].iter_parts()] == ["text/plain", "text/html"] and sent[0]["To"] == "x@y.z"
    pipeline.main(["analyze", "--store", path])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["total_papers"] == 1
    with pytest.raises(SystemExit):
        pipeline.main(["fetch", "--store", path])


def test_taxonomy_file(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"g": {"description": "d", "keywords": ["ab"]}, "h": ["b"]}))
    tax = tx.Taxonomy.from_json(str(tmp_path / "t.json"))
    out = pp.categorize(frame(spark, paper(0, title="xab")), tax)
    assert out.first()["categories"] == ["g", "h"]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_digest_page_is_never_whole_on_the_driver(spark, tmp_path, monkeypatch):
    """A page comes in pieces, newest papers first, escaped; a large one goes to the server piece by piece and arrives whole."""
    rows = [paper(i, f"A{i}", title=f"<t{i}> & 'q' ü\n.", date=f"2024-01-{1 + i % 9:02}", authors=["N & M"], url="" if i % 2 else 'u"', abstract="x" * 250) for i in range(40)]
    got: list = []
    told = pipeline.run(spark, str(tmp_path / "s"), frame(spark, *rows), tx.FIXTURE, notify=lambda n, text, html: got.append((n, list(html))) or True)
    n, pieces = got[0]
    assert told["email_sent"] and n == 40 and all(isinstance(p, bytes) for p in pieces) and not list((tmp_path / "s" / "digest").iterdir())
    page = b"".join(pieces).decode()
    order = sorted(range(40), key=lambda i: (-(i % 9), i))
    assert [int(x) for x in re.findall(r"&lt;t(\d+)&gt; &amp; &#x27;q&#x27; ü\n\.</a>", page)] == order
    assert page.startswith("<!DOCTYPE html>\n<html><body><h1>Literature Update ") and page.rstrip().endswith("</td></tr>\n</table></body></html>")
    assert page.count('href="#"') == page.count('href="u&quot;"') == 20 and page.count(">" + "x" * 200 + "...</td>") == 40 and page.count("N &amp; M | ") == 40
    sent: list = []

    class Server:
        starttls = login = ehlo_or_helo_if_needed = lambda self, *_: None
        mail = rcpt = lambda self, *_: (250, b"")
        docmd = lambda self, *_: (354, b"")
        getreply = lambda self: (250, b"")
        send = lambda self, data: sent.append(data)
        __init__ = __exit__ = lambda self, *_: None
        __enter__ = lambda self: self

    box = mail.Mailbox(["x@y.z"], "u", "p")
    monkeypatch.setattr(mail, "WHOLE", 1_000)
    assert mail.send(40, ".plain ü", iter([page.encode()[i : i + 1_000] for i in range(0, len(page.encode()), 1_000)]), box, Server)
    assert max(map(len, sent)) < 2_000 and sent[-1] == b"\r\n.\r\n"
    whole = email.message_from_bytes(re.sub(rb"(?m)^\.\.", b".", b"".join(sent[:-1])), policy=email.policy.SMTP)
    plain, html = whole.iter_parts()
    assert plain.get_content().strip() == ".plain ü" and html.get_payload(decode=True).decode() == page and html.get_content_type() == "text/html"
