"""Answers, dumps and the data source of searches."""

import json
import threading
from collections import Counter
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from samples import FIELDS, PAPERS, SAMPLES

from citeloom.plans import pipeline
from citeloom.sources import payloads, requests, searches, store
from citeloom.sources.catalogue import CATALOGUE


@pytest.mark.parametrize("source", sorted(SAMPLES))
def test_parsers(spark, source):
    answers = spark.createDataFrame([(0, "genome deep learning", SAMPLES[source])], "place long, query string, value string")
    out = payloads.PARSERS[source](answers).withColumn("authors", F.array_join("authors", ";")).orderBy("pos").select(*FIELDS)
    assert [tuple(r) for r in out.collect()] == PAPERS[source]


def entry(i):
    return f"<PubmedArticle n='{i}'><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>T {i} &lt; <i>x</i></ArticleTitle></Article></MedlineCitation></PubmedArticle>"


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_a_dump_is_read_by_many_tasks(spark, tmp_path, small_splits):
    """Each record once and in order, wherever splits fall; broken records and text between them count for nothing."""
    n = 6_000
    for f, numbers in (("a.xml", range(n // 2)), ("b.xml", range(n // 2, n))):
        body = "\n".join(entry(i) + ("<PubmedArticle><broken></PubmedArticle>" if i % 1000 == 7 else "") for i in numbers)
        (tmp_path / f).write_text(f'<?xml version="1.0"?><!DOCTYPE PubmedArticleSet><PubmedArticleSet>\n{body}\n</PubmedArticleSet>\n')
    rows = payloads.dump(spark, str(tmp_path), "pubmed")
    assert rows.rdd.getNumPartitions() >= 10
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < n / 5
    got = payloads.read(spark, "pubmed", str(tmp_path)).select("pos", "id", "title").collect()
    assert len({r["pos"] for r in got}) == n
    ordered = sorted(got, key=lambda r: r["pos"])
    assert [r["id"] for r in ordered] == [f"pmid:{i}" for i in range(n)] and ordered[5]["title"] == "T 5 < x"


def test_dumps_without_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed></feed>")
    (tmp_path / "b.xml").write_text("")
    assert payloads.read(spark, "arxiv", str(tmp_path)).isEmpty()
    assert payloads.read(spark, "nowhere", str(tmp_path)) is None


def test_files_of_answers_keep_their_order(spark, tmp_path):
    for i in (0, 1, 2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"message": {"items": [{"DOI": f"10.1/{i}.{j}", "title": [f"T{i}{j}"]} for j in range(4)]}}))
    got = payloads.read(spark, "crossref", str(tmp_path)).orderBy("pos").collect()
    assert [r["id"] for r in got] == [f"10.1/{i}.{j}" for i in range(3) for j in range(4)]


class Services:
    """The services' answers by HTTP; what was asked, and how often each busy one refused."""

    def __init__(self, busy=0):
        asked, refused = self.asked, self.refused = [], Counter()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                asked.append(self.path)
                source = self.path.split("/")[1]
                if source == "crossref" or (source == "europepmc" and refused[self.path] < busy):
                    refused[self.path] += 1
                    self.send_error(500 if source == "crossref" else 429)
                    return
                body = SAMPLES.get(source, "")
                if "esearch" in self.path:
                    body = json.dumps({"esearchresult": {"idlist": ["11", "12"] if "Hi-C+OR+HiC" in self.path else []}})
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.address = f"http://127.0.0.1:{self.server.server_port}"

    def __enter__(self):
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_):
        self.server.shutdown()
        self.server.server_close()


def test_executors_ask_and_one_failure_stays_alone(spark):
    wanted = [{"source": s, "query": "genome deep learning"} for s in ("arxiv", "crossref", "none", "europepmc", "biorxiv")]
    with Services(busy=1) as services:
        frame = searches.asked(spark, wanted, mirror=services.address, pause=0, tries=2)
        assert frame.rdd.getNumPartitions() == len(wanted)
        services.asked.clear()
        got = {r["source"]: r for r in frame.collect()}
        assert {s for s, r in got.items() if r["error"]} == {"crossref", "none"}
        assert "HTTPError" in got["crossref"]["error"] and got["none"]["error"] == "ValueError: unknown source: none"
        assert got["arxiv"]["value"] == SAMPLES["arxiv"] and got["europepmc"]["value"] == SAMPLES["europepmc"]
        assert services.refused == {p: (2 if "crossref" in p else 1) for p in services.refused}
        services.asked.clear()
        assert frame.where("source = 'arxiv'").count() == 1 and len(services.asked) == 1  # the others aren't asked
        services.asked.clear()
        assert frame.where("source in ('arxiv', 'biorxiv') and search > 0").select("source").collect() == [("biorxiv",)]
        assert sorted(p.split("/")[1] for p in services.asked) == ["arxiv", "biorxiv"] or len(services.asked) == 2


def test_filters_choose_searches():
    reader = searches.SearchReader({"searches": json.dumps([{"source": s, "query": q} for s in "ab" for q in "xyz"]), "pause": "7"})
    left = list(reader.pushFilters([EqualTo(("source",), "b"), In(("query",), ("x", "z")), GreaterThan(("search",), 1), EqualTo(("error",), "e")]))
    assert left == [GreaterThan(("search",), 1), EqualTo(("error",), "e")]
    parts = reader.partitions()
    assert [(p.search, p.source, p.query) for p in parts] == [(3, "b", "x"), (5, "b", "z")]
    assert parts[1].earliest - parts[0].earliest == 7
    assert list(searches.SearchReader({"source": "a"}).partitions())[0].query == ""
    reader.wanted = {"source": {"a"} & {"b"}}
    assert reader.partitions() == []


def test_patience():
    tries, waits = [], []

    def ask(url):
        tries.append(url)
        if len(tries) < 3:
            raise HTTPError(url, 503, "busy", {}, None)
        return b"x"

    assert searches.patiently(ask, 3, waits.append)("u") == b"x" and waits == [1.0, 2.0]
    tries.clear()
    with pytest.raises(HTTPError):
        searches.patiently(ask, 2, waits.append)("u")
    with pytest.raises(HTTPError):
        searches.patiently(lambda u: (_ for _ in ()).throw(HTTPError(u, 404, "none", {}, None)), 3, waits.append)("u")


def test_the_whole_catalogue(spark, tmp_path, capsys):
    """An update from all built-in searches, one service failing: what the others found is stored."""
    (tmp_path / "t.json").write_text(json.dumps({"g": ["genome"]}))
    with Services() as services:
        pipeline.main(["fetch", "--store", str(tmp_path / "s"), "--taxonomy", str(tmp_path / "t.json"), "--answers", str(tmp_path / "a"), "--mirror", services.address])
        asked = services.asked
    told = capsys.readouterr().out
    failed = sum(c["source"] == "crossref" for c in CATALOGUE)
    assert told.count("HTTPError") == failed and len(CATALOGUE) == 66
    assert len([p for p in asked if "esearch" in p]) == 31 and len([p for p in asked if "efetch" in p]) == 1
    kept = store.read_snapshot(spark, str(tmp_path / "s")).orderBy("pos").collect()
    assert [r["source"] for r in kept] == ["pubmed", "pubmed", "pubmed", "biorxiv", "arxiv", "arxiv", "semantic_scholar", "europepmc"]
    assert [r["pos"] for r in kept] == list(range(8))
    assert any(p.endswith("efetch.fcgi?db=pubmed&id=11%2C12&retmode=xml") for p in asked)


def test_addresses():
    day = date(2024, 2, 29)
    assert requests.search_address("biorxiv", "x", requests.year_before(day), day) == "https://api.biorxiv.org/details/biorxiv/2023-02-28/2024-02-29/0/50"
    assert "search_query=all%3A3D%2Bgenome&" in requests.search_address("arxiv", "3D genome", day, day)
    assert requests.search_address("crossref", "x", day, day, 500).count("rows=50") == 1
    assert requests.mirrored("https://a.org/b/c?d", "s", "http://m/") == "http://m/s/b/c?d"


def test_records_are_read_in_slices():
    """However many records a batch holds, few are Python objects at once, and their numbers run on."""
    batch = pa.RecordBatch.from_pydict({"place": [7] * 1000, "record": ["<entry><title>t</title></entry>", "<entry>"] * 500, "today": ["2025-06-15"] * 1000})
    made = list(payloads._reader(payloads.ARXIV_PARTS)(iter([batch])))
    assert max(b.num_rows for b in made) <= payloads.SLICE and sum(b.num_rows for b in made) == 500
    assert [x for b in made for x in b.column(0).to_pylist()] == [7 + i for i in range(0, 1000, 2)]
