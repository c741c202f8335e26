"""Searches by the trigram index against the scan, and the index along updates of the store."""

import random

import pytest
from test_literature import frame, paper

from citeloom.functions import taxonomy as tx
from citeloom.operators import search, substrings
from citeloom.plans import pipeline
from citeloom.sources import store

QUERIES = ["gan gat", "the the ion", "a", "zz", "qx7", "Ünï 𝔸b", "rare-word common", "cat%_ .*", "fx_rare", "  ", "nowhere", "ab ab ab xylo", "other common ion the"]


@pytest.fixture(scope="module")
def collection(spark):
    rng = random.Random(5)
    words = ["gan", "gate", "theorem", "ion", "ünïcode", "𝔸bc", "common", "cat%_", ".*", "abacus", "xylophone"]
    rows = [paper(i, str(i), " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice(["", None, "common text Ion", "the end"]), categories=[rng.choice(["Other", "fx_rare Group"])]) for i in range(600)]
    rows[77] = paper(77, "77", "a rare-word", "qx7 stands here")
    rows[78] = paper(78, None, None, None, categories=())
    return frame(spark, *rows)


@pytest.fixture(scope="module")
def index(spark, collection, tmp_path_factory):
    return substrings.Index(spark, [substrings.build(collection, str(tmp_path_factory.mktemp("i") / "all"), chunk=16)])


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("limit", [7, 1000])
def test_equals_the_scan(collection, index, query, limit):
    want = [(r["pos"], r["score"]) for r in search.search(collection, query, limit).collect()]
    got = [(r["pos"], r["score"]) for r in substrings.search(collection, index, query, limit).collect()]
    assert got == want


def test_rare_terms_read_little(index):
    found = index.candidates(["rare-word", "qx7"]).collect()
    assert [(r["pos"], r["bound"]) for r in found] == [(77, 2)]
    read = index.texts().where(f"chunk = {found[0]['chunk']}")
    assert "PartitionFilters: [isnotnull(chunk" in read._jdf.queryExecution().toString()
    assert read.count() == 16 < 600 / 10
    assert index.candidates(["nowhere"]).isEmpty()


def test_rows_of_postings_are_bounded(index):
    assert index.postings().agg({"n": "max"}).first()[0] <= 16
    total = {r["gram"]: r["n"] for r in index.counts().collect()}
    assert total["com"] == index.texts().where("contains(text, 'com')").count()


def test_common_terms_wait_for_rare_ones(index, monkeypatch):
    """Texts that hold too few terms aren't read once enough hold more."""
    read = []
    texts = substrings.Index.texts
    monkeypatch.setattr(substrings.Index, "texts", lambda self: read.append(1) or texts(self))
    best = index.best("xylo aba ion the", 3)
    assert len(best) == 3 and len(read) < 4 and best[0][1] >= 3


def test_empty(spark, tmp_path):
    none = frame(spark)
    index = substrings.Index(spark, [substrings.build(none, str(tmp_path / "x"))])
    assert substrings.search(none, index, "abc").isEmpty() and substrings.search(none, substrings.Index(spark, []), "abc").isEmpty()


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_the_update_job_keeps_it(spark, tmp_path):
    path, root = str(tmp_path / "s"), tmp_path / "s" / "index"

    def run(*rows, taxonomy=tx.FIXTURE):
        pipeline.run(spark, path, frame(spark, *rows), taxonomy, index=True)
        index = pipeline.index_of(spark, path)
        papers = store.read_snapshot(spark, path)
        for query in ("gan tion", "fx_rare", "new"):
            assert substrings.search(papers, index, query).collect() == search.search(papers, query).collect()
        return index.folders

    one = run(paper(0, "A", "gan tion"), paper(1, "B", "x"))
    old = files(root)
    two = run(paper(0, "C", "new gan"), paper(1, "a", "other"))
    assert two[:1] == one and len(two) == 2 and old.items() <= files(root).items()
    assert run(paper(0, "c", "none")) == two  # nothing added
    other = run(paper(0, "D", "new"), taxonomy=tx.Taxonomy({"fx_rare": ["x"]}))
    assert len(other) == 1 and other[0] not in two
    pipeline.run(spark, path, frame(spark, paper(0, "E", "gan")), tx.FIXTURE)
    assert pipeline.index_of(spark, path) is None  # not kept: searches scan


def test_a_crash_before_the_pointer_moves(spark, tmp_path, monkeypatch, capsys):
    path = str(tmp_path / "s")
    pipeline.run(spark, path, frame(spark, paper(0, "A")), tx.FIXTURE, index=True)
    name = store.pointer(spark, path).name
    with monkeypatch.context() as m:
        m.setattr(store, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            pipeline.run(spark, path, frame(spark, paper(0, "B", "bert")), tx.FIXTURE, index=True)
    assert store.pointer(spark, path).name == name and store.read_snapshot(spark, path).count() == 1
    assert [r["id"] for r in pipeline.latest_delta(spark, path).collect()] == ["A"]
    out = pipeline.run(spark, path, frame(spark, paper(0, "B", "bert")), tx.FIXTURE, index=True)
    assert (out["new_count"], out["total_count"]) == (1, 2) and [r["id"] for r in pipeline.latest_delta(spark, path).collect()] == ["B"]
    pipeline.main(["search", "--store", path, "bert"])
    assert "bert" in capsys.readouterr().out


def test_grams_part_no_character():
    """Those of characters beyond 16 bits are whole, and each stands once."""
    assert sorted(substrings.grams("a𝔸ba𝔸b")) == sorted(["a𝔸b", "𝔸ba", "ba𝔸", "𝔸b", "b"]) and substrings.grams("") == []
