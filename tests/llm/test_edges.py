"""What operators give for null, empty, repeated and long texts and rows without an id, and the components of links."""

import numpy as np
import pytest
from test_operators import EDGES

from citeloom.llm import backoff, components, langid, licenses, mixing, neardup, runtime, secretscan


def table(frame, *columns):
    return sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in frame.collect())


def test_texts_without_secrets_or_licenses(docs):
    got = table(secretscan.scan_secrets(docs(EDGES, extra=True)), "spans", "cut")
    assert got == sorted((str(i), "", False) for i, _ in EDGES)
    texts = {r["doc_id"]: r["redacted"] for r in secretscan.scan_secrets(docs(EDGES)).collect()}
    assert texts == dict(EDGES)
    assert all(r["n_licenses"] == 0 and r["license"] is None and r["licenses"] == "" for r in licenses.scan_licenses(docs(EDGES)).collect())


def test_scores(docs):
    got = {(r["doc_id"], r["n_words"], r["per_word"] is None) for r in backoff.score(docs(EDGES, extra=True)).collect()}
    assert got == {(1, 0, True), (2, 0, True), (3, 0, True), (4, 1, False), (None, 2, False), (5, 6, False), (6, 30_000, False)}


def test_components_and_sizes(docs):
    got = table(neardup.near_duplicates(docs(EDGES, extra=True)), "n_shingles", "component_id", "kept")
    assert got == sorted([("1", 0, 1, True), ("2", 0, 2, True), ("3", 0, 3, True), ("4", 1, 4, True), ("4", 1, 4, True), ("None", 1, None, True), ("5", 1, 5, True), ("6", 1, 6, True)], key=lambda x: (x[0], x[1]))
    mixed = table(mixing.mix(docs(EDGES, extra=True)), "size", "taken")
    assert [x[1] for x in mixed] == [0, 0, 0, 1, 1, 6, 30_000, 2] and sum(x[2] for x in mixed) == 30_010 * 3 // 2


def test_links_of_rows_that_share_an_id(docs):
    """Texts a and b under one id: each is linked with its own near copy, in any order of the rows."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z")]
    for order in (rows, [rows[1], rows[0], *rows[2:]], rows[::-1]):
        got = table(neardup.near_duplicates(docs(order)), "component_id", "kept")
        assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 1, False)]


def test_languages_of_texts_without_letters(docs):
    rows = [(i, t, "en") for i, t in EDGES]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(rows, extra=True)).collect()}
    assert all(got[i] == ("und", 0) for i in (1, 2, 3)) and all(got[i][0] == "en" and 0 < got[i][1] <= 1 for i in (4, 5, 6, None))


@pytest.mark.parametrize("kind", ["random", "chain", "hub"])
def test_components(spark, kind):
    rng = np.random.default_rng(2)
    links = {"random": rng.integers(0, 300, (200, 2)).tolist(), "chain": [[i, i + 1] for i in range(120)], "hub": [[500, i] for i in range(200)]}[kind]
    parent = list(range(501))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    frame = spark.createDataFrame([*links, [7, 7], [None, 3]], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(frame).collect()}
    assert got == {x: find(x) for pair in links for x in pair if pair[0] != pair[1]}


def test_stored_tables_are_forgotten(spark, docs):
    before = runtime.tables()
    frame = runtime.stored(docs([(1, "x")]), "t")
    assert frame.count() == 1 and len(runtime.tables()) == len(before) + 1
    runtime.forget(spark, runtime.tables()[len(before) :])
    assert runtime.tables() == before
