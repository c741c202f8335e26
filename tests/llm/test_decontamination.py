"""Decontamination: hot words in long texts, both ways of joining, and brute force."""

import time

import numpy as np
import pytest

from citeloom.llm import decontam


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


@pytest.fixture(params=["broadcast", "shuffled"])
def joined(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(decontam, "BROADCAST_WORDS", -1)
    return request.param


def brute(words, items, size=13):
    hit, ids = set(), set()
    for name, item in items:
        k = min(size, len(item))
        windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if item else set()
        for p in range(len(words) - k + 1) if windows else ():
            if tuple(words[p : p + k]) in windows:
                hit |= set(range(p, p + k))
                ids.add(str(name))
    return len(hit), sorted(ids)


def test_against_brute_force(spark, docs, joined):
    """Texts and items of few different words, so that windows repeat, overlap and nearly match."""
    rng = np.random.default_rng(8)
    draw = lambda n, kinds: [f"v{x}" for x in rng.integers(0, kinds, n)]
    items = [(i, draw(int(rng.integers(0, 40)), 3)) for i in range(12)] + [(90, ["v0"]), (91, ["v1"] * 30), (91, ["v2"] * 14), (None, ["rare", "v1"])]
    texts = []
    for i in range(60):
        words = draw(int(rng.integers(0, 60)), 3)
        if i % 2:
            words[int(rng.integers(0, len(words) + 1)) : 0] = items[i % 16][1][int(rng.integers(0, 3)) :]
        texts.append(words)
    texts += [["v1"] * 50, ["rare", "v1"], ["v2"] * 13, []]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = by_id(decontam.contamination(docs([(i, " ".join(t)) for i, t in enumerate(texts)]), frame))
    named = [("null" if i is None else i, w) for i, w in items]
    for i, words in enumerate(texts):
        hit, ids = brute(words, named)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(words), hit, ids)
        assert got[i]["contaminated"] == (hit > 0 and 20 * hit >= len(words))


def test_a_hot_word(spark, docs, joined):
    """A long text of one word, against items of that word alone, once and many times."""
    text = "the " * 20_000
    frame = spark.createDataFrame([(1, "the"), (2, "the " * 300), (3, "the end")], "item_id long, text string")
    began = time.time()
    got = by_id(decontam.contamination(docs([(1, text), (2, "no such word"), (3, "The end " * 2000)]), frame))
    assert [(got[i]["n_hit"], got[i]["items"]) for i in (1, 2, 3)] == [(20_000, ["1", "2"]), (0, []), (4000, ["1", "3"])]
    assert [[tuple(x) for x in got[i]["near"]] for i in (1, 2, 3)] == [[("1", 0), ("2", -decontam.SLOP)], [], [("1", 0), ("2", -1), ("3", 0)]]
    assert time.time() - began < 120


@pytest.mark.parametrize("many", [0, 1 << 30])
def test_near_places_of_hot_words(spark, docs, monkeypatch, many):
    """Texts of three words against items of these and of words that no text has: the places of windows tried one by one, all of them."""
    monkeypatch.setattr(decontam, "MANY_BEGINS", many)
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(["a", "b", "c"], n))) for i, n in enumerate([3, 20, 60, 90])]
    items = [(i, " ".join(rng.choice(["a", "b", "c", "x"], n, p=p))) for i, (n, p) in enumerate([(2, [0.5, 0.5, 0, 0]), (7, [0.4, 0.2, 0.2, 0.2]), (9, [0.1, 0.1, 0.1, 0.7]), (12, [0.3, 0.3, 0.3, 0.1])])]
    got = by_id(decontam.contamination(docs(texts), spark.createDataFrame(items, "item_id long, text string")))
    for doc, text in texts:
        want, words = [], text.split()
        for item, phrase in ((i, t.split()) for i, t in items):
            best = (0, 0)
            for start in range(-len(phrase) - decontam.SLOP, len(words) + 1):
                stand = [(s, j) for j, w in enumerate(phrase) for s in range(start, start + decontam.SLOP + 1) if 0 <= s + j < len(words) and words[s + j] == w]
                aligned = min(len({j for _, j in stand}), len({s + j for s, j in stand}))
                best = max(best, (aligned, -min((s for s, _ in stand), default=0)))
            need = max(min(2, len(phrase)), -(-len(phrase) // 2))
            want += [(str(item), -best[1])] if best[0] >= need else []
        assert [tuple(x) for x in got[doc]["near"]] == want


def test_near_matches_either_way(spark, docs, joined):
    words = [f"w{i}" for i in range(20)]
    frame = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = by_id(decontam.contamination(docs([(0, " ".join(words[2:14])), (1, "x " + " ".join(words[:6] + ["new"] + words[6:11])), (2, " ".join(words[:9]))]), frame))
    assert [[tuple(x) for x in got[i]["near"]] for i in range(3)] == [[("7", -2)], [("7", 1)], []]
