"""License scans on neighbouring, damaged and stretched copies."""

import random

import pytest

from citeloom.llm import licenses

MIT, ISC = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["ISC"]


def found(docs, text, name, templates=None):
    """[(start, end)] of a template's matches in a text, and the best coverage."""
    r = licenses.scan_licenses(docs([(1, text)]), templates).first()
    spans = [tuple(map(int, x.rsplit(":", 2)[1:])) for x in r["licenses"].split(",") if x.startswith(f"{name}:")]
    return spans, r["coverage"] if r["license"] == name else None


def changed(text, *places):
    words = text.split(" ")
    for p in places:
        words[p] = f"zq{p}"
    return " ".join(words)


def test_neighbours_keep_their_words(docs):
    spans, best = found(docs, f"{changed(ISC, 9)} {ISC}", "ISC")
    assert len(spans) == 2 and best == 1.0 and spans[1][0] == len(changed(ISC, 9)) + 1
    bad = changed(MIT, 3, 11, 29, 41, 55, 68, 80)
    for text in (f"{bad} {MIT}", f"{MIT} {bad}", f"{bad} {bad} {bad}"):
        spans, _ = found(docs, text, "MIT")
        assert len(spans) == len(text) // len(bad) or len(spans) == 2 == text.count("Permission")
    assert len(found(docs, f"{bad} {MIT}", "MIT")[0]) == len(found(docs, f"{MIT} {bad}", "MIT")[0]) == 2
    assert len(found(docs, f"{bad} {bad} {bad}", "MIT")[0]) == 3


def test_words_put_in(docs):
    words = MIT.split(" ")
    stretched = " ".join(w + (" pad" if i % 2 else "") for i, w in enumerate(words))
    assert found(docs, f"x {stretched} y", "MIT") == ([(2, 2 + len(stretched) - (4 if stretched.endswith(" pad") else 0) - 1)], 1.0)
    middle = " ".join([*words[:40], *["foreign"] * 60, *words[40:]])
    spans, best = found(docs, middle, "MIT")
    assert len(spans) == 1 and best == 1.0
    assert found(docs, " ".join([*words[:30], *["far"] * 400, *words[30:]]), "MIT")[0] == []


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for i, y in enumerate(b, 1):
            before, row[i] = row[i], before + 1 if x == y else max(row[i], row[i - 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_mixtures_of_damaged_copies(docs, seed):
    """Every copy with up to a tenth of its words damaged is found where it stands, as well covered as the longest common subsequence allows, but for a few words."""
    rng = random.Random(seed)
    templates = {"MIT": MIT, "ISC": ISC, "own": "one alpha two beta one gamma two delta one epsilon two zeta one eta two theta"}
    text, planted = [], []
    for _ in range(14):
        name = rng.choice(list(templates))
        words = [w.strip('(),.;:"').lower() for w in templates[name].replace("/", " ").split(" ")]
        copy = list(words)
        for _ in range(rng.randint(0, len(words) // 10)):
            i = rng.randrange(len(copy))
            copy[i : i + 1] = rng.choice([[], ["zq"], [copy[i], "zr"]])
        text += ["fill"] * rng.choice([0, 0, 3, 200])
        planted.append((name, len(text), len(text) + len(copy), common(copy, words) / len(words)))
        text += copy
    starts = [0]
    for w in text:
        starts.append(starts[-1] + len(w) + 1)
    r = licenses.scan_licenses(docs([(1, " ".join(text))]), templates).first()
    got = sorted((int(s), n, int(e)) for n, s, e in (x.rsplit(":", 2) for x in r["licenses"].split(",")))
    assert [n for _, n, _ in got] == [n for n, *_ in planted]
    for (s, n, e), (_, low, high, share) in zip(got, planted):
        assert abs(s - starts[low]) <= 60 and abs(e - starts[high]) <= 60
        assert share >= 0.85


def test_edges(docs):
    many = " ".join([ISC] * 300)
    assert len(found(docs, many, "ISC")[0]) == 300
    assert found(docs, "use copy modify " * 30_000, "ISC")[0] == []
    twice = {"t": "a b a b", "none": "", "one": "solo"}
    assert found(docs, "x a b a b y", "t", twice)[0] == [(2, 9)] and len(found(docs, "solo solo", "one", twice)[0]) == 2
    assert licenses.scan_licenses(docs([(1, None), (2, ""), (3, "!!!")]), twice).where("n_licenses > 0").isEmpty()
