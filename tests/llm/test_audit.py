"""The filter audit against a loop over documents and orders, and its edges."""

import random
from collections import Counter
from itertools import permutations

from citeloom.llm import audit

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: {doc_id: (good, toxic)}."""
    import re

    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    fails = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((lang or "", {k for k, v in f.items() if v}, *labels.get(i, (False, False))))
    out, total = {}, Counter()
    for part in {x[0] for x in fails}:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                c = Counter()
                for p, bad, good, toxic in fails:
                    if p != part:
                        continue
                    before, hit = bad & set(order[: step - 1]), f in bad
                    c["kept"] += not before and not hit
                    c["removed"] += hit and not before
                    c["redundant"] += hit and bool(before)
                    c["unique_fails"] += bad == {f}
                    c["good_lost"] += hit and not before and good
                    c["toxic_lost"] += hit and not before and toxic
                out[part, order, step] = c
                total[part, f] += c["removed"]
    return {k: tuple(c[n] for n in COLUMNS[:-1]) + (total[k[0], k[1][k[2] - 1]],) for k, c in out.items()}


def result(frame):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def test_against_a_loop(spark, docs):
    rng = random.Random(3)
    texts = ["", None, "a b", "a b", "X" * 9, "w " * 300, " ".join(f"w{i}" for i in range(260)), " ".join(f"w{i}" for i in range(260)), "# " + " ".join(f"v{i}" for i in range(210)), "Ä b 𝔸C"]
    rows = [(i // 2 if i % 7 == 0 else i if i % 11 else None, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(60)]
    rows += rows[:3]
    said = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 50, 2)] + [(4, 1, 0), (None, 1, 1), (6, None, 1)]
    labels = {}
    for i, q, t in said:
        good, toxic = labels.get(i, (False, False))
        labels[i] = (good or q == 1, toxic or t == 1)
    del labels[None]
    table = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    got = result(audit.audit(docs(rows, extra=True), table.selectExpr("*", "'x' AS part", "1 AS mask")))
    assert got == brute(rows, labels) and len(got) == 3 * 120 * 5


def test_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs([]), none).count() == 0
    got = result(audit.audit(docs([(None, None, None)]), none))
    assert len(got) == 600 and all(c[0] + c[1] + c[2] <= 1 for c in got.values()) and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
    long = " ".join(f"w{i}" for i in range(300_000))
    assert result(audit.audit(docs([(1, long, "x")]), none))["x", "EDCBA", 5][0] == 1


def test_other_filters(spark):
    """Cells of two filters, whatever they are: two orders, two steps."""
    cells = spark.createDataFrame([("p", 3, 10, 4, 1), ("p", 1, 5, 0, 0), ("p", 0, 2, 2, 0)], "part string, mask int, n long, good long, toxic long")
    got = result(audit.interactions(cells, "xy"))
    assert got == {("p", "xy", 1): (2, 15, 0, 5, 4, 1, 20), ("p", "xy", 2): (2, 0, 10, 0, 0, 0, 10), ("p", "yx", 1): (7, 10, 0, 0, 4, 1, 10), ("p", "yx", 2): (2, 5, 10, 5, 0, 0, 20)}
