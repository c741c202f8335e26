"""Totals that updates add to, against the statistics of the whole collection."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_literature import frame, paper

from citeloom.functions import taxonomy as tx
from citeloom.operators import analysis as an
from citeloom.operators import papers as pp
from citeloom.operators import report, totals
from citeloom.plans import pipeline
from citeloom.shared import cut
from citeloom.sources import store


def collection(spark, n, start=0, recent=True):
    rng = random.Random(n + start)
    words = ["cnn", "vae", "gat", "the tion", "der sch", "akita", "dip-c", "nothing", "lstm gan"]
    year = lambda: rng.choice([None, 0, 2001, 2015, 2022, 2023, *([2024, 2025] if recent else [])])
    return frame(spark, *(paper(start + i, f"K{start + i}", " ".join(rng.choices(words, k=rng.randint(1, 4))), "", year(), source=rng.choice(["a", "b", None]), categories=None if rng.random() < 0.1 else ()) for i in range(n)))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


PAIRS = [
    (totals.total, pp.total),
    (totals.by_year, pp.by_year),
    (totals.by_source, pp.by_source),
    (totals.by_category, pp.by_category),
    (totals.learning_share, an.learning_share),
    (lambda x: totals.top_members(x, "method"), lambda p: an.top_members(p, "methods")),
    (lambda x: totals.top_members(x, "tool"), lambda p: an.top_members(p, "tools")),
    (totals.trend_years, an.trend_years),
    (totals.trend_methods, an.trend_methods),
    (totals.landscape, an.landscape),
    (lambda x: totals.hot_topics(x, 2025), lambda p: an.hot_topics(p, 2025)),
    (lambda x: totals.growth(x, 2025), lambda p: an.growth(p, 2025)),
    (lambda x: totals.category_insights(x, 2025), lambda p: an.category_insights(p, 2025)),
]


@pytest.mark.parametrize("recent", [True, False])
def test_three_updates_equal_the_whole(spark, recent):
    """Categories null and empty among them; without recent papers the first ones give the topics."""
    annotate = lambda df, classify: cut(pp.annotate(pp.categorize(df, tx.FIXTURE) if classify else df))
    parts = [annotate(collection(spark, n, start, recent), classify) for n, start, classify in ((20, 0, True), (60, 20, False), (90, 80, True))]
    out = totals.empty(spark)
    for part in parts:
        out = cut(totals.combined(out, totals.state(part)))
    whole = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    for read, count in PAIRS:
        assert rows(read(out)) == rows(count(whole))
    assert rows(out) == rows(totals.combined(totals.state(whole)))


def test_each_paper_is_classified_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def methods(title):
        seen.add(1)
        return ["CNN"]

    papers = collection(spark, 200).withColumns({"methods": methods("title"), "tools": F.array().cast("array<string>")})
    counted = cut(totals.combined(totals.empty(spark), totals.state(papers)))
    assert seen.value == 200 and totals.total(counted).first()["total"] == 200


def test_nothing(spark):
    for none in (totals.empty(spark), totals.state(pp.annotate(frame(spark)))):
        assert totals.total(none).first()["total"] == 0 and totals.learning_share(none).first()["dl_ratio"] == 0
        assert all(read(none).isEmpty() for read, _ in PAIRS[1:4])
        assert report.analysis(none, 2025, "now")["research_summary"] == "No papers to analyze."


def test_an_update_reads_its_own_papers_alone(spark, tmp_path):
    path = str(tmp_path)
    pipeline.run(spark, path, collection(spark, 40), tx.FIXTURE, count=True)
    pipeline.run(spark, path, collection(spark, 30, 30), tx.FIXTURE, count=True)

    def broken(name):
        """The papers that stood before can't be read while the totals advance."""
        held = {p: p.read_bytes() for old in store.manifest(spark, path).parts for p in (tmp_path / old).rglob("*.parquet")}
        for p in held:
            p.write_bytes(b"")
        pipeline._count(spark, path, name)
        for p, data in held.items():
            p.write_bytes(data)

    name = store.add_papers(spark, path, collection(spark, 50, 70), lambda p: pp.categorize(p, tx.FIXTURE), finish=broken)
    whole = totals.state(pp.annotate(store.read_snapshot(spark, path)))
    assert rows(pipeline.totals_of(spark, path, name)) == rows(totals.combined(whole)) and store.read_snapshot(spark, path).count() == 110


def test_commands_read_the_totals(spark, tmp_path, capsys):
    path, tax, fresh = str(tmp_path / "s"), tmp_path / "t.json", tmp_path / "new.json"
    tax.write_text(json.dumps({"g": ["cnn"]}))
    fresh.write_text(json.dumps([{"id": "A", "title": "cnn", "year": 2025}, {"id": "B", "title": "x", "year": 2024}]))
    pipeline.main(["fetch", "--store", path, "--taxonomy", str(tax), "--new", str(fresh), "--totals"])
    capsys.readouterr()
    pipeline.main(["analyze", "--store", path])
    with_totals = json.loads(capsys.readouterr().out.splitlines()[-1])
    plain = report.analyze(store.read_snapshot(spark, path), 2026, "now")
    assert {k: v for k, v in with_totals.items() if k not in ("generated_at", "research_summary", "trend_analysis", "hot_topics", "category_insights")} == {k: v for k, v in plain.items() if k not in ("generated_at", "research_summary", "trend_analysis", "hot_topics", "category_insights")}
    pipeline.main(["stats", "--store", path])
    assert "|2025|1" in capsys.readouterr().out.replace(" ", "")
    assert pipeline.totals_of(spark, path) is not None
    pipeline.run(spark, path, None, tx.Taxonomy({"h": ["x"]}), count=True)
    assert {r["category"]: r["n"] for r in totals.by_category(pipeline.totals_of(spark, path)).collect()} == {"h": 1, "Other": 1}
