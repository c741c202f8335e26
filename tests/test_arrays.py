"""JSON arrays that many tasks read, against json.loads."""

import json
import random

import pytest

from citeloom.sources import store

ODD = ["", "}", "{", '"', '\\"', "\\", '"},{"', "]", "[", "a\nb", "\\\\", "é x", "},\n{", "'"]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "97")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
@pytest.mark.parametrize("n", [0, 1, 40])
def test_every_paper_in_its_place(spark, tmp_path, small_splits, form, n):
    """Splits begin anywhere: inside texts that hold brackets, quotes and escapes, and inside papers longer than a split."""
    rng = random.Random(n)
    text = lambda: "".join(rng.choices(ODD, k=rng.choice([0, 1, 3, 60])))
    made = [{"id": str(i), "title": text(), "abstract": text(), "authors": [text() for _ in range(rng.randint(0, 3))], "year": rng.choice([None, 2020]), "more": {"deep": [{"x": text()}]}} for i in range(n)]
    (tmp_path / "p.json").write_text(json.dumps(made, **form) + "\n", encoding="utf-8")
    read = store.read_json(spark, str(tmp_path / "p.json"))
    assert [(r["pos"], r["id"], r["title"], r["abstract"], r["authors"], r["year"]) for r in read.orderBy("pos").collect()] == [(i, m["id"], m["title"], m["abstract"], m["authors"], m["year"]) for i, m in enumerate(made)]


def test_a_file_is_no_single_tasks(spark, tmp_path):
    """Each task reads a share of the file."""
    (tmp_path / "p.json").write_text(json.dumps([{"id": str(i), "title": "t" * 100} for i in range(2000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "97")
    try:
        read = store.read_json(spark, str(tmp_path / "p.json"))
        sizes = read.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(sizes) == 2000 and max(sizes) < 600


BAD = ['[{"id": "a"}', '[{"id": "a"}, {"id": "b"', '[{"id": "a"} {"id": "b"}]', '[{"id": "a"},]', '[,{"id": "a"}]', '[{"id": "a"}, 3]', '[null, {"id": "a"}]', '{"id": "a"}', '[{"id": "a}]', '[{"id" "a"}]', '[{"id": "a"}]]', '[{"id": "a"}] x', "[{", "x", "3"]


@pytest.mark.parametrize("text", BAD)
def test_malformed_files_raise(spark, tmp_path, text):
    (tmp_path / "p.json").write_text(text)
    with pytest.raises(Exception):
        store.read_json(spark, str(tmp_path / "p.json")).collect()
