"""Queries against their SQL, and what the learnt and aligning operators do beyond the common case."""

import time

import numpy as np
import pytest
from compare import oracle, rows

from citeloom.llm import langid, licenses, toxicity
from citeloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    assert rows(out, columns) == oracle(SQL[name], SF, columns)


def test_many_scripts():
    """Languages told apart by letters that are rare among all texts."""
    rng = np.random.default_rng(1)
    alphabets = {f"l{i}": [chr(0x4E00 + 40 * i + j) for j in range(40)] for i in range(20)} | {"la": list("abcdefghij"), "cy": list("абвгдежзик")}

    def prose(lang):
        return " ".join("".join(rng.choice(alphabets[lang], 5)) for _ in range(30))

    langs = [x for x in alphabets for _ in range(12)]
    model = langid.fit([prose(x) for x in langs], langs)
    asked = [x for x in alphabets for _ in range(4)]
    got, score = langid.predict([prose(x) for x in asked], model)
    assert got == asked and (score > 1 / len(alphabets)).all()
    assert langid.predict([None, "", "12 !?", "x"], model)[0][:3] == ["und"] * 3


def test_every_language_is_learnt(docs):
    """More than 200 languages, one of them in long texts alone."""
    rows_ = [(i, f"{chr(0x4E00 + i % 230) * 3} {chr(0x4E00 + i % 230)}", f"l{i % 230:03}") for i in range(1150)] + [(5000 + i, "абв где " * 5000, "long") for i in range(4)]
    got = langid.identify(docs([(i, t, lang) for i, t, lang in rows_])).collect()
    want = {i: lang for i, _, lang in rows_}
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in got) and len(got) == len(rows_)


def test_many_templates_and_matches(docs):
    made = {f"t{i:03}": " ".join(f"w{i}x{j}" for j in range(20)) for i in range(200)}
    text = "É " + " ".join([made["t007"], "between", made["t150"]])
    r = licenses.scan_licenses(docs([(1, text)], extra=True), made).first()
    first = len("É ") + len(made["t007"])
    assert r["licenses"] == f"t007:2:{first},t150:{first + len(' between ')}:{len(text)}"
    line = "Released under the MIT License. "
    began = time.time()
    assert licenses.scan_licenses(docs([(1, line * 20_000)])).first()["n_licenses"] == 20_000
    assert time.time() - began < 40


def test_toxicity_on_labels(spark):
    """Held-out labels of the documents table."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), labels)
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in got.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] >= 0.8 * (counts[1, 1] + counts[1, 0]) and counts[0, 1] <= 0.03 * (counts[0, 0] + counts[0, 1])


def test_the_sample_of_languages_is_bounded(spark, monkeypatch):
    """Copies of one text under one id share a hash; no language has more rows than its bound, and none less than it can."""
    monkeypatch.setattr(langid, "TRAIN_PER_LANG", 50)
    copies = spark.range(4000).selectExpr("1L AS doc_id", "'same text' AS text", "'en' AS lang")
    others = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CASE WHEN id % 2 = 0 THEN 'de' WHEN id % 200 = 1 THEN 'fr' ELSE 'en' END AS lang")
    rows = langid.training_rows(copies.unionByName(others)).groupBy("lang").count().collect()
    got = {r["lang"]: r["count"] for r in rows}
    assert got["en"] == got["de"] == 50 and 0 < got["fr"] <= 15
    first = [r["h"] for r in langid.training_rows(others).where("lang = 'de'").collect()]
    assert max(first) <= sorted(r["h"] for r in others.where("lang = 'de' and crc32(cast(doc_id as string)) % 4 <> 2").selectExpr("xxhash64(text, doc_id) AS h").collect())[49]
