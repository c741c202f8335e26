"""The corpus pipeline's stages on planted cases: rows without an id, rows that share one, tables without rows."""

import collections

import numpy as np
import pytest

import corpus_pipeline as cp

WORDS = [f"w{i}" for i in range(400)]
SECRET = "note password=hunter22 end"
ITEM = " ".join(f"b{i}" for i in range(20))


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a folder of tables and gives its documents as the stages get them."""

    def make(rows, labels=(), items=((1, ITEM),), extra=False):
        frame = spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
        frame = frame.selectExpr("*", "1 AS row", "2 AS key", "3 AS node", "'x' AS spans", "true AS cut", "0 AS taken", "1 AS size", "2 AS tag") if extra else frame
        frame.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)

    return make


def told(frame):
    return collections.Counter((r["doc_id"], r["text"]) for r in frame.collect())


def test_secrets_go_row_by_row(spark, tables):
    docs, path = tables([(1, SECRET), (1, "clean text one"), (None, SECRET), (None, "clean"), (2, None), (3, ""), (4, SECRET), (4, SECRET)], extra=True)
    out = cp.redact_secrets(spark, docs, path)
    gone = SECRET.replace("password=hunter22", "[REDACTED]")
    assert told(out) == collections.Counter({(1, gone): 1, (1, "clean text one"): 1, (None, gone): 1, (None, "clean"): 1, (2, None): 1, (3, ""): 1, (4, gone): 2})
    assert out.columns == cp.COLUMNS and {r["n_chars"] for r in out.where("doc_id = 4").collect()} == {len(gone)}


def test_contaminated_rows_go(spark, tables):
    docs, path = tables([(1, ITEM), (1, "clean text"), (None, f"x {ITEM}"), (None, "clean"), (2, None), (3, ITEM + " pad" * 900)], extra=True)
    assert told(cp.drop_contaminated(spark, docs, path)) == collections.Counter({(1, "clean text"): 1, (None, "clean"): 1, (2, None): 1, (3, ITEM + " pad" * 900): 1})


def test_one_of_each_group_stays(spark, tables):
    a, b, c = (" ".join(WORDS[i : i + 100]) for i in (0, 120, 240))
    near = lambda x: x + " end"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, near(near(a))), (None, c), (None, near(c)), (5, c), (6, None), (7, None), (8, ""), (8, "")]
    docs, path = tables(rows, extra=True)
    out = cp.drop_near_duplicates(spark, docs, path)
    assert told(out) == collections.Counter({(1, a): 1, (1, b): 1, (5, c): 1, (6, None): 1, (7, None): 1, (8, ""): 2})
    assert out.columns == cp.COLUMNS


def test_toxic_rows_go(spark, tables):
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("ba", "de", "li", "mo") for b in ("ra", "sto", "nel", "ki")]

    def prose(toxic):
        words = list(rng.choice(plain, 40))
        if toxic:
            words[int(rng.integers(40))] = "grob" + str(rng.choice(plain))
        return " ".join(words)

    rows = [(i, prose(i % 4 == 0)) for i in range(240)] + [(300, prose(True)), (300, prose(False)), (None, prose(True)), (None, prose(False)), (900, None), (901, "")]
    docs, path = tables(rows, [(i, int(i % 4 == 0)) for i in range(240)], extra=True)
    out = cp.drop_toxic(spark, docs, path)
    left = told(out)
    assert out.columns == cp.COLUMNS and sum("grob" in (t or "") for _, t in left) <= 3
    assert all(left[rows[i]] for i in (-5, -3, -2, -1)) and not left[rows[-6]] and not left[rows[-4]]


def test_mix_gives_the_texts_taken(spark, tables):
    rows = [(i, f"  word{i} \n" + "x y\n" * (i % 5)) for i in range(60)] + [(7, "again this"), (None, "no id here"), (None, None)]
    docs, path = tables(rows, extra=True)
    out = cp.mix_sources(spark, docs, path).collect()
    texts = collections.Counter(rows)
    assert sum(r["taken"] for r in out) == sum(len((t or "").split()) for _, t in rows) * 3 // 2
    for r in out:
        assert len(r["text"].split()) == min(r["taken"], r["size"]) > 0
        assert texts[r["doc_id"], r["text"]] or r["taken"] < r["size"] and any(i == r["doc_id"] and t.lstrip().startswith(r["text"]) for i, t in rows)


def test_empty_tables(spark, tables):
    docs, path = tables([], items=())
    for _, stage in cp.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0 and (stage is cp.mix_sources or out.columns == cp.COLUMNS)


def test_whole(spark, tables):
    text = " ".join(WORDS[:50])
    rows = [(1, f"{text} {SECRET}"), (1, " ".join(WORDS[200:260])), (2, f"{text} {SECRET}"), (None, f"other {SECRET}"), (3, ITEM), (4, None)]
    _, path = tables(rows)
    left = told(cp.run(spark, path))
    assert {i for i, _ in left} <= {1, None} and not any("hunter22" in t for _, t in left)
    assert sum(left.values()) == 3


def test_runs_in_threads_leave_each_other_s_tables(spark, tables):
    """A mix that stands while a pipeline runs beside it can still be read, and so can the pipeline's own."""
    import threading

    from citeloom.llm.mixing import mix
    from citeloom.llm.runtime import scratch, stored

    docs, path = tables([(i, f"text {i} " + " ".join(WORDS[i : i + 40])) for i in range(40)])
    mixed, told = mix(docs), {}
    going, done = threading.Event(), threading.Event()

    def run():
        with scratch(spark) as made:
            step = stored(docs, "a")
            going.set()
            done.wait(60)
            step = stored(step, "b")
            made.forget_before_last()
            made.keep_last()
        told["rows"] = step.count()

    thread = threading.Thread(target=run)
    thread.start()
    going.wait(60)
    other = mix(docs)
    done.set()
    thread.join()
    assert told["rows"] == mixed.count() == other.count() == 40
    out = cp.run(spark, path)
    assert mixed.count() == other.count() == 40 and out.count() > 0
