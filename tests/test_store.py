"""The store's parts, manifests and pointer."""

import random

import pytest
from test_literature import frame, paper

from citeloom.functions import text as t
from citeloom.operators import papers as pp
from citeloom.sources import store


def files(path):
    return {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in path.rglob("*.parquet")}


def rows(df):
    return sorted(map(str, df.collect()))


def some(spark, rng, n, start=0):
    return frame(spark, *(paper(start + i, f"{rng.choice(['', ' ', 'HTTPS://doi.org/'])}K{rng.randint(0, 400)}" if rng.random() > 0.05 else " ", f"t{start + i}") for i in range(n)))


def test_updates_equal_merges(spark, tmp_path):
    """Three updates with known, repeated and empty ids leave what merging leaves, in the same order."""
    rng, path = random.Random(2), str(tmp_path)
    whole = frame(spark)
    for n in (300, 120, 200):
        new = some(spark, rng, n)
        store.add_papers(spark, path, new)
        want, added = pp.merge(whole, new)
        assert rows(store.read_snapshot(spark, path).select("id", "title")) == rows(want.select("id", "title"))
        assert rows(store.read_added(spark, path).select("id", "title")) == rows(added.select("id", "title"))
        assert [r["title"] for r in store.read_snapshot(spark, path).orderBy("pos").collect()] == [r["title"] for r in want.orderBy("pos").collect()]
        whole = spark.createDataFrame(want.collect(), want.schema)
    made = store.manifest(spark, path)
    assert len(made.parts) == 3 and made.rows == whole.count() and made.top == store.read_snapshot(spark, path).agg({"pos": "max"}).first()[0] + 1


def test_a_small_update_writes_little(spark, tmp_path):
    path = str(tmp_path)
    store.write_snapshot(frame(spark, *(paper(i, f"K{i}") for i in range(2000))), path, buckets=16)
    before = files(tmp_path)
    assert len(before) == 16
    store.add_papers(spark, path, frame(spark, *(paper(i, f"K{i + 1985}") for i in range(20))))
    after = files(tmp_path)
    assert before.items() <= after.items() and sum(len(b) for _, b in after.values()) < 1.3 * sum(len(b) for _, b in before.values())
    assert store.manifest(spark, path).rows == 2005 == store.read_snapshot(spark, path).count()


def test_a_large_update_of_a_small_store_is_many_tasks(spark, tmp_path, monkeypatch):
    """The one bucket of a store that began small is written by tasks of a slice or a few each."""
    monkeypatch.setattr(store, "SLICE_ROWS", 100)
    path = str(tmp_path)
    store.add_papers(spark, path, frame(spark, paper(0, "K0")))
    store.add_papers(spark, path, frame(spark, *(paper(i, f"K{i}") for i in range(2000))))
    made = store.manifest(spark, path)
    sizes = [spark.read.parquet(str(p)).count() for p in (tmp_path / made.added).rglob("*.parquet")]
    assert made.buckets == 1 and sum(sizes) == 1999 and max(sizes) < 700
    assert sorted(r["id"] for r in store.read_snapshot(spark, path).collect()) == sorted(f"K{i}" for i in range(2000))


@pytest.mark.parametrize("most", [0, 1000])
def test_only_touched_buckets_are_read(spark, tmp_path, monkeypatch, most):
    """Files of other buckets may be gone without an update noticing."""
    monkeypatch.setattr(store, "BROADCAST_KEYS", most)
    path = str(tmp_path)
    store.write_snapshot(frame(spark, *(paper(i, f"K{i}") for i in range(200))), path, buckets=32)
    new = frame(spark, paper(0, "k7"), paper(1, "N"))
    base = store.manifest(spark, path)
    touched = {r["bucket"] for r in store._keyed(new, 32).collect()}
    for p in tmp_path.rglob("*.parquet"):
        if int(p.parent.name.removeprefix("bucket=")) not in touched:
            p.write_bytes(b"")
    assert [r["id"] for r in store.unseen(spark, path, new, base).collect()] == ["N"]


def test_readers_see_old_or_new(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    store.add_papers(spark, path, frame(spark, paper(0, "A")))
    reader = store.read_snapshot(spark, path)
    with monkeypatch.context() as m:
        m.setattr(store, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            store.add_papers(spark, path, frame(spark, paper(0, "B")))
    assert rows(store.read_snapshot(spark, path)) == rows(reader)
    store.add_papers(spark, path, frame(spark, paper(0, "B")))
    assert reader.count() == 1 and store.read_snapshot(spark, path).count() == 2


def test_old_parts_go_when_no_snapshot_names_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 3)
    path = str(tmp_path)
    for i in range(7):
        store.add_papers(spark, path, frame(spark, paper(0, f"K{i}")), keep=2)
    assert [r["id"] for r in store.read_snapshot(spark, path).orderBy("pos").collect()] == [f"K{i}" for i in range(7)]
    assert [r["id"] for r in store.read_added(spark, path).collect()] == ["K6"]
    assert len(store.manifest(spark, path).parts) <= 3 and len(list(tmp_path.glob("snapshot-*.json"))) == 2
    told = [store.manifest(spark, path, x.stem) for x in tmp_path.glob("snapshot-*.json")]
    assert {f"rows/{p.name}" for p in (tmp_path / "rows").iterdir() if p.is_dir()} == {p for m in told for p in (*m.parts, m.added)}


def test_empty(spark, tmp_path):
    path = str(tmp_path)
    assert store.read_snapshot(spark, path).isEmpty() and store.read_added(spark, path).isEmpty()
    store.add_papers(spark, path, frame(spark, paper(0, " ")))
    assert store.read_snapshot(spark, path).isEmpty() and store.manifest(spark, path).rows == 0
    store.add_papers(spark, path, frame(spark, paper(3, "x", None)))
    assert store.read_snapshot(spark, path).select(t.merge_key("id").alias("k"), "pos").collect() == [("x", 3)]
