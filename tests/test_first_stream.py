"""First records of a stream against those of the batch."""

import random
import time

import pytest
from test_literature import frame, paper

from citeloom.functions import text as t
from citeloom.operators import papers as pp
from citeloom.schema import PAPER
from citeloom.streaming import first


@pytest.fixture
def rocks(spark):
    was = {k: spark.conf.get(k) for k in first.SETTINGS}
    for k, v in first.SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.fixture
def stream(spark, tmp_path, rocks):
    """Adds batches to a folder and runs the stream over what is new there; all that has passed so far."""

    def run(*batches, **options):
        for rows in batches:
            frame(spark, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(0.02)
        new = spark.readStream.schema(PAPER).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        write = first.first_stream(new, **options).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        write = write.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        assert write.awaitTermination(120), write.stop()
        return spark.read.schema(PAPER).parquet(str(tmp_path / "out"))

    return run


def test_any_order_and_a_restart_give_the_batch_result(spark, stream):
    rng = random.Random(4)
    rows = [paper(i, rng.choice(["", " ", "A", "b ", "B", "https://doi.org/c", "d"]) + str(rng.randint(0, 3)) if rng.random() > 0.1 else "", f"t{i}", None, rng.choice([None, 2020]), authors=["x", None]) for i in range(60)]
    rng.shuffle(rows)
    batches = [rows[i : i + 12] for i in range(0, 60, 12)]
    stream(*batches[:2])
    changes = stream(*batches[2:])
    want = pp.first_by_key(frame(spark, *rows), t.merge_key("id")).drop("_key")
    assert sorted(map(str, first.settled(changes).collect())) == sorted(map(str, want.collect()))
    assert changes.count() < len([r for r in rows if r[1].strip()])  # what changes nothing stays behind


def test_keys_are_forgotten(stream):
    assert [r["pos"] for r in stream([paper(5, "a")], forget_ms=1).collect()] == [5]
    time.sleep(0.1)
    assert sorted(r["pos"] for r in stream([paper(9, "A")], forget_ms=1).collect()) == [5, 9]
