"""A stream of new papers added to the store, batch by batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom.functions import text as t
from citeloom.functions.taxonomy import Taxonomy
from citeloom.operators import papers as pp
from citeloom.sources import store


def merge_stream(new: DataFrame, path: str, taxonomy: Taxonomy, checkpoint: str, delta: str | None = None) -> StreamingQuery:
    """Run every available batch through categorisation and merge; a batch's added papers go to delta/batch=N.

    A batch that is repeated after a failure starts again from the snapshot before it, so that
    snapshot and delta come out as they would have.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def step(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, f"{stream}-{number}"
        now = store.pointer(spark, path)
        base = now.before if now.batch == mark else now.name

        def keep(name: str) -> None:
            if delta:
                store.read_added(spark, path, name).write.mode("overwrite").parquet(f"{delta}/batch={number}")

        store.add_papers(spark, path, batch, lambda rows: pp.categorize(rows, taxonomy), mark, base, finish=keep)

    return new.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(new: DataFrame, event_time: str, delay: str = "7 days") -> DataFrame:
    """The first paper of each key as a stream, keys being forgotten after `delay`."""
    return new.withColumn("_key", t.merge_key("id")).where(F.col("_key") != "").withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
