"""The first record of each key in a stream whose batches come in any order.

Spark's own deduplication keeps whichever record of a key came first. Here the state holds the
least place (pos) that a key has had, a number per key, and a record goes on when it stands
before that. So what has gone on after any number of batches, the least place of each key
counting, is what first_by_key finds in all of them together.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from citeloom.functions import text as t
from citeloom.operators import papers as pp

#: What a session needs: RocksDB's state store, as states have a time to live, and no batches without data, which would never end a run over what is there.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
DAY_MS = 86_400_000


class Least(StatefulProcessor):
    """Lets a key's record pass when its place is less than any before; forgets a key that had none so for some time."""

    def __init__(self, forget_ms: int) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "pos long", self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: r["pos"])  # one after the other, none is held
        before = self.place.get() if self.place.exists() else None
        if before is None or first["pos"] < before[0]:
            self.place.update((first["pos"],))
            yield first

    def close(self) -> None:
        pass


def first_stream(new: DataFrame, forget_ms: int = 30 * DAY_MS) -> DataFrame:
    """The papers of a stream that stand before all others of their key so far, in update mode.

    Papers without an id or a place are dropped. A key is forgotten when no record has taken
    its first place for `forget_ms` of processing time; a later one then passes again. The
    session must have SETTINGS.
    """
    keyed = new.withColumn("_key", t.merge_key("id")).where((F.col("_key") != "") & F.col("pos").isNotNull())
    out = keyed.groupBy("_key").transformWithState(Least(forget_ms), keyed.schema, "Update", "ProcessingTime")
    return out.drop("_key")


def settled(changes: DataFrame) -> DataFrame:
    """The papers that hold, of all that a first_stream has let pass."""
    return pp.first_by_key(changes, t.merge_key("id")).drop("_key")
