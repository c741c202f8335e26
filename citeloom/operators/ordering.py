"""Row numbers in an order, overall or per group, without one task per group.

A window numbers a group's rows in one task. Here the rows are dealt into ranges of groups and
order together, so that a large group takes many ranges and small groups share one. Counts per
range and group give what stands before a range; inside it rows are numbered as they stand.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.shared import cut

#: Ranges and groups up to which their offsets are broadcast (some MB).
BROADCAST_RANGES = 100_000
#: monotonically_increasing_id holds the partition above so many bits.
PARTITION_BITS = 33


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The rows in ranges of keys and order, sorted, with `_at`: the range and the place in it. Computed and kept once."""
    by = [*keys, *order]
    return cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "rn", keys: Sequence[str] = ()) -> DataFrame:
    """rows with their number, from 1, in an order that has no ties; per group where keys are given.

    Rows of equal keys and order are numbered in some order, which stays. Null keys are a group.
    Rows go through one range shuffle and the checkpoint folder, so give narrow ones and join
    the rest; the offsets are a row per range, and per group beyond the first in a range.
    """
    held = in_ranges(rows, keys, order)
    part = F.shiftright("_at", PARTITION_BITS)
    counts = held.groupBy(*keys, part.alias("_range")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_{i}" for i in range(len(keys))]
    offsets = cut(counts.select("_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), *(F.col(k).alias(n) for k, n in zip(keys, names))))
    found = offsets if offsets.count() > BROADCAST_RANGES else F.broadcast(offsets)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)), part == F.col("_range"))
    return held.join(found, same).withColumn(name, F.col("_at") + F.col("_shift") + 1).drop("_at", "_range", "_shift", *names)
