"""Connected components of a links table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.runtime import cut, release

#: Links a task takes (about 1 MB); a table of few links is not dealt over all shuffle partitions.
TASK_LINKS = 1 << 16


def _stars(edges: DataFrame, upward: bool) -> DataFrame:
    """Link the larger (upward) or the smaller neighbours of each node to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if upward:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u").select("u", "v", "m")
    if upward:
        out = linked.where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        out = linked.select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); component is its smallest reachable node.

    Null ends and self links are dropped. Each round is checkpointed; only a count and a
    checksum of the links reach the driver. Tasks grow in number with the links.
    """
    edges = cut(links.where("a <> b").select("a", "b").distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        tasks = 1 + now[0] // TASK_LINKS
        edges = edges.coalesce(tasks)
        if seen == tuple(now):
            break
        seen = tuple(now)
        edges = cut(_stars(_stars(edges, True), False).coalesce(tasks))
        release(edges.sparkSession)
    members = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()).coalesce(tasks)


def stars(found: DataFrame) -> DataFrame:
    """Links (a, b) of what components() found, each member with its component: no chains are left to shorten."""
    return found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
