"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, once per epoch. Documents are
served in packets of up to PACKET words. A packet's virtual finish time is its queue's
cumulative words divided by the queue's target. The packets of all queues are range-sorted
by finish time, and the sorted queue is cut where its running total reaches the budget: no
source is cut on its own, so each comes within a packet or so of its target.

Words are counted once, and all else runs on sizes alone. Running sums are spread over
buckets of the shuffle and ranges of virtual time, so that no task holds a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.runtime import stored

BETWEEN = r"[\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
EPOCHS = 2
#: Words of a document that are served at once.
PACKET = 64
#: Ranges of virtual time that packets are sorted in, up to time 1 and beyond it.
BINS = 1 << 13
#: Sources whose targets are broadcast; those of more are joined with each source's rows dealt over SALTS parts.
BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, BETWEEN), "")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    """(key, source_size, target) per source: weighted shares of the budget, none above EPOCHS times its size.

    The level at which the uncapped sources share is found in one pass: in order of
    capacity per weight, the first source whose fair level does not exceed its capacity.
    """
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNotNull().desc(), "source")
    ranked = sources.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("double") for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumns({"cap": (F.col("source_size") * EPOCHS).cast("double"), "n": F.row_number().over(order)})
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = Window.orderBy("ratio", "n")
    budget = F.sum(F.col("source_size")).over(Window.partitionBy()).cast("double") * F.lit(share)
    level = ranked.withColumn("level", (budget - F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    level = level.withColumn("fair", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return level.select("key", "source_size", F.coalesce(F.least("cap", F.col("fair") * F.col("weight")), "cap").alias("target"))


def with_targets(rows: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """rows (row, key) with the target of their source; a source of any share of the rows is no single task's."""
    if few:
        return rows.join(F.broadcast(targets), "key")
    dealt = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(dealt, ["key", "salt"]).drop("salt")


def queue(sized: DataFrame) -> DataFrame:
    """(row, key, size, epoch, begin): every document once per epoch, begin being its source's words before it.

    The order in a source is a shuffle by the epoch and the document's name, so reruns agree.
    """
    mark = F.md5(F.concat(F.col("epoch").cast("string"), F.lit(":"), F.col("name")).cast("binary"))
    entries = sized.withColumn("epoch", F.explode(F.array(*(F.lit(e) for e in range(1, EPOCHS + 1))))).withColumn("mark", mark)
    entries = entries.select("row", "key", "size", "epoch", "mark", F.substring("mark", 1, 3).alias("bucket"))
    sums = entries.groupBy("key", "epoch", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("key").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("key", "epoch", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = Window.partitionBy("key", "epoch", "bucket").orderBy("mark", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["key", "epoch", "bucket"])
    return placed.select("row", "key", "size", "epoch", (F.col("offset") + F.col("within")).alias("begin"))


def packets(entries: DataFrame) -> DataFrame:
    """(row, key, epoch, words, end, finish): the entries' packets, end being their source's words up to theirs."""
    packet = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / PACKET)))
    parted = entries.where("size > 0").withColumn("packet", packet)
    parted = parted.withColumn("words", F.least(F.lit(PACKET).cast("long"), F.col("size") - F.col("packet") * PACKET))
    parted = parted.withColumn("end", F.col("begin") + F.col("packet") * PACKET + F.col("words"))
    return parted.select("row", "key", "epoch", "words", "end", (F.col("end") / F.col("target")).alias("finish"))


def cut_at_budget(parted: DataFrame, budget: int) -> DataFrame:
    """The packets in the order of virtual finish times, with the words that the budget leaves them: adds took.

    Only the packet that the budget ends in is taken in part. The global order is by ranges of
    virtual time (BINS up to time 1, as many beyond): queues drain at even rates, so ranges
    hold about equal words whatever the sources' sizes. Running totals are those of the ranges
    before, plus those within the range.
    """
    range_ = F.when(F.col("finish") <= 1, F.ceil(F.col("finish") * BINS)).otherwise(BINS + F.ceil(BINS * (1 - 1 / F.col("finish")))).cast("int")
    parted = parted.withColumn("range", range_)
    sums = parted.groupBy("range").agg(F.sum("words").alias("total"))  # at most 2 * BINS rows
    before = F.sum("total").over(Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("range", F.coalesce(before, F.lit(0)).alias("offset"))
    order = Window.partitionBy("range").orderBy("finish", "key", "end").rowsBetween(Window.unboundedPreceding, -1)
    queued = parted.withColumn("within", F.coalesce(F.sum("words").over(order), F.lit(0))).join(F.broadcast(offsets), "range")
    took = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("offset") - F.col("within"))).cast("long")
    return queued.select("row", "epoch", "finish", "words", took.alias("took"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, taken, finish1, finish2, taken1, taken2.

    size counts words (null text: 0). Sources in code point order, null last, get the
    weights in turn. taken are the words of the document in the queue of all sources' packets,
    range-sorted by virtual finish time and cut at the budget (share times all words, whole);
    taken1 and taken2 are those of the two epochs, never above size, and finish1 and finish2
    the finish times of the last packets taken (null where none is). A source's words are its
    target's give or take a packet, and what other sources' last packets leave over. A row
    with a null doc_id shuffles by its text; rows that repeat a doc_id are separate entries; an
    empty table gives an empty result. The order depends on doc_id, size and, without a doc_id,
    text alone, so reruns agree. A column `row` of `docs`, if there is one, is carried to the
    result as it is (`tag`); other columns are not read.
    """
    tag = F.col("row") if "row" in docs.columns else F.lit(None).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), name.alias("name"), tag.alias("tag"), F.monotonically_increasing_id().alias("row"))
    sized = stored(sized.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))), "sizes")
    targets = stored(source_targets(sized, weights, share), "targets")
    sources, words = targets.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    few = sources <= BROADCAST_SOURCES
    entries = with_targets(queue(sized), targets.select("key", "target"), few)
    taken = cut_at_budget(packets(entries), math.floor(words * share)).where("took > 0")
    of = lambda e, c: F.when(F.col("epoch") == e, F.col(c))
    per_row = taken.groupBy("row").agg(*(F.sum(of(e, "took")).alias(f"taken{e}") for e in (1, 2)), *(F.max(of(e, "finish")).alias(f"finish{e}") for e in (1, 2)))
    out = with_targets(sized, targets, few).join(per_row, "row", "left").na.fill(0, ["taken1", "taken2"])
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("taken1") + F.col("taken2")).alias("taken"), "finish1", "finish2", "taken1", "taken2", "tag")


def emission(mixed: DataFrame) -> DataFrame:
    """The mix as a training stream: (doc_id, epoch, finish, words), in the order of virtual finish times."""
    entry = F.explode(F.array(*(F.struct(F.lit(e).alias("epoch"), F.col(f"finish{e}").alias("finish"), F.col(f"taken{e}").alias("words")) for e in (1, 2))))
    entries = mixed.select("doc_id", entry.alias("e")).select("doc_id", "e.*").where("words > 0")
    return entries.orderBy("finish", "doc_id", "epoch")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
