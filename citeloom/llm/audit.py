"""Filter interaction audit: what each filter removes, repeats and costs in every order of the filters.

A document's failures are a bit mask. Only counts per part and mask enter the audit; these
cells are unpivoted against the steps of all orders, a running bit-or over a cell's earlier
steps tells what was removed before, and conditional sums give the figures of a step.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
#: What a document must have or not exceed.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3  # words, percent of them, percent of code points
JUNK = r"[#$%&*|]"
_SPACE = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _mask(*failures: Column) -> Column:
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): which of the five filters each row of docs fails, whatever the others say.

    Row and text are compared table-wide through a digest: of each text's rows the one with the
    smallest doc_id passes E, as do rows that share that doc_id and rows without one, which no
    id is smaller than. The smallest ids are looked up by doc_id, so the copies of one text
    never meet in one task.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", _SPACE), lambda w: w != ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    length = F.length("text")
    capitals = length - F.length(F.translate("text", _CAPITALS, ""))
    own = _mask(n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * length, F.rlike("text", F.lit(JUNK)))
    rows = rows.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("own") + F.when(again, 16).otherwise(0)).alias("mask"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts of documents, and of those that labels call good and toxic.

    A doc_id with several rows in labels is good or toxic if one of them says so.
    """
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    return failed.join(told, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("is_good").alias("good"), F.count_if("is_toxic").alias("toxic"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of cells (part, mask, n, good, toxic): one row per part, order and step, zeros included.

    Every cell gives a row for each step of each order, so the number of rows is parts x
    masks x orders x steps, whatever the number of documents; with n filters there are n! orders.
    """
    orders = ["".join(p) for p in permutations(filters)]
    steps = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bit = F.element_at(F.create_map(*(x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i)))), F.col("filter"))
    steps = steps.withColumn("bit", bit).withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("hit").over(before), F.lit(0)))
    fails, gone = F.col("hit") != 0, F.col("earlier") != 0
    total = lambda kept, what="n": F.sum(F.when(kept, F.col(what)).otherwise(0))
    figures = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    of_filter = Window.partitionBy("part", "filter")
    return figures.withColumn("shapley", F.sum("removed").over(of_filter)).drop("filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of docs (doc_id, text, lang) against labels (doc_id, quality, toxic).

    Null texts are empty and a null lang is part ''; an empty table has no parts and so no
    rows. Repeated rows count each; further columns are not read.
    """
    return interactions(cells(failures(docs), labels))
