"""Search of substrings by an index of character trigrams.

A term stands in a text only if all its trigrams do. Postings say in which texts a trigram
stands; those of a term's rarest trigrams give the texts that may hold it, `contains` on the
text itself decides. A text that may hold few of a query's terms is looked at only if not
enough others hold more, so a query's work follows its rare terms.

An index is a list of folders, one for each batch of papers added, each with three tables:
texts (chunk, pos, text), a folder per chunk of places; postings (gram, chunk, n, places), in
the order of grams, a row for each chunk, so that a gram of all texts is no row of all places;
and counts (gram, n).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.operators.search import _hits, searched_text
from citeloom.schema import spread
from citeloom.shared import cut

#: Places to a chunk: what a row of postings holds at most, and a task reads of texts at least.
CHUNK = 1 << 14
#: Trigrams of a term that are looked up.
RAREST = 2
_GRAM = 3


def grams(text: str) -> list[str]:
    """The different trigrams of a text, and its last two characters and last one, which shorter terms are sought by."""
    return list({text[i : i + _GRAM] for i in range(len(text))})


def _with_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pos, grams) of texts (chunk, pos, text), a few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(map(grams, some.column(2).to_pylist()), pa.list_(pa.string()))], ["chunk", "pos", "grams"])


def build(papers: DataFrame, folder: str, chunk: int = CHUNK) -> str:
    """Index papers into a new folder; the folder. Places (pos) must be in no other folder of the index."""
    spark = papers.sparkSession
    rows = spread(papers).select(F.expr(f"pos div {chunk}").alias("chunk"), "pos", searched_text().alias("text"))
    rows.repartition("chunk").sortWithinPartitions("chunk", "pos").write.partitionBy("chunk").parquet(f"{folder}/texts")
    texts = spark.read.schema("pos long, text string, chunk long").parquet(f"{folder}/texts")
    each = texts.select("chunk", "pos", "text").mapInArrow(_with_grams, "chunk long, pos long, grams array<string>").select("chunk", "pos", F.explode_outer("grams").alias("gram")).where("gram is not null")
    lists = each.groupBy("gram", "chunk").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    lists.select("gram", "chunk", F.size("places").alias("n"), "places").repartitionByRange("gram", "chunk").sortWithinPartitions("gram", "chunk").write.parquet(f"{folder}/postings")
    counts = spark.read.parquet(f"{folder}/postings").groupBy("gram").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/counts")
    return folder


class Index:
    """The folders of an index, read together."""

    def __init__(self, spark: SparkSession, folders: list[str]) -> None:
        self.spark, self.folders = spark, folders

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.folders:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{f}/{name}") for f in self.folders]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        return union

    def texts(self) -> DataFrame:
        return self._table("texts", "pos long, text string, chunk long")

    def postings(self) -> DataFrame:
        return self._table("postings", "gram string, chunk long, n int, places array<long>")

    def counts(self) -> DataFrame:
        return self._table("counts", "gram string, n long")

    def rarest(self, terms: list[str]) -> dict[str, list[str]]:
        """The rarest trigrams of each term of three characters and more; none of one that no text can hold."""
        of = {w: {w[i : i + _GRAM] for i in range(len(w) - _GRAM + 1)} for w in set(terms) if len(w) >= _GRAM}
        wanted = sorted(set().union(*of.values()))
        found = {r["gram"]: r["n"] for r in self.counts().where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n")).collect()} if wanted else {}
        return {w: sorted(g, key=lambda x: (found[x], x))[:RAREST] if g <= found.keys() else [] for w, g in of.items()}

    def candidates(self, terms: list[str]) -> DataFrame:
        """(chunk, pos, bound): the texts that may hold terms, and how many at most, a repeated term counting each time."""
        chosen = self.rarest(terms)
        out = self.spark.createDataFrame([], "chunk long, pos long, times int")
        for term in sorted(set(terms)):
            if term in chosen and not chosen[term]:
                continue
            rows = self.postings().where(F.col("gram").isin(chosen[term]) if term in chosen else F.col("gram").startswith(term))
            places = rows.select("chunk", "gram", F.explode("places").alias("pos")).groupBy("chunk", "pos").agg(F.count("*").alias("k"))
            need = len(chosen[term]) if term in chosen else 1
            out = out.unionByName(places.where(F.col("k") >= need).select("chunk", "pos", F.lit(terms.count(term)).alias("times")))
        return out.groupBy("chunk", "pos").agg(F.sum("times").alias("bound"))

    def best(self, query: str, limit: int) -> list[tuple[int, int]]:
        """The (pos, score) of the texts that hold most of a query's terms, at most `limit`, ties to the smaller pos.

        Texts are read in falling order of their bounds, those of one bound in one job, until no
        text left can come in; of each job `limit` rows reach the driver.
        """
        terms = t.terms_of(query)
        if not terms or not self.folders or limit < 1:
            return []
        found = cut(self.candidates(terms))
        levels = {r["bound"]: r["chunks"] for r in found.groupBy("bound").agg(F.collect_set("chunk").alias("chunks")).collect()}
        best: list[tuple[int, int]] = []
        for bound in sorted(levels, reverse=True):
            if len(best) == limit and best[-1][1] > bound:
                break
            some = self.texts().where(F.col("chunk").isin(levels[bound]))  # folders by name: others aren't read
            scored = some.join(found.where(F.col("bound") == bound), ["chunk", "pos"], "left_semi").select("pos", _hits(F.col("text"), terms).alias("score"))
            rows = scored.where("score > 0").orderBy(F.desc("score"), "pos").limit(limit).collect()
            best = sorted([*best, *((r["pos"], r["score"]) for r in rows)], key=lambda x: (-x[1], x[0]))[:limit]
        return best


def search(papers: DataFrame, index: Index, query: str, limit: int = 20) -> DataFrame:
    """What search.search finds in papers, by an index of just these papers: each with its score, best first."""
    found = index.best(query, limit)
    scores = F.broadcast(papers.sparkSession.createDataFrame(found, "pos long, score int"))  # `limit` rows at most
    return papers.where(F.col("pos").isin([p for p, _ in found])).join(scores, "pos").select(*papers.columns, "score").orderBy(F.desc("score"), "pos")
