"""Corpus preparation: toxic documents go, one of each group of near-duplicates stays,
contaminated documents go, secrets are redacted, and sources are mixed to their weights.

Rows are decided on one by one: columns are carried through the operator, or rows are known by
a key of their place in the stage's input. So rows without a doc_id, and rows that share one,
are kept, dropped and redacted each for its own text. Null and empty texts are never toxic,
similar, contaminated or secret; they stay until the mix, which takes no words of them. Empty
tables give empty results. Columns beyond those of documents are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.decontam import contamination
from citeloom.llm.mixing import first_words, mix
from citeloom.llm.neardup import near_duplicates
from citeloom.llm.runtime import keyed, scratch, stored
from citeloom.llm.secretscan import scan_secrets
from citeloom.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = ("text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs whose whole text the network does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, carry=REST).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows that links of similar texts join: that of the smallest doc_id."""
    rows = keyed(docs.select(*COLUMNS), "row")
    gone = near_duplicates(rows, k=5, num=80, den=100, key="row").where("not kept").select("row")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that are not contaminated by the benchmark's items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs.select(*COLUMNS), "row")
    found = contamination(rows.select(F.col("row").alias("doc_id"), "text"), benchmark, proximity=False)
    gone = found.where("contaminated").select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, each text without the secrets of any of its layers; n_chars follows a changed text."""
    found = scan_secrets(docs, carry=REST)
    changed = (F.col("spans") != "") | F.col("cut")
    n_chars = F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with the text it takes.

    A document taken in part is cut after its last word taken. Where `taken` exceeds `size`,
    the document is served once more, up to taken - size words from its start.
    """
    rows = keyed(docs.select(*COLUMNS), "row")
    taken = mix(rows).where("taken > 0").select(F.col("tag").alias("row"), "size", "source_size", "target", "taken", "finish1", "finish2")
    text = F.when(F.col("taken") < F.col("size"), first_words(F.col("text"), F.col("taken"))).otherwise(F.col("text"))
    return rows.join(taken, "row").select("doc_id", text.alias("text"), "lang", "source", "size", "source_size", "target", "taken", "finish1", "finish2")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

#: Two stages are models or nested decoding, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    with scratch(spark) as made:  # of this run alone: what a stage has read and made on its way goes
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), "stage")
            made.forget_before_last()
        made.keep_last()
    return STAGES[-1][1](spark, docs, sf_dir)
