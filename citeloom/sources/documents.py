"""A paper-shaped view of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.schema import FIELDS, spread


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    cut = F.instr("text", "\n")
    doi = F.concat(F.lit("10.1101/"), F.md5(F.col("text").cast("binary")))
    year = F.when(F.col("doc_id") % 29 != 0, (2010 + F.col("doc_id") % 17).cast("int"))
    two = lambda n: F.lpad((1 + F.col("doc_id") % n).cast("string"), 2, "0")
    form = F.col("doc_id") % 3
    out = d.select(
        F.col("doc_id").alias("pos"),
        F.when(form == 0, doi).when(form == 1, F.concat(F.lit("https://doi.org/"), F.upper(doi))).otherwise(F.concat(F.lit("  "), doi, F.lit(" "))).alias("id"),
        F.when(cut > 0, F.substring("text", F.lit(1), cut - 1)).otherwise(F.col("text")).alias("title"),
        F.when(cut > 0, F.substring("text", cut + 1, F.length("text"))).otherwise("").alias("abstract"),
        F.concat(F.lit("J "), "lang").alias("journal"),
        year.alias("year"),
        F.coalesce(F.concat_ws("-", F.nullif(F.coalesce(year.cast("string"), F.lit("")), F.lit("")), F.when(year.isNotNull(), two(12)), F.when(year.isNotNull(), two(28))), F.lit("")).alias("date"),
        doi.alias("doi"),
        F.concat(F.lit("https://doi.org/"), doi).alias("url"),
        "source",
    )
    tokens = F.filter(F.split("title", " "), lambda x: x != "")
    out = out.withColumns({"authors": F.slice(tokens, F.lit(1), (F.col("pos") % 5).cast("int")), "categories": F.array().cast("array<string>"), "fetched_at": F.lit(None).cast("string")})
    return out.select(*FIELDS)
