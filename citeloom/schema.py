"""The paper record. `pos` is the record's place in its collection; ties go by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())
PAPER = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("authors", _TEXTS),
        T.StructField("abstract", T.StringType()),
        T.StructField("journal", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("date", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("categories", _TEXTS),
        T.StructField("fetched_at", T.StringType()),
    ]
)
FIELDS = PAPER.fieldNames()
#: Places (pos) that each query's results take when several are joined: bytes of a dump may be counted, so 256 TB of it.
QUERY_PLACES = 1 << 48


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of few, large row groups over all cores before classifying."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
