"""Session helpers shared by the operators: checkpoints and column handling."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where driver and executors are one machine."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: the cluster has no known shared folder")
        set_dir = tempfile.mkdtemp(prefix="citeloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints of finished steps.

    It does so once the driver's collector finds that nothing refers to them, which in a
    driver with little to do may come long after the disk is full.
    """
    spark.sparkContext._jvm.System.gc()


#: Folders of all tables that stored() has written in this process and that are still there.
_tables: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back (columnar, compressed)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    if (run := _run.get()) is not None:
        run.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    return list(_tables)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables made by stored() that no result still reads."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _tables.remove(path)


class Scratch:
    """The tables that one run has stored, in order, and whether the last one outlives it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.kept = spark, [], False

    def forget_before_last(self) -> None:
        """Delete what the newest table was made from."""
        forget(self.spark, self.paths[:-1])
        self.paths = self.paths[-1:]

    def keep_last(self) -> None:
        self.kept = True


_run: ContextVar[Scratch | None] = ContextVar("_run", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Delete the tables stored inside at the end, but for the last one if it is to be kept; those of other runs stay.

    Which run stores a table is known by the caller's context, so runs in several threads
    don't meet. A kept table belongs to the run around this one, if there is one.
    """
    made = Scratch(spark)
    token = _run.set(made)
    try:
        yield made
    finally:
        _run.reset(token)
        kept = made.paths[-1:] if made.kept else []
        forget(spark, [p for p in made.paths if p not in kept])
        if (around := _run.get()) is not None:
            around.paths += kept


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is a scan of files with nothing but projections and filters on it, so that each row is one of a file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def keyed(df: DataFrame, name: str) -> DataFrame:
    """df with a 64-bit key of each row that is the same however often and on however many machines the rows are read.

    Rows of Parquet files are known by file and place (hashed: among 10^10 rows about three
    pairs share a key); any other table is written once with numbered rows.
    """
    if _plain_scan(df):
        with contextlib.suppress(AnalysisException):  # another format
            return df.withColumn(name, F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores when the scan has fewer partitions (one row group files)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def held_out(doc_id: str = "doc_id"):
    """True for the rows that labels are never learnt from (crc32 of the id's text mod 4 is 2)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
