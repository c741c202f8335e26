"""The paper collection on disk: snapshots of Parquet parts, JSON arrays, CSV exports.

A snapshot is a manifest, a small file that names its parts; CURRENT points to one. A part is a
folder of papers in hash buckets of their merge key. As records that are known are never
refreshed, an update writes a part of the papers it adds and a manifest of one part more: no
file is written again, and only keys of the buckets that new papers fall into are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeloom.functions import text as t
from citeloom.schema import FIELDS, PAPER
from citeloom.shared import cut
from citeloom.sources import arrays

# The columns of the two CSV forms.
EXPORT_COLUMNS = ["id", "title", "authors", "journal", "year", "date", "doi", "url", "source", "categories"]
WEB_COLUMNS = ["title", "authors", "journal", "year", "date", "doi", "url", "source", "categories", "abstract"]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of papers in a file, which any number of tasks read; pos is the place in the array. A malformed file raises."""
    schema = StructType([f for f in PAPER.fields if f.name != "pos"])
    return arrays.elements(spark, path).select("pos", F.from_json("element", schema, {"mode": "FAILFAST"}).alias("p")).select("pos", "p.*")


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """One text file of the lines in order: sorted and written by all tasks, their files then copied behind each other, a buffer at a time."""
    spark, parts = lines.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    write_folder(lines, parts, *order)
    jvm = spark.sparkContext._jvm
    to, fs = _place(spark, path)
    out = fs.create(to, True)
    for opened in _opened(spark, parts):
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(opened, out, 1 << 16, False)
    out.close()
    remove(spark, parts)


def write_folder(lines: DataFrame, path: str, *order: str | Column) -> None:
    """The lines in order as the files of a folder, sorted and written by all tasks."""
    lines.orderBy(*order).select("line").write.text(path)


def _opened(spark: SparkSession, path: str) -> Iterator:
    """The files of a folder in order, each opened until the next is asked for."""
    folder, fs = _place(spark, path)
    for at in sorted((x.getPath() for x in fs.listStatus(folder)), key=lambda p: p.getName()):
        if at.getName().startswith("part-"):
            opened = fs.open(at)
            try:
                yield opened
            finally:
                opened.close()


def pieces(spark: SparkSession, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """What write_folder wrote, a buffer at a time."""
    for opened in _opened(spark, path):
        while data := bytes(opened.readNBytes(size)):
            yield data


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _place(spark, path)
    fs.delete(at, True)


def json_lines(papers: DataFrame) -> DataFrame:
    """(part, pos, line): a JSON array of papers in pos order."""
    last = F.broadcast(papers.agg(F.max("pos").alias("_last")))  # one row
    value = F.to_json(F.struct(*(c for c in FIELDS if c != "pos")), {"ignoreNullFields": "false"})
    rows = papers.join(last).select(F.lit(1).alias("part"), "pos", F.concat(F.lit("  "), value, F.when(F.col("pos") == F.col("_last"), "").otherwise(",")).alias("line"))
    ends = papers.sparkSession.createDataFrame([(0, None, "["), (2, None, "]")], "part int, pos long, line string")
    return rows.unionByName(ends)


def write_json(papers: DataFrame, path: str) -> None:
    """One JSON array file in pos order (places differ)."""
    write_lines(json_lines(papers), path, "part", "pos")


class Pointer(NamedTuple):
    """What CURRENT says: the snapshot, the one before it, and the stream batch that made it."""

    name: str = ""
    before: str = ""
    batch: str = ""


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through Spark's file systems, so that a shared folder of any kind will do."""
    at, fs = _place(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(data))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _place(spark, path)
    return fs.exists(at)


def get(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if there is none."""
    return spark.read.text(path, wholetext=True).first()[0] if exists(spark, path) else None


def pointer(spark: SparkSession, path: str) -> Pointer:
    told = get(spark, f"{path}/CURRENT")
    return Pointer() if told is None else Pointer(*told.split("\n"))


def _point(spark: SparkSession, path: str, to: Pointer) -> None:
    """Write the pointer beside CURRENT and rename it over that in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside = f"{path}/CURRENT-{uuid.uuid4().hex}"
    put(spark, beside, "\n".join(to).encode())
    new, fs = _place(spark, beside)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(new, _place(spark, f"{path}/CURRENT")[0], over)


class Manifest(NamedTuple):
    """A snapshot: its parts' folders, their number of buckets, the first free place, how many papers there are, what they were classified by, and the folder of those it added."""

    parts: tuple[str, ...] = ()
    buckets: int = 1
    top: int = 0
    rows: int = 0
    mark: str = ""
    added: str = ""


#: Papers to a bucket when a snapshot is written whole, parts that an update may leave, and new keys up to which they are broadcast (some 100 MB).
BUCKET_ROWS, MOST_PARTS, BROADCAST_KEYS = 1 << 18, 64, 1_000_000
#: Papers to a slice of a bucket, which one task writes to one file.
SLICE_ROWS = 1 << 14
_PART = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAPER.fields) + ", key string, part string, bucket int"


def manifest(spark: SparkSession, path: str, name: str | None = None) -> Manifest:
    """What the current snapshot, or a named one, consists of; an empty one if there is none yet."""
    name = pointer(spark, path).name if name is None else name
    if not name:
        return Manifest()
    told = json.loads(get(spark, f"{path}/{name}.json") or "")
    return Manifest(**told | {"parts": tuple(told["parts"])})


def _forget_old(spark: SparkSession, path: str, keep: int, current: Pointer) -> None:
    """Delete the oldest snapshots with what was kept for each, and the parts that only they name."""
    at, fs = _place(spark, path)
    found = sorted((x.getModificationTime(), x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().startswith("snapshot-"))
    names = [name.removesuffix(".json") for _, name in found]
    old = [n for n in names[: max(0, len(names) - keep)] if n not in (current.name, current.before)]
    if old:
        told = {n: manifest(spark, path, n) for n in names}
        held = lambda some: {p for n in some for p in (*told[n].parts, told[n].added) if p}
        gone = held(old) - held(set(names) - set(old))
        for name in [*gone, *(x for n in old for x in (f"{n}.json", f"totals/{n}", f"index/{n}.json"))]:
            fs.delete(_place(spark, f"{path}/{name}")[0], True)


def _keyed(papers: DataFrame, buckets: int) -> DataFrame:
    keyed = papers.select(*FIELDS).withColumn("key", t.merge_key("id"))
    return keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def write_part(keyed: DataFrame, path: str) -> str:
    """Write papers with key and bucket as a part that no snapshot names yet; its folder.

    Buckets are written in slices by key, so that a task's share doesn't grow with the papers, whatever the number of buckets.
    """
    name = f"rows/part=p{uuid.uuid4().hex}"
    held = keyed.groupBy("bucket").count().agg(F.count("*").alias("buckets"), F.max("count").alias("most")).first()
    slices = max(1, -(-(held["most"] or 0) // SLICE_ROWS))
    by = ["bucket", F.pmod(F.xxhash64("key", F.lit("slice")), F.lit(slices))]  # apart from the bucket's own hash
    many = held["buckets"] * slices > int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(held["buckets"] * slices, *by) if many else keyed.repartition(*by)
    dealt.sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{path}/{name}")
    return name


def _read_parts(spark: SparkSession, path: str, parts: tuple[str, ...]) -> DataFrame:
    return spark.read.schema(_PART).option("basePath", f"{path}/rows").parquet(*(f"{path}/{p}" for p in parts)) if parts else spark.createDataFrame([], _PART)


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    return _read_parts(spark, path, (part,)).select(*FIELDS)


def _commit(spark: SparkSession, path: str, made: Manifest, batch: str, before: str | None, keep: int, finish: Callable[[str], None] | None) -> str:
    """Write a manifest, have what belongs to it written, move the pointer, and forget old snapshots."""
    name = f"snapshot-{uuid.uuid4().hex}"
    put(spark, f"{path}/{name}.json", json.dumps(made._asdict()).encode())
    if finish is not None:
        finish(name)
    current = Pointer(name, pointer(spark, path).name if before is None else before, batch)
    _point(spark, path, current)
    _forget_old(spark, path, keep, current)
    return name


def write_snapshot(papers: DataFrame, path: str, batch: str = "", before: str | None = None, keep: int = 5, finish: Callable[[str], None] | None = None, mark: str = "", buckets: int | None = None, added: str = "") -> str:
    """Write papers whole as a new snapshot, then move the pointer to it, so that readers see the old or the new one whole.

    `finish` gets the snapshot's name before the pointer moves and writes what belongs to it: if
    that or the move fails, readers go on with the old snapshot, and the next run does all again.
    The newest `keep` snapshots stay for readers that began before. `before` is the snapshot
    this one was made from, the current one unless a batch is repeated. `mark` says what the
    papers were classified by.
    """
    spark = papers.sparkSession
    buckets = buckets or 1 << max(0, (papers.count() - 1) // BUCKET_ROWS).bit_length()
    part = write_part(_keyed(papers, buckets), path)
    size = _read_parts(spark, path, (part,)).agg(F.count("*").alias("n"), F.max("pos").alias("top")).first()
    made = Manifest((part,), buckets, 0 if size["top"] is None else size["top"] + 1, size["n"], mark, added)
    return _commit(spark, path, made, batch, before, keep, finish)


def unseen(spark: SparkSession, path: str, new: DataFrame, base: Manifest) -> DataFrame:
    """(the papers' fields, key, bucket) of new papers: the first of each key that a snapshot doesn't hold, placed after its papers.

    Of the snapshot only keys are read, and those of the buckets that the new papers fall into.
    Few new keys are broadcast to them; many are joined with them by key.
    """
    first = _keyed(new, base.buckets).where("key <> ''").withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).where("_rank = 1").drop("_rank")
    first = cut(first.withColumn("pos", F.col("pos") + F.lit(base.top)))
    touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]
    known = _read_parts(spark, path, base.parts).where(F.col("bucket").isin(touched)).select("key")
    if first.count() <= BROADCAST_KEYS:
        known = known.join(F.broadcast(first.select("key")), "key", "left_semi")
    return first.join(known, "key", "left_anti").select(*FIELDS, "key", "bucket")


def add_papers(spark: SparkSession, path: str, new: DataFrame, classify: Callable[[DataFrame], DataFrame] = lambda p: p, batch: str = "", before: str | None = None, keep: int = 5, finish: Callable[[str], None] | None = None) -> str:
    """A new snapshot with the unseen ones of new papers, classified; nothing that stands is written again.

    The rest is as in write_snapshot. After MOST_PARTS updates the parts are written as one.
    """
    base = manifest(spark, path, before)
    if not base.parts:
        buckets = 1 << max(0, (new.count() - 1) // BUCKET_ROWS).bit_length()
        base = base._replace(buckets=buckets)
    part = write_part(classify(unseen(spark, path, new, base)), path)
    size = _read_parts(spark, path, (part,)).agg(F.count("*").alias("n"), F.max("pos").alias("top")).first()
    made = base._replace(added=part)
    if size["n"]:
        made = made._replace(parts=(*base.parts, part), top=size["top"] + 1, rows=base.rows + size["n"])
    if len(made.parts) > MOST_PARTS:
        return write_snapshot(_read_parts(spark, path, made.parts), path, batch, before, keep, finish, made.mark, added=part)
    return _commit(spark, path, made, batch, before, keep, finish)


def read_snapshot(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The current snapshot, or a named one; empty if there is none yet. A damaged one raises."""
    return _read_parts(spark, path, manifest(spark, path, name).parts).select(*FIELDS)


def read_added(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The papers that a snapshot added to the one before."""
    folder = manifest(spark, path, name).added
    return read_part(spark, path, folder) if folder else spark.createDataFrame([], PAPER)


def export_rows(papers: DataFrame, columns: list[str] = EXPORT_COLUMNS) -> DataFrame:
    """Flat rows for CSV: lists joined by `; `."""
    flat = papers.withColumns({c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ") for c in ("authors", "categories")})
    return flat.orderBy("pos").select(*columns)


def write_csv(papers: DataFrame, path: str, columns: list[str] = EXPORT_COLUMNS) -> None:
    export_rows(papers, columns).write.mode("overwrite").csv(path, header=True, escape='"', lineSep="\r\n", emptyValue="")


def export(papers: DataFrame, kind: str, path: str) -> None:
    if kind == "json":
        write_json(papers, path)
    elif kind == "csv":
        write_csv(papers, path)
    else:
        raise ValueError(f"unknown format {kind!r}")
