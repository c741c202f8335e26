"""JSON arrays of any size, cut into their elements by many tasks.

Spark splits a file behind any closing brace. Whether a split begins inside a text, and how
deep, follows from the quotes and brackets of the splits before: a first pass counts them, a
second cuts. What stands before a split's first element's end is joined with what the splits
before left over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN, _CLOSE = "{[", "]"  # closing braces part the rows


class Begin(NamedTuple):
    """How a split begins: inside a text or not, in how many brackets, and how many elements end before it."""

    inside: bool = False
    depth: int = 0
    place: int = 0


def _scanned(text: str) -> tuple[bool, int, int]:
    """Whether a row ends in the other state than it begins in, and the brackets it opens if it begins outside a text, or inside."""
    parts = (re.sub(r"(?s)\\.", "", text) if "\\" in text else text).split('"')
    opened = lambda some: sum(sum(map(x.count, _OPEN)) - sum(map(x.count, _CLOSE)) for x in some)
    return len(parts) % 2 == 0, opened(parts[::2]), opened(parts[1::2])


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The rows of each split, by its file and first byte."""
    rows = (x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(3))))
    for at, some in groupby(rows, lambda x: x[:2]):
        yield at, (x[2] for x in some)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split and state that it may begin in: the state it ends in, its depth, and how many braces close at each depth."""
    for (file, start), rows in _splits(batches):
        inside, depth, closed = [False, True], [0, 0], [Counter(), Counter()]
        for text in rows:
            turned, *opened = _scanned(text)
            for i in (0, 1):
                depth[i] += opened[inside[i]]
                inside[i] ^= turned
                if not inside[i]:
                    depth[i] -= 1
                    closed[i][depth[i]] += 1
        both = [{"began": bool(i), "inside": bool(inside[i]), "depth": depth[i], "depths": list(closed[i]), "times": list(closed[i].values())} for i in (0, 1)]
        yield pa.RecordBatch.from_pylist([{"file": file, "start": start, **x} for x in both], _COUNTED)


_COUNTED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("began", pa.bool_()), ("inside", pa.bool_()), ("depth", pa.int64()), ("depths", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def _begins(counts: DataFrame) -> dict[tuple[str, int], Begin]:
    """How each split begins; two small rows per split are read. A file that ends elsewhere than behind its array raises."""
    told = {(r["file"], r["start"], r["began"]): r for r in counts.collect()}
    out, now = {}, Begin()
    for file, starts in groupby(sorted({k[:2] for k in told}), lambda x: x[0]):
        now = Begin(place=now.place)
        for at in starts:
            out[at], r = now, told[(*at, now.inside)]
            now = Begin(r["inside"], now.depth + r["depth"], now.place + dict(zip(r["depths"], r["times"])).get(1 - now.depth, 0))
        if now.inside or now.depth != -1:  # the row behind the last brace, which ends without one
            raise ValueError(f"{file} is no JSON array")
    return out


#: Characters of elements that a task hands on at once.
HELD = 1 << 22
_CUT = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()), ("element", pa.string())])


def _cutter(begins: dict[tuple[str, int], Begin]):
    """Cuts splits into elements, each with what stands before it: whole ones, and what the split's ends hold of others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for (file, start), rows in _splits(batches):
            inside, depth, place = begins[file, start]
            pieces, whole = [], start == 0
            for text in rows:
                turned, *opened = _scanned(text)
                pieces += text, "}"
                depth += opened[inside]
                inside ^= turned
                depth -= not inside
                if depth == 1 and not inside:
                    made.append({"file": file, "pos": place, "start": start, "whole": whole, "element": "".join(pieces)})
                    held += len(made[-1]["element"])
                    pieces, whole, place = [], True, place + 1
                    if held > HELD:
                        yield pa.RecordBatch.from_pylist(made, _CUT)
                        made, held = [], 0
            made.append({"file": file, "pos": place, "start": start, "whole": False, "element": "".join(pieces)})
        yield pa.RecordBatch.from_pylist(made, _CUT)

    return cut


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(pos, element): the objects of a JSON array in a file, as texts. Whatever else stands in the array raises."""
    meta = [F.col(f"_metadata.{x}") for x in ("file_path", "file_block_start")]
    rows = spark.read.option("lineSep", "}").text(path).select(*meta, "value")
    counts = rows.mapInArrow(_counted, "file string, start long, began boolean, inside boolean, depth long, depths array<long>, times array<long>")
    pieces = rows.mapInArrow(_cutter(_begins(counts)), "file string, pos long, start long, whole boolean, element string")
    joined = pieces.where("not whole").groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("start", "element"))).alias("e"))  # two pieces a split, all others are whole
    every = pieces.where("whole").select("pos", "element").unionByName(joined.select("pos", F.array_join(F.transform("e", lambda x: x["element"]), "").alias("element")))
    begin = F.instr("element", "{")
    before = F.when(begin > 0, F.substring("element", F.lit(1), begin - 1)).otherwise(F.col("element"))
    space = r"[ \t\r\n]*"
    told = every.select("pos", "element", begin.alias("begin"), before.alias("before"))
    told = told.where(~((F.col("begin") == 0) & F.col("before").rlike(rf"^(\ufeff?{space}\[)?{space}\]{space}\}}$")))  # the array's end
    fit = (F.col("begin") > 0) & F.col("before").rlike(rf"^(\ufeff?{space}\[|{space},){space}$")
    return told.select("pos", F.when(fit, F.substring("element", F.col("begin"), F.length("element"))).otherwise(F.raise_error(F.concat(F.lit("no JSON array of objects: "), F.substring("before", 1, 100)))).alias("element"))
