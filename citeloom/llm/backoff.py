"""Stupid-backoff scores from n-gram counts over all documents.

Words and bigrams are 64-bit hashes. Documents are read in chunks. Every chunk sends its
distinct words and bigrams, with their number in it, to the partitions of the count tables,
by hash, and itself in packed form. A partition adds up the numbers of all chunks and answers
each chunk with the totals of what it sent, in the same order. A last step scores the
documents of a chunk with these answers. No table of counts is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import textkit as tk
from citeloom.llm.runtime import spread

ALPHA = 0.4
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 60_000
#: Words of the text for each partition of the count tables.
PART_TOKENS = 2_000_000
_FACTOR = np.uint64(0x2545F4914F6CDD1D | 1)


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, tk.Words]]:
    for row, end, raw, at in tk.chunks(batch.column(column), CHUNK_BYTES):
        for low in range(row, end, CHUNK_ROWS):
            high = min(end, low + CHUNK_ROWS)
            part = at[low - row : high - row + 1]
            yield batch.slice(low, high - low), tk.words(raw[part[0] : part[-1]], part - part[0])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n): the words of each batch."""
    for batch in batches:
        n = sum(len(w.hashes) for _, w in _chunks(batch, 0))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


def bigrams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all bigrams within documents, in order, and the places of their second words."""
    opens = np.zeros(len(words) + 1, bool)
    opens[first] = True
    second = np.flatnonzero(~opens[:-1])
    return tk.mix(words[second - 1] * _FACTOR + words[second]), second


def _pack(x: np.ndarray) -> bytes:
    """Numbers of one width, compressed by byte planes."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return np.int64(len(x)).tobytes() + (pa.Codec("zstd").compress(planes.tobytes(), asbytes=True) if len(x) else b"")


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    n, width = int(np.frombuffer(blob, np.int64, 1)[0]), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


_ROW = "part long, chunk long, kind int, a binary, b binary"
_SCHEMA = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_META, _WORDS, _BIGRAMS = range(3)


def _send(parts: int):
    """Documents -> packed rows: every chunk's texts as numbers of its distinct words, and its words and bigrams by partition."""
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for head, w in _chunks(batch, 1):
                chunk = (TaskContext.get().partitionId() << 32) + number
                number += 1
                words, local, count = np.unique(w.hashes, return_inverse=True, return_counts=True)
                ids = head.column(0).fill_null(0).to_numpy().astype(np.int64)
                held = np.asarray(head.column(0).is_valid()).astype(np.int64)
                rows = [(parts + chunk % parts, chunk, _META, _pack(np.concatenate([ids, held, np.diff(w.first)])), _pack(local.astype(np.uint32)))]
                pairs = np.unique(bigrams(w.hashes, w.first)[0], return_counts=True)
                for kind, (keys, n) in ((_WORDS, (words, count)), (_BIGRAMS, pairs)):
                    part, n = (keys >> shift).astype(np.int64), n.astype(np.uint32)
                    at = [*np.flatnonzero(np.diff(part, prepend=-1)), len(keys)]  # of the partitions that get any
                    rows += [(int(part[a]), chunk, kind, _pack_sorted(keys[a:b]), _pack(n[a:b])) for a, b in zip(at[:-1], at[1:])]
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 64]), _SCHEMA)], schema=_SCHEMA)

    return run


def _totals(frame: pd.DataFrame) -> pd.DataFrame:
    """One partition of the count tables: the words and bigrams of all chunks -> their totals (and the words), per chunk in the order sent."""
    out = []
    for kind in (_WORDS, _BIGRAMS):
        sent = frame[frame["kind"] == kind]
        if not len(sent):
            continue
        keys = [_unpack_sorted(b) for b in sent["a"]]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([_unpack(b, np.uint32) for b in sent["b"]])).astype(np.int64)
        at = np.cumsum([0, *map(len, keys)])
        out += [(p, c, kind, _pack(total[inverse[a:b]]), k if kind == _WORDS else None) for p, c, k, a, b in zip(sent["part"], sent["chunk"], sent["a"], at[:-1], at[1:])]
    answers = pd.DataFrame(out, columns=["part", "chunk", "kind", "a", "b"])
    meta = frame[frame["kind"] == _META]
    return pd.concat([meta, answers], ignore_index=True) if len(meta) and out else answers if out else meta


def _scores(total: int):
    """All rows of a chunk -> its documents' scores."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")  # the order of the hashes
        meta, one, two = (frame[frame["kind"] == kind] for kind in (_META, _WORDS, _BIGRAMS))
        ids, held, lengths = np.split(_unpack(meta["a"].iloc[0], np.int64), 3)
        n, first, local = len(ids), np.concatenate([[0], np.cumsum(lengths)]), _unpack(meta["b"].iloc[0], np.uint32)
        words = np.concatenate([np.zeros(0, np.uint64), *map(_unpack_sorted, one["b"])])
        count, often = (np.concatenate([np.zeros(0, np.int64), *(_unpack(b, np.int64) for b in x["a"])]) for x in (one, two))
        document = np.repeat(np.arange(n), lengths)
        value = np.log(count / total)[local]  # of first words
        keys, second = bigrams(words[local], first)
        if len(keys):
            kinds, inverse = np.unique(keys, return_inverse=True)
            _, mine, own = np.unique(document[second] * np.int64(len(kinds)) + inverse, return_inverse=True, return_counts=True)
            seen = often[inverse] > own[mine]
            value[second] = np.where(seen, np.log(often[inverse] / count[local[second - 1]]), value[second] + np.log(ALPHA))
        return pd.DataFrame({"doc_id": ids, "known": held > 0, "n_words": lengths, "log_score": np.bincount(document, value, n)})

    return run


def score(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, log_score, per_word), one per row of `docs` (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased. log_score sums, over the
    words of a text, log(c(h w) / c(h)) where the bigram with the word before also occurs in
    another row (in more occurrences than the text's own), else log(ALPHA * c(w) / N); a
    first word has log(c(w) / N). c counts all rows,
    exactly but for words or bigrams with equal 64-bit hashes. per_word is its mean. Null, empty and
    blank texts have 0 words, a log_score of 0 and a null per_word. Rows that repeat a
    doc_id are separate, and copies of a text are seen in each other. A null doc_id stays.
    """
    given = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    total = given.select("text").mapInArrow(_count, "n long").agg(F.sum("n")).first()[0] or 0
    parts = 1 << max(2, int(np.ceil(np.log2(max(1, total / PART_TOKENS)))))
    sent = given.mapInArrow(_send(parts), _ROW)
    answered = sent.repartition(2 * parts, "part").groupBy("part").applyInPandas(_totals, _ROW)
    added = answered.groupBy("chunk").applyInPandas(_scores(max(1, total)), "doc_id long, known boolean, n_words long, log_score double")
    return added.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("per_word"))
