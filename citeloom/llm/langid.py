"""Language identification with a string kernel.

A text is its set of letter n-grams of lengths 1 to 3 (a blended spectrum, presence only),
and the kernel of two texts is the size of their common set over the root of the sizes'
product. Nyström landmarks turn it into a few features; one-versus-rest kernel ridge
regression on them gives a weight per landmark and language, so that a batch of texts is
scored by two matrix products.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.runtime import held_out, spread

#: Bounds of the training sample: rows of each language, rows and landmarks of all, and the characters of a text that it is fitted on.
TRAIN_PER_LANG, TRAIN_ROWS = 375, 20_000
LANDMARKS_PER_LANG, LANDMARKS = 40, 2_000
TRAIN_CHARS = 20_000
#: Different lang values up to which their counts are broadcast (some MB).
BROADCAST_LANGS = 100_000
RIDGE = 1e-2
SHARPNESS = 6.0
#: Bits of a code point, and the symbol for what is no letter: n-grams of up to three symbols have codes of their own.
_BITS, _MARK = 21, 1


@cache
def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else the mark."""
    return np.array([c if chr(c).isalpha() else _MARK for c in range(0x110000)], np.int64)


class Model(NamedTuple):
    known: np.ndarray  # sorted n-gram codes that landmarks have
    grams: np.ndarray  # [known, landmark], over the root of the landmark's set size
    weights: np.ndarray  # [landmark, language]
    langs: list[str]


def gram_codes(text: str) -> np.ndarray:
    """Sorted distinct codes of the n-grams of 1 to 3 letters, runs of non-letters counting as one mark; empty without letters."""
    s = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate([[_MARK], s, [_MARK]])
    s = s[np.concatenate([[True], (s[1:] != _MARK) | (s[:-1] != _MARK)])]
    if len(s) < 2:
        return np.zeros(0, np.int64)
    two = (s[:-1] << _BITS) | s[1:]
    three = (two[:-1] << _BITS) | s[2:]
    return np.concatenate([np.unique(s), np.unique(two), np.unique(three)])  # each range is above the one before


def _presence(codes: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), len(known)), np.float32)
    for i, c in enumerate(codes):
        at = np.minimum(np.searchsorted(known, c), len(known) - 1)
        out[i, at[known[at] == c]] = 1
    return out


def fit(texts: list[str], langs: list[str]) -> Model:
    """Fit on labelled texts; landmarks are each language's first texts with letters."""
    codes = [gram_codes(t) for t in texts]
    rows = [i for i, c in enumerate(codes) if len(c)]
    names = sorted({langs[i] for i in rows})
    if not names:
        return Model(np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)), [])
    most = min(LANDMARKS_PER_LANG, max(1, LANDMARKS // len(names)))
    taken = dict.fromkeys(names, 0)
    landmarks = []
    for i in rows:
        if taken[langs[i]] < most:
            taken[langs[i]] += 1
            landmarks.append(i)
    known = np.unique(np.concatenate([codes[i] for i in landmarks]))
    marks = _presence([codes[i] for i in landmarks], known)
    grams = (marks / np.sqrt(marks.sum(1, keepdims=True))).T.copy()
    size = np.array([len(codes[i]) for i in rows], np.float64)
    k = np.concatenate([_presence([codes[i] for i in rows[at : at + 256]], known) @ grams for at in range(0, len(rows), 256)]) / np.sqrt(size)[:, None]
    values, vectors = np.linalg.eigh((marks @ grams) / np.sqrt(marks.sum(1, keepdims=True)))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ root
    truth = np.where(np.array([langs[i] for i in rows])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    number = {name: (truth[:, j] > 0).sum() for j, name in enumerate(names)}
    balance = 1 / np.array([number[langs[i]] for i in rows])
    left = (phi * balance[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1]) * balance.sum() / len(rows)
    return Model(known, grams, root @ np.linalg.solve(left, (phi * balance[:, None]).T @ truth), names)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    for at in range(0, len(texts), 256):
        codes = [gram_codes(t or "") for t in texts[at : at + 256]]
        some = [i for i, c in enumerate(codes) if len(c)]
        if not some or not model.langs:
            continue
        size = np.array([len(codes[i]) for i in some], np.float64)
        k = (_presence([codes[i] for i in some], model.known) @ model.grams) / np.sqrt(size)[:, None]
        margin = SHARPNESS * (k @ model.weights)
        odds = np.exp(margin - margin.max(1, keepdims=True))
        best = odds.argmax(1)
        for j, i in enumerate(some):
            langs[at + i] = model.langs[best[j]]
            scores[at + i] = odds[j, best[j]] / odds[j].sum()
    return langs, scores


def training_rows(docs: DataFrame) -> DataFrame:
    """(text, lang, h): of every language the TRAIN_PER_LANG labelled rows with the smallest hash of text and id, fewer if languages are many.

    Rows far above a language's share of hashes go before any text is sorted; the rest are
    ranked, so that copies of one text, which share a hash, stay within the bound. Of a text
    over TRAIN_CHARS its beginning is fitted on; predictions read whole texts.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    h = F.xxhash64("text", "doc_id")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(h).alias("n"))  # copies of a row count once
    langs = counts.count()
    most = max(1, min(TRAIN_PER_LANG, TRAIN_ROWS // max(1, langs)))
    counts = F.broadcast(counts) if langs <= BROADCAST_LANGS else counts
    share = (h.cast("double") / 2.0**64 + 0.5) * F.col("n")  # of n different hashes about as many are smaller
    likely = labelled.join(counts, "lang").where(share < most + 8 * most**0.5 + 8)
    cut = likely.select(F.substring("text", 1, TRAIN_CHARS).alias("text"), F.col("lang").cast("string").alias("lang"), h.alias("h"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    return cut.withColumn("rank", rank).where(F.col("rank") <= most).select("text", "lang", "h")


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["h"], r["text"], r["lang"]) for batch in batches for r in batch.to_pylist())
    model = fit([r[1] for r in rows], [r[2] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def identify(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of `docs` (doc_id, text, lang).

    Learns only from rows with text and lang whose crc32(doc_id) mod 4 is not 2, on the
    bounded sample of training_rows(), in one task; predictions read the whole text alone.
    Every lang value with a text that has letters is learnt. Null texts and
    texts without a letter are `und` with score 0, and so is everything if no row is
    labelled. A null doc_id is not held out. Repeated rows get equal answers.
    """
    made = training_rows(docs).repartition(1).mapInArrow(_train, "model binary").first()
    model = pickle.loads(made["model"]) if made else fit([], [])
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, scores = predict(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores)], schema=schema)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return spread(given).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
