"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters as a learnt vector (zero if unseen in training) beside the last states of a
bidirectional recurrent layer over its characters (UTF-8 bytes). A second bidirectional
layer runs over overlapping windows of WINDOW words, one every STRIDE words, so that any passage
of WINDOW - STRIDE + 1 words lies whole in one; attention pools its states into one logit per
window. A document is scored by its highest window, over all windows of the whole text, and
a logistic fit on documents turns that into a probability. All trained here in numpy.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import gru
from citeloom.llm import textkit as tk
from citeloom.llm.runtime import held_out, spread

F32 = np.float32
#: Bounds of the training sample: labelled rows of each class, the longest text fitted on, and the word vectors kept.
TRAIN_TOXIC = 1500
TRAIN_CLEAN = 2500
TRAIN_CHARS = 8_000
TRAIN_WORDS = 30_000
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, CHAR_HIDDEN, HIDDEN = 8, 8, 8, 8
EPOCHS, BATCH, RATE = 6, 128, 0.01
THRESHOLD = 0.3
_HOLD = F32(40)  # update gate of a padding word: the state passes unchanged


class Network:
    """Parameters and passes. Padding words have index -1 in windows."""

    def __init__(self, vocabulary: np.ndarray, evidence: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary  # sorted word hashes
        x = WORD_DIM + 2 * CHAR_HIDDEN
        words = rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)).astype(F32)
        words[:-1, 0] = evidence
        words[-1] = 0
        self.p = {"word": words, "char": rng.normal(0, 0.5, (256, CHAR_DIM)).astype(F32)}
        for name, inputs, hidden in (("cf", CHAR_DIM, CHAR_HIDDEN), ("cb", CHAR_DIM, CHAR_HIDDEN), ("wf", x, HIDDEN), ("wb", x, HIDDEN)):
            self.p |= {f"{name}_{k}": v for k, v in gru.init(rng, inputs, hidden).items()}
        self.p |= {"att": rng.normal(0, 0.3, 2 * HIDDEN).astype(F32), "out": rng.normal(0, 0.3, 2 * HIDDEN).astype(F32), "bias": np.zeros(1, F32)}
        self.scale = (1.0, 0.0)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the word table; the last row for unknown words."""
        n = len(self.vocabulary)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(n - 1, 0))
        return np.where(self.vocabulary[at] == hashes, at, n) if n else np.zeros(len(hashes), np.int64)

    def characters(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """[word, 2 * CHAR_HIDDEN]: the last states over each word's bytes, both directions."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        long = size[order]
        active = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), "right")
        out = np.empty((len(starts), 2 * CHAR_HIDDEN), F32)
        for k, name in enumerate(("cf", "cb")):
            table = self.p["char"] @ self.p[f"{name}_w"] + self.p[f"{name}_b"]
            picked = [data[(starts[order[:m]] + t) if k == 0 else (ends[order[:m]] - 1 - t)] for t, m in enumerate(active)]
            steps = [] if tape is not None else None
            states = gru.forward([table[c] for c in picked], self.p[f"{name}_u"], steps)
            final = np.empty((len(starts), CHAR_HIDDEN), F32)
            for t, m in enumerate(active):
                stop = active[t + 1] if t + 1 < len(active) else 0
                final[order[stop:m]] = states[t][stop:m]
            out[:, k * CHAR_HIDDEN : (k + 1) * CHAR_HIDDEN] = final
            if tape is not None:
                tape[name] = (steps, picked, order, active)
        return out

    def characters_back(self, tape: dict, d: np.ndarray, grads: dict) -> None:
        for k, name in enumerate(("cf", "cb")):
            steps, picked, order, active = tape[name]
            part = d[:, k * CHAR_HIDDEN : (k + 1) * CHAR_HIDDEN]
            above = []
            for t, m in enumerate(active):
                stop = active[t + 1] if t + 1 < len(active) else 0
                g = np.zeros((m, CHAR_HIDDEN), F32)
                g[stop:] = part[order[stop:m]]
                above.append(g)
            dx, grads[f"{name}_u"] = gru.backward(steps, self.p[f"{name}_u"], above)
            table = _summed(np.concatenate(picked), np.concatenate(dx), 256) if dx else np.zeros((256, 3 * CHAR_HIDDEN), F32)
            grads[f"{name}_w"] = self.p["char"].T @ table
            grads[f"{name}_b"] = table.sum(0)
            grads["char"] = grads.get("char", 0) + table @ self.p[f"{name}_w"].T

    def windows(self, inputs: np.ndarray, at: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows; at [window, WINDOW] indexes the rows of inputs."""
        pad = at < 0
        both = []
        for name in ("wf", "wb"):
            table = inputs @ self.p[f"{name}_w"] + self.p[f"{name}_b"]
            hold = np.zeros((1, 3 * HIDDEN), F32)
            hold[0, HIDDEN : 2 * HIDDEN] = _HOLD
            table = np.concatenate([table, hold])  # row -1: padding
            steps = [] if tape is not None else None
            columns = range(at.shape[1]) if name == "wf" else range(at.shape[1] - 1, -1, -1)
            states = gru.forward([table[at[:, t]] for t in columns], self.p[f"{name}_u"], steps)
            both.append(np.stack(states if name == "wf" else states[::-1], axis=1))
            if tape is not None:
                tape[name] = steps
        h = np.concatenate(both, axis=2)
        score = h @ self.p["att"]
        score[pad] = -np.inf
        a = np.exp(score - score.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", a, h)
        if tape is not None:
            tape["top"] = (h, a, pooled)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def windows_back(self, inputs: np.ndarray, at: np.ndarray, tape: dict, d: np.ndarray, grads: dict) -> np.ndarray:
        """Gradients by the parameters; returns those by the inputs."""
        h, a, pooled = tape["top"]
        grads["bias"] = np.array([d.sum()], F32)
        grads["out"] = pooled.T @ d
        dpool = d[:, None] * self.p["out"]
        dscore = a * (np.einsum("bh,bth->bt", dpool, h) - (dpool * pooled).sum(1, keepdims=True))
        grads["att"] = np.einsum("bt,bth->h", dscore, h)
        dh = a[:, :, None] * dpool[:, None, :] + dscore[:, :, None] * self.p["att"]
        back = np.zeros_like(inputs)
        for k, name in enumerate(("wf", "wb")):
            part = dh[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            columns = list(range(at.shape[1])) if name == "wf" else list(range(at.shape[1] - 1, -1, -1))
            dx, grads[f"{name}_u"] = gru.backward(tape[name], self.p[f"{name}_u"], [part[:, t] for t in columns])
            index = np.concatenate([at[:, t] for t in columns])
            table = _summed(np.where(index < 0, len(inputs), index), np.concatenate(dx), len(inputs) + 1)[:-1]
            grads[f"{name}_w"] = inputs.T @ table
            grads[f"{name}_b"] = table.sum(0)
            back += table @ self.p[f"{name}_w"].T
        return back

    def word_inputs(self, w: tk.Words, sample: np.ndarray) -> np.ndarray:
        """Inputs of the words at the given places."""
        chars = self.characters(w.lowered, w.starts[sample], w.ends[sample])
        return np.concatenate([self.p["word"][self.lookup(w.hashes[sample])], chars], axis=1)

    def document_logits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The highest window logit of each document; -inf without words."""
        w = tk.words(raw, at)
        out = np.full(len(at) - 1, -np.inf)
        if not len(w.hashes):
            return out
        _, sample, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        inputs = self.word_inputs(w, sample)
        begin, document = window_starts(w.first)
        for k in range(0, len(begin), 1024):
            places = window_places(begin[k : k + 1024], w.first[document[k : k + 1024] + 1])
            rows = np.where(places < 0, -1, inverse[places])
            np.maximum.at(out, document[k : k + 1024], self.windows(inputs, rows))
        return out

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return gru.sigmoid(self.scale[0] * np.clip(logits, -30, 30) + self.scale[1]).astype(np.float64)


def _summed(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows by index."""
    return np.stack([np.bincount(index, rows[:, c], size) for c in range(rows.shape[1])], axis=1).astype(F32)


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and their documents: every STRIDE words until the text's end is covered."""
    count = np.diff(first)
    n = np.where(count == 0, 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)))
    document = np.repeat(np.arange(len(count)), n)
    return first[document] + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)), document


def window_places(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    places = begin[:, None] + np.arange(WINDOW)
    return np.where(places < end[:, None], places, -1)


def fit(texts: list[str], toxic: np.ndarray) -> Network | None:
    """Train on labelled texts; None if they don't hold both classes.

    A toxic text says nothing of where: its windows start ranked by the evidence of single
    words, then by the network itself. Clean texts give random windows and, from the second
    epoch on, their highest ones.
    """
    toxic = np.asarray(toxic, bool)
    if not len(texts) or toxic.all() or not toxic.any():
        return None
    rng = np.random.default_rng(5)
    raw, at = tk.utf8(pa.array(texts, pa.string()))
    w = tk.words(raw, at)
    types, sample, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    document = w.documents()
    pairs = np.unique(document * np.int64(len(types) + 1) + inverse)
    has, kind = pairs // (len(types) + 1), pairs % (len(types) + 1)
    n1 = np.bincount(kind[toxic[has]], minlength=len(types))
    n0 = np.bincount(kind[~toxic[has]], minlength=len(types))
    odds = np.log((n1 + 0.3) / (toxic.sum() + 1)) - np.log((n0 + 0.3) / ((~toxic).sum() + 1))
    odds[n1 + n0 < 2] = 0
    often = np.sort(np.lexsort((types, -(n1 + n0)))[:TRAIN_WORDS])
    often = often[(n1 + n0)[often] >= 2]
    net = Network(types[often], np.clip(odds[often] / 4, -1, 1).astype(F32))
    begin, owner = window_starts(w.first)
    kind_of = inverse.astype(np.int32)
    rows, rank = np.empty((len(begin), WINDOW), np.int32), np.empty(len(begin))
    for k in range(0, len(begin), 4096):  # in parts, for the driver's memory
        places = window_places(begin[k : k + 4096], w.first[owner[k : k + 4096] + 1])
        rows[k : k + 4096] = np.where(places < 0, -1, kind_of[places])
        rank[k : k + 4096] = np.where(places < 0, -np.inf, odds[kind_of[places]]).max(1)
    del document, pairs, has, kind, inverse
    first_window = np.searchsorted(owner, np.arange(len(texts) + 1))
    some = np.flatnonzero(np.diff(first_window) > 0)
    best = lambda score, docs: np.array([first_window[d] + score[first_window[d] : first_window[d + 1]].argmax() for d in docs], np.int64)
    table = net.lookup(types)
    adam = gru.Adam(net.p, RATE)
    clean_windows = np.flatnonzero(~toxic[owner])
    hits, misses = some[toxic[some]], some[~toxic[some]]
    hard = np.zeros(0, np.int64)
    steps = max(EPOCHS, -(-240 * BATCH // max(1, 2 * len(hits)) // 8)) if len(hits) < 200 else EPOCHS
    for epoch in range(steps):
        if epoch in (2, 4):
            score = _all_windows(net, w, sample, rows)
            rank = score
            hard = best(score, misses)
        positive = best(rank, hits)
        negative = np.concatenate([rng.choice(clean_windows, min(len(clean_windows), 3 * len(positive) + 50), replace=False), hard])
        chosen = np.concatenate([positive, negative])
        truth = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))]).astype(F32)
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), BATCH):
            take = order[k : k + BATCH]
            seen, local = np.unique(rows[chosen[take]], return_inverse=True)
            local = local.reshape(len(take), WINDOW)
            if seen[0] < 0:
                seen, local = seen[1:], local - 1
            tape: dict = {}
            grads: dict = {}
            drop = rng.random(len(seen)) < 0.5  # so that characters must suffice too
            ids = np.where(drop, len(net.vocabulary), table[seen])
            chars = net.characters(w.lowered, w.starts[sample[seen]], w.ends[sample[seen]], tape)
            inputs = np.concatenate([net.p["word"][ids], chars], axis=1)
            logit = net.windows(inputs, local, tape)
            d = ((gru.sigmoid(logit) - truth[take]) / len(take)).astype(F32)
            back = net.windows_back(inputs, local, tape, d, grads)
            net.characters_back(tape, back[:, WORD_DIM:], grads)
            grads["word"] = _summed(ids, back[:, :WORD_DIM], len(net.p["word"]))
            grads["word"][-1] = 0
            adam.step(grads)
    score = _all_windows(net, w, sample, rows)
    top = np.full(len(texts), -30.0)
    np.maximum.at(top, owner, score)
    net.scale = _logistic(top, toxic)
    return net


def _all_windows(net: Network, w: tk.Words, sample: np.ndarray, rows: np.ndarray) -> np.ndarray:
    inputs = np.concatenate([net.word_inputs(w, sample[k : k + 20_000]) for k in range(0, len(sample), 20_000)])
    return np.concatenate([net.windows(inputs, rows[k : k + 1024]) for k in range(0, len(rows), 1024)])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the log odds, the slope drawn to 1 so that separable scores stay finite."""
    a = np.stack([np.clip(x, -30, 30), np.ones(len(x))], axis=1)
    theta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = gru.sigmoid(a @ theta)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([2.0, 0.1]), a.T @ (p - y) + np.array([2.0, 0.1]) * (theta - prior))
        theta = theta - np.clip(step, -0.5, 0.5)
    return float(max(theta[0], 0.05)), float(theta[1])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A bounded sample of labelled rows: at most TRAIN_TOXIC toxic and TRAIN_CLEAN clean texts, by a hash of the id.

    Labels of a doc_id that disagree or are null are not learnt from.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    known = known.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    chosen = None
    for kind, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= TRAIN_CHARS)
    joined = texts.join(F.broadcast(chosen), "doc_id")  # at most TRAIN_TOXIC + TRAIN_CLEAN rows
    return joined.select("text", "toxic", F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "text").limit(TRAIN_TOXIC + TRAIN_CLEAN)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    rows.sort(key=lambda r: (r["h"], r["text"]))
    net = fit([r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows], bool))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])


def trained(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network fitted on training_rows() by one task, whose rows are bounded; the driver gets the parameters alone."""
    made = training_rows(docs, labels).coalesce(1).mapInArrow(_train, "net binary").first()
    return pickle.loads(made["net"]) if made else None


def toxicity(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, the carried columns of `docs`), one per row of `docs` (doc_id, text).

    Learns from the labels of rows whose crc32(doc_id) mod 4 is not 2, on the bounded sample
    of training_rows(); scores read the whole text alone. Null, empty and blank texts, and
    everything if the sample lacks a class, score 0. Texts of any length are scored over all
    their windows. A null doc_id is not held out. Repeated rows get equal scores.
    """
    net = trained(docs, labels)
    out = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("_text"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*out, *(batch.schema.field(3 + i) for i in range(len(carry)))])
            for row, end, raw, at in tk.chunks(batch.column(2)):
                score = np.zeros(end - row)
                if net is not None:
                    logits = net.document_logits(raw, at)
                    some = np.isfinite(logits)
                    score[some] = net.probability(logits[some])
                head = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([head.column(0), head.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), *head.columns[3:]], schema=schema)

    carried = "".join(f", `{c}` {given.schema[c].dataType.simpleString()}" for c in carry)
    return spread(given).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + carried)
