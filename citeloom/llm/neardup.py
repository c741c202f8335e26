"""MinHash near-duplicate detection with odd sketches.

Documents are sets of word shingles. Equal sets collapse to one class, named by a digest of
the set, whatever the documents' ids. Classes get MinHash samples; their bands name buckets, and the same samples folded
into a parity bitmap (odd sketch) estimate the similarity of two members of a bucket from
the population count of their XOR. Candidates that the sketch admits are confirmed on the
full sets, and links are closed to components.

Links are searched in rounds, so that a bucket of n similar classes gives about n candidates
rather than n*(n-1)/2: first every member against its bucket's smallest member; then only
buckets whose members are still in different components, each member against its NEAREST
nearest members of other components; at last, where a member has more admitted partners than
that, blocks of the bucket are searched whole on full sets and give a spanning forest of their
links, fewer rows than members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import textkit as tk
from citeloom.llm.components import components, stars
from citeloom.llm.runtime import cut, keyed, spread

SAMPLES = 120
SKETCH_BITS = 256
MISS = 1e-5
BLOCK, BLOCK_BYTES = 4096, 4 << 20
SALTS = 64
NEAREST = 4
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_SKETCH = ("s0", "s1", "s2", "s3")


def band_rows(threshold: float) -> int:
    """The longest band for which a pair at the threshold shares none with a chance below MISS."""
    return max(r for r in range(1, 13) if r == 1 or (1 - threshold**r) ** (SAMPLES // r) <= MISS)


def sketch_limit(threshold: float) -> int:
    """XOR population counts up to this are admitted: similarity five deviations below the threshold."""
    low = max(0.0, threshold - 5.5 * math.sqrt(threshold * (1 - threshold) / SAMPLES))
    mean = SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - low) / SKETCH_BITS))
    return int(mean + 4)


def samples(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash samples [document, SAMPLES] of the shingle hashes of non-empty documents."""
    out = np.empty((len(first) - 1, SAMPLES), np.uint64)
    for j in range(SAMPLES):
        out[:, j] = np.minimum.reduceat(sets * _A[j] + _B[j], first[:-1])
    return out


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Fold samples into parity bitmaps: [document, 4] words of 64 bits."""
    n = len(minima)
    bit = (tk.mix(minima + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
    parity = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + bit).ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64).reshape(n, 4)


def digest(shingles: np.ndarray) -> int:
    """The class of a set: 64 bits of a digest of its sorted shingle hashes."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _fingerprint(k: int, rows: int):
    bands = SAMPLES // rows
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("bytes", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64())), *((c, pa.int64()) for c in _SKETCH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, at in tk.chunks(batch.column(2), 1 << 18):
                hashes, first = tk.shingles(tk.words(raw, at), k)
                sets = [np.unique(hashes[first[i] : first[i + 1]]) for i in range(end - row)]
                size = np.array([len(x) for x in sets], np.int64)
                some = np.flatnonzero(size)
                buckets, sketch = np.zeros((end - row, bands), np.int64), np.zeros((end - row, 4), np.int64)
                if len(some):
                    minima = samples(np.concatenate([sets[i] for i in some]), np.concatenate([[0], np.cumsum(size[some])]))
                    key = np.tile(np.arange(bands, dtype=np.uint64), (len(some), 1))
                    for j in range(rows):
                        key = tk.mix(key * np.uint64(31) + minima[:, j : j + rows * bands : rows][:, :bands])
                    buckets[some] = key.view(np.int64)
                    sketch[some] = odd_sketches(minima)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(end - row + 1) * bands, pa.int32()), pa.array(buckets.ravel()))
                head = batch.slice(row, end - row)
                node = pa.array([digest(x) if len(x) else None for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([head.column(0), head.column(1), pa.array(size), pa.array(np.diff(at)), node, lists, *(pa.array(sketch[:, c]) for c in range(4))], schema=schema)

    return run


def _count_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _led(classes: DataFrame) -> DataFrame:
    """(bucket, a, b): each later member b of a bucket beside the bucket's least, a.

    The least are aggregated before the shuffle and joined back, so that a bucket of any size
    can be split.
    """
    placed = classes.select(F.explode("bands").alias("bucket"), "node")
    least = cut(placed.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return placed.join(least, "bucket").where("node <> a").select("bucket", "a", F.col("node").alias("b"))


def _admitted(pairs: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ in at most `limit` bits."""
    ends = pairs
    for c in "ab":
        ends = ends.join(nodes.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}{x}") for x in _SKETCH)), c)
    apart = sum((F.bit_count(F.col(f"a{x}").bitwiseXOR(F.col(f"b{x}"))) for x in _SKETCH), F.lit(0))
    return ends.where(apart <= limit).select("a", "b")


def nearest_across(node: np.ndarray, group: np.ndarray, sketch: np.ndarray, limit: int, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of members of different groups whose sketches differ in at most `limit` bits.

    Per member at most `most`, nearest first; the last value tells whether any were left out.
    """
    left, right, more = [], [], False
    for at in range(0, len(node), 256):
        apart = _count_bits(sketch[at : at + 256, None, :], sketch[None, :, :])
        apart[group[at : at + 256, None] == group[None, :]] = limit + 1
        if apart.shape[1] > most and ((apart <= limit).sum(axis=1) > most).any():
            more = True
            kth = np.partition(apart, most - 1, axis=1)[:, most - 1]
            apart[(apart > kth[:, None]) | ((apart == kth[:, None]) & (np.cumsum(apart == kth[:, None], axis=1) > most))] = limit + 1
        i, j = np.nonzero(apart <= limit)
        left.append(node[at + i])
        right.append(node[j])
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b), more


def _nearest_round(limit: int, most: int):
    """Pairs (a, b) of a block of a bucket; `more` marks a block where some member has further admitted partners."""

    def run(pdf):
        node, group, sketch = pdf["node"].to_numpy(), pdf["component"].to_numpy(), pdf[list(_SKETCH)].to_numpy()
        a, b, more = nearest_across(node, group, sketch, limit, most)
        return type(pdf)({"a": a, "b": b, "more": np.full(len(a), more)}).drop_duplicates()

    return run


def forest_across(node: np.ndarray, group: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], limit: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the groups as all admitted and confirmed pairs of the block's members would, without cycles.

    A pair of different groups has an end outside the largest group, so only those members
    are compared, each with all others at once: counts of its shingles among theirs.
    """
    root = np.unique(group, return_inverse=True)[1]
    size = np.array([len(x) for x in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(codes.max() + 1, np.int32)
    largest = np.bincount(root).argmax()
    links = []
    for i in np.flatnonzero(root != largest):
        other = np.flatnonzero((root != root[i]) & (_count_bits(sketch[i], sketch) <= limit))
        if not len(other):
            continue
        own = codes[first[i] : first[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[codes], first[:-1])[other]
        mark[own] = 0
        for j in other[den * both >= num * (size[i] + size[other] - both)]:
            if root[j] != root[i]:
                links.append((min(node[i], node[j]), max(node[i], node[j])))
                root[root == root[j]] = root[i]
    return links


def _whole_round(k: int, num: int, den: int, limit: int):
    """A block of a bucket, texts included -> the forest of its links across components."""

    def run(pdf):
        node, group, sketch = pdf["node"].to_numpy(), pdf["component"].to_numpy(), pdf[list(_SKETCH)].to_numpy()
        sets = []
        for row, end, raw, at in tk.chunks(pa.array(pdf["text"], pa.large_string()), 1 << 18):
            hashes, first = tk.shingles(tk.words(raw, at), k)
            sets += [np.unique(hashes[first[i] : first[i + 1]]) for i in range(end - row)]
        links = forest_across(node, group, sketch, sets, limit, num, den)
        return type(pdf)({c: np.array([x[i] for x in links], np.int64) for i, c in enumerate("ab")})

    return run


def _torn(members: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, n, node, component) of the later members of buckets that hold several components.

    A bucket's first member has been tested with all others, so only two later members can
    be left to test. Of buckets with the same members one is taken.
    """
    label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    known = cut(members.join(label("b"), "b", "left").select("bucket", "a", "b", F.coalesce("cb", "b").alias("cb")))
    members_of = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")
    torn = known.groupBy("bucket").agg(F.count("*").alias("n"), members_of, F.max("cb").alias("most"), F.min("cb").alias("least")).where("most <> least")
    torn = cut(torn.groupBy("n", "mark").agg(F.min("bucket").alias("bucket")))
    return known.join(torn.select("bucket", "n"), "bucket").select("bucket", "n", F.col("b").alias("node"), F.col("cb").alias("component"))


def _dealt(inside: DataFrame, blocks) -> DataFrame:
    """Rows in pairs of blocks (bucket, i, j), i <= j, so that any two rows of a bucket meet."""
    dealt = inside.withColumn("mine", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("*", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).drop("mine", "other")
    parts = int(inside.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: not to be coalesced
    return dealt.repartition(parts, "bucket", "i", "j")


def _confirm(k: int, num: int, den: int):
    """Rows (a, id, text) sorted by a, the leader's first -> pairs (a, b) whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, lead_set = None, None
        for batch in batches:
            key, ids = (np.asarray(batch.column(c)) for c in range(2))
            found = []
            for row, end, raw, at in tk.chunks(batch.column(2), 1 << 18):
                hashes, first = tk.shingles(tk.words(raw, at), k)
                for i in range(end - row):
                    own = np.unique(hashes[first[i] : first[i + 1]])
                    a, b = key[row + i], ids[row + i]
                    if a == b:
                        lead, lead_set = a, own
                    elif a == lead:
                        small, large = sorted((len(own), len(lead_set)))
                        if den * small < num * large:
                            continue
                        both = small + large - len(np.union1d(own, lead_set))
                        if den * both >= num * (small + large - both):
                            found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(2)], schema=schema)

    return run


def _links(texts: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) confirmed on full sets; a leader's pairs are dealt over salts, its text once to each."""
    salted = pairs.select("a", "b", (F.pmod(F.xxhash64("b"), F.lit(SALTS))).cast("int").alias("salt"))
    parts = salted.select(F.col("a").alias("key"), "salt", F.col("b").alias("node"))
    parts = parts.unionByName(salted.select(F.col("a").alias("key"), "salt", F.col("a").alias("node")).distinct())
    rows = texts.join(parts.join(reps, "node"), "row")
    rows = rows.withColumn("lead", F.when(F.col("node") == F.col("key"), 0).otherwise(1))
    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "lead")
    return dealt.select("key", "node", "text").mapInArrow(_confirm(k, num, den), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str | None = None) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of `docs` (doc_id, text); with `key`, that column of `docs` comes first.

    Documents link when den * |intersection| >= num * |union| of their sets of k-word
    shingles (words are runs without ASCII white space, A-Z lower-cased; fewer than k words
    make one shingle). Null, empty and blank texts have no shingles, link with nothing, have
    their own doc_id as component and are kept. component_id is the smallest doc_id that
    links reach, among rows that have one; it is null, and the row kept, if no row reached
    has one. Rows that repeat a doc_id are documents of their own: one belongs to its own
    text's component, and several may be kept. Given a `key` (a long that differs in all
    rows), kept tells instead one row of each component: of the smallest doc_id, nulls last,
    then the smallest key. Other columns of `docs` are not read.
    """
    threshold = num / den
    rows, limit = band_rows(threshold), sketch_limit(threshold)
    schema = "row long, doc_id long, n_shingles long, bytes long, node long, bands array<long>, " + ", ".join(f"{c} long" for c in _SKETCH)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(key).alias("row")] if key else []))
    given = (given if key else keyed(given, "row")).select("row", "doc_id", "text")
    prints = cut(spread(given).mapInArrow(_fingerprint(k, rows), schema))
    classes = prints.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.max("bytes").alias("bytes"), F.first("bands").alias("bands"), *(F.first(c).alias(c) for c in _SKETCH))
    classes = cut(classes)
    nodes, reps, texts = classes.select("node", *_SKETCH), classes.select("node", "row"), given.select("row", "text")
    members = cut(_led(classes))
    tested = cut(_admitted(members.select("a", "b").distinct(), nodes, limit))
    found = cut(components(_links(texts, reps, tested, k, num, den)))
    near = _dealt(_torn(members, found).join(nodes, "node"), F.ceil(F.col("n") / BLOCK).cast("long"))
    pairs = near.select("bucket", "i", "j", "node", "component", *_SKETCH).groupBy("bucket", "i", "j").applyInPandas(_nearest_round(limit, NEAREST), "a long, b long, more boolean")
    pairs = cut(pairs.groupBy("a", "b").agg(F.max("more").alias("more")))
    fresh = cut(pairs.select("a", "b").join(tested, ["a", "b"], "left_anti"))
    if not fresh.isEmpty():
        found = cut(components(stars(found).unionByName(_links(texts, reps, fresh, k, num, den))))
    if not pairs.where("more").isEmpty():
        inside = cut(_torn(members, found).join(classes.select("node", "row", "bytes", *_SKETCH), "node"))
        sizes = cut(inside.groupBy("bucket").agg(F.sum("bytes").alias("bytes")))
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("long")
        whole = _dealt(inside.drop("bytes").join(sizes, "bucket").join(texts, "row"), blocks)
        rest = whole.select("bucket", "i", "j", "node", "component", *_SKETCH, "text").groupBy("bucket", "i", "j").applyInPandas(_whole_round(k, num, den, limit), "a long, b long")
        found = cut(components(stars(found).unionByName(rest)))
    label = classes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    label = label.join(label.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component", "component_id")
    joined = prints.select("row", "doc_id", "n_shingles", "node").join(label, "node", "left")
    if key is None:
        answer = joined.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        return answer.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    joined = cut(joined)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    chosen = joined.where("node is not null").groupBy("component").agg(first).select(F.col("first.row").alias("row"), F.lit(True).alias("chosen"))
    answer = joined.join(chosen, "row", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return answer.select(F.col("row").alias(key), "doc_id", "n_shingles", component.alias("component_id"), (F.col("node").isNull() | F.col("chosen").isNotNull()).alias("kept"))
