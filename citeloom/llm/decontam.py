"""Benchmark decontamination with a positional inverted index, in DataFrame operations alone.

The index is stored as rows: document, position and term of all words that the benchmark knows.
Windows of the benchmark items (`size` consecutive words, or the whole of a shorter item) with
the same words are one gram, which names its two rarest terms. Their postings, less the term's
offset, name the places where the gram could stand; the two lists are intersected, and where
they meet all the gram's words are looked up in the index (phrase matches). Each item names its
rarest terms, so many that any place with half of its words has two of them; their lists are
intersected with a slop, and where two meet the words are compared with the same slop
(proximity matches).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.runtime import keyed, spread, stored

#: What stands between words; A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
#: Places by which words of a proximity match may be shifted against each other.
SLOP = 2
#: Begins of an item in a document from which on its words in the document are counted, to stop once all are aligned.
MANY_BEGINS = 64
#: Words of all benchmark items up to which their terms and places are broadcast (some 10 MB); beyond, the joins shuffle.
BROADCAST_WORDS = 200_000
#: Documents with candidates up to which their row numbers are broadcast (some 10 MB), so that others' words are not shuffled.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """The words of a text. Splitting is some fifteen times as fast as extracting matches, and lower() as translate()."""
    plain = F.length(text) == F.octet_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item, words): every window of every item that has words."""
    n = F.size("words")
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array(F.lit(0)))
    return items.where(n > 0).select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at") + 1, size).alias("words"))


def gram_places(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, length, which, term, offset): of words (gram, length, offset, term) each gram's two rarest in training, or its only one; grams with a term that never occurs are out."""
    order = Window.partitionBy("gram").orderBy("n", "term", "offset")
    ranked = words.join(counts, "term").withColumns({"which": F.row_number().over(order), "known": F.count("*").over(Window.partitionBy("gram"))})
    return ranked.where("which <= 2 and known = length").select("gram", "length", "which", "term", "offset")


def near_need(length: Column) -> Column:
    """The words of an item that a proximity match has at least: half, and two if it has two."""
    return F.greatest(F.ceil(length / 2), F.least(F.lit(2), length)).cast("int")


def near_places(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, length, offset, term): of words (item, length, offset, term) each item's rarest in training.

    They are so many that near_need() words always hold two of them, or one if one is needed.
    """
    need = near_need(F.col("length"))
    order = Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "term", "offset")
    ranked = words.join(counts, "term", "left").withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= F.col("length") - need + F.least(F.lit(2), need)) & (F.col("n") > 0)).select("item", "length", "offset", "term")


def _holding(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `table` that are among `rows` (row): known by a broadcast if a count shows that they are few enough."""
    rows = stored(rows.distinct(), "rows")
    return table.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "row", "left_semi")


def matches(postings: DataFrame, words: DataFrame, places: DataFrame, bounded: bool) -> DataFrame:
    """(row, gram, begin, length): where grams of `words` occur in documents.

    The offset-adjusted lists of a gram's two rarest terms are intersected first. What is left
    has all its words looked up in the postings, by document, position and term: so neither a
    document nor a gram that many places have in common is ever copied to each of them.
    """
    hint = F.broadcast if bounded else (lambda x: x)
    spots = postings.join(hint(places), "term").select("row", "gram", "length", "which", (F.col("pos") - F.col("offset")).alias("begin"))
    met = spots.where("begin >= 0").groupBy("row", "gram", "begin", "length").agg(F.bit_or("which").alias("lists"))
    found = stored(met.where("lists = 3 or lists = 1 and length = 1").select("row", "gram", "begin", "length"), "candidates")
    wanted = found.drop("length").join(words, "gram").withColumn("pos", F.col("begin") + F.col("offset"))
    there = _holding(postings, found.select("row"))
    same = wanted.join(there, ["row", "pos", "term"]).groupBy("row", "gram", "begin", "length").count()
    return same.where("count = length").drop("count")


def near_matches(postings: DataFrame, given: DataFrame, items: DataFrame, places: DataFrame, bounded: bool) -> DataFrame:
    """(row, item, place, aligned): where near_need() words of items stand in documents (row, words), their offset-adjusted places within SLOP of each other.

    place is the first of these (it may be negative), aligned the number of different words of the item that stand there, each at a word of the document of its own.
    """
    hint = F.broadcast if bounded else (lambda x: x)
    begins = postings.join(hint(places), "term").groupBy("row", "item", "length", (F.col("pos") - F.col("offset")).alias("begin")).count()
    after = F.lead("begin").over(Window.partitionBy("row", "item").orderBy("begin"))
    spots = begins.withColumn("after", after).where((near_need(F.col("length")) < 2) | (F.col("count") > 1) | (F.col("after") - F.col("begin") <= SLOP))
    spots = stored(spots.groupBy("row", "item").agg(F.sort_array(F.collect_list("begin")).alias("begins")), "spots")  # at most as many as both have words
    spots = spots.join(_holding(given, spots.select("row")), "row").join(items.select("item", F.col("words").alias("phrase")), "item")
    shifts = F.array(*(F.lit(s) for s in range(-SLOP, SLOP + 1)))

    def lowest(begin: Column, i: Column) -> Column:
        """The first shift that windows at the begin before have not covered."""
        return F.struct(begin.alias("begin"), F.greatest(F.lit(-SLOP), F.get("begins", i - 1) + 1 - begin).alias("lowest"))

    def stand(begin: Column, low: Column) -> Column:
        """(s, j, p): the words j of the item that stand at p, s beside their place."""
        word = lambda w, j: F.transform(F.filter(shifts, lambda s: (s >= low) & F.coalesce(F.get("words", begin + j + s) == w, F.lit(False))), lambda s: F.struct(s.alias("s"), j.alias("j"), (begin + j + s).alias("p")))
        return F.flatten(F.transform("phrase", word))

    def fit(begin: Column, standing: Column, first: int) -> Column:
        some = F.filter(standing, lambda x: (x["s"] >= first) & (x["s"] <= first + SLOP))
        words = F.least(*(F.size(F.array_distinct(F.transform(some, lambda x: x[k]))) for k in ("j", "p")))  # noqa: B023
        return F.struct(words.alias("aligned"), (-begin - F.array_min(F.transform(some, lambda x: x["s"]))).alias("before"))

    def best(at: Column) -> Column:
        begin, low = at["begin"], at["lowest"]
        fits = F.transform(F.array(stand(begin, low)), lambda x: F.greatest(*(F.when(low <= first, fit(begin, x, first)) for first in range(-SLOP, 1))))
        return F.get(fits, F.lit(0))

    def better(so_far: Column, at: Column) -> Column:
        """Begins rise, and so do their places: once as many words are aligned as can be, no later begin is tried."""
        tried = F.struct(F.greatest(so_far["best"], best(at)).alias("best"), so_far["most"].alias("most"))
        return F.when(so_far["best"]["aligned"] >= so_far["most"], so_far).otherwise(tried)

    held = F.transform(F.array(F.array_intersect("phrase", "words")), lambda both: F.size(F.filter("phrase", lambda w: F.array_contains(both, w))))
    most = F.when(F.size("begins") > MANY_BEGINS, F.least(F.get(held, F.lit(0)), F.size("words"))).otherwise(F.size("phrase"))
    none = F.struct(F.struct(F.lit(0).alias("aligned"), F.lit(None).cast("int").alias("before")).alias("best"), most.alias("most"))
    tops = F.aggregate(F.transform("begins", lowest), none, better, lambda x: x["best"])
    tried = spots.select("row", "item", near_need(F.size("phrase")).alias("need"), tops.alias("best"))
    return tried.where("best.aligned >= need").select("row", "item", (-F.col("best.before")).alias("place"), "best.aligned")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, proximity: bool = True) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, n_near, near), one per row of `docs` (doc_id, text).

    A document word inside any occurrence of a window of any item (item_id, text) is hit.
    items are the ids of items with occurring windows, as sorted strings; contaminated tells
    that n_hit > 0 and 20 * n_hit >= n_words. n_near counts items of which at least half the
    words, and two if it has two, stand aligned at one place, give or take SLOP words
    (proximity matches); near are their (item_id, place), the place being that of the item's
    first word where most are aligned, before the document's first word if negative; both are
    only given if `proximity` matches are sought. Null and empty texts have
    no words; items without words or with a null item_id (taken as the id `null`) are
    treated alike; rows that repeat an item_id count as one item with several texts. Rows of
    `docs` that repeat a doc_id get their own answers. Other columns are not read.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = stored(items.distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    bounded = (items.agg(F.sum(F.size("words"))).first()[0] or 0) <= BROADCAST_WORDS
    hint = F.broadcast if bounded else (lambda x: x)
    vocabulary = stored(items.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    windows = item_windows(items, size)
    grams = stored(windows.select("words").distinct().withColumn("gram", F.monotonically_increasing_id()), "grams")
    terms = lambda table, key: table.select(key, F.size("words").alias("length"), F.posexplode("words").alias("offset", "word")).join(vocabulary, "word").drop("word")
    gram_words = stored(terms(grams, "gram"), "gram-words")
    owners = windows.join(grams, "words").join(items.select("item", "item_id"), "item").select("gram", "item_id").distinct()
    given = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")), "row")
    words = spread(given).select("row", words_of(F.col("text")).alias("words"))
    postings = words.select("row", F.posexplode("words").alias("pos", "word")).join(hint(vocabulary), "word").select("row", "pos", "term")
    postings = stored(postings, "postings")
    counts = stored(postings.groupBy("term").agg(F.count("*").alias("n")), "counts")
    places = stored(gram_places(gram_words, counts), "places")
    found = stored(matches(postings, gram_words, places, bounded), "matches")
    hit = found.select("row", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("length") - 1)).alias("pos")).distinct()
    hit = hit.groupBy("row").agg(F.count("*").alias("n_hit"))
    ids = found.select("row", "gram").distinct().join(owners, "gram").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    per_row = stored(hit.join(ids, "row"), "hits")
    # every row again, with its number of words; a broadcast of the few that are hit, if a count shows that they are few
    heads = spread(given).select("row", "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = heads.join(F.broadcast(per_row) if per_row.count() <= BROADCAST_ROWS // 10 else per_row, "row", "left")
    hits, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    out = [
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((hits > 0) & (20 * hits >= F.col("n_words"))).alias("contaminated"),
        ids.alias("items"),
    ]
    if not proximity:
        return joined.select(*out)
    close = stored(near_places(terms(items, "item"), counts), "close")
    nearby = near_matches(postings, words, items, close, bounded).join(items.select("item", "item_id"), "item")
    nearby = nearby.groupBy("row", "item_id").agg(F.min_by("place", F.struct(-F.col("aligned"), "place")).alias("place"))
    nearby = nearby.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("item_id", "place"))).alias("near"))
    near = F.coalesce("near", F.array().cast("array<struct<item_id:string,place:int>>"))
    return joined.join(nearby, "row", "left").select(*out, F.size(near).cast("long").alias("n_near"), near.alias("near"))
