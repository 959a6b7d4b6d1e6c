"""Benchmark decontamination with DataFrame functions only: SimHash windows, a multi-index, exact verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateloom.llm.common import stage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Fingerprints within this many of 64 bits are found for certain: of BLOCKS equal parts one has at most FLIPS changes.
RADIUS = 23
BLOCKS = 8
FLIPS = 2
#: Shingles of the benchmark that are held at once; a larger benchmark is taken in blocks of about this many.
BLOCK_SHINGLES = 20_000


def words_of(text: Column) -> Column:
    """The runs of letters and digits of ``text`` in lower case; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingle_hashes(hashes: Column, n: Column, k: Column | int) -> Column:
    """A hash for each run of ``k`` of an array of ``n`` word hashes."""
    def at(i: Column) -> Column:
        return F.xxhash64(*(F.get(hashes, i + j) for j in range(k)))

    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), at)).otherwise(F.array().cast("array<bigint>"))


def _shingle_texts(words: Column, n: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))


def simhash(hashes: Column) -> Column:
    """The 64-bit SimHash of an array of hashes, each weighted by its number of occurrences."""
    def with_bit(so_far: Column, b: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda x: F.getbit(x, b) == 1))
        return so_far.bitwiseOR(F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), with_bit)


def _part(fp: Column, b: Column | int) -> Column:
    """The ``b``-th eight bits of a fingerprint; never null, so that a join on it brings no filter that works it out again."""
    shifted = F.shiftrightunsigned(fp, 8 * b) if isinstance(b, int) else F.call_function("shiftrightunsigned", fp, b * 8)
    return F.coalesce(shifted.bitwiseAND(F.lit(255).cast("bigint")).cast("int"), F.lit(-1))


def _masks() -> list[int]:
    """All bytes with at most FLIPS bits set."""
    return [m for m in range(256) if m.bit_count() <= FLIPS]


def _items(benchmark: DataFrame) -> DataFrame:
    """Benchmark items with words: id, words, their number, the shingle length, shingles and fingerprint."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("iw")).distinct()
    rows = rows.withColumn("n", F.size("iw")).filter("n > 0").withColumn("k", F.least("n", F.lit(SHINGLE_WORDS)))
    rows = rows.withColumn("ih", F.transform("iw", lambda w: F.xxhash64(w)))
    by_k = reduce(lambda rest, k: F.when(F.col("k") == k, _shingle_hashes(F.col("ih"), F.col("n"), k)).otherwise(rest), range(1, SHINGLE_WORDS), _shingle_hashes(F.col("ih"), F.col("n"), SHINGLE_WORDS))
    rows = rows.withColumn("sh", by_k).withColumn("ifp", simhash(F.col("sh")))
    return rows.select("item_id", F.xxhash64("item_id", "iw").alias("mark"), "n", "k", "sh", "ifp", _shingle_texts(F.col("iw"), F.col("n"), F.col("k")).alias("ishingles"))


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, similarity)`` for each document that holds a benchmark item.

    For each size of item, windows of so many words end at every shingle that items of this size have too. Any other
    window can move left until it ends at one, or begins the document, and loses none, so these windows hold the
    most similar one and the first of its kind. Those with fewer shared shingles than ``similarity`` needs are left out.
    Windows are cut to the document. Their fingerprints look up the items of that size in a multi-index, which holds all fingerprints
    within ``RADIUS`` bits for certain. Each pair found is verified: the similarity is the sum of the smaller over the
    sum of the larger of the counts of every five-word shingle (items below five words: the whole item), compared as
    text. The most similar, then first, window of a document and item is returned if it has ``similarity`` or more.

    Null and empty texts hold nothing; null or wordless items are ignored; a null doc_id or item_id is an id like any
    other; repeated rows count once; empty tables give an empty result. Other columns are ignored.
    """
    items = stage(_items(benchmark), "benchmark-items")
    total, sizes = items.agg(F.sum(F.size("sh")), F.collect_set("k")).first()
    blocks = max(1, -(-(total or 0) // BLOCK_SHINGLES))
    number = F.pmod("mark", F.lit(blocks))
    found = [_one_block(docs, items.filter(number == b), sorted(sizes or [SHINGLE_WORDS]), similarity) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _starts(n: int, k: int, known: list[int], similarity: float) -> Column:
    """``(n, start)`` of the windows of ``n`` words that can be similar to an item with some of the shingles ``known``."""
    shingles = n - k + 1
    own = F.least(F.lit(n), F.col("nd")) - k + 1
    # common / (shingles + own - common) >= similarity
    need = F.greatest(F.lit(1), F.ceil(F.lit(similarity / (1 + similarity)) * (own + shingles) - 1e-9).cast("int"))

    def ends(places: Column) -> Column:
        enough = F.filter(places, lambda p, i: (i + 1 >= need) & (p - F.get(places, i + 1 - need) < own))
        return F.array_distinct(F.transform(enough, lambda p: F.greatest(F.lit(0), p - own + 1)))

    places = F.transform(F.filter("hits", lambda s: s["h"].isin(known)), lambda s: s["pos"])
    starts = F.flatten(F.transform(F.array(places), ends))
    # a bound that needs no look-up comes first
    return F.when(F.size("hits") >= need, F.transform(starts, lambda s: F.struct(F.lit(n).alias("n"), s.alias("start")))).otherwise(F.array().cast("array<struct<n:int,start:int>>"))


def _one_block(docs: DataFrame, items: DataFrame, sizes: list[int], similarity: float) -> DataFrame:
    """``contamination`` for a block of items that is small enough to be sent to all executors."""
    known: dict[int, dict[int, list[int]]] = {k: {} for k in sizes}
    for r in items.select("n", "k", F.explode("sh").alias("h")).distinct().collect():
        known[r.k].setdefault(r.n, []).append(r.h)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w"))
    rows = rows.withColumn("nd", F.size("w")).withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    laid = []
    for k in sizes:
        some = sorted({h for hs in known[k].values() for h in hs})
        shingled = rows.withColumn("sh", _shingle_hashes(F.col("wh"), F.col("nd"), k))
        # (place, hash) of the shingles that the benchmark has too
        hits = F.filter(F.transform("sh", lambda h, i: F.struct(i.alias("pos"), F.when(h.isin(some), h).alias("h"))), lambda s: s["h"].isNotNull())
        starts = F.concat(F.array().cast("array<struct<n:int,start:int>>"), *(_starts(n, k, hs, similarity) for n, hs in sorted(known[k].items())))
        # explode() would bring a filter on the size of the array, which is then worked out twice
        shared = shingled.withColumn("hits", hits).select("doc_id", "w", "nd", "sh", F.explode_outer(starts).alias("at")).filter("at.start is not null")
        shared = shared.select("doc_id", F.col("at.n").alias("n"), F.lit(k).alias("k"), F.col("at.start").alias("start"), F.least("at.n", "nd").alias("len"), "w", "sh")
        laid.append(shared.select("doc_id", "n", "k", "start", "len", F.slice("w", F.col("start") + 1, F.col("len")).alias("ww"), F.slice("sh", F.col("start") + 1, F.greatest(F.col("len") - F.col("k") + 1, F.lit(1))).alias("wsh")))
    # few bytes but much work follow: the partitions stay as many as they are
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = reduce(DataFrame.union, laid).distinct().repartition(spread, "doc_id", "start", "n").withColumn("wfp", F.coalesce(simhash(F.col("wsh")), F.lit(0).cast("bigint")))
    windows = windows.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("b")).withColumn("value", _part(F.col("wfp"), F.col("b")))

    index = items.select("item_id", "mark", "n", "ifp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("b"))
    index = index.select("*", F.explode(F.array(*(F.lit(m) for m in _masks()))).alias("mask"))
    index = index.select("item_id", "mark", "n", "ifp", "b", _part(F.col("ifp"), F.col("b")).bitwiseXOR(F.col("mask")).alias("value"))

    pairs = windows.join(F.broadcast(index), ["n", "b", "value"])
    differ = F.col("wfp").bitwiseXOR(F.col("ifp"))
    # a pair is taken up by the first of the parts that found it
    earlier = reduce(lambda rest, b: F.when(F.bit_count(_part(differ, b)) <= FLIPS, F.lit(b)).otherwise(rest), reversed(range(BLOCKS)), F.lit(BLOCKS))
    pairs = pairs.filter((F.bit_count(differ) <= RADIUS) & (F.col("b") == earlier))
    pairs = pairs.select("doc_id", "item_id", "mark", "start", "len", "k", "ww").join(F.broadcast(items.select("mark", "ishingles")), "mark")
    pairs = pairs.withColumn("wshingles", _shingle_texts(F.col("ww"), F.col("len"), F.col("k")))
    times = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    smaller = F.aggregate(F.array_distinct("ishingles"), F.lit(0), lambda acc, s: acc + F.least(times(F.col("ishingles"), s), times(F.col("wshingles"), s)))
    pairs = pairs.withColumn("common", smaller)
    share = F.col("common") / (F.size("ishingles") + F.size("wshingles") - F.col("common"))
    best = pairs.select("doc_id", "item_id", "start", "len", share.alias("similarity")).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "len")).alias("best"))
    # a filter before the maximum would be worked out within the join, once for every use of what it needs
    return best.filter(F.col("best.similarity") >= similarity).select("doc_id", "item_id", (-F.col("best.back")).cast("int").alias("start_word"), F.col("best.len").cast("int").alias("n_words"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item. Rows with a null doc_id stay."""
    gone = contamination(docs, benchmark, similarity).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_leaked"], "left_anti")
