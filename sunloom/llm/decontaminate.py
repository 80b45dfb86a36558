"""Benchmark decontamination in DataFrame operations only.

A document window can only be similar to an item if they share a five-word
shingle, so the shingles of the items, looked up by their longest word, say
where windows start: the window of the item's length that lines the shared
shingle up.  Each window gets a 64-bit SimHash over its weighted shingles; the
fingerprints are matched through eight 8-bit blocks, where a distance of RADIUS
or less leaves at least one block within RADIUS // 8, so all fingerprints within
the radius are found.  The exact weighted Jaccard similarity decides.

The radius is 4.6 standard deviations above the mean distance of two windows
with similarity 0.8, so practically no such pair is beyond it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import saved

#: What stands between words: ASCII other than letters and digits.
_NOT_WORD = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE, THRESHOLD = 5, 0.8
RADIUS, BLOCKS = 23, 8
#: Most shingles of a benchmark (and most of its items) that are sent to every task; a larger one is joined by shuffles.
BROADCAST_ROWS = 200_000


def _words(text_col: str) -> Column:
    """The lower-cased words in order; null for a text without one."""
    plain = F.btrim(F.lower(F.col(text_col).cast("string")), F.lit(_NOT_WORD))
    return F.when(F.length(plain) > 0, F.split(plain, _GAP))


def _gram(words: str, at: Column | str, size: Column | str) -> Column:
    """The hash of `size` words from 0-based place `at`."""
    return F.xxhash64(F.concat_ws(" ", F.slice(F.col(words), (F.col(at) if isinstance(at, str) else at) + 1, F.col(size) if isinstance(size, str) else size)))


def _hint(rows: int) -> Callable[[DataFrame], DataFrame]:
    """How a table of so many counted rows is joined: sent to every task, or left to the planner."""
    return F.broadcast if rows <= BROADCAST_ROWS else lambda df: df


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def items(benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """(item, m words, q words a shingle, idx, gram, word, off): every shingle of every distinct text that has words.

    item: the text's digest; word, off: the shingle's longest word and its place in it.
    """
    part = F.slice("iw", F.col("idx") + 1, F.col("q"))
    best = F.array_max(F.transform(part, lambda w, k: F.struct(F.length(w).alias("size"), w.alias("word"), (-k).alias("back"))))
    base = benchmark.select(_digest(text_col).alias("item"), _words(text_col).alias("iw")).where("iw IS NOT NULL").dropDuplicates(["item"])
    base = base.withColumn("m", F.size("iw")).withColumn("q", F.least(F.col("m"), F.lit(SHINGLE)))
    base = base.withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("q")))).withColumn("gram", _gram("iw", "idx", "q")).withColumn("b", best)
    return base.select("item", "m", "q", "idx", "gram", F.col("b.word").alias("word"), (-F.col("b.back")).alias("off"))


def windows(docs: DataFrame, table: DataFrame, sized: Callable[[DataFrame], DataFrame], text_col: str = "text") -> DataFrame:
    """(key, item, q, start, window): the windows of each text that line up a shingle of an item; key: the text's digest."""
    # (explode_outer, since for explode the planner would add filters that split the text twice more.)
    # Per word first: one lookup of a word gives the places it can have in shingles, and only then the items.
    spots = table.select("word", "off", "q", "gram").distinct()
    text = docs.select(_digest(text_col).alias("key"), _words(text_col).alias("words"))
    at = F.col("pos") - F.col("off")
    hits = text.select("key", "words", F.posexplode_outer("words").alias("pos", "word")).join(sized(spots), "word")
    hits = hits.where((at >= 0) & (at + F.col("q") <= F.size("words"))).where(_gram("words", at, "q") == F.col("gram")).select("key", "words", at.alias("at"), "q", "gram")
    lined = hits.join(sized(table.select("item", "m", "q", "idx", "gram").distinct()), ["gram", "q"])
    start = F.greatest(F.col("at") - F.col("idx"), F.lit(0))
    end = F.least(F.col("at") - F.col("idx") + F.col("m"), F.size("words"))
    return lined.select("key", "item", "q", start.alias("start"), F.slice("words", start + 1, end - start).alias("window")).distinct()


def _simhash(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, print: the SimHash of the weighted shingles (gram, c) of each key."""
    # One sum for two bits, k and k + 32: each has half of a long, enough for two thousand million shingles.
    low = F.lit(0x100000001).cast("long")
    sums = [F.sum(F.shiftrightunsigned("gram", k).bitwiseAND(low) * F.col("c")).alias(f"b{k}") for k in range(32)]
    summed = counted.groupBy(*keys).agg(F.sum("c").alias("total"), *sums)
    half = F.lit(0xFFFFFFFF).cast("long")
    more = lambda bits, k: F.when(bits * 2 > F.col("total"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    every = F.array(*(x for k in range(32) for x in (more(F.col(f"b{k}").bitwiseAND(half), k), more(F.shiftrightunsigned(f"b{k}", 32), k + 32))))
    return summed.select(*keys, "total", F.aggregate(every, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("print"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """(key, item, similarity, start, distance): for each text and item (md5 of their bytes) the most similar window of 0.8 or more.

    Similarity: weighted Jaccard over five-word shingles (of all words, for an item of fewer) of the window and the item,
    lower-cased.  Among equals the first window; start counts words from 0.  Null texts, and texts and items without a
    word, match nothing; an empty table gives an empty result.  Items are told apart by their texts, whatever their ids.
    """
    grams = saved(items(benchmark, item_text_col))
    keys = ["key", "item", "start"]
    found = windows(docs, grams, _hint(grams.count()), text_col)
    shingles = found.where(F.size("window") >= F.col("q")).select(*keys, "window", "q", F.explode(F.sequence(F.lit(0), F.size("window") - F.col("q"))).alias("i")).select(*keys, _gram("window", "i", "q").alias("gram"))
    # Written once: fingerprints and exact similarities are two readers, and the texts are gone through a single time.
    counted = saved(shingles.groupBy(*keys, "gram").agg(F.count("*").alias("c")))
    wanted = grams.groupBy("item", "gram").agg(F.count("*").alias("c"))
    mine = _simhash(counted, keys)
    theirs = _simhash(wanted, ["item"])
    near = RADIUS // BLOCKS
    flips = [sum(1 << b for b in bits) for r in range(near + 1) for bits in combinations(range(8), r)]
    blocks = lambda df: df.select("*", F.posexplode(F.array(*(F.shiftrightunsigned("print", 8 * k).bitwiseAND(F.lit(255).cast("long")) for k in range(BLOCKS)))).alias("block", "value"))
    index = blocks(theirs).select("item", F.col("print").alias("other"), F.col("total").alias("m_total"), "block", F.explode(F.array(*(F.lit(x).cast("long") for x in flips))).alias("flip"), "value")
    index = index.select("item", "other", "m_total", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("other")))
    matched = blocks(mine).join(index, ["item", "block", "value"]).where(distance <= RADIUS).select(*keys, "total", "m_total", distance.alias("distance")).distinct()
    shared = counted.join(wanted.select("item", "gram", F.col("c").alias("c2")), ["item", "gram"]).groupBy(*keys).agg(F.sum(F.least("c", "c2")).alias("both"))
    scored = matched.join(shared, keys).select(*keys, "distance", (F.col("both") / (F.col("total") + F.col("m_total") - F.col("both"))).alias("similarity"))
    best = scored.where(F.col("similarity") >= THRESHOLD).groupBy("key", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.col("distance").alias("distance"))).alias("b"))
    return best.select("key", "item", "b.similarity", (-F.col("b.back")).alias("start"), "b.distance")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs and item that a window of its text matches: id_col, item_id, similarity, start, distance.

    An item is a distinct pair of item_id, null too, and text: an id with two texts that both match has two rows.
    """
    found = contaminated(docs, benchmark, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), _digest(text_col).alias("key"))
    named = benchmark.select(F.col("item_id"), _digest("text").alias("item")).where("item IS NOT NULL").distinct()
    return rows.join(found, "key").join(named, "item").select(F.col("_id").alias(id_col), "item_id", "similarity", F.col("start").cast("long").alias("start"), F.col("distance").cast("long").alias("distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text matches an item."""
    keys = contaminated(docs, benchmark, text_col).select("key").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), _digest(f"`{text_col}`").alias("digest"))
    return rows.join(keys, F.col("digest") == F.col("key"), "left_anti").select("doc.*")
