"""Find documents that hold a benchmark item, exactly or nearly.

Method. Words are runs of letters and digits, in lower case. A window is as long as an item. It is laid over a document
where the number of five-word shingles that it shares with the item peaks and is enough for ``percent``: a shingle that the item has
``c`` times counts in a window if fewer than ``c`` equal ones precede it there, that is for one run of starts, so counts of all
windows follow from a running sum over the ends of such runs. Texts of windows are made for peaks only, and the work
grows with the length of items and documents, not with their product. Of starts that share equally much the first is laid.
SimHash gives each window and each item 64 bits from its words, repeats counting as often as they occur.
Fingerprints are cut in ``BLOCKS`` blocks; two within ``RADIUS`` bits differ by at most ``TURNS`` bits in some block, so an
index of every block of every item with up to so many bits turned finds all of them by equality. Candidates
within the radius are verified by the weighted Jaccard similarity of five-word shingles (each weighs as often as it
occurs), which has to reach ``percent``.

All of it is DataFrame expressions. The item shingles are broadcast in slices of ``SLICE`` rows at most, one pass over
the documents for each slice. Places of windows are joined back to the texts, broadcast up to ``SLICE`` / 4 of them and shuffled beyond.

Defined cases. A null or empty text, or one without words, holds nothing; so does an item without words. An item of fewer than five
words is one shingle, its whole sequence. A text shorter than an item is compared as a whole. Rows that repeat a ``doc_id`` give one result
row per item. Empty tables give an empty result. Columns beyond ``doc_id``, ``text`` and ``item_id``, ``text`` are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofid.session import checkpointed

WIDTH, PERCENT = 5, 80
#: 23 bits over 8 blocks leave at most two bits to some block.
RADIUS, BLOCKS, BLOCK_BITS, TURNS = 23, 8, 8, 2
#: Item shingles broadcast at a time: about 40 bytes each.
SLICE = 1_000_000


def text_words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words; none if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<long>"))


def shingle_bag(words: Column) -> Column:
    """Hashes of all five-word runs, or of the whole sequence if it is shorter."""
    return F.when(F.size(words) >= WIDTH, shingles(words, WIDTH)).otherwise(F.array(F.xxhash64(words)))


def fingerprints(texts: DataFrame, name: str, words: str) -> DataFrame:
    """``name, bits``: the 64-bit SimHash of the words of each ``name``; each word is hashed once."""
    hashed = texts.select(name, F.explode(words).alias("word")).select(name, F.xxhash64("word").alias("h"))
    ones = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    counted = hashed.groupBy(name).agg(F.count(F.lit(1)).alias("n"), *ones)
    set_bits = [F.when(2 * F.col(f"b{b}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return counted.select(name, reduce(Column.bitwiseOR, set_bits).alias("bits"))


def blocks(value: Column) -> Column:
    """``(block, key)`` pairs of a fingerprint."""
    mask = (1 << BLOCK_BITS) - 1
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(value, b * BLOCK_BITS).bitwiseAND(F.lit(mask)).alias("key")) for b in range(BLOCKS)))


def item_table(items: DataFrame) -> DataFrame:
    """``item_id, item_words, length, item``, without empty items; ``item`` stands for the words."""
    words = items.select("item_id", text_words(F.col("text")).alias("item_words"))
    kept = words.withColumn("length", F.size("item_words")).where("length > 0").dropDuplicates(["item_id", "item_words"])
    return kept.withColumn("item", F.xxhash64("item_words"))


def needed(width: int) -> Column:
    """Shared shingles from which a window of a text of ``size`` words can reach ``PERCENT`` with an item of ``length`` words."""
    sizes = F.least("size", "length") + F.col("length") - 2 * (width - 1)
    return F.ceil(PERCENT * sizes / F.lit(100 + PERCENT))


def peaks(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_hash, start, length``: where the count of shingles shared with an item peaks, if it suffices."""
    texts = items.groupBy("item", "length").agg(F.first("item_words").alias("item_words"))
    each = texts.select("item", "length", F.explode(shingles(F.col("item_words"), width)).alias("h"))
    placed = checkpointed(each.groupBy("item", "length", "h").agg(F.count(F.lit(1)).cast("int").alias("c")))
    slices = max(1, -(-placed.count() // SLICE))
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_words(F.col("text")).alias("words"))
    # The outer form keeps Spark from pushing a test for empty arrays, and with it the splitting, below the projection.
    runs = words.select("doc_id", "text_hash", F.size("words").alias("size"), F.posexplode_outer(shingles(F.col("words"), width)).alias("at", "h"))
    hits = reduce(DataFrame.unionByName, [runs.join(F.broadcast(placed.where(F.pmod("h", F.lit(slices)) == k)), "h") for k in range(slices)])
    text = ["doc_id", "text_hash", "item", "length", "size"]
    # A set: rows that repeat id and text count once.
    enough = hits.groupBy(*text).agg(F.collect_set(F.struct("h", "c", "at")).alias("hits")).where(F.size("hits") >= needed(width))
    each = checkpointed(enough).select(*text, F.inline("hits")).groupBy(*text, "h", "c").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    span = F.expr(
        f"""transform(ats, (p, k) -> struct(greatest(0, p - length + {width}, IF(k >= c, get(ats, k - c) + 1, 0)) AS lo,
            least(p, greatest(0, size - length)) AS hi))"""
    )
    spans = each.select(*text, F.inline(span)).where("lo <= hi")
    ends = F.array(F.struct(F.col("lo").alias("start"), F.lit(1).alias("change")), F.struct((F.col("hi") + 1).alias("start"), F.lit(-1).alias("change")))
    steps = spans.select(*text, F.inline(ends)).groupBy(*text, "start").agg(F.sum("change").alias("change")).where("change <> 0")
    along = Window.partitionBy(*text).orderBy("start")
    counted = steps.withColumns({"shared": F.sum("change").over(along), "next": F.lead("change").over(along)})
    return counted.where((F.col("change") > 0) & (F.col("next") < 0) & (F.col("shared") >= needed(width))).select("doc_id", "text_hash", "start", "length").distinct()


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, text_hash, start, length, window, words``: item-sized windows at the peaks; ``window`` stands for the words."""
    widths = [r.width for r in items.select(F.least("length", F.lit(WIDTH)).alias("width")).distinct().orderBy("width").collect()]
    found = [peaks(docs, items.where(F.least("length", F.lit(WIDTH)) == width), width) for width in widths]
    if not found:
        return docs.select(
            "doc_id", F.lit(0).cast("long").alias("text_hash"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window"), F.array(F.lit("")).alias("words")
        ).where(F.lit(False))
    places = checkpointed(reduce(DataFrame.unionByName, found))
    if places.count() <= SLICE // 4:
        places = F.broadcast(places)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").alias("l")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash"))
    laid = texts.join(places.alias("r"), same).select("l.doc_id", "l.text_hash", "start", "length", F.slice(text_words(F.col("text")), F.col("start") + 1, F.col("length")).alias("words"))
    return laid.withColumn("window", F.md5(F.array_join("words", " ")))


def turned() -> Column:
    """Every pattern of up to ``TURNS`` bits of a block."""
    masks = [sum(1 << b for b in bits) for k in range(TURNS + 1) for bits in combinations(range(BLOCK_BITS), k)]
    return F.array(*map(F.lit, masks))


def verified(bodies: DataFrame, items: DataFrame) -> DataFrame:
    """``window, length, item_id, hamming, similarity`` of the windows (``window, length, words``) that hold an item."""
    printed = bodies.select("window", "length").join(fingerprints(bodies, "window", "words"), "window")
    probes = printed.withColumn("probe", F.explode(blocks(F.col("bits")))).select("length", "window", "bits", "probe.block", "probe.key")
    texts = checkpointed(items.groupBy("item", "length").agg(F.first("item_words").alias("item_words")))
    index = (
        texts.select("item", "length").join(checkpointed(fingerprints(texts, "item", "item_words").withColumnRenamed("bits", "item_bits")), "item")
        .withColumn("probe", F.explode(blocks(F.col("item_bits"))))
        .withColumn("turn", F.explode(turned()))
        .select("item", "length", "item_bits", "probe.block", F.col("probe.key").bitwiseXOR(F.col("turn")).alias("key"))
    )
    hamming = F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits")))
    near = probes.join(index, ["length", "block", "key"]).withColumn("hamming", hamming).where(F.col("hamming") <= RADIUS)
    pairs = checkpointed(near.select("window", "length", "item", "hamming").distinct())

    def bag(df: DataFrame, name: str, words: str, n: str) -> DataFrame:
        return df.select(name, F.explode(shingle_bag(F.col(words))).alias("h")).groupBy(name, "h").agg(F.count(F.lit(1)).alias(n))

    probed = bodies.join(pairs.select("window").distinct(), "window", "left_semi")
    weights = pairs.join(bag(probed, "window", "words", "a"), "window").join(bag(texts, "item", "item_words", "b"), ["item", "h"])
    both = weights.groupBy("window", "item").agg(F.sum(F.least("a", "b")).alias("both"))
    shingle_count = lambda words: F.greatest(F.size(words) - (WIDTH - 1), F.lit(1))
    sizes = pairs.join(probed.select("window", shingle_count("words").alias("a")), "window").join(texts.select("item", shingle_count("item_words").alias("b")), "item")
    counted = sizes.join(both, ["window", "item"]).withColumn("all", F.col("a") + F.col("b") - F.col("both"))
    held = counted.where(100 * F.col("both") >= PERCENT * F.col("all"))
    return held.join(items.select("item", "item_id"), "item").select("window", "length", "item_id", "hamming", (F.col("both") / F.col("all")).alias("similarity"))


def leaking_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_hash, start, item_id, similarity, hamming`` of every laid window that holds an item."""
    items = checkpointed(item_table(benchmark))
    laid = checkpointed(windows(docs, items))
    bodies = checkpointed(laid.groupBy("window", "length").agg(F.first("words").alias("words")))
    held = checkpointed(verified(bodies, items))
    return laid.drop("words").join(held, ["length", "window"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity, start, hamming``: the best window for each document and item it holds."""
    each = leaking_windows(docs, benchmark)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), (-F.col("hamming")).alias("apart")))
    return each.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.before")).alias("start"), (-F.col("best.apart")).alias("hamming")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the documents whose ``doc_id`` no text that holds an item has; rows without an id count as one id."""
    held = leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_doc")).distinct()
    return docs.join(held, docs["doc_id"].eqNullSafe(held["leaked_doc"]), "left_anti")


def decontaminate_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the rows whose own text holds no item, whatever other rows have the same ``doc_id`` or none."""
    held = leaking_windows(docs, benchmark).select(F.col("doc_id").alias("leaked_doc"), F.col("text_hash").alias("leaked_text")).distinct()
    same = docs["doc_id"].eqNullSafe(held["leaked_doc"]) & (F.xxhash64(docs["text"]) == held["leaked_text"])
    return docs.join(held, same, "left_anti")
