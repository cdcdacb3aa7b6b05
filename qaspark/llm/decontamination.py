"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check.

A document's windows have as many words as a benchmark item and start at every word, up to the last that fits; a text shorter than
the item is one window. A window gets a 64-bit fingerprint: the bits that most of its five-word shingles have. The fingerprint is
cut into ``BLOCKS`` blocks; two fingerprints within ``RADIUS`` bits agree in some block up to RADIUS // BLOCKS bits, so a join on
(size, block, value), with the items' blocks entered under every value that near, guarantees all of them, and brings together about
a quarter of the pairs of equal size. Those within the radius are then checked exactly: shared weight over total weight of the two
shingle bags, each shingle weighted by how often it occurs. All windows of at least the given similarity are reported.

Windows that share no shingle with any item of their size have similarity 0 with all of them: they are left out before
fingerprints are made, which loses nothing. At similarity 0.8 fingerprints lie 10 bits apart in the mean (standard deviation 3), so
a radius of 17 keeps more than 99 in 100 such windows, and nearly all more similar ones.

Everything is Spark SQL functions and joins. The benchmark side is broadcast only after its rows have been counted, without the
items' shingles: these are joined to what the search has found.

Edge cases: null texts and texts without words match nothing; an item of fewer than five words is one shingle and matches windows
equal to it; items of equal text all match; texts of any length are searched whole; repeated rows are reported once; rows of one id
with different texts are all searched; windows of equal similarity, also of one document, are all reported; rows without an id are kept and not reported; an empty benchmark or an empty table gives no
matches; extra columns, of whatever name, are ignored by ``leaks`` and kept by ``without_leaks``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import checkpointed, let, small_or_shuffled, words
from qaspark.llm.fingerprints import shingle_hashes

SHINGLE = 5
BITS, BLOCKS, RADIUS = 64, 6, 17
#: First bit and width of each block.
_CUTS = [(i * BITS // BLOCKS, (i + 1) * BITS // BLOCKS - i * BITS // BLOCKS) for i in range(BLOCKS)]
SIMILARITY = 0.8


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint of a bag of shingle hashes: each bit by majority, every occurrence counting once."""
    n = F.size(hashes)

    def bit(b: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
        ones = F.aggregate(hashes, F.lit(0), lambda s, x: s + (x.bitwiseAND(mask) != 0).cast("int"))
        return F.when(2 * ones > n, mask).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(bit(b)))


def _block(fingerprint: Column, at: int, width: int) -> Column:
    return F.shiftright(fingerprint, at).bitwiseAND(F.lit(2**width - 1)).cast("int")


def blocks(fingerprint: Column) -> Column:
    """The fingerprint's blocks as structs (block, value)."""
    return F.array(*[F.struct(F.lit(i).alias("block"), _block(fingerprint, *cut).alias("value")) for i, cut in enumerate(_CUTS)])


def nearby_blocks(fingerprint: Column) -> Column:
    """Structs (block, value) of all values that differ from the fingerprint's blocks in at most RADIUS // BLOCKS bits."""


    def flipped(block: int, at: int, width: int) -> Column:
        masks = [sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), r)]
        value = lambda m: _block(fingerprint, at, width).bitwiseXOR(m)
        return F.transform(F.expr(f"array({','.join(map(str, masks))})"), lambda m: F.struct(F.lit(block).alias("block"), value(m).alias("value")))

    return F.concat(*[flipped(i, *cut) for i, cut in enumerate(_CUTS)])


def weight_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle bags: sum of smaller counts over sum of larger counts."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return shared / (F.size(a) + F.size(b) - shared)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, size (words), k (words in a shingle) and the shingle hashes of every item with words."""
    text = F.lower(F.coalesce("text", F.lit("")))
    rows = benchmark.select("item_id", F.size(words(text)).alias("size"), shingle_hashes(text).alias("bag"))
    return rows.where("size > 0").withColumn("k", F.least("size", F.lit(SHINGLE)))


def _run_hashes(text: Column, k: int) -> Column:
    """Hashes of the runs of exactly ``k`` words: none for fewer words."""
    hashes = shingle_hashes(text, k)
    return hashes if k == 1 else F.when(F.size(words(text)) >= k, hashes).otherwise(F.expr("cast(array() as array<bigint>)"))


def _windows(hits: Column, n: Column, k: int) -> Column:
    """Structs (start, size) of the item-sized windows that hold some hit (pos, size), in a text of ``n`` shingles."""

    def starts(hit: Column) -> Column:
        further = hit["size"] - k
        last = F.greatest(n - further - 1, F.lit(0))  # 0: the whole of a shorter text
        each = F.sequence(F.greatest(hit["pos"] - further, F.lit(0)), F.least(hit["pos"], last))
        return F.transform(each, lambda s: F.struct(s.alias("start"), hit["size"].alias("size")))

    return F.array_distinct(F.flatten(F.transform(hits, starts)))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Every window like an item: doc_id, item_id, start and size (in words; the size is the item's), distance (bits) and similarity."""
    items = checkpointed(_items(benchmark).withColumn("item_print", simhash(F.col("bag"))))
    text = F.lower(F.coalesce("text", F.lit("")))
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("kind"), text.alias("text"))
    key = ["doc_id", "kind"]
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).cast("int")
    found = None
    for k in sorted(r["k"] for r in items.select("k").distinct().collect()):  # 1 to 5
        of_size = items.where(F.col("k") == k)
        entries = checkpointed(of_size.select("size", F.explode("bag").alias("hash")).distinct())
        runs = docs.select(*key, F.posexplode(_run_hashes(F.col("text"), k)).alias("pos", "hash"))
        hits = runs.join(small_or_shuffled(entries), "hash").select(*key, "size", "pos").distinct()
        wanted = checkpointed(hits.groupBy(*key).agg(F.collect_list(F.struct("pos", "size")).alias("wanted")))
        bags = docs.join(small_or_shuffled(wanted, array="wanted"), key).select(*key, "wanted", _run_hashes(F.col("text"), k).alias("whole"))
        one = bags.select(*key, "whole", F.explode(_windows(F.col("wanted"), F.size("whole"), k)).alias("w"))
        one = one.select(*key, "w.start", "w.size", F.slice("whole", F.col("w.start") + 1, F.col("w.size") - k + 1).alias("bag"))
        one = checkpointed(one.withColumn("print", simhash(F.col("bag"))))

        near = of_size.select("item_id", "size", "item_print", F.explode(nearby_blocks(F.col("item_print"))).alias("b")).select("item_id", "size", "item_print", "b.block", "b.value")
        windows = one.select(*key, "start", "size", "bag", "print", F.explode(blocks(F.col("print"))).alias("b")).select(*key, "start", "size", "bag", "print", "b.block", "b.value")
        pairs = windows.join(small_or_shuffled(checkpointed(near)), ["size", "block", "value"]).where(distance <= RADIUS)
        pairs = checkpointed(pairs.groupBy(*key, "item_id", "start", "size").agg(F.first(F.struct("bag", distance.alias("distance"))).alias("p")))
        bag_of = checkpointed(of_size.groupBy("item_id", "size").agg(F.collect_set("bag").alias("item_bags")))
        likeness = F.array_max(F.transform("item_bags", lambda b: weight_similarity(F.col("p.bag"), b)))
        pairs = pairs.join(small_or_shuffled(bag_of.withColumn("width", F.flatten("item_bags")), array="width").drop("width"), ["item_id", "size"])
        part = pairs.select("doc_id", "item_id", "start", "size", "p.distance", likeness.alias("similarity"))
        part = checkpointed(part.where(F.col("similarity") >= similarity).distinct())
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.join(items, F.lit(False)).select("doc_id", "item_id", F.lit(0).alias("start"), "size", F.lit(0).alias("distance"), F.lit(0.0).alias("similarity"))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay."""
    gone = checkpointed(leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(small_or_shuffled(gone), "doc_id", "left_anti").select(docs.columns)
