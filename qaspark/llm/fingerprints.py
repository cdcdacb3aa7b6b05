"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Every shingle of five words is hashed once; the top bits of the hash choose a bin, the smallest hash of each bin stays. Empty bins
copy a filled bin, found along a fixed pseudo-random order of the bins that is the same for all texts. Each bin keeps its low
eight bits; likeness is the share of equal bins, corrected for the 2**-8 that agree by chance. All of it is Spark SQL
functions: the array functions run per row, nothing is exploded, and the only shuffle brings neighbouring ids together.

Edge cases: a null text counts as empty; an empty text (or one without words) has the fingerprint "", which is fully like itself
and not like any other; a text of fewer than five words is one shingle. Null ids sort below all others. Rows of one id are
ordered by the hash of their text, and rows that repeat are each other's next. A text of any length is hashed whole. The only row of
a table is its own next row; an empty table gives no rows; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.llm.common import let, words

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
#: Rows that share a window, and the most windows that ids are cut into.
RANGE_ROWS = 1000
RANGES = 1024


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def _constant(value, kind: str) -> Column:
    """A nested array constant; folded to a literal once, when the query is planned."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """One 64-bit hash for each run of ``k`` words; for fewer words, one of the whole sequence; none without words."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        every = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))  # past the end: nulls, cut off
        return F.when(F.size(h) < k, F.slice(every, 1, 1)).otherwise(F.slice(every, 1, F.greatest(F.size(h) - (k - 1), F.lit(1))))

    return let(hashed, runs)


def sketch(hashes: Column) -> Column:
    """The densified bins' low bits, as an array of BINS ints; empty for no hashes."""
    shift = 64 - BIN_BITS
    last = [((b - BINS // 2 + 1) << shift) - 1 for b in range(BINS)]  # largest hash of each bin: stands for an empty bin
    ends = _constant(last, "array<bigint>")
    order = [sorted(range(BINS), key=lambda j: _splitmix(b * BINS + j)) for b in range(BINS)]  # noqa: B023
    orders = _constant(order, "array<array<int>>")

    def bins(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(h, i - 1), shift)))

    def densify(h: Column) -> Column:
        filled = lambda i: F.get(h, i) != F.get(ends, i)
        donor = lambda i: F.get(h, F.get(F.filter(F.get(orders, i), filled), F.lit(0)))
        return F.when(F.exists(F.zip_with(h, ends, lambda x, e: x == e), lambda q: q), F.transform(h, lambda x, i: F.when(x == F.get(ends, i), donor(i)).otherwise(x))).otherwise(h)

    sorted_hashes = F.sort_array(F.concat(hashes, ends))
    low = let(let(sorted_hashes, bins), lambda d: F.transform(densify(d), lambda x: x.bitwiseAND(F.lit(2**LOW_BITS - 1)).cast("int")))
    return F.when(F.size(hashes) > 0, low).otherwise(F.expr("cast(array() as array<int>)"))


def packed(bins: Column) -> Column:
    """Two hex digits for each bin."""
    digits = _constant([f"{v:02x}" for v in range(2**LOW_BITS)], "array<string>")
    return F.array_join(F.transform(bins, lambda x: F.get(digits, x)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1."""
    chance = 2.0**-LOW_BITS
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    both = F.greatest((equal - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise((F.size(a) == F.size(b)).cast("double"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced from the next lower id's text).

    Ids are cut at approximate quantiles into ranges, so that the rows next to each other meet in bounded windows. The first
    row of each range also stands, as a ghost, at the end of the range above it.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count = rows.count()
    ranges = max(1, min(RANGES, count // RANGE_ROWS))
    bounds = []
    if ranges > 1:
        got = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
        bounds = sorted(set(got))
    cut = _constant(bounds, "array<bigint>")
    rows = rows.withColumn("_range", F.coalesce(F.size(F.filter(cut, lambda b: b < F.col("doc_id"))), F.lit(0)))

    tops = rows.groupBy("_range").agg(F.max("doc_id").alias("_top"))  # at most RANGES + 1 rows
    ring = Window.orderBy("_range")
    above = F.coalesce(F.lead("_range").over(ring), F.first("_range").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.select(F.col("_range").alias("_of"), F.col("_top"), above.alias("_to"))
    ghosts = rows.join(F.broadcast(tops), F.col("_top").eqNullSafe(F.col("doc_id")) & (F.col("_of") == F.col("_range"))).select("doc_id", "text", F.col("_to").alias("_range"), F.lit(True).alias("_ghost"))
    rows = rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts)

    order = Window.partitionBy("_range").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    rows = rows.withColumn("_next", F.lead("text", 1, "").over(order))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.select(
        "doc_id",
        "text",
        "_range",
        "_ghost",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - third), F.substring("_next", F.lit(1), third)).alias("_edited"),
    )
    own, edited = sketch(shingle_hashes(F.col("text"))), sketch(shingle_hashes(F.col("_edited")))
    rows = rows.withColumn("_own", own).withColumn("_next_own", F.lead("_own").over(order)).where(~F.col("_ghost")).withColumn("_edit", edited)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("_own")).alias("fingerprint"),
        packed(F.col("_edit")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edit")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next_own")).alias("near_next"),
    )
