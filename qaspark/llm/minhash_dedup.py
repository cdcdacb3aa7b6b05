"""MinHash near-dedup with an LSH forest.

Each distinct shingle set gets a signature. The forest is ``ORDERS`` sorted orders of the sets, each by its own run of signature
values: neighbours in an order share the longest prefixes there are, so every region is searched as deep as it is dense (down to
``KEY`` values), with no bucket ever gathered. Neighbours that a small sketch calls similar are candidates; links are confirmed on
the full sets. First every set is checked against its best smaller candidate; of the other candidates, likeliest first, only those
between groups still separate need a check. Components are found by joins. The orders are searched in steps: from the second on, the
groups so far are known, and neighbours of one group are no candidates any more. So the candidates of a dense group come from the
few orders of the first step.

An order shows each set at most ``REACH`` neighbours to each side. What that hides is a set with very many partners that are not
partners of each other, as an original with thousands of copies edited each in its own way. Such sets, hubs, have many confirmed
links already. So in every region (sets with the same first ``REGION`` values of an order) that holds several groups, the set with most links is
compared with all others, then the next one, for as long as that joins groups. Each round costs one join, linear in the sets.

Edge cases: a null text counts as empty; rows with an empty set are linked with nothing; rows without an id keep no component;
rows of equal sets (repeated rows too) form one class; an id with different texts is linked through any of them; a set of any size
is signed and compared whole; equally likely candidates are taken by id; an empty table gives no rows; extra columns, of whatever
name, are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaspark.llm.common import checkpointed, join_by_key, small_batches, small_or_shuffled, written
from qaspark.llm.components import components, relabelled, roots
from qaspark.llm.shingling import mix, pair_set

#: Sorted orders, signature values that each order starts with before it shares values, and values in a sort key: the first REGION
#: of them with two bytes each, the others with one.
ORDERS, OWN, KEY, REGION = 20, 6, 8, 4
KEY_BYTES = KEY + REGION
VALUES = ORDERS * OWN
#: Orders up to which each step searches.
STEPS = (3, 9, ORDERS)
#: Neighbours looked at in each order, to each side; they share the first value at least.
REACH = 8
#: Four-bit sketch values, and how many must agree: far below what a similarity of 0.8 gives (52, deviation 3).
SKETCH, AGREE = 64, 38
#: After the best candidates, the others are checked in bands of agreement, the likeliest first: each band joins groups, and pairs
#: inside a group need no check. The last band ends at AGREE.
BANDS = (50, 44, AGREE)

_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHIFTS = mix(_SEEDS)
_AT = (np.arange(ORDERS)[:, None] * OWN + np.arange(KEY)) % VALUES


def signature(items: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(items), 2048):
            least = np.minimum(least, (items[i : i + 2048, None] * _SEEDS + _SHIFTS).min(0))
    return mix(least)


def _describe(text: str | None) -> tuple:
    items = pair_set(text)
    if not len(items):
        return 0, None, None, None
    s = signature(items)
    values = s.astype(">u2")[_AT]
    keys = np.hstack([values[:, :REGION].copy().view(np.uint8), (values[:, REGION:] & 255).astype(np.uint8)])
    half = ((s[:SKETCH] >> np.uint64(20)) & np.uint64(15)).astype(np.uint8)
    return len(items), xxhash.xxh3_128_digest(items.tobytes()), keys.tobytes(), (half[::2] << 4 | half[1::2]).tobytes()


@F.pandas_udf(T.StructType().add("n", T.LongType()).add("kind", T.BinaryType()).add("keys", T.BinaryType()).add("sketch", T.BinaryType()))
def describe(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_describe(t) for t in texts], columns=["n", "kind", "keys", "sketch"])


@F.pandas_udf(T.BinaryType())
def full_set(texts: pd.Series) -> pd.Series:
    return pd.Series([pair_set(t).tobytes() for t in texts], dtype=object)


@F.pandas_udf(T.BooleanType())
def linked(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * intersection >= 80 * union, on whole sets."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True)) if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) else 0
        out.append(100 * both >= 80 * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def _matrix(column, kind, width) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, width)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many sketch values agree, row by row."""
    differ = a ^ b
    return ((differ & 15) == 0).sum(1) + ((differ >> 4) == 0).sum(1)


@F.pandas_udf(T.IntegerType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_agreement(_matrix(a, np.uint8, SKETCH // 2), _matrix(b, np.uint8, SKETCH // 2))).astype("int32")


def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Similar neighbours within one sorted partition, and the partition's first and last rows (``id`` set) for the borders."""
    tail: pd.DataFrame | None = None
    first = True
    for b in batches:
        if first and len(b):
            yield b.head(REACH).assign(a=None, b=None, agree=None)
            first = False
        rows = b if tail is None else pd.concat([tail, b], ignore_index=True)
        if len(rows):
            yield pairs_within(rows)
            tail = rows.tail(REACH)
    if tail is not None:
        yield tail.assign(a=None, b=None, agree=None)


def pairs_within(rows: pd.DataFrame) -> pd.DataFrame:
    order, ids = rows["order"].to_numpy(), rows["id"].to_numpy()
    roots = rows["root"].to_numpy()
    keys, sketch = _matrix(rows["key"], np.uint8, KEY_BYTES)[:, :2], _matrix(rows["sketch"], np.uint8, SKETCH // 2)
    found = []
    for step in range(1, min(REACH, len(rows) - 1) + 1):
        near = (order[step:] == order[:-step]) & (keys[step:] == keys[:-step]).all(1) & (roots[step:] != roots[:-step])
        i = np.flatnonzero(near)
        agree = _agreement(sketch[i], sketch[i + step])
        i, agree = i[agree >= AGREE], agree[agree >= AGREE]
        found.append((np.minimum(ids[i], ids[i + step]), np.maximum(ids[i], ids[i + step]), agree))
    a, b, agree = (np.concatenate(x) if found else np.zeros(0) for x in (zip(*found, strict=True) if found else ([], [], [])))
    out = pd.DataFrame({"a": a, "b": b, "agree": agree}).drop_duplicates()
    return out.assign(order=None, key=None, id=None, sketch=None, root=None)[["order", "key", "id", "sketch", "root", "a", "b", "agree"]]


_SORTED = "order int, key binary, id long, sketch binary, root long"


def in_orders(sets: DataFrame, size: int, first: int = 0, stop: int = ORDERS) -> DataFrame:
    """order, key (its first ``size`` bytes) and the columns of ``sets`` but its keys, of each set in each of the orders."""
    orders = F.transform(F.sequence(F.lit(first), F.lit(stop - 1)), lambda i: F.struct(i.alias("order"), F.substring("keys", i * KEY_BYTES + 1, F.lit(size)).alias("key")))
    own = [c for c in sets.columns if c != "keys"]
    return sets.select(*own, F.explode(orders).alias("o")).select("o.order", "o.key", *own)


def candidates(sets: DataFrame, first: int = 0, stop: int = ORDERS) -> DataFrame:
    """(a, b, agree), a < b: similar neighbours of different roots in some order. ``sets`` has id, keys, sketch and root.

    Every order is sorted by range partitions. Pairs across a border come from the rows at the borders, a few for each partition.
    """
    rows = in_orders(sets.select("id", "sketch", "root", "keys"), KEY_BYTES, first, stop)
    schema = f"{_SORTED}, a long, b long, agree int"
    sort = ("order", "key", "id")
    found = checkpointed(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInPandas(neighbours, schema))
    borders = found.where("id is not null").select("order", "key", "id", "sketch", "root").distinct()
    across = borders.repartitionByRange(1, *sort).sortWithinPartitions(*sort).mapInPandas(neighbours, schema)
    return found.union(across).where("a is not null and a <> b").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that are links, checked on the full sets of the two documents' texts."""
    ids = checkpointed(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = checkpointed(docs.select("doc_id", "text").join(small_or_shuffled(ids), "doc_id").dropDuplicates(["doc_id", "text"]).select("doc_id", full_set("text").alias("_set")))
    one, other = (sets.select(F.col("doc_id").alias(e), F.col("_set").alias(f"_{e}")) for e in "ab")
    return pairs.join(one, "a").join(other, "b").where(linked("_a", "_b")).select("a", "b").distinct()


def joined(docs: DataFrame, pairs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labels (node, root) after the links among those pairs whose ends are still in different groups, and these links (a, b)."""
    apart = relabelled(pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), labels)
    apart = checkpointed(apart.select("a", "b", "x", "y"))
    links = checkpointed(confirmed(docs, apart.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    upper = components(apart.join(links.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"]).select("a", "b"))
    top = upper.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    moved = labels.join(top, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return checkpointed(moved.union(upper.select("node", "root"))), links  # the nodes of upper were roots, which have no label


def joined_by_hubs(docs: DataFrame, sets: DataFrame, found: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels after comparing hubs with all sets of their regions. ``found`` are all candidates, ``links`` the confirmed ones."""
    ends = links.select(F.col("a").alias("id")).unionAll(links.select("b"))
    hubs = checkpointed(ends.groupBy("id").agg(F.count(F.lit(1)).alias("links")).where(F.col("links") >= REACH))
    if hubs.isEmpty():
        return labels
    region = ["order", "key"]
    similar = found.select(F.col("a").alias("id")).unionAll(found.select("b")).distinct()
    members, drop_members = written(in_orders(sets.select("id", "sketch", "keys").join(similar, "id", "left_semi"), 2 * REGION))
    hubs = checkpointed(members.join(small_or_shuffled(hubs), "id").select(*region, F.col("id").alias("hub"), F.col("sketch").alias("hub_sketch"), F.struct("links", -F.col("id")).alias("rank")))
    group = members.join(hubs.select(*region).distinct(), region, "left_semi").join(labels.select(F.col("node").alias("id"), "root"), "id", "left")
    group = group.groupBy(*region).agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("root", "id")).alias("_least"), F.max(F.coalesce("root", "id")).alias("_most"))
    group = group.where((F.col("n") > REACH) & (F.col("_least") < F.col("_most"))).select(*region, "n")
    tried = checkpointed(group.withColumn("last", F.lit(None).cast(hubs.schema["rank"].dataType)))
    while not tried.isEmpty():
        best = F.max_by(F.struct("hub", "hub_sketch", "rank"), "rank").alias("h")
        now = tried.join(hubs, region).where(F.col("last").isNull() | (F.col("rank") < F.col("last"))).groupBy(*region, "n").agg(best)
        now, drop_now = written(now.select(*region, "n", "h.*"))
        near = join_by_key(members, now, region, "n").where((F.col("id") != F.col("hub")) & (agreement("sketch", "hub_sketch") >= AGREE))
        near, drop_near = written(near.select(*region, F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")))
        labels, new = joined(docs, near.select("a", "b").distinct(), labels)
        gained = near.join(new, ["a", "b"], "left_semi").select(*region).distinct()
        tried = checkpointed(now.join(gained, region, "left_semi").select(*region, "n", F.col("rank").alias("last")))
        drop_now()
        drop_near()
    drop_members()
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = checkpointed(docs.select("doc_id", describe("text").alias("d")).select("doc_id", "d.*"))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("kind").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = checkpointed(classes)
    found = checkpointed(candidates(classes.withColumn("root", F.col("id")), 0, STEPS[0]))

    best = F.max_by("a", F.struct(F.least("agree", F.lit(54)), -F.col("a")))
    first = checkpointed(found.groupBy("b").agg(best.alias("a")).select("a", "b"))
    links = checkpointed(confirmed(docs, first))
    labels = roots(links.select(F.col("b").alias("node"), F.col("a").alias("parent")))
    others = found.join(first, ["a", "b"], "left_anti")
    for least, below in zip(BANDS, (SKETCH + 1, *BANDS), strict=False):
        labels, new = joined(docs, others.where((F.col("agree") >= least) & (F.col("agree") < below)), labels)
        links = links.unionAll(new)
    for start, stop in zip(STEPS, STEPS[1:], strict=False):
        rooted = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        pairs = checkpointed(candidates(rooted, start, stop))
        labels, new = joined(docs, pairs, labels)
        found, links = found.unionAll(pairs), links.unionAll(new)
    labels = joined_by_hubs(docs, classes, found, links, labels)

    group = classes.join(labels, classes["id"] == labels["node"], "left").select("kind", F.coalesce("root", "id").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "kind").join(group, "kind", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; rows without an id stay."""
    gone = checkpointed(near_duplicates(docs).where("not kept").select("doc_id").distinct())
    return docs.join(small_or_shuffled(gone), "doc_id", "left_anti").select(docs.columns)
