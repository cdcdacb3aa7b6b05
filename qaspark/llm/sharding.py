"""Sharding by Karmarkar-Karp differencing: shards of near equal bytes, equal texts always together.

Differencing runs over a bounded number of items: every group of equal texts that is large against a shard is an item of its
own, the many small groups are bundled by hash into ``BUNDLES`` items. So the hot group of a skewed corpus is placed first and
the bundles fill up the other shards, and the differencing step never sees more than ``BUNDLES + GIANTS * shards`` rows.

Edge cases: a null text has no bytes and goes with the empty texts; null ids and repeated rows are placed like any row; items of equal
size are placed in order of their hash, so ties fall alike in every run; a text of any length is one row, and one that is larger
than a fair shard, as a group that is, can't be split, so its shard is larger; an empty table gives no rows; extra columns, of whatever
name, are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaspark.llm.common import checkpointed

#: Items that small groups are bundled into; a group of more than 1/(GIANTS * shards) of all bytes is an item itself.
BUNDLES = 4096
GIANTS = 64
#: Rows in a block of the slot numbering.
BLOCK_ROWS = 8192


def differencing(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item.

    Each item starts as a partial partition (its size, then zeros). The two partial partitions with the largest spread between
    their fullest and emptiest part are combined, fullest part with emptiest, until one is left. ``links`` keeps, for every
    combination, which part of each half went where; walking it backwards gives the items' parts.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=int)
    parts: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes):
        v = np.zeros(shards)
        v[0] = s
        parts[i] = v
        heap.append((-float(s), i))
    heapq.heapify(heap)
    links = []
    new = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        va, vb = parts.pop(a), parts.pop(b)
        v = va + vb[::-1]  # both in descending order, so the fullest part meets the emptiest
        order = np.argsort(-v, kind="stable")
        links.append((new, a, b, order))
        v = v[order]
        parts[new] = v
        heapq.heappush(heap, (-float(v[0] - v[-1]), new))
        new += 1
    place = {heap[0][1]: np.arange(shards)}
    for node, a, b, order in reversed(links):
        to = np.empty(shards, dtype=int)
        to[order] = place.pop(node)
        place[a], place[b] = to, to[::-1]
    return np.array([place[i][0] for i in range(n)])


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = checkpointed(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("_key"),
        )
    )
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    giants = rows.groupBy("_key").agg(F.sum("size").alias("_bytes")).where(F.col("_bytes") * (GIANTS * shards) > total)
    giants = checkpointed(giants.select("_key", F.hex("_key").alias("_giant")))  # fewer than GIANTS * shards rows
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("_key"), F.lit(BUNDLES)).cast("string"))
    rows = rows.join(F.broadcast(giants), "_key", "left").withColumn("_item", F.coalesce("_giant", bundle)).drop("_giant")

    def place(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["_bytes", "_item"], ascending=[False, True], kind="stable")
        return pd.DataFrame({"_item": items["_item"], "shard": differencing(items["_bytes"].to_numpy(), shards)})

    items = rows.groupBy("_item").agg(F.sum("size").alias("_bytes"))  # bounded, see above
    placed = items.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(place, "_item string, shard int")
    rows = rows.join(F.broadcast(placed), "_item")

    blocks = max(1, -(-count // BLOCK_ROWS))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", "_key"), F.lit(blocks)))
    inside = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32")
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_block").count().select("shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_n", F.row_number().over(inside) - 1).join(starts, ["shard", "_block"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_start") + F.col("_n")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
