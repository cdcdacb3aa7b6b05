"""Conversation prefix trie by parallel tree contraction.

``rebuilt`` puts the conversations together: the first turns of the conversation that opens a hundred, then the own turns. Every
distinct sequence of first turns is a node of the trie. A turn's number comes from range partitions (``numbered``), and the digest of
a prefix is the sum of its turns' digests, each taken with its depth, in four parts of 32 bits: running sums inside blocks of turns,
then over the blocks' totals, so that a conversation of any length is spread over many tasks.

``subtree_totals`` contracts the tree in rounds of joins. Compress: every maximal chain of nodes with one child each is doubled into a
pointer to the node below the chain, with what the chain adds; that node then hangs below the node above the chain. Rake: all leaves
hand their totals to their parents, summed per parent before the shuffle, and leave the tree. Without chains half of a tree's nodes
are leaves, so the rounds are at most logarithmic in the nodes, and a chain of n turns takes log n joins. When the root is raked, the
chains are expanded again, latest round first: a node's total is that of the node below its chain plus what lies between.

Member ids are joined in blocks of 4096 neighbouring ids by many tasks; SHA-256 has to run over them in order, so the blocks of one
node stream through one hash, in bounded memory.

Edge cases: rows without a conv_id belong to no conversation; a null turn comes first, a null role or text is empty; turns of equal
number stand in the order of their role, then of the MD5 of their text; repeated rows are turns of their own; texts of any length
enter by their digest and length; a conversation that has lost all its turns is a member of the root; an empty table gives no rows;
extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions.tables import numbered
from qaspark.llm.common import checkpointed, join_by_key, small_batches

#: Conversations are rebuilt in groups of so many neighbouring ids, with fewer than HEAD_TURNS turns of the group's first one.
GROUP = 100
HEAD_TURNS = 6
#: Turns in a block of running sums, and, as a power of two, neighbouring ids in a block of joined ids.
BLOCK_TURNS = 1024
BLOCK_ID_BITS = 12
SUMS = [f"s{i}" for i in range(4)]


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one that opens its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD_TURNS).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, turn_md5, len) of the rebuilt conversations, and (conv_id, length) of each, also without turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        "turn",
        role.alias("role"),
        F.md5(text.cast("binary")).alias("text_md5"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("turn_md5"),
        F.length(text).cast("long").alias("len"),
    )
    turns = numbered(turns, ["conv_id"], ["turn", "role", "text_md5"], "at").select("conv_id", F.col("at").cast("long"), "turn_md5", "len")
    turns = checkpointed(turns)
    counts = checkpointed(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    bases = counts.where(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base"), F.least("n", F.lit(HEAD_TURNS)).cast("int").alias("_n"))
    whole = counts.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), head_turns(F.col("conv_id")).alias("h"))
    whole = whole.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("_n", F.lit(0)))).drop("_n")
    whole = checkpointed(whole.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    heads = turns.where(f"conv_id % {GROUP} = 0 and at < {HEAD_TURNS}").withColumnRenamed("conv_id", "base")
    first = whole.where("head > 0").join(heads, "base").where("at < h").select("conv_id", (F.col("at") + 1).alias("depth"), "turn_md5", "len")
    own = join_by_key(turns, whole.select("conv_id", "n", "h", "head"), ["conv_id"], "n").where("at >= h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("head") + 1).alias("depth"), "turn_md5", "len")
    return first.unionByName(own), whole.select("conv_id", "length")


def _id(depth: Column, *sums: Column) -> Column:
    """A node's id: 128 bits of its depth and the four sums."""
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))


def root_id() -> Column:
    return _id(F.lit(0), *[F.lit(0)] * 4)


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with id and parent (both binary) of the node that each turn reaches."""
    element = F.md5(F.concat_ws(":", "depth", "turn_md5").cast("binary"))
    part = lambda i: F.conv(F.substring(element, 8 * i + 1, 8), 16, 10).cast("long")
    rows = turns.select("*", F.floor(F.col("depth") / BLOCK_TURNS).alias("block"), *[part(i).alias(f"e{i}") for i in range(4)])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(f"e{i}").alias(f"e{i}") for i in range(4)])
    totals = totals.select("conv_id", "block", *[F.sum(f"e{i}").over(before).alias(f"c{i}") for i in range(4)]).where("c0 is not null")
    rows = rows.select("*", *[F.sum(f"e{i}").over(inside).alias(s) for i, s in enumerate(SUMS)]).join(totals, ["conv_id", "block"], "left")
    rows = rows.select("*", *[(F.col(s) + F.coalesce(f"c{i}", F.lit(0))).alias(f"t{i}") for i, s in enumerate(SUMS)])
    here = _id(F.col("depth"), *[F.col(f"t{i}") for i in range(4)])
    up = _id(F.col("depth") - 1, *[F.col(f"t{i}") - F.col(f"e{i}") for i in range(4)])
    return rows.select(*turns.columns, here.alias("id"), up.alias("parent"))


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, *values) summed over every node's subtree; ``tree`` has id, parent (null at roots) and long values.

    A live node has gathered ``values`` so far and owes ``_up_*``, what compressed chains add on the way to its parent.
    """
    ups = [f"_up_{v}" for v in values]
    live = checkpointed(tree.select("id", "parent", *values, *[F.lit(0).cast("long").alias(u) for u in ups]))
    done, chains = [], []
    while not live.isEmpty():
        live, spliced = compress(live, values, ups)
        if spliced is not None:
            chains.append(spliced)
        parents = live.where("parent is not null").select(F.col("parent").alias("id")).distinct()
        live = checkpointed(live.join(parents.withColumn("_inner", F.lit(True)), "id", "left"))
        leaves = live.where("_inner is null")
        done.append(leaves.select("id", *values))
        gifts = leaves.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(*[F.sum(F.col(v) + F.col(u)).alias(f"_gift_{v}") for v, u in zip(values, ups, strict=True)])
        added = [(F.col(v) + F.coalesce(f"_gift_{v}", F.lit(0))).alias(v) for v in values]
        live = checkpointed(live.where("_inner").join(gifts, "id", "left").select("id", "parent", *added, *ups))
    known = tree.select("id", *values).limit(0)
    for part in done:
        known = known.unionByName(part)
    for spliced in reversed(chains):
        below = known.select(F.col("id").alias("_to"), *[F.col(v).alias(f"_below_{v}") for v in values])
        found = spliced.join(below, "_to").select("id", *[(F.col(f"_off_{v}") + F.col(f"_below_{v}")).alias(v) for v in values])
        known = known.unionByName(checkpointed(found))
    return known


def compress(live: DataFrame, values: list[str], ups: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``live`` without its chains of nodes with one child, and those nodes (id, _to, _off_*): total = that of _to + _off."""
    only = live.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("_kids"), F.min(F.struct("id", *ups)).alias("_child"))
    unary = live.where("parent is not null").join(only.where("_kids = 1"), "id")
    unary = checkpointed(unary.select("id", "parent", *ups, F.col("_child.id").alias("_to"), *[(F.col(v) + F.col(f"_child.{u}")).alias(f"_off_{v}") for v, u in zip(values, ups, strict=True)]))
    if unary.isEmpty():
        return live, None
    inner = unary.select(F.col("_to").alias("id"), F.lit(True).alias("_below"))
    chain = checkpointed(unary.join(inner, "id", "left").select("*", F.lit(True).alias("_moved")))
    while not chain.where("_moved").isEmpty():
        jump = chain.select(F.col("id").alias("_to"), F.col("_to").alias("_next"), *[F.col(f"_off_{v}").alias(f"_more_{v}") for v in values])
        offs = [(F.col(f"_off_{v}") + F.coalesce(f"_more_{v}", F.lit(0))).alias(f"_off_{v}") for v in values]
        chain = chain.drop("_moved").join(jump, "_to", "left")
        chain = checkpointed(chain.select("id", "parent", *ups, "_below", F.coalesce("_next", "_to").alias("_to"), *offs, F.col("_next").isNotNull().alias("_moved")))
    tops = chain.where("_below is null").select(F.col("_to").alias("id"), F.col("parent").alias("_parent"), *[(F.col(f"_off_{v}") + F.col(u)).alias(f"_new{u}") for v, u in zip(values, ups, strict=True)])
    rest = live.join(unary.select("id"), "id", "left_anti").join(tops, "id", "left")
    rest = rest.select("id", F.coalesce("_parent", "parent").alias("parent"), *values, *[F.coalesce(f"_new{u}", u).alias(u) for u in ups])
    return checkpointed(rest), chain.select("id", "_to", *[f"_off_{v}" for v in values])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) from (id, conv_id): the hash of a node's decimal ids, ascending, comma-joined."""
    small_batches(ends.sparkSession)
    block = F.shiftright("conv_id", BLOCK_ID_BITS)
    pieces = ends.groupBy("id", block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, ids, shas = None, None, [], []
        for batch in batches:
            for node, piece in zip(batch.column("id").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if node != at:
                    if at is not None:
                        ids.append(at)
                        shas.append(state.hexdigest())
                    at, state = node, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(shas, pa.string())], ["id", "ends_sha256"])
            ids, shas = [], []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["id", "ends_sha256"])

    return pieces.repartition("id").sortWithinPartitions("id", "block").select("id", "piece").mapInArrow(digest, "id binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' trie.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (all long), ends_sha256.
    """
    turns, whole = rebuilt(conversations)
    reached = checkpointed(prefixes(turns).join(whole.select("conv_id", F.col("length").alias("depth"), F.lit(True).alias("_ends")), ["conv_id", "depth"], "left"))
    ends = reached.where("_ends").select("id", "conv_id").unionByName(whole.where("length = 0").select(root_id().alias("id"), "conv_id"))
    nodes = reached.groupBy("id").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("len").alias("len"))
    root = whole.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(root_id().alias("id"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("len"))
    nodes = nodes.unionByName(root)
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = checkpointed(nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = [F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("len")).alias("saved_tokens")]
    totals = subtree_totals(nodes.select("id", "parent", *own), ["n_leaves", "saved_tokens"])
    parents = nodes.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = join_by_key(nodes.where("parent is not null"), parents.withColumnRenamed("n_children", "_n"), ["parent"], "_n")
    top = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = below.unionByName(top).join(totals, "id").join(ends_digests(ends), "id", "left")
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
