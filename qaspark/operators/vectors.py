"""Vectors: embedding, normalising, indexing, exact and approximate nearest neighbours, hybrid search and re-ranking.

Search packs base and queries into blocks of vectors and pairs block with block (one matrix product each). A task keeps the nearest k
of each query over all the blocks that it meets and emits them once, so what is shuffled for the last ranking grows with the tasks, not
with the blocks. Nothing is gathered in the driver, however many queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions.numbers import let
from qaspark.functions.tables import small_batches, stored, with_group_values
from qaspark.operators.cases import code_type
from qaspark.registry import query

#: About how many vectors a block holds. Search defaults: neighbours and least score.
BASE_BLOCK, QUERY_BLOCK = 8192, 1024
TOP_K, MIN_SCORE = 10, 0.3
#: Hits that a task keeps before it emits them.
HELD_HITS = 2_000_000

_HITS = "query_id long, index_name string, id long, distance double"


def blocks(vectors: DataFrame, key: str | None, size: int) -> DataFrame:
    """One row for about ``size`` vectors (id, vec) of equal ``key``: block, ids and vecs, the vectors' numbers one after another.

    Rows are dealt by hash, each key's into as many blocks as its own count needs. ``vectors`` is read twice.
    """
    keys = [key] if key else []
    rows = vectors.where("vec is not null").select(*keys, "id", F.col("vec").cast("array<float>").alias("vec"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if key:
        counts = counts.withColumn("_deals", F.ceil(F.col("_n") / size))
        rows = with_group_values(rows, counts, key, "_n")
    else:
        rows = rows.withColumn("_deals", F.lit(-(-counts.first()[0] // size) or 1))
    deal = F.pmod(F.xxhash64("id"), F.col("_deals"))
    packed = rows.withColumn("block", deal).groupBy(*keys, "block").agg(F.collect_list(F.struct("id", "vec")).alias("b"))
    return packed.select(*keys, "block", F.transform("b", lambda x: x["id"]).alias("ids"), F.flatten(F.transform("b", lambda x: x["vec"])).alias("vecs"))


class Nearest:
    """The nearest k of the queries of one block over the base blocks seen so far: ids and distances, ordered by (distance, id)."""

    def __init__(self, query_ids: np.ndarray, query_vecs: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.q = query_vecs.reshape(len(query_ids), -1).astype(np.float64)
        self.ids = np.zeros((len(query_ids), 0), dtype=np.int64)
        self.distances = np.zeros((len(query_ids), 0))

    def see(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], vecs.reshape(len(ids), -1).astype(np.float64)[order]
        d = np.round(np.maximum((self.q * self.q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * self.q @ v.T, 0), 6)
        best = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        d = np.concatenate((self.distances, np.take_along_axis(d, best, 1)), 1)
        ids = np.concatenate((self.ids, ids[best]), 1)
        order = np.lexsort((ids, d), axis=1)[:, : self.k]
        self.ids, self.distances = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)

    def hits(self, name: str) -> pd.DataFrame:
        n = self.ids.shape[1]
        return pd.DataFrame({"query_id": np.repeat(self.query_ids, n), "index_name": name, "id": self.ids.ravel(), "distance": self.distances.ravel()})


def local_hits(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, index_name, id, distance of the nearest k of each query within a task.

    ``pairs``: index_name, ids, vecs, query_block, query_ids and query_vecs. A task that holds too many hits emits what it has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Nearest] = {}
        size = 0
        for batch in batches:
            for name, ids, vecs, block, query_ids, query_vecs in batch.itertuples(index=False):
                if (name, block) not in held:
                    if size + len(query_ids) * k > HELD_HITS:
                        yield from (near.hits(key[0]) for key, near in held.items())
                        held, size = {}, 0
                    held[name, block] = Nearest(query_ids, query_vecs, k)
                    size += len(query_ids) * k
                held[name, block].see(ids, vecs)
        yield from (near.hits(key[0]) for key, near in held.items())

    small_batches(pairs.sparkSession)
    return pairs.select("index_name", "ids", "vecs", "query_block", "query_ids", "query_vecs").mapInPandas(run, _HITS)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """``hits`` of the nearest k, with rank (from 0; equal distances by id) and score."""
    rank = F.row_number().over(Window.partitionBy("query_id", "index_name").orderBy("distance", "id")) - 1
    return hits.withColumn("rank", rank).where(F.col("rank") < k).withColumn("score", 1 / (1 + F.col("distance")))


def asked_blocks(queries: DataFrame, key: str | None = None) -> DataFrame:
    found = blocks(queries, key, QUERY_BLOCK)
    return found.withColumnsRenamed({"block": "query_block", "ids": "query_ids", "vecs": "query_vecs"})


def nearest(base: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, index_name, id, distance (squared L2), score (1 / (1 + distance)) and rank (from 0) of each query's k nearest in each index.

    ``queries`` (id, vec) is a stated set. Every block of it meets every block of the base. Equal distances rank by id. Null vectors
    are left out.
    """
    pairs = blocks(base, "index_name", BASE_BLOCK).drop("block").crossJoin(asked_blocks(queries))
    return ranked(local_hits(pairs, k), k)


_QUERIES = "(SELECT id AS query_id, vec AS q FROM vectors WHERE id % 50 = 0)"
_DIST = "round(list_sum(list_transform(range(1, len(v.vec) + 1), lambda i: (v.vec[i]::DOUBLE - q.q[i]::DOUBLE) * (v.vec[i]::DOUBLE - q.q[i]::DOUBLE))), 6)"
SQL_HITS = f"""WITH d AS (SELECT q.query_id, v.index_name, v.id, v.content, {_DIST} AS distance FROM vectors v, {_QUERIES} q),
 h AS (SELECT query_id, index_name, id, content, distance, 1 / (1 + distance) AS score, row_number() OVER (PARTITION BY query_id, index_name ORDER BY distance, id) - 1 AS rank FROM d)"""
#: The query set: every vector whose id is divisible by 50.
_BOTH = lambda v: (v, v.where("id % 50 = 0").select("id", "vec"))


@query("vectors", sql=f"{SQL_HITS} SELECT query_id, id, distance, rank FROM h WHERE index_name = 'test_patterns' AND rank < 10", prepare=lambda v: _BOTH(v))
def knn_search(base: DataFrame, queries: DataFrame, index_name: str = "test_patterns", k: int = TOP_K) -> DataFrame:
    """The k nearest of each query in one index."""
    return nearest(base.where(F.col("index_name") == index_name), queries, k).select("query_id", "id", "distance", "rank")


@query("vectors", sql=f"{SQL_HITS} SELECT query_id, index_name, id, rank FROM h WHERE index_name IN ('test_patterns', 'edge_cases', 'code') AND rank < 5", prepare=lambda v: _BOTH(v))
def multi_index_search(base: DataFrame, queries: DataFrame, names: tuple[str, ...] = ("test_patterns", "edge_cases", "code"), k: int = 5) -> DataFrame:
    """The k nearest of each query in each of several indices, in one pass."""
    return nearest(base.where(F.col("index_name").isin(*names)), queries, k).select("query_id", "index_name", "id", "rank")


@query("vectors", sql=f"{SQL_HITS} SELECT query_id, index_name, id, rank FROM h WHERE rank < 3", prepare=lambda v: _BOTH(v))
def retrieve_topk(base: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """Top k per query and index over all indices."""
    return nearest(base, queries, k).select("query_id", "index_name", "id", "rank")


@query("vectors", sql=f"{SQL_HITS} SELECT query_id, index_name, id, rank FROM h WHERE rank < 10", prepare=lambda v: _BOTH(v))
def hit_rank(base: DataFrame, queries: DataFrame) -> DataFrame:
    """Rank, from 0, of every hit within its query and index; ties by id."""
    return nearest(base, queries, TOP_K).select("query_id", "index_name", "id", "rank")


@query("vectors", sql=f"{SQL_HITS} SELECT query_id, id, round(score, 5) AS score FROM h WHERE index_name = 'validation_rules' AND rank < 10 AND score >= 0.4", prepare=lambda v: (*_BOTH(v), 0.4))
def similarity_filter(base: DataFrame, queries: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """Hits of at least this score."""
    hits = nearest(base.where("index_name = 'validation_rules'"), queries)
    return hits.where(F.col("score") >= least).select("query_id", "id", F.round("score", 5).alias("score"))


@query("vectors", sql=f"{SQL_HITS} SELECT h.query_id, h.id, h.content FROM h WHERE index_name = 'bug_patterns' AND rank < 10", prepare=lambda v: _BOTH(v))
def hits_with_metadata(base: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits with what is stored beside their vectors; ids of -1 are dropped, missing contents are empty."""
    hits = nearest(base.where("index_name = 'bug_patterns'"), queries).where("id <> -1")
    return hits.join(base.select("index_name", "id", "content"), ["index_name", "id"], "left").select("query_id", "id", F.coalesce("content", F.lit("")).alias("content"))


@query("vectors", sql=f"{SQL_HITS}, u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index_name, id) - 1 AS position FROM h WHERE rank < 5) SELECT query_id, index_name, id, position FROM u WHERE position < 8", prepare=lambda v: _BOTH(v))
def hybrid_search(base: DataFrame, queries: DataFrame, per_index: int = 5, k: int = 8) -> DataFrame:
    """Hits of all indices together, best score first."""
    hits = nearest(base, queries, per_index)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "index_name", "id")) - 1
    return hits.withColumn("position", at).where(F.col("position") < k).select("query_id", "index_name", "id", "position")


@query("vectors", sql=f"{SQL_HITS} SELECT query_id, index_name, id, content, round(score, 5) AS score FROM h WHERE rank < 10", prepare=lambda v: _BOTH(v))
def hybrid_union(base: DataFrame, queries: DataFrame) -> DataFrame:
    """The hits of all indices together, each with its index, content and score."""
    hits = nearest(base, queries).join(base.select("index_name", "id", "content"), ["index_name", "id"])
    return hits.select("query_id", "index_name", "id", "content", F.round("score", 5).alias("score"))


@query("vectors", sql=f"{SQL_HITS} SELECT query_id, id, rank FROM h WHERE index_name = 'edge_cases' AND rank < 10 AND score >= 0.3", prepare=lambda v: _BOTH(v))
def retrieve_edge_cases(base: DataFrame, queries: DataFrame) -> DataFrame:
    """Nearest edge cases of at least the usual score."""
    return nearest(base.where("index_name = 'edge_cases'"), queries).where(F.col("score") >= MIN_SCORE).select("query_id", "id", "rank")


_TEST_CODES = ("checks invalid input", "at the boundary", "unauthorized call", "plain call")


def _with_code(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    code = F.get(F.array(*[F.lit(c) for c in _TEST_CODES]), (F.col("label") % 4).cast("int"))
    return vectors.withColumn("test_code", F.when(F.col("id") % 2 == 0, code)), vectors.where("id % 50 = 0").select("id", "vec")


@query(
    "vectors",
    prepare=_with_code,
    sql=f"""{SQL_HITS} SELECT h.query_id, h.id, h.rank, CASE WHEN h.id % 2 = 0 THEN CASE v.label % 4 WHEN 0 THEN 'validation' WHEN 1 THEN 'edge_case' WHEN 2 THEN 'authentication' ELSE 'functional' END END AS test_type
    FROM h JOIN vectors v ON v.index_name = h.index_name AND v.id = h.id WHERE h.index_name = 'test_patterns' AND rank < 5""",
)
def retrieve_similar_tests(base: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Nearest test patterns, with the test type of their ``test_code`` where they have one."""
    stored = base.where("index_name = 'test_patterns'")
    kinds = stored.select("id", F.when(F.col("test_code").isNotNull(), code_type(F.col("test_code"))).alias("test_type"))
    return nearest(stored, queries, k).join(kinds, "id").select("query_id", "id", "rank", "test_type")


@query("vectors", sql=f"{SQL_HITS} SELECT query_id, id, rank FROM h WHERE index_name = 'validation_rules' AND rank < 5", prepare=lambda v: _BOTH(v))
def retrieve_validation_patterns(base: DataFrame, queries: DataFrame) -> DataFrame:
    """Nearest validation rules."""
    return nearest(base.where("index_name = 'validation_rules'"), queries, 5).select("query_id", "id", "rank")


def lexical_overlap(query_text: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text holds: the default re-ranking scorer."""
    q, t = F.array_distinct(F.split(F.lower(query_text), r"\s+")), F.split(F.lower(text), r"\s+")
    return F.size(F.array_intersect(q, t)) / F.size(q)


def pair_scorer(setup: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A scorer for ``rerank`` from a model: ``setup`` loads it once a task and gives a function from query texts and texts to scores."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = setup()
        for asked, texts in batches:
            yield pd.Series(model(asked.tolist(), texts.tolist()), dtype="float64")

    return score


_ASKED = "(SELECT id AS asked, content AS query_text FROM vectors WHERE id % 50 = 0)"
_OVERLAP = "len(list_intersect(list_distinct(string_split(lower(query_text), ' ')), string_split(lower(content), ' '))) / len(list_distinct(string_split(lower(query_text), ' ')))::DOUBLE"


@query(
    "vectors",
    prepare=lambda v: (v, v.where("id % 50 = 0").select("id", "vec", F.col("content").alias("text"))),
    sql=f"""{SQL_HITS}, s AS (SELECT query_id, id, query_text, {_OVERLAP} AS pair_score, score FROM h JOIN {_ASKED} ON asked = query_id WHERE index_name = 'code' AND rank < 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, score DESC, id) - 1 AS position FROM s)
    SELECT query_id, id, query_text, round(pair_score, 6) AS pair_score, round(score, 5) AS original_score, position FROM r WHERE position < 5""",
)
def rerank(base: DataFrame, queries: DataFrame, k: int = 5, scorer: Callable[[Column, Column], Column] = lexical_overlap, index_name: str = "code") -> DataFrame:
    """Fetches 2k hits of every query (id, vec, text), scores each pair of texts anew, keeps the best k. The scorer is pluggable."""
    queries = stored(queries.select("id", "vec", "text"))
    hits = nearest(base.where(F.col("index_name") == index_name), queries, 2 * k)
    hits = hits.join(base.select("index_name", "id", "content"), ["index_name", "id"])
    hits = hits.join(queries.select(F.col("id").alias("query_id"), F.col("text").alias("query_text")), "query_id")
    scored = hits.withColumn("pair_score", scorer(F.coalesce("query_text", F.lit("")), F.coalesce("content", F.lit(""))))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("pair_score"), F.desc("score"), "id")) - 1
    scored = scored.withColumn("position", at).where(F.col("position") < k)
    return scored.select("query_id", "id", "query_text", F.round("pair_score", 6).alias("pair_score"), F.round("score", 5).alias("original_score"), "position")


@query("vectors", prepare=lambda v: _BOTH(v))
def mmr(base: DataFrame, queries: DataFrame, k: int = 5, weight: float = 0.5, diversity: str = "cosine") -> DataFrame:
    """Maximal marginal relevance over 4k hits of each query; diversity 'none' keeps the order of score."""
    hits = nearest(base.where("index_name = 'api_patterns'"), queries, 4 * k)
    if diversity == "none":
        return hits.where(F.col("rank") < k).select("query_id", "id", F.col("rank").cast("int").alias("position"))
    rows = hits.join(base.select("index_name", "id", "vec"), ["index_name", "id"]).select("query_id", "id", "score", "vec")

    def greedy(hits: pd.DataFrame) -> pd.DataFrame:
        hits = hits.sort_values(["score", "id"], ascending=[False, True])
        v = np.array(hits["vec"].tolist(), dtype=float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        score, near = hits["score"].to_numpy(), np.zeros(len(hits))
        left, chosen = list(range(len(hits))), []
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (weight * score[i] - (1 - weight) * near[i], -i))
            chosen.append(best)
            left.remove(best)
            near = np.maximum(near, v @ v[best])
        return pd.DataFrame({"query_id": hits["query_id"].iloc[chosen], "id": hits["id"].iloc[chosen], "position": range(len(chosen))})

    return rows.groupBy("query_id").applyInPandas(greedy, "query_id long, id long, position int")


#: Slack of the bounds on distances, which are rounded to six digits.
_SLACK = 1e-4


class Cells:
    """k-means centres, with each cell's radius once its members are known."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray | None = None) -> None:
        self.centres, self.radii = centres, radii

    def distances(self, vecs: pd.Series) -> np.ndarray:
        v = np.array(vecs.tolist(), dtype=float)
        return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * v @ self.centres.T, 0))

    def own(self) -> Callable:
        """Column of each vector's cell, and its distance from the centre."""

        @F.pandas_udf("cell int, off double")
        def own(vecs: pd.Series) -> pd.DataFrame:
            d = self.distances(vecs)
            return pd.DataFrame({"cell": d.argmin(1).astype(np.int32), "off": d.min(1)})

        return own

    def first(self, n: int) -> Callable:
        """Column of the n cells with the nearest centres."""

        @F.pandas_udf("array<int>")
        def first(vecs: pd.Series) -> pd.Series:
            return pd.Series(list(np.argsort(self.distances(vecs), axis=1, kind="stable")[:, :n].astype(np.int32)))

        return first

    def others(self, n: int) -> Callable:
        """Column of the cells beyond the first n that may hold a vector within ``worst``: no member is nearer than centre less radius."""

        @F.pandas_udf("array<int>")
        def others(vecs: pd.Series, worst: pd.Series) -> pd.Series:
            d = self.distances(vecs)
            later = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable") >= n
            near = np.maximum(d - self.radii, 0) ** 2 <= worst.to_numpy()[:, None] + _SLACK
            return pd.Series([np.flatnonzero(x).astype(np.int32) for x in later & near])

        return others


def ivf_hits(base: DataFrame, queries: DataFrame, nlist: int = 50, nprobe: int = 30, k: int = TOP_K, train_rows: int = 10_000, seed: int = 1, exact: bool = False) -> DataFrame:
    """query_id, id, distance, rank and probes, the number of cells that the query has searched.

    k-means cells are fitted on at most ``train_rows`` vectors; all are indexed. A query searches its ``nprobe`` nearest cells. With
    ``exact`` it then searches every other cell that its radius does not rule out: a member is at least as far away as the centre less
    the radius, so when that exceeds the distance of the k-th hit the cell can't add one. Queries and base meet in an equi-join on the
    cell, block by block, so a large cell is no single task. Fewer vectors than ``nlist`` make as many cells.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    base, queries = base.where("vec is not null"), queries.where("vec is not null").select("id", "vec")
    sample = base.orderBy(F.xxhash64("id"), "id").limit(train_rows).select(array_to_vector("vec").alias("features"))
    count = sample.count()
    if count < 2:
        hits = nearest(base.withColumn("index_name", F.lit("all")), queries, k)
        return hits.select("query_id", "id", "distance", "rank", F.lit(1).alias("probes"))
    cells = Cells(np.array(KMeans(k=min(nlist, count), seed=seed, maxIter=10).fit(sample).clusterCenters()))
    members = stored(base.select("id", "vec", cells.own()("vec").alias("c")).select("id", "vec", "c.cell", "c.off"))
    packed = stored(blocks(members, "cell", BASE_BLOCK).drop("block"))

    def searched(probes: DataFrame) -> DataFrame:
        asked = asked_blocks(stored(probes.select("id", "vec", F.explode("cells").alias("cell"))), "cell")
        pairs = packed.join(asked, "cell").withColumn("index_name", F.lit("all"))
        return local_hits(pairs.withColumn("query_block", F.concat_ws("/", "cell", "query_block")), k)

    probes = queries.withColumn("cells", cells.first(nprobe)("vec"))
    hits = searched(probes)
    spent = probes.select(F.col("id").alias("query_id"), F.size("cells").alias("probes"))
    if exact:
        radii = np.zeros(len(cells.centres))
        for r in members.groupBy("cell").agg(F.max("off").alias("off")).collect():  # at most nlist rows
            radii[r.cell] = r.off
        cells.radii = radii
        hits = stored(ranked(hits, k))
        worst = hits.where(F.col("rank") == k - 1).select(F.col("query_id").alias("id"), F.col("distance").alias("worst"))
        asked = queries.join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        more = stored(asked.withColumn("cells", cells.others(nprobe)("vec", "worst")))
        hits = hits.select("query_id", "index_name", "id", "distance").unionByName(searched(more))
        spent = spent.unionByName(more.select(F.col("id").alias("query_id"), F.size("cells").alias("probes"))).groupBy("query_id").agg(F.sum("probes").alias("probes"))
    return ranked(hits, k).join(spent, "query_id").select("query_id", "id", "distance", "rank", F.col("probes").cast("int").alias("probes"))


@query("vectors", prepare=lambda v: _BOTH(v), sql=f"{SQL_HITS.replace('v.index_name', chr(39) + 'all' + chr(39) + ' AS index_name')} SELECT query_id, id, distance, rank FROM h WHERE rank < 10")
def ivf_search(base: DataFrame, queries: DataFrame, nlist: int = 50, nprobe: int = 8, k: int = TOP_K, exact: bool = True) -> DataFrame:
    """The k nearest of each query by cells: exact by the cells' radii, or within ``nprobe`` cells only."""
    return ivf_hits(base, queries, nlist, nprobe, k, exact=exact).select("query_id", "id", "distance", "rank")


@query("vectors", prepare=lambda v: _BOTH(v), sql=f"{SQL_HITS.replace('v.index_name', chr(39) + 'all' + chr(39) + ' AS index_name')} SELECT query_id, id, distance, rank FROM h WHERE rank < 10")
def knn_join(base: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k nearest of each query over all indices together."""
    return nearest(base.withColumn("index_name", F.lit("all")), queries, k).select("query_id", "id", "distance", "rank")


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """Deterministic unit vector: the bytes of sha256 repeated to ``dim``, scaled to -1 .. 1. Each step is computed once for a text."""
    pair = lambda digest, i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1
    raw = let(F.sha2(text.cast("binary"), 256), lambda digest: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: pair(digest, i)))
    return normalized(let(raw, lambda r: F.slice(F.flatten(F.array_repeat(r, -(-dim // 32))), 1, dim)))


def normalized(vec: Column) -> Column:
    """Row of length 1; a zero row stays."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))

    return let(vec, scaled)


SQL_BYTES = "list_transform(range(0, {d}), lambda i: (CAST('0x' || substr(sha256({t}), CAST(2 * (i % 32) + 1 AS BIGINT), 2) AS BIGINT) / 127.5 - 1)::DOUBLE)"


@query("corpus", sql=f"WITH v AS (SELECT doc_id, {SQL_BYTES.format(d=64, t='content')} AS v FROM corpus) SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[33] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS middle, len(v) AS dim FROM v", name="hash_embedding", prepare=lambda c: (c, 64))
def embed_hashed(documents: DataFrame, dim: int = 384) -> DataFrame:
    """Two components and the length of each document's hash embedding."""
    rows = documents.select("doc_id", hash_embedding(F.col("content"), dim).alias("v"))
    return rows.select("doc_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(dim // 2)), 6).alias("middle"), F.size("v").alias("dim"))


#: Texts that an encoder gets at once.
ENCODER_BATCH = 32

Encoder = Callable[[list[str]], np.ndarray]


def hash_encoder(dim: int = 384) -> Encoder:
    """The encoder of ``hash_embedding``, before it is scaled to length 1, for tasks without the column form."""

    def encode(texts: list[str]) -> np.ndarray:
        digests = np.frombuffer(b"".join(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts), dtype=np.uint8)
        return np.tile(digests.reshape(len(texts), 32) / 127.5 - 1, -(-dim // 32))[:, :dim]

    return encode


def fitted(rows: np.ndarray, dim: int) -> np.ndarray:
    """Rows cut or padded with zeros to ``dim`` and scaled to length 1; a zero row stays."""
    rows = np.pad(rows[:, :dim], ((0, 0), (0, max(0, dim - rows.shape[1])))).astype(np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=rows, where=norms > 0)


def encoded(text: Column, setup: Callable[[], Encoder], dim: int = 384, batch: int = ENCODER_BATCH) -> Column:
    """Unit vector of ``dim`` numbers for every text; null for null.

    ``setup`` loads the encoder once a task; it then gets at most ``batch`` texts at a time, and whatever width it returns is fitted.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = setup()
        for texts in batches:
            out = np.full(len(texts), None, dtype=object)
            there = np.flatnonzero(texts.notna().to_numpy())
            for at in range(0, len(there), batch):
                some = there[at : at + batch]
                for i, row in zip(some, fitted(np.asarray(encoder(texts.iloc[some].tolist())), dim), strict=True):
                    out[i] = row
            yield pd.Series(out)

    return encode(text)


_V48 = SQL_BYTES.format(d=48, t="content")
_NORM = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"


@query(
    "corpus",
    sql=f"WITH v AS (SELECT doc_id, {_V48} AS v FROM corpus) SELECT doc_id, round(v[1] / {_NORM}, 6) AS first, round(v[48] / {_NORM}, 6) AS last_own, 0.0::DOUBLE AS padding, 1.0::DOUBLE AS norm, 64 AS dim FROM v",
    prepare=lambda c: (c, lambda: hash_encoder(48), 64),
)
def embed_batches(documents: DataFrame, setup: Callable[[], Encoder] = hash_encoder, dim: int = 384) -> DataFrame:
    """Components, norm and length of what a batch encoder of any width makes of every document, fitted to ``dim``.

    ``last_own`` is the last component that an encoder of three quarters of ``dim`` fills itself, ``padding`` the one after it.
    """
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", encoded(F.col("content"), setup, dim).alias("v"))
    at = lambda i: F.round(F.get("v", F.lit(i)), 6)
    own = 3 * dim // 4
    norm = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return rows.select("doc_id", at(0).alias("first"), at(own - 1).alias("last_own"), at(own).alias("padding"), norm.alias("norm"), F.size("v").alias("dim"))


_V32 = SQL_BYTES.format(d=32, t="content")


def _half_cached(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = corpus.where("doc_id % 2 = 0").select(F.sha1("content").alias("key"), "content").dropDuplicates(["key"])
    return corpus, stored(known.select("key", hash_embedding(F.col("content"), 32).alias("vec")))


@query(
    "corpus",
    sql=f"""WITH t AS (SELECT content, count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) > 0 AS cached FROM corpus GROUP BY 1), v AS (SELECT *, {_V32} AS v FROM t)
    SELECT sha1(content) AS key, n, cached, round(v[1] / {_NORM}, 6) AS first, round(v[32] / {_NORM}, 6) AS last, len(v) AS dim FROM v""",
    prepare=_half_cached,
)
def embedding_cache(documents: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts, how many documents have each, whether the cache held it, and two components of its vector."""
    found = with_cache(documents, cache, lambda text: hash_embedding(text, 32))
    at = lambda i: F.round(F.get("vec", i), 6)
    return found.select("key", "n", "cached", at(F.lit(0)).alias("first"), at(F.size("vec") - 1).alias("last"), F.size("vec").alias("dim"))


def with_cache(documents: DataFrame, cache: DataFrame, encoder: Callable[[Column], Column]) -> DataFrame:
    """key (sha1), n, cached and vec of every distinct text of ``documents``; only texts that ``cache`` (key, vec) lacks are encoded.

    Copies meet before anything is encoded. The result's rows with ``cached`` false are what a next cache adds.
    """
    keyed = documents.where("content is not null").select(F.sha1("content").alias("key"), "content")
    distinct = stored(keyed.groupBy("key").agg(F.first("content").alias("content"), F.count(F.lit(1)).alias("n")))
    fresh = distinct.join(cache, "key", "left_anti").select("key", "n", F.lit(False).alias("cached"), encoder(F.col("content")).alias("vec"))
    return distinct.select("key", "n").join(cache.select("key", F.lit(True).alias("cached"), "vec"), "key").unionByName(fresh)


_FIT = "list_concat(vec[1:80], list_transform(range(greatest(0, 80 - len(vec))), lambda i: 0.0::FLOAT))"


@query("vectors", sql=f"SELECT id, len(v) AS dim, round(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS squared FROM (SELECT id, {_FIT} AS v FROM vectors)", prepare=lambda v: (v, 80))
def align_normalize(vectors: DataFrame, dim: int = 384) -> DataFrame:
    """Length and squared norm of vectors cut or padded to ``dim`` and normalised."""
    fitted = F.concat(F.slice("vec", 1, dim), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), dim - F.size("vec"))))
    v = normalized(F.transform(fitted, lambda x: x.cast("double")))
    return vectors.select("id", F.size(v).alias("dim"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 5).alias("squared"))


@query("vectors", sql="SELECT index_name, count(*) AS n_vectors, max(len(vec)) AS dimension, count(content) AS n_metadata FROM vectors GROUP BY 1")
def index_statistics(vectors: DataFrame) -> DataFrame:
    """Vectors, dimension and metadata of each index."""
    return vectors.groupBy("index_name").agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.size("vec")).alias("dimension"), F.count("content").alias("n_metadata"))


@query("vectors", sql="SELECT index_name, id, CASE WHEN id % 3 = 0 THEN 'new ' || id ELSE content END AS content FROM vectors", prepare=lambda v: (v, v.where("id % 3 = 0").withColumn("content", F.concat(F.lit("new "), "id"))))
def upsert_vectors(there: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors with the new version of each id that has one."""
    both = there.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)))
    latest = F.max_by(F.struct("vec", "content", "label"), "_version").alias("v")
    return both.groupBy("index_name", "id").agg(latest).select("index_name", "id", "v.content")
