"""Search, cells, encoders and re-ranking against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaspark.operators import vectors

DIM = 6


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, DIM)) * 4
    return np.float32(np.concatenate([centres[rng.integers(12, size=900)] + rng.normal(size=(900, DIM)), np.zeros((40, DIM))]))


@pytest.fixture(scope="module")
def table(spark, points):
    rows = [(i, "ab"[i % 10 == 0], v.tolist()) for i, v in enumerate(points)]
    return spark.createDataFrame([*rows, (5000, "a", None)], "id long, index_name string, vec array<float>").cache()


def brute(points, ids, q, k):
    d = np.round(((points[ids].astype(float) - points[q].astype(float)) ** 2).sum(1), 6)
    return [ids[i] for i in np.lexsort((ids, d))[:k]]


@pytest.mark.parametrize("held", [10, 10**6])
def test_a_task_emits_k_hits_a_query_however_many_blocks(monkeypatch, table, points, held):
    monkeypatch.setattr(vectors, "HELD_HITS", held)
    queries = table.where("id % 50 = 0 and vec is not null").select("id", "vec")
    n = queries.count()
    for size in (16, 4096):
        base = vectors.blocks(table, "index_name", size)
        pairs = base.drop("block").crossJoin(vectors.asked_blocks(queries)).coalesce(1)
        blocks = base.count()
        hits = vectors.local_hits(pairs, 7)
        if held > 10:
            assert hits.count() == n * 7 * 2 and (blocks > 50 or size > 16)
        got = {}
        for r in vectors.ranked(hits, 7).orderBy("rank").collect():
            got.setdefault((r.index_name, r.query_id), []).append(r.id)
        for (name, q), found in got.items():
            assert found == brute(points, np.array([i for i in range(len(points)) if "ab"[i % 10 == 0] == name]), q, 7)


def test_blocks_follow_each_keys_own_count(table):
    sizes = {(r.index_name, r.block): r.n for r in vectors.blocks(table, "index_name", 50).select("index_name", "block", F.size("ids").alias("n")).collect()}
    assert sum(n for (k, _), n in sizes.items() if k == "a") == 846 and len([k for k in sizes if k[0] == "b"]) == 2


def test_exact_cells_lose_nothing_and_probe_less(table, points):
    queries = table.where("id % 20 = 0 and vec is not null").select("id", "vec")
    want = {(q, i) for q in range(0, len(points), 20) for i in brute(points, np.arange(len(points)), q, 5)}
    exact = vectors.ivf_hits(table, queries, nlist=30, nprobe=2, k=5, exact=True).collect()
    assert {(r.query_id, r.id) for r in exact} == want
    probes = {r.query_id: r.probes for r in exact}
    assert min(probes.values()) >= 2 and np.mean(list(probes.values())) < 15  # half of the cells are ruled out
    fast = vectors.ivf_hits(table, queries, nlist=30, nprobe=6, k=5).collect()
    assert {r.probes for r in fast} == {6} and len({(r.query_id, r.id) for r in fast} & want) >= 0.9 * len(want)


def test_fewer_vectors_than_neighbours(table):
    few = table.where("id < 3")
    for base in (few, few.limit(1), few.limit(0)):
        n = base.count()
        for exact in (True, False):
            assert vectors.ivf_hits(base, few.select("id", "vec"), nprobe=1, k=10, exact=exact).count() == (3 * n if exact or n < 2 else 3)


def test_batches_are_encoded_by_an_encoder_set_up_once_a_task(spark):
    sc = spark.sparkContext
    setups, texts, largest = sc.accumulator(0), sc.accumulator(0), sc.accumulator(0)

    def setup():
        setups.add(1)

        def encode(batch):
            texts.add(len(batch))
            if len(batch) > 32:
                largest.add(1)
            return np.array([[len(t), 1.0, 2.0] for t in batch])

        return encode

    docs = spark.createDataFrame([(i, None if i == 7 else "x" * (i % 5)) for i in range(500)], "doc_id long, content string").coalesce(2)
    rows = docs.select("doc_id", vectors.encoded(F.col("content"), setup, 2).alias("v")).collect()
    got = {r.doc_id: r.v for r in rows}
    assert (setups.value, texts.value, largest.value) == (docs.rdd.getNumPartitions(), 499, 0)
    assert got[7] is None and got[3] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])


def test_encoder_forms_agree(spark):
    texts = ["a", "", "é€ text", "x" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    columns = {r.id: r.v for r in docs.select("id", vectors.hash_embedding(F.col("content"), 50).alias("v")).collect()}
    rows = vectors.fitted(vectors.hash_encoder(50)(texts), 50)
    assert all(np.allclose(columns[i], rows[i]) for i in range(len(texts)))
    assert vectors.fitted(np.zeros((1, 2)), 4).tolist() == [[0.0] * 4]


def test_only_unseen_texts_are_encoded(spark):
    encoded = spark.sparkContext.accumulator(0)

    def setup():
        def encode(batch):
            encoded.add(len(batch))
            return np.array([[1.0, len(t)] for t in batch])

        return encode

    docs = spark.createDataFrame([("a",), ("a",), ("bb",), ("ccc",), (None,), ("ccc",), ("ccc",)], "content string")
    cache = docs.where("content = 'a'").limit(1).select(F.sha1("content").alias("key"), F.array(F.lit(9.0), F.lit(9.0)).alias("vec"))
    rows = vectors.with_cache(docs, cache, lambda c: vectors.encoded(c, setup, 2)).collect()
    assert encoded.value == 2
    assert sorted((r.n, r.cached, r.vec[0] == 9.0) for r in rows) == [(1, False, False), (2, True, True), (3, False, False)]
    plan = vectors.embedding_cache(docs, cache.select("key", F.array(F.lit(9.0)).alias("vec")))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan  # the vectors are part of the result


def test_rerank_with_a_model(spark, table):
    stored = table.where("vec is not null").withColumn("content", F.concat(F.lit("text "), "id"))
    queries = table.where("id in (3, 5)").select("id", "vec", F.lit("ask").alias("text"))
    scorer = vectors.pair_scorer(lambda: lambda asked, texts: [float(t.split()[1]) + (a == "ask") for a, t in zip(asked, texts, strict=True)])
    got = vectors.rerank(stored, queries, 3, scorer, "a").orderBy("query_id", "position").collect()
    near = vectors.nearest(stored.where("index_name = 'a'"), queries, 6).collect()
    for q in (3, 5):
        ids = [r.id for r in got if r.query_id == q]
        assert ids == sorted((r.id for r in near if r.query_id == q), reverse=True)[:3]
        assert [r.pair_score for r in got if r.query_id == q] == [i + 1.0 for i in ids]
