"""The pipeline against a plain Python version of its stages, and on empty tables."""

import functools
import hashlib
import random
import re

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from qaspark.llm import bpe, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = "[^\x20\x09-\x0d]+"


def pairs_of(text):
    w = re.findall(SPLIT, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def without_near_duplicates(docs):
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, pairs_of(t)) for i, t in docs]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if n and 100 * n >= 80 * (len(a) + len(b) - n) and find(i) != find(j):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [(i, t) for i, t in docs if find(i) == i]


def without_repeats(docs):
    first = {}
    for i, t in docs:
        w = re.findall(SPLIT, t or "")
        for p in range(len(w) - 49):
            first[tuple(w[p : p + 50])] = min(i, first.get(tuple(w[p : p + 50]), i))
    out = []
    for i, t in docs:
        w = re.findall(SPLIT, t or "")
        gone = set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    return out


def without_leaks(docs, items):
    def runs(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    bags = [runs(x.lower().split()) for x in items]
    return [(i, t) for i, t in docs if not any(len(b & runs((t or "").lower().split())) >= 0.9 * len(b) for b in bags)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    made = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    docs = [(i, made(rng.randrange(60, 120)) + (" you idiot you moron" * 3 if i % 5 == 0 else "")) for i in range(200)]
    items = [made(30), made(20)]
    passage = made(55)
    docs += [(300 + i, docs[1][1]) for i in range(5)] + [(310, docs[2][1].replace("w1", "w1x", 1))]
    docs += [(320 + i, made(40) + " " + passage + " " + made(40)) for i in range(5)]
    docs += [(330, made(30) + " " + items[0].upper() + " " + made(30)), (331, items[1])]
    docs += [(340, None), (341, ""), (342, "short")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_pipeline_equals_plain_python(spark, folder):
    path, docs, items = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score_documents(table, spark.read.parquet(f"{path}/labels.parquet")).where("predicted = 1").collect()}
    assert sum(i % 5 == 0 for i in toxic if i < 200) >= 38 and all(i % 5 == 0 for i in toxic if i < 200)
    want = without_leaks(without_repeats(without_near_duplicates([d for d in docs if d[0] not in toxic])), items)
    tokenizer = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    got = corpus_pipeline.run(spark, path)
    assert got.columns == [*table.columns, "tokens", "n_tokens", "decoded_sha256"]
    assert all(r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in got.collect())
    assert {r.doc_id: (r.text, r.n_chars, r.tokens) for r in got.collect()} == {i: (t, None if t is None else len(t), tokenizer.encode_ordinary(t or "")) for i, t in want} | {340: (None, got.where("doc_id = 340").first().n_chars, [])}


def test_stages_with_clashing_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id >= 300 or doc_id < 20")
    names = ("gone", "_gone", "whole", "_whole", "print", "_print", "kind", "score", "predicted", "label", "component_id", "kept", "tokens", "found")
    extra = docs.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, path)
        assert out.columns == extra.columns
        wrong = [F.col(n) != F.concat(F.lit(n), "doc_id") for n in names]
        assert out.count() > 0 and out.where(functools.reduce(lambda a, b: a | b, wrong)).isEmpty()
    assert "tokens" in corpus_pipeline.STAGES[-1][1](spark, extra, path).columns


def test_stages_keep_columns_and_empty_tables(spark, folder):
    path = folder[0]
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, path)
        assert out.columns == empty.columns and out.isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, path).isEmpty()
