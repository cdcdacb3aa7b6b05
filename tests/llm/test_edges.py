"""Very long texts, ids with several texts, ties and balance of the older corpus operators."""

import hashlib
import random
from collections import Counter, defaultdict

import base64

import pytest
import public_tokenizers
import tiktoken

from qaspark.llm import bpe, decontamination, fingerprints, sharding

SCHEMA = "doc_id long, text string"


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_shards_of_the_query_are_balanced(spark):
    rng = random.Random(1)
    docs = [(i, words(rng, rng.randrange(1, 300))) for i in range(1500)] + [(5000 + i, "a common text of some length") for i in range(400)]
    docs += [(7000 + i, "tie") for i in range(16)] + [(8000, None), (8001, ""), (None, "no id"), (8002, words(rng, 3000))]
    rows = sharding.shard_by_bytes(spark.createDataFrame(docs, SCHEMA)).collect()
    size, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of[r.text_crc32].add(r.shard)
    assert len(rows) == len(docs) and len(size) == 16 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())  # equal texts together
    assert max(size.values()) - min(size.values()) < 0.01 * sum(size.values()) / 16
    again = sharding.shard_by_bytes(spark.createDataFrame(docs, SCHEMA)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_fingerprints_of_long_texts_and_of_ids_with_two_texts(spark):
    rng = random.Random(2)
    long, other = words(rng, 60_000, 10**6), words(rng, 60_000, 10**6)
    docs = [(1, "short text of six words here"), (2, long), (2, other), (3, long), (3, long)]
    rows = fingerprints.fingerprint_documents(spark.createDataFrame([(*d, 1, "x") for d in docs], f"{SCHEMA}, n_chars int, fingerprint string")).collect()
    assert sorted(r.n_chars for r in rows) == sorted(len(t) for _, t in docs)
    prints = defaultdict(set)
    for r in rows:
        prints[r.doc_id].add(r.fingerprint)
    assert len(prints[2]) == 2 and prints[3] <= prints[2]
    twin = [r for r in rows if r.doc_id == 3]
    assert sum(r.near_next == 1.0 for r in twin) >= 1 and all(0.3 < r.near_edited < 0.9 for r in rows if r.doc_id == 2)


def test_a_leak_in_a_very_long_text_and_ties(spark):
    rng = random.Random(3)
    item = words(rng, 40, 10**6)
    text = f"{words(rng, 3000, 10**6)} {item} {words(rng, 3000, 10**6)} {item}"
    docs = spark.createDataFrame([(1, text, 1), (2, words(rng, 3000, 10**6), 1), (3, item, 1), (3, item, 1)], f"{SCHEMA}, size int")
    benchmark = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    found = decontamination.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 7), (1, 8), (3, 7), (3, 8)}
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, benchmark).collect()) == [2]


@pytest.mark.parametrize("text", ["mixed 12 wörter, 漢字 \n\t and 'quotes' " * 20_000, "x" * 100_000, "ab" * 40_000 + " end"])
def test_bytes_pairs_of_a_very_long_text(spark, text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    got = bpe.encode_documents(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert got.n_tokens == len(want) and got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
