"""Byte-level BPE: distinct words are encoded by ranked merges over their bytes; decoding concatenates the ids' binary pieces.

``encode_documents_by_fold`` uses Spark's higher-order functions only. Every distinct word of the corpus is encoded once: it starts
as an array of its bytes, and a fold over the word's length replaces, at each step, the adjacent pair of lowest rank by the joined
piece until no pair has a rank. Ranks come from a literal map of the vocabulary, cut into buckets by hash because a map's lookup
is linear. The words' ids are joined back and put together in order of position. It gives right results but shuffles a row for
each word of the corpus, so it can't keep to a small multiple of the input on disk (figures in the README).

``encode_documents`` and ``with_tokens`` therefore run the same merges in Arrow batches: each task keeps the ids of the distinct
words that it meets in a bounded cache, and nothing is shuffled.

Edge cases: a null text counts as empty and has no tokens; rows of equal id are told apart by the hash of their text and repeated
rows keep their number; a word of any length is folded whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.llm.common import let, private, small_batches

#: Default vocabulary; any file of base64 pieces and ranks will do.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BUCKETS = 32_768

#: The tokenizer's pattern for Java: there \\s and \\S are ASCII only unless told.
PATTERN = "(?U)" + public_tokenizers.PATTERN


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _bucket(piece: Column) -> Column:
    return F.pmod(F.hash(piece), F.lit(BUCKETS))


def constants(spark: SparkSession, ranks: dict[bytes, int]) -> tuple[Column, Column]:
    """The vocabulary as two constants: an array of BUCKETS small maps from piece to rank, and an array of pieces by rank.

    A piece stands as a string with one Latin-1 character for each byte. The file's fixed size bounds both.
    """
    rows = [(k.decode("latin-1"), v) for k, v in ranks.items()]
    found = spark.createDataFrame(rows, "piece string, rank int").select("piece", "rank", _bucket(F.col("piece")).alias("b")).collect()
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    pieces = [""] * (max(ranks.values()) + 1)
    for r in found:
        maps[r["b"]][r["piece"]] = r["rank"]
        pieces[r["rank"]] = r["piece"].encode("latin-1").hex()
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>"), F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def fold(word: Column, ranks: Column) -> Column:
    """Ids of one word."""
    rank = lambda piece: F.try_element_at(F.get(ranks, _bucket(piece)), piece)
    letters = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))

    def merge(pieces: Column) -> Column:
        pairs = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda right, i: rank(F.concat(F.get(pieces, i), right)))

        def at_least(found: Column) -> Column:
            at = F.array_position(found, F.array_min(found)).cast("int")
            joined = F.concat(F.slice(pieces, 1, at - 1), F.array(F.concat(F.get(pieces, at - 1), F.get(pieces, at))), F.slice(pieces, at + 2, F.size(pieces)))
            return F.when(F.array_min(found).isNull(), pieces).otherwise(joined)

        return let(pairs, at_least)

    merged = F.aggregate(F.sequence(F.lit(1), F.length(word)), letters, lambda pieces, _: F.when(F.size(pieces) < 2, pieces).otherwise(merge(pieces)))
    return let(rank(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(merged, rank)))


def little_endian(i: Column) -> Column:
    """Eight hex digits of an id's four bytes, lowest first."""
    h = F.lpad(F.hex(i.cast("bigint")), 8, "0")
    return F.concat(*[h.substr(k, 2) for k in (7, 5, 3, 1)])


def encode_distinct(words: DataFrame, ranks: Column, pieces: Column) -> DataFrame:
    """word, n, ids (little-endian hex) and decoded (hex of the ids' pieces, put together) of every distinct word."""
    bytes_ = F.decode(F.col("word").cast("binary"), "ISO-8859-1")
    ids = words.select("word").distinct().withColumn("_ids", fold(bytes_, ranks))
    return ids.select("word", F.size("_ids").alias("n"), F.array_join(F.transform("_ids", little_endian), "").alias("ids"), F.array_join(F.transform("_ids", lambda i: F.get(pieces, i)), "").alias("decoded"))


def encode_documents_by_fold(docs: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``, by array functions and joins only."""
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "_row", F.posexplode_outer(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("pos", "word")
    )
    known = encode_distinct(words.where("word is not null"), *constants(docs.sparkSession, ranks or read_ranks()))
    parts = words.join(known, "word", "left").groupBy("doc_id", "_row")
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("pos", "ids", "decoded"))).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    whole = lambda field: F.sha2(F.unhex(F.array_join(F.transform("p", lambda x: x[field]), "")), 256)
    return parts.select("doc_id", "n_tokens", whole("ids").alias("ids_sha256"), whole("decoded").alias("decoded_sha256"))


#: Distinct words whose ids a task keeps; when they are full, the task starts anew.
CACHED_WORDS = 200_000


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank, leftmost first, is joined until no pair has a rank.

    Pieces are linked by position and pairs wait in a heap, so that a word of n bytes takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # end of the piece that starts here; 0 once it is part of another
    start_of = list(range(n))  # start of the piece that ends just before position i + 1
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop or stop <= middle:
            continue  # one of the two pieces has changed since
        end[i], end[middle] = stop, 0
        start_of[stop - 1] = i
        if i:
            before = start_of[i - 1]
            if (r := ranks.get(word[before:stop])) is not None:
                heapq.heappush(heap, (r, before, stop))
        if stop < n and (r := ranks.get(word[i : end[stop]])) is not None:
            heapq.heappush(heap, (r, i, end[stop]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : end[i]]])
        i = end[i]
    return ids


def encoder(ranks: dict[bytes, int]) -> Callable[[str], bytes]:
    """Function from a text to its ids as little-endian unsigned 32-bit integers."""
    find = regex.compile(public_tokenizers.PATTERN).findall
    known: dict[str, bytes] = {}

    def ids(word: str) -> bytes:
        if len(known) >= CACHED_WORDS:
            known.clear()
        found = known[word] = np.array(merged(word.encode("utf-8"), ranks), dtype="<u4").tobytes()
        return found

    return lambda text: b"".join([known.get(w) or ids(w) for w in find(text)])


def decoder(ranks: dict[bytes, int]) -> Callable[[bytes], bytes]:
    piece = {i: p for p, i in ranks.items()}.__getitem__
    return lambda ids: b"".join(map(piece, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    small_batches(docs.sparkSession)
    ranks = ranks or read_ranks()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode, decode = encoder(ranks), decoder(ranks)
        for texts in batches:
            ids = [encode(t or "") for t in texts]
            rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(decode(i)).hexdigest()) for i in ids]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")


def with_tokens(docs: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """``docs`` with tokens (array of ids), n_tokens and decoded_sha256 (of the ids' bytes) in place of any such columns."""
    small_batches(docs.sparkSession)
    ranks = ranks or read_ranks()

    @F.pandas_udf("tokens array<int>, decoded_sha256 string")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode, decode = encoder(ranks), decoder(ranks)
        for texts in batches:
            ids = [encode(t or "") for t in texts]
            arrays = [np.frombuffer(i, dtype="<u4").astype(np.int32) for i in ids]
            yield pd.DataFrame({"tokens": arrays, "decoded_sha256": [hashlib.sha256(decode(i)).hexdigest() for i in ids]})

    kept = [F.col(c) for c in docs.columns if c.lower() not in ("tokens", "n_tokens", "decoded_sha256")]
    found = private("found", docs)
    rows = docs.withColumn(found, tokens("text"))
    return rows.select(*kept, F.col(f"{found}.tokens").alias("tokens"), F.size(f"{found}.tokens").cast("long").alias("n_tokens"), F.col(f"{found}.decoded_sha256").alias("decoded_sha256"))
