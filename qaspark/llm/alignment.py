"""Cross-tokenizer alignment: lockstep vectorised merging of two tokenizers' byte offsets.

Text A is a blank and the text in byte-level BPE, B the text in sentence pieces, which adds the blank itself. A batch's documents are
cut into lanes of at most LANE tokens of A, with the tokens of B that end in the same bytes. One numpy vector of A pointers and one of
B pointers hold the place of all lanes: in every step each lane whose two tokens end at the same byte emits a link and a cut and moves
both pointers on, any other lane moves the pointer of the token that ends first; finished lanes are compacted away. So a batch takes
at most as many steps as a lane has tokens, also with very long documents.

Links are counted per pair of ids inside each document, then over the corpus, partial sums first. The pairs' counts come back to the
documents by a join on the pair; its right side has a row per pair of ids, and hot pairs are broadcast.

Edge cases: a null or empty text, and a text that either tokenizer doesn't give back byte for byte, has no tokens, only zeros and an
empty digest; special tokens' strings are plain text; texts of any length are encoded whole; repeated rows are documents of their own
and count each; among equal counts all pairs of a B id are best; no token is empty, so at most one of each side ends at a byte; an
empty table gives no rows; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import checkpointed, join_by_key, small_batches

#: Default tokenizers, files of public_tokenizers.
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Tokens of A in a lane, and characters that are encoded at once: ids take far more memory than their text.
LANE = 256
CHUNK_CHARS = 1 << 20


def byte_letters() -> dict[str, int]:
    """Byte-level BPE writes a printable Latin-1 byte as itself and the others, in order, as the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Pair:
    """The two tokenizers and their tokens' bytes. Files are read where the tasks run.

    A's vocabulary must hold its merges in the order of their ids; the same merges then run by rank, without the character offsets
    and strings that the tokenizers library makes for every token.
    """

    def __init__(self, byte_bpe: str | None = None, pieces: str | None = None) -> None:
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(byte_bpe or public_tokenizers.path(BYTE_BPE), encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocabulary = byte_letters(), model["vocab"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocabulary[m] for m in merged]
        if ids != sorted(set(ids)):
            raise ValueError("the vocabulary's ids must follow its merges")
        ranks = {bytes(letters[c] for c in t): vocabulary[t] for t in [*letters, *merged]}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = SentencePieceProcessor(model_file=pieces or public_tokenizers.path(PIECES))
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(t) for t in self.a_bytes])
        self.b_sizes = np.array([len(t) for t in self.b_bytes])
        #: What the digest writes for a token: an id, and what stands after it inside and at the end of its side of a group.
        a_ids, b_ids = range(len(self.a_bytes)), range(len(self.b_bytes))
        self.written = [*(f"{i}," for i in a_ids), *(f"{i}|" for i in a_ids), *(f"{i}," for i in b_ids), *(f"{i};" for i in b_ids)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B; none of either if one doesn't give back the bytes of the blank and the text."""
        b = self.b.encode(texts, num_threads=1)
        out, none = [], np.zeros(0, dtype=np.int64)
        for text, y in zip(texts, b, strict=True):
            want, x = b" " + text.encode("utf-8", "surrogatepass"), self.a.encode_ordinary(" " + text)
            same = text and b"".join(map(self.a_bytes.__getitem__, x)) == want and b"".join(map(self.b_bytes.__getitem__, y)) == want
            out.append((np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)) if same else (none, none))
        return out

    def groups_text(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: ids between cuts, which follow the tokens at ``i`` and ``j``; every token is part of a group.

        A token stands after the tokens of its own side before it and those of the other side in earlier groups, and for A's side of a
        group in none of its own.
        """
        what = np.empty(len(a) + len(b), dtype=np.int64)
        at_a, at_b = np.arange(len(a)), np.arange(len(b))
        of_a = at_a + np.concatenate(([0], j + 1))[np.searchsorted(i, at_a)]
        of_b = at_b + (i + 1)[np.searchsorted(j, at_b)]
        width_a, width_b = len(self.a_bytes), len(self.b_bytes)
        what[of_a] = a
        what[of_b] = 2 * width_a + b
        what[of_a[i]] += width_a
        what[of_b[j]] += width_b
        return "".join(map(self.written.__getitem__, what.tolist()))[:-1]


def lockstep(a_ends: list[np.ndarray], b_ends: list[np.ndarray], lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links as (document, token of A, token of B), in order, from the documents' ascending byte offsets where tokens end.

    A document's offsets must end at the same byte on both sides.
    """
    starts, stops, b_starts, b_stops, docs = [], [], [], [], []
    a_base = np.cumsum([0, *map(len, a_ends)])
    b_base = np.cumsum([0, *map(len, b_ends)])
    for d, (x, y) in enumerate(zip(a_ends, b_ends, strict=True)):
        if not len(x) or not len(y):
            continue
        first = np.arange(0, len(x), lane)
        last = np.minimum(first + lane, len(x))
        to = np.searchsorted(y, x[last - 1], "right")
        to[-1] = len(y)
        starts.append(first + a_base[d])
        stops.append(last + a_base[d])
        b_starts.append(np.concatenate(([0], to[:-1])) + b_base[d])
        b_stops.append(to + b_base[d])
        docs.append(np.full(len(first), d))
    if not docs:
        return (np.zeros(0, dtype=np.int64),) * 3
    i, i_stop, j, j_stop, doc = map(np.concatenate, (starts, stops, b_starts, b_stops, docs))
    a, b = np.concatenate(a_ends), np.concatenate(b_ends)
    found = []
    while len(i):
        live = (i < i_stop) & (j < j_stop)
        if not live.all():
            i, i_stop, j, j_stop, doc = i[live], i_stop[live], j[live], j_stop[live], doc[live]
            if not len(i):
                break
        x, y = a[i], b[j]
        same = x == y
        found.append((doc[same], i[same], j[same]))
        i = i + (x <= y)
        j = j + (y <= x)
    doc, i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(i, kind="stable")
    doc, i, j = doc[order], i[order], j[order]
    return doc, i - a_base[doc], j - b_base[doc]


#: A pair of ids is one number, a * B_IDS + b.
B_IDS = 1 << 32
FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, n array<int>"


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of together about CHUNK_CHARS characters."""
    held, chars = [], 0
    for t in texts:
        held.append(t)
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def found(pair: Pair, texts: list[str], lane: int = LANE) -> list[tuple]:
    """Rows of FOUND for the texts: counts, digest, and the distinct pairs of linked ids with their counts."""
    ids = pair.encode(texts)
    doc, i, j = lockstep([np.cumsum(pair.a_sizes[a]) for a, _ in ids], [np.cumsum(pair.b_sizes[b]) for _, b in ids], lane)
    at = np.searchsorted(doc, np.arange(len(ids) + 1))
    rows = []
    for d, (a, b) in enumerate(ids):
        x, y = i[at[d] : at[d + 1]], j[at[d] : at[d + 1]]
        pairs, n = np.unique(a[x] * B_IDS + b[y], return_counts=True)
        digest = hashlib.sha256(pair.groups_text(a, b, x, y).encode()).hexdigest() if len(a) else ""
        rows.append((len(a), len(b), len(x), len(x), digest, pairs, n.astype(np.int32)))
    return rows


def aligned(docs: DataFrame, byte_bpe: str | None = None, pieces: str | None = None) -> DataFrame:
    """doc_id with the columns of FOUND for every row of ``docs``: counts, digest of the groups, and the pairs of linked ids."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(FOUND)
    def align(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pair = Pair(byte_bpe, pieces)
        for texts in batches:
            rows = [row for chunk in chunks([t or "" for t in texts]) for row in found(pair, chunk)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in FOUND.split(", ")])

    return docs.select("doc_id", align("text").alias("f")).select("doc_id", "f.*")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best) of the rows (pair, n): how many links hold the pair of ids, and whether no pair with its B id has more."""
    counts = checkpointed(pairs.groupBy("pair").agg(F.sum("n").alias("count")))
    b = F.col("pair") % B_IDS
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def align_documents(docs: DataFrame, byte_bpe: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (all long), groups_sha256."""
    rows = checkpointed(aligned(docs, byte_bpe, pieces).withColumn("row", F.monotonically_increasing_id()))
    pairs = rows.select("row", F.explode(F.arrays_zip("pairs", "n")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.n").cast("long").alias("n"))
    counts = checkpointed(pair_counts(pairs))
    sums = join_by_key(pairs, counts.withColumn("links", F.col("count")), ["pair"], "links").groupBy("row")
    sums = sums.agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    whole = rows.drop("pairs", "n").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
