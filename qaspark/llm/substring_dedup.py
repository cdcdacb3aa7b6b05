"""Substring dedup: seed and extend over winnowed anchors.

Seeds: of every 50-word window, the smallest hash of its 25-word runs is the anchor (winnowing), so equal windows have equal
anchors, and a text keeps about one anchor in thirteen words. Documents are joined on anchors; those in one document only are
dropped. The document with the smallest id that has an anchor is its owner and offers the words around its anchor. In every other
document that has the anchor, the match is extended from it word by word to both sides, as far as the words agree and windows with
this anchor reach; extensions from neighbouring anchors overlap, and their union is the maximal repeat. It counts from 50 words on.

A window that doesn't match its owner's words, but those of a third document, is found by what is left over: such windows, keyed
by anchor and 128 bits of hash over their words, are reduced to their smallest id and joined back. Whether a window matches the
owner's words depends on the window alone, so equal windows are either all extended or all left over, and the result is exact.
No pairs of documents are made, however many share a passage: every anchor has one owner, every left-over window one smallest id.

Copies of a whole text are settled by 128 bits of the text's hash and take no part in the anchors.

Edge cases: a null text has no words; texts below 50 words have no windows and lose nothing; a text of any length, or of one word
repeated, is processed whole; rows of equal id never remove words from each other, and if their texts differ, each loses its own
words; repeated rows give equal results; rows without an id neither lose words nor take any; repeats inside one document stay; an
empty table gives no rows; extra columns, of whatever name, are ignored by ``repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaspark.llm.common import checkpointed, join_by_key, private, small_batches, small_or_shuffled, written
from qaspark.llm.shingling import run_hashes, word_hashes

WINDOW = 50
RUN = 25
#: Words to each side of an anchor that some window with this anchor can reach.
SIDE = WINDOW - RUN

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # ASCII blanks: space and \x09 to \x0D


def _anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all RUN-word runs, and the position of the anchor of each window: the leftmost smallest run in it."""
    runs = run_hashes(h, RUN)
    span = WINDOW - RUN + 1
    at = np.arange(len(runs))
    step = 1
    while 2 * step <= span:  # smallest of 2, 4, 8, 16 runs
        left, right = at[:-step], at[step:]
        at = np.where(runs[right] < runs[left], right, left)
        step *= 2
    left, right = at[: len(runs) - span + 1], at[span - step :]
    return runs, np.where(runs[right] < runs[left], right, left)


@F.pandas_udf(T.ArrayType(T.LongType()))
def anchors(texts: pd.Series) -> pd.Series:
    """Distinct anchor hashes of each text."""

    def one(text):
        words = _words(text)
        if len(words) < WINDOW:
            return np.zeros(0, dtype=np.int64)
        runs, at = _anchors(word_hashes(words))
        return np.unique(runs[at]).view(np.int64)

    return pd.Series([one(t) for t in texts])


_PLACES = "doc_id long, print binary, anchor long, mine boolean, left binary, right binary, at binary"


def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each place of a shared anchor in a text: word hashes of the SIDE words to its left and right, and ``at``.

    ``at`` holds int32 triples: the anchor's position, and the first and last start of the windows that it stands for. Places of
    one anchor with the same words around them share a row, so a text of one word repeated makes few.
    """
    for b in batches:
        for doc_id, kind, text, shared in zip(b["doc_id"], b["print"], b["text"], b["shared"], strict=True):
            h = word_hashes(_words(text))
            runs, at = _anchors(h)
            first = np.flatnonzero(np.diff(at, prepend=-1))  # starts of the windows where the anchor changes
            last = np.append(first[1:], len(at)) - 1
            keys = runs[at[first]].view(np.int64)
            owned = {s["anchor"]: s["mine"] for s in shared}
            found: dict[tuple, list[int]] = {}
            for k in np.flatnonzero(np.isin(keys, np.fromiter(owned, dtype=np.int64, count=len(owned)))).tolist():
                p = int(at[first[k]])
                place = int(keys[k]), h[max(0, p - SIDE) : p].tobytes(), h[p + RUN : p + WINDOW].tobytes()
                found.setdefault(place, []).extend((p, int(first[k]), int(last[k])))
            rows = [(doc_id, kind, a, owned[a], left, right, np.array(x, dtype=np.int32).tobytes()) for (a, left, right), x in found.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "print", "anchor", "mine", "left", "right", "at"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


_MATCHES = "doc_id long, print binary, start int, n int, anchor long, window binary"


def extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of windows that match the owner's words (window: null), and the windows left over, one by one."""
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            left, right = np.frombuffer(r.left, dtype=np.uint64), np.frombuffer(r.right, dtype=np.uint64)
            before = len(left) if r.left == r.own_left else _common(left[::-1], np.frombuffer(r.own_left, dtype=np.uint64)[::-1])
            after = len(right) if r.right == r.own_right else _common(right, np.frombuffer(r.own_right, dtype=np.uint64))
            hashes: dict[int, bytes] = {}
            for p, lowest, highest in np.frombuffer(r.at, dtype=np.int32).reshape(-1, 3).tolist():
                low, high = max(lowest, p - before), min(highest, p + after - SIDE)
                if low > high:
                    low, high = highest + 1, highest
                elif r.doc_id > r.owner:
                    rows.append((r.doc_id, r.print, low, high - low + 1, None, None))
                for s in (*range(lowest, low), *range(high + 1, highest + 1)):
                    k = p - s  # words of the window before the anchor
                    if k not in hashes:
                        around = r.left[len(r.left) - 8 * k :] + r.right[: 8 * (SIDE - k)]
                        hashes[k] = xxhash.xxh3_128_digest(around, k)
                    rows.append((r.doc_id, r.print, s, 1, r.anchor, hashes[k]))
        yield pd.DataFrame(rows, columns=["doc_id", "print", "start", "n", "anchor", "window"]).astype({"anchor": "Int64"})


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("n", T.IntegerType())))
def merged(found: pd.Series) -> pd.Series:
    """Runs of windows put together where one goes on from another: the maximal repeats of a document."""

    def one(runs):
        s = np.array([r["start"] for r in runs], dtype=np.int64)
        end = s + np.array([r["n"] for r in runs], dtype=np.int64)
        order = np.argsort(s, kind="stable")
        s, end = s[order], np.maximum.accumulate(end[order])
        heads = np.flatnonzero(np.append(True, s[1:] > end[:-1]))
        return [{"start": a, "n": b - a} for a, b in zip(s[heads].tolist(), end[np.append(heads[1:], len(s)) - 1].tolist(), strict=True)]

    return pd.Series([one(r) for r in found])


def _cover(n: int, gone) -> np.ndarray:
    """Which of ``n`` words lie in the runs of windows (start, n) that go."""
    s, k = (np.array([g[x] for g in gone], dtype=np.int64) for x in ("start", "n"))
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, s, 1)
    np.add.at(cover, s + k + WINDOW - 1, -1)
    return np.cumsum(cover)[:-1] > 0


def _kept(words: list[bytes], gone, whole: bool) -> list[bytes]:
    if whole and len(words) >= WINDOW:
        return []
    if gone is None or not len(gone):
        return words
    return [w for w, g in zip(words, _cover(len(words), gone), strict=True) if not g]


@F.pandas_udf(T.StructType().add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType()))
def digest(texts: pd.Series, gone: pd.Series, whole: pd.Series) -> pd.DataFrame:
    rows = []
    for t, s, w in zip(texts, gone, whole, strict=True):
        words = _words(t)
        kept = _kept(words, s, w is True)
        rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])


def _cut(text: str, gone, whole: bool) -> str:
    """The text without the words that go: each stretch that stays keeps its blanks; a gap becomes one blank, or one line break."""
    at = [m.span() for m in _WORD.finditer(text)]
    if whole and len(at) >= WINDOW:
        return ""
    if gone is None or not len(gone):
        return text
    cover = _cover(len(at), gone)
    edges = np.flatnonzero(np.diff(cover, prepend=True))  # where stretches start to stay or to go
    out, end = [], None
    for first, last in zip(edges[::2].tolist(), [*edges[1::2].tolist(), len(at)], strict=False):
        start = at[first][0]
        if end is not None:
            out.append("\n" if "\n" in text[end:start] else " ")
        end = at[last - 1][1]
        out.append(text[start:end])
    return "".join(out)


@F.pandas_udf(T.StringType())
def remaining(texts: pd.Series, gone: pd.Series, whole: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _cut(t, s, w is True) for t, s, w in zip(texts, gone, whole, strict=True)], dtype=object)


def text_print(text: Column) -> Column:
    """128 bits of a text's hash; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, print, gone (runs of windows: start and number) and whole (copy of a smaller id's text) of the rows that lose words."""
    small_batches(docs.sparkSession)
    key = ["doc_id", "print"]
    docs = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * WINDOW - 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_print(F.col("text")).alias("print"))
    prints, drop_prints = written(docs.select(key))
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("copies"))
    firsts = checkpointed(firsts.where("first < last").drop("last"))
    copies = checkpointed(join_by_key(prints, firsts, ["print"], "copies").where("doc_id > first").select(key).distinct())
    drop_prints()

    originals = docs.join(small_or_shuffled(copies), key, "left_anti")
    seeds, drop_seeds = written(originals.select(*key, F.explode(anchors("text")).alias("anchor")))
    owners = seeds.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("places"))
    owners = checkpointed(owners.where("owner < last").drop("last"))
    shared = join_by_key(seeds, owners, ["anchor"], "places").select(*key, F.struct("anchor", (F.col("doc_id") == F.col("owner")).alias("mine")).alias("a"))
    shared = checkpointed(shared.groupBy(*key).agg(F.collect_set("a").alias("shared")))
    drop_seeds()

    found, drop_found = written(originals.join(small_or_shuffled(shared, array="shared"), key).select("doc_id", "print", "text", "shared").mapInPandas(places, _PLACES))
    around = found.where("mine").groupBy("anchor").agg(F.min(F.struct("left", "right")).alias("w"), F.min("doc_id").alias("owner"))
    around = around.join(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("places")), "anchor")
    around, drop_around = written(around.select("anchor", "owner", F.col("w.left").alias("own_left"), F.col("w.right").alias("own_right"), "places"))
    matches, drop_matches = written(join_by_key(found, around, ["anchor"], "places", 16 * WINDOW).mapInPandas(extended, _MATCHES))
    drop_found()
    drop_around()

    over = matches.where("window is not null")
    least = over.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("places"))
    least = checkpointed(least.where("first < last").drop("last"))
    rest = join_by_key(over, least, ["anchor", "window"], "places").where("doc_id > first")
    runs = matches.where("window is null").select(*key, "start", "n").unionByName(rest.select(*key, "start", "n"))
    gone = checkpointed(runs.groupBy(*key).agg(merged(F.collect_list(F.struct("start", "n"))).alias("gone")))
    drop_matches()
    return checkpointed(gone.withColumn("whole", F.lit(False)).unionByName(copies.select(*key, F.lit(None).cast(gone.schema["gone"].dataType).alias("gone"), F.lit(True).alias("whole"))))


def _marked(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with what goes of each row, and the names of the two columns that say it."""
    found = repeated_runs(docs.select("doc_id", "text"))
    gone, whole, kind = (private(x, docs) for x in ("gone", "whole", "print"))
    found = found.withColumnsRenamed({"gone": gone, "whole": whole, "print": kind})
    return docs.withColumn(kind, text_print(F.col("text"))).join(small_or_shuffled(found, array=gone), ["doc_id", kind], "left"), gone, whole


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``."""
    marked, gone, whole = _marked(docs.select("doc_id", "text"))
    return marked.select("doc_id", digest("text", gone, whole).alias("d")).select("doc_id", "d.*")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; n_chars, where there is one, is counted anew."""
    marked, gone, whole = _marked(docs)
    marked = marked.withColumn("text", remaining("text", gone, whole))
    if "n_chars" in docs.columns:
        marked = marked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return marked.select(docs.columns)
