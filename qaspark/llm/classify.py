"""The two document classifiers' common frame: bounded sample, features in Arrow batches, scores for every whole text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import checkpointed, held_out, small_batches

#: Most labelled rows that a model is fitted on, taken by smallest hash of their id.
SAMPLE_ROWS = 20_000

#: Characters of ASCII, by kind, as 0/1 vectors over byte values.
_ASCII = [chr(i) for i in range(128)]
_kind = lambda ok: np.array([float(ok(c)) for c in _ASCII] + [0.0] * 128)
UPPER, LOWER = _kind(str.isupper), _kind(str.islower)
DIGIT, SPACE = _kind(str.isdigit), _kind(str.isspace)
MARK = _kind(lambda c: not c.isalnum() and not c.isspace() and c.isprintable())
STOP = _kind(lambda c: c in ".,;:'\"-()?")
HIGH = np.array([0.0] * 128 + [1.0] * 128)


def byte_counts(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents that are not held out: doc_id, text, _label and _half (0 or 1, by id).

    The sampled ids are bounded, so they are broadcast and the documents are not shuffled. Null labels and null ids are
    left out; an id labelled twice counts once, with its largest label; of equal texts one is kept.
    """
    small_batches(docs.sparkSession)
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("_half", F.abs(F.xxhash64("doc_id", F.lit(7))) % 2)
    one = F.min_by(F.struct("doc_id", "text", "_label", "_half"), F.col("doc_id"))
    return checkpointed(found.groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).agg(one.alias("r")).select("r.*"))


def matrix(rows: DataFrame, features: Callable[[str, int], list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Features (of text and half) and labels of the bounded training rows, ordered by id."""

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series, halves: pd.Series) -> pd.Series:
        return pd.Series([features(t or "", h) for t, h in zip(texts, halves, strict=True)])

    got = rows.select("doc_id", "_label", vector("text", "_half").alias("_vector")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["_vector"].tolist(), dtype=float).reshape(-1, len(features("", 0)))
    return x, got["_label"].to_numpy(dtype=float)


def scored(text: Column, model: dict, features: Callable[[str], list[float]], score: Callable[[dict, np.ndarray], np.ndarray]) -> Column:
    """Score of every whole text; null counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        width = len(features(""))
        for texts in batches:
            x = np.array([features(t or "") for t in texts], dtype=float).reshape(-1, width)
            yield pd.Series(score(model, x))

    return run(text)
