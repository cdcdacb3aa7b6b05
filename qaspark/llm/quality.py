"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted in turn over the features, add up to one lookup table per feature and one per chosen pair; scoring adds the
table entries of a row's bins, vectorised over Arrow batches.

Edge cases: a null or empty text gets the score of a text without words; a text of any length is read whole; null labels and null ids
are not learned from; rows that repeat an id are scored each by its own text, and equal texts alike; a tie, a score equal to the
threshold, counts as 1; an empty label table gives a constant score, an empty table no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm import boosting
from qaspark.llm.classify import DIGIT, HIGH, LOWER, MARK, SPACE, STOP, UPPER, byte_counts, matrix, scored, training_rows
from qaspark.llm.common import held_out, small_batches

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    """the of and to in a is that for it was on with as at by this are be or from an not have but they you he she we
    der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
    le la les de des et un une du en que est pour dans qui sur avec par pas au plus il elle ne ce
    el los las y que en un una por con no para es al lo como más su se del""".split()
)
_ODD = re.compile(r"[^\w\s.,;:'\"()?\-]")


def features(text: str) -> list[float]:
    """Dense features of one whole text; an empty text gives zeros."""
    ws = text.split()
    n = max(1, len(ws))
    size = max(1, len(text))
    low = [w.lower() for w in ws]
    counts = Counter(low)
    top = max(counts.values(), default=0)
    lengths = np.fromiter(map(len, ws), dtype=float, count=len(ws)) if ws else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    c = byte_counts(text)
    upper, lower = float(c @ UPPER), float(c @ LOWER)
    ends = sum(text.count(x) for x in (". ", ".\n", "! ", "? ")) + text.endswith((".", "!", "?"))
    return [
        float(np.log1p(len(ws))),
        float(lengths.mean()),
        float(lengths.std()),
        upper / max(1.0, upper + lower),
        float(c @ DIGIT) / size,
        float(c @ MARK - c @ STOP) / size,
        float(c @ STOP) / size,
        float(c @ SPACE) / size,
        float(c @ HIGH) / size,
        len(counts) / n,
        top / n,
        len(set(zip(low, low[1:], strict=False))) / n,
        sum(counts[w] for w in FUNCTION_WORDS & counts.keys()) / n,
        len(ws) / max(1, ends),
        len(set(lines)) / m,
        len(ws) / m,
        c[124] / n,
        c[33] / n,
        sum(x.isupper() for x in ws) / n,
        sum(1 for w in ws if _ODD.search(w)) / n,
        sum(map(str.isalpha, ws)) / n,
        (text.count("http") + text.count("www.") + c[64]) / n,
        float(lengths.max()),
    ]


def fit(docs: DataFrame, labels: DataFrame, **params) -> dict:
    """Model from a bounded sample (``SAMPLE_ROWS``) of the rows that are not held out."""
    x, y = matrix(training_rows(docs, labels, "quality"), lambda text, _: features(text))
    return boosting.fit_gam(x, y, **params)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels)
    return docs.select("doc_id", held_out().alias("held_out"), scored(F.col("text"), model, features, boosting.score_gam).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
