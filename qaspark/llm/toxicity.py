"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of two insult lexicons, closeness of insults to second-person words, capitals, punctuation, and how much is
obfuscated (letters replaced by digits or signs, also insults found only after undoing that). One lexicon is fixed; the other holds
word stems that the labels mark, for languages and coinages that a fixed list misses. Each half of the training rows gets the stems
learned from the other half, so that the trees see how far unseen stems can be trusted; scoring uses the stems of all of them.

Edge cases: a null or empty text gets the score of a text without words; a text of any length is read whole; null labels and null ids
are not learned from; rows that repeat an id are scored each by its own text, and equal texts alike; a tie, a score equal to the
threshold, counts as 1; an empty label table gives a constant score, an empty table no rows; extra columns are ignored by ``score_documents`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re

from collections import Counter
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm import boosting
from qaspark.llm.classify import DIGIT, LOWER, MARK, UPPER, byte_counts, matrix, scored, training_rows
from qaspark.llm.common import held_out, small_batches

# Insults by language, and second-person words.
INSULTS = frozenset(
    """idiot idiots idiotic moron morons moronic stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns
    imbecile fool fools foolish jerk bastard bitch asshole shit crap fuck fucking damn retard retarded ugly filthy vermin parasite
    degenerate coward liar swine
    idiote idioten dumm dummkopf trottel arschloch scheisse scheiße abschaum versager widerlich wertlos erbärmlich
    crétin imbécile connard connasse merde salaud ordure débile minable dégoûtant pute
    idiota imbécil estúpido estúpida basura asqueroso patético inútil mierda cabrón puta pendejo escoria""".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur youre du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
OPENERS = "\"'([{<*_-.,"
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")

_LETTERS = re.compile(r"[^\W\d_]+")
_SIGN_IN_WORD = re.compile(r"[^\W\d_][013457@$!*.\-_]+[^\W\d_]|[013457@$!][^\W\d_]")
_JOINTS = re.compile(r"[^\W_]")


#: Letters in a stem (whole words count too), most stems in the learned lexicon, fewest toxic texts that hold a stem, least ratio of its shares.
STEM_LENGTHS = (4, 6, 8)
STEMS = 1000
STEM_TEXTS = 4
STEM_RATIO = 12.0


def stems_of(tokens: set[str]) -> set[str]:
    return {t[:k] for t in tokens for k in STEM_LENGTHS if len(t) >= k} | {t for t in tokens if len(t) > 3}


def learn_stems(rows: DataFrame) -> list[frozenset]:
    """Stems far more frequent in toxic than in other texts: from half 0, from half 1, and from all training rows.

    Texts that hold a stem are counted per partition, then summed; only the marked stems, ``STEMS`` at most, come back.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counter()
        for b in batches:
            for text, label, half in zip(b["text"], b["_label"], b["_half"], strict=True):
                seen.update((s, half, label) for s in stems_of(set(_LETTERS.findall((text or "").lower()))))
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["stem", "half", "label", "n"])

    counts = rows.select("text", "_label", "_half").mapInPandas(count, "stem string, half long, label int, n long")
    sizes = {(r["_half"], r["_label"]): r["count"] for r in rows.groupBy("_half", "_label").count().collect()}
    found = []
    for halves in ((0,), (1,), (0, 1)):
        toxic = sum(sizes.get((h, 1), 0) for h in halves)
        other = sum(sizes.get((h, 0), 0) for h in halves)
        marked = (
            counts.where(F.col("half").isin(*halves))
            .groupBy("stem")
            .agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("o"))
            .where((F.col("t") >= STEM_TEXTS) & (F.col("t") * max(other, 1) >= STEM_RATIO * (F.col("o") + 1) * max(toxic, 1)))
            .orderBy(F.desc("t"), "stem")
            .limit(STEMS)
        )
        found.append(frozenset(r["stem"] for r in marked.select("stem").collect()))
    return found


def features(text: str, stems: frozenset = frozenset()) -> list[float]:
    """Dense features of one whole text; an empty text gives zeros."""
    low = text.lower()
    tokens = _LETTERS.findall(low)
    n = max(1, len(tokens))
    kinds = set(tokens)
    coined = {t for t in kinds if t in stems or t[:4] in stems or t[:6] in stems or t[:8] in stems} if stems else set()
    insults = (kinds & INSULTS) | coined
    hits = [i for i, t in enumerate(tokens) if t in insults] if insults else []
    fixed = sum(tokens[i] in INSULTS for i in hits)
    persons = [i for i, t in enumerate(tokens) if t in SECOND_PERSON]
    near, closest = 0, 0.0
    if hits and persons:
        p = np.array(persons)
        at = np.searchsorted(p, hits)
        gap = np.minimum(np.abs(p[np.minimum(at, len(p) - 1)] - hits), np.abs(p[np.maximum(at - 1, 0)] - hits))
        near, closest = int((gap <= 5).sum()), float(1.0 / gap.min()) if gap.min() else 1.0
    odd = [w for w in (w.rstrip(punctuation).lstrip(OPENERS) for w in low.split() if not w.isalpha()) if not w.isalpha()]
    disguised = [w for w in odd if _SIGN_IN_WORD.search(w)]
    hidden = sum("".join(_JOINTS.findall(w.translate(LOOKALIKE))) in INSULTS for w in disguised)
    c = byte_counts(text)
    size = max(1, len(text))
    upper, lower = float(c @ UPPER), float(c @ LOWER)
    return [
        fixed / n,
        float(np.log1p(fixed)),
        (len(hits) - fixed) / n,
        float(np.log1p(len(hits) - fixed)),
        len(hits) / n,
        float(len(insults)),
        len(persons) / n,
        near / n,
        closest,
        upper / max(1.0, upper + lower),
        float(c @ MARK) / size,
        c[33] / size,
        float(c @ DIGIT) / size,
        len(disguised) / n,
        float(hidden),
        hidden / n,
        float(np.log1p(len(tokens))),
        sum(map(len, tokens)) / n,
        len(kinds) / n,
    ]


def fit(docs: DataFrame, labels: DataFrame, **params) -> dict:
    """Model from a bounded sample (``classify.SAMPLE_ROWS``) of the rows that are not held out."""
    rows = training_rows(docs, labels, "toxic")
    stems = learn_stems(rows)
    x, y = matrix(rows, lambda text, half: features(text, stems[1 - half]))
    return {"stems": stems[2]} | boosting.fit_calibrated_gbt(x, y, **params)


def toxicity(docs: DataFrame, labels: DataFrame):
    """Column with the score of ``text``, by a model fitted on ``labels``."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels)
    stems = model["stems"]
    return scored(F.col("text"), model, lambda text: features(text, stems), boosting.score_calibrated_gbt)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    return docs.select("doc_id", held_out().alias("held_out"), toxicity(docs, labels).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored at the threshold or above; all columns stay."""
    return docs.where(toxicity(docs, labels) < threshold)
