"""The small models against plain versions: trees by trying every split, isotonic fits by their formula, tables by single lookups."""

import math
import random

import numpy as np
import pytest

from qaspark.llm import boosting, quality, toxicity


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(120, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=120) > 0).astype(float)
    return x, y


def plain_tree(x, y, raw, rows, depth, edges, rate, l2, out):
    """Leaf values of the rows by trying every feature and border; a node with no gain keeps its rows together."""
    p = 1 / (1 + np.exp(-raw))
    g, h = y - p, p * (1 - p)
    gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
    best, cut = 1e-9, None
    for j in range(x.shape[1]) if depth else ():
        for e in edges[j]:
            left, right = rows[x[rows, j] <= e], rows[x[rows, j] > e]
            if len(left) and len(right) and gain(left) + gain(right) - gain(rows) > best + 1e-12:
                best, cut = gain(left) + gain(right) - gain(rows), (left, right)
    if cut is None:
        out[rows] = rate * g[rows].sum() / (h[rows].sum() + l2)
    else:
        for side in cut:
            plain_tree(x, y, raw, side, depth - 1, edges, rate, l2, out)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_trees_equal_every_split_tried(data, depth):
    x, y = data
    model = boosting.fit_gbt(x, y, trees=5, depth=depth, rate=0.3, bins=8, l2=2.0, least=0.0)
    edges = boosting.fit_edges(x, 8)
    raw = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(5):
        out = np.zeros(len(y))
        plain_tree(x, y, raw, np.arange(len(y)), depth, edges, 0.3, 2.0, out)
        raw = raw + out
    assert np.allclose(boosting.raw_gbt(model, x), raw)


def test_isotonic_fit_equals_its_formula(data):
    rng = np.random.default_rng(1)
    raw = np.sort(rng.normal(size=40))
    y = (rng.random(40) < 1 / (1 + np.exp(-raw))).astype(float)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    centres, means = boosting.fit_isotonic(raw, y)
    blocks = np.abs(raw[:, None] - centres).argmin(1)
    assert sorted(set(np.round(means, 9))) == sorted(set(np.round(want, 9)))
    assert np.allclose(np.maximum.accumulate(want), want) and len(set(blocks)) == len(centres)


def test_additive_model_is_the_sum_of_its_tables(data):
    x, y = data
    model = boosting.fit_gam(x, y, bins=8, pair_bins=4, pairs=2, rounds=10, pair_rounds=5)
    bin_of = lambda v, e: sum(v > b for b in e)
    for row, got in zip(x, boosting.score_gam(model, x), strict=True):
        total = model["base"] + sum(t[bin_of(row[j], model["edges"][j])] for j, t in enumerate(model["tables"]))
        total += sum(t[bin_of(row[i], model["coarse"][i]), bin_of(row[j], model["coarse"][j])] for (i, j), t in zip(model["pairs"], model["pair_tables"], strict=True))
        assert got == pytest.approx(1 / (1 + math.exp(-total)))
    assert len(model["pairs"]) == 2 and len({frozenset(p) for p in model["pairs"]}) == 2


def test_a_tables_step_is_the_best_cut():
    rng = np.random.default_rng(4)
    g, h = rng.normal(size=6), rng.random(6) + 1
    score = lambda s: g[s].sum() ** 2 / (h[s].sum() + 2.0)
    cuts = {c: score(slice(0, c)) + score(slice(c, None)) for c in range(1, 6)}
    first = max(cuts, key=cuts.get)
    step = boosting._step1(g, h, 2.0, 0.0)
    assert cuts[first] > score(slice(0, 6)) and step[first - 1] != step[first]
    for part in (range(first), range(first, 6)):
        values = [step[i] for i in part]
        assert 1 <= len(set(values)) <= 2


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_long_texts_and_ids_with_two_texts(spark, module, label):
    rng = random.Random(2)
    docs = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(30)) + (" you idiot !!!" * 3 if i % 3 == 0 else ".")) for i in range(90)]
    labels = [(i, int((i % 3 == 0) == (label == "toxic"))) for i in range(90)]
    docs += [(500, "you idiot " * 60_000), (501, "word " * 60_000 + "."), (502, "a plain text."), (502, "you idiot !!! you idiot"), (503, "same"), (503, "same"), (504, None), (504, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = module.score_documents(df, spark.createDataFrame(labels, f"doc_id long, {label} int")).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[502]) == 2 and len(by[503]) == 1 and len(by[504]) == 1
