"""Small boosted models over binned dense features, fitted in numpy on a bounded sample.

A model is a plain dict of arrays: it is small (kilobytes) and travels to the executors inside the scoring function.
"""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner bin borders of each column, at its quantiles."""
    q = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], q)) if len(x) else np.zeros(0) for j in range(x.shape[1])]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int64)


def _gain(g, h, l2):
    return g * g / (h + l2)


def fit_gbt(x, y, trees=80, depth=3, rate=0.15, bins=48, l2=2.0, least=8.0) -> dict:
    """Gradient-boosted trees with logistic loss; each level splits every node at its best bin border."""
    edges = fit_edges(x, bins)
    b = to_bins(x, edges)
    n, d = b.shape
    width = bins
    base = float(np.log((y.sum() + 1.0) / (n - y.sum() + 1.0))) if n else 0.0
    raw = np.full(n, base)
    feats, cuts, leaves = [], [], []
    for _ in range(trees if n else 0):
        p = sigmoid(raw)
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feat, cut = [], []
        for level in range(depth):
            m = 1 << level
            best = np.full(m, 1e-9)
            bf, bc = np.zeros(m, dtype=np.int64), np.full(m, width, dtype=np.int64)  # no split: all go left
            for j in range(d):
                at = node * width + b[:, j]
                gl = np.bincount(at, g, m * width).reshape(m, width).cumsum(1)
                hl = np.bincount(at, h, m * width).reshape(m, width).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                ok = (hl * 4 >= least) & ((ht - hl) * 4 >= least)
                gain = np.where(ok, _gain(gl, hl, l2) + _gain(gt - gl, ht - hl, l2) - _gain(gt, ht, l2), 0)
                c = gain.argmax(1)
                v = gain[np.arange(m), c]
                take = v > best
                best[take], bf[take], bc[take] = v[take], j, c[take]
            feat.append(bf)
            cut.append(bc)
            node = node * 2 + (b[np.arange(n), bf[node]] > bc[node])
        gs, hs = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
        leaf = rate * gs / (hs + l2)
        raw += leaf[node]
        feats.append(np.concatenate(feat))
        cuts.append(np.concatenate(cut))
        leaves.append(leaf)
    return {"edges": edges, "base": base, "depth": depth, "feats": feats, "cuts": cuts, "leaves": leaves}


def raw_gbt(model: dict, x: np.ndarray) -> np.ndarray:
    b = to_bins(x, model["edges"])
    rows = np.arange(len(b))
    out = np.full(len(b), model["base"])
    for feat, cut, leaf in zip(model["feats"], model["cuts"], model["leaves"], strict=True):
        node = np.zeros(len(b), dtype=np.int64)
        for level in range(model["depth"]):
            at = (1 << level) - 1 + node
            node = node * 2 + (b[rows, feat[at]] > cut[at])
        out += leaf[node]
    return out


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres of the pooled blocks and their non-decreasing means."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weight, mean of y, mean of raw
    for r, t in zip(raw[order], y[order], strict=True):
        blocks.append([1.0, float(t), float(r)])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, m, c = blocks.pop()
            v = blocks[-1]
            s = v[0] + w
            blocks[-1] = [s, (v[0] * v[1] + w * m) / s, (v[0] * v[2] + w * c) / s]
    return np.array([b[2] for b in blocks]), np.array([b[1] for b in blocks])


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The isotonic fit between block centres; a trace of the raw score keeps the order inside flat blocks."""
    s = sigmoid(raw)
    return np.clip(0.999 * (np.interp(raw, *knots) if len(knots[0]) else s) + 0.001 * s, 0, 1)


def fit_calibrated_gbt(x, y, folds=3, **params) -> dict:
    """Trees on all rows; the isotonic map is fitted on scores of trees that did not see the row."""
    fold = np.arange(len(y)) % folds
    raw = np.zeros(len(y))
    for f in range(folds):
        if (fold == f).any():
            raw[fold == f] = raw_gbt(fit_gbt(x[fold != f], y[fold != f], **params), x[fold == f])
    return {"gbt": fit_gbt(x, y, **params), "knots": fit_isotonic(raw, y)}


def score_calibrated_gbt(model: dict, x: np.ndarray) -> np.ndarray:
    return calibrated(raw_gbt(model["gbt"], x), model["knots"])


def _step1(g, h, l2, least):
    """Update of one feature's table: a tree of up to four leaves over its bins."""

    def split(lo, hi):
        gc, hc = g[lo:hi].cumsum(), h[lo:hi].cumsum()
        gt, ht = gc[-1], hc[-1]
        ok = (hc * 4 >= least) & ((ht - hc) * 4 >= least)
        gain = np.where(ok, _gain(gc, hc, l2) + _gain(gt - gc, ht - hc, l2) - _gain(gt, ht, l2), 0)
        c = int(gain.argmax())
        return [(lo, lo + c + 1), (lo + c + 1, hi)] if gain[c] > 1e-9 else [(lo, hi)]

    out = np.zeros(len(g))
    for lo, hi in [y for x in split(0, len(g)) for y in split(*x)]:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + l2)
    return out


def _step2(g, h, l2):
    """Update of a pair's table: one cut of the first axis, then one cut of the second on each side. Also the gain."""
    best, cut = -1.0, None
    gc, hc = g.cumsum(0), h.cumsum(0)
    gt, ht = gc[-1], hc[-1]
    top = _gain(gt.sum(), ht.sum(), l2)
    lg, lh = gc[:-1].cumsum(1), hc[:-1].cumsum(1)
    rg, rh = (gt - gc[:-1]).cumsum(1), (ht - hc[:-1]).cumsum(1)
    side = lambda a, b: _gain(a[:, :-1], b[:, :-1], l2) + _gain(a[:, -1:] - a[:, :-1], b[:, -1:] - b[:, :-1], l2)
    left, right = side(lg, lh), side(rg, rh)
    total = left.max(1) + right.max(1) - top
    i = int(total.argmax())
    best, cut = float(total[i]), (i + 1, int(left[i].argmax()) + 1, int(right[i].argmax()) + 1)
    out = np.zeros_like(g)
    for rows, c in ((slice(0, cut[0]), cut[1]), (slice(cut[0], None), cut[2])):
        for cols in (slice(0, c), slice(c, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + l2)
    return out, best


def fit_gam(x, y, bins=32, pair_bins=8, pairs=6, rounds=150, pair_rounds=60, rate=0.08, l2=2.0, least=8.0) -> dict:
    """Additive model: features take turns, each turn adds a shallow tree to that feature's lookup table.

    Then the pairs with the largest gain on what is left are boosted in turn on coarse two-way tables.
    """
    edges = fit_edges(x, bins)
    coarse = fit_edges(x, pair_bins)
    b, c = to_bins(x, edges), to_bins(x, coarse)
    n, d = b.shape
    base = float(np.log((y.sum() + 1.0) / (n - y.sum() + 1.0))) if n else 0.0
    tables = [np.zeros(bins) for _ in range(d)]
    raw = np.full(n, base)

    def slopes():
        p = sigmoid(raw)
        return y - p, p * (1 - p)

    for _ in range(rounds if n else 0):
        for j in range(d):
            g, h = slopes()
            step = rate * _step1(np.bincount(b[:, j], g, bins), np.bincount(b[:, j], h, bins), l2, least)
            tables[j] += step
            raw += step[b[:, j]]
    cells = lambda i, j: c[:, i] * pair_bins + c[:, j]
    square = lambda at, v: np.bincount(at, v, pair_bins * pair_bins).reshape(pair_bins, pair_bins)
    chosen, pair_tables = [], []
    if n:
        g, h = slopes()
        gains = sorted(((_step2(square(cells(i, j), g), square(cells(i, j), h), l2)[1], i, j) for i in range(d) for j in range(d) if i != j), reverse=True)
        seen: set[frozenset] = set()
        for _, i, j in gains:
            if len(chosen) < pairs and frozenset((i, j)) not in seen:
                seen.add(frozenset((i, j)))
                chosen.append((i, j))
                pair_tables.append(np.zeros((pair_bins, pair_bins)))
        for _ in range(pair_rounds):
            for k, (i, j) in enumerate(chosen):
                g, h = slopes()
                at = cells(i, j)
                step = rate * _step2(square(at, g), square(at, h), l2)[0]
                pair_tables[k] += step
                raw += step.ravel()[at]
    return {"edges": edges, "coarse": coarse, "base": base, "tables": tables, "pairs": chosen, "pair_tables": pair_tables}


def score_gam(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability: one table lookup per feature and per pair, added up."""
    b, c = to_bins(x, model["edges"]), to_bins(x, model["coarse"])
    raw = np.full(len(x), model["base"])
    for j, t in enumerate(model["tables"]):
        raw += t[b[:, j]]
    for (i, j), t in zip(model["pairs"], model["pair_tables"], strict=True):
        raw += t[c[:, i], c[:, j]]
    return sigmoid(raw)
