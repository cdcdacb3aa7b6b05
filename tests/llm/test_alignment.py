"""Cross-tokenizer alignment against a plain loop over both token lists."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from qaspark.llm import alignment

SCHEMA = "doc_id long, text string, row int, pairs string, n int, pair long, f string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p", 2, 3, "f") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair()


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_BPE))
    found.encode_special_tokens = True
    return found


def plain_links(pair, library, text):
    """Ids of both sides and all (i, j) whose byte ranges end together, by looking at every pair of offsets."""
    letters = {c: b for c, b in alignment.byte_letters().items()}
    a = library.encode(" " + text, add_special_tokens=False) if text else None
    b = pair.b.encode(text) if text else []
    if not text:
        return [], [], []
    a_bytes = [bytes(letters[c] for c in token) for token in a.tokens]
    b_bytes = [bytes([int(p[3:5], 16)]) if pair.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, pair.b.id_to_piece(k)) for k in b)]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return [], [], []
    ends = lambda parts: [len(b"".join(parts[: k + 1])) for k in range(len(parts))] if len(parts) < 300 else list(np.cumsum([len(p) for p in parts]))
    y = {e: j for j, e in enumerate(ends(b_bytes))}
    return a.ids, b, [(i, y[e]) for i, e in enumerate(ends(a_bytes)) if e in y]


def plain(pair, library, rows):
    each = [(d, *plain_links(pair, library, t or "")) for d, t in rows]
    counts = Counter((a[i], b[j]) for _, a, b, links in each for i, j in links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = Counter()
    for d, a, b, links in each:
        parts, u, v = [], 0, 0
        for i, j in links:
            parts.append(",".join(map(str, a[u : i + 1])) + "|" + ",".join(map(str, b[v : j + 1])))
            u, v = i + 1, j + 1
        ids = [(a[i], b[j]) for i, j in links]
        sha = hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""
        out[d, len(a), len(b), len(parts), len(links), sum(counts[p] == most[p[1]] for p in ids), sum(counts[p] for p in ids), sha] += 1
    return out


def test_alignment_equals_plain_loop(spark, pair, library):
    rng = random.Random(4)
    bits = ["the ", "house", " Straße", "ñandú", "\n", "\t", "  ", "123", "<|endoftext|>", "<s>", "<0x0A>", "漢字", "🙂", "é", "don't", "...", " x", "́"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "▁ mark"), (104, "\x00zero"), (105, "word " * 9000), (None, "no id"), (106, "same"), (106, "same"), (107, "x" * 3000), (108, "ﬁ ligature")]
    got = alignment.align_documents(table(spark, rows)).collect()
    assert Counter(map(tuple, got)) == plain(pair, library, rows)
    zeros = [r for r in got if r.doc_id in (100, 101, 103)]
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in zeros)
    assert alignment.align_documents(table(spark, [])).isEmpty()


@pytest.mark.parametrize("lane", [1, 3, 64, 10**6])
def test_lockstep_in_lanes(lane):
    rng = np.random.default_rng(7)
    sides = [[], []]
    for n in [1, 2, 5, 40, 300, 0]:
        for side in sides:
            ends = np.unique(rng.integers(1, 4 * n + 1, n)) if n else np.zeros(0, dtype=np.int64)
            side.append(np.unique(np.append(ends, 4 * n)) if n else ends)
    got = list(zip(*(c.tolist() for c in alignment.lockstep(*sides, lane)), strict=True))
    want = [(d, i, list(y).index(e)) for d, (x, y) in enumerate(zip(*sides, strict=True)) for i, e in enumerate(x) if e in y]
    assert got == want
