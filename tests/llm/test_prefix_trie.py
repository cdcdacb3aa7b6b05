"""The conversation prefix trie against a plain trie, with nulls, ties, repeats, long chains and clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from qaspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, id binary, n long, block int"


def plain(rows):
    """Every node's row, from tuples of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    members, kids, ends, leaves, saved = defaultdict(set), defaultdict(set), defaultdict(list), defaultdict(int), defaultdict(int)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made = tuple(own.get(base, [])[:h] + turns[h:])
        ends[made].append(c)
        for d in range(len(made) + 1):
            members[made[:d]].add(c)
            if d:
                kids[made[: d - 1]].add(made[:d])
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids.get(node)
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1]) if node else 0)
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    up = lambda node: min(members[node[:-1]]) if node else None
    return [(min(m), len(n), up(n), len(m), len(kids.get(n, ())), leaves[n], saved[n], sha(n)) for n, m in members.items()]


def check(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 1, b"z", 2, 3) for r in rows], SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))


def test_trie_equals_plain_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 16)  # a chain of 150 turns spans blocks
    monkeypatch.setattr(prefix_trie, "BLOCK_ID_BITS", 3)  # members of a node span blocks of ids
    rng = random.Random(3)
    ids = [*range(40), 100, 101, 150, 205, 299, -5, -105, -100]
    rows = [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", None, "", "é€"])) for c in ids for t in range(rng.randrange(9))]
    rows += [(None, 1, "user", "x"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "system", "aa"), (8, 1, "user", "long " * 20000)]
    rows += [(300 + i, t, "user", f"same {t}") for i in range(40) for t in range(3)]
    rows += [(402, t, "user", f"turn {t % 7}") for t in range(150)]
    rng.shuffle(rows)
    check(spark, rows)


def test_one_chain_and_turnless_conversations(spark):
    lost = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 3)
    check(spark, [(lost, 0, "user", "only")])  # its base is absent and its own turn is cut: a member of the root
    check(spark, [(200, t, "user", "x") for t in range(9)])


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).isEmpty()


@pytest.mark.parametrize("shape", ["chain", "star", "caterpillar"])
def test_subtree_totals(spark, shape):
    n = 64
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "caterpillar": lambda i: i - 1 if i % 2 else max(i - 2, 0)}[shape]
    parent = {i: up(i) if i else None for i in range(n)}
    want = {i: 0 for i in parent}
    for i in parent:
        at = i
        while at is not None:
            want[at] += i
            at = parent[at]
    rows = [(bytes([i]), None if p is None else bytes([p]), i) for i, p in parent.items()]
    got = prefix_trie.subtree_totals(spark.createDataFrame(rows, "id binary, parent binary, v long"), ["v"]).collect()
    assert {r.id[0]: r.v for r in got} == want and len(got) == n
