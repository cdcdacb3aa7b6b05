"""Line dedup against a plain count, and its runs."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from qaspark.llm import line_runs

SCHEMA = "doc_id long, text string, lines int, pos string, kept string, k1 int, line string, batch int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p", "k", 2, "l", 3) for i, t in rows], SCHEMA)


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, least):
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(i)
    gone = {k for k, d in docs.items() if k and len(d) >= least}
    return [(i, t, [x for x in (t or "").split("\n") if key(x) not in gone]) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    common = [f"Common line {i}" for i in range(12)]
    rows = []
    for i in range(120):
        lines = [f"own {i} {k}" for k in range(rng.randrange(4))]
        lines += [rng.choice(["  ", "", "\t"]) + rng.choice(common[: 1 + i % 12]).swapcase() + rng.choice(["", " \r", "\x0b"]) for _ in range(rng.randrange(5))]
        lines += ["é accent", "É accent", ""][: rng.randrange(4)]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, "nine documents\nhold this") for i in range(9)] + [(220 + i, "ten documents\nhold that\n") for i in range(10)]
    rows += [(300, "ten times in one document\n" * 20), (301, None), (302, ""), (303, "\n\n"), (None, "no id\nHOLD THIS"), (None, "no id")]
    rows += [(304, "own a"), (304, "own b"), (304, "own b"), (305, "word " * 50000 + "\n" + "line\n" * 20000)]
    return rows


@pytest.mark.parametrize("least,batches", [(10, 6), (1, 2), (3, 10)])
def test_lines_equal_plain_count(spark, rows, least, batches):
    want = Counter((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for i, t, kept in plain(rows, least))
    got = line_runs.frequent_lines(table(spark, rows), least, batches).collect()
    assert Counter(map(tuple, got)) == want


def test_texts_without_frequent_lines(spark, rows):
    docs = table(spark, rows)
    got = line_runs.without_frequent_lines(docs)
    assert got.schema == docs.schema
    lost = {(i, t): kept for i, t, kept in plain(rows, 10)}
    for r in got.collect():
        assert r.lines == 1 and r.kept == "k"
    want = Counter((i, t if len(kept) == len((t or "").split("\n")) else "\n".join(kept)) for (i, t), kept in lost.items() for _ in range(rows.count((i, t))))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_no_documents(spark):
    assert line_runs.frequent_lines(table(spark, [])).isEmpty()


def test_runs_compact_and_settle(spark):
    batch = lambda names, docs: spark.createDataFrame([(n, docs) for n in names], "line string, docs long").select(F.col("line").cast("binary").alias("line"), "docs")
    runs = line_runs.LineRuns(spark, least=3, fanout=2)
    shapes = []
    for k in range(5):
        runs.add(batch(["every", f"only {k}"], 2))
        shapes.append([len(level) for level in runs.levels])
    assert shapes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert [r.line for r in runs.unsettled(batch(["every", "new"], 1)).collect()] == [b"new"]  # four documents in a compacted run
    assert sorted((bytes(r.line), r.docs) for r in runs.total().collect())[0] == (b"every", 4)
    first_seen = line_runs.LineRuns(spark, least=1)
    first_seen.add(batch(["a", "b"], 1))
    assert [r.line for r in first_seen.unsettled(batch(["b", "c"], 1)).collect()] == [b"c"]
    names = [*runs.runs, *first_seen.runs]
    runs.close()
    first_seen.close()
    assert not any(spark.catalog.tableExists(n) for n in names)
