"""Chunking of documents: sliding sentences, paragraphs, lines, code and tests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.functions.tables import small_batches
from qaspark.registry import query

# Chunk and overlap size in characters, lines in a block, and the patterns of sentence ends and of tests.
SIZE, OVERLAP, LINES = 512, 50, 50
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
CODE_START = re.compile(r"(?m)^(?=class |def |async def )")
TEST_STARTS = r"def test_\w+|public void \w+Test|it\(['\"].*?['\"]|TEST\("

Piece = tuple[str, int, int]
_PIECES = "array<struct<text: string, start_idx: int, end_idx: int>>"


def sliding(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Piece]:
    """Sentences packed up to ``size``; each chunk repeats the shortest run of last sentences of at least ``overlap`` characters."""
    chunks, current, length, start = [], [], 0, 0

    def put() -> int:
        body = " ".join(current)
        chunks.append((body, start, start + len(body)))
        return start + len(body)

    for s in filter(None, (x.strip() for x in SENTENCE_END.split(text))):
        if current and length + len(s) > size:
            end = put()
            carried, total = [], 0
            for x in reversed(current):
                carried.insert(0, x)
                total += len(x)
                if total >= overlap:
                    break
            if total < overlap:
                carried, total = [], 0
            current, length, start = carried, total, end - total
        current.append(s)
        length += len(s)
    if current:
        put()
    return chunks


def semantic(text: str, size: int = SIZE) -> list[Piece]:
    """Paragraphs packed up to ``size``, without overlap."""
    chunks, current, length, start = [], [], 0, 0
    for p in filter(None, (x.strip() for x in text.split("\n\n"))):
        if current and length + len(p) > size:
            body = "\n\n".join(current)
            chunks.append((body, start, start + len(body)))
            start += len(body) + 2
            current, length = [], 0
        current.append(p)
        length += len(p)
    if current:
        body = "\n\n".join(current)
        chunks.append((body, start, start + len(body)))
    return chunks


def code(text: str, language: str = "python") -> list[Piece]:
    """Blocks of code: Python at top-level definitions, brace languages where the braces balance, others by lines."""
    if language == "python":
        parts = [p for p in CODE_START.split(text) if p.strip()]
    elif language in ("csharp", "java"):
        parts, block, depth, seen = [], [], 0, False
        for line in text.split("\n"):
            block.append(line)
            depth += line.count("{") - line.count("}")
            seen |= "{" in line
            if seen and depth == 0:
                parts.append("\n".join(block))
                block, seen = [], False
        if "".join(block).strip():
            parts.append("\n".join(block))
    else:
        lines = text.split("\n")
        parts = ["\n".join(lines[i : i + LINES]) for i in range(0, len(lines), LINES)]
    out, at = [], 0
    for p in parts:
        out.append((p, at, at + len(p)))
        at += len(p)
    return out



#: About how many characters of pieces a task holds before it emits them.
HELD_CHARS = 4_000_000

Cut = Callable[[str], list[Piece]]


def chunked_by(documents: DataFrame, cuts: dict[str, Cut], prefix: str = "chunk", most: int | None = None) -> DataFrame:
    """doc_id, chunk_index, chunk_id, text, start_idx, end_idx and strategy of the pieces of every document (doc_id, content, strategy).

    ``cuts`` has a function from a text to pieces for every strategy. One pass over the documents; pieces leave a task as rows, some
    megabytes at a time, and never as lists of a whole batch.
    """
    small_batches(documents.sparkSession)
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, rows, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            at, texts, starts, ends = zip(*rows, strict=True)
            kinds = (id_, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            columns = (ids, at, texts, starts, ends, names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "chunk_index", "text", "start_idx", "end_idx", "strategy"])

        for batch in batches:
            id_ = batch.schema.field("doc_id").type
            for doc, text, name in zip(*(batch.column(i) for i in range(3)), strict=True):
                name = name.as_py()
                for i, piece in enumerate(cuts[name](text.as_py() or "")[:most]):
                    ids.append(doc.as_py())
                    names.append(name)
                    rows.append((i, *piece))
                    held += len(piece[0])
                    if held > HELD_CHARS:
                        yield out()
                        ids, names, rows, held = [], [], [], 0
            if rows:
                yield out()
                ids, names, rows, held = [], [], [], 0

    found = documents.select("doc_id", "content", "strategy").mapInArrow(run, f"doc_id {id_type}, chunk_index int, text string, start_idx int, end_idx int, strategy string")
    return found.select("doc_id", "chunk_index", F.concat(F.lit(f"{prefix}_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text", "start_idx", "end_idx", "strategy")


def chunked(documents: DataFrame, cut: Cut, prefix: str = "chunk") -> DataFrame:
    """doc_id, chunk_index, chunk_id, text, start_idx and end_idx; ``cut`` is any function from a text to pieces."""
    return chunked_by(documents.withColumn("strategy", F.lit("")), {"": cut}, prefix).drop("strategy")


def lines(text: str, n: int = LINES) -> list[Piece]:
    """Blocks of so many lines."""
    out, at, rows = [], 0, text.split("\n")
    for i in range(0, len(rows), n):
        body = "\n".join(rows[i : i + n])
        out.append((body, at, at + len(body)))
        at += len(body) + 1
    return out


_TEST_LINE = re.compile(TEST_STARTS)


def tests(text: str) -> list[Piece]:
    """A piece for each test, from its first line on; a text without tests is cut by sentences."""
    out, at = [], 0
    for line in text.split("\n"):
        if _TEST_LINE.search(line):
            out.append([line, at])
        elif out:
            out[-1][0] += "\n" + line
        at += len(line) + 1
    return [(body, start, start + len(body)) for body, start in out] or sliding(text)


#: Ways to cut a text, by name; any other name, or none, means sliding.
STRATEGIES: dict[str, Callable[[str], list[Piece]]] = {"sliding": sliding, "semantic": semantic, "code": code, "test": tests, "lines": lines}


def pieces_or_error(strategies: dict[str, Callable[[str], list[Piece]]]) -> Callable:
    """Column from (content, strategy) to the pieces, and the error of a text that can't be cut: it does not fail the others."""

    def one(text: str | None, strategy: str | None) -> dict:
        try:
            cut = strategies.get(strategy) or strategies["sliding"]
            return {"pieces": [{"text": t, "start_idx": a, "end_idx": b} for t, a, b in cut(text or "")], "error": None}
        except Exception as e:  # any error of a pluggable strategy is this document's status
            return {"pieces": None, "error": f"{type(e).__name__}: {e}"}

    @F.pandas_udf(f"pieces {_PIECES}, error string")
    def cut(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t, n) for t, n in zip(texts, names, strict=True)], columns=["pieces", "error"])

    return cut


@query("corpus")
def chunk_sliding(documents: DataFrame) -> DataFrame:
    return chunked(documents, sliding)


@query("corpus", prepare=lambda c: (c.withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n"))),))
def chunk_semantic(documents: DataFrame) -> DataFrame:
    return chunked(documents, semantic)


@query("corpus", prepare=lambda c: (c.withColumn("content", F.concat(F.lit("import os\nclass A:\n    x = 1\n\ndef f(a):\n    return '"), "content", F.lit("'\n"))),))
def chunk_code(documents: DataFrame, language: str = "python") -> DataFrame:
    """Code blocks with their kind."""
    rows = chunked(documents, lambda text: code(text, language), "code_chunk")
    has = lambda *words: F.col("text").rlike("|".join(words))
    kind = F.when(has("class "), "class").when(has("def ", "function "), "function").when(has("(?i)test"), "test").otherwise("unknown")
    return rows.withColumn("block_type", kind)


@query("corpus", prepare=lambda c: (c.withColumn("strategy", F.get(F.array(F.lit("sliding"), F.lit("semantic"), F.lit(None).cast("string")), (F.col("doc_id") % 3).cast("int"))),))
def chunk_documents(documents: DataFrame, most: int | None = None, strategies: dict[str, Callable[[str], list[Piece]]] | None = None) -> DataFrame:
    """Each document by its own strategy, sliding by default and for an unknown one; strategies are pluggable."""
    cuts = {"sliding": sliding} | (strategies or STRATEGIES)
    own = F.when(F.col("strategy").isin(*cuts), F.col("strategy")).otherwise("sliding")
    return chunked_by(documents.withColumn("strategy", own), cuts, most=most)


@query("corpus", sql="WITH l AS (SELECT doc_id, string_split(content, chr(10)) AS lines FROM corpus) SELECT doc_id, i AS chunk_index, array_to_string(lines[i * 2 + 1:i * 2 + 2], chr(10)) AS text FROM l, range(0, 100000) g(i) WHERE i * 2 < len(lines)", prepare=lambda c: (c, 2))
def chunk_lines(documents: DataFrame, lines: int = LINES) -> DataFrame:
    """Blocks of so many lines."""
    rows = documents.select("doc_id", F.split("content", "\n").alias("l"))
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / lines).cast("int")), lambda i: F.array_join(F.slice("l", i * lines + 1, F.lit(lines)), "\n"))
    return rows.select("doc_id", F.posexplode(starts).alias("chunk_index", "text"))


_SQL_STARTS = TEST_STARTS.replace("'", "''")


def _test_name():
    """Name of the test that a block starts with, unknown_test if it has none."""
    found = [F.regexp_extract("text", p, 1) for p in (r"def (test_\w+)", r"public void (\w+Test)", r"it\(['\"]([^'\"]*)['\"]", r"TEST\((\w+)")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit("unknown_test"))


_TESTS = "'import x' || chr(10) || 'def test_a' || doc_id || '():' || chr(10) || content || chr(10) || 'def test_b():' || chr(10) || '    pass'"


@query(
    "corpus",
    prepare=lambda c: (c.select("doc_id", F.concat(F.lit("import x\ndef test_a"), "doc_id", F.lit("():\n"), "content", F.lit("\ndef test_b():\n    pass")).alias("content")),),
    sql=f"""WITH l AS (SELECT doc_id, unnest(string_split({_TESTS}, chr(10))) AS line, generate_subscripts(string_split({_TESTS}, chr(10)), 1) AS n FROM corpus),
    s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_SQL_STARTS}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM l)
    SELECT doc_id, CAST(block - 1 AS INT) AS chunk_index, string_agg(line, chr(10) ORDER BY n) AS text, regexp_extract(string_agg(line, chr(10) ORDER BY n), 'def (test_\\w+)', 1) AS test_name FROM s WHERE block > 0 GROUP BY 1, block""",
)
def chunk_tests(documents: DataFrame) -> DataFrame:
    """A chunk for each test, from its first line on; what stands before the first test is dropped. A text without tests is cut by
    sentences, its chunks named unknown_test. Lines are folded inside their row: nothing is shuffled."""
    lines = F.split("content", "\n")
    seen = F.exists(lines, lambda x: x.rlike(TEST_STARTS))
    marked = F.transform(lines, lambda x: F.when(x.rlike(TEST_STARTS), F.concat(F.lit("\0"), x)).otherwise(x))
    parts = F.transform(F.slice(F.split(F.concat(F.lit("\n"), F.array_join(marked, "\n")), "\n\0"), 2, F.size(lines)), lambda x: x)
    tests = documents.where(seen).select("doc_id", F.posexplode(parts).alias("chunk_index", "text")).withColumn("test_name", _test_name())
    others = chunked(documents.where(~F.coalesce(seen, F.lit(False))), sliding)
    return tests.unionByName(others.select("doc_id", "chunk_index", "text", F.lit("unknown_test").alias("test_name")))


@query("corpus", sql="SELECT doc_id, i - 1 AS chunk_index, lines[i] AS text FROM (SELECT doc_id, string_split(content, chr(10)) AS lines FROM corpus), range(1, 100000) g(i) WHERE i <= len(lines)")
def chunk_index(documents: DataFrame) -> DataFrame:
    """Ordinal of each line in its document."""
    return documents.select("doc_id", F.posexplode(F.split("content", "\n")).alias("chunk_index", "text"))
