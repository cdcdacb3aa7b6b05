"""Chunks leave a task as rows, some megabytes at a time, whatever the documents hold."""

from qaspark.operators import chunking

DOC = "doc_id long, content string, strategy string"


def test_pieces_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chunking, "HELD_CHARS", 1000)
    rows = [(1, "One two three. " * 400, None), (None, "a\n\n" + "b" * 600 + "\n\nc", "semantic"), (3, None, "sliding"), (4, "", "lines"), (5, "x\ny", "lines"), (6, "Same. " * 200, "unheard of")]
    got = chunking.chunk_documents(spark.createDataFrame(rows, DOC))
    assert [f.simpleString() for f in got.schema] == ["doc_id:bigint", "chunk_index:int", "chunk_id:string", "text:string", "start_idx:int", "end_idx:int", "strategy:string"]
    want = []
    for doc, text, strategy in rows:
        own = strategy if strategy in chunking.STRATEGIES else "sliding"
        want += [(doc, i, f"chunk_{i}", *piece, own) for i, piece in enumerate(chunking.STRATEGIES[own](text or ""))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_documents_are_read_once_for_all_strategies(spark):
    rows = spark.createDataFrame([(1, "a", "sliding")], DOC)
    plan = chunking.chunk_documents(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Union" not in plan


def test_own_strategies_keep_sliding(spark):
    got = chunking.chunk_documents(spark.createDataFrame([(1, "a|b", "bars"), (2, "a|b", None)], DOC), strategies={"bars": lambda text: [(t, 0, 1) for t in text.split("|")]})
    assert sorted((r.doc_id, r.text, r.strategy) for r in got.collect()) == [(1, "a", "bars"), (1, "b", "bars"), (2, "a|b", "sliding")]
