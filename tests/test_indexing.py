"""Indexing in parts: statuses, restarts, and parts that fail."""

import pytest
from pyspark.sql import functions as F

from qaspark.functions import tables
from qaspark.operators.metrics import endpoint_statistics
from qaspark.operators.vectors import hash_embedding
from qaspark.plans import workloads
from qaspark.streaming import jobs

DOC = "doc_id long, type string, content string, text string, chunking_strategy string, force_reindex boolean, strategy int"


def docs(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r)), 1) for r in rows], DOC)


def stats(df):
    return {k: v for k, v in df.first().asDict().items() if v}


def statuses(spark, folder):
    return {(r.part, r.doc_id): (r.status, r.reason, r.chunks) for r in workloads.stored_index(spark, folder, "ledger").collect()}


def test_every_document_has_a_status(spark):
    folder = tables.shared_folder(spark)

    def broken(text):
        raise ValueError("no way")

    cuts = workloads.STRATEGIES | {"broken": broken, "nothing": lambda text: []}
    encoder = lambda text, dim: F.when(text != "bad", hash_embedding(text, dim))
    long = "Some words. " * 80
    rows = [(1, "test_case", long), (2, None, None, "from the text column"), (3, "bug", "x", None, "broken"), (4, None, "x", None, "unheard of"), (10, None, "x", None, "broken"), (5, None, ""), (6, None, "a\n\n" + "b" * 600, None, "semantic")]
    rows += [(7, None, "bad"), (8, None, "x", None, "nothing"), (1, "test_case", long), (None, None, "no id")]
    got = stats(workloads.index_into(docs(spark, *rows), folder, 0, 8, cuts, encoder))
    assert got == {"total_documents": 11, "indexed": 4, "skipped": 4, "no_content": 1, "no_chunks": 1, "failed": 3, "chunks_created": 6}
    assert statuses(spark, folder) == {
        (0, 1): ("indexed", None, 2),
        (0, 2): ("indexed", None, 1),
        (0, 3): ("failed", "ValueError: no way", 0),
        (0, 4): ("indexed", None, 1),
        (0, 10): ("failed", "ValueError: no way", 0),
        (0, 5): ("skipped", "no_content", 0),
        (0, 6): ("indexed", None, 2),
        (0, 7): ("failed", "no_vector", 0),
        (0, 8): ("skipped", "no_chunks", 0),
    }
    vectors = workloads.stored_index(spark, folder, "vectors").collect()
    assert sorted(r.vector_id for r in vectors) == list(range(6)) and {r.doc_id for r in vectors} == {1, 2, 4, 6}
    # the next run takes what is new, what has failed, and what is forced, and numbers on
    more = [(1, "test_case", long), (2, None, "again", None, None, True), (3, "bug", "x"), (9, None, "new")]
    got = stats(workloads.index_into(docs(spark, *more), folder, 1, 8, cuts, encoder))
    assert got == {"total_documents": 4, "indexed": 3, "skipped": 1, "already_indexed": 1, "chunks_created": 3}
    ids = {}
    for r in workloads.stored_index(spark, folder, "vectors").collect():
        ids.setdefault(r.index_name, []).append(r.vector_id)
    assert {k: sorted(v) for k, v in ids.items()} == {"test_patterns": list(range(8)), "bug_patterns": [0]}


def test_a_published_part_is_not_written_again(spark):
    folder = tables.shared_folder(spark)
    first = stats(workloads.index_into(docs(spark, (1, None, "one")), folder, 0, 8))
    assert stats(workloads.index_into(docs(spark, (2, None, "two")), folder, 0, 8)) == first
    assert {i for _, i in statuses(spark, folder)} == {1}
    assert workloads.index_into(docs(spark), folder, 1, 8).first().total_documents == 0


def test_a_part_that_fails_leaves_no_trace(spark):
    folder = tables.shared_folder(spark)
    workloads.index_into(docs(spark, (1, None, "one")), folder, 0, 8)

    @F.pandas_udf("array<double>")
    def lost(texts):
        raise OSError("an encoder that is down")

    with pytest.raises(Exception, match="is down"):
        workloads.index_into(docs(spark, (2, None, "two")), folder, 1, 8, encoder=lambda text, dim: lost(text))
    # as if a run had been cut off after its vectors, before its entry
    workloads.stored_index(spark, folder, "vectors").drop("part").write.parquet(f"{folder}/vectors/part=1")
    assert workloads.stored_index(spark, folder, "vectors").count() == 1 and set(statuses(spark, folder)) == {(0, 1)}
    assert stats(workloads.index_into(docs(spark, (2, None, "two")), folder, 1, 8)) == {"total_documents": 1, "indexed": 1, "chunks_created": 1}
    assert sorted(r.vector_id for r in workloads.stored_index(spark, folder, "vectors").collect()) == [0, 1]


def test_indexing_stream_restarts(spark):
    source, folder = tables.shared_folder(spark), tables.shared_folder(spark)
    write = lambda *rows: spark.createDataFrame(rows, "doc_id long, content string, type string").write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("doc_id long, content string, type string").parquet(source)
    ids = lambda: sorted(r.doc_id for r in jobs.stream_incremental_index(stream(), folder, 8).collect())
    write((1, "one", None))
    assert ids() == [1] and ids() == [1]  # nothing new the second time
    write((1, "one", None), (2, "two", "bug"), (3, "", None))
    assert ids() == [1, 2] and ids() == [1, 2]



def test_statistics_and_feedback_streams_restart(spark):
    from qaspark.sources import adapters

    source, folder, other = (tables.shared_folder(spark) for _ in range(3))
    results = adapters.load(spark, "/root/testdata/sf0.001", "results")
    schema = results.schema
    spark.createDataFrame([], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    assert jobs.stream_endpoint_stats(stream(), folder).isEmpty()
    assert {r.n for r in jobs.stream_feedback(stream(), other).collect()} == {0}
    for part in range(4):
        results.where(F.col("id") % 4 == part).write.mode("append").parquet(source)
        for _ in range(2):  # the second time without anything new
            rows = jobs.stream_endpoint_stats(stream(), folder)
        so_far = results.where(F.col("id") % 4 <= part)
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, endpoint_statistics(so_far).collect()))
    assert len(tables.published(spark, folder)) == 2
    fed = {r.kind: r.n for r in jobs.stream_feedback(stream(), other).collect()}
    assert fed["success"] == results.where("passed").count() and fed == {r.kind: r.n for r in jobs.stream_feedback(stream(), other).collect()}
