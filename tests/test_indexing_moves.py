"""Vectors are written once, with ids in order of document and chunk, also when some documents fail."""

from pyspark.sql import functions as F

from qaspark.functions import tables
from qaspark.operators.vectors import hash_embedding
from qaspark.plans import workloads


def test_vectors_are_stored_with_their_ids_only(spark, monkeypatch):
    seen = []
    for module in (tables, workloads):
        monkeypatch.setattr(module, "stored", lambda df, f=tables.stored: seen.append(df.columns) or f(df))
    text = lambda i: "\n".join(["bad" if i % 7 == 3 and j == 60 else f"{i} {j}" for j in range(10 + i % 120)])
    docs = spark.createDataFrame([(i, text(i), "test_case" if i % 2 else "bug", "lines") for i in range(200)], "doc_id long, content string, type string, chunking_strategy string")
    good = lambda df: df.where("doc_id % 7 <> 3")
    folder = tables.shared_folder(spark)
    workloads.index_into(good(docs).where("doc_id < 50"), folder, 0, 8)
    workloads.index_into(good(docs), folder, 1, 8)
    assert seen and not any("vec" in columns for columns in seen)
    workloads.index_into(docs, folder, 2, 8, encoder=lambda text, dim: F.when(~F.contains(text, F.lit("bad")), hash_embedding(text, dim)))
    rows = sorted((r.index_name, r.part, r.doc_id, int(r.chunk_id[6:]), r.vector_id) for r in workloads.stored_index(spark, folder, "vectors").collect())
    for name in {r[0] for r in rows}:
        ids = [r[-1] for r in rows if r[0] == name]
        assert ids == list(range(len(ids)))
    failed = {r.doc_id for r in workloads.stored_index(spark, folder, "ledger").where("reason = 'no_vector'").collect()}
    assert failed == {i for i in range(200) if "bad" in text(i)} and not failed & {r[2] for r in rows} and len(failed) > 5
