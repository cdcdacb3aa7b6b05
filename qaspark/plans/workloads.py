"""Composed jobs: incremental indexing from new documents to stored vectors.

An index is a folder of tables in parts, one part a run. A part becomes visible by its entry in the manifest, written when all its
tables are, so a run that fails leaves no trace and can be repeated, and a part that has been published is not written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.functions.tables import numbered, publish, published, published_table, shared_folder, small_batches, stored, unpublish
from qaspark.operators.cases import content_of
from qaspark.operators.chunking import STRATEGIES, Piece, pieces_or_error
from qaspark.operators.knowledge import _ROUTE, LEDGER, index_of, indexing_stats
from qaspark.operators.vectors import hash_embedding
from qaspark.registry import query

_TABLES = {"vectors": "index_name string, vector_id long, doc_id long, chunk_id string, text string, start_idx int, end_idx int, vec array<double>, part int", "ledger": LEDGER}


def stored_index(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Table "vectors" or "ledger" of the published parts of an index in ``folder``."""
    return published_table(spark, folder, table, _TABLES[table])


def _column(documents: DataFrame, name: str, kind: str, default: object) -> Column:
    return F.coalesce(F.col(name).cast(kind), F.lit(default)) if name in documents.columns else F.lit(default)


def planned(documents: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, index_name, content, strategy and the reason, if any, to skip each document: one row an id.

    ``known`` holds the ids that have been indexed; a document with ``force_reindex`` is taken again. Of rows that repeat an id one
    counts. Contents come from whichever columns a document has.
    """
    one = documents.select(
        "doc_id",
        _column(documents, "type", "string", "").alias("type"),
        content_of(documents).alias("content"),
        _column(documents, "chunking_strategy", "string", "sliding").alias("strategy"),
        _column(documents, "force_reindex", "boolean", False).alias("_force"),
    )
    one = one.where("doc_id is not null").dropDuplicates(["doc_id"])
    one = one.join(known.select("doc_id", F.lit(True).alias("_known")).distinct(), "doc_id", "left")
    reason = F.when(F.col("_known") & ~F.col("_force"), "already_indexed").when(F.coalesce("content", F.lit("")) == "", "no_content")
    return one.select("doc_id", index_of(F.col("type")).alias("index_name"), "content", "strategy", reason.alias("reason"))


def index_into(
    documents: DataFrame,
    folder: str,
    part: int,
    dim: int = 384,
    strategies: dict[str, Callable[[str], list[Piece]]] = STRATEGIES,
    encoder: Callable[[Column, int], Column] = hash_embedding,
) -> DataFrame:
    """Add the documents that the index in ``folder`` lacks to it, as ``part``; returns the run's statistics.

    Documents are routed to an index, cut by their own strategy (``chunking_strategy``, sliding by default), and their chunks embedded
    and numbered per index after its last id, without a task that holds a whole index. A document whose text can't be cut, or
    that has a chunk without a vector, has failed and adds nothing; the others go on. The ledger has a row for each document: its
    status, why it was skipped or failed, and its chunks. Rows without an id, and those that repeat one, count as skipped.
    """
    spark = documents.sparkSession
    entries = published(spark, folder)
    if part not in entries:
        try:
            _write_part(documents, folder, part, dim, strategies, encoder, entries)
        except Exception:
            if part not in published(spark, folder):
                unpublish(spark, folder, part, *_TABLES)
            raise
        entries = published(spark, folder)
    names = indexing_stats(spark.createDataFrame([], LEDGER)).columns
    return spark.createDataFrame([tuple(entries[part]["stats"][n] for n in names)], ", ".join(f"{n} long" for n in names))


def _write_part(documents: DataFrame, folder: str, part: int, dim: int, strategies: dict, encoder: Callable, entries: dict[int, dict]) -> None:
    spark = documents.sparkSession
    small_batches(spark)
    plan = planned(documents, stored_index(spark, folder, "ledger").where("status = 'indexed'"))
    due = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    plan = plan.withColumn("c", pieces_or_error(strategies)(due("content"), due("strategy")))
    # what has been skipped counts as an empty text without an error
    plan = stored(plan.select("doc_id", "index_name", "reason", due("c.pieces").alias("pieces"), due("c.error").alias("error")))
    chunks = F.when(F.size("pieces") > 0, F.size("pieces"))

    last: dict[str, int] = {}
    for facts in entries.values():
        last = {k: max(v, last.get(k, -1)) for k, v in {**last, **facts["last"]}.items()}
    after = F.lit(0)
    for name, n in last.items():
        after = F.when(F.col("index_name") == name, F.lit(n + 1)).otherwise(after)

    def placed(rows: DataFrame, counts: DataFrame) -> DataFrame:
        """``rows`` with their document's index and the number of its first chunk; ``counts``: index_name, doc_id, n."""
        return rows.join(numbered(counts, ["index_name"], ["doc_id"], "_start", "n").drop("n"), "doc_id")

    def write(rows: DataFrame) -> DataFrame:
        chunk = rows.select("index_name", (after + F.col("_start") + F.col("chunk_index")).cast("long").alias("vector_id"), "doc_id", F.concat(F.lit("chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text", "start_idx", "end_idx", F.col("vec").cast("array<double>").alias("vec"))
        chunk.write.mode("overwrite").parquet(f"{folder}/vectors/part={part}")
        return spark.read.schema(chunk.schema).parquet(f"{folder}/vectors/part={part}")

    # a document's texts are shuffled once, and its vectors written once, with their ids: only sizes are numbered
    counts = plan.select("index_name", "doc_id", chunks.cast("long").alias("n")).where("n is not null")
    rows = placed(plan.where(chunks.isNotNull()).select("doc_id", "pieces"), counts)
    rows = rows.select("index_name", "doc_id", "_start", F.posexplode("pieces").alias("chunk_index", "c")).select("index_name", "doc_id", "_start", "chunk_index", "c.*")
    vectors = write(rows.withColumn("vec", encoder(F.col("text"), dim)))
    lost = stored(vectors.where("vec is null").select("doc_id").distinct())
    if not lost.isEmpty():  # documents that fail leave no gap in the ids: the others are numbered and written anew
        rest = vectors.join(lost, "doc_id", "left_anti").drop("index_name", "vector_id")
        rest = stored(rest.withColumn("chunk_index", F.substring("chunk_id", len("chunk_") + 1, 10).cast("int")))
        vectors = write(placed(rest, counts.join(lost, "doc_id", "left_anti")))

    done = plan.select("doc_id", "index_name", "reason", "error", chunks.cast("long").alias("chunks")).join(lost.withColumn("_lost", F.lit(True)), "doc_id", "left")
    reason = F.coalesce("reason", "error", F.when(F.col("chunks").isNull(), "no_chunks"), F.when(F.col("_lost"), "no_vector"))
    skipped = F.coalesce("reason", F.when(F.col("error").isNull() & F.col("chunks").isNull(), "no_chunks"))
    status = F.when(skipped.isNotNull(), "skipped").when(reason.isNotNull(), "failed").otherwise("indexed")
    ledger = done.select("doc_id", "index_name", status.alias("status"), reason.alias("reason"), F.when(reason.isNull(), F.col("chunks")).otherwise(0).alias("chunks"))
    ledger.write.mode("overwrite").parquet(f"{folder}/ledger/part={part}")
    ledger = spark.read.parquet(f"{folder}/ledger/part={part}")
    ends = vectors.groupBy("index_name").agg(F.max("vector_id").alias("last")).collect()  # a row an index
    stats = indexing_stats(ledger).first().asDict()
    repeats = documents.count() - stats["total_documents"]
    stats |= {"total_documents": stats["total_documents"] + repeats, "skipped": stats["skipped"] + repeats}
    publish(spark, folder, part, {"stats": stats, "last": {r.index_name: r.last for r in ends}})


def _broken(text: str) -> list[Piece]:
    raise ValueError("can't be cut")


_CUT = "CAST(ceil(len(string_split(content, chr(10))) / 50.0) AS BIGINT)"


@query(
    "corpus",
    sql=f"""WITH d AS (SELECT {_ROUTE} AS index_name, doc_id % 3 = 0 AS first, doc_id % 13 = 5 AS broken, {_CUT} AS n FROM corpus WHERE content <> '')
    SELECT index_name, count(*) FILTER (WHERE first AND NOT broken) AS before, count(*) FILTER (WHERE NOT first AND NOT broken) AS added, count(*) FILTER (WHERE first AND NOT broken) AS known, count(*) FILTER (WHERE broken) + count(*) FILTER (WHERE broken AND first) AS failed,
    coalesce(sum(n) FILTER (WHERE NOT broken), 0)::BIGINT AS chunks, true AS gapless FROM d GROUP BY 1""",
)
def index_documents(documents: DataFrame) -> DataFrame:
    """Two runs into one index, the second with all documents, cut by lines; some are cut by a strategy that fails.

    Per index: documents that each run adds, that the second run skips as known, that failed in either, all chunks, and whether the
    vector ids have no gaps.
    """
    spark, folder = documents.sparkSession, shared_folder(documents.sparkSession)
    rows = documents.withColumn("chunking_strategy", F.when(F.col("doc_id") % 13 == 5, "broken").otherwise("lines"))
    cuts = STRATEGIES | {"broken": _broken}
    index_into(rows.where("doc_id % 3 = 0"), folder, 0, 64, cuts)
    index_into(rows, folder, 1, 64, cuts)
    of = lambda part, status, reason=True: F.count_if((F.col("part") == part) & (F.col("status") == status) & reason)
    known = of(1, "skipped", F.col("reason") == "already_indexed").alias("known")
    ledger = stored_index(spark, folder, "ledger").groupBy("index_name").agg(of(0, "indexed").alias("before"), of(1, "indexed").alias("added"), known, F.count_if(F.col("status") == "failed").alias("failed"), F.sum("chunks").alias("chunks"))
    ids = stored_index(spark, folder, "vectors").groupBy("index_name").agg((F.max("vector_id") + 1 == F.count(F.lit(1))).alias("_all"), (F.sum("vector_id") * 2 == F.max("vector_id") * F.count(F.lit(1))).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return ledger.join(ids, "index_name").select("index_name", "before", "added", "known", "failed", "chunks", (F.col("_all") & F.col("_sum") & (F.col("_n") == F.col("chunks"))).alias("gapless"))
