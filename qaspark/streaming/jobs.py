"""The incremental jobs on Structured Streaming: the same functions on streaming tables, run over what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.functions.tables import publish, published, published_table, shared_folder, unpublish
from qaspark.operators.knowledge import _ROUTE
from qaspark.operators.metrics import SQL_ENDPOINT, endpoint_statistics
from qaspark.operators.results import bug_patterns, discovered_edge_cases, success_documents
from qaspark.plans.workloads import index_into, stored_index
from qaspark.registry import ORACLE_SQL, QUERIES
from qaspark.sources.adapters import ADAPTERS, dialect, duck_ctes


def _stream(spark: SparkSession, sf_dir: str, base: str, table: str) -> DataFrame:
    """A derived table over the stream of a given one."""
    path = f"{sf_dir}/{base}.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(f"{path[:-1]}[t]")  # a pattern, so that one file will do as well as a folder
    sql = dialect(ADAPTERS[table][1], False).replace("{", "{{").replace("}", "}}").replace(f"FROM {base}", "FROM {rows}")
    return spark.sql(sql, rows=rows)


def stream_endpoint_stats(results: DataFrame, folder: str) -> DataFrame:
    """Statistics per endpoint as results arrive. Each micro-batch writes the table of all of them anew (there are few endpoints).

    Tables are parts of ``folder`` that become visible when they are whole. The newest is returned, also by a restart with nothing
    new; the one before stays for its readers, older ones are dropped. Without any results the table is empty.
    """
    spark, stats = results.sparkSession, endpoint_statistics(results)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/stats/part={number}")
        publish(spark, folder, number, {})
        for old in list(published(spark, folder))[:-2]:
            unpublish(spark, folder, old, "stats")

    run = stats.writeStream.outputMode("complete").foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    parts = list(published(spark, folder))
    return spark.read.schema(stats.schema).parquet(f"{folder}/stats/part={parts[-1]}") if parts else spark.createDataFrame([], stats.schema)


def stream_incremental_index(documents: DataFrame, folder: str, dim: int = 384) -> DataFrame:
    """The stored index of the documents as they arrive: each micro-batch adds its chunks' vectors and its ledger rows, as its own part.

    The ledger, not the stream's state, knows what has been indexed, so the state stays empty; a micro-batch that is repeated after
    a crash finds its part published, or writes it again from the start. Returns the ledger's indexed documents.
    """
    run = documents.writeStream.foreachBatch(lambda batch, number: index_into(batch, folder, number, dim) and None)
    run.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stored_index(documents.sparkSession, folder, "ledger").where("status = 'indexed'").select("doc_id", "index_name")


def stream_feedback(results: DataFrame, folder: str) -> DataFrame:
    """What each batch of results adds: success documents, bug patterns and edge cases; returns their numbers, 0 before any batch."""
    spark, kinds = results.sparkSession, {"success": success_documents, "bugs": bug_patterns, "edge_cases": discovered_edge_cases}

    def append(batch: DataFrame, number: int) -> None:
        for kind, rows in kinds.items():
            rows(batch).write.mode("overwrite").parquet(f"{folder}/{kind}/part={number}")
        publish(spark, folder, number, {})

    results.writeStream.foreachBatch(append).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = None
    for kind, rows in kinds.items():
        stored_rows = published_table(spark, folder, kind, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows(results).schema))
        part = stored_rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        found = part if found is None else found.unionByName(part)
    return found


QUERIES |= {
    "stream_endpoint_stats": lambda spark, d: stream_endpoint_stats(_stream(spark, d, "events", "results"), shared_folder(spark)),
    "stream_incremental_index": lambda spark, d: stream_incremental_index(_stream(spark, d, "documents", "corpus"), shared_folder(spark), 64),
    "stream_feedback": lambda spark, d: stream_feedback(_stream(spark, d, "events", "results"), shared_folder(spark)),
}
ORACLE_SQL |= {
    "stream_endpoint_stats": duck_ctes(["results"], SQL_ENDPOINT),
    "stream_incremental_index": duck_ctes(["corpus"], f"SELECT doc_id, {_ROUTE} AS index_name FROM corpus WHERE content <> ''"),
    "stream_feedback": duck_ctes(["results"], "SELECT 'success' AS kind, count(*) FILTER (WHERE coalesce(passed, false)) AS n FROM results UNION ALL SELECT 'bugs', count(*) FILTER (WHERE NOT coalesce(passed, false)) FROM results UNION ALL SELECT 'edge_cases', count(*) FILTER (WHERE test_type = 'edge_case') FROM results"),
}
