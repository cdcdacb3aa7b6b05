"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without the ASCII blanks at its ends, A-Z lower-cased; its hash has 128 bits (MD5), and an empty key has none.
``LineRuns`` keeps how many documents hold each line in runs: tables in the shared folder, bucketed and sorted by hash, so that a merge
reads them as they lie. A new batch merge-anti-joins the runs, which takes out the lines that a run has already settled, and adds its
own run; two runs of one level are compacted into one of the next by a merge join, which shuffles nothing, and counts add up. So the runs stay few however many
batches come, and a line that is in all documents is written only until it is settled.

``frequent_lines`` and ``without_frequent_lines`` send a whole table through the runs, in batches by hash of the document's id, so
that all rows of a document meet in one batch. Lines are counted per task before they are shuffled. The settled lines' positions are
then gathered per document and taken out of its text.

Edge cases: a null or empty text is one empty line; empty lines are never dropped; the last line may be empty; a text of any length, or
of one line repeated, is split whole; a line that repeats inside a document counts once, and so do rows that repeat an id, null
included: they are one document, and each loses its own lines; a line in exactly ``least`` documents goes; a document that loses all
its lines has an empty text; an empty table gives no rows; extra columns, of whatever name, are ignored by ``frequent_lines`` and kept by
``without_frequent_lines``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.llm.common import checkpointed, join_by_key, let, private, scratch, small_or_shuffled, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Documents that hold a line before it is dropped, batches of a whole table, and runs that fill a level.
LEAST = 10
BATCHES = 6
FANOUT = 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column) -> Column:
    """Array of the hex digests of the text's lines, null where the key is empty."""
    digest = lambda key: F.when(key != "", F.md5(key.cast("binary")))
    return F.transform(lines_of(F.translate(text, UPPER, LOWER)), lambda line: digest(F.btrim(line, F.lit(BLANKS))))


class LineRuns:
    """Levelled sorted runs of (line, docs): in how many documents a line has been seen.

    ``least`` documents settle a line: later batches don't add it again. Batches must not share documents.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT) -> None:
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """The lines of a batch that no run has settled."""
        for run in self.runs:
            counts = counts.join(self.spark.table(run).where(F.col("docs") >= self.least).select("line"), "line", "left_anti")
        return counts

    def add(self, counts: DataFrame) -> None:
        """Add a batch's (line, docs), one row a line."""
        self._push(0, self._run(self.unsettled(counts)))

    def total(self) -> DataFrame:
        """(line, docs) over all batches, from one run that all others have been compacted into. Docs are exact below ``least``."""
        if len(self.runs) > 1:
            merged = self._merged(self.runs)
            self._drop(self.runs)
            self.levels = [*[[] for _ in self.levels], [merged]]
        return self.spark.table(self.runs[0])

    def close(self) -> None:
        self._drop(self.runs)
        self.levels = []

    def _run(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = counts.select("line", "docs").write.bucketBy(self.buckets, "line").sortBy("line").format("parquet")
        rows.option("path", f"{scratch(self.spark)}_{name}").saveAsTable(name)
        return name

    def _merged(self, runs: list[str]) -> str:
        rows = self.spark.table(runs[0])
        for run in runs[1:]:
            other = self.spark.table(run).withColumnRenamed("docs", "_docs")
            rows = rows.join(other, "line", "full_outer").select("line", (F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))).alias("docs"))
        return self._run(rows)

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        full = self.levels[level]
        if len(full) >= self.fanout:
            merged = self._merged(full)
            self._drop(full)
            self.levels[level] = []
            self._push(level + 1, merged)

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            place = self.spark.sql(f"DESCRIBE TABLE EXTENDED {run}").where("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"DROP TABLE {run}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def document_counts(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(line, docs) of rows (id, lines); ``repeated`` holds the ids of several rows, which count once a line."""
    seen = lambda r: r.select("id", F.explode(F.array_distinct("lines")).alias("line")).where("line is not null")
    if repeated is None:
        lines = seen(rows)
    else:
        lines = seen(rows.join(repeated, "id", "left_anti")).unionByName(seen(rows.join(repeated, "id", "left_semi")).distinct())
    return lines.groupBy(F.unhex("line").alias("line")).agg(F.count(F.lit(1)).alias("docs"))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two numbers that tell rows of different id or text apart."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, doc_id, F.lit(1)).alias("k2")]


def dropped_positions(docs: DataFrame, least: int, batches: int) -> DataFrame:
    """(k1, k2, pos): the array of the lines' positions that go, for every row of docs (doc_id, text) that loses any."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), doc.alias("id"), line_hashes(F.col("text")).alias("lines"))
    rows.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    rows = spark.read.schema("k1 long, k2 long, id string, lines array<string>, batch int").parquet(path)
    repeated, drop = written(rows.groupBy("id").count().where("count > 1").select("id"))
    some = None if repeated.isEmpty() else small_or_shuffled(repeated)
    runs = LineRuns(spark, least)
    for batch in range(batches):
        runs.add(document_counts(rows.where(F.col("batch") == batch).drop("batch"), some))
    frequent = checkpointed(runs.total().where(F.col("docs") >= least).select(F.lower(F.hex("line")).alias("line"), "docs"))
    runs.close()
    drop()
    lines = rows.select("k1", "k2", F.posexplode("lines").alias("pos", "line")).where("line is not null")
    hit = join_by_key(lines, frequent, ["line"], "docs")
    return checkpointed(hit.groupBy("k1", "k2").agg(F.collect_set("pos").alias("pos")))


def _cut(docs: DataFrame, least: int, batches: int) -> tuple[DataFrame, str, str, str]:
    """``docs`` with columns for their lines, the array of dropped positions (null if none), and the kept text, under new names."""
    lines, pos, kept = (private(n, docs) for n in ("lines", "pos", "kept"))
    k1, k2 = private("k1", docs), private("k2", docs)
    gone = dropped_positions(docs.select("doc_id", "text"), least, batches)
    gone = small_or_shuffled(gone, "pos").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("pos").alias(pos))
    first, second = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.withColumns({k1: first, k2: second}).join(gone, [k1, k2], "left").drop(k1, k2)

    def rest(parts: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(pos))
        return F.array_join(F.transform(at, lambda i: F.get(parts, i)), "\n")

    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn(kept, F.when(F.col(pos).isNull(), text).otherwise(let(lines_of(F.col("text")), rest)))
    return rows.withColumn(lines, F.size(lines_of(F.col("text")))), lines, pos, kept


def frequent_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row of ``docs``: lines in ``least`` documents or more are dropped."""
    rows, lines, pos, kept = _cut(docs.select("doc_id", "text"), least, batches)
    n = F.when(F.col(pos).isNull(), 0).otherwise(F.size(pos))
    return rows.select("doc_id", F.col(lines).cast("long").alias("n_lines"), n.cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


def without_frequent_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """``docs`` with the kept lines as their text; a null text that loses nothing stays null."""
    rows, _, pos, kept = _cut(docs, least, batches)
    text = F.when(F.col(pos).isNull(), F.col("text")).otherwise(F.col(kept))
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
