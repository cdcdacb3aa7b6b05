"""What the corpus operators share: reading tables, column-name hygiene, tables that cut the lineage, let-bindings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but blanks and the ASCII control blanks.
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Rows in an Arrow batch: long texts times this many stay well inside a Python worker's memory.
ARROW_ROWS = 1000
ARROW_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python workers see at most ARROW_ROWS rows, and about ARROW_BYTES, at once. Set for the session: Spark has no narrower place."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def _checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder that all executors share (``spark.checkpoint.dir``); only a local session without it gets its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    _checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` from a Parquet table in the shared folder, and a function that drops the table.

    This cuts the lineage as a checkpoint does; the table is smaller, is read by column, and hands on nothing of what the planner
    has inferred, which makes the plans of long loops slow.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)

    def drop() -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return spark.read.schema(df.schema).parquet(path), drop


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from a table that stays in the shared folder."""
    return written(df)[0]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no classifier learns from: crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words(text: Column) -> Column:
    """Array of words, never null; case is kept."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def private(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores before it as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Most rows (of ids and a few numbers) that are broadcast, and most elements in their arrays; above it the same join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_ELEMENTS = 2_000_000


def small_or_shuffled(df: DataFrame, array: str | None = None) -> DataFrame:
    """``df``, marked for broadcast only if its rows, and the elements of its array column, have been counted to be few.

    Cut its lineage before. Columns other than ``array`` must be of bounded width.
    """
    elements = F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0)
    rows, inside = df.agg(F.count(F.lit(1)), elements).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and inside <= BROADCAST_ELEMENTS else df


#: A key is hot if it holds more than this share of the rows: fewer than its inverse are.
HOT_SHARE = 1000


def join_by_key(rows: DataFrame, keyed: DataFrame, key: list[str], n: str, width: int = 64) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row of at most ``width`` bytes for each key, and in ``n`` how many rows have it.

    A small ``keyed`` is broadcast whole. Else its hot keys, fewer than HOT_SHARE of them whatever the size, are broadcast, so that
    no task gets all rows of one, and the others meet in a shuffle. ``rows`` is read twice: cut its lineage before, as that of ``keyed``.
    """
    keys, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0))).first()
    if keys * width <= BROADCAST_ROWS * 64:
        return rows.join(F.broadcast(keyed.drop(n)), key)
    hot = F.col(n) > total // HOT_SHARE
    few, rest = F.broadcast(keyed.where(hot).drop(n)), keyed.where(~hot).drop(n)
    return rows.join(few, key).unionByName(rows.join(few.select(*key), key, "left_anti").join(rest, key))
