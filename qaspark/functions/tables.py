"""Tables in the shared folder, and gapless numbers that need no task to hold a whole group."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows, and about how many bytes, that a Python worker holds in an Arrow batch.
ARROW_ROWS = 1000
ARROW_BYTES = 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches. Set for the session, to the same values by all operators: Spark has no narrower place."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share; only a local session without it gets its own folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` from a Parquet table in the shared folder: its lineage is cut, and it is computed once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: About how many rows a task of a sort, window or join of a table gets; of a table of over FEW_TASKS times as many, up to MOST_ROWS.
TASK_ROWS = 100_000
MOST_ROWS = 1_000_000
#: So many parts are written by a shuffle without a sort in the memory of the tasks that write.
FEW_TASKS = 200


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many parts a table of so many rows is dealt into: by their count, so that what a task holds doesn't grow with the table.

    Given to ``repartition`` as a number, it is kept; without one, Spark has a fixed number of parts and merges those of few bytes.
    """
    return max(spark.sparkContext.defaultParallelism, min(FEW_TASKS, -(-rows // TASK_ROWS)), -(-rows // MOST_ROWS))


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in each group, in the given order; with a ``weight``, its sum over the group's earlier rows.

    Rows are dealt by their count into range partitions over all groups; a row's number is its place in its group's part of the
    partition after the sizes of the group's earlier parts. So a group of any size is numbered by as many tasks as it fills. Only the
    first group of a partition can have earlier parts: a row a partition at most is broadcast. ``df`` is read three times.
    """
    part = ["_part", *group]
    tasks = tasks_for(df.sparkSession, df.count())
    rows = df.repartitionByRange(tasks, *group, *order).withColumn("_part", F.spark_partition_id()).repartitionById(tasks, F.col("_part"))
    place = Window.partitionBy(*part).orderBy(*order)
    inside = F.coalesce(F.sum(weight).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(place) - 1
    first = F.row_number().over(Window.partitionBy("_part").orderBy(*group, *order)) == 1  # the same sort
    rows = stored(rows.withColumn("_inside", inside).withColumn("_first", first))

    split = rows
    if group:
        firsts = rows.where("_first").select(*[F.col(c).alias(f"_of_{c}") for c in group]).distinct()
        split = rows.join(F.broadcast(firsts), [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group], "left_semi")
    sizes = split.groupBy(*part).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in part], F.sum("_n").over(before).alias("_before")).where("_before is not null")
    found = rows.join(F.broadcast(sizes), [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in part], "left")
    return found.select(*df.columns, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


#: Most rows that are broadcast beside a group's values, and the inverse of the share of all rows above which a group is hot.
BROADCAST_ROWS = 500_000
HOT_SHARE = 1000


def with_group_values(rows: DataFrame, values: DataFrame, group: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has a row of bounded width for each group, and in ``count`` how many rows it has.

    Few groups are broadcast. Of many, the hot ones and null are, at most HOT_SHARE whatever the size, and the others shuffle, dealt by
    the count of rows. Both sides are read twice: cut their lineage before.
    """
    groups, total = values.agg(F.count(F.lit(1)), F.coalesce(F.sum(count), F.lit(0))).first()
    named = values.withColumnRenamed(group, "_of_group")
    same = F.col(group).eqNullSafe(F.col("_of_group"))
    if groups <= BROADCAST_ROWS:
        return rows.join(F.broadcast(named.drop(count)), same).drop("_of_group")
    hot = F.col("_of_group").isNull() | (F.col(count) > total // HOT_SHARE)
    few = F.broadcast(named.where(hot).drop(count))
    tasks = tasks_for(rows.sparkSession, total)
    rest = rows.join(few.select("_of_group"), same, "left_anti").repartition(tasks, group)
    others = named.where(~hot).drop(count).repartition(tasks, "_of_group")
    return rows.join(few, same).unionByName(rest.join(others, F.col(group) == F.col("_of_group"))).drop("_of_group")


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder of this name, in whatever file system it names?"""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _manifest(spark: SparkSession, folder: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, folder: str, part: int, facts: dict) -> None:
    """Make ``part`` of the tables in ``folder`` visible, with facts about it: its entry appears whole, by a rename, or not at all."""
    place, fs = _manifest(spark, folder)
    made, entry = (spark._jvm.org.apache.hadoop.fs.Path(place, name) for name in (f".{part}.{uuid.uuid4().hex}", f"{part}.json"))
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(facts), "utf-8"))
    out.close()
    if not fs.rename(made, entry):  # a run that was taken for lost has published it
        fs.delete(made, False)


def published(spark: SparkSession, folder: str) -> dict[int, dict]:
    """The parts that have been published in ``folder``, with their facts."""
    place, fs = _manifest(spark, folder)
    found = {}
    for status in fs.listStatus(place) if fs.exists(place) else []:
        name = status.getPath().getName()
        if name.endswith(".json") and name[0] != ".":
            into = fs.open(status.getPath())
            found[int(name[: -len(".json")])] = json.loads(bytes(into.readAllBytes()))
            into.close()
    return dict(sorted(found.items()))


def unpublish(spark: SparkSession, folder: str, part: int, *tables: str) -> None:
    """Take a part out of the manifest, then delete its rows in ``tables``."""
    place, fs = _manifest(spark, folder)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(place, f"{part}.json"), False)
    for table in tables:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}/part={part}"), True)


def published_table(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """``table`` of all published parts; what an unpublished part has left behind is not read. Empty if there are none."""
    parts = [f"{folder}/{table}/part={n}" for n in published(spark, folder)]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/{table}").parquet(*parts)
