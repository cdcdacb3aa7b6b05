"""Running computations over ordered groups of any size: previous rows, linear recurrences, sliding maxima.

Rows come with gapless numbers in their group (``tables.numbered``). They are cut into blocks of BLOCK numbers; a block is computed on
its own, the blocks' results are composed by the same function one level up, and every block is finished with what comes before it. So
one long group fills many tasks, and no task holds more than a block of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions.tables import BROADCAST_ROWS, stored, tasks_for

BLOCK = 4096


def _block(n: str, size: int) -> Column:
    return F.floor(F.col(n) / size)


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the rows of a block in one task, and in a task as many blocks as their number of rows allows."""
    return rows.repartition(tasks_for(rows.sparkSession, rows.count()), *keys)


def with_previous(rows: DataFrame, group: list[str], n: str, column: str, name: str, size: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: ``column`` of the row numbered one less in the group, null in the first.

    The last row of a block is dealt to the next block too. ``rows`` is read twice: cut its lineage before.
    """
    keys = [*group, "_block"]
    blocks = rows.withColumn("_block", _block(n, size)).withColumn("_copy", F.lit(False))
    ends = blocks.where(F.col(n) % size == size - 1).withColumn("_block", F.col("_block") + 1).withColumn("_copy", F.lit(True))
    found = _dealt(blocks.unionByName(ends), keys).withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(n)))
    return found.where(~F.col("_copy")).select(*rows.columns, name)


def segmented_scan(scale: np.ndarray, offset: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running composition of the maps y -> scale * y + offset, anew wherever ``first``; by doubling the stretch that is composed."""
    scale, offset = scale.copy(), offset.copy()
    start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    place = np.arange(len(first)) - start
    step = 1
    while step <= place.max(initial=0):
        at = np.flatnonzero(place >= step)
        offset[at], scale[at] = scale[at] * offset[at - step] + offset[at], scale[at] * scale[at - step]
        step *= 2
    return scale, offset


def with_recurrence(rows: DataFrame, group: list[str], n: str, scale: Column, offset: Column, name: str, size: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: y of the recurrence y = scale * (y of the row numbered one less) + offset, which starts from 0.

    Neither ``scale`` nor ``offset`` may be null.
    """
    rows = rows.withColumn("_block", _block(n, size)).withColumn("_scale", scale.cast("double")).withColumn("_offset", offset.cast("double"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.array([1.0]), np.array([0.0])  # the block that a batch's first rows belong to may have begun in the last batch
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index
            s, o = batch.column(at("_scale")).to_numpy(), batch.column(at("_offset")).to_numpy()
            first = batch.column(at(n)).to_numpy() % size == 0
            s, o = segmented_scan(np.concatenate((before[0], s)), np.concatenate((before[1], o)), np.concatenate(([True], first)))
            before = s[-1:], o[-1:]
            batch = batch.set_column(at("_scale"), "_scale", pa.array(s[1:]))
            yield batch.set_column(at("_offset"), "_offset", pa.array(o[1:]))

    keys = [*group, "_block"]
    rows = stored(_dealt(rows, keys).sortWithinPartitions(*keys, n).mapInArrow(local, rows.schema))
    if rows.where("_block > 0").isEmpty():
        return rows.withColumn(name, F.col("_offset")).drop("_block", "_scale", "_offset")
    ends = rows.where(F.col(n) % size == size - 1).select(*group, F.col("_block").alias("_n"), F.col("_scale").alias("_s"), F.col("_offset").alias("_o"))
    ends = with_recurrence(ends, group, "_n", F.col("_s"), F.col("_o"), "_y", size)
    ends = stored(ends.select(*[F.col(c).alias(f"_of_{c}") for c in group], (F.col("_n") + 1).alias("_of__block"), F.col("_y").alias("_before")))
    few = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends  # a row a block
    found = rows.join(few, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys], "left")
    y = F.col("_scale") * F.coalesce("_before", F.lit(0.0)) + F.col("_offset")
    return found.withColumn(name, y).drop(*[f"_of_{c}" for c in keys], "_block", "_scale", "_offset", "_before")


def with_sliding_max(rows: DataFrame, group: list[str], n: str, column: str, width: int, name: str) -> DataFrame:
    """``rows`` with ``name``: the largest ``column`` of the ``width`` rows before each, null if there are none.

    In blocks of ``width`` rows, the rows before are the end of the last block and the start of this one, so the maxima of all starts
    and of all ends of blocks answer every row: a block is dealt to a task with the one before it, and each row is looked at twice in
    both, however wide the frame. ``rows`` is read three times: cut its lineage before.
    """
    keys = [*group, "_block"]
    both = rows.withColumn("_block", _block(n, width)).withColumn("_place", F.col(n)).withColumn("_copy", F.lit(False))
    if not rows.where(F.col(n) >= width).isEmpty():
        last = both.withColumn("_block", F.col("_block") + 1).withColumn("_place", F.col(n) + width).withColumn("_copy", F.lit(True))
        both = both.unionByName(last)
    start = F.max(F.when(~F.col("_copy"), F.col(column))).over(Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    end = F.max(F.when(F.col("_copy"), F.col(column))).over(Window.partitionBy(*keys).orderBy(F.desc("_place")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = _dealt(both, keys).withColumn("_start", start).withColumn("_end", end).where(~F.col("_copy"))
    return found.select(*rows.columns, F.greatest("_start", "_end").alias(name))
