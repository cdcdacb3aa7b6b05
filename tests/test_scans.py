"""Running computations over long groups against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaspark.functions import scans, tables
from qaspark.operators import rewards

GROUPS = {"a": 700, "b": 1, None: 65, "c": 64}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = [(g, i, rng.random(), rng.choice([0.0, 0.9, 1.1]), None if rng.random() < 0.2 else rng.random()) for g, n in GROUPS.items() for i in range(n)]
    rng.shuffle(made)
    return made, spark.createDataFrame(made, "g string, n long, offset double, scale double, v double")


def test_previous_rows(rows):
    made, df = rows
    got = scans.with_previous(df, ["g"], "n", "offset", "before", size=16).collect()
    at = {(g, n): o for g, n, o, _, _ in made}
    assert len(got) == len(made) and all(r.before == at.get((r.g, r.n - 1)) for r in got)


@pytest.mark.parametrize("size", [4, 64, 4096])
def test_recurrence_over_levels_of_blocks(rows, size):
    made, df = rows
    got = {(r.g, r.n): r.y for r in scans.with_recurrence(df, ["g"], "n", F.col("scale"), F.col("offset"), "y", size).collect()}
    assert len(got) == len(made)
    for g in GROUPS:
        y = 0.0
        for _, n, offset, scale, _ in sorted(r for r in made if r[0] == g):
            y = scale * y + offset
            assert got[g, n] == pytest.approx(y, rel=1e-9)


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_sliding_maxima(rows, width):
    made, df = rows
    got = {(r.g, r.n): r.most for r in scans.with_sliding_max(df, ["g"], "n", "v", width, "most").collect()}
    at = {(g, n): v for g, n, _, _, v in made}
    for (g, n), most in got.items():
        seen = [v for k in range(max(0, n - width), n) if (v := at[g, k]) is not None]
        assert most == max(seen, default=None)
    assert len(got) == len(made)


def test_one_long_episode(spark):
    """Advantages and priorities of an episode of 100,000 steps, 25 blocks."""
    n = 100_000
    step, x = F.col("id").cast("int").alias("step"), F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    df = spark.range(n).select(F.lit(1).cast("long").alias("episode"), step, x.alias("reward"), (1 - x).alias("value"), F.lit(0.5).alias("next_value"), (F.col("id") % 5000 == 4999).alias("done"), x.alias("priority"))
    table = df.toPandas().sort_values("step")
    ahead = np.append(table["value"].to_numpy()[1:], 0.5)
    going = 1 - table["done"].to_numpy().astype(int)
    delta = table["reward"].to_numpy() + rewards.GAMMA * ahead * going - table["value"].to_numpy()
    want, y = np.zeros(n), 0.0
    for i in range(n - 1, -1, -1):
        want[i] = y = delta[i] + rewards.GAMMA * rewards.LAMBDA * going[i] * y
    want = (want - want.mean()) / (want.std(ddof=1) + 1e-8)
    got = rewards.gae_advantages(df).toPandas().sort_values("step")
    assert np.abs(got["advantage"].to_numpy() - want).max() < 1.1e-5
    most = rewards.initial_priority(df).toPandas().sort_values("step")["initial_priority"]
    frame = table["priority"].rolling(rewards.BUFFER, min_periods=1).max().shift(1).fillna(1.0)
    assert most.tolist() == frame.tolist()


def test_missing_values_of_an_episode(spark):
    df = spark.createDataFrame([(1, 1, None, 0.5, 0.1, None), (1, 2, 1.0, None, None, True), (None, 1, 0.3, 0.2, 0.1, False)], "episode long, step int, reward double, value double, next_value double, done boolean")
    got = rewards.gae_advantages(df).collect()
    assert len(got) == 3 and all(r.advantage is not None for r in got)
    assert rewards.gae_advantages(df.limit(0)).isEmpty()


def _rows_by_task(spark, path):
    """Rows of each file below a folder of Parquet tables, which its tasks have written."""
    files = spark.read.option("recursiveFileLookup", "true").parquet(path).groupBy(F.input_file_name()).count().collect()
    return [r["count"] for r in files]


@pytest.mark.parametrize("group", [[], ["g"]])
@pytest.mark.parametrize("weight", [None, "w"])
def test_numbers_of_many_small_tasks(spark, monkeypatch, group, weight):
    """Parts go by the count of rows, not by the session: no task gets much more than its share, and no number is lost."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    folders = []
    monkeypatch.setattr(tables, "shared_folder", lambda spark, f=tables.shared_folder: folders.append(f(spark)) or folders[-1])
    g = F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 == 6, None).otherwise((F.col("id") % 500).cast("string"))
    df = spark.range(5000).select(g.alias("g"), "id", F.when(F.col("id") % 3 > 0, F.col("id") % 4).alias("w"))
    got = tables.numbered(df, group, [F.desc("id")], "n", weight).collect()
    assert len(got) == 5000
    seen = {}
    for r in sorted(got, key=lambda r: -r.id):
        key = tuple(r[c] for c in group)
        assert r.n == seen.get(key, 0)
        seen[key] = r.n + (r.w or 0 if weight else 1)
    assert max(_rows_by_task(spark, folders[0])) < 300


def test_blocks_are_dealt_by_their_rows(spark, rows, monkeypatch):
    """Sorts of the running computations get as many tasks as the rows need, which Spark may not merge."""
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    _, df = rows
    for found in (scans.with_sliding_max(df, ["g"], "n", "v", 16, "most"), scans.with_previous(df, ["g"], "n", "offset", "before", 16)):
        assert found.count() == sum(GROUPS.values())
        plan = found._jdf.queryExecution().executedPlan().toString()
        counts = [int(x) for x in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)]
        assert counts and min(counts) >= 17 and "ENSURE_REQUIREMENTS" not in plan


def test_values_of_many_groups_are_dealt_by_rows(spark, monkeypatch):
    """With more groups than are broadcast, hot ones and null are, and the others meet in as many parts as the rows need."""
    for name, value in (("TASK_ROWS", 100), ("BROADCAST_ROWS", 10), ("HOT_SHARE", 10)):
        monkeypatch.setattr(tables, name, value)
    g = F.when(F.col("id") % 4 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 300)
    rows = tables.stored(spark.range(2000).select("id", g.alias("g")))
    values = tables.stored(rows.groupBy("g").agg(F.max("id").alias("most"), F.count(F.lit(1)).alias("n")))
    found = tables.with_group_values(rows, values, "g", "n")
    most = {r.g: r.most for r in values.collect()}
    got = found.collect()
    assert len(got) == 2000 == len({r.id for r in got}) and all(r.most == most[r.g] for r in got) and None in most
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan).count("20") >= 2 and "hashpartitioning" not in re.sub(r"hashpartitioning\([^)]*\), REPARTITION_BY_NUM", "", plan)
