"""Samples that are a share of the rows are ranked bin by bin."""

import re

import pytest
from pyspark.sql import functions as F

from qaspark.operators import rewards


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 2000])
@pytest.mark.parametrize("bins", [1, 16, 65_536])
def test_the_first_n(spark, monkeypatch, n, bins):
    monkeypatch.setattr(rewards, "BINS", bins)
    rows = spark.range(1000).select((F.col("id") % 700).alias("ordinal")).withColumn("_u", rewards.uniform("ordinal", 5))
    want = sorted((r._u, r.ordinal) for r in rows.collect())[:n]
    assert [(r._u, r.ordinal) for r in rewards.first_by_chance(rows, n).collect()] == want


def test_no_task_ranks_the_sample(spark):
    cases = spark.range(50_000).select(F.col("id").alias("ordinal"))
    got = rewards.exploration_tests(cases, cases.where("ordinal % 2 = 0"))
    limits = [int(x) for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", got._jdf.queryExecution().executedPlan().toString())]
    assert got.count() == 5000 and all(x < 100 for x in limits)


def test_missing_ordinals_come_first(spark):
    cases = spark.createDataFrame([(None,), (1,), (2,)], "ordinal long")
    assert rewards.exploration_tests(cases, cases.where("ordinal = 1")).collect()[0].ordinal is None
