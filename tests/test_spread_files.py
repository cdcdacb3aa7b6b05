"""Source files are dealt out over tasks, and every file is parsed once."""

from qaspark.operators import scopes, sourcecode

CODE = "public class A { public void B() { if (x == null) { } } }"


def files(spark, n):
    return spark.range(n).coalesce(1).selectExpr("concat('f', id, '.cs') AS path", "'csharp' AS language", f"'{CODE}' AS code")


def test_one_partition_of_files_becomes_many(spark, monkeypatch):
    monkeypatch.setattr(scopes, "TASK_FILES", 10)
    for query in (sourcecode.methods_inventory, sourcecode.inline_validations):
        got = query(files(spark, 100))
        assert got.rdd.getNumPartitions() == 10 and got.count() == 100
    assert scopes.spread(files(spark, 0)).count() == 0


def test_validators_parse_a_file_once(spark):
    plan = sourcecode.validators_inventory(files(spark, 3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("PythonMapInArrow") <= 2 and "MapInArrow" in plan


def test_scopes_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(scopes, "HELD_CHARS", 20)
    rows = scopes.with_scopes(files(spark, 5), "method").collect()
    assert len(rows) == 5 and all(r.rules == [] and r.owner == "A" for r in rows)
