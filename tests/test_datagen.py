"""Test data where many parameters share a name."""

from pyspark.sql import functions as F

from qaspark.operators import datagen

PARAMETERS = "id long, endpoint string, name string, type string, required boolean, min_value int, max_value int, min_length int, max_length int, test_type string"


def test_one_parameter_a_name_meets_the_tests(spark):
    n = 4000
    kind = F.when(F.col("id") % 2 == 0, "integer").otherwise("boolean")
    many = spark.range(n).select("id", F.lit("/p").alias("endpoint"), F.concat(F.lit("label"), F.col("id") % 2).alias("name"), kind.alias("type"), (F.col("id") % 3 == 0).alias("required"), *[F.lit(1).alias(c) for c in ("min_value", "max_value", "min_length", "max_length")], F.lit("x").alias("test_type"))
    odd = spark.createDataFrame([(None, "/p", "noid", "string", True, *[None] * 5), (7, None, "nowhere", "string", True, *[None] * 5)], PARAMETERS)
    parameters = many.unionByName(odd)
    counting = datagen.counting(parameters).collect()
    want = {("all", "label0", n - 2), ("all", "label1", n - 1), ("all", "noid", None), ("any", "noid", None)}
    want |= {("missing", "label0", n - 2), ("missing", "label1", n - 3)}
    got = {(r.scope, r.name, r.id) for r in counting}
    assert len(counting) == len(got) and {g for g in got if g[0] != "any"} == {w for w in want if w[0] != "any"}
    assert {g[1] for g in got if g[0] == "any"} == {"label0", "label1", "noid"}
    tests = spark.createDataFrame([("t", "/p", "validation", "wrong type", None), ("m", "/p", "validation", "missing", None), ("none", "/q", "functional", None, None)], "test string, endpoint string, test_type string, description string, test_data string")
    data = {r.test: r.test_data for r in datagen.generate_test_data(tests, parameters).collect()}
    assert data["t"] == '{"label0":"not_a_number","label1":"not_a_boolean"}' and data["none"] == "{}"
    assert data["m"] in ('{"label0":1,"label1":true}', '{"label0":1,"label1":false}')
