"""Assertions over JSON responses, and validation of whole responses."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.numbers import let
from qaspark.registry import query

# The forms of an assertion, tried in this order; length comes before equality, which it would also match.
FORMS = {
    "length": r"^(\w+(?:\.\w+)*)\.length\s*==\s*(\d+)",
    "equals": r"^(\w+(?:\.\w+)*)\s*==\s*(.+)",
    "not_equals": r"^(\w+(?:\.\w+)*)\s*!=\s*(.+)",
    "greater_than": r"^(\w+(?:\.\w+)*)\s*>\s*(.+)",
    "less_than": r"^(\w+(?:\.\w+)*)\s*<\s*(.+)",
    "contains": r"^(\w+(?:\.\w+)*)\s+contains\s+(.+)",
    "not_null": r"^(\w+(?:\.\w+)*)\s+is\s+not\s+null",
    "null": r"^(\w+(?:\.\w+)*)\s+is\s+null",
}


def _python_text(value: Column, raw: Column) -> Column:
    """How the value prints: booleans capitalised, a missing one as None."""
    return F.when(value.isNull(), "None").when(raw == "true", "True").when(raw == "false", "False").otherwise(value)


@query(
    "results",
    prepare=lambda r: (r.select("id", F.get(F.array(*[F.lit(a) for a in ("data.k == 5", "data.k != 5", "data.k > 50", "data.k < 50", "data.name contains ser", "data.missing is null", "data.k is not null", "data.name.length == 5", "data.k >= 5", "what")]), (F.col("id") % 10).cast("int")).alias("assertion"), F.concat(F.lit('{"data": {"k": '), "k", F.lit(', "name": "user'), F.col("k") % 10, F.lit('"}}')).alias("response_json")),),
    sql="""SELECT id, ['equals', 'not_equals', 'greater_than', 'less_than', 'contains', 'null', 'not_null', 'length', 'error', 'unknown'][id % 10 + 1] AS type,
    CASE id % 10 WHEN 0 THEN k = 5 WHEN 1 THEN k <> 5 WHEN 2 THEN k > 50 WHEN 3 THEN k < 50 WHEN 4 THEN true WHEN 5 THEN true WHEN 6 THEN true WHEN 7 THEN true ELSE false END AS passed FROM results""",
)
def evaluate_assertions(rows: DataFrame) -> DataFrame:
    """Type and outcome of ``assertion`` ("path operator value") on ``response_json``. An unknown form, and >= and <=, do not pass."""
    return rows.select("id", outcome(F.col("assertion"), F.col("response_json")).alias("o")).select("id", "o.type", "o.passed")


def outcome(assertion: Column, response: Column) -> Column:
    """Struct of type and passed: how an assertion fares on a JSON text."""

    def read(text: Column) -> Column:
        kind = F.lit("unknown")
        for name, form in reversed(FORMS.items()):
            kind = F.when(text.rlike(form), name).otherwise(kind)
        return F.struct(text.alias("text"), kind.alias("type"))

    def taken_apart(r: Column) -> Column:
        part = lambda i: F.coalesce(*[F.when(r["type"] == n, F.regexp_extract(r["text"], f, i)) for n, f in FORMS.items() if i == 1 or "(.+)" in f or "(\\d+)" in f])
        value = F.trim(part(2), F.lit("\"' "))
        actual = F.try_variant_get(F.try_parse_json(response), F.concat(F.lit("$."), part(1)), "string")
        return F.struct(r["type"].alias("type"), value.alias("value"), actual.alias("actual"))

    def judged(r: Column) -> Column:
        actual, value = r["actual"], r["value"]
        number, limit = actual.try_cast("double"), value.try_cast("double")
        printed = _python_text(actual, actual)
        passed = (
            F.when(r["type"] == "equals", printed == value)
            .when(r["type"] == "not_equals", printed != value)
            .when(r["type"] == "greater_than", number > limit)
            .when(r["type"] == "less_than", number < limit)
            .when(r["type"] == "contains", F.contains(actual, value))
            .when(r["type"] == "null", actual.isNull())
            .when(r["type"] == "not_null", actual.isNotNull())
            .when(r["type"] == "length", F.length(actual) == value.try_cast("int"))
        )
        bad = r["type"].isin("greater_than", "less_than") & limit.isNull()
        return F.struct(F.when(bad, "error").otherwise(r["type"]).alias("type"), F.coalesce(passed & ~bad, F.lit(False)).alias("passed"))

    return let(let(let(F.trim(assertion), read), taken_apart), judged)


def _subset(expected, actual) -> bool:
    if isinstance(expected, dict):
        return isinstance(actual, dict) and all(k in actual and _subset(v, actual[k]) for k, v in expected.items())
    return expected == actual


def _parse(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


@query(
    "results",
    prepare=lambda r: (
        r.select(
            "id",
            "expected_status",
            "actual_status",
            F.when(F.col("k") % 4 == 0, None).when(F.col("k") % 2 == 0, F.concat(F.lit('{"k": '), "k", F.lit("}"))).otherwise(F.lit('{"z": 1}')).alias("expected"),
            F.concat(F.lit('{"k": '), "k", F.lit(', "more": [1]}')).alias("actual"),
            F.when(F.col("id") % 4 == 0, F.array(F.lit("k > 20"), F.lit("k is not null"))).alias("assertions"),
        ),
    ),
    sql="""SELECT *, status_ok AND body_ok AND assertions_ok AS passed FROM (SELECT id, coalesce(expected_status = actual_status, false) AS status_ok, k % 2 = 0 AS body_ok, id % 4 <> 0 OR k > 20 AS assertions_ok FROM results)""",
)
def validate_responses(rows: DataFrame) -> DataFrame:
    """Status equality; whether the expected JSON is a subset of the actual one (lists are compared whole; none expected is fine); and
    whether all ``assertions`` pass on the actual one. A response passes if all three do."""

    @F.pandas_udf("boolean")
    def subset(expected: pd.Series, actual: pd.Series) -> pd.Series:
        parsed = ((_parse(e), a) for e, a in zip(expected, actual, strict=True))
        return pd.Series([not e or _subset(e, _parse(a)) for e, a in parsed], dtype=bool)

    status = F.coalesce(F.col("expected_status") == F.col("actual_status"), F.lit(False))
    all_pass = F.coalesce(F.forall("assertions", lambda a: outcome(a, F.col("actual"))["passed"]), F.lit(True))
    checked = rows.select("id", status.alias("status_ok"), subset("expected", "actual").alias("body_ok"), all_pass.alias("assertions_ok"))
    return checked.withColumn("passed", F.col("status_ok") & F.col("body_ok") & F.col("assertions_ok"))
