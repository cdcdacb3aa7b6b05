"""Validators of models: categories, strength, test cases and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.tables import numbered
from qaspark.registry import query

# Parts of rule names by category, in order of precedence.
CATEGORIES = {"format": ("email", "url", "phone"), "size": ("length", "size", "min", "max"), "presence": ("required", "notnull", "notempty"), "pattern": ("pattern", "regex", "matches"), "range": ("range", "between")}


def category_of(rules: Column) -> Column:
    """Category of the first rule that has one; custom if none has."""
    each = lambda r: F.coalesce(*[F.when(F.lower(r).rlike("|".join(names)), c) for c, names in CATEGORIES.items()])
    return F.coalesce(F.get(F.array_compact(F.transform(rules, each)), F.lit(0)), F.lit("custom"))


_EACH = "CASE " + " ".join(f"WHEN regexp_matches(lower(r), '{'|'.join(names)}') THEN '{c}'" for c, names in CATEGORIES.items()) + " END"


@query("validator_rows", sql=f"SELECT ordinal, coalesce(list_filter(list_transform(rules, lambda r: {_EACH}), lambda x: x IS NOT NULL)[1], 'custom') AS category FROM validator_rows")
def validation_category(validators: DataFrame) -> DataFrame:
    return validators.select("ordinal", category_of(F.col("rules")).alias("category"))


@query("validator_rows", sql="SELECT ordinal, CASE WHEN len(rules) > 3 OR (list_contains(rules, 'NotNull') AND list_contains(rules, 'Pattern')) THEN 'strict' WHEN len(rules) > 1 OR list_contains(rules, 'NotNull') THEN 'moderate' ELSE 'lenient' END AS strength FROM validator_rows")
def validation_strength(validators: DataFrame) -> DataFrame:
    """Strict with over three rules or required and patterned, moderate with several or required, else lenient."""
    has = lambda form: F.exists("rules", lambda r: F.lower(r).rlike(form))
    n = F.size("rules")
    return validators.select("ordinal", F.when((n > 3) | (has("required|notnull") & has("pattern|regex")), "strict").when((n > 1) | has("required|notnull"), "moderate").otherwise("lenient").alias("strength"))


_CASES = """CASE r WHEN 'NotEmpty' THEN ['|fail|empty value', 'value|pass|non-empty value'] WHEN 'Length' THEN [repeat('a', min_length - 1) || '|fail|below min length', repeat('a', min_length) || '|pass|at min length', repeat('a', max_length) || '|pass|at max length',
 repeat('a', max_length + 1) || '|fail|above max length'] WHEN 'EmailAddress' THEN ['invalid|fail|invalid email', 'test@example.com|pass|valid email', 'test@|fail|incomplete email'] WHEN 'Matches' THEN ['test_pattern|depends|must match pattern: '] WHEN 'Pattern' THEN ['test_pattern|depends|must match pattern: '] ELSE [] END"""


@query("validator_rows", sql=f"SELECT ordinal, rule, string_split(c, '|')[1] AS input, string_split(c, '|')[2] AS expected, string_split(c, '|')[3] AS reason FROM (SELECT ordinal, r AS rule, unnest({_CASES}) AS c FROM (SELECT ordinal, min_length, max_length, unnest(rules) AS r FROM validator_rows))")
def validation_test_cases(validators: DataFrame) -> DataFrame:
    """Inputs that each rule should pass or fail."""
    case = lambda value, expected, reason: F.struct((value if isinstance(value, Column) else F.lit(value)).alias("input"), F.lit(expected).alias("expected"), F.lit(reason).alias("reason"))
    run = lambda n: F.repeat(F.lit("a"), n)
    least, most = F.col("min_length"), F.col("max_length")
    rule = F.col("rule")
    cases = (
        F.when(rule == "NotEmpty", F.array(case("", "fail", "empty value"), case("value", "pass", "non-empty value")))
        .when(rule == "Length", F.array(case(run(least - 1), "fail", "below min length"), case(run(least), "pass", "at min length"), case(run(most), "pass", "at max length"), case(run(most + 1), "fail", "above max length")))
        .when(rule == "EmailAddress", F.array(case("invalid", "fail", "invalid email"), case("test@example.com", "pass", "valid email"), case("test@", "fail", "incomplete email")))
        .when(rule.isin("Matches", "Pattern"), F.array(case("test_pattern", "depends", "must match pattern: ")))
    )
    rows = validators.select("ordinal", "min_length", "max_length", F.explode("rules").alias("rule"))
    return rows.select("ordinal", "rule", F.explode(cases).alias("c")).select("ordinal", "rule", "c.*")


def _with_validations(validators: DataFrame) -> DataFrame:
    return validators.withColumn("validations", F.when(F.col("min_length") % 2 == 0, F.array(F.concat(F.lit("min "), F.col("min_length").cast("string")))))


@query(
    "validator_rows",
    prepare=lambda v: (_with_validations(v),),
    sql="""WITH r AS (SELECT model || '_' || field AS key, ordinal, 'rules' AS kind, unnest(rules) AS value, generate_subscripts(rules, 1) AS i FROM validator_rows
      UNION ALL SELECT model || '_' || field, ordinal, 'validations', 'min ' || min_length, 1 FROM validator_rows WHERE min_length % 2 = 0)
    SELECT key, kind, row_number() OVER (PARTITION BY key, kind ORDER BY ordinal, i) - 1 AS position, value FROM r""",
)
def merge_validators(validators: DataFrame) -> DataFrame:
    """Validators of one model and field as one: its rules and its validations, numbered in order.

    What is merged stays rows and is numbered over range partitions, so any number of validators may share a key.
    """
    key = F.concat_ws("_", "model", "field").alias("key")
    parts = [validators.select(key, "ordinal", F.lit(c).alias("kind"), F.posexplode(c).alias("_i", "value")) for c in ("rules", "validations") if c in validators.columns]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return numbered(rows, ["key", "kind"], ["ordinal", "_i"], "position").select("key", "kind", "position", "value")
