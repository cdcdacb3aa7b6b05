"""Validation of test cases, specifications and single values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.tables import numbered, stored
from qaspark.registry import query

# HTTP verbs and the patterns of valid e-mail addresses and URLs.
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://[^\s/$.?#].[^\s]*$"

SQL_VERB = "coalesce(upper(method) IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH', 'HEAD', 'OPTIONS'), false)"
SQL_ERROR = f"""CASE WHEN coalesce(name, '') = '' THEN 'Missing required fields: [''name'']' WHEN method IS NOT NULL AND NOT {SQL_VERB} THEN 'Invalid HTTP method: ' || method
 WHEN endpoint = '' THEN 'Invalid endpoint path: ' END"""


def is_verb(method: Column) -> Column:
    return F.coalesce(F.upper(method).isin(*VERBS), F.lit(False))


def case_error() -> Column:
    """First thing wrong with a test case; null if nothing is."""
    return (
        F.when(F.coalesce("name", F.lit("")) == "", "Missing required fields: ['name']")
        .when(F.col("method").isNotNull() & ~is_verb(F.col("method")), F.concat(F.lit("Invalid HTTP method: "), "method"))
        .when(F.col("endpoint") == "", "Invalid endpoint path: ")
    )


@query("test_cases", sql=f"SELECT ordinal, method, {SQL_VERB} AS valid FROM test_cases")
def valid_http_method(cases: DataFrame) -> DataFrame:
    """Is the method one of the seven verbs, in any case? Missing: no."""
    return cases.select("ordinal", "method", is_verb(F.col("method")).alias("valid"))


@query("test_cases", sql=f"SELECT ordinal, {SQL_ERROR} IS NULL AS is_valid, {SQL_ERROR} AS error FROM test_cases")
def validate_test_cases(cases: DataFrame) -> DataFrame:
    """Validity and first error of every case."""
    return cases.select("ordinal", case_error().isNull().alias("is_valid"), case_error().alias("error"))


@query(
    "test_cases",
    sql=f"""WITH c AS (SELECT suite_id, ordinal, row_number() OVER (PARTITION BY suite_id ORDER BY ordinal) - 1 AS idx, {SQL_ERROR} AS error FROM test_cases)
    SELECT suite_id, false AS is_valid, idx, 'Test case ' || idx || ': ' || error AS error FROM c WHERE error IS NOT NULL UNION ALL SELECT suite_id, true, NULL, NULL FROM c GROUP BY 1 HAVING count(error) = 0""",
)
def validate_suite(cases: DataFrame) -> DataFrame:
    """A row for each error of a suite, with the number of its case in the suite, and one row for a suite without errors.

    Cases are numbered over range partitions and errors stay rows, so a suite of any size is spread over many tasks.
    """
    rows = cases.select("suite_id", "ordinal", case_error().alias("error"))
    indexed = stored(numbered(rows, ["suite_id"], ["ordinal"], "idx"))
    line = F.concat(F.lit("Test case "), F.col("idx").cast("string"), F.lit(": "), "error")
    errors = indexed.where("error is not null").select("suite_id", F.lit(False).alias("is_valid"), "idx", line.alias("error"))
    fine = indexed.groupBy("suite_id").agg(F.count("error").alias("_n")).where("_n = 0")
    return errors.unionByName(fine.select("suite_id", F.lit(True).alias("is_valid"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("error")))


@query("test_cases", sql=f"SELECT ordinal, name, test_type, method, endpoint FROM test_cases WHERE {SQL_ERROR} IS NULL AND NOT (test_case IS NOT NULL AND method IS NULL)")
def filter_valid_tests(cases: DataFrame) -> DataFrame:
    """Valid cases, without malformed edge cases (a nested test case and no method)."""
    return cases.where(case_error().isNull() & ~(F.col("test_case").isNotNull() & F.col("method").isNull())).select("ordinal", "name", "test_type", "method", "endpoint")


@query("endpoints_raw", sql="SELECT controller, count(path) AS n_endpoints, count(path) > 0 AS valid FROM endpoints_raw GROUP BY 1")
def spec_valid(endpoints: DataFrame) -> DataFrame:
    """A specification (one per controller) is valid with at least one endpoint."""
    return endpoints.groupBy("controller").agg(F.count("path").alias("n_endpoints"), (F.count("path") > 0).alias("valid"))


def _addresses(customers: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    mail = F.concat(F.when(key % 3 == 0, F.lit("user ")).otherwise(F.lit("user.")), key, F.when(key % 5 == 0, F.lit("#")).otherwise(F.lit("@")), F.lower("c_mktsegment"), F.lit(".org"))
    return customers.select("c_custkey", mail.alias("email"))


_MAIL = "CASE WHEN c_custkey % 3 = 0 THEN 'user ' ELSE 'user.' END || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '#' ELSE '@' END || lower(c_mktsegment) || '.org'"


@query("customer", prepare=lambda c: (_addresses(c),), sql=f"SELECT c_custkey, email, regexp_matches(email, '{EMAIL}') AS valid FROM (SELECT c_custkey, {_MAIL} AS email FROM customer)")
def validate_email(rows: DataFrame) -> DataFrame:
    """Is ``email`` a valid address?"""
    return rows.withColumn("valid", F.col("email").rlike(EMAIL))


@query("pages", prepare=lambda p: (p.select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" "), "url")).otherwise(F.col("url")).alias("url")),), sql=f"SELECT page_id, url, regexp_matches(url, '{URL}') AS valid FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN ' ' || url ELSE url END AS url FROM pages)")
def validate_url(rows: DataFrame) -> DataFrame:
    """Is ``url`` a valid http address?"""
    return rows.withColumn("valid", F.col("url").rlike(URL))


@query(
    "llm_responses",
    prepare=lambda r: (r.select("id", F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"id": '), "turn", F.lit("}"))).otherwise(F.concat(F.lit('{"id": '), "turn")).alias("data")),),
    sql="""SELECT id, data, json_valid(data) AS valid FROM (SELECT id, '{"id": ' || turn || CASE WHEN turn % 2 = 0 THEN '}' ELSE '' END AS data FROM llm_responses)""",
)
def validate_json(rows: DataFrame) -> DataFrame:
    """Does ``data`` parse as strict JSON?"""
    return rows.withColumn("valid", F.try_parse_json("data").isNotNull())


@query("test_cases", sql="SELECT ordinal, len(m) = 0 AS ok, array_to_string(m, ', ') AS missing FROM (SELECT ordinal, list_filter([CASE WHEN name IS NULL THEN 'name' END, CASE WHEN method IS NULL THEN 'method' END, CASE WHEN endpoint IS NULL THEN 'endpoint' END], lambda x: x IS NOT NULL) AS m FROM test_cases)")
def required_fields(rows: DataFrame, fields: tuple[str, ...] = ("name", "method", "endpoint")) -> DataFrame:
    """Which of the required fields a row lacks."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    return rows.select("ordinal", (F.size(missing) == 0).alias("ok"), F.array_join(missing, ", ").alias("missing"))


@query("knowledge", sql="SELECT id, TRY_CAST(json_extract_string(item_json, '$.source') AS INT) IS NOT NULL AS ok, CASE WHEN TRY_CAST(json_extract_string(item_json, '$.source') AS INT) IS NULL THEN 'source must be int' ELSE '' END AS errors FROM knowledge")
def field_types(rows: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Errors of the JSON fields that can't be read as their declared types."""
    declared = types or {"name": "string", "source": "int"}
    wrong = F.array_compact(F.array(*[F.when(F.get_json_object("item_json", f"$.{f}").try_cast(t).isNull(), F.lit(f"{f} must be {t}")) for f, t in declared.items()]))
    return rows.select("id", (F.size(wrong) == 0).alias("ok"), F.array_join(wrong, ", ").alias("errors"))


@query("test_cases", sql="SELECT ordinal, name, test_type FROM test_cases UNION ALL SELECT ordinal, name, test_type FROM test_cases WHERE test_type = 'edge_case'", prepare=lambda c: (c, c.where("test_type = 'edge_case'")))
def all_tests(cases: DataFrame, edge_cases: DataFrame) -> DataFrame:
    """Test cases and edge cases together, duplicates kept."""
    return cases.unionByName(edge_cases, allowMissingColumns=True).select("ordinal", "name", "test_type")


@query("test_cases", sql="SELECT ordinal, name, test_type FROM test_cases WHERE ordinal % 3 <> 0", prepare=lambda c: (c, c.where("ordinal % 3 = 0")))
def unselected_tests(cases: DataFrame, selected: DataFrame) -> DataFrame:
    """Cases that were not selected."""
    return cases.join(selected.select("ordinal"), "ordinal", "left_anti").select("ordinal", "name", "test_type")


@query("test_cases", sql="SELECT ordinal, endpoint FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ordinal) AS n FROM test_cases) WHERE n <= 50")
def max_tests_per_endpoint(cases: DataFrame, most: int = 50) -> DataFrame:
    """At most so many cases of each endpoint, the first ones."""
    from pyspark.sql import Window

    return cases.withColumn("_n", F.row_number().over(Window.partitionBy("endpoint").orderBy("ordinal"))).where(F.col("_n") <= most).select("ordinal", "endpoint")
