"""Analysis of test results: summaries, breakdowns, failures, performance, coverage, feedback rows and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions.numbers import exact_sum, mean2, round2, share, sql_mean2, sql_round2, sql_share, sql_sum
from qaspark.registry import query

# Test types whose failures are critical, and types that count as bugs or edge cases.
CRITICAL = ("authentication", "security", "validation")
BUG_TYPES = ("security", "validation")
EDGE_TYPES = ("edge_case", "boundary")

def _passed() -> Column:
    return F.coalesce(F.col("passed"), F.lit(False))


SQL_PASSED = "count(*) FILTER (WHERE coalesce(passed, false))"


def _outcomes() -> list[Column]:
    total, passed = F.count(F.lit(1)), F.count_if(_passed())
    return [total.alias("total"), passed.alias("passed"), (total - passed).alias("failed"), share(passed, total).alias("pass_rate")]


SQL_OUTCOMES = f"count(*) AS total, {SQL_PASSED} AS passed, count(*) - {SQL_PASSED} AS failed, {sql_share(SQL_PASSED, 'count(*)')} AS pass_rate"


@query("results", sql=f"SELECT {SQL_OUTCOMES}, coalesce({sql_round2(sql_sum('execution_time'))}, 0.0) AS total_time, {sql_mean2('execution_time')} AS average_time FROM results")
def result_summary(results: DataFrame) -> DataFrame:
    """Totals, pass rate and execution times of all results."""
    time = exact_sum("execution_time")
    return results.agg(*_outcomes(), F.coalesce(round2(time), F.lit(0.0)).alias("total_time"), mean2(time, F.count(F.lit(1))).alias("average_time"))


@query("results", sql=f"SELECT coalesce(test_type, 'unknown') AS test_type, {SQL_OUTCOMES} FROM results GROUP BY 1")
def results_by_type(results: DataFrame) -> DataFrame:
    """Outcomes per test type; a missing type is 'unknown'."""
    return results.groupBy(F.coalesce("test_type", F.lit("unknown")).alias("test_type")).agg(*_outcomes())


@query("results", sql=f"SELECT coalesce(endpoint, 'unknown') AS endpoint, {SQL_OUTCOMES} FROM results GROUP BY 1")
def results_by_endpoint(results: DataFrame) -> DataFrame:
    """Outcomes per endpoint; a missing endpoint is 'unknown'."""
    return results.groupBy(F.coalesce("endpoint", F.lit("unknown")).alias("endpoint")).agg(*_outcomes())


def error_type(error: Column) -> Column:
    """Text before the first colon; a missing error is 'Unknown error'."""
    return F.substring_index(F.coalesce(error, F.lit("Unknown error")), ":", 1)


SQL_ERROR = "split_part(coalesce(error, 'Unknown error'), ':', 1)"


@query("results", sql=f"SELECT {SQL_ERROR} AS error, count(*) AS n FROM results WHERE NOT coalesce(passed, false) GROUP BY 1")
def failure_counts(results: DataFrame) -> DataFrame:
    """Failures per error type."""
    return results.where(~_passed()).groupBy(error_type(F.col("error")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("results", sql=f"SELECT {SQL_ERROR} AS error, count(*) AS n FROM results WHERE NOT coalesce(passed, false) GROUP BY 1 ORDER BY n DESC, error LIMIT 5")
def top_errors(results: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent error types, ties by name."""
    return failure_counts(results).orderBy(F.desc("n"), "error").limit(n)


@query("results", sql="SELECT coalesce(test_type, 'unknown') AS test_type, count(*) AS failed FROM results WHERE NOT coalesce(passed, false) GROUP BY 1")
def failures_by_type(results: DataFrame) -> DataFrame:
    """Failed results per test type."""
    return results.where(~_passed()).groupBy(F.coalesce("test_type", F.lit("unknown")).alias("test_type")).agg(F.count(F.lit(1)).alias("failed"))


@query("results", sql="SELECT id, name, test_type, endpoint, method, error FROM results WHERE NOT coalesce(passed, false) AND test_type IN ('authentication', 'security', 'validation')")
def critical_failures(results: DataFrame, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    """Failed results of critical types."""
    return results.where(~_passed() & F.col("test_type").isin(*critical)).select("id", "name", "test_type", "endpoint", "method", "error")


_MEAN = f"{sql_sum('execution_time')} / count(execution_time)"


@query(
    "results",
    sql=f"""SELECT coalesce({sql_round2(_MEAN)}, 0.0) AS average_time, {sql_round2('min(execution_time)')} AS min_time, {sql_round2('max(execution_time)')} AS max_time,
    count(*) FILTER (WHERE execution_time > 2 * (SELECT {_MEAN} FROM results)) AS slow_tests_count FROM results""",
)
def performance_stats(results: DataFrame) -> DataFrame:
    """Average, least and greatest execution time, and how many results took over twice the average."""
    mean = results.agg((exact_sum("execution_time") / F.count("execution_time")).alias("_mean"))
    time = F.col("execution_time")
    return results.join(F.broadcast(mean)).agg(
        F.coalesce(round2(F.first("_mean")), F.lit(0.0)).alias("average_time"),
        round2(F.min(time)).alias("min_time"),
        round2(F.max(time)).alias("max_time"),
        F.count_if(time > 2 * F.col("_mean")).alias("slow_tests_count"),
    )


@query("results", sql=f"SELECT id, name, test_type, endpoint, execution_time FROM results WHERE execution_time > 2 * (SELECT {_MEAN} FROM results) ORDER BY execution_time DESC, name LIMIT 5")
def slowest_tests(results: DataFrame, n: int = 5) -> DataFrame:
    """The slowest of the results that took over twice the average, ties by name."""
    mean = results.agg((exact_sum("execution_time") / F.count("execution_time")).alias("_mean"))
    slow = results.join(F.broadcast(mean)).where("execution_time > 2 * _mean")
    return slow.select("id", "name", "test_type", "endpoint", "execution_time").orderBy(F.desc("execution_time"), "name").limit(n)


def _kinds(c: str) -> Column:
    """Distinct values, a missing value counting as one."""
    return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))


def _coverage() -> list[Column]:
    total = F.coalesce(F.sum(F.size("assertions")), F.lit(0))
    passed = F.coalesce(F.sum(F.size(F.filter("assertions", lambda a: a["passed"]))), F.lit(0))
    return [
        F.coalesce(_kinds("endpoint"), F.lit(0)).alias("endpoints"),
        F.coalesce(_kinds("method"), F.lit(0)).alias("methods"),
        F.coalesce(_kinds("test_type"), F.lit(0)).alias("test_types"),
        total.alias("assertions"),
        passed.alias("assertions_passed"),
        share(passed, total).alias("assertion_rate"),
    ]


_ALL = "coalesce(CAST(sum(len(assertions)) AS BIGINT), 0)"
_GOOD = "coalesce(CAST(sum(len(list_filter(assertions, lambda a: a.passed))) AS BIGINT), 0)"
SQL_COVERAGE = ", ".join(f"coalesce(count(DISTINCT {c}) + max(CAST({c} IS NULL AS INT)), 0) AS {a}" for c, a in (("endpoint", "endpoints"), ("method", "methods"), ("test_type", "test_types"))) + (
    f", {_ALL} AS assertions, {_GOOD} AS assertions_passed, {sql_share(_GOOD, _ALL)} AS assertion_rate"
)


@query("results", sql=f"SELECT {SQL_COVERAGE} FROM results")
def coverage_stats(results: DataFrame) -> DataFrame:
    """Distinct endpoints, methods and types (missing counts as one), and assertion totals."""
    return results.agg(*_coverage())


@query("results", sql=f"SELECT session_id, {SQL_COVERAGE} FROM results GROUP BY session_id")
def session_coverage(results: DataFrame) -> DataFrame:
    """``coverage_stats`` of each session."""
    return results.groupBy("session_id").agg(*_coverage())


@query(
    "results",
    sql=f"""WITH s AS (SELECT {sql_share(SQL_PASSED, 'count(*)')} AS rate, count(*) FILTER (WHERE NOT coalesce(passed, false) AND test_type IN ('authentication', 'security', 'validation')) AS critical,
      count(*) FILTER (WHERE execution_time > 2 * (SELECT {_MEAN} FROM results)) AS slow, count(DISTINCT test_type) + max(CAST(test_type IS NULL AS INT)) AS kinds FROM results),
    e AS (SELECT {SQL_ERROR} AS error, count(*) AS n FROM results WHERE NOT coalesce(passed, false) GROUP BY 1 ORDER BY n DESC, error LIMIT 1),
    r AS (SELECT [CASE WHEN rate < 70 THEN 'Critical: Pass rate is below 70%. Immediate investigation required.' WHEN rate < 90 THEN 'Warning: Pass rate is below 90%. Review failed tests and fix issues.' END,
      CASE WHEN critical > 0 THEN 'Critical: ' || critical || ' critical test failures detected (authentication/security/validation). Address immediately.' END,
      CASE WHEN slow > 5 THEN 'Performance: ' || slow || ' slow tests detected. Consider optimizing API or test implementation.' END,
      (SELECT 'Most common error: ''' || error || ''' (' || n || ' occurrences). Focus debugging efforts here.' FROM e),
      CASE WHEN kinds < 4 THEN 'Coverage: Limited test type diversity. Consider adding more edge case and security tests.' END] AS texts FROM s)
    SELECT i - 1 AS position, texts[i] AS recommendation FROM (SELECT list_filter(texts, lambda t: t IS NOT NULL) AS texts FROM r), range(1, 6) g(i) WHERE i <= len(texts)""",
)
def recommendations(results: DataFrame) -> DataFrame:
    """Advice by rule, in order: pass rate, critical failures, slow tests, most common error, diversity."""
    # The texts of the advice and the limits that they name.
    top = top_errors(results, 1).agg(F.first("error").alias("_error"), F.first("n").alias("_n"))
    mean = results.agg((exact_sum("execution_time") / F.count("execution_time")).alias("_mean"))
    total, passed = F.count(F.lit(1)), F.count_if(_passed())
    facts = results.join(F.broadcast(mean)).agg(
        share(passed, total).alias("rate"),
        F.count_if(~_passed() & F.col("test_type").isin(*CRITICAL)).alias("critical"),
        F.count_if(F.col("execution_time") > 2 * F.col("_mean")).alias("slow"),
        F.coalesce(_kinds("test_type"), F.lit(0)).alias("kinds"),
    )
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    rules = F.array(
        F.when(F.col("rate") < 70, "Critical: Pass rate is below 70%. Immediate investigation required.").when(F.col("rate") < 90, "Warning: Pass rate is below 90%. Review failed tests and fix issues."),
        F.when(F.col("critical") > 0, text("Critical: ", F.col("critical"), " critical test failures detected (authentication/security/validation). Address immediately.")),
        F.when(F.col("slow") > 5, text("Performance: ", F.col("slow"), " slow tests detected. Consider optimizing API or test implementation.")),
        F.when(F.col("_n") > 0, text("Most common error: '", F.col("_error"), "' (", F.col("_n"), " occurrences). Focus debugging efforts here.")),
        F.when(F.col("kinds") < 4, "Coverage: Limited test type diversity. Consider adding more edge case and security tests."),
    )
    return facts.join(F.broadcast(top)).select(F.posexplode(F.array_compact(rules)).alias("position", "recommendation"))


@query("results", sql="SELECT id, name, CASE WHEN coalesce(passed, false) THEN 'successful' ELSE 'failed' END AS outcome FROM results")
def split_outcomes(results: DataFrame) -> DataFrame:
    """Each result as successful (passed is true) or failed (false or missing)."""
    return results.select("id", "name", F.when(_passed(), "successful").otherwise("failed").alias("outcome"))


@query(
    "results",
    sql="""SELECT name AS description, endpoint, method, request_data AS input_data, CAST(expected_status AS VARCHAR) AS expected_behavior,
    CAST(actual_status AS VARCHAR) AS actual_behavior, true AS discovered FROM results WHERE test_type = 'edge_case'""",
)
def discovered_edge_cases(results: DataFrame) -> DataFrame:
    """Edge-case results as knowledge rows."""
    return results.where("test_type = 'edge_case'").select(
        F.col("name").alias("description"),
        "endpoint",
        "method",
        F.col("request_data").alias("input_data"),
        F.col("expected_status").cast("string").alias("expected_behavior"),
        F.col("actual_status").cast("string").alias("actual_behavior"),
        F.lit(True).alias("discovered"),
    )


@query(
    "results",
    sql="SELECT name AS test_name, endpoint, method, test_type, error, expected_status AS expected, actual_status AS actual, request_data AS test_data FROM results WHERE NOT coalesce(passed, false)",
)
def bug_patterns(results: DataFrame) -> DataFrame:
    """Failed results as bug patterns."""
    return results.where(~_passed()).select(
        F.col("name").alias("test_name"), "endpoint", "method", "test_type", "error", F.col("expected_status").alias("expected"), F.col("actual_status").alias("actual"), F.col("request_data").alias("test_data")
    )


@query(
    "results",
    sql="""SELECT 'success_' || name AS doc_id, 'test_case' AS type, 'Test: ' || name || chr(10) || 'Type: ' || coalesce(test_type, 'unknown') || chr(10) || 'Endpoint: ' || method || ' ' || coalesce(endpoint, '') || chr(10)
    || 'Input: ' || request_data || chr(10) || 'Assertions:' || chr(10) || array_to_string(list_transform(assertions, lambda a: '  - ' || a.assertion), chr(10)) AS content, endpoint, method FROM results WHERE coalesce(passed, false)""",
)
def success_documents(results: DataFrame) -> DataFrame:
    """Passed results as documents for the retrieval corpus."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    content = F.concat_ws(
        "\n",
        line("Test", F.col("name")),
        line("Type", F.coalesce("test_type", F.lit("unknown"))),
        line("Endpoint", F.concat_ws(" ", "method", F.coalesce("endpoint", F.lit("")))),
        line("Input", F.col("request_data")),
        F.when(F.size("assertions") > 0, F.concat(F.lit("Assertions:\n"), F.array_join(F.transform("assertions", lambda a: F.concat(F.lit("  - "), a["assertion"])), "\n"))),
    )
    return results.where(_passed()).select(F.concat(F.lit("success_"), "name").alias("doc_id"), F.lit("test_case").alias("type"), content.alias("content"), "endpoint", "method")


_BUG = "NOT coalesce(passed, false) AND test_type IN ('security', 'validation')"
_SCENARIOS = "count(DISTINCT (coalesce(endpoint, chr(0)), coalesce(method, chr(0)), coalesce(test_type, chr(0))))"


@query(
    "results",
    sql=f"""SELECT {SQL_OUTCOMES}, count(*) FILTER (WHERE {_BUG}) AS bugs_found, count(*) FILTER (WHERE test_type IN ('edge_case', 'boundary')) AS edge_cases_covered,
    {_SCENARIOS} AS unique_scenarios, count(*) FILTER (WHERE error <> '') AS api_errors FROM results""",
)
def feedback_metrics(results: DataFrame) -> DataFrame:
    """What a feedback round counts: outcomes, bugs, edge cases, scenarios, errors."""
    return results.agg(*_outcomes(), *_signals())


def _signals() -> list[Column]:
    known = lambda c: F.coalesce(c, F.lit("\0"))
    return [
        F.count_if(~_passed() & F.col("test_type").isin(*BUG_TYPES)).alias("bugs_found"),
        F.count_if(F.col("test_type").isin(*EDGE_TYPES)).alias("edge_cases_covered"),
        F.count_distinct(F.struct(known("endpoint"), known("method"), known("test_type"))).alias("unique_scenarios"),
        F.count_if(F.col("error") != "").alias("api_errors"),
    ]


@query("results", sql="SELECT coalesce(test_type, 'unknown') AS test_type, count(*) AS n FROM results GROUP BY 1 ORDER BY n DESC, test_type")
def test_type_distribution(results: DataFrame) -> DataFrame:
    """Results per type, most frequent first."""
    return results.groupBy(F.coalesce("test_type", F.lit("unknown")).alias("test_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "test_type")


@query(
    "results",
    sql="""WITH f AS (SELECT coalesce(test_type, 'unknown') AS test_type, name || ': ' || coalesce(error, 'Unknown error') AS line, row_number() OVER (PARTITION BY coalesce(test_type, 'unknown') ORDER BY id) AS n
      FROM results WHERE NOT coalesce(passed, false))
    SELECT test_type, count(*) AS failures, array_to_string(list(line ORDER BY n) FILTER (WHERE n <= 2), chr(10)) AS examples FROM f GROUP BY 1""",
)
def failure_digest(results: DataFrame, examples: int = 2) -> DataFrame:
    """Failures per type, with the lines of the first few by id; only those few are ever collected."""
    kind = F.coalesce("test_type", F.lit("unknown")).alias("test_type")
    failed = results.where(~_passed()).select(kind, "id", F.concat("name", F.lit(": "), F.coalesce("error", F.lit("Unknown error"))).alias("line"))
    first = failed.withColumn("_n", F.row_number().over(Window.partitionBy("test_type").orderBy("id"))).where(F.col("_n") <= examples)
    first = first.groupBy("test_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias("examples"))
    return failed.groupBy("test_type").agg(F.count(F.lit(1)).alias("failures")).join(first, "test_type")


@query("results", sql=f"SELECT count(*) AS generated, count(*) FILTER (WHERE status <> 'skipped') AS executed, {SQL_PASSED} AS passed, {sql_share(SQL_PASSED, 'count(*)')} AS pass_rate FROM results")
def outcome_by_stage(results: DataFrame) -> DataFrame:
    """Counts of the pipeline's stages: generated, executed, passed."""
    total, passed = F.count(F.lit(1)), F.count_if(_passed())
    return results.agg(total.alias("generated"), F.count_if(F.col("status") != "skipped").alias("executed"), passed.alias("passed"), share(passed, total).alias("pass_rate"))


SQL_SEVERITY = """CASE WHEN test_type IN ('authentication', 'security') THEN 'critical' WHEN test_type IN ('validation', 'error_handling') THEN 'major'
 WHEN test_type IN ('boundary', 'edge_case') THEN 'normal' ELSE 'minor' END"""


def severity(test_type: Column) -> Column:
    return (
        F.when(test_type.isin("authentication", "security"), "critical")
        .when(test_type.isin("validation", "error_handling"), "major")
        .when(test_type.isin("boundary", "edge_case"), "normal")
        .otherwise("minor")
    )


def _priority(kind: Column) -> Column:
    return F.when(~_passed() & (kind == "critical"), "high").when(~_passed() & (kind == "major"), "medium").otherwise("low")


SQL_PRIORITY = f"CASE WHEN NOT coalesce(passed, false) AND {SQL_SEVERITY} = 'critical' THEN 'high' WHEN NOT coalesce(passed, false) AND {SQL_SEVERITY} = 'major' THEN 'medium' ELSE 'low' END"


@query("results", sql=f"SELECT id, {SQL_SEVERITY} AS severity, {SQL_PRIORITY} AS priority FROM results")
def severity_priority(results: DataFrame) -> DataFrame:
    """Severity by type; priority by severity of what failed."""
    kind = severity(F.col("test_type"))
    return results.select("id", kind.alias("severity"), _priority(kind).alias("priority"))


@query(
    "results",
    sql=f"SELECT id, coalesce(name, 'Unnamed Test') AS title, CASE WHEN coalesce(passed, false) THEN 'PASSED' ELSE 'FAILED' END AS status, test_type, endpoint, method, {SQL_SEVERITY} AS severity, {SQL_PRIORITY} AS priority, execution_time, coalesce(error, '') AS error FROM results",
)
def report_rows(results: DataFrame) -> DataFrame:
    """One formatted row per result, for reports and exports."""
    kind = severity(F.col("test_type"))
    return results.select(
        "id",
        F.coalesce("name", F.lit("Unnamed Test")).alias("title"),
        F.when(_passed(), "PASSED").otherwise("FAILED").alias("status"),
        "test_type",
        "endpoint",
        "method",
        kind.alias("severity"),
        _priority(kind).alias("priority"),
        "execution_time",
        F.coalesce("error", F.lit("")).alias("error"),
    )


_DATA = "regexp_replace(request_data, '[{}\" ]', '', 'g')"


@query(
    "results",
    sql=f"""SELECT id, array_to_string(list_filter(['API endpoint ' || coalesce(endpoint, 'N/A') || ' is available', CASE WHEN coalesce(test_type, '') <> 'authentication' THEN 'Valid authentication token is available' END, 'Test data is prepared and valid'], lambda x: x IS NOT NULL), chr(10)) AS preconditions,
      array_to_string(list_concat(['Setup test environment', 'Prepare test data: ' || replace({_DATA}, ':', '='), 'Send ' || method || ' request to ' || coalesce(endpoint, 'endpoint')],
      list_concat(list_transform(assertions, lambda a: 'Validate: ' || a.assertion), ['Clean up test data'])), chr(10)) AS steps FROM results""",
)
def report_steps(results: DataFrame, shown: int = 3) -> DataFrame:
    """Preconditions and steps of a report row: set up, data (the first fields), request, one check per assertion, clean up."""
    data = F.from_json("request_data", "map<string,string>")
    fields = F.array_join(F.slice(F.transform(F.map_entries(data), lambda e: F.concat(e["key"], F.lit("="), e["value"])), 1, shown), ", ")
    needs = F.array(
        F.concat(F.lit("API endpoint "), F.coalesce("endpoint", F.lit("N/A")), F.lit(" is available")),
        F.when(F.coalesce("test_type", F.lit("")) != "authentication", "Valid authentication token is available"),
        F.when(F.size(data) > 0, "Test data is prepared and valid"),
    )
    head = F.array(
        F.lit("Setup test environment"),
        F.when(F.size(data) > 0, F.concat(F.lit("Prepare test data: "), fields)),
        F.concat(F.lit("Send "), F.coalesce("method", F.lit("HTTP")), F.lit(" request to "), F.coalesce("endpoint", F.lit("endpoint"))),
    )
    checks = F.transform("assertions", lambda a: F.concat(F.lit("Validate: "), a["assertion"]))
    return results.select(
        "id",
        F.array_join(F.array_compact(needs), "\n").alias("preconditions"),
        F.array_join(F.concat(F.array_compact(head), checks, F.array(F.lit("Clean up test data"))), "\n").alias("steps"),
    )


_HALF = "ts < TIMESTAMP '2024-01-16 00:00:00'"


@query(
    "results",
    sql=f"""WITH c AS (SELECT endpoint, count(*) FILTER (WHERE coalesce(passed, false)) / CAST(count(*) AS DOUBLE) AS rate FROM results WHERE NOT ({_HALF}) GROUP BY 1),
    h AS (SELECT endpoint, count(*) FILTER (WHERE coalesce(passed, false)) / CAST(count(*) AS DOUBLE) AS rate FROM results WHERE {_HALF} GROUP BY 1)
    SELECT c.endpoint, c.rate AS current_rate, h.rate AS historical_rate, coalesce(abs(c.rate - h.rate) > 0.2, false) AS drifted FROM c LEFT JOIN h ON c.endpoint IS NOT DISTINCT FROM h.endpoint""",
    name="drift_flag",
    prepare=lambda r: (r.where(f"NOT ({_HALF})"), r.where(_HALF)),
)
def drift_flag(current: DataFrame, history: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Pass rate per endpoint against an earlier period; drifted if they differ by more than the threshold. No history: not drifted."""
    return drift_join(current, history).withColumn("drifted", F.coalesce(F.abs(F.col("current_rate") - F.col("historical_rate")) > threshold, F.lit(False)))


@query(
    "results",
    sql=f"""WITH c AS (SELECT endpoint, count(*) FILTER (WHERE coalesce(passed, false)) / CAST(count(*) AS DOUBLE) AS rate FROM results WHERE NOT ({_HALF}) GROUP BY 1),
    h AS (SELECT endpoint, count(*) FILTER (WHERE coalesce(passed, false)) / CAST(count(*) AS DOUBLE) AS rate FROM results WHERE {_HALF} GROUP BY 1)
    SELECT c.endpoint, c.rate AS current_rate, h.rate AS historical_rate FROM c LEFT JOIN h ON c.endpoint IS NOT DISTINCT FROM h.endpoint""",
    prepare=lambda r: (r.where(f"NOT ({_HALF})"), r.where(_HALF)),
)
def drift_join(current: DataFrame, history: DataFrame) -> DataFrame:
    """Current and historical pass rate of each endpoint."""
    rate = lambda df, name: df.groupBy("endpoint").agg((F.count_if(_passed()) / F.count(F.lit(1)).cast("double")).alias(name))
    old = rate(history, "historical_rate").withColumnRenamed("endpoint", "_endpoint")
    return rate(current, "current_rate").join(old, F.col("endpoint").eqNullSafe(F.col("_endpoint")), "left").drop("_endpoint")
