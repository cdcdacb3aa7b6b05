"""Test and agent metrics: summaries, breakdowns and the comprehensive report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.numbers import exact_sum, mean2, round2, share, sql_mean2, sql_round2, sql_share, sql_sum
from qaspark.registry import query

def _all() -> Column:
    return F.count(F.lit(1))



def _n(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def _sql_n(status: str) -> str:
    return f"count(*) FILTER (WHERE status = '{status}')"


SQL_TIMES = f"{sql_mean2('execution_time')} AS avg_execution_time, {sql_mean2('response_time')} AS avg_response_time, coalesce({sql_round2(sql_sum('execution_time'))}, 0.0) AS total_execution_time"


@query(
    "results",
    sql=f"""SELECT count(*) AS total, {_sql_n('passed')} AS passed, {_sql_n('failed')} AS failed, {_sql_n('error')} AS errors, {_sql_n('skipped')} AS skipped, {sql_share(_sql_n('passed'), 'count(*)')} AS pass_rate, {SQL_TIMES} FROM results""",
)
def test_metric_summary(metrics: DataFrame) -> DataFrame:
    """Totals by status, pass rate and times."""
    run, answer = exact_sum("execution_time"), exact_sum("response_time")
    return metrics.agg(
        _all().alias("total"),
        _n("passed").alias("passed"),
        _n("failed").alias("failed"),
        _n("error").alias("errors"),
        _n("skipped").alias("skipped"),
        share(_n("passed"), _all()).alias("pass_rate"),
        mean2(run, _all()).alias("avg_execution_time"),
        mean2(answer, _all()).alias("avg_response_time"),
        F.coalesce(round2(run), F.lit(0.0)).alias("total_execution_time"),
    )


_OK = "count(*) FILTER (WHERE success)"
SQL_AGENT = f"""count(*) AS executions, {_OK} AS successful, count(*) - {_OK} AS failed, {sql_share(_OK, 'count(*)')} AS success_rate, coalesce(CAST(sum(tokens_used) AS BIGINT), 0) AS tokens,
 coalesce(CAST(sum(api_calls) AS BIGINT), 0) AS api_calls, {sql_mean2('execution_time')} AS avg_execution_time, coalesce({sql_round2(sql_sum('execution_time'))}, 0.0) AS total_execution_time"""


def _agent() -> list[Column]:
    good, run = F.count_if("success"), exact_sum("execution_time")
    return [
        _all().alias("executions"),
        good.alias("successful"),
        (_all() - good).alias("failed"),
        share(good, _all()).alias("success_rate"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("api_calls"), F.lit(0)).alias("api_calls"),
        mean2(run, _all()).alias("avg_execution_time"),
        F.coalesce(round2(run), F.lit(0.0)).alias("total_execution_time"),
    ]


@query("agent_metrics", sql=f"SELECT {SQL_AGENT} FROM agent_metrics")
def agent_metric_summary(agents: DataFrame) -> DataFrame:
    """Totals over all agent executions."""
    return agents.agg(*_agent())


_PER_RUN = [f"{sql_round2(f'CAST(sum({c}) AS DOUBLE) / count(*)')} AS avg_{c.removesuffix('_used')}" for c in ("tokens_used", "api_calls")]


@query("agent_metrics", sql=f"SELECT agent_type, {SQL_AGENT}, {', '.join(_PER_RUN)} FROM agent_metrics GROUP BY 1")
def agent_type_breakdown(agents: DataFrame) -> DataFrame:
    """Totals per agent type, and the mean tokens and calls of an execution."""
    each = [round2(F.coalesce(F.sum(c), F.lit(0)).cast("double") / _all()).alias(f"avg_{c.removesuffix('_used')}") for c in ("tokens_used", "api_calls")]
    return agents.groupBy("agent_type").agg(*_agent(), *each)


SQL_KEY = "method || ':' || coalesce(endpoint, 'unknown')"
SQL_ENDPOINT = f"""SELECT {SQL_KEY} AS endpoint_key, count(*) AS total, {_sql_n('passed')} AS success, count(*) - {_sql_n('passed')} AS failed, {sql_share(_sql_n('passed'), 'count(*)')} AS success_rate,
 {sql_mean2('response_time')} AS avg_response_time, {sql_round2('min(response_time)')} AS min_response_time, {sql_round2('max(response_time)')} AS max_response_time FROM results GROUP BY 1"""


def endpoint_key() -> Column:
    return F.concat_ws(":", "method", F.coalesce("endpoint", F.lit("unknown")))


@query("results", sql=SQL_ENDPOINT)
def endpoint_statistics(metrics: DataFrame) -> DataFrame:
    """Requests and response times of each METHOD:endpoint."""
    time = exact_sum("response_time")
    return metrics.groupBy(endpoint_key().alias("endpoint_key")).agg(
        _all().alias("total"),
        _n("passed").alias("success"),
        (_all() - _n("passed")).alias("failed"),
        share(_n("passed"), _all()).alias("success_rate"),
        mean2(time, _all()).alias("avg_response_time"),
        round2(F.min("response_time")).alias("min_response_time"),
        round2(F.max("response_time")).alias("max_response_time"),
    )


@query("results", sql=f"SELECT {SQL_KEY} AS endpoint_key, actual_status AS status_code, count(*) AS n FROM results WHERE actual_status <> 0 GROUP BY 1, 2")
def status_code_histogram(metrics: DataFrame) -> DataFrame:
    """Counts of each status code per endpoint; 0 and missing codes are left out."""
    return metrics.where("actual_status <> 0").groupBy(endpoint_key().alias("endpoint_key"), F.col("actual_status").alias("status_code")).agg(_all().alias("n"))


@query(
    "results",
    sql=f"""SELECT coalesce(test_type, 'unknown') AS test_type, count(*) AS total, {_sql_n('passed')} AS passed, {_sql_n('failed')} AS failed, {_sql_n('error')} AS errors,
    {sql_share(_sql_n('passed'), 'count(*)')} AS pass_rate, {sql_mean2('execution_time')} AS avg_execution_time FROM results GROUP BY 1""",
)
def test_type_breakdown(metrics: DataFrame) -> DataFrame:
    """Statuses and times per test type; skipped ones only count in the total."""
    return metrics.groupBy(F.coalesce("test_type", F.lit("unknown")).alias("test_type")).agg(
        _all().alias("total"), _n("passed").alias("passed"), _n("failed").alias("failed"), _n("error").alias("errors"), share(_n("passed"), _all()).alias("pass_rate"), mean2(exact_sum("execution_time"), _all()).alias("avg_execution_time")
    )


TEST_VALUES = ("total", "passed", "failed", "errors", "skipped", "pass_rate", "avg_execution_time", "avg_response_time", "total_execution_time", "min_response_time", "max_response_time")
AGENT_VALUES = ("executions", "successful", "failed", "success_rate", "tokens", "api_calls", "avg_execution_time", "total_execution_time")


def _sql_tests(failed: str) -> str:
    return f"""count(*) AS total, {_sql_n('passed')} AS passed, {failed} AS failed, {_sql_n('error')} AS errors, {_sql_n('skipped')} AS skipped, {sql_share(_sql_n('passed'), 'count(*)')} AS pass_rate, {SQL_TIMES},
    {sql_round2('min(response_time)')} AS min_response_time, {sql_round2('max(response_time)')} AS max_response_time"""


def _sql_long(table: str, values: tuple[str, ...]) -> str:
    doubles = ", ".join(f"CAST({v} AS DOUBLE) AS {v}" for v in values)
    return f"SELECT section, key, metric, value FROM (SELECT section, key, {doubles} FROM {table}) UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(values)}))"


SQL_REPORT = f"""WITH t AS (SELECT 'tests' AS section, '' AS key, {_sql_tests(_sql_n('failed'))} FROM results
    UNION ALL SELECT 'test_types', coalesce(test_type, 'unknown'), {_sql_tests(_sql_n('failed'))} FROM results GROUP BY 2
    UNION ALL SELECT 'endpoints', {SQL_KEY}, {_sql_tests(f"count(*) - {_sql_n('passed')}")} FROM results GROUP BY 2),
    a AS (SELECT 'all_agents' AS section, '' AS key, {SQL_AGENT} FROM agent_metrics UNION ALL SELECT 'agents', agent_type, {SQL_AGENT} FROM agent_metrics GROUP BY 2)
    {_sql_long('t', TEST_VALUES)} UNION ALL {_sql_long('a', AGENT_VALUES)}
    UNION ALL SELECT 'status_codes', {SQL_KEY} || ' ' || actual_status, 'total', CAST(count(*) AS DOUBLE) FROM results WHERE actual_status <> 0 GROUP BY 2"""


def _long(rows: DataFrame, values: tuple[str, ...]) -> DataFrame:
    return rows.select("section", "key", *[F.col(v).cast("double").alias(v) for v in values]).unpivot(["section", "key"], list(values), "metric", "value")


@query("results", "agent_metrics", sql=SQL_REPORT)
def comprehensive_report(metrics: DataFrame, agents: DataFrame) -> DataFrame:
    """Long form (section, key, metric, value): all tests, test types, endpoints and their status codes, all agents and their types.

    Each table is read once, by grouping sets. Of an endpoint, all that did not pass counts as failed, as in its statistics.
    """
    rows = metrics.select(F.coalesce("test_type", F.lit("unknown")).alias("kind"), endpoint_key().alias("endpoint"), F.col("actual_status").alias("code"), "status", "execution_time", "response_time")
    run, answer = exact_sum("execution_time"), exact_sum("response_time")
    sets = rows.groupingSets([[], ["kind"], ["endpoint"], ["endpoint", "code"]], "kind", "endpoint", "code").agg(
        F.grouping_id().alias("g"),
        _all().alias("total"),
        _n("passed").alias("passed"),
        _n("failed").alias("failed"),
        _n("error").alias("errors"),
        _n("skipped").alias("skipped"),
        share(_n("passed"), _all()).alias("pass_rate"),
        mean2(run, _all()).alias("avg_execution_time"),
        mean2(answer, _all()).alias("avg_response_time"),
        F.coalesce(round2(run), F.lit(0.0)).alias("total_execution_time"),
        round2(F.min("response_time")).alias("min_response_time"),
        round2(F.max("response_time")).alias("max_response_time"),
    )
    section = F.when(F.col("g") == 7, "tests").when(F.col("g") == 3, "test_types").when(F.col("g") == 5, "endpoints").otherwise("status_codes")
    key = F.when(F.col("g") == 4, F.concat_ws(" ", "endpoint", F.col("code").cast("string"))).otherwise(F.coalesce("kind", "endpoint", F.lit("")))
    failed = F.when(F.col("g") == 5, F.col("total") - F.col("passed")).otherwise(F.col("failed"))
    sets = sets.where("g <> 4 or code <> 0").select(section.alias("section"), key.alias("key"), *[failed.alias(v) if v == "failed" else v for v in TEST_VALUES])
    tests = _long(sets, TEST_VALUES).where("section <> 'status_codes' or metric = 'total'")
    kinds = agents.groupingSets([[], ["agent_type"]], "agent_type").agg(F.grouping_id().alias("g"), *_agent())
    whole = F.col("g") == 1
    kinds = kinds.select(F.when(whole, "all_agents").otherwise("agents").alias("section"), F.when(whole, "").otherwise(F.col("agent_type")).alias("key"), *AGENT_VALUES)
    return tests.union(_long(kinds, AGENT_VALUES))
