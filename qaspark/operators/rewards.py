"""Rewards, experience buffers, rankings and features of reinforcement learning over test results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions.numbers import exact_sum
from qaspark.functions.scans import with_previous, with_recurrence, with_sliding_max
from qaspark.functions.tables import numbered, stored, with_group_values
from qaspark.operators.results import _signals
from qaspark.registry import query

# Reward weights, action types, discount factors.
WEIGHTS = {"bugs_found": 10.0, "code_coverage": 5.0, "edge_cases_covered": 8.0, "unique_scenarios": 6.0, "false_positives": -3.0, "redundant_tests": -2.0, "test_failures": -1.0, "api_errors": -5.0}
ACTIONS = ("happy_path", "boundary_value", "null_empty", "type_mismatch", "format_violation", "business_logic", "security_test", "concurrent_access", "state_transition", "integration_test")
TEST_TYPES = ("happy_path", "validation", "authentication", "security", "edge_case", "boundary", "functional", "integration", "performance", "other")
GAMMA, LAMBDA = 0.99, 0.95
BUFFER = 10_000
PRIORITY_POWER, EPSILON = 0.6, 1e-6

_SIGNATURE = "coalesce(endpoint, '') || '_' || coalesce(method, '') || '_' || coalesce(test_type, '') || '_' || coalesce(request_data, '')"


def signature() -> Column:
    return F.concat_ws("_", *[F.coalesce(c, F.lit("")) for c in ("endpoint", "method", "test_type", "request_data")])


@query("results", sql="SELECT count(DISTINCT (coalesce(endpoint, ''), coalesce(method, ''), coalesce(test_type, ''), coalesce(array_to_string(list_sort(json_keys(request_data)), ','), ''))) AS unique_scenarios FROM results")
def unique_scenarios(results: DataFrame) -> DataFrame:
    """Distinct (endpoint, method, type, set of parameter names)."""
    keys = F.array_join(F.array_sort(F.json_object_keys("request_data")), ",")
    return results.select(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("endpoint", "method", "test_type")], F.coalesce(keys, F.lit("")).alias("keys")).alias("s")).agg(F.count_distinct("s").alias("unique_scenarios"))


@query("results", sql=f"SELECT count(*) - count(DISTINCT {_SIGNATURE}) AS redundant_tests FROM results")
def redundant_tests(results: DataFrame) -> DataFrame:
    """How many results repeat the signature of another."""
    return results.agg((F.count(F.lit(1)) - F.count_distinct(signature())).alias("redundant_tests"))


@query("results", sql=f"SELECT id, row_number() OVER (PARTITION BY {_SIGNATURE} ORDER BY ts, id) > 1 AS redundant FROM results")
def flag_redundant(results: DataFrame) -> DataFrame:
    """Marks all but the first result of each signature, by time and id.

    The first of a signature is found by aggregation and joined back, so a hot signature is never sorted in one task.
    """
    keyed = results.select("id", "ts", F.xxhash64(signature()).alias("_h"), signature().alias("_s"))
    first = keyed.groupBy("_h", "_s").agg(F.min(F.struct("ts", "id")).alias("_first"))
    return keyed.join(first, ["_h", "_s"]).select("id", (F.struct("ts", "id") != F.col("_first")).alias("redundant"))


_BUG = "NOT coalesce(passed, false) AND test_type IN ('security', 'validation')"


_RAW = "greatest(-100.0, least(100.0, 10.0 * bugs + 5.0 * cover + 8.0 * edges + 6.0 * kinds - 3.0 * alarms - 2.0 * repeats - 1.0 * fails - 5.0 * errors))"


def _supplied(results: DataFrame) -> DataFrame:
    return results.groupBy("session_id").agg(*[F.count_if(F.col("k") % 10 == i).alias(c) for i, c in enumerate(("code_coverage", "false_positives", "test_failures"))])


@query(
    "results",
    prepare=lambda r: (r, None, _supplied(r.where("session_id % 2 = 0"))),
    sql=f"""WITH m AS (SELECT session_id, count(*) FILTER (WHERE {_BUG}) AS bugs, count(*) FILTER (WHERE test_type IN ('edge_case', 'boundary')) AS edges,
      count(DISTINCT (coalesce(endpoint, chr(0)), coalesce(method, chr(0)), coalesce(test_type, chr(0)))) AS kinds, count(*) - count(DISTINCT {_SIGNATURE}) AS repeats, count(*) FILTER (WHERE error <> '') AS errors,
      count(*) FILTER (WHERE k % 10 = 0 AND session_id % 2 = 0) AS cover, count(*) FILTER (WHERE k % 10 = 1 AND session_id % 2 = 0) AS alarms, count(*) FILTER (WHERE k % 10 = 2 AND session_id % 2 = 0) AS fails FROM results GROUP BY 1)
    SELECT session_id, CAST({_RAW} AS DOUBLE) AS raw, round(2 / (1 + exp(-{_RAW} / 10)) - 1, 9) AS reward FROM m""",
)
def session_reward(results: DataFrame, weights: dict[str, float] | None = None, supplied: DataFrame | None = None) -> DataFrame:
    """Weighted reward of each session, clipped to 100 either way, and scaled to (-1, 1). Weights are a parameter.

    ``supplied`` may give further signals of sessions (code_coverage, false_positives, test_failures; one row a session); they count
    0 where it does not.
    """
    w = weights or WEIGHTS
    signals = results.groupBy("session_id").agg(*_signals(), (F.count(F.lit(1)) - F.count_distinct(signature())).alias("redundant_tests"))
    names = ["bugs_found", "edge_cases_covered", "unique_scenarios", "redundant_tests", "api_errors"]
    if supplied is not None:
        more = [c for c in ("code_coverage", "false_positives", "test_failures") if c in supplied.columns]
        signals = signals.join(supplied.select("session_id", *more), "session_id", "left")
        names += more
    raw = sum((F.coalesce(c, F.lit(0)) * w[c] for c in names), F.lit(0.0))
    raw = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), raw))
    return signals.select("session_id", raw.alias("raw"), F.round(2 / (1 + F.exp(-raw / 10)) - 1, 9).alias("reward"))


@query("agent_metrics", sql="SELECT agent_type, round(CAST(sum(tokens_used) AS DOUBLE) * 0.5 + CAST(sum(api_calls) AS DOUBLE) * -0.25, 6) AS reward FROM agent_metrics GROUP BY 1", prepare=lambda a: (a.groupBy("agent_type").agg(F.sum("tokens_used").cast("double").alias("tokens"), F.sum("api_calls").cast("double").alias("calls")).unpivot("agent_type", ["tokens", "calls"], "metric", "value"), {"tokens": 0.5, "calls": -0.25}))
def weighted_metric_reward(metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of metric times weight over the metrics that have a weight; ``metrics`` is long: agent_type, metric, value."""
    table = metrics.sparkSession.createDataFrame(list(weights.items()), "metric string, weight double")
    return metrics.join(F.broadcast(table), "metric").groupBy("agent_type").agg(F.round(F.sum(F.col("value") * F.col("weight")), 6).alias("reward"))


_TREND = """CASE WHEN count(*) FILTER (WHERE n <= 10) < 2 THEN 'stable' WHEN regr_slope(reward, -n) FILTER (WHERE n <= 10) > 0.1 THEN 'improving' WHEN regr_slope(reward, -n) FILTER (WHERE n <= 10) < -0.1 THEN 'declining' ELSE 'stable' END"""


@query("experiences", sql=f"WITH e AS (SELECT episode, reward, row_number() OVER (PARTITION BY episode ORDER BY step DESC) AS n FROM experiences) SELECT episode, {_TREND} AS trend FROM e GROUP BY 1")
def reward_trend(experiences: DataFrame, last: int = 10, slope: float = 0.1) -> DataFrame:
    """Direction of each series' last rewards by least squares."""
    n = F.row_number().over(Window.partitionBy("episode").orderBy(F.desc("step")))
    tail = experiences.select("episode", "reward", n.alias("n")).where(F.col("n") <= last)
    s = F.regr_slope("reward", -F.col("n"))
    return tail.groupBy("episode").agg(F.when(F.count(F.lit(1)) < 2, "stable").when(s > slope, "improving").when(s < -slope, "declining").otherwise("stable").alias("trend"))


@query(
    "experiences",
    sql=f"""WITH e AS (SELECT reward, row_number() OVER (ORDER BY id DESC) AS n FROM experiences), t AS (SELECT {_TREND} AS recent_trend FROM e)
    SELECT count(DISTINCT episode) AS episodes, round(CAST(sum(CAST(reward AS DECIMAL(28,6))) AS DOUBLE) / count(*), 6) AS mean, round(stddev_pop(reward), 6) AS std, max(reward) AS max, min(reward) AS min,
    (SELECT recent_trend FROM t) AS recent_trend FROM experiences""",
)
def reward_statistics(experiences: DataFrame, last: int = 10, slope: float = 0.1) -> DataFrame:
    """Mean, population deviation and range of all rewards, the number of episodes, and the trend of the last rewards by id."""
    every = experiences.agg(
        F.count_distinct("episode").alias("episodes"),
        F.round(exact_sum("reward") / F.count(F.lit(1)), 6).alias("mean"),
        F.round(F.stddev_pop("reward"), 6).alias("std"),
        F.max("reward").alias("max"),
        F.min("reward").alias("min"),
    )
    tail = experiences.select("id", "reward").orderBy(F.desc("id")).limit(last).agg(F.array_sort(F.collect_list(F.struct("id", "reward"))).alias("t"))
    s = F.regr_slope("t.reward", "n")
    trend = F.when(F.count("t") < 2, "stable").when(s > slope, "improving").when(s < -slope, "declining").otherwise("stable")
    return every.crossJoin(tail.select(F.posexplode_outer("t").alias("n", "t")).agg(trend.alias("recent_trend")))  # one row each


@query("experiences", sql="SELECT episode, step, coalesce(max(priority) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN 10000 PRECEDING AND 1 PRECEDING), 1.0) AS initial_priority FROM experiences")
def initial_priority(experiences: DataFrame, capacity: int = BUFFER) -> DataFrame:
    """Priority that a new experience gets: the largest so far in its buffer, 1 in an empty one.

    A sliding maximum over the last ``capacity`` experiences of an episode, by the maxima of blocks' starts and ends: an episode of any
    length is spread over many tasks, and each row is looked at twice.
    """
    rows = stored(numbered(stored(experiences.select("episode", "step", "priority")), ["episode"], ["step"], "n"))
    found = with_sliding_max(rows, ["episode"], "n", "priority", capacity, "_most")
    return found.select("episode", "step", F.coalesce("_most", F.lit(1.0)).alias("initial_priority"))


@query("experiences", sql="SELECT episode, step, reward FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY step DESC) AS n FROM experiences) WHERE n <= 20", prepare=lambda e: (e, 20))
def buffer_tail(experiences: DataFrame, capacity: int = BUFFER) -> DataFrame:
    """What a ring buffer of this size still holds of each episode."""
    n = F.row_number().over(Window.partitionBy("episode").orderBy(F.desc("step")))
    return experiences.withColumn("_n", n).where(F.col("_n") <= capacity).select("episode", "step", "reward")


@query(
    "experiences",
    sql=f"""WITH RECURSIVE v AS (SELECT episode, step, reward, value, coalesce(lead(value) OVER (PARTITION BY episode ORDER BY step), next_value) AS nv, CAST(done AS INT) AS done, row_number() OVER (PARTITION BY episode ORDER BY step DESC) AS back FROM experiences),
    d AS (SELECT episode, step, back, done, reward + {GAMMA} * nv * (1 - done) - value AS delta FROM v),
    a AS (SELECT episode, step, back, delta AS advantage FROM d WHERE back = 1 UNION ALL SELECT d.episode, d.step, d.back, d.delta + {GAMMA} * {LAMBDA} * (1 - d.done) * a.advantage FROM d JOIN a ON d.episode = a.episode AND d.back = a.back + 1),
    m AS (SELECT episode, avg(advantage) AS mean, coalesce(stddev_samp(advantage), 0) AS std FROM a GROUP BY 1)
    SELECT a.episode, a.step, round((a.advantage - m.mean) / (m.std + 1e-8), 5) AS advantage FROM a JOIN m USING (episode)""",
)
def gae_advantages(experiences: DataFrame, gamma: float = GAMMA, lam: float = LAMBDA) -> DataFrame:
    """Generalised advantage estimates of each episode, in step order, normalised by sample deviation.

    Backwards in steps, an advantage is a linear map of the one after it; the maps are composed by a segmented scan in blocks, so an
    episode of any length is spread over many tasks. A missing reward or value counts 0, a missing ``done`` as false.
    """
    filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("reward", "value", "next_value")]
    rows = experiences.select("episode", "step", *filled, F.coalesce("done", F.lit(False)).alias("done"))
    rows = stored(numbered(stored(rows), ["episode"], [F.desc("step")], "n"))
    rows = with_previous(rows, ["episode"], "n", "value", "_ahead")
    going = 1 - F.col("done").cast("int")
    delta = F.col("reward") + gamma * F.coalesce("_ahead", "next_value") * going - F.col("value")
    rows = stored(with_recurrence(rows, ["episode"], "n", gamma * lam * going, delta, "_raw").select("episode", "step", "_raw"))
    each = stored(rows.groupBy("episode").agg(F.avg("_raw").alias("_mean"), F.coalesce(F.stddev_samp("_raw"), F.lit(0.0)).alias("_spread"), F.count(F.lit(1)).alias("_n")))
    rows = with_group_values(rows, each, "episode", "_n")
    return rows.select("episode", "step", F.round((F.col("_raw") - F.col("_mean")) / (F.col("_spread") + 1e-8), 5).alias("advantage"))


_PROBS = {a: round(0.05 + 0.01 * i, 2) for i, a in enumerate(ACTIONS)}
_SQL_PROBS = ", ".join(f"({i}, '{a}', CAST({p} AS DOUBLE))" for i, (a, p) in enumerate(_PROBS.items()))
_SQL_SCORES = f"""WITH p(i, action, prob) AS (VALUES {_SQL_PROBS}), s AS (SELECT c.ordinal, c.test_type, coalesce(min(p.i), 0) AS i FROM test_cases c LEFT JOIN p ON contains(c.test_type, p.action) GROUP BY ALL)"""


def _scored(cases: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    first = F.lit(float(next(iter(probabilities.values()))))
    prob = F.coalesce(*[F.when(F.contains("test_type", F.lit(a)), F.lit(float(p))) for a, p in probabilities.items()], first)
    return cases.select("ordinal", "test_type", prob.alias("probability"))


@query("test_cases", sql=f"{_SQL_SCORES} SELECT s.ordinal, s.test_type, p.prob AS probability FROM s JOIN p USING (i)", prepare=lambda c: (c, _PROBS))
def test_scores_join(cases: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Probability of the first action whose name is part of the test type, else of the first action."""
    return _scored(cases, probabilities)


_SCORE = "round(p.prob * CASE WHEN contains(s.test_type, 'authentication') OR contains(s.test_type, 'validation') THEN 1.5 ELSE 1 END, 6)"


@query("test_cases", sql=f"{_SQL_SCORES} SELECT s.ordinal, s.test_type, {_SCORE} AS score FROM s JOIN p USING (i) ORDER BY score DESC, ordinal", prepare=lambda c: (c, _PROBS))
def rank_test_cases(cases: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Cases by descending score; authentication and validation weigh half as much again."""
    boosted = F.contains("test_type", F.lit("authentication")) | F.contains("test_type", F.lit("validation"))
    score = F.round(F.col("probability") * F.when(boosted, 1.5).otherwise(1.0), 6)
    return _scored(cases, probabilities).select("ordinal", "test_type", score.alias("score")).orderBy(F.desc("score"), "ordinal")


def uniform(id_: str, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed only: 13 hex digits of an md5."""
    return (F.conv(F.md5(F.concat(F.col(id_).cast("string"), F.lit(f":{seed}"))).substr(1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def _sql_uniform(id_: str, seed: int) -> str:
    return f"((CAST(('0x' || substr(md5(CAST({id_} AS VARCHAR) || ':{seed}'), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)"


@query("experiences", sql=f"SELECT id, priority FROM experiences ORDER BY round(-ln({_sql_uniform('id', 7)}) / pow(priority + 1e-6, 0.6), 9), id LIMIT 64")
def prioritized_sample(experiences: DataFrame, n: int = 64, seed: int = 7) -> DataFrame:
    """Weighted sample without replacement: smallest exponential clocks, rate (priority + 1e-6) ** 0.6."""
    clock = F.round(-F.ln(uniform("id", seed)) / F.pow(F.col("priority") + EPSILON, F.lit(PRIORITY_POWER)), 9)
    return experiences.orderBy(clock, "id").limit(n).select("id", "priority")


@query("experiences", sql=f"SELECT id, reward FROM experiences ORDER BY {_sql_uniform('id', 11)}, id LIMIT 64")
def uniform_sample(experiences: DataFrame, n: int = 64, seed: int = 11) -> DataFrame:
    """Sample without replacement, by hash of id and seed."""
    return experiences.orderBy(uniform("id", seed), "id").limit(n).select("id", "reward")


@query("experiences", sql="SELECT id, CASE WHEN id % 3 <> 0 THEN priority WHEN abs(td_error) + 1e-6 > 0 AND isfinite(td_error) THEN abs(td_error) + 1e-6 ELSE 1e-6 END AS priority FROM experiences", prepare=lambda e: (e, e.where("id % 3 = 0").select("id", "td_error")))
def update_priorities(experiences: DataFrame, errors: DataFrame) -> DataFrame:
    """New priority |td_error| + 1e-6 where an error is given; 1e-6 for one that is not finite."""
    new = F.abs(F.col("_error")) + EPSILON
    fine = ~F.isnan(new) & (new > 0) & (new < float("inf"))
    joined = experiences.select("id", "priority").join(errors.select("id", F.col("td_error").alias("_error"), F.lit(True).alias("_given")), "id", "left")
    return joined.select("id", F.when(F.col("_given").isNull(), F.col("priority")).when(fine, new).otherwise(EPSILON).alias("priority"))


#: Bins of the numbers from 0 to 1.
BINS = 65_536


def first_by_chance(rows: DataFrame, n: int) -> DataFrame:
    """The n rows (ordinal, _u) of least (_u, ordinal), in that order; ``_u`` is spread evenly over (0, 1).

    Rows are counted by bins: all bins before that of the n-th row are taken whole, and only that one is ranked by a single task. So
    n may be any share of the rows.
    """
    rows = stored(rows.withColumn("_bin", F.coalesce(F.floor(F.col("_u") * BINS), F.lit(-1))))
    left, border = n, None
    for bin_, count in sorted(map(tuple, rows.groupBy("_bin").count().collect())):  # at most BINS + 1 rows
        if count > left:
            border = bin_
            break
        left -= count
    if border is not None:
        rows = rows.where(F.col("_bin") < border).unionByName(rows.where(F.col("_bin") == border).orderBy("_u", "ordinal").limit(left))
    return rows.orderBy("_u", "ordinal").drop("_bin")


@query("test_cases", sql=f"SELECT ordinal FROM test_cases WHERE ordinal % 3 <> 0 ORDER BY {_sql_uniform('ordinal', 5)}, ordinal LIMIT (SELECT greatest(1, CAST(floor(0.2 * count(*)) AS BIGINT)) FROM test_cases WHERE ordinal % 3 = 0)", prepare=lambda c: (c, c.where("ordinal % 3 = 0")))
def exploration_tests(cases: DataFrame, selected: DataFrame, rate: float = 0.2, seed: int = 5) -> DataFrame:
    """Random unselected cases, a share of the selected ones' number, at least one."""
    n = max(1, int(rate * selected.count()))
    rest = cases.join(selected.select("ordinal"), "ordinal", "left_anti")
    return first_by_chance(rest.select("ordinal", uniform("ordinal", seed).alias("_u")), n).select("ordinal")


@query("test_cases", sql="SELECT c.ordinal FROM test_cases c WHERE EXISTS (SELECT 1 FROM test_cases t WHERE t.ordinal % 10 = 0 AND t.test_type IS NOT DISTINCT FROM c.test_type AND t.endpoint IS NOT DISTINCT FROM c.endpoint AND t.method IS NOT DISTINCT FROM c.method)", prepare=lambda c: (c, c.where("ordinal % 10 = 0")))
def redundant_actions(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed cases for which a case of the same type, endpoint and method exists; missing values are equal."""
    key = ("test_type", "endpoint", "method")
    there = existing.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = F.col("test_type").eqNullSafe(F.col("_test_type")) & F.col("endpoint").eqNullSafe(F.col("_endpoint")) & F.col("method").eqNullSafe(F.col("_method"))
    return proposed.join(there, same, "left_semi").select("ordinal")


@query("results", sql="SELECT id, CASE WHEN coalesce(passed, false) THEN 10.0 ELSE -5.0 END::DOUBLE AS training, CASE WHEN coalesce(passed, false) THEN 1.0 ELSE -0.5 END::DOUBLE AS pipeline FROM results")
def experience_reward(results: DataFrame) -> DataFrame:
    """Reward of a result under the training scheme and under the pipeline's."""
    good = F.coalesce("passed", F.lit(False))
    return results.select("id", F.when(good, 10.0).otherwise(-5.0).alias("training"), F.when(good, 1.0).otherwise(-0.5).alias("pipeline"))


@query("results", sql=f"SELECT id, coalesce(nullif(list_position({list(TEST_TYPES)}, test_type), 0) - 1, 9) AS action FROM results")
def action_index(results: DataFrame) -> DataFrame:
    """Number of the test type among the known ones; the last one for any other."""
    at = F.array_position(F.array(*[F.lit(a) for a in TEST_TYPES]), F.coalesce("test_type", F.lit(""))).cast("int")
    return results.select("id", F.when(at > 0, at - 1).otherwise(len(TEST_TYPES) - 1).alias("action"))


@query(
    "results",
    sql="SELECT id, CASE WHEN test_type IN ('edge_case', 'security', 'boundary') THEN 2.0 WHEN test_type IN ('validation', 'authentication') THEN 1.5 WHEN test_type = 'happy_path' THEN 1.0 ELSE 0.0 END + 3.0 * (k / 100.0)::DOUBLE - CASE WHEN k % 5 = 0 THEN 2.0 ELSE 0.0 END AS reward FROM results",
    prepare=lambda r: (r.withColumn("coverage", F.col("k") / 100.0).withColumn("redundant", F.col("k") % 5 == 0),),
)
def intermediate_reward(actions: DataFrame) -> DataFrame:
    """Reward of one action: by type, by coverage gained, less if redundant."""
    kind = F.when(F.col("test_type").isin("edge_case", "security", "boundary"), 2.0).when(F.col("test_type").isin("validation", "authentication"), 1.5).when(F.col("test_type") == "happy_path", 1.0).otherwise(0.0)
    return actions.select("id", (kind + 3.0 * F.col("coverage") - F.when(F.col("redundant"), 2.0).otherwise(0.0)).alias("reward"))


_SHARES = ", ".join(f"round(count(*) FILTER (WHERE test_type = '{a}') / count(*)::DOUBLE, 9)" for a in ACTIONS)


def _padded(parts: list[Column], size: int) -> Column:
    return F.concat(F.array(*parts), F.array_repeat(F.lit(0.0), size - len(parts)))


@query("results", sql=f"SELECT session_id, list_concat([{_SHARES}, count(*) / 100.0::DOUBLE, round(sum(len(assertions)) / (5.0 * count(*)), 9)]::DOUBLE[], list_transform(range(52), lambda x: 0.0::DOUBLE)) AS features FROM results GROUP BY 1")
def coverage_features(results: DataFrame, size: int = 64) -> DataFrame:
    """Feature vector of a session's coverage: share of each action type, size, assertions; padded with zeros."""
    n = F.count(F.lit(1))
    shares = [F.round(F.count_if(F.col("test_type") == a) / n.cast("double"), 9) for a in ACTIONS]
    return results.groupBy("session_id").agg(_padded([*shares, n / 100.0, F.round(F.sum(F.size("assertions")) / (5.0 * n), 9)], size).alias("features"))


@query("results", sql="SELECT session_id, list_concat([round((count(DISTINCT test_type) + max(CAST(test_type IS NULL AS INT))) / 10.0, 9), round(sum(len(assertions)) / CAST(count(*) AS DOUBLE) / 10.0, 9), round(sum(CASE test_type WHEN 'authentication' THEN 10 WHEN 'validation' THEN 8 WHEN 'happy_path' THEN 6 ELSE 5 END) / 10.0 / count(*), 9)]::DOUBLE[], list_transform(range(125), lambda x: 0.0::DOUBLE)) AS features FROM results GROUP BY 1")
def suite_features(results: DataFrame, size: int = 128) -> DataFrame:
    """Feature vector of a suite: diversity (a missing type counts), mean assertions, mean priority; padded with zeros."""
    weight = F.when(F.col("test_type") == "authentication", 10).when(F.col("test_type") == "validation", 8).when(F.col("test_type") == "happy_path", 6).otherwise(5)
    n = F.count(F.lit(1)).cast("double")
    kinds = F.count_distinct("test_type") + F.max(F.col("test_type").isNull().cast("int"))
    parts = [F.round(kinds / 10.0, 9), F.round(F.sum(F.size("assertions")) / n / 10.0, 9), F.round(F.sum(weight) / 10.0 / n, 9)]
    return results.groupBy("session_id").agg(_padded(parts, size).alias("features"))


_TYPES4 = ("happy_path", "validation", "edge_case", "security")
_SQL_ONE_HOT = ", ".join([*(f"CASE WHEN coalesce(test_type, '') = '{t}' THEN 1.0 ELSE 0.0 END" for t in _TYPES4), "CASE WHEN method = 'GET' THEN 1.0 ELSE 0.0 END", "CASE WHEN method = 'POST' THEN 1.0 ELSE 0.0 END", "CASE WHEN passed THEN 1.0 ELSE 0.0 END"])


@query("results", sql=f"SELECT id, list_concat([{_SQL_ONE_HOT}]::DOUBLE[], list_transform(range(633), lambda x: 0.0::DOUBLE)) AS state FROM results")
def result_state_vector(results: DataFrame, size: int = 640) -> DataFrame:
    """0/1 vector of the test type, the method and the outcome, padded with zeros."""
    flags = [*(F.col("test_type") == t for t in _TYPES4), F.col("method") == "GET", F.col("method") == "POST", F.col("passed")]
    return results.select("id", _padded([F.when(f, 1.0).otherwise(0.0) for f in flags], size).alias("state"))
