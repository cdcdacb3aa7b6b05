"""The library's domain tables, derived from the given parquet tables.

Each adapter is one SELECT that Spark and DuckDB both run; the few places where their dialects differ are named fragments.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.functions.tables import numbered, stored, with_group_values

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Fragment -> (Spark, DuckDB).
DIALECT = {
    "K": ("CAST(get_json_object(props, '$.k') AS INT)", "CAST(json_extract_string(props, '$.k') AS INT)"),
    "ASSERTIONS": (
        "transform(sequence(1, 1 + k % 3), i -> named_struct('type', 'status', 'assertion', concat('check ', i), 'passed', (k + i) % 4 <> 0))",
        "list_transform(range(1, 2 + k % 3), lambda i: {'type': 'status', 'assertion': 'check ' || i, 'passed': (k + i) % 4 <> 0})",
    ),
    "STEPS": (
        "array(named_struct('action', concat('Open the form ', source), 'expected_result', 'Form is shown', 'data', ''), named_struct('action', concat(CASE doc_id % 4 WHEN 0 THEN 'Send a get request to ' WHEN 1 THEN 'POST /api/v1/items' WHEN 2 THEN 'DELETE /api/users/{id}' ELSE 'Check ' END, ''), 'expected_result', CASE doc_id % 3 WHEN 0 THEN 'Status 404 is returned' WHEN 1 THEN 'Code 201' ELSE 'Works' END, 'data', concat('row ', doc_id)))",
        "[{'action': 'Open the form ' || source, 'expected_result': 'Form is shown', 'data': ''}, {'action': CASE doc_id % 4 WHEN 0 THEN 'Send a get request to ' WHEN 1 THEN 'POST /api/v1/items' WHEN 2 THEN 'DELETE /api/users/{id}' ELSE 'Check ' END, 'expected_result': CASE doc_id % 3 WHEN 0 THEN 'Status 404 is returned' WHEN 1 THEN 'Code 201' ELSE 'Works' END, 'data': 'row ' || doc_id}]",
    ),
    "TAGS": ("array('smoke', concat('t', doc_id % 3))", "['smoke', 't' || (doc_id % 3)]"),
    "PARAMS": (
        "array(named_struct('name', 'id', 'type', 'int', 'source', 'route', 'required', true), named_struct('name', 'page', 'type', CASE page_id % 3 WHEN 0 THEN 'List<string>' ELSE 'bool?' END, 'source', CASE page_id % 5 WHEN 0 THEN 'query' WHEN 1 THEN 'body' WHEN 2 THEN 'header' WHEN 3 THEN 'form' END, 'required', page_id % 2 = 0))",
        "[{'name': 'id', 'type': 'int', 'source': 'route', 'required': true}, {'name': 'page', 'type': CASE page_id % 3 WHEN 0 THEN 'List<string>' ELSE 'bool?' END, 'source': CASE page_id % 5 WHEN 0 THEN 'query' WHEN 1 THEN 'body' WHEN 2 THEN 'header' WHEN 3 THEN 'form' END, 'required': page_id % 2 = 0}]",
    ),
    "PATH": ("regexp_replace(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/[0-9]+', CASE page_id % 3 WHEN 0 THEN '/:id' WHEN 1 THEN '/<id>' ELSE '/<int:id>' END)", "regexp_replace(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/[0-9]+', CASE page_id % 3 WHEN 0 THEN '/:id' WHEN 1 THEN '/<id>' ELSE '/<int:id>' END, 'g')"),
    "RULES": (
        "filter(array(CASE WHEN p_size % 2 = 1 THEN 'NotEmpty' END, CASE WHEN p_size % 3 = 0 THEN 'Length' END, CASE WHEN p_size % 5 = 0 THEN 'EmailAddress' END, CASE WHEN p_size % 7 = 0 THEN 'Matches' END, CASE WHEN p_size % 11 = 0 THEN 'GreaterThan' END, CASE WHEN p_size % 4 = 0 THEN 'NotNull' END, CASE WHEN p_size % 6 = 0 THEN 'Pattern' END), x -> x is not null)",
        "list_filter([CASE WHEN p_size % 2 = 1 THEN 'NotEmpty' END, CASE WHEN p_size % 3 = 0 THEN 'Length' END, CASE WHEN p_size % 5 = 0 THEN 'EmailAddress' END, CASE WHEN p_size % 7 = 0 THEN 'Matches' END, CASE WHEN p_size % 11 = 0 THEN 'GreaterThan' END, CASE WHEN p_size % 4 = 0 THEN 'NotNull' END, CASE WHEN p_size % 6 = 0 THEN 'Pattern' END], lambda x: x IS NOT NULL)",
    ),
    "JSON": (
        "to_json(named_struct('name', concat('item ', doc_id), 'method', CASE doc_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END, 'lang', lang, 'source', source))",
        "CAST(to_json({'name': 'item ' || doc_id, 'method': CASE doc_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END, 'lang': lang, 'source': source}) AS VARCHAR)",
    ),
    "FENCE": ("concat('```json\n{\"name\": \"t', conv_id, '\", \"turn\": ', turn, '}\n```')", "concat('```json\n{\"name\": \"t', conv_id, '\", \"turn\": ', turn, '}\n```')"),
}

#: Table -> (tables that it reads, SELECT).
ADAPTERS: dict[str, tuple[tuple[str, ...], str]] = {
    "results": (
        ("events",),
        """
SELECT event_id AS id, concat('test_', CAST(event_id AS STRING)) AS name, user_id AS session_id,
  CASE WHEN k = 99 THEN NULL ELSE CASE event_type WHEN 'click' THEN 'happy_path' WHEN 'view' THEN 'validation' WHEN 'signup' THEN 'authentication'
       WHEN 'purchase' THEN 'edge_case' ELSE 'security' END END AS test_type,
  CASE WHEN k = 98 THEN NULL ELSE concat('/api/users/', CAST(user_id % 20 AS STRING)) END AS endpoint,
  CASE k % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' ELSE 'PATCH' END AS method,
  CASE WHEN k = 97 THEN NULL ELSE value < 70 END AS passed, value AS execution_time, value / 2 AS response_time, 200 AS expected_status,
  CASE WHEN value < 70 THEN 200 WHEN k % 4 = 3 THEN NULL WHEN k = 40 THEN 0 ELSE 400 + k % 4 END AS actual_status,
  CASE WHEN value < 70 THEN NULL WHEN k % 4 = 0 THEN 'Request timeout: attempt 3' WHEN k % 4 = 1 THEN 'Client error: refused'
       WHEN k % 4 = 2 THEN 'Validation failed' END AS error,
  CASE WHEN value < 70 THEN 'passed' WHEN k < 10 THEN 'skipped' WHEN k < 30 THEN 'error' ELSE 'failed' END AS status,
  k, props AS request_data, {ASSERTIONS} AS assertions, ts
FROM (SELECT *, {K} AS k FROM events) e""",
    ),
    "agent_metrics": (
        ("events",),
        """
SELECT event_type AS agent_type, value AS execution_time, CAST(k AS BIGINT) AS tokens_used, CAST(1 + k % 3 AS BIGINT) AS api_calls, value < 70 AS success
FROM (SELECT *, {K} AS k FROM events) e""",
    ),
    "experiences": (
        ("events",),
        """
SELECT user_id AS episode, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS step, value / 100 AS reward, CAST(k AS DOUBLE) / 100 AS value,
  CAST(k % 7 AS DOUBLE) / 10 AS next_value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS done, event_id AS id, CAST(k - 50 AS DOUBLE) / 10 AS td_error,
  1 + CAST(k AS DOUBLE) / 50 AS priority
FROM (SELECT *, {K} AS k FROM events) e""",
    ),
    "test_cases": (
        ("events",),
        """
SELECT event_id AS ordinal, user_id AS suite_id, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN '' ELSE concat('case ', event_id) END AS name,
  CASE event_type WHEN 'click' THEN 'happy_path' WHEN 'view' THEN 'validation_error' WHEN 'signup' THEN 'authentication' WHEN 'purchase' THEN 'edge_case' ELSE 'security' END AS test_type,
  CASE k % 8 WHEN 0 THEN 'get' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'Delete' WHEN 4 THEN 'PATCH' WHEN 5 THEN 'FETCH' WHEN 6 THEN NULL ELSE 'HEAD' END AS method,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN '' ELSE concat('/api/items/', '{', 'id', '}', '/', CAST(user_id % 7 AS STRING)) END AS endpoint,
  CASE WHEN k % 23 = 0 THEN 'x' END AS test_case, 200 + (k % 3) AS expected_status, concat('about ', event_type) AS description, k
FROM (SELECT *, {K} AS k FROM events) e""",
    ),
    "cases": (
        ("documents",),
        """
SELECT doc_id AS id,
  concat(split_part(text, chr(10), 1), CASE doc_id % 10 WHEN 0 THEN ' validation of email' WHEN 1 THEN ' invalid login token' WHEN 2 THEN ' duplicate license' WHEN 3 THEN ' boundary limit'
    WHEN 4 THEN ' successful booking' WHEN 5 THEN ' sql injection' WHEN 6 THEN ' negative price' ELSE ' listing' END) AS title,
  concat(substring(text, length(split_part(text, chr(10), 1)) + 2), CASE doc_id % 4 WHEN 0 THEN ' must be unique' ELSE '' END) AS description,
  CASE doc_id % 3 WHEN 0 THEN 'user exists' WHEN 1 THEN '' END AS preconditions,
  CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' END AS priority,
  CASE doc_id % 2 WHEN 0 THEN 'smoke' ELSE 'functional' END AS type, source AS suite_path, {STEPS} AS steps, {TAGS} AS tags
FROM documents""",
    ),
    "endpoints_raw": (
        ("pages",),
        """
SELECT page_id AS ordinal, concat('C', page_id % 9) AS controller, CASE WHEN page_id % 5 = 4 THEN NULL ELSE concat('op', page_id) END AS method_name,
  CASE page_id % 6 WHEN 0 THEN 'get' WHEN 1 THEN 'POST' WHEN 2 THEN 'put' WHEN 3 THEN 'DELETE' WHEN 4 THEN NULL ELSE 'Patch' END AS http_method,
  CASE WHEN page_id % 17 = 0 THEN NULL ELSE {PATH} END AS path, CASE page_id % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'List<User>' WHEN 2 THEN 'int?' ELSE 'Guid' END AS return_type,
  page_id % 3 = 0 AS authorization_required, {PARAMS} AS parameters
FROM pages""",
    ),
    "parameters": (
        ("part",),
        """
SELECT p_partkey AS id, concat('/p/', p_partkey % 50) AS endpoint,
  concat(CASE p_partkey % 13 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'uuid' WHEN 3 THEN 'createdDate' WHEN 4 THEN 'url' WHEN 5 THEN 'count' WHEN 6 THEN 'telNo' WHEN 7 THEN 'guid' WHEN 8 THEN 'startTime' WHEN 9 THEN 'link' WHEN 10 THEN 'ipAddress' ELSE 'label' END, p_partkey % 3) AS name,
  CASE p_size % 6 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'string' WHEN 3 THEN 'boolean' WHEN 4 THEN 'array' ELSE 'object' END AS type,
  p_size % 2 = 1 AS required, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS min_value, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size + 10 END AS max_value,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS min_length, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size + 5 END AS max_length,
  CASE p_partkey % 4 WHEN 0 THEN 'wrong_type' WHEN 1 THEN 'boundary' WHEN 2 THEN 'edge' ELSE 'length' END AS test_type
FROM part""",
    ),
    "source_files": (
        ("part",),
        """
SELECT concat('src/f', p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.cs' WHEN 1 THEN '.java' WHEN 2 THEN '.py' WHEN 3 THEN '_api.py' ELSE '.cpp' END) AS path,
  CASE p_partkey % 5 WHEN 0 THEN 'csharp' WHEN 1 THEN 'java' WHEN 4 THEN 'cpp' ELSE 'python' END AS language,
  replace(replace(replace(replace(CASE p_partkey % 5
    WHEN 0 THEN 'using System;~using Shop.Core;~[Route("things/§")]~public class T§Controller : ControllerBase~{~  private readonly IT§Service _service;~  [HttpGet("{id}")]~  [Authorize(Policy = "Read§")]~  public async Task<ActionResult<Item>> GetOne(int id) { if (id == null) { throw new Exception("no { §"); } /* } */ if (id < ¤) { return Ok("}"); } return Ok(); }~  [HttpPost]~  public IActionResult Create([FromBody] Item item, [FromQuery] int? n§) => Ok(¤);~}~public class Item§Dto~{~  public string Name { get; set; }~  public int? Size { get; set; }~}~public class Item§Validator : AbstractValidator<Item§Dto>~{~  public Item§Validator() { RuleFor(x => x.Name).NotEmpty().MaximumLength(¤).Matches("[(].*;$"); RuleFor(x => x.Size).GreaterThan(0); }~}'
    WHEN 1 THEN 'import java.util.List;~import org.shop.Item;~@RestController~@RequestMapping("/things§")~public class T§Api {~  @Autowired~  private T§Repo repo;~  @GetMapping("/{id}")~  public Item find(@PathVariable Long id) { return repo.get(id); }~  @DeleteMapping("/{id}")~  public void remove(@PathVariable Long id, @RequestParam("q§") String why) { log("}"); }~}~class Item§ {~  @NotNull~  @Size(min = ¤)~  private String name;~  private int size;~}'
    WHEN 2 THEN 'import os~from flask import Flask~app = Flask(__name__)~@app.route(^/things§/<int:id>^, methods=[^GET^, ^PUT^])~def one(id):~    if id is None:~        return "def x(): §"~    return ¤~~@app.route(^/things§^)~def every():~    return []~'
    WHEN 3 THEN 'from fastapi import FastAPI, Query~from pydantic import BaseModel~~class Item§(BaseModel):~    name: str~    size: int = 0~    code: str = Field(..., min_length=2, max_length=¤, regex=^[a-z]+$^)~    @validator(^size^)~    def check_size(cls, v):~        return v~~@app.get(^/things§/{id}^)~async def one(id: int, q: str = Query(None)):~    return id~~@router.post(^/things§^)~def create(item: Item§):~    return item~'
    ELSE '#include "crow.h"~#include <string>~struct Item§ {~  std::string name;~  int size;~};~int main() {~  CROW_ROUTE(app, "/things§/<int>").methods("GET"_method, "POST"_method)([](int id) { return ¤; });~  http_listener rest("http://0.0.0.0:80/rest§");~  rest.support(methods::GET, handle);~}~bool validateItem(const Item§& i) { return true; }~' END,
    '~', chr(10)), '^', chr(39)), '§', CAST(p_partkey AS STRING)), '¤', CAST(p_size AS STRING)) AS code, p_partkey, p_size
FROM part""",
    ),
    "validator_rows": (
        ("part",),
        """
SELECT p_partkey AS ordinal, p_brand AS model, concat('f', p_size % 8) AS field, p_size AS min_length, p_size + 10 AS max_length, {RULES} AS rules
FROM part""",
    ),
    "knowledge": (
        ("documents",),
        """
SELECT CASE doc_id % 7 WHEN 0 THEN 'test_patterns' WHEN 1 THEN 'bug_patterns' WHEN 2 THEN 'edge_cases' WHEN 3 THEN 'validation_rules' WHEN 4 THEN 'api_patterns' ELSE 'test_patterns' END AS knowledge_type,
  concat('k', doc_id) AS id, {JSON} AS item_json, concat('2024-01-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), 'T00:00:00') AS added_at,
  CASE WHEN doc_id % 5 = 0 THEN concat('2024-02-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), 'T00:00:00') END AS updated_at, doc_id
FROM documents""",
    ),
    "vectors": (
        ("embeddings",),
        """
SELECT vec_id AS id, CASE label % 6 WHEN 0 THEN 'test_patterns' WHEN 1 THEN 'api_patterns' WHEN 2 THEN 'edge_cases' WHEN 3 THEN 'bug_patterns' WHEN 4 THEN 'validation_rules' ELSE 'code' END AS index_name,
  embedding AS vec, concat('text of ', vec_id, ' label ', label) AS content, label
FROM embeddings""",
    ),
    "corpus": (("documents",), "SELECT doc_id, text AS content, CASE doc_id % 5 WHEN 0 THEN 'test_case' WHEN 1 THEN 'api_specification' WHEN 2 THEN 'validation' WHEN 3 THEN 'other' END AS type, lang, source FROM documents"),
    "llm_responses": (
        ("conversations",),
        """
SELECT concat(conv_id, '/', turn) AS id, conv_id, turn, CASE turn % 3 WHEN 0 THEN text
  WHEN 1 THEN concat('Here it is: ', {FENCE}, ' done') ELSE concat('Result ', '{', '"name": "n', conv_id, '", "method": "GET"', '}', ' end') END AS text
FROM conversations""",
    ),
}


def _experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table "experiences" with its steps counted over range partitions: one user may hold any share of the events."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), "ts", F.col("event_id").alias("id"), "value", k.alias("k"))
    rows = stored(numbered(rows, ["episode"], ["ts", "id"], "_at"))
    ends = stored(rows.groupBy("episode").agg(F.max("_at").alias("_end"), F.count(F.lit(1)).alias("_n")))
    number = F.col("k").cast("double")
    return with_group_values(rows, ends, "episode", "_n").select(
        "episode",
        (F.col("_at") + 1).cast("int").alias("step"),
        (F.col("value") / 100).alias("reward"),
        (number / 100).alias("value"),
        ((F.col("k") % 7).cast("double") / 10).alias("next_value"),
        (F.col("_at") == F.col("_end")).alias("done"),
        "id",
        ((F.col("k") - 50).cast("double") / 10).alias("td_error"),
        (1 + number / 50).alias("priority"),
    )


#: Tables that Spark derives in another form than the SELECT above, which DuckDB runs: the same rows, without a window over a hot key.
SPARK_FORMS = {"experiences": _experiences}


def dialect(sql: str, duck: bool) -> str:
    return re.sub(r"\{([A-Z]+)\}", lambda m: DIALECT[m[1]][duck], sql)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, or a derived one."""
    if table in SPARK_FORMS:
        return SPARK_FORMS[table](spark, sf_dir)
    if table in ADAPTERS:
        bases, sql = ADAPTERS[table]
        sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(bases)})\b", r"\1 <<\2>>", dialect(sql, False)).replace("{", "{{").replace("}", "}}")
        sql = re.sub(r"<<(\w+)>>", r"{\1}", sql)
        return spark.sql(sql, **{b: load(spark, sf_dir, b) for b in bases})
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def duck_ctes(tables: list[str], sql: str) -> str:
    """``sql`` for DuckDB, with the derived tables as common table expressions."""
    ctes = [f"{t} AS ({dialect(ADAPTERS[t][1], True)})" for t in dict.fromkeys(tables)]
    if not ctes:
        return sql
    head = sql.lstrip()
    for start, join in (("WITH RECURSIVE ", "WITH RECURSIVE "), ("WITH ", "WITH ")):
        if head.startswith(start):
            return f"{join}{', '.join(ctes)}, {head[len(start) :]}"
    return f"WITH {', '.join(ctes)} {sql}"
