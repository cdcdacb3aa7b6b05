"""Test data: valid, boundary, edge and wrong values of parameters. Choices are hashed with a seed, never random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.registry import query

# Values of the wrong type, of invalid format, and edge values, by type, as JSON.
WRONG = {"integer": '"not_a_number"', "number": '"not_a_number"', "boolean": '"not_a_boolean"', "array": '"not_an_array"', "object": '"not_an_object"', "string": "12345"}
BAD_FORMAT = {"email": "invalid-email", "date": "not-a-date", "url": "not://a.url", "uuid": "not-a-uuid"}
EDGES = {"integer": ["0", "-1", "2147483647", "-2147483648"], "number": ["0.0", "-0.0", "1e308"], "string": ['""', '" "', '"<script>alert(1)</script>"'], "boolean": ["null"], "array": ["[]", "[null]"], "object": ["{}", "null"]}
VERY_LONG = 10_000


def _case(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _sql_case(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def pick(n: Column, *parts: str, seed: int = 0) -> Column:
    """A whole number from 0 to n - 1 that depends on the parts and the seed."""
    digest = F.md5(F.concat_ws(":", *[F.col(p).cast("string") for p in parts], F.lit(str(seed))))
    return F.conv(digest.substr(1, 12), 16, 10).cast("bigint") % n


_PICK = "CAST('0x' || substr(md5(id || ':' || name || ':0'), 1, 12) AS BIGINT) % ({0})"


@query("parameters", sql=f"SELECT id, {_sql_case(WRONG, 'type')} AS value FROM parameters")
def wrong_type_values(parameters: DataFrame) -> DataFrame:
    """A JSON value of the wrong type."""
    return parameters.select("id", _case(WRONG, F.col("type")).alias("value"))


_LENGTH = f"CASE WHEN min_length IS NOT NULL THEN greatest(min_length - 1, 0) WHEN max_length IS NOT NULL THEN max_length + 1 ELSE {VERY_LONG} END"


@query("parameters", sql=f"SELECT id, repeat('x', {_LENGTH}) AS value FROM parameters")
def invalid_length_values(parameters: DataFrame) -> DataFrame:
    """A string too short, else too long, else very long."""
    return parameters.select("id", _bad_length().alias("value"))


def _bad_length() -> Column:
    n = F.when(F.col("min_length").isNotNull(), F.greatest(F.col("min_length") - 1, F.lit(0))).when(F.col("max_length").isNotNull(), F.col("max_length") + 1).otherwise(VERY_LONG)
    return F.repeat(F.lit("x"), n)


_WORD = "regexp_extract(name, '^[a-z]+', 0)"
_FORMAT = f"coalesce({_sql_case(BAD_FORMAT, _WORD)}, 'invalid_format')"


def _bad_format() -> Column:
    return F.coalesce(_case(BAD_FORMAT, F.regexp_extract("name", "^[a-z]+", 0)), F.lit("invalid_format"))


@query("parameters", sql=f"SELECT id, {_FORMAT} AS value FROM parameters")
def invalid_format_values(parameters: DataFrame) -> DataFrame:
    """A value of invalid format, by the leading word of the name."""
    return parameters.select("id", _bad_format().alias("value"))


_BOUND = "CASE WHEN type IN ('integer', 'number') THEN CAST(coalesce(min_value, max_value, 0) AS VARCHAR) WHEN type = 'string' THEN '\"' || repeat('x', coalesce(min_length, max_length, 0)) || '\"' END"


def _boundary() -> Column:
    number = F.coalesce("min_value", "max_value", F.lit(0)).cast("string")
    text = F.concat(F.lit('"'), F.repeat(F.lit("x"), F.coalesce("min_length", "max_length", F.lit(0))), F.lit('"'))
    return F.when(F.col("type").isin("integer", "number"), number).when(F.col("type") == "string", text)


_VALID = f"""CASE WHEN contains(lower(name), 'email') THEN '"test_' || (1000 + {_PICK.format(9000)}) || '@example.com"' WHEN contains(lower(name), 'phone') OR contains(lower(name), 'tel') THEN '"+1' || (1000000000 + {_PICK.format(8999999999)}) || '"'
 WHEN contains(lower(name), 'uuid') OR contains(lower(name), 'guid') THEN '"' || md5(id || ':' || name) || '"' WHEN contains(lower(name), 'date') OR contains(lower(name), 'time') THEN '"2024-01-' || lpad(CAST(1 + {_PICK.format(28)} AS VARCHAR), 2, '0') || '"'
 WHEN contains(lower(name), 'url') OR contains(lower(name), 'link') THEN '"https://example.com/api/' || (1 + {_PICK.format(100)}) || '"' WHEN contains(lower(name), 'ip') THEN '"192.168.' || {_PICK.format(256)} || '.' || (1 + {_PICK.format(254)}) || '"'
 WHEN type = 'integer' THEN CAST(coalesce(min_value, 1) + {_PICK.format('greatest(coalesce(max_value, 1000) - coalesce(min_value, 1) + 1, 1)')} AS VARCHAR)
 WHEN type = 'number' THEN CAST(CAST((100 * coalesce(min_value, 0) + {_PICK.format('greatest(100 * (coalesce(max_value, 1000) - coalesce(min_value, 0)) + 1, 1)')}) / 100.0 AS DECIMAL(20, 2)) AS VARCHAR)
 WHEN type = 'boolean' THEN CASE WHEN {_PICK.format(2)} = 0 THEN 'false' ELSE 'true' END WHEN type = 'array' THEN '["x"]' WHEN type = 'object' THEN '{{"key":"value","nested":{{"data":"test"}}}}'
 ELSE '"' || repeat('a', CAST(coalesce(min_length, 1) + {_PICK.format('greatest(coalesce(max_length, 20) - coalesce(min_length, 1) + 1, 1)')} AS INT)) || '"' END"""


def _valid() -> Column:
    name, kind = F.lower("name"), F.col("type")
    p = lambda n: pick(n if isinstance(n, Column) else F.lit(n), "id", "name")
    quoted = lambda *parts: F.concat(F.lit('"'), *[x if isinstance(x, Column) else F.lit(x) for x in parts], F.lit('"'))
    between = lambda low, low_default, high, high_default: F.coalesce(low, F.lit(low_default)) + p(F.greatest(F.coalesce(high, F.lit(high_default)) - F.coalesce(low, F.lit(low_default)) + 1, F.lit(1)))
    has = lambda *words: name.rlike("|".join(words))
    least, most = F.coalesce("min_value", F.lit(0)), F.coalesce("max_value", F.lit(1000))
    hundredths = 100 * least + p(F.greatest(100 * (most - least) + 1, F.lit(1)))
    return (
        F.when(has("email"), quoted("test_", (1000 + p(9000)).cast("string"), "@example.com"))
        .when(has("phone", "tel"), quoted("+1", (1000000000 + p(8999999999)).cast("string")))
        .when(has("uuid", "guid"), quoted(F.md5(F.concat_ws(":", F.col("id").cast("string"), "name"))))
        .when(has("date", "time"), quoted("2024-01-", F.lpad((1 + p(28)).cast("string"), 2, "0")))
        .when(has("url", "link"), quoted("https://example.com/api/", (1 + p(100)).cast("string")))
        .when(has("ip"), quoted("192.168.", p(256).cast("string"), ".", (1 + p(254)).cast("string")))
        .when(kind == "integer", between(F.col("min_value"), 1, F.col("max_value"), 1000).cast("string"))
        .when(kind == "number", (hundredths / 100).cast("decimal(20,2)").cast("string"))
        .when(kind == "boolean", F.when(p(2) == 0, "false").otherwise("true"))
        .when(kind == "array", F.lit('["x"]'))
        .when(kind == "object", F.lit('{"key":"value","nested":{"data":"test"}}'))
        .otherwise(quoted(F.repeat(F.lit("a"), between(F.col("min_length"), 1, F.col("max_length"), 20).cast("int"))))
    )


@query(
    "parameters",
    prepare=lambda p: (p.withColumn("enum", F.when(F.col("id") % 9 == 0, F.array(F.lit('"low"'), F.lit('"mid"'), F.lit('"high"')))),),
    sql=f"""SELECT id, CASE WHEN id % 9 = 0 THEN ['"low"', '"mid"', '"high"'][1 + {_PICK.format(3)}] ELSE {_VALID} END AS value FROM parameters""",
)
def valid_values(parameters: DataFrame) -> DataFrame:
    """A valid JSON value: one of the ``enum`` (JSON values) if the table has such a column and it is not empty, else by what the name
    says, else by type within the constraints."""
    value = _valid()
    if "enum" in parameters.columns:
        value = F.when(F.size("enum") > 0, F.get("enum", pick(F.size("enum"), "id", "name").cast("int"))).otherwise(value)
    return parameters.select("id", value.alias("value"))


@query("parameters", sql=f"SELECT id, coalesce({_BOUND}, {_VALID}) AS value FROM parameters")
def boundary_values(parameters: DataFrame) -> DataFrame:
    """The value at the lower bound, else at the upper, else a valid value."""
    return parameters.select("id", F.coalesce(_boundary(), _valid()).alias("value"))


_POOL = ", ".join(f"('{t}', [{', '.join(repr(v) for v in vs)}])" for t, vs in EDGES.items())


@query("parameters", sql=f"SELECT p.id, unnest(e.vals) AS value FROM parameters p JOIN (VALUES {_POOL}) e(type, vals) USING (type)")
def edge_values(parameters: DataFrame) -> DataFrame:
    """Every edge value of the parameter's type."""
    pool = F.create_map(*[x for t, vs in EDGES.items() for x in (F.lit(t), F.array(*[F.lit(v) for v in vs]))])
    return parameters.select("id", F.explode(F.try_element_at(pool, F.col("type"))).alias("value"))


_EDGE_FIRST = f"(CASE type {' '.join(f'WHEN {t!r} THEN {vs[0]!r}' for t, vs in EDGES.items())} END)"
#: Tests of the query: kind, test type, description and input that is there already.
_KINDS = [("missing", "validation", "a required field is missing", None), ("type", "validation", "wrong type", None), ("length", "validation", "too long: length", None), ("format", "validation", "bad format", None), ("plain", "validation", "fine", None), ("boundary", "boundary", None, None), ("edge", "edge_case", "", None), ("any", "functional", "", None), ("given", "functional", "", '{"given":1}')]


def _tests(parameters: DataFrame) -> tuple[DataFrame, DataFrame]:
    kinds = parameters.sparkSession.createDataFrame(_KINDS, "kind string, test_type string, description string, test_data string")
    every = parameters.select("endpoint").distinct().crossJoin(F.broadcast(kinds))  # a few kinds
    return every.select(F.concat_ws(":", "endpoint", "kind").alias("test"), "endpoint", "test_type", "description", "test_data"), parameters


def counting(parameters: DataFrame) -> DataFrame:
    """The parameter that counts for each endpoint and name, by scope of a test: of all, of those not required (missing), or of those
    required and seven in ten others (any).

    Only the largest ids are aggregated and joined back, so a test meets a row a name, however many parameters share the name.
    """
    needed = F.coalesce("required", F.lit(False))
    scopes = F.array_compact(F.array(F.lit("all"), F.when(~needed, "missing"), F.when(needed | (pick(F.lit(10), "id", "name") >= 3), "any")))
    key = ["endpoint", "name", "id"]
    largest = parameters.where("endpoint is not null").select("endpoint", "name", "id", F.explode(scopes).alias("scope")).groupBy("endpoint", "name", "scope").agg(F.max("id").alias("id"))
    largest = largest.select(*[F.col(c).alias(f"_{c}") for c in key], "scope")
    return parameters.drop("test_type").join(largest, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]).drop(*[f"_{c}" for c in key])


@query(
    "parameters",
    prepare=_tests,
    sql=f"""WITH k AS (SELECT unnest({[k[0] for k in _KINDS]}) AS k), t AS (SELECT endpoint || ':' || k AS test, endpoint AS ep, k FROM (SELECT DISTINCT endpoint FROM parameters), k),
    v AS (SELECT test, id, name, CASE k WHEN 'type' THEN {_sql_case(WRONG, 'type')} WHEN 'length' THEN '"' || repeat('x', {_LENGTH}) || '"' WHEN 'format' THEN '"' || {_FORMAT} || '"' WHEN 'boundary' THEN coalesce({_BOUND}, {_VALID})
      WHEN 'edge' THEN {_EDGE_FIRST} ELSE {_VALID} END AS value FROM t JOIN parameters p ON p.endpoint = t.ep WHERE CASE k WHEN 'missing' THEN NOT required WHEN 'any' THEN required OR {_PICK.format(10)} >= 3 WHEN 'given' THEN false ELSE true END),
    m AS (SELECT test, name, arg_max(coalesce(value, 'null'), id) AS value FROM v GROUP BY 1, 2)
    SELECT t.test, CASE k WHEN 'given' THEN '{{"given":1}}' ELSE '{{' || coalesce(string_agg('"' || name || '":' || value, ',' ORDER BY name), '') || '}}' END AS test_data FROM t LEFT JOIN m USING (test) GROUP BY t.test, k""",
)
def generate_test_data(tests: DataFrame, parameters: DataFrame) -> DataFrame:
    """Input of each test as a JSON object of its endpoint's parameters; ``test_data`` that a test has already is kept.

    Tests of validation break what their description names: required parameters are left out, or values get a wrong type, length or
    format. Tests of boundaries and edges get such values. All others get valid ones: of required parameters, and of seven in ten
    others. Of parameters with the same name the one with the largest id counts. A test without parameters gets an empty object.
    """
    text = F.lower(F.coalesce("description", F.lit("")))
    broken = F.when(text.rlike("missing|required"), "missing").when(text.rlike("type"), "type").when(text.rlike("length|size"), "length").when(text.rlike("format"), "format").otherwise("valid")
    kind = F.when(F.col("test_type") == "validation", broken).when(F.col("test_type") == "boundary", "boundary").when(F.col("test_type") == "edge_case", "edge").otherwise("any")
    due = tests.where("test_data is null").select("test", "endpoint", kind.alias("kind"))
    rows = due.withColumn("scope", F.when(F.col("kind").isin("missing", "any"), F.col("kind")).otherwise("all")).join(counting(parameters), ["endpoint", "scope"])
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    value = (
        F.when(F.col("kind") == "type", _case(WRONG, F.col("type")))
        .when(F.col("kind") == "length", quoted(_bad_length()))
        .when(F.col("kind") == "format", quoted(_bad_format()))
        .when(F.col("kind") == "boundary", F.coalesce(_boundary(), _valid()))
        .when(F.col("kind") == "edge", _case({k: v[0] for k, v in EDGES.items()}, F.col("type")))
        .otherwise(_valid())
    )
    each = rows.groupBy("test", "name").agg(F.max_by(F.coalesce(value, F.lit("null")), "id").alias("value"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda x: F.concat(F.lit('"'), x["name"], F.lit('":'), x["value"]))
    made = each.groupBy("test").agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("_made"))
    return tests.select("test", "test_data").join(made, "test", "left").select("test", F.coalesce("test_data", "_made", F.lit("{}")).alias("test_data"))
