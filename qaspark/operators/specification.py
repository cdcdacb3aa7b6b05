"""API specifications: paths with their operations, schemas, as canonical JSON.

Every path and every schema is a row with its own JSON, keys in order and without blanks; the whole document is written by many tasks
(``write_specification``), never put together in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.numbers import let
from qaspark.operators.endpoints import LOCATIONS_SPEC, SQL_METHOD, lookup, spec_type, sql_lookup, sql_spec_type
from qaspark.registry import query

# Responses of every operation, and its security if it needs any.
RESPONSES = {"200": "Successful response", "400": "Bad request", "401": "Unauthorized", "404": "Not found", "500": "Internal server error"}
SECURITY = '[{"BearerAuth":[]}]'

_RESPONSES = "{" + ",".join(f'"{code}":{{"description":"{text}"}}' for code, text in RESPONSES.items()) + "}"


def json_text(text: Column) -> Column:
    """JSON literal of a string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1")


def _object(fields: list[tuple[str, Column]]) -> Column:
    """JSON object of fields whose values are JSON; nulls are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("string")


def parameters_json(parameters: Column) -> Column:
    """The parameters of an operation, in order: in, name, required, schema."""

    def one(p: Column) -> Column:
        place = F.coalesce(lookup(LOCATIONS_SPEC, F.coalesce(p["source"], F.lit(""))), F.lit("query"))
        schema = _object([("type", json_text(spec_type(F.coalesce(p["type"], F.lit("string")))))])
        return _object([("in", json_text(place)), ("name", json_text(F.coalesce(p["name"], F.lit("unknown")))), ("required", _true(p["required"])), ("schema", schema)])

    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(parameters, one), ","), F.lit("")), F.lit("]"))


def _operation() -> Column:
    needed = F.coalesce("authorization_required", F.lit(False))
    fields = [("operationId", json_text(F.coalesce("method_name", F.lit("unknown")))), ("parameters", parameters_json(F.col("parameters"))), ("responses", F.lit(_RESPONSES)), ("security", F.when(needed, SECURITY))]
    return _object(fields)


def operations(endpoints: DataFrame) -> DataFrame:
    """path, method (lower case), secured and the operation's JSON; of endpoints that repeat a path and method the last one wins."""
    rows = endpoints.select(F.coalesce("path", F.lit("/unknown")).alias("path"), F.lower(F.coalesce("http_method", F.lit("GET"))).alias("method"), "ordinal", F.coalesce("authorization_required", F.lit(False)).alias("secured"), _operation().alias("json"))
    last = F.max_by(F.struct("secured", "json"), "ordinal").alias("o")
    return rows.groupBy("path", "method").agg(last).select("path", "method", "o.*")


_PLACE = f"coalesce({sql_lookup(LOCATIONS_SPEC, 'p.source')}, 'query')"
_PARAMETER = f"""'{{"in":' || to_json({_PLACE}) || ',"name":' || to_json(coalesce(p.name, 'unknown')) || ',"required":' || coalesce(p.required, false) || ',"schema":{{"type":' || to_json({sql_spec_type("coalesce(p.type, 'string')")}) || '}}}}'"""
_OPERATION = f"""'{{"operationId":' || to_json(coalesce(method_name, 'unknown')) || ',"parameters":[' || array_to_string(list_transform(parameters, lambda p: {_PARAMETER}), ',') || '],"responses":{_RESPONSES}' || CASE WHEN authorization_required THEN ',"security":{SECURITY}' ELSE '' END || '}}'"""
SQL_PATHS = f"""WITH o AS (SELECT coalesce(path, '/unknown') AS path, lower({SQL_METHOD}) AS method, arg_max(coalesce(authorization_required, false), ordinal) AS secured, arg_max({_OPERATION}, ordinal) AS json FROM endpoints_raw GROUP BY 1, 2)
    SELECT path, string_agg(method, ',' ORDER BY method) AS methods, count(*) FILTER (WHERE secured) AS secured, '{{' || string_agg('"' || method || '":' || json, ',' ORDER BY method) || '}}' AS json FROM o GROUP BY 1"""


@query("endpoints_raw", sql=SQL_PATHS)
def build_paths(endpoints: DataFrame) -> DataFrame:
    """Paths of the specification: methods, how many need authorisation, and the JSON of their operations (operationId, parameters,
    responses, security). Only a path's methods, which are few, meet in a row."""
    one = F.struct("method", "secured", "json")
    paths = operations(endpoints).groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("o"))
    json = F.array_join(F.transform("o", lambda o: F.concat(json_text(o["method"]), F.lit(":"), o["json"])), ",")
    methods = F.array_join(F.transform("o", lambda o: o["method"]), ",")
    return paths.select("path", methods.alias("methods"), F.size(F.filter("o", lambda o: o["secured"])).cast("long").alias("secured"), F.concat(F.lit("{"), json, F.lit("}")).alias("json"))


_LAST = "list_filter(properties, lambda p, i: NOT list_contains(list_transform(properties[i + 1:], lambda q: q.name), p.name))"
SQL_SCHEMAS = f"""WITH m AS (SELECT coalesce(controller, 'UnknownModel') AS model, arg_max(parameters, ordinal) AS properties FROM endpoints_raw GROUP BY 1)
    SELECT model, len({_LAST})::INT AS n_properties, '{{"properties":{{' || array_to_string(list_transform(list_sort(list_transform({_LAST}, lambda p: {{'name': p.name, 'json': to_json(p.name) || ':{{"nullable":' || ends_with(p.type, '?') || ',"type":' || to_json({sql_spec_type('p.type')}) || '}}'}})), lambda x: x.json), ',') || '}},"type":"object"}}' AS json FROM m"""


def _as_models(endpoints: DataFrame) -> DataFrame:
    properties = F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), F.endswith(p["type"], F.lit("?")).alias("nullable")))
    return endpoints.select(F.col("controller").alias("name"), "ordinal", properties.alias("properties"))


@query("endpoints_raw", prepare=lambda e: (_as_models(e),), sql=SQL_SCHEMAS)
def build_schemas(models: DataFrame) -> DataFrame:
    """Schema of each model (name, ordinal, properties): the JSON of its properties with nullability and specification type.

    Of models of one name the last one wins, and of properties of one name in it.
    """
    last = models.groupBy(F.coalesce("name", F.lit("UnknownModel")).alias("model")).agg(F.max_by("properties", "ordinal").alias("p"))

    def kept(properties: Column) -> Column:
        names = F.transform(properties, lambda p: p["name"])
        return F.filter(properties, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["name"]))

    one = lambda p: _object([("nullable", _true(p["nullable"])), ("type", json_text(spec_type(F.coalesce(p["type"], F.lit("string")))))])
    named = F.transform(let(F.coalesce("p", F.array().cast(models.schema["properties"].dataType)), kept), lambda p: F.struct(p["name"].alias("name"), F.concat(json_text(p["name"]), F.lit(":"), one(p)).alias("json")))
    rows = last.select("model", F.array_sort(named).alias("p"))
    json = F.concat(F.lit('{"properties":{'), F.array_join(F.transform("p", lambda p: p["json"]), ","), F.lit('},"type":"object"}'))
    return rows.select("model", F.size("p").alias("n_properties"), json.alias("json"))


def specification_rows(endpoints: DataFrame, models: DataFrame) -> DataFrame:
    """section (components.schemas or paths), name and JSON of everything in the document."""
    paths = build_paths(endpoints).select(F.lit("paths").alias("section"), F.col("path").alias("name"), "json")
    return build_schemas(models).select(F.lit("components.schemas").alias("section"), F.col("model").alias("name"), "json").unionByName(paths)


@query("endpoints_raw", prepare=lambda e: (e, _as_models(e)), sql=f"SELECT 'paths' AS section, path AS name, json FROM ({SQL_PATHS}) UNION ALL SELECT 'components.schemas', model, json FROM ({SQL_SCHEMAS})")
def build_specification(endpoints: DataFrame, models: DataFrame) -> DataFrame:
    """The specification's paths and schemas as rows of JSON."""
    return specification_rows(endpoints, models)


def write_specification(endpoints: DataFrame, models: DataFrame, folder: str) -> None:
    """The document as lines of text in sorted part files: read one after another they are one JSON object."""
    rows = specification_rows(endpoints, models)
    line = F.concat(json_text(F.col("name")), F.lit(":"), "json")
    edge = lambda section, name, text: rows.sparkSession.createDataFrame([(section, name, text)], "section string, at int, line string")
    texts = rows.select("section", F.lit(1).alias("at"), line.alias("line"), "name")
    first = F.broadcast(texts.groupBy("section").agg(F.min("name").alias("_first")))  # two rows
    sized = texts.join(first, "section").withColumn("line", F.when(F.col("name") == F.col("_first"), F.col("line")).otherwise(F.concat(F.lit(","), "line"))).drop("_first")
    heads = edge("components.schemas", 0, '{"components":{"schemas":{').unionByName(edge("components.schemas", 2, "}},")).unionByName(edge("paths", 0, '"paths":{')).unionByName(edge("paths", 2, "}}"))
    whole = sized.unionByName(heads.withColumn("name", F.lit(None).cast("string")))
    whole.orderBy("section", "at", "name").select("line").write.text(folder)
