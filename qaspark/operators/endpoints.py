"""Endpoint catalogues and API specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions.tables import numbered, stored, with_group_values
from qaspark.registry import query

# Types of source languages in API terms, and where a parameter is sent.
TYPE_MAP = {
    "string": "string", "String": "string", "int": "integer", "Int32": "integer", "long": "integer", "Int64": "integer", "float": "number", "double": "number", "Double": "number",
    "bool": "boolean", "Boolean": "boolean", "DateTime": "string", "DateOnly": "string", "Guid": "string", "str": "string", "list": "array", "dict": "object",
    "Integer": "integer", "Long": "integer", "Float": "number", "Date": "string", "List": "array", "Map": "object",
}
SPEC_TYPES = {"int": "integer", "long": "integer", "string": "string", "bool": "boolean", "double": "number", "float": "number", "decimal": "number", "DateTime": "string", "DateOnly": "string", "Guid": "string"}
LOCATIONS = {"body": "body", "query": "query", "path": "path", "route": "path", "header": "header", "form": "formData"}
LOCATIONS_SPEC = {"query": "query", "route": "path", "path": "path", "body": "body", "header": "header"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def sql_lookup(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def path_of(path: Column) -> Column:
    """Leading slash, no trailing one, ``:x``, ``<x>`` and ``<t:x>`` as ``{x}``."""
    p = F.coalesce(path, F.lit("/"))
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"<\w+:(\w+)>", "{$1}"), r"<(\w+)>", "{$1}"), r":(\w+)", "{$1}")
    p = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))
    return F.when((F.length(p) > 1) & F.endswith(p, F.lit("/")), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)


_P = r"regexp_replace(regexp_replace(regexp_replace(coalesce(path, '/'), '<\w+:(\w+)>', '{\1}', 'g'), '<(\w+)>', '{\1}', 'g'), ':(\w+)', '{\1}', 'g')"
SQL_PATH = f"CASE WHEN length({_P}) > 1 AND ends_with({_P}, '/') THEN left({_P}, length({_P}) - 1) ELSE {_P} END"
SQL_METHOD = "upper(coalesce(http_method, 'GET'))"


@query("endpoints_raw", sql=f"SELECT ordinal, {SQL_PATH} AS path FROM endpoints_raw")
def normalize_path(endpoints: DataFrame) -> DataFrame:
    return endpoints.select("ordinal", path_of(F.col("path")).alias("path"))


@query("endpoints_raw", sql=f"SELECT ordinal, {SQL_METHOD} AS method FROM endpoints_raw")
def normalize_method(endpoints: DataFrame) -> DataFrame:
    """Upper case, GET by default."""
    return endpoints.select("ordinal", F.upper(F.coalesce("http_method", F.lit("GET"))).alias("method"))


def type_of(kind: Column) -> Column:
    """API type of a source type; of a generic one by its base, object by default; unknown ones in lower case."""
    base = F.substring_index(kind, "<", 1)
    return F.when(F.contains(kind, F.lit("<")), F.coalesce(lookup(TYPE_MAP, base), F.lit("object"))).otherwise(F.coalesce(lookup(TYPE_MAP, kind), F.lower(kind)))


def sql_type_of(kind: str) -> str:
    base = f"split_part({kind}, '<', 1)"
    return f"CASE WHEN contains({kind}, '<') THEN coalesce({sql_lookup(TYPE_MAP, base)}, 'object') ELSE coalesce({sql_lookup(TYPE_MAP, kind)}, lower({kind})) END"


@query("endpoints_raw", sql=f"SELECT ordinal, {sql_type_of('return_type')} AS type FROM endpoints_raw")
def normalize_type(endpoints: DataFrame) -> DataFrame:
    return endpoints.select("ordinal", type_of(F.col("return_type")).alias("type"))


def spec_type(kind: Column) -> Column:
    """Specification type: nullable marks are dropped, generics are objects, unknown types strings."""
    bare = F.replace(kind, F.lit("?"), F.lit(""))
    return F.when(F.contains(bare, F.lit("<")), "object").otherwise(F.coalesce(lookup(SPEC_TYPES, bare), F.lit("string")))


def sql_spec_type(kind: str) -> str:
    return f"CASE WHEN contains({kind}, '<') THEN 'object' ELSE coalesce({sql_lookup(SPEC_TYPES, f"replace({kind}, '?', '')")}, 'string') END"


@query("endpoints_raw", sql=f"SELECT ordinal, {sql_spec_type('return_type')} AS type FROM endpoints_raw")
def map_spec_type(endpoints: DataFrame) -> DataFrame:
    return endpoints.select("ordinal", spec_type(F.col("return_type")).alias("type"))


@query("parameters", sql=f"SELECT id, coalesce({sql_lookup(LOCATIONS, 'source')}, 'query') AS location FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'body' WHEN 1 THEN 'route' WHEN 2 THEN 'form' WHEN 3 THEN 'header' END AS source FROM parameters)", prepare=lambda p: (p.select("id", F.get(F.array(F.lit("body"), F.lit("route"), F.lit("form"), F.lit("header")), (F.col("id") % 5).cast("int")).alias("source")),))
def param_location(parameters: DataFrame) -> DataFrame:
    """Where a parameter is sent; in the query by default."""
    return parameters.select("id", F.coalesce(lookup(LOCATIONS, F.coalesce("source", F.lit(""))), F.lit("query")).alias("location"))


# Constraints that a parameter may have, by the column that holds each, and those that validations are translated to.
CONSTRAINTS = {"min": "min_value", "max": "max_value", "minLength": "min_length", "maxLength": "max_length", "pattern": "pattern", "enum": "enum", "format": "format", "multipleOf": "multiple_of"}
VALIDATIONS = {"min_length": "minLength", "max_length": "maxLength", "pattern": "pattern"}


def constraints_of(parameters: DataFrame) -> Column:
    """Map of the constraints that a parameter has; what its validations (type, value) say replaces them, the last of a type first."""
    given = {k: F.col(c).cast("string") for k, c in CONSTRAINTS.items() if c in parameters.columns}

    def last(kind: str) -> Column:
        stated = F.filter("validations", lambda v: (v["type"] == kind) & v["value"].isNotNull())
        return F.try_element_at(F.transform(stated, lambda v: v["value"].cast("string")), F.lit(-1))

    if "validations" in parameters.columns:
        for kind, name in VALIDATIONS.items():
            given[name] = F.coalesce(last(kind), given[name]) if name in given else last(kind)
    return F.map_filter(F.create_map(*[x for k, c in given.items() for x in (F.lit(k), c)]), lambda k, v: v.isNotNull())


def _constrained(parameters: DataFrame) -> DataFrame:
    i, odd = F.col("id"), F.col("id") % 2 == 1
    stated = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))
    validations = F.array(stated("min_length", i % 7), stated("pattern", F.lit("p")), stated("min_length", F.when(i % 3 == 0, i % 5)), stated("custom", i))
    return parameters.select(
        "*",
        F.when(i % 4 == 0, "^[a-z]+$").alias("pattern"),
        F.when(i % 6 == 0, "a|b").alias("enum"),
        F.when(i % 5 == 0, "date").alias("format"),
        F.when(i % 9 == 0, 3).alias("multiple_of"),
        F.when(odd, validations).alias("validations"),
    )


@query(
    "parameters",
    prepare=lambda p: (_constrained(p),),
    sql="""SELECT id, array_to_string(list_filter(['enum=' || CASE WHEN id % 6 = 0 THEN 'a|b' END, 'format=' || CASE WHEN id % 5 = 0 THEN 'date' END, 'max=' || max_value, 'maxLength=' || max_length, 'min=' || min_value,
    'minLength=' || CASE WHEN id % 2 = 0 THEN min_length WHEN id % 3 = 0 THEN id % 5 ELSE id % 7 END, 'multipleOf=' || CASE WHEN id % 9 = 0 THEN 3 END, 'pattern=' || CASE WHEN id % 2 = 1 THEN 'p' WHEN id % 4 = 0 THEN '^[a-z]+$' END], lambda x: x IS NOT NULL), ';') AS constraints FROM parameters""",
)
def param_constraints(parameters: DataFrame) -> DataFrame:
    """The known constraints that a parameter has, by name."""
    entries = F.array_sort(F.map_entries(constraints_of(parameters)))
    return parameters.select("id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("constraints"))


def auth_of(endpoints: DataFrame) -> Column:
    """Authorisation as (required, type, scopes): the record ``authorization`` as it is, else what auth_required and auth_type say."""
    has = lambda c, default: F.coalesce(F.col(c), default) if c in endpoints.columns else default
    none = F.array().cast("array<string>")
    flags = F.struct(has("auth_required", has("authorization_required", F.lit(False))).alias("required"), has("auth_type", F.lit(None).cast("string")).alias("type"), none.alias("scopes"))
    if "authorization" not in endpoints.columns:
        return flags
    given = F.col("authorization")
    return F.when(given.isNotNull(), F.struct(F.coalesce(given["required"], F.lit(False)).alias("required"), given["type"].alias("type"), F.coalesce(given["scopes"], none).alias("scopes"))).otherwise(flags)


def _guarded(endpoints: DataFrame) -> DataFrame:
    n = F.col("ordinal")
    record = F.struct(F.col("authorization_required").alias("required"), F.lit("bearer").alias("type"), F.array(F.lit("read"), F.concat(F.lit("s"), n % 2)).alias("scopes"))
    return endpoints.select("*", F.when(n % 3 == 0, record).alias("authorization"), (n % 2 == 0).alias("auth_required"), F.when(n % 4 == 1, "apiKey").alias("auth_type"))


@query(
    "endpoints_raw",
    prepare=lambda e: (_guarded(e),),
    sql="""SELECT ordinal, CASE WHEN ordinal % 3 = 0 THEN authorization_required ELSE ordinal % 2 = 0 END AS required, CASE WHEN ordinal % 3 = 0 THEN 'bearer' WHEN ordinal % 4 = 1 THEN 'apiKey' END AS type,
    CASE WHEN ordinal % 3 = 0 THEN 'read,s' || (ordinal % 2) ELSE '' END AS scopes FROM endpoints_raw""",
)
def endpoint_auth(endpoints: DataFrame) -> DataFrame:
    """Authorisation that an endpoint needs: whether it does, of which type, with which scopes."""
    return endpoints.select("ordinal", auth_of(endpoints).alias("a")).select("ordinal", "a.required", "a.type", F.array_join("a.scopes", ",").alias("scopes"))


_KIND = f"CASE WHEN {SQL_METHOD} IN ('POST', 'PUT', 'PATCH') THEN 'mutation' WHEN {SQL_METHOD} = 'GET' THEN 'query' WHEN {SQL_METHOD} = 'DELETE' THEN 'deletion' END"
_EXPLICIT = "CASE WHEN ordinal % 3 = 0 THEN ['beta', controller] WHEN ordinal % 3 = 1 THEN ['query', NULL, 'alpha'] ELSE []::VARCHAR[] END"
_TAGS = f"array_to_string(list_sort(list_distinct(list_concat([controller, {_KIND}], {_EXPLICIT}))), ',')"


def _tagged(endpoints: DataFrame) -> DataFrame:
    n = F.col("ordinal") % 3
    return endpoints.withColumn("tags", F.when(n == 0, F.array(F.lit("beta"), "controller")).when(n == 1, F.array(F.lit("query"), F.lit(None), F.lit("alpha"))))


@query("endpoints_raw", prepare=lambda e: (_tagged(e),), sql=f"SELECT ordinal, {_TAGS} AS tags FROM endpoints_raw")
def endpoint_tags(endpoints: DataFrame) -> DataFrame:
    """Distinct tags: controller, the endpoint's own ``tags``, and mutation, query or deletion by method."""
    return endpoints.select("ordinal", F.array_join(tags_of(endpoints), ",").alias("tags"))


def _first_given(endpoints: DataFrame, names: tuple[str, ...], default: str) -> Column:
    """The first of the columns, of those that the table has, that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names if c in endpoints.columns], F.lit(default))


def method_of(endpoints: DataFrame) -> Column:
    return F.upper(_first_given(endpoints, ("method", "http_method"), "GET"))


def tags_of(endpoints: DataFrame) -> Column:
    m = method_of(endpoints)
    kind = F.when(m.isin("POST", "PUT", "PATCH"), "mutation").when(m == "GET", "query").when(m == "DELETE", "deletion")
    own = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in endpoints.columns else F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(F.col("controller"), kind), own))))


def _renamed(endpoints: DataFrame) -> DataFrame:
    """Some endpoints name their path route or url, and their method function_name or name, as other languages' parsers do."""
    n = F.col("ordinal")
    rows = _tagged(_guarded(endpoints)).withColumn("method", F.when(n % 8 == 0, "options"))
    rows = rows.withColumn("route", F.when(n % 7 == 0, F.col("path"))).withColumn("url", F.when(n % 11 == 0, F.col("path"))).withColumn("path", F.when((n % 7 == 0) | (n % 11 == 0), F.lit("")).otherwise(F.col("path")))
    return rows.withColumn("function_name", F.when(n % 5 == 2, F.concat(F.lit("fn"), n))).withColumn("name", F.when(n % 5 == 4, F.concat(F.lit("any"), n)))


_METHOD9 = f"CASE WHEN ordinal % 8 = 0 THEN 'OPTIONS' ELSE {SQL_METHOD} END"
_LOCATION = f"coalesce({sql_lookup(LOCATIONS, 'p.source')}, 'query')"


@query(
    "endpoints_raw",
    prepare=lambda e: (_renamed(e),),
    sql=f"""SELECT ordinal, {SQL_PATH} AS path, {_METHOD9} AS method, CASE WHEN ordinal % 5 = 2 THEN 'fn' || ordinal WHEN method_name IS NOT NULL THEN method_name WHEN ordinal % 5 = 4 THEN 'any' || ordinal ELSE 'unknown' END AS name, {sql_type_of('return_type')} AS return_type,
    array_to_string(list_transform(parameters, lambda p: p.name || ':' || {sql_type_of('p.type')} || ':' || {_LOCATION} || ':' || coalesce(p.required, false)), ',') AS parameters,
    CASE WHEN ordinal % 3 = 0 THEN authorization_required ELSE ordinal % 2 = 0 END AS auth_required, {_TAGS.replace(SQL_METHOD, '(' + _METHOD9 + ')')} AS tags FROM endpoints_raw""",
)
def normalize_endpoints(endpoints: DataFrame) -> DataFrame:
    """Every endpoint with normalised path, method, name, types, parameters (name:type:location:required), authorisation and tags.

    The path is whichever of path, route and url is given, the name the first of function_name, method_name and name, the method that
    of method and http_method. Columns that the table lacks count as missing.
    """
    one = lambda p: F.concat_ws(":", p["name"], type_of(p["type"]), F.coalesce(lookup(LOCATIONS, F.coalesce(p["source"], F.lit(""))), F.lit("query")), F.coalesce(p["required"], F.lit(False)).cast("string"))
    return endpoints.select(
        "ordinal",
        path_of(F.nullif(_first_given(endpoints, ("path", "route", "url"), ""), F.lit(""))).alias("path"),
        method_of(endpoints).alias("method"),
        _first_given(endpoints, ("function_name", "method_name", "name"), "unknown").alias("name"),
        type_of(F.col("return_type")).alias("return_type"),
        F.array_join(F.transform("parameters", one), ",").alias("parameters"),
        auth_of(endpoints)["required"].alias("auth_required"),
        F.array_join(tags_of(endpoints), ",").alias("tags"),
    )


_SEG = f"list_filter(string_split({SQL_PATH}, '/'), lambda x: x <> '')"
_RES = rf"CASE WHEN regexp_full_match(coalesce({_SEG}[1], ''), 'v\d+') THEN coalesce({_SEG}[2], 'root') ELSE coalesce({_SEG}[1], 'root') END"


@query("endpoints_raw", sql=f"SELECT {_RES} AS resource, row_number() OVER (PARTITION BY {_RES} ORDER BY ordinal) - 1 AS position, count(*) OVER (PARTITION BY {_RES}) AS n, {SQL_METHOD} || ' ' || {SQL_PATH} AS endpoint FROM endpoints_raw")
def endpoints_by_resource(endpoints: DataFrame) -> DataFrame:
    """Endpoints of each resource (the first path segment that is no version), numbered in their order, and how many it has.

    Endpoints stay rows and are numbered over range partitions, so a resource may hold any number of them.
    """
    segments = F.filter(F.split(path_of(F.col("path")), "/"), lambda x: x != "")
    first = F.get(segments, F.lit(0))
    resource = F.coalesce(F.when(first.rlike(r"^v\d+$"), F.get(segments, F.lit(1))).otherwise(first), F.lit("root"))
    line = F.concat_ws(" ", F.upper(F.coalesce("http_method", F.lit("GET"))), path_of(F.col("path")))
    rows = stored(numbered(endpoints.select(resource.alias("resource"), "ordinal", line.alias("endpoint")), ["resource"], ["ordinal"], "position"))
    sizes = stored(rows.groupBy("resource").agg(F.count(F.lit(1)).alias("n")).withColumn("_n", F.col("n")))
    return with_group_values(rows, sizes, "resource", "_n").select("resource", "position", "n", "endpoint")


def _latest(endpoints: DataFrame) -> DataFrame:
    """The last endpoint of each (path, method)."""
    rows = endpoints.select(F.coalesce("path", F.lit("/unknown")).alias("path"), F.upper(F.coalesce("http_method", F.lit("GET"))).alias("method"), "ordinal", "controller", "method_name", "authorization_required")
    last = F.max_by(F.struct("controller", "method_name", "authorization_required", "ordinal"), "ordinal").alias("e")
    return rows.groupBy("path", "method").agg(last).select("path", "method", "e.*")


@query("endpoints_raw", sql=f"SELECT coalesce(path, '/unknown') || '_' || {SQL_METHOD} AS doc_id, arg_max('Operation: ' || coalesce(method_name, '') || chr(10) || 'Controller: ' || coalesce(controller, ''), ordinal) AS content FROM endpoints_raw GROUP BY 1")
def format_operation_document(endpoints: DataFrame) -> DataFrame:
    """One document for each operation of the specification."""
    text = F.concat(F.lit("Operation: "), F.coalesce("method_name", F.lit("")), F.lit("\nController: "), F.coalesce("controller", F.lit("")))
    return _latest(endpoints).select(F.concat_ws("_", "path", "method").alias("doc_id"), text.alias("content"))


@query("endpoints_raw", sql="SELECT controller, min(ordinal) AS first_seen FROM endpoints_raw GROUP BY 1 ORDER BY 2")
def controllers(endpoints: DataFrame) -> DataFrame:
    """Controllers in the order in which they are first seen."""
    return endpoints.groupBy(F.coalesce("controller", F.lit("Unknown")).alias("controller")).agg(F.min("ordinal").alias("first_seen")).orderBy("first_seen")


_RECORD = "ordinal, kind, name, path, http_method, controller, return_type, parameters"
_KINDS_SQL = """(SELECT ordinal, CASE WHEN ordinal % 5 = 3 THEN 'models' ELSE 'endpoints' END AS kind, CASE WHEN ordinal % 9 <> 4 THEN coalesce(method_name, 'same') END AS name, path, http_method, controller, return_type,
    array_to_string(list_transform(parameters, lambda p: p.name || ':' || p.type), ',') AS parameters FROM endpoints_raw)"""
_ID = "CASE WHEN path IS NOT NULL AND http_method IS NOT NULL THEN 'p' || path || '_' || http_method WHEN name IS NOT NULL THEN 'n' || name ELSE 'r' || to_json([name, path, http_method, controller, return_type, parameters])::VARCHAR END"
_FIRSTS = f"SELECT {_RECORD} FROM {_KINDS_SQL} QUALIFY row_number() OVER (PARTITION BY kind, {_ID} ORDER BY ordinal) = 1"


def _records(endpoints: DataFrame) -> DataFrame:
    n = F.col("ordinal")
    parameters = F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",")
    kind = F.when(n % 5 == 3, "models").otherwise("endpoints")
    return endpoints.select("ordinal", kind.alias("kind"), F.when(n % 9 != 4, F.coalesce("method_name", F.lit("same"))).alias("name"), "path", "http_method", "controller", "return_type", parameters.alias("parameters"))


@query("endpoints_raw", prepare=lambda e: (_records(e),), sql=_FIRSTS)
def dedupe_parsed(records: DataFrame) -> DataFrame:
    """The first, by ordinal, of the parsed records that are the same: whole records, of whatever columns.

    Records are told apart by path and http_method if they have both, else by name, else by all that they hold but the ordinal. Kinds
    (if there is a column ``kind``) are told apart too.
    """
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    whole = F.to_json(F.struct(*[c for c in records.columns if c not in ("ordinal", "kind")]))
    key = F.coalesce(F.concat(F.lit("p"), has("path"), F.lit("_"), has("http_method")), F.concat(F.lit("n"), has("name")), F.concat(F.lit("r"), whole))
    first = records.groupBy(has("kind").alias("_kind"), key.alias("_key")).agg(F.min_by(F.struct(*records.columns), "ordinal").alias("r"))
    return first.select("r.*")


@query("endpoints_raw", prepare=lambda e: ([_records(e.where("ordinal % 2 = 0")), _records(e.where("ordinal % 3 <> 1")), _records(e.where("ordinal % 2 = 1"))],), sql=_FIRSTS)
def combine_parsed(parts: list[DataFrame]) -> DataFrame:
    """What several parsers found, together, without repeats."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return dedupe_parsed(whole)


_RISKS = f"list_filter([CASE WHEN NOT authorization_required THEN 'high: No authentication specified' END, CASE WHEN ordinal % 4 = 0 THEN 'medium: No explicit validation rules' END, CASE WHEN {SQL_METHOD} IN ('DELETE', 'PUT') THEN 'high: ' || {SQL_METHOD} || ' operation - data modification risk' END, CASE WHEN ordinal % 7 = 0 THEN 'high: File upload - security risk' END], lambda x: x IS NOT NULL)"


@query("endpoints_raw", sql=f"SELECT ordinal, array_to_string({_RISKS}, '; ') AS risks FROM endpoints_raw", prepare=lambda e: (e.withColumn("n_validators", F.col("ordinal") % 4).withColumn("consumes", F.when(F.col("ordinal") % 7 == 0, "multipart/form-data")),))
def assess_risks(endpoints: DataFrame) -> DataFrame:
    """Risks of an endpoint by rule."""
    m = F.upper(F.coalesce("http_method", F.lit("GET")))
    rules = F.array(
        F.when(~F.coalesce("authorization_required", F.lit(False)), "high: No authentication specified"),
        F.when(F.col("n_validators") == 0, "medium: No explicit validation rules"),
        F.when(m.isin("DELETE", "PUT"), F.concat(F.lit("high: "), m, F.lit(" operation - data modification risk"))),
        F.when(F.contains("consumes", F.lit("multipart/form-data")), "high: File upload - security risk"),
    )
    return endpoints.select("ordinal", F.array_join(F.array_compact(rules), "; ").alias("risks"))


_COMPLEX = f"len(parameters) + 5 * CAST({SQL_METHOD} IN ('POST', 'PUT', 'PATCH') AS INT) + ordinal % 5 + 2 * (ordinal % 4)"


@query("endpoints_raw", sql=f"SELECT ordinal, {_COMPLEX} AS points, CASE WHEN {_COMPLEX} < 5 THEN 'low' WHEN {_COMPLEX} < 15 THEN 'medium' ELSE 'high' END AS complexity FROM endpoints_raw", prepare=lambda e: (e.withColumn("n_responses", F.col("ordinal") % 5).withColumn("n_dependencies", F.col("ordinal") % 4),))
def assess_complexity(endpoints: DataFrame) -> DataFrame:
    """Points for parameters, body, responses and dependencies, and their class."""
    body = F.upper(F.coalesce("http_method", F.lit("GET"))).isin("POST", "PUT", "PATCH").cast("int")
    size = F.size(F.coalesce("parameters", F.array().cast(endpoints.schema["parameters"].dataType)))
    points = size + 5 * body + F.coalesce("n_responses", F.lit(0)) + 2 * F.coalesce("n_dependencies", F.lit(0))
    return endpoints.select("ordinal", points.alias("points"), F.when(points < 5, "low").when(points < 15, "medium").otherwise("high").alias("complexity"))


CONTEXT_SQL = f"""SELECT controller, query_text FROM (WITH e AS (SELECT controller, ordinal, {SQL_METHOD} || ' ' || coalesce(path, '/unknown') AS line, row_number() OVER (PARTITION BY controller ORDER BY ordinal) AS n FROM endpoints_raw),
    m AS (SELECT controller, return_type AS model, row_number() OVER (PARTITION BY controller ORDER BY min(ordinal), return_type) AS n FROM endpoints_raw GROUP BY 1, 2),
    l AS (SELECT controller, string_agg(model, ' ' ORDER BY n) AS models FROM m WHERE n <= 3 GROUP BY 1)
    SELECT controller, string_agg(line, ' ' ORDER BY n) || ' ' || controller || coalesce(' ' || any_value(models), '') AS query_text FROM e LEFT JOIN l USING (controller) WHERE n <= 5 GROUP BY 1)"""


@query("endpoints_raw", prepare=lambda e: (e, e.select("controller", "ordinal", F.col("return_type").alias("model"))), sql=CONTEXT_SQL)
def assemble_context(endpoints: DataFrame, models: DataFrame, first: int = 5, first_models: int = 3) -> DataFrame:
    """Query text of each controller's specification: its first endpoints, its name and its first models (controller, ordinal, model).

    Endpoints and models without a controller belong together. Only the first rows of a controller are shuffled, so a hot one does
    not gather in a task.
    """
    line = F.concat_ws(" ", F.upper(F.coalesce("http_method", F.lit("GET"))), F.coalesce("path", F.lit("/unknown")))
    lines = _first_of(endpoints.select("controller", "ordinal", line.alias("line")), first, "ordinal", "line")
    seen = models.where("model is not null").groupBy("controller", "model").agg(F.min("ordinal").alias("ordinal"))
    named = _first_of(seen, first_models, "ordinal", "model").select(F.col("controller").alias("_of"), F.col("lines").alias("models"))
    text = F.concat_ws(" ", "lines", "controller", "models")
    return lines.join(named, F.col("controller").eqNullSafe(F.col("_of")), "left").select("controller", text.alias("query_text"))


def _first_of(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """controller and lines: the last of the columns in ``order`` in its first n rows, joined by spaces."""
    at = F.row_number().over(Window.partitionBy("controller").orderBy(*order))
    top = rows.withColumn("_n", at).where(F.col("_n") <= n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", order[-1]))), lambda x: x[order[-1]]), " ")
    return top.groupBy("controller").agg(joined.alias("lines"))


_CODE = "CASE {0} WHEN 'GET' THEN 0.2 WHEN 'POST' THEN 0.4 WHEN 'PUT' THEN 0.6 WHEN 'DELETE' THEN 0.8 WHEN 'PATCH' THEN 1.0 ELSE 0.5 END".format(SQL_METHOD)
_KINDS = ("string", "integer", "boolean", "object", "array")
_SQL_KINDS = ", ".join(f"len(list_filter(parameters, lambda p: {sql_type_of('p.type')} = '{k}')) / greatest(len(parameters), 1)" for k in _KINDS)


@query(
    "endpoints_raw",
    sql=f"SELECT ordinal, list_concat([len(parameters) / 10.0, {_SQL_KINDS}, {_CODE}, CASE WHEN authorization_required THEN 1.0 ELSE 0.0 END, (ordinal % 5) / 10.0, (ordinal % 4) / 10.0]::DOUBLE[], list_transform(range(118), lambda x: 0.0::DOUBLE)) AS features FROM endpoints_raw",
    prepare=lambda e: (e.withColumn("n_responses", F.col("ordinal") % 5).withColumn("n_validators", F.col("ordinal") % 4),),
)
def api_features(endpoints: DataFrame, size: int = 128) -> DataFrame:
    """Feature vector of an endpoint: parameters, share of each type, method, authorisation, responses, validators; padded with zeros."""
    m = F.upper(F.coalesce("http_method", F.lit("GET")))
    code = F.when(m == "GET", 0.2).when(m == "POST", 0.4).when(m == "PUT", 0.6).when(m == "DELETE", 0.8).when(m == "PATCH", 1.0).otherwise(0.5)
    n = F.size("parameters")
    kinds = F.transform("parameters", lambda p: type_of(p["type"]))
    shares = [(n - F.size(F.array_remove(kinds, k))) / F.greatest(n, F.lit(1)) for k in _KINDS]
    parts = [n / 10.0, *shares, code, F.coalesce("authorization_required", F.lit(False)).cast("double"), F.col("n_responses") / 10.0, F.col("n_validators") / 10.0]
    return endpoints.select("ordinal", F.concat(F.array(*parts), F.array_repeat(F.lit(0.0), size - len(parts))).alias("features"))


@query("test_cases", sql="SELECT ordinal, 'http://api' || replace(endpoint, '{id}', CAST(k AS VARCHAR)) AS url FROM test_cases", prepare=lambda c: (c.withColumn("test_data", F.create_map(F.lit("id"), F.col("k").cast("string"))), "http://api/"))
def build_url(requests: DataFrame, base: str) -> DataFrame:
    """URL of a request: path parameters from the test data, else its id, else 1; as written without test data.
    A request without an endpoint has no URL."""
    named = F.regexp_extract_all("endpoint", F.lit(r"\{(\w+)\}"), F.lit(1))
    filled = F.aggregate(named, F.col("endpoint"), lambda url, p: F.replace(url, F.concat(F.lit("{"), p, F.lit("}")), F.coalesce(F.try_element_at("test_data", p), F.try_element_at("test_data", F.lit("id")), F.lit("1"))))
    path = F.when(F.size("test_data") > 0, filled).otherwise(F.col("endpoint"))
    whole = F.when(path == "", F.lit(base.rstrip("/"))).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(path, F.lit("/"))))
    return requests.select("ordinal", whole.alias("url"))


#: Headers of every request.
HEADERS = {"Content-Type": "application/json", "Accept": "application/json"}


def _updated(there: Column, more: Column) -> Column:
    """A map with the entries of another, which win."""
    return F.map_concat(F.map_filter(there, lambda k, _: ~F.map_contains_key(more, k)), more)


@query(
    "test_cases",
    prepare=lambda c: (
        c.select(
            "*",
            F.create_map(F.lit("id"), F.col("k").cast("string")).alias("test_data"),
            F.concat(F.lit("t"), "suite_id").alias("auth_token"),
            F.when(F.col("k") % 3 == 0, F.create_map(F.lit("Accept"), F.lit("text/plain"), F.lit("X-Suite"), F.col("suite_id").cast("string"))).alias("headers"),
        ),
    ),
    sql="""SELECT ordinal, CASE WHEN upper(method) IN ('GET', 'DELETE') THEN 'id=' || k END AS query_params, CASE WHEN upper(method) IN ('POST', 'PUT', 'PATCH') THEN '{"id":"' || k || '"}' END AS body,
    CASE WHEN k % 3 = 0 THEN ['Accept: text/plain', 'Authorization: Bearer t' || suite_id, 'Content-Type: application/json', 'X-Suite: ' || suite_id] ELSE ['Accept: application/json', 'Authorization: Bearer t' || suite_id, 'Content-Type: application/json'] END AS headers FROM test_cases""",
)
def request_shape(requests: DataFrame) -> DataFrame:
    """Query parameters or JSON body by method, and header lines in order: the usual ones, then the request's own ``headers``, then its
    ``auth_token``; later ones replace earlier ones."""
    m = F.upper("method")
    pairs = F.array_join(F.transform(F.map_entries("test_data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    token = F.when(F.col("auth_token").isNotNull(), F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer "), "auth_token")))
    merged = F.create_map(*[F.lit(x) for kv in HEADERS.items() for x in kv])
    for more in (own, F.coalesce(token, F.create_map().cast("map<string,string>"))):
        merged = _updated(merged, more)
    return requests.select(
        "ordinal",
        F.when(m.isin("GET", "DELETE"), pairs).alias("query_params"),
        F.when(m.isin("POST", "PUT", "PATCH"), F.to_json("test_data")).alias("body"),
        F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))).alias("headers"),
    )
