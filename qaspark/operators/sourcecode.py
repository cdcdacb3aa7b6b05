"""Endpoints, models, validators and dependencies of source files, by regular expressions over blocks of code and over scopes.

Every parser is a set of columns over ``source_files`` (path, language, code): code is split where an annotation starts, so that an
annotation belongs to the method after it, and each block gives one row. Further languages register in ``PARSERS``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.operators.scopes import with_scopes
from qaspark.registry import query

# File endings by language, and flags of inline validation.
LANGUAGES = {".cs": "csharp", ".py": "python", ".java": "java", ".cpp": "cpp"}
CHECKS = {
    "null_check": r"(?i)if\s*\(.*?(?:==|!=)\s*null",
    "empty_check": r"(?i)if\s*\(.*?\.(?:isEmpty|empty|Length\s*==\s*0)",
    "range_check": r"(?i)if\s*\(.*?(?:<|>|<=|>=)\s*\d+",
    "regex_check": r"(?i)if\s*\(.*?\.(?:matches|test|match)\(",
    "type_check": r"(?i)if\s*\(.*?instanceof",
    "custom_validation": r"(?i)if\s*\(.*?(?:isValid|validate|check)",
}



def _blocks(files: DataFrame, language: str, start: str, marker: str) -> DataFrame:
    rows = files.where(F.col("language") == language)
    return rows.select("path", "language", "code", F.posexplode(F.split("code", start)).alias("ordinal", "block")).where(F.col("block").rlike(marker))


def _first(pattern: str, group: int = 1, c: str = "block") -> Column:
    return F.regexp_extract(c, pattern, group)


def _clean(route: Column) -> Column:
    one = F.regexp_replace(F.concat(F.lit("/"), route), "/+", "/")
    return F.when((F.length(one) > 1) & F.endswith(one, F.lit("/")), F.substring(one, F.lit(1), F.length(one) - 1)).otherwise(one)


def _arguments(parameters: Column) -> Column:
    """The parameters of a signature, one by one: commas within parentheses do not part them."""
    return F.filter(F.transform(F.split(parameters, r",(?![^(]*\))"), lambda x: F.trim(x)), lambda x: x != "")


def _source(argument: Column, marks: dict[str, str], default: str) -> Column:
    found = [F.when(F.contains(argument, F.lit(mark)), source) for mark, source in marks.items()]
    return F.coalesce(*found, F.lit(default))


# Where a parameter comes from, by what marks it.
CSHARP_SOURCES = {"[FromBody]": "body", "[FromQuery]": "query", "[FromRoute]": "route"}
JAVA_SOURCES = {"@PathVariable": "path", "@RequestParam": "query", "@RequestBody": "body"}
FASTAPI_SOURCES = {"Query": "query", "Path": "path", "Body": "body", "Header": "header"}


@query(
    "source_files",
    sql="""SELECT path, 'T' || p_partkey || 'Controller' AS controller, m AS method_name, CASE m WHEN 'GetOne' THEN 'GET' ELSE 'POST' END AS http_method, '/api/things/' || p_partkey || CASE m WHEN 'GetOne' THEN '/{id}' ELSE '' END AS route,
    CASE m WHEN 'GetOne' THEN 'id:int:route' ELSE 'item:Item:body,n' || p_partkey || ':int?:query' END AS parameters, m = 'GetOne' AS authorized, CASE m WHEN 'GetOne' THEN 'Read' || p_partkey ELSE '' END AS policy
    FROM source_files, unnest(['GetOne', 'Create']) t(m) WHERE language = 'csharp'""",
    prepare=lambda f: (f,),
)
def endpoints_csharp(files: DataFrame) -> DataFrame:
    """Actions of ASP.NET controllers; the base route gets the api/ prefix. Parameters come as name:type:source, from the route by default."""
    verb = r"\[Http(Get|Post|Put|Delete|Patch)(?:\(\"([^\"]*)\"\))?\]"
    signature = r"public\s+(?:async\s+)?(?:Task<)?(?:ActionResult(?:<[^>]*>)?|IActionResult)>?\s+(\w+)\s*\(([^)]*)\)"
    rows = _blocks(files, "csharp", r"(?=\[Http(?:Get|Post|Put|Delete|Patch))", verb).where(F.col("block").rlike(signature))
    base = _first(r"\[Route\(\"([^\"]+)\"\)\]", 1, "code")
    base = F.when((base == "") | F.startswith(base, F.lit("api/")), base).otherwise(F.concat(F.lit("api/"), base))
    guarded = F.col("block").rlike(r"\[Authorize") | F.get(F.split("code", r"public\s+class"), F.lit(0)).rlike(r"\[Authorize")
    named = lambda x: F.regexp_replace(x, r"^(?:\[[^\]]*\]\s*)?(\S+)\s+(\w+).*$", "$2:$1")
    arguments = F.transform(_arguments(_first(signature, 2)), lambda x: F.concat_ws(":", named(x), _source(x, CSHARP_SOURCES, "route")))
    return rows.select(
        "path",
        _first(r"public\s+class\s+(\w+)", 1, "code").alias("controller"),
        _first(signature).alias("method_name"),
        F.upper(_first(verb)).alias("http_method"),
        _clean(F.concat_ws("/", base, _first(verb, 2))).alias("route"),
        F.array_join(arguments, ",").alias("parameters"),
        guarded.alias("authorized"),
        _first(r"\[Authorize\([^\]]*?Policy\s*=\s*\"([^\"]*)\"").alias("policy"),
    )


@query(
    "source_files",
    sql="""SELECT path, 'T' || p_partkey || 'Api' AS controller, m AS method_name, CASE m WHEN 'find' THEN 'GET' ELSE 'DELETE' END AS http_method, '/things' || p_partkey || '/{id}' AS route,
    CASE m WHEN 'find' THEN 'id:Long:path' ELSE 'id:Long:path,q' || p_partkey || ':String:query' END AS parameters FROM source_files, unnest(['find', 'remove']) t(m) WHERE language = 'java'""",
)
def endpoints_java(files: DataFrame) -> DataFrame:
    """Handlers of Spring controllers; an annotation binds to the method after it. Annotated parameters come as name:type:source, under
    the name that the annotation gives them, if any."""
    verb = r"@(Get|Post|Put|Delete|Patch)Mapping(?:\(\s*(?:value\s*=\s*)?\"([^\"]*)\"[^)]*\))?"
    signature = r"(?:public|private|protected)\s+[\w<>\[\],\s?]+?\s+(\w+)\s*\((.*?)\)\s*(?:throws\s+\w+\s*)?\{"
    rows = _blocks(files, "java", r"(?=@(?:Get|Post|Put|Delete|Patch)Mapping)", verb).where(F.col("code").rlike(r"@(?:Rest)?Controller") & F.col("block").rlike(signature))
    given = lambda x: F.nullif(F.regexp_extract(x, r"@\w+\(\s*(?:(?:value|name)\s*=\s*)?\"(\w+)\"", 1), F.lit(""))
    plain = lambda x, i: F.regexp_extract(x, r"(\S+)\s+(\w+)$", i)
    marked = F.filter(_arguments(_first(signature, 2)), lambda x: x.rlike("@(?:PathVariable|RequestParam|RequestBody)"))
    arguments = F.transform(marked, lambda x: F.concat_ws(":", F.coalesce(given(x), plain(x, 2)), plain(x, 1), _source(x, JAVA_SOURCES, "")))
    return rows.select(
        "path",
        _first(r"class\s+(\w+)", 1, "code").alias("controller"),
        _first(signature).alias("method_name"),
        F.upper(_first(verb)).alias("http_method"),
        _clean(F.concat_ws("/", _first(r"@RequestMapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"", 1, "code"), _first(verb, 2))).alias("route"),
        F.array_join(arguments, ",").alias("parameters"),
    )


@query("source_files", sql="SELECT path, 'flask' AS framework, f AS function_name, m AS http_method, '/things' || p_partkey || CASE f WHEN 'one' THEN '/<int:id>' ELSE '' END AS route, '' AS parameters FROM source_files, (VALUES ('one', 'GET'), ('one', 'PUT'), ('every', 'GET')) t(f, m) WHERE p_partkey % 5 = 2 UNION ALL SELECT path, 'fastapi', f, m, '/things' || p_partkey || CASE f WHEN 'one' THEN '/{id}' ELSE '' END, CASE f WHEN 'one' THEN 'id:int:body:required,q:str:query:optional' ELSE 'item:Item' || p_partkey || ':body:required' END FROM source_files, (VALUES ('one', 'GET'), ('create', 'POST')) t(f, m) WHERE p_partkey % 5 = 3")
def endpoints_python(files: DataFrame) -> DataFrame:
    """Routes of Flask (a row for each method, GET by default), FastAPI and Django.

    FastAPI's typed parameters come as name:type:source:required or optional; they are from the body unless their default says otherwise.
    """
    name = r"def\s+(\w+)\s*\("
    flask = r"@\w+\.route\(['\"]([^'\"]+)['\"](?:[^)]*?methods=\[([^\]]*)\])?"
    rows = _blocks(files, "python", r"(?=@\w+\.route\()", flask)
    methods = F.transform(F.split(F.when(_first(flask, 2) == "", "GET").otherwise(_first(flask, 2)), ","), lambda m: F.upper(F.regexp_replace(m, r"[\s'\"]", "")))
    found = rows.select("path", F.lit("flask").alias("framework"), _first(name).alias("function_name"), F.explode(methods).alias("http_method"), _first(flask).alias("route"), F.lit("").alias("parameters"))
    fast = r"@(?:app|router)\.(get|post|put|delete|patch)\(['\"]([^'\"]+)['\"]"
    typed = r"(\w+)\s*:\s*([\w\[\].]+)(?:\s*=\s*([^,)]+))?"
    part = lambda x, i: F.regexp_extract(x, typed, i)
    needed = lambda default: F.when((default == "") | F.contains(default, F.lit("...")), "required").otherwise("optional")
    listed = F.regexp_extract_all(_first(r"def\s+\w+\s*\(((?:[^()]|\([^()]*\))*)\)"), F.lit(typed), F.lit(0))
    arguments = F.transform(listed, lambda x: F.concat_ws(":", part(x, 1), part(x, 2), _source(part(x, 3), FASTAPI_SOURCES, "body"), needed(part(x, 3))))
    rows = _blocks(files, "python", r"(?=@(?:app|router)\.(?:get|post|put|delete|patch)\()", fast)
    found = found.unionByName(rows.select("path", F.lit("fastapi").alias("framework"), _first(name).alias("function_name"), F.upper(_first(fast)).alias("http_method"), _first(fast, 2).alias("route"), F.array_join(arguments, ",").alias("parameters")))
    django = r"\bpath\(\s*['\"][^'\"]*['\"]\s*,\s*[\w.]+"
    each = files.where(F.col("language") == "python").select("path", F.explode(F.regexp_extract_all("code", F.lit(django), F.lit(0))).alias("block"))
    return found.unionByName(each.select("path", F.lit("django").alias("framework"), _first(r",\s*(?:\w+\.)*(\w+)$").alias("function_name"), F.lit("GET").alias("http_method"), F.concat(F.lit("/"), _first(r"['\"]([^'\"]*)['\"]")).alias("route"), F.lit("").alias("parameters")))


@query("source_files", sql="SELECT path, 'crow' AS framework, m AS http_method, '/things' || p_partkey || '/<int>' AS route FROM source_files, unnest(['GET', 'POST']) t(m) WHERE language = 'cpp' UNION ALL SELECT path, 'cpprest', 'GET', '/rest' || p_partkey FROM source_files WHERE language = 'cpp'")
def endpoints_cpp(files: DataFrame) -> DataFrame:
    """Routes of Crow and Restbed (routes by methods), Pistache handlers, and cpprest handlers under the route that they name or else
    the path of their listener's address."""
    code = files.where(F.col("language") == "cpp")
    crow = r"CROW_ROUTE\(\w+,\s*\"([^\"]+)\"\)(?:\s*\.methods\(([^)]*)\))?"
    rows = _blocks(files, "cpp", r"(?=CROW_ROUTE\()", crow)
    quoted = F.transform(F.regexp_extract_all(_first(crow, 2), F.lit(r"\"?(\w+)\"?_method"), F.lit(1)), lambda m: F.upper(m))
    methods = F.when(F.size(quoted) > 0, quoted).otherwise(F.array(F.lit("GET")))
    found = rows.select("path", F.lit("crow").alias("framework"), F.explode(methods).alias("http_method"), _first(crow).alias("route"))
    pistache = r"Routes::(?:Get|Post|Put|Delete|Patch)\(\w+,\s*\"[^\"]+\""
    each = code.select("path", F.explode(F.regexp_extract_all("code", F.lit(pistache), F.lit(0))).alias("block"))
    found = found.unionByName(each.select("path", F.lit("pistache").alias("framework"), F.upper(_first(r"Routes::(\w+)")).alias("http_method"), _first(r"\"([^\"]+)\"").alias("route")))
    verbs = F.regexp_extract_all("code", F.lit(r"set_method_handler\(\s*\"(\w+)\""), F.lit(1))
    restbed = code.select("path", "code", F.explode(F.regexp_extract_all("code", F.lit(r"set_path\(\s*\"([^\"]+)\""), F.lit(1))).alias("route")).select("path", F.lit("restbed").alias("framework"), F.explode(verbs).alias("http_method"), "route")
    support = r"(\w+)\s*(?:\.|->)\s*support\(\s*(?:web::http::)?methods::(\w+)\s*,\s*(?:U\(\s*)?(?:\"([^\"]*)\")?"
    each = code.select("path", "code", F.explode(F.regexp_extract_all("code", F.lit(support), F.lit(0))).alias("block"))
    listener = F.concat(F.lit(r"\bhttp_listener\s+"), _first(support), F.lit(r"\s*[({]\s*(?:U\(\s*)?\"(?:\w+://[^/\"]*)?([^\"?#]*)"))
    own = F.regexp_replace(F.call_function("regexp_extract", F.col("code"), listener, F.lit(1)), r"(?<=.)/$", "")
    route = F.coalesce(F.nullif(_first(support, 3), F.lit("")), F.nullif(own, F.lit("")), F.lit("/"))
    rest = each.select("path", F.lit("cpprest").alias("framework"), F.upper(F.replace(_first(support, 2), F.lit("DEL"), F.lit("DELETE"))).alias("http_method"), route.alias("route"))
    return found.unionByName(restbed).unionByName(rest)


Parser = Callable[[DataFrame], DataFrame]
#: Parser of endpoints by language; ``register_parser`` adds others.
PARSERS: dict[str, Parser] = {"csharp": endpoints_csharp, "java": endpoints_java, "python": endpoints_python, "cpp": endpoints_cpp}


def register_parser(language: str, parser: Parser) -> None:
    """``all_endpoints`` gives ``parser`` the files of this language; it returns path, http_method and route at least."""
    PARSERS[language] = parser


@query("source_files", sql="""SELECT path, language, unnest(CASE p_partkey % 5 WHEN 0 THEN ['GET', 'POST'] WHEN 1 THEN ['GET', 'DELETE'] WHEN 2 THEN ['GET', 'PUT', 'GET'] WHEN 3 THEN ['GET', 'POST'] ELSE ['GET', 'POST', 'GET'] END) AS http_method,
    unnest(list_transform(CASE p_partkey % 5 WHEN 0 THEN ['/api/things/§/{id}', '/api/things/§'] WHEN 1 THEN ['/things§/{id}', '/things§/{id}'] WHEN 2 THEN ['/things§/<int:id>', '/things§/<int:id>', '/things§'] WHEN 3 THEN ['/things§/{id}', '/things§']
    ELSE ['/things§/<int>', '/things§/<int>', '/rest§'] END, lambda x: replace(x, '§', CAST(p_partkey AS VARCHAR)))) AS route FROM source_files""")
def all_endpoints(files: DataFrame) -> DataFrame:
    """path, language, http_method and route of the endpoints of all files, by each language's registered parser."""
    found = None
    for language, parser in PARSERS.items():
        part = parser(files.where(F.col("language") == language)).select("path", F.lit(language).alias("language"), "http_method", "route")
        found = part if found is None else found.unionByName(part)
    return found


_METHODS = """(VALUES (0, 'T§Controller', 'GetOne', 'Task<ActionResult<Item>>', 'int id', '{ if (id == null) { throw new Exception("no { §"); } /* } */ if (id < ¤) { return Ok("}"); } return Ok(); }'),
 (0, 'T§Controller', 'Create', 'IActionResult', '[FromBody] Item item, [FromQuery] int? n§', 'Ok(¤);'),
 (1, 'T§Api', 'find', 'Item', '@PathVariable Long id', '{ return repo.get(id); }'), (1, 'T§Api', 'remove', 'void', '@PathVariable Long id, @RequestParam("q§") String why', '{ log("}"); }'),
 (2, '', 'one', '', 'id', '    if id is None:~        return "def x(): §"~    return ¤'), (2, '', 'every', '', '', '    return []'),
 (3, '', 'one', '', 'id: int, q: str = Query(None)', '    return id'), (3, '', 'create', '', 'item: Item§', '    return item'), (3, 'Item§', 'check_size', '', 'cls, v', '        return v'),
 (4, '', 'main', 'int', '', '{~  CROW_ROUTE(app, "/things§/<int>").methods("GET"_method, "POST"_method)([](int id) { return ¤; });~  http_listener rest("http://0.0.0.0:80/rest§");~  rest.support(methods::GET, handle);~}'),
 (4, '', 'validateItem', 'bool', 'const Item§& i', '{ return true; }')) t(k, o, n, r, p, b)"""
_FILLED = "replace(replace(replace({}, '§', CAST(p_partkey AS VARCHAR)), '¤', CAST(p_size AS VARCHAR)), '~', chr(10))"


@query("source_files", sql=f"SELECT path, {_FILLED.format('o')} AS owner, n AS name, r AS return_type, {_FILLED.format('p')} AS parameters, {_FILLED.format('b')} AS body FROM source_files, {_METHODS} WHERE p_partkey % 5 = t.k")
def methods_inventory(files: DataFrame) -> DataFrame:
    """Methods and functions of every file: owner (the class around, or empty), return type (empty if none is given), parameters as
    written, and the body, also of braces in strings and comments, expression bodies and nested blocks; empty for a declaration."""
    rows = with_scopes(files, "method")
    return rows.select("path", "owner", "name", F.col("type").alias("return_type"), "parameters", "body")


@query("source_files", sql="SELECT path, CASE p_partkey % 5 WHEN 0 THEN 'Item' || p_partkey || 'Dto' ELSE 'Item' || p_partkey END AS model, f AS field, CASE p_partkey % 5 WHEN 0 THEN CASE f WHEN 'Name' THEN 'string' ELSE 'int?' END WHEN 1 THEN CASE f WHEN 'name' THEN 'String' ELSE 'int' END WHEN 3 THEN CASE f WHEN 'size' THEN 'int' ELSE 'str' END ELSE CASE f WHEN 'name' THEN 'std::string' ELSE 'int' END END AS type FROM source_files, (VALUES (0, 'Name'), (0, 'Size'), (1, 'name'), (1, 'size'), (3, 'name'), (3, 'size'), (3, 'code'), (4, 'name'), (4, 'size')) t(k, f) WHERE p_partkey % 5 = t.k")
def models_inventory(files: DataFrame) -> DataFrame:
    """Typed fields of data classes: C# DTOs, Java classes, pydantic models and dataclasses, C++ structs."""
    shapes = {
        "csharp": (r"(?=public\s+class\s+\w+)", r"public\s+class\s+(\w+(?:Dto|DTO|Model|Request|Response))\b", r"public\s+([\w<>?\[\]]+)\s+(\w+)\s*\{\s*get", 2, 1),
        "java": (r"(?m)(?=^(?:public\s+)?class\s+\w+)", r"class\s+(\w+)\s*\{", r"private\s+([\w<>]+)\s+(\w+)\s*;", 2, 1),
        "python": (r"(?m)(?=^@dataclass)|(?<!\)\n|dataclass\n)(?=^class\s+\w+)", r"(?:class\s+(?=\w+\([^)]*BaseModel)|@dataclass(?:\([^)]*\))?\s+class\s+)(\w+)(?:\([^)]*\))?:", r"(?m)^    (\w+):\s*([\w\[\], ]+?)\s*(?:=.*)?$", 1, 2),
        "cpp": (r"(?m)(?=^struct\s+\w+)", r"struct\s+(\w+)\s*\{", r"(?m)^\s+([\w:<>]+)\s+(\w+);", 2, 1),
    }
    found = None
    for language, (start, model, field, name, kind) in shapes.items():
        rows = _blocks(files, language, start, model)
        if language == "java":
            rows = rows.where(~F.col("block").rlike("@(?:Autowired|GetMapping|PostMapping)"))
        rows = rows.withColumn("block", F.when(F.lit(language == "python"), F.get(F.split("block", r"(?m)^(?=@(?!dataclass)|def |async )"), F.lit(0))).otherwise(F.col("block")))
        names, kinds = (F.regexp_extract_all("block", F.lit(field), F.lit(g)) for g in (name, kind))
        part = rows.select("path", _first(model).alias("model"), F.explode(F.arrays_zip(names.alias("field"), kinds.alias("type"))).alias("f")).select("path", "model", "f.field", "f.type")
        found = part if found is None else found.unionByName(part)
    return found


@query(
    "source_files",
    sql="""SELECT path, 'Item' || p_partkey || 'Validator' AS validator, f AS field, replace(r, '¤', CAST(p_size AS VARCHAR)) AS rules FROM source_files, (VALUES ('Name', 'NotEmpty,MaximumLength(¤),Matches("[(].*;$")'), ('Size', 'GreaterThan(0)')) t(f, r) WHERE p_partkey % 5 = 0
    UNION ALL SELECT path, 'Item' || p_partkey, 'name', 'NotNull,Size(min = ' || p_size || ')' FROM source_files WHERE p_partkey % 5 = 1
    UNION ALL SELECT path, 'Item' || p_partkey, f, replace(r, '¤', CAST(p_size AS VARCHAR)) FROM source_files, (VALUES ('code', 'min_length(2),max_length(¤),regex([a-z]+$)'), ('size', 'custom:check_size')) t(f, r) WHERE p_partkey % 5 = 3
    UNION ALL SELECT path, 'validateItem', '', 'function' FROM source_files WHERE p_partkey % 5 = 4""",
)
def validators_inventory(files: DataFrame) -> DataFrame:
    """Rules with their parameters, each under its own class: fluent validators, bean annotations, pydantic field limits and validators
    (with the function's name), and C++ validate functions."""
    bean = r"((?:@\w+(?:\([^)]*\))?\s*)+)private\s+[\w<>]+\s+(\w+)"
    known = r"@((?:NotNull|NotBlank|NotEmpty|Size|Min|Max|Email|Pattern)\b(?:\([^)]*\))?)"
    checked = r"@(?:field_)?validator\(\s*['\"]\w+['\"][^)]*\)\s*(?:@classmethod\s*)?(?:async\s+)?def\s+\w+"
    whole = r"@(?:root|model)_validator(?:\([^)]*\))?\s*(?:@classmethod\s*)?(?:async\s+)?def\s+\w+"
    stated = lambda field, rule: F.struct(field.alias("field"), rule.alias("rules"))
    custom = lambda x: F.concat(F.lit("custom:"), F.regexp_extract(x, r"def\s+(\w+)$", 1))
    blocks = lambda form: F.regexp_extract_all("body", F.lit(form), F.lit(0))
    marks = lambda x: F.array_join(F.regexp_extract_all(x, F.lit(known), F.lit(1)), ",")
    beans = F.filter(F.transform(blocks(bean), lambda x: stated(F.regexp_extract(x, bean, 2), marks(x))), lambda r: r["rules"] != "")
    fields = F.transform(blocks(checked), lambda x: stated(F.regexp_extract(x, r"validator\(\s*['\"](\w+)", 1), custom(x)))
    wholes = F.transform(blocks(whole), lambda x: stated(F.lit(""), custom(x)))
    every = F.when(F.col("language") == "java", F.concat("rules", beans)).when(F.col("language") == "python", F.concat("rules", fields, wholes)).otherwise(F.col("rules"))
    classes = with_scopes(files, "class")  # one pass for all forms
    found = classes.select("path", F.col("name").alias("validator"), F.explode(every).alias("r")).select("path", "validator", "r.field", "r.rules")
    rows = files.where("language = 'cpp'").select("path", F.explode(F.regexp_extract_all("code", F.lit(r"(?:bool|int)\s+(validate\w*)\s*\("), F.lit(1))).alias("validator"))
    return found.unionByName(rows.select("path", "validator", F.lit("").alias("field"), F.lit("function").alias("rules")))


@query("source_files", sql="SELECT d AS dependency, count(*) AS files FROM source_files, (VALUES (0, 'System'), (0, 'Shop.Core'), (1, 'java.util.List'), (1, 'org.shop.Item'), (2, 'os'), (2, 'flask'), (3, 'fastapi'), (3, 'pydantic'), (4, 'crow.h'), (4, 'string')) t(k, d) WHERE p_partkey % 5 = t.k GROUP BY 1")
def dependencies_inventory(files: DataFrame) -> DataFrame:
    """How many files use each dependency."""
    found = F.regexp_extract_all("code", F.lit(r"(?m)^(?:using\s+|import\s+|from\s+|#include\s+[<\"])([\w.]+)"), F.lit(1))
    return files.select("path", F.explode(F.array_distinct(found)).alias("dependency")).groupBy("dependency").agg(F.count(F.lit(1)).alias("files"))


@query("source_files", sql="SELECT path, 'IT' || p_partkey || 'Service' AS type, '_service' AS name FROM source_files WHERE p_partkey % 5 = 0 UNION ALL SELECT path, 'T' || p_partkey || 'Repo', 'repo' FROM source_files WHERE p_partkey % 5 = 1")
def services_inventory(files: DataFrame) -> DataFrame:
    """Injected services: private readonly fields in C#, autowired ones in Java."""
    form = r"(?:private\s+readonly|@Autowired\s+private)\s+([\w<>]+)\s+(\w+)\s*;"
    kinds, names = (F.regexp_extract_all("code", F.lit(form), F.lit(g)) for g in (1, 2))
    return files.select("path", F.explode(F.arrays_zip(kinds.alias("type"), names.alias("name"))).alias("s")).select("path", "s.type", "s.name")


@query("source_files", sql=f"SELECT path, n AS method, CASE WHEN n IN ('GetOne', 'one') AND t.k = 0 THEN 'null_check,range_check' ELSE '' END AS checks FROM source_files, {_METHODS} WHERE p_partkey % 5 = t.k")
def inline_validations(files: DataFrame) -> DataFrame:
    """Kinds of checks that each method makes by hand, inside its own body; strings and comments count for nothing."""
    found = F.array_compact(F.array(*[F.when(F.col("code").rlike(p), F.lit(n)) for n, p in CHECKS.items()]))
    rows = with_scopes(files, "method")
    return rows.select("path", F.col("name").alias("method"), F.array_join(found, ",").alias("checks"))


@query("source_files", sql="SELECT path, language, length(code) AS n_chars FROM source_files")
def read_source_files(files: DataFrame) -> DataFrame:
    """Language of each file by its ending (C# by default), and its length; ``read_code`` loads such files from a folder."""
    kind = F.coalesce(*[F.when(F.endswith("path", F.lit(e)), l) for e, l in LANGUAGES.items()], F.lit("csharp"))
    return files.select("path", kind.alias("language"), F.length("code").alias("n_chars"))


def read_code(spark, folder: str) -> DataFrame:
    """path, language and code of the files in a folder, each as one text."""
    kind = F.coalesce(*[F.when(F.endswith("path", F.lit(e)), l) for e, l in LANGUAGES.items()], F.lit("csharp"))
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("code")).withColumn("language", kind)
