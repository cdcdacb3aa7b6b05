"""Test cases of suites: flattening, parsing, classification and texts for retrieval."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.tables import small_batches, stored, with_group_values
from qaspark.registry import query

# Keywords by test type, in order of precedence, and words of edge cases and of fields.
TYPE_WORDS = {
    "validation": ("duplicate", "invalid", "negative", "fail", "error"),
    "authentication": ("auth", "login", "token", "permission"),
    "security": ("security", "injection", "xss", "csrf"),
    "edge_case": ("edge", "boundary", "limit", "null", "empty"),
    "happy_path": ("successful", "positive", "happy"),
}
EDGE_WORDS = ("duplicate", "invalid", "null", "empty", "boundary", "limit", "maximum", "minimum", "negative", "special")
FIELD_WORDS = ("email", "username", "id", "password", "license", "plate")
REQUEST = r"(?i)\b(GET|POST|PUT|DELETE|PATCH)\s+([/\w{}-]+)"
STATUS = r"\b(\d{3})\b"


def _sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _any(text: Column, words) -> Column:
    return text.rlike("|".join(words))


_TEXT = "lower(title || ' ' || description)"
SQL_TYPE = "CASE " + " ".join(f"WHEN {_sql_any(_TEXT, w)} THEN '{t}'" for t, w in TYPE_WORDS.items()) + " ELSE 'functional' END"


def test_type_of(title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, description))
    found = F.lit("functional")
    for kind, words in reversed(TYPE_WORDS.items()):
        found = F.when(_any(text, words), kind).otherwise(found)
    return found


@query("cases", sql=f"SELECT id, {SQL_TYPE} AS test_type FROM cases")
def classify_test_type(cases: DataFrame) -> DataFrame:
    """Test type by the first group of keywords found in title and description."""
    return cases.select("id", test_type_of(F.col("title"), F.col("description")).alias("test_type"))


@query("cases", sql=f"SELECT id, {_sql_any(_TEXT, EDGE_WORDS)} AS is_edge_case FROM cases")
def is_edge_case(cases: DataFrame) -> DataFrame:
    """Does title or description hold an edge-case word?"""
    return cases.select("id", _any(F.lower(F.concat_ws(" ", "title", "description")), EDGE_WORDS).alias("is_edge_case"))


SQL_FIELD = "CASE " + " ".join(f"WHEN contains({_TEXT}, '{w}') THEN '{w}'" for w in FIELD_WORDS) + " ELSE 'unknown' END"


def field_name(text: Column) -> Column:
    found = F.lit("unknown")
    for w in reversed(FIELD_WORDS):
        found = F.when(F.contains(text, F.lit(w)), w).otherwise(found)
    return found


@query("cases", sql=f"SELECT id, {SQL_FIELD} AS field FROM cases")
def extract_field_name(cases: DataFrame) -> DataFrame:
    """The first field word found in title and description."""
    return cases.select("id", field_name(F.lower(F.concat_ws(" ", "title", "description"))).alias("field"))


def request_of(steps: Column) -> dict[str, Column]:
    """Method, endpoint and status that the last matching step names."""
    actions = F.filter(F.transform(steps, lambda s: s["action"]), lambda a: a.rlike(REQUEST))
    last = F.try_element_at(actions, F.lit(-1))
    statuses = F.filter(F.transform(steps, lambda s: F.regexp_extract(s["expected_result"], STATUS, 1)), lambda x: x != "")
    return {
        "method": F.upper(F.regexp_extract(last, REQUEST, 1)),
        "endpoint": F.regexp_extract(last, REQUEST, 2),
        "expected_status": F.coalesce(F.try_element_at(statuses, F.lit(-1)).cast("int"), F.lit(200)),
    }


_RE = r"(?i)\b(GET|POST|PUT|DELETE|PATCH)\s+([/\w{}-]+)"
_ACTION = f"list_extract(list_filter(list_transform(steps, lambda s: s.action), lambda a: regexp_matches(a, '{_RE}')), -1)"
_STATUS = r"coalesce(CAST(list_extract(list_filter(list_transform(steps, lambda s: regexp_extract(s.expected_result, '\b(\d{3})\b', 1)), lambda x: x <> ''), -1) AS INT), 200)"
SQL_REQUEST = f"upper(regexp_extract({_ACTION}, '{_RE}', 1)) AS method, regexp_extract({_ACTION}, '{_RE}', 2) AS endpoint, {_STATUS} AS expected_status"


@query("cases", sql=f"SELECT id, {SQL_REQUEST} FROM cases")
def case_endpoint_info(cases: DataFrame) -> DataFrame:
    """Method, endpoint and expected status (default 200) from the steps; the last match wins."""
    return cases.select("id", *[c.alias(n) for n, c in request_of(F.col("steps")).items()])


@query("cases", sql=f"SELECT id, title, 'uniqueness' AS rule_type, {SQL_FIELD} AS field, {SQL_REQUEST} FROM cases WHERE contains(lower(title), 'duplicate') OR contains(lower(description), 'unique')")
def uniqueness_rules(cases: DataFrame) -> DataFrame:
    """Rules of uniqueness that cases state."""
    rows = cases.where(F.contains(F.lower("title"), F.lit("duplicate")) | F.contains(F.lower("description"), F.lit("unique")))
    field = field_name(F.lower(F.concat_ws(" ", "title", "description")))
    return rows.select("id", "title", F.lit("uniqueness").alias("rule_type"), field.alias("field"), *[c.alias(n) for n, c in request_of(F.col("steps")).items()])


@query("cases", sql=f"SELECT * FROM (SELECT id, title AS name, {SQL_REQUEST} FROM cases) WHERE endpoint <> ''")
def api_patterns(cases: DataFrame) -> DataFrame:
    """Cases that name an endpoint."""
    rows = cases.select("id", F.col("title").alias("name"), *[c.alias(n) for n, c in request_of(F.col("steps")).items()])
    return rows.where("endpoint <> ''")


@query("cases", sql=f"SELECT id, title AS name, {SQL_TYPE} AS test_type, {SQL_REQUEST}, len(steps) AS n_steps, CASE WHEN {_sql_any(_TEXT, EDGE_WORDS)} THEN 'edge_cases' ELSE 'test_patterns' END AS target FROM cases")
def parse_cases(cases: DataFrame) -> DataFrame:
    """Every case as a pattern row, with the knowledge table that it goes to."""
    edge = _any(F.lower(F.concat_ws(" ", "title", "description")), EDGE_WORDS)
    return cases.select(
        "id",
        F.col("title").alias("name"),
        test_type_of(F.col("title"), F.col("description")).alias("test_type"),
        *[c.alias(n) for n, c in request_of(F.col("steps")).items()],
        F.size("steps").alias("n_steps"),
        F.when(edge, "edge_cases").otherwise("test_patterns").alias("target"),
    )


def _labelled(label: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))


def _sql_labelled(label: str, c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') <> '' THEN '{label}: ' || {c} END"


_SEARCH = f"""array_to_string(list_filter(list_concat(list_concat([{_sql_labelled('Title', 'title')}, {_sql_labelled('Description', 'description')}, {_sql_labelled('Suite', 'suite_path')}],
 flatten(list_transform(steps, lambda s: [{_sql_labelled('Action', 's.action')}, {_sql_labelled('Expected', 's.expected_result')}, {_sql_labelled('Data', 's.data')}]))),
 [{_sql_labelled('Preconditions', 'preconditions')}, 'Priority: ' || coalesce(priority, 'medium'), 'Type: ' || coalesce(type, 'other')]), lambda x: x IS NOT NULL), ' | ')"""


@query("cases", sql=f"SELECT id, {_SEARCH} AS search_text FROM cases")
def search_text(cases: DataFrame) -> DataFrame:
    """One line per case for the retrieval corpus; empty parts are left out."""
    head = F.array(_labelled("Title", F.col("title")), _labelled("Description", F.col("description")), _labelled("Suite", F.col("suite_path")))
    steps = F.flatten(F.transform("steps", lambda s: F.array(_labelled("Action", s["action"]), _labelled("Expected", s["expected_result"]), _labelled("Data", s["data"]))))
    tail = F.array(_labelled("Preconditions", F.col("preconditions")), F.concat(F.lit("Priority: "), F.coalesce("priority", F.lit("medium"))), F.concat(F.lit("Type: "), F.coalesce("type", F.lit("other"))))
    return cases.select("id", F.array_join(F.array_compact(F.concat(head, steps, tail)), " | ").alias("search_text"))


@query(
    "cases",
    sql="""SELECT id, CASE WHEN priority = 'high' OR type IN ('smoke', 'critical') THEN 'test_patterns' WHEN contains(lower(title), 'negative') OR contains(lower(title), 'fail')
    OR contains(lower(title), 'invalid') THEN 'edge_cases' WHEN coalesce(preconditions, '') <> '' THEN 'validation_rules' ELSE 'test_patterns' END AS category FROM cases""",
)
def categorize_case(cases: DataFrame) -> DataFrame:
    """Knowledge table of a case: by priority and type, by words of its title, by preconditions."""
    title = F.lower("title")
    kind = (
        F.when((F.col("priority") == "high") | F.col("type").isin("smoke", "critical"), "test_patterns")
        .when(_any(title, ("negative", "fail", "invalid")), "edge_cases")
        .when(F.coalesce("preconditions", F.lit("")) != "", "validation_rules")
        .otherwise("test_patterns")
    )
    return cases.select("id", kind.alias("category"))


def _given(rows: DataFrame, name: str, kind: str = "string") -> Column:
    """The column of this name, or nulls where the table has none."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


_DOC = """'Test: ' || coalesce(title, 'Unnamed') || chr(10) || 'Type: ' || coalesce(type, 'unknown') || chr(10) || 'Endpoint: ' || CASE WHEN id % 3 = 0 THEN '/c/' || id ELSE '' END || chr(10) || 'Method: GET' || coalesce(chr(10) || 'Description: ' || description, '') ||
 chr(10) || 'Steps:' || chr(10) || array_to_string(list_transform(range(1, len(steps) + 1), lambda i: '  ' || i || '. ' || steps[i].action), chr(10)) ||
 CASE WHEN id % 2 = 0 THEN chr(10) || 'Assertions:' || chr(10) || '  - status == 200' || chr(10) || '  - id is not null' ELSE '' END || CASE WHEN id % 5 = 0 THEN chr(10) || 'Test Data: {"id":"' || id || '"}' ELSE '' END"""


def _as_tests(cases: DataFrame) -> DataFrame:
    return cases.select(
        "*",
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("/c/"), "id")).alias("endpoint"),
        F.lit("GET").alias("method"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("status == 200"), F.lit("id is not null"))).alias("assertions"),
        F.when(F.col("id") % 5 == 0, F.create_map(F.lit("id"), F.col("id").cast("string"))).alias("test_data"),
    )


@query("cases", sql=f"SELECT id, {_DOC} AS document FROM cases", prepare=lambda c: (_as_tests(c),))
def format_case_document(cases: DataFrame) -> DataFrame:
    """Multi-line document of a case: test, type, endpoint and method always; description, numbered steps, assertions and test data where
    the case has them. Columns that the table lacks count as missing."""
    steps = F.array_join(F.transform("steps", lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s["action"])), "\n")
    checks = F.array_join(F.transform(_given(cases, "assertions", "array<string>"), lambda a: F.concat(F.lit("  - "), a)), "\n")
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(_given(cases, c), F.lit(default))) for label, c, default in (("Test", "title", "Unnamed"), ("Type", "type", "unknown"), ("Endpoint", "endpoint", ""), ("Method", "method", ""))]
    lines += [F.concat(F.lit("Description: "), _given(cases, "description")), F.concat(F.lit("Steps:\n"), steps), F.concat(F.lit("Assertions:\n"), checks)]
    lines.append(F.concat(F.lit("Test Data: "), F.to_json(_given(cases, "test_data", "map<string,string>"))))
    return cases.select("id", F.concat_ws("\n", *lines).alias("document"))


@query("test_cases", sql="SELECT ordinal, array_to_string(list_filter([nullif(name, ''), nullif(description, ''), nullif(endpoint, ''), nullif(method, ''), nullif(test_type, '')], lambda x: x IS NOT NULL), ' ') AS text FROM test_cases")
def item_text(items: DataFrame) -> DataFrame:
    """Index text of an item: its non-empty fields."""
    return items.select("ordinal", F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in map(F.col, ("name", "description", "endpoint", "method", "test_type"))]).alias("text"))


#: Fields of a record that come first, by label.
COMMON = {"endpoint": "Endpoint", "path": "Path", "method": "Method", "name": "Name", "description": "Description"}


@query(
    "parameters",
    prepare=lambda p: (p.select("id", "endpoint", "name", F.array(F.struct("name", F.col("type").alias("values"))).alias("parameters"), "min_value", "max_value"),),
    sql="SELECT id, array_to_string(list_filter(['Endpoint: ' || endpoint, 'Name: ' || name, 'Param: ' || name || ' Values: ' || type, 'min_value: ' || min_value, 'max_value: ' || max_value], lambda x: x IS NOT NULL), ' | ') AS text FROM parameters",
)
def structured_text(records: DataFrame) -> DataFrame:
    """One line of a structured record (its columns but ``id``): the common fields by label, then its ``parameters`` (name and values),
    then all other fields by name. Missing fields are left out, and so are common ones that are empty."""
    labelled = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))
    parts = [F.when(F.col(c) != "", labelled(label, c)) for c, label in COMMON.items() if c in records.columns]
    if "parameters" in records.columns:
        parts.append(F.transform("parameters", lambda p: F.concat(F.lit("Param: "), F.coalesce(p["name"], F.lit("")), F.lit(" Values: "), F.coalesce(p["values"], F.lit("")))))
    parts += [labelled(c, c) for c in records.columns if c not in {"id", "parameters", *COMMON}]
    return records.select("id", F.concat_ws(" | ", *parts).alias("text"))


def _suite_texts(documents: DataFrame) -> DataFrame:
    """A suite tree per source, as JSON text: the source's documents are cases of nested suites. Some texts are cut off, some missing."""
    case = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("lang").alias("priority")))
    suite = F.concat(F.lit('{"title":"L'), F.col("doc_id") % 3, F.lit('","cases":['), case, F.lit('],"suites":[{"cases":['), case, F.lit("]}]}"))
    text = F.concat(F.lit('{"suites":['), suite, F.when(F.col("doc_id") % 50 == 7, "").otherwise("]}"))
    return documents.select(F.col("source").alias("path"), F.when(F.col("doc_id") % 50 != 8, text).alias("content"))


def suite_cases(tree: dict) -> Iterator[tuple[str, int, dict[str, str]]]:
    """Suite path, id and fields of the cases of a suite tree, a suite's own before those of its children; without recursion."""
    waiting = [(s, "") for s in reversed(tree.get("suites") or [])]
    while waiting:
        suite, above = waiting.pop()
        title = suite.get("title") or "Unknown Suite"
        at = f"{above} > {title}" if above else title
        for c in suite.get("cases") or []:
            yield at, c.get("id"), {k: v if isinstance(v, str) else json.dumps(v) for k, v in c.items() if k != "id"}
        waiting.extend((s, at) for s in reversed(suite.get("suites") or []))


_CASE_FIELDS = "MAP {'title': coalesce(text, ''), 'priority': coalesce(lang, '')}"
_ERROR = "CASE doc_id % 50 WHEN 7 THEN 'no JSON' WHEN 8 THEN 'no content' END"


@query(
    "documents",
    prepare=lambda d: (_suite_texts(d.fillna("", ["text", "lang"])),),
    sql=f"""SELECT source AS path, 'L' || (doc_id % 3) AS suite_path, doc_id AS id, {_CASE_FIELDS} AS fields, NULL::VARCHAR AS error FROM documents WHERE {_ERROR} IS NULL
    UNION ALL SELECT source, 'L' || (doc_id % 3) || ' > Unknown Suite', doc_id, {_CASE_FIELDS}, NULL FROM documents WHERE {_ERROR} IS NULL UNION ALL SELECT source, NULL, NULL, NULL, {_ERROR} FROM documents WHERE {_ERROR} IS NOT NULL""",
)
def flatten_suites(files: DataFrame) -> DataFrame:
    """Cases of suite trees (JSON texts in ``content``) with the path of suite titles and all their fields; any depth.

    Fields that are no strings come as JSON. A file that can't be read as a suite tree gives one row that says why in ``error`` and
    has nothing else but its path; the others are not affected.
    """

    def rows_of(path: str, text: str | None) -> list[tuple]:
        if text is None:
            return [(path, None, None, None, "no content")]
        try:
            return [(path, *x, None) for x in suite_cases(json.loads(text))]
        except ValueError:
            return [(path, None, None, None, "no JSON")]
        except (AttributeError, TypeError):
            return [(path, None, None, None, "no suite tree")]
        except RecursionError:
            return [(path, None, None, None, "nested too deeply")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["content"], strict=True) for r in rows_of(p, t)]
            yield pd.DataFrame(rows, columns=["path", "suite_path", "id", "fields", "error"]).astype({"id": "Int64"})

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, suite_path string, id long, fields map<string,string>, error string")


_TREE = """WITH RECURSIVE tree(id, suite_path, depth) AS (
  SELECT id, coalesce(nullif(title, ''), 'Unknown Suite'), 1 FROM {suites} WHERE parent_id IS NULL
  UNION ALL SELECT s.id, concat(tree.suite_path, ' > ', coalesce(nullif(s.title, ''), 'Unknown Suite')), depth + 1 FROM {suites} s JOIN tree ON s.parent_id = tree.id)
SELECT id, suite_path, depth FROM tree"""


def suite_paths(suites: DataFrame, levels: int = 1000) -> DataFrame:
    """id, suite_path and depth of every suite of a table (id, parent_id, title) that hangs below one without a parent.

    A level of the tree is a join; a tree of more than ``levels`` levels is an error, not a cut. Suites on a cycle hang below none.
    """
    spark = suites.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(levels))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return stored(spark.sql(_TREE, suites=stored(suites.select("id", "parent_id", "title"))))


def _suite_table(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suites three deep: sources, their languages, and a number; a document is a case of the innermost."""
    third = F.col("doc_id") % 4
    key = lambda *parts: F.concat_ws("/", *[F.coalesce(F.col(p) if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    rows = documents.select("doc_id", "source", "lang", third.alias("m"))
    level = lambda *names: rows.select(key(*names).alias("id"), (key(*names[:-1]) if names[:-1] else F.lit(None).cast("string")).alias("parent_id"), F.col(names[-1]).cast("string").alias("title")).distinct()
    suites = level("source").unionByName(level("source", "lang")).unionByName(level("source", "lang", "m"))
    return suites.withColumn("title", F.when(F.col("title") != "2", F.col("title"))), rows.select(F.col("doc_id").alias("id"), key("source", "lang", "m").alias("suite_id"))


@query(
    "documents",
    prepare=_suite_table,
    sql="SELECT doc_id AS id, source || ' > ' || lang || ' > ' || CASE WHEN doc_id % 4 = 2 THEN 'Unknown Suite' ELSE (doc_id % 4)::VARCHAR END AS suite_path, 3 AS depth FROM documents",
)
def flatten_suite_table(suites: DataFrame, cases: DataFrame) -> DataFrame:
    """``flatten_suites`` of suites in a table: id, suite_path and depth of the cases (id, suite_id) of every suite of the tree."""
    cases = stored(cases.select("id", "suite_id"))
    sizes = cases.groupBy(F.col("suite_id").alias("_suite")).agg(F.count(F.lit(1)).alias("_n"))
    paths = suite_paths(suites).join(sizes, F.col("id") == F.col("_suite")).select(F.col("id").alias("suite_id"), "suite_path", "depth", "_n")
    return with_group_values(cases, stored(paths), "suite_id", "_n").select("id", "suite_path", "depth")


@query(
    "cases",
    prepare=lambda c: (
        c.select(
            "id",
            F.when(F.col("id") % 4 == 0, F.col("description")).alias("content"),
            F.when(F.col("id") % 4 == 1, F.col("title")).alias("text"),
            F.when(F.col("id") % 4 == 2, F.concat(F.lit("code "), "id")).alias("code"),
            F.col("title").alias("name"),
            "description",
            F.col("priority").alias("summary"),
        ),
    ),
    sql="""SELECT * FROM (SELECT id, CASE id % 4 WHEN 0 THEN description WHEN 1 THEN title WHEN 2 THEN 'code ' || id
    ELSE array_to_string(list_filter(['name: ' || title, 'description: ' || description, 'summary: ' || priority], lambda x: x IS NOT NULL), chr(10)) END AS content FROM cases) WHERE content <> ''""",
)
def extract_content(documents: DataFrame) -> DataFrame:
    """Content of a document: its content, else text, else code, else its described fields as lines. Empty documents are skipped, and
    columns that the table lacks count as missing."""
    return documents.select("id", content_of(documents).alias("content")).where("content <> ''")


def content_of(documents: DataFrame) -> Column:
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), _given(documents, c)) for c in ("name", "description", "summary", "body")])
    return F.coalesce(*[_given(documents, c) for c in ("content", "text", "code")], lines)


_CODE = "lower(code)"


@query("source_files", sql=f"SELECT path, CASE WHEN {_sql_any(_CODE, ('validation', 'invalid'))} THEN 'validation' WHEN {_sql_any(_CODE, ('edge', 'boundary'))} THEN 'edge_case' WHEN {_sql_any(_CODE, ('auth', 'unauthorized'))} THEN 'authentication' WHEN contains({_CODE}, 'security') THEN 'security' ELSE 'functional' END AS test_type FROM source_files")
def classify_code_type(files: DataFrame) -> DataFrame:
    """Test type of code by the first group of words that it holds."""
    return files.select("path", code_type(F.col("code")).alias("test_type"))


def code_type(code: Column) -> Column:
    code = F.lower(code)
    kind = F.when(_any(code, ("validation", "invalid")), "validation").when(_any(code, ("edge", "boundary")), "edge_case").when(_any(code, ("auth", "unauthorized")), "authentication").when(_any(code, ("security",)), "security")
    return kind.otherwise("functional")


@query("cases", sql="SELECT id, coalesce(nullif(array_to_string(list_filter([nullif(description, ''), nullif(title, '')], lambda x: x IS NOT NULL), ' '), ''), '{}') AS text FROM cases", prepare=lambda c: (c.select("id", F.create_map(F.lit("description"), F.col("description"), F.lit("name"), F.col("title")).alias("metadata")),))
def metadata_text(rows: DataFrame) -> DataFrame:
    """Searchable text of ``metadata`` (a map): its text fields that are not empty, in fixed order; the whole map if there is none."""
    fields = [F.nullif(F.try_element_at("metadata", F.lit(f)), F.lit("")) for f in ("content", "text", "description", "name", "test_code", "code")]
    text = F.concat_ws(" ", *fields)
    return rows.select("id", F.when(text != "", text).otherwise(F.to_json("metadata")).alias("text"))
