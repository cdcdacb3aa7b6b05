"""Structured parts of language-model responses: JSON, lists, code, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.registry import query

FENCE = r"(?s)```(\w*)\s*\n?(.*?)```"


def json_text(text: Column) -> Column:
    """The JSON of a response: in the first fence, else from the first brace to the last, else from bracket to bracket."""
    fenced = F.trim(F.regexp_extract(text, FENCE, 2))
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    brackets = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(fenced != "", F.regexp_replace(fenced, r"\s+$", "")).when(braces != "", braces).when(brackets != "", brackets)


_F = "trim(regexp_extract(text, '(?s)```(\\w*)\\s*\\n?(.*?)```', 2), chr(10) || ' ')"
_JSON = f"CASE WHEN {_F} <> '' THEN {_F} WHEN regexp_extract(text, '(?s)\\{{.*\\}}', 0) <> '' THEN regexp_extract(text, '(?s)\\{{.*\\}}', 0) WHEN regexp_extract(text, '(?s)\\[.*\\]', 0) <> '' THEN regexp_extract(text, '(?s)\\[.*\\]', 0) END"


@query("llm_responses", sql=f"SELECT id, CASE WHEN json_valid({_JSON}) THEN {_JSON} END AS json, CASE WHEN json_valid({_JSON}) THEN 'ok' ELSE 'failed' END AS status FROM llm_responses")
def extract_json_responses(responses: DataFrame) -> DataFrame:
    """JSON text of each response, and whether it parses."""
    found = responses.select("id", json_text(F.col("text")).alias("json"))
    good = F.try_parse_json("json").isNotNull()
    return found.select("id", F.when(good, F.col("json")).alias("json"), F.when(good, "ok").otherwise("failed").alias("status"))


# Fixed value: what marks a line as an item.
_MARK = r"^[-*\d.]+\s*"


def _lists(responses: DataFrame) -> DataFrame:
    """Some responses are JSON lists, bare or in a fence, with texts, numbers, objects and nulls."""
    n = F.col("conv_id") + F.col("turn")
    items = F.concat(F.lit('["a, b", '), n.cast("string"), F.lit(', {"k": [1]}, null, "- x"]'))
    return responses.withColumn("text", F.when(n % 3 == 0, items).when(n % 3 == 1, F.concat(F.lit("```json\n"), items, F.lit("\n```"))).otherwise(F.concat(F.lit("* first\n\n2. second\n-third "), "text")))


_PLAIN = r"list_filter(list_transform(string_split(trim(text, chr(10) || ' '), chr(10)), lambda x: regexp_replace(trim(x, chr(9) || chr(13) || ' '), '^[-*\d.]+\s*', '')), lambda x: x <> '')"


@query(
    "llm_responses",
    prepare=lambda r: (_lists(r),),
    sql=f"""WITH t AS (SELECT id, (conv_id + turn) % 3 < 2 AS listed, conv_id + turn AS n, '* first' || chr(10) || chr(10) || '2. second' || chr(10) || '-third ' || text AS text FROM llm_responses)
    SELECT id, CASE WHEN listed THEN ['a, b', n::VARCHAR, '{{"k":[1]}}', 'null', '- x'] ELSE {_PLAIN} END AS items FROM t""",
)
def parse_list_responses(responses: DataFrame) -> DataFrame:
    """Items of a response: of its JSON if that is a list (texts as they are, anything else as JSON), else its lines without bullets and
    numbers, blank ones dropped. A text that is JSON as a whole is taken as it is."""
    parsed = F.coalesce(F.try_parse_json("text"), F.try_parse_json(json_text(F.col("text"))))
    listed = F.try_variant_get(parsed, "$", "array<variant>")
    item = lambda v: F.when(v.isNull() | F.is_variant_null(v), "null").when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    lines = F.filter(F.transform(F.split(F.trim("text", F.lit(" \n")), "\n"), lambda x: F.regexp_replace(F.trim(x, F.lit(" \t\r")), _MARK, "")), lambda x: x != "")
    return responses.select("id", F.coalesce(F.transform(listed, item), lines).alias("items"))


@query("llm_responses", sql=r"SELECT id, CASE WHEN contains(text, '```') THEN regexp_extract(text, '(?s)```(\w*)\s*\n?(.*?)```', 1) ELSE '' END AS language, CASE WHEN contains(text, '```') THEN trim(regexp_extract(text, '(?s)```(\w*)\s*\n?(.*?)```', 2), chr(10) || ' ') ELSE text END AS code, trim(split_part(text, '```', 1), ' ') AS description FROM llm_responses")
def parse_code_responses(responses: DataFrame) -> DataFrame:
    """Language and code of the first fence, else the whole text; the description is what stands before."""
    fenced = F.contains("text", F.lit("```"))
    code = F.trim(F.regexp_extract("text", FENCE, 2), F.lit(" \n"))
    return responses.select(
        "id",
        F.when(fenced, F.regexp_extract("text", FENCE, 1)).otherwise("").alias("language"),
        F.when(fenced, code).otherwise(F.col("text")).alias("code"),
        F.trim(F.substring_index("text", "```", 1)).alias("description"),
    )


def _headed(responses: DataFrame) -> DataFrame:
    text = F.concat(F.lit("before\n# First Part\n"), "text", F.lit("\n## Second one\nrow "), "id", F.lit("\n# First Part\nagain\n**Bold\n2. Second one"))
    return responses.select("id", F.when(F.col("text").isNotNull(), text).alias("text"))


# Fixed value: what starts a section.
_HEAD = r"(?:\d+\.|#{1,3}\s|\*\*)"


@query(
    "llm_responses",
    prepare=lambda r: (_headed(r),),
    sql="""SELECT id, unnest(['content', 'first_part', 'second_one', 'bold']) AS section, unnest([['before'], [trim(text, chr(10) || ' '), 'again'], ['row ' || id, ''], ['']]) AS content
    FROM llm_responses WHERE text IS NOT NULL""",
)
def parse_sections(responses: DataFrame) -> DataFrame:
    """Sections of a response by heading (numbered, #, ## or ###, **), in lower case with underscores, each with the list of its texts: one
    for every time that the heading comes. What stands before the first heading is the section "content"."""
    parts = F.filter(F.transform(F.split("text", rf"\n(?={_HEAD})"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    head = lambda x: F.regexp_extract(x, rf"^{_HEAD}([^\n]+)", 1)
    key = lambda x: F.replace(F.lower(F.trim(head(x))), F.lit(" "), F.lit("_"))
    body = lambda x: F.regexp_replace(F.regexp_replace(x, rf"^{_HEAD}[^\n]*\n?", ""), r"^\s+|\s+$", "")
    pairs = F.transform(parts, lambda x: F.struct(F.when(head(x) != "", key(x)).otherwise("content").alias("key"), body(x).alias("text")))
    rows = responses.select("id", F.posexplode(pairs).alias("at", "p")).select("id", "at", F.col("p.key").alias("section"), "p.text")
    found = rows.groupBy("id", "section").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
    return found.select("id", "section", F.transform("t", lambda x: x["text"]).alias("content"))


@query("llm_responses", sql=f"SELECT id, array_to_string(list_filter(['name', 'endpoint', 'method'], lambda k: NOT coalesce(list_contains(json_keys(CASE WHEN json_valid({_JSON}) THEN {_JSON} END), k), false)), ',') AS missing FROM llm_responses")
def response_structure_check(responses: DataFrame, required: tuple[str, ...] = ("name", "endpoint", "method")) -> DataFrame:
    """Required keys that a response's JSON lacks."""
    found = responses.select("id", json_text(F.col("text")).alias("json"))
    keys = F.coalesce(F.json_object_keys(F.when(F.try_parse_json("json").isNotNull(), F.col("json"))), F.array().cast("array<string>"))
    return found.select("id", F.array_join(F.array_except(F.array(*[F.lit(k) for k in required]), keys), ",").alias("missing"))
