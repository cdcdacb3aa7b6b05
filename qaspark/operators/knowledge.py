"""The knowledge base and the ingestion ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.tables import numbered
from qaspark.registry import query

# Knowledge types, default patterns with the methods that they apply to, edge values by data type, index by document type.
TYPES = ("test_patterns", "edge_cases", "validation_rules", "api_patterns", "bug_patterns", "best_practices")
PATTERNS = [("Happy Path Testing", ["GET", "POST", "PUT", "DELETE"]), ("Null/Empty Testing", ["POST", "PUT"]), ("Boundary Testing", ["All"]), ("Authentication Testing", ["All"]), ("Concurrent Access Testing", ["PUT", "DELETE"])]
EDGE_VALUES = {"string": ["Empty string", "Single space", "Very long string", "XSS attempt"], "integer": ["Zero", "Negative one", "MAX_INT", "MIN_INT"], "array": ["Empty array", "Array with null"], "date": ["Invalid date", "Unix epoch"]}
INDEX_OF = {"test_case": "test_patterns", "edge_case": "edge_cases", "validation": "validation_rules", "api_specification": "api_specifications", "bug": "bug_patterns"}


@query("knowledge", sql="SELECT id, knowledge_type FROM knowledge WHERE json_extract_string(item_json, '$.method') = 'GET' AND json_extract_string(item_json, '$.lang') = 'en'", prepare=lambda k: (k, {"method": "GET", "lang": "en"}))
def knowledge_filter(knowledge: DataFrame, equal: dict[str, str]) -> DataFrame:
    """Items whose fields equal the given values; a missing field does not."""
    for key, value in equal.items():
        knowledge = knowledge.where(F.get_json_object("item_json", f"$.{key}") == value)
    return knowledge.select("id", "knowledge_type")


@query("knowledge", sql="SELECT id, knowledge_type FROM knowledge WHERE knowledge_type IN ('test_patterns', 'edge_cases') AND contains(lower(item_json), 'item 1')", prepare=lambda k: (k, "Item 1", ("test_patterns", "edge_cases")))
def knowledge_search(knowledge: DataFrame, text: str, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Items of the given types whose JSON holds the text, in any case."""
    return knowledge.where(F.col("knowledge_type").isin(*types) & F.contains(F.lower("item_json"), F.lit(text.lower()))).select("id", "knowledge_type")


@query("knowledge", sql="SELECT t.knowledge_type, count(k.id) AS n, max(coalesce(k.updated_at, k.added_at)) AS last_updated FROM (SELECT unnest(['test_patterns', 'bug_patterns', 'edge_cases', 'validation_rules', 'api_patterns', 'best_practices']) AS knowledge_type) t LEFT JOIN knowledge k USING (knowledge_type) GROUP BY 1")
def knowledge_statistics(knowledge: DataFrame) -> DataFrame:
    """Items and last change of every type, absent types too."""
    types = knowledge.sparkSession.createDataFrame([(t,) for t in TYPES], "knowledge_type string")
    found = knowledge.groupBy("knowledge_type").agg(F.count("id").alias("n"), F.max(F.coalesce("updated_at", "added_at")).alias("last_updated"))
    return types.join(found, "knowledge_type", "left").select("knowledge_type", F.coalesce("n", F.lit(0)).alias("n"), "last_updated")


@query("knowledge", sql="SELECT id, knowledge_type, item_json FROM knowledge WHERE doc_id % 2 = 0 UNION ALL SELECT id, knowledge_type, item_json FROM knowledge WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0", prepare=lambda k: (k.where("doc_id % 2 = 0"), k.where("doc_id % 3 = 0")))
def knowledge_merge(there: DataFrame, new: DataFrame, merge: bool = True) -> DataFrame:
    """Import: items of new ids are added; without merging, the new items replace all."""
    added = new.join(there.select("id"), "id", "left_anti") if merge else new
    out = there.unionByName(added.select(there.columns)) if merge else added
    return out.select("id", "knowledge_type", "item_json")


@query("knowledge", sql="SELECT id, CASE WHEN doc_id % 4 = 0 THEN '{}' ELSE item_json END AS item_json, CASE WHEN doc_id % 4 = 0 THEN '2025-01-01T00:00:00' ELSE updated_at END AS updated_at FROM knowledge WHERE doc_id % 10 <> 1 AND (doc_id % 2 = 0 OR doc_id % 4 = 0 OR doc_id % 2 = 1)", prepare=lambda k: (k, k.where("doc_id % 4 = 0").select("id", F.lit("{}").alias("item_json")), k.where("doc_id % 10 = 1").select("id"), "2025-01-01T00:00:00"))
def knowledge_upsert(knowledge: DataFrame, changed: DataFrame, removed: DataFrame, now: str) -> DataFrame:
    """Updates fields and the time of change by id, and removes ids."""
    new = changed.select("id", F.col("item_json").alias("_json"))
    rows = knowledge.join(removed.select("id"), "id", "left_anti").join(new, "id", "left")
    return rows.select("id", F.coalesce("_json", "item_json").alias("item_json"), F.when(F.col("_json").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"))


@query(
    "knowledge",
    prepare=lambda k: (k.withColumn("item_json", F.concat(F.expr("left(item_json, length(item_json) - 1)"), F.lit(',"n":5,"more":{"a":"b"},"long":"'), F.repeat(F.lit("x"), F.lit(500)), F.lit('"}'))),),
    sql="SELECT id, 'name: ' || json_extract_string(item_json, '$.name') || ' method: ' || json_extract_string(item_json, '$.method') || ' lang: ' || json_extract_string(item_json, '$.lang') || ' source: ' || json_extract_string(item_json, '$.source') || ' more: {\"a\":\"b\"}' AS text FROM knowledge",
)
def load_kb_items(knowledge: DataFrame) -> DataFrame:
    """Searchable text of an item: its string fields under 500 characters and its objects as JSON, as "key: value", in the item's order."""
    fields = F.try_variant_get(F.try_parse_json("item_json"), "$", "map<string,variant>")
    rows = knowledge.select("id", F.json_object_keys("item_json").alias("_keys"), fields.alias("_fields"))

    def shown(key: Column) -> Column:
        value = F.try_element_at("_fields", key)
        kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
        return F.when((kind == "STRING") & (F.length(text) < 500), F.concat(key, F.lit(": "), text)).when(F.startswith(kind, F.lit("OBJECT")), F.concat(key, F.lit(": "), F.to_json(value)))

    return rows.select("id", F.array_join(F.array_compact(F.transform("_keys", shown)), " ").alias("text"))


_METHODS = "(VALUES ('Happy Path Testing', ['GET', 'POST', 'PUT', 'DELETE']), ('Null/Empty Testing', ['POST', 'PUT']), ('Boundary Testing', ['All']), ('Authentication Testing', ['All']), ('Concurrent Access Testing', ['PUT', 'DELETE'])) p(pattern, applicable_to)"


@query("results", sql=f"SELECT r.id, p.pattern FROM results r JOIN {_METHODS} ON list_contains(p.applicable_to, 'All') OR list_contains(p.applicable_to, r.method)", prepare=lambda r: (r, r.sparkSession.createDataFrame(PATTERNS, "pattern string, applicable_to array<string>")))
def patterns_for_method(requests: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns that apply to a request's method, and those that apply to 'All', also for a request without a method."""
    each = patterns.select("pattern", F.explode("applicable_to").alias("method")).distinct()
    every = each.where("method = 'All'")
    pairs = every.unionByName(each.join(every.select("pattern"), "pattern", "left_anti"))
    named = requests.select("id", F.explode(F.array_compact(F.array("method", F.lit("All")))).alias("method"))
    return named.join(pairs, "method").select("id", "pattern")


_EDGES = "(VALUES ('string', ['Empty string', 'Single space', 'Very long string', 'XSS attempt']), ('integer', ['Zero', 'Negative one', 'MAX_INT', 'MIN_INT']), ('array', ['Empty array', 'Array with null']), ('date', ['Invalid date', 'Unix epoch'])) e(type, vals)"


@query("parameters", sql=f"SELECT p.id, p.type, v.edge_value FROM parameters p JOIN {_EDGES} USING (type), unnest(e.vals) v(edge_value)")
def edge_cases_for_type(parameters: DataFrame) -> DataFrame:
    """Every edge value of each parameter's type."""
    values = parameters.sparkSession.createDataFrame(list(EDGE_VALUES.items()), "type string, vals array<string>")
    return parameters.join(F.broadcast(values), "type").select("id", "type", F.explode("vals").alias("edge_value"))


@query("results", sql="SELECT id, CASE WHEN coalesce(passed, false) THEN 'test_patterns' ELSE 'bug_patterns' END AS knowledge_type, name, CASE WHEN coalesce(passed, false) THEN NULL ELSE error END AS error FROM results", prepare=lambda r: (r.select("id", "name"), r.select("id", "passed", "error")))
def result_to_case(cases: DataFrame, results: DataFrame) -> DataFrame:
    """A case with its result: a pattern if it passed, a bug if not."""
    good = F.coalesce("passed", F.lit(False))
    return cases.join(results, "id").select("id", F.when(good, "test_patterns").otherwise("bug_patterns").alias("knowledge_type"), "name", F.when(~good, F.col("error")).alias("error"))


@query("corpus", sql="SELECT doc_id, content FROM corpus WHERE doc_id % 3 <> 0", prepare=lambda c: (c, c.where("doc_id % 3 = 0").select("doc_id")))
def new_documents(documents: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Documents that the ledger does not hold yet; all of them if forced."""
    rows = documents if force else documents.join(ledger, "doc_id", "left_anti")
    return rows.select("doc_id", "content")


_ROUTE = "CASE type WHEN 'test_case' THEN 'test_patterns' WHEN 'api_specification' THEN 'api_specifications' WHEN 'validation' THEN 'validation_rules' ELSE 'test_patterns' END"


@query("corpus", sql=f"SELECT doc_id, {_ROUTE} AS index_name FROM corpus")
def route_index(documents: DataFrame) -> DataFrame:
    """Index of a document by its type; test_patterns by default."""
    return documents.select("doc_id", index_of(F.col("type")).alias("index_name"))


def index_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in INDEX_OF.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(kind, F.lit(""))), F.lit("test_patterns"))


#: A document's row in the ledger: what became of it in the run ``part``, why, and how many chunks it gave.
LEDGER = "doc_id long, index_name string, status string, reason string, chunks long, part int"


def _planned(corpus: DataFrame) -> DataFrame:
    known, empty, broken = F.col("doc_id") % 3 == 0, F.coalesce("content", F.lit("")) == "", F.col("doc_id") % 11 == 0
    status = F.when(known | empty, "skipped").when(broken, "failed").otherwise("indexed")
    reason = F.when(known, "already_indexed").when(empty, "no_content").when(broken, "ValueError")
    return corpus.select("doc_id", status.alias("status"), reason.alias("reason"), F.when(status == "indexed", F.size(F.split("content", "\n"))).otherwise(0).alias("chunks"))


@query(
    "corpus",
    prepare=lambda c: (_planned(c),),
    sql="""WITH l AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'known' WHEN coalesce(content, '') = '' THEN 'empty' WHEN doc_id % 11 = 0 THEN 'broken' ELSE 'fine' END AS s, len(string_split(content, chr(10))) AS n FROM corpus)
    SELECT count(*) AS total_documents, count(*) FILTER (WHERE s = 'fine') AS indexed, count(*) FILTER (WHERE s IN ('known', 'empty')) AS skipped, count(*) FILTER (WHERE s = 'known') AS already_indexed,
    count(*) FILTER (WHERE s = 'empty') AS no_content, 0::BIGINT AS no_chunks, count(*) FILTER (WHERE s = 'broken') AS failed, coalesce(sum(n) FILTER (WHERE s = 'fine'), 0)::BIGINT AS chunks_created FROM l""",
)
def indexing_stats(ledger: DataFrame) -> DataFrame:
    """What an indexing run has done with its documents: indexed, skipped (and why), failed, and the chunks created."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    reasons = [is_("reason", r).alias(r) for r in ("already_indexed", "no_content", "no_chunks")]
    chunks = F.coalesce(F.sum(F.when(F.col("status") == "indexed", F.col("chunks"))), F.lit(0)).cast("long")
    return ledger.agg(F.count(F.lit(1)).alias("total_documents"), is_("status", "indexed").alias("indexed"), is_("status", "skipped").alias("skipped"), *reasons, is_("status", "failed").alias("failed"), chunks.alias("chunks_created"))


@query("corpus", sql=f"SELECT doc_id, index_name, 100 + row_number() OVER (PARTITION BY index_name ORDER BY doc_id) AS vector_id FROM (SELECT doc_id, {_ROUTE} AS index_name FROM corpus)", prepare=lambda c: (route_index(c), route_index(c).select("index_name").distinct().withColumn("last_id", F.lit(100))))
def assign_vector_ids(documents: DataFrame, last: DataFrame) -> DataFrame:
    """New ids per index, after the last one there, in order of document."""
    rows = numbered(documents.select("doc_id", "index_name"), ["index_name"], ["doc_id"], "n").join(last, "index_name", "left")
    return rows.select("doc_id", "index_name", (F.coalesce("last_id", F.lit(0)) + F.col("n") + 1).cast("long").alias("vector_id"))
