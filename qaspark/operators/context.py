"""Context of an API specification: query text, hits of three indices, and a block of examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.functions.tables import numbered, stored
from qaspark.operators.endpoints import CONTEXT_SQL, assemble_context
from qaspark.operators.vectors import MIN_SCORE, SQL_BYTES, TOP_K, hash_embedding, nearest
from qaspark.registry import query

# Indices by what their hits are called, and the texts around examples.
INDICES = {"similar_tests": "test_patterns", "edge_cases": "edge_cases", "validation_patterns": "validation_rules"}
HEADER = "📚 EXAMPLES FROM KNOWLEDGE BASE (476 test cases):\nLearn from these real test cases:\n\n"
NO_EXAMPLES = "⚠️ No similar test examples found in knowledge base."


def example_text(position: Column, score: Column, title: Column, description: Column, steps: Column) -> Column:
    """One example: relevance, title, description if there is one, and what the first two steps do and expect."""
    line = lambda before, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit("\n"))).otherwise("")
    shown = F.transform(F.slice(steps, 1, 2), lambda s: F.concat(line("  Step: ", s["action"]), line("    Expected: ", s["expected_result"])))
    head = F.concat(F.lit("Example "), position.cast("string"), F.lit(" (relevance: "), F.format_string("%.1f%%", score * 100), F.lit("): "), F.coalesce(title, F.lit("Unknown")), F.lit("\n"))
    return F.concat(head, line("  Description: ", description), F.coalesce(F.array_join(shown, ""), F.lit("")), F.lit("\n"))


def retrieve_context(endpoints: DataFrame, models: DataFrame, vectors: DataFrame, items: DataFrame, k: int = TOP_K, examples: int = 3, encoder: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """controller, query_text, the hits of each index as arrays of (id, score), best first, and the block of examples.

    The query text of each controller's specification is encoded and searched in three indices at once. Edge cases need the usual
    least score. The best similar tests are shown with their title, description and steps from ``items`` (id, title, description,
    steps); a hit without an item is shown as Unknown. A hit's relevance is its score. Specifications without hits have empty arrays
    and say so.
    """
    asked = numbered(stored(assemble_context(endpoints, models)), [], ["controller"], "query_id")
    asked = stored(asked.withColumn("vec", encoder(F.col("query_text"))))
    base = vectors.where(F.col("index_name").isin(*INDICES.values()))
    hits = nearest(base, asked.select(F.col("query_id").alias("id"), "vec"), k)
    hits = stored(hits.where((F.col("index_name") != "edge_cases") | (F.col("score") >= MIN_SCORE)).select("query_id", "index_name", "id", "score", "rank"))
    found = [F.collect_list(F.when(F.col("index_name") == index, F.struct("rank", "id", "score"))).alias(name) for name, index in INDICES.items()]
    lists = hits.groupBy("query_id").agg(*found)
    lists = lists.select("query_id", *[F.transform(F.array_sort(name), lambda h: F.struct(h["id"].alias("id"), h["score"].alias("score"))).alias(name) for name in INDICES])
    best = hits.where((F.col("index_name") == INDICES["similar_tests"]) & (F.col("rank") < examples)).join(items.select("id", "title", "description", "steps"), "id", "left")
    shown = best.select("query_id", "rank", example_text(F.col("rank") + 1, F.col("score"), F.col("title"), F.col("description"), F.col("steps")).alias("text"))
    blocks = shown.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "").alias("_block"))
    rows = asked.join(lists, "query_id", "left").join(blocks, "query_id", "left")
    none = F.array().cast("array<struct<id:bigint,score:double>>")
    block = F.when(F.col("_block").isNotNull(), F.concat(F.lit(HEADER), "_block")).otherwise(NO_EXAMPLES)
    return rows.select("controller", "query_text", *[F.coalesce(name, none).alias(name) for name in INDICES], block.alias("examples"))


_V = SQL_BYTES.format(d=64, t="query_text")
_LINE = "CASE WHEN coalesce({1}, '') <> '' THEN '{0}' || {1} || chr(10) ELSE '' END"
_STEPS = f"array_to_string(list_transform(steps[1:2], lambda s: {_LINE.format('  Step: ', 's.action')} || {_LINE.format('    Expected: ', 's.expected_result')}), '')"
_HITS_OF = "coalesce((SELECT string_agg(id || ':' || printf('%.4f', score), ',' ORDER BY rank) FROM g WHERE g.controller = t.controller AND g.index_name = '{}'), '') AS {}"


@query(
    "endpoints_raw",
    "vectors",
    "cases",
    prepare=lambda e, v, c: (e, e.select("controller", "ordinal", F.col("return_type").alias("model")), v, c),
    sql=f"""WITH t AS ({CONTEXT_SQL}), w AS (SELECT controller, {_V} AS v FROM t), q AS (SELECT controller, list_transform(v, lambda x: (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT) AS q FROM w),
    d AS (SELECT controller, index_name, v.id, round(list_sum(list_transform(range(1, 65), lambda i: (v.vec[i]::DOUBLE - q.q[i]::DOUBLE) * (v.vec[i]::DOUBLE - q.q[i]::DOUBLE))), 6) AS distance FROM vectors v, q WHERE index_name IN ('test_patterns', 'edge_cases', 'validation_rules')),
    h AS (SELECT *, 1 / (1 + distance) AS score, row_number() OVER (PARTITION BY controller, index_name ORDER BY distance, id) - 1 AS rank FROM d),
    g AS (SELECT * FROM h WHERE rank < 10 AND (index_name <> 'edge_cases' OR score >= 0.3)),
    x AS (SELECT controller, rank, 'Example ' || (rank + 1) || ' (relevance: ' || printf('%.1f%%', score * 100) || '): ' || coalesce(title, 'Unknown') || chr(10) || {_LINE.format('  Description: ', 'description')} || coalesce({_STEPS}, '') || chr(10) AS text
      FROM g LEFT JOIN cases c ON c.id = g.id WHERE index_name = 'test_patterns' AND rank < 3)
    SELECT controller, query_text, {', '.join(_HITS_OF.format(index, name) for name, index in INDICES.items())},
    coalesce('{HEADER}' || (SELECT string_agg(text, '' ORDER BY rank) FROM x WHERE x.controller = t.controller), '{NO_EXAMPLES}') AS examples FROM t""",
    name="retrieve_context",
)
def contexts(endpoints: DataFrame, models: DataFrame, vectors: DataFrame, items: DataFrame) -> DataFrame:
    """The context of every specification, its hits as ``id:score``."""
    rows = retrieve_context(endpoints, models, vectors, items, encoder=lambda text: hash_embedding(text, 64))
    shown = lambda name: F.array_join(F.transform(name, lambda h: F.format_string("%d:%.4f", h["id"], h["score"])), ",").alias(name)
    return rows.select("controller", "query_text", *[shown(n) for n in INDICES], "examples")
