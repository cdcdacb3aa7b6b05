"""Specifications, endpoint rules, contexts, reports and responses: small cases typed by hand."""

import glob
import json

from pyspark.sql import functions as F

from qaspark.functions.tables import shared_folder
from qaspark.operators import context, endpoints, reports, responses, specification, vectors

RAW = "ordinal long, path string, http_method string, controller string, method_name string, authorization_required boolean, parameters array<struct<name:string,type:string,source:string,required:boolean>>"
MODEL = "name string, ordinal long, properties array<struct<name:string,type:string,nullable:boolean>>"


def raw(spark):
    id_, q = ("id", "int", "route", True), ('q"u', "List<int>", "cookie", None)
    return spark.createDataFrame(
        [(1, "/a", "get", "C", "Old", False, []), (2, "/a", "GET", "C", "New", True, [id_, q]), (3, "/a", "POST", None, None, None, None), (4, None, None, "C", "x", False, [(None, None, None, None)])], RAW
    )


def test_the_document_is_one_json_object(spark):
    models = spark.createDataFrame([("M", 1, [("gone", "int", False)]), ("M", 2, [("b", "DateTime?", True), ("a", "int", False), ("b", "Guid", None)]), (None, 3, None)], MODEL)
    folder = shared_folder(spark)
    specification.write_specification(raw(spark), models, folder)
    text = "\n".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{folder}/part-*")))
    answers = {"200": {"description": "Successful response"}, "400": {"description": "Bad request"}, "401": {"description": "Unauthorized"}, "404": {"description": "Not found"}, "500": {"description": "Internal server error"}}
    assert json.loads(text) == {
        "components": {
            "schemas": {
                "M": {"type": "object", "properties": {"a": {"type": "integer", "nullable": False}, "b": {"type": "string", "nullable": False}}},
                "UnknownModel": {"type": "object", "properties": {}},
            }
        },
        "paths": {
            "/a": {
                "get": {
                    "operationId": "New",
                    "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "integer"}}, {"name": 'q"u', "in": "query", "required": False, "schema": {"type": "object"}}],
                    "responses": answers,
                    "security": [{"BearerAuth": []}],
                },
                "post": {"operationId": "unknown", "parameters": [], "responses": answers},
            },
            "/unknown": {"get": {"operationId": "x", "parameters": [{"name": "unknown", "in": "query", "required": False, "schema": {"type": "string"}}], "responses": answers}},
        },
    }


def test_records_are_told_apart_by_three_keys(spark):
    rows = [(3, "/a", "GET", "later", "x"), (1, "/a", "GET", "first", "y"), (2, "/a", None, "n", "z"), (4, None, None, "n", "other"), (5, None, None, None, "r"), (6, None, None, None, "r"), (7, None, None, None, "s")]
    df = spark.createDataFrame(rows, "ordinal long, path string, http_method string, name string, more string")
    assert sorted(tuple(r) for r in endpoints.dedupe_parsed(df).collect()) == [(1, "/a", "GET", "first", "y"), (2, "/a", None, "n", "z"), (5, None, None, None, "r"), (7, None, None, None, "s")]
    again = spark.createDataFrame([(0, "r")], "ordinal long, more string")
    assert {r.ordinal for r in endpoints.combine_parsed([df, again]).collect()} == {0, 1, 2, 7}


def test_rules_without_their_columns(spark):
    plain = raw(spark)
    assert [r.required for r in endpoints.endpoint_auth(plain).orderBy("ordinal").collect()] == [False, True, False, False]
    assert [r.tags for r in endpoints.endpoint_tags(plain).orderBy("ordinal").collect()] == ["C,query", "C,query", "mutation", "C,query"]
    got = endpoints.normalize_endpoints(plain.withColumn("return_type", F.lit("int?"))).orderBy("ordinal").collect()
    assert [(r.path, r.method, r.name) for r in got] == [("/a", "GET", "Old"), ("/a", "GET", "New"), ("/a", "POST", "unknown"), ("/", "GET", "x")]
    assert endpoints.assess_complexity(plain.withColumn("n_responses", F.lit(None).cast("int")).withColumn("n_dependencies", F.lit(0))).where("points is null").isEmpty()
    docs = {r.doc_id: r.content for r in endpoints.format_operation_document(plain).collect()}
    assert docs["/a_POST"] == "Operation: \nController: "
    urls = spark.createDataFrame([(1, None, {"id": "3"}), (2, "/x/{id}", {"id": "3"})], "ordinal long, endpoint string, test_data map<string,string>")
    assert [r.url for r in endpoints.build_url(urls, "http://h").orderBy("ordinal").collect()] == [None, "http://h/x/3"]


def test_models_of_endpoints_without_a_controller(spark):
    models = spark.createDataFrame([(None, 1, "M"), ("C", 1, "N")], "controller string, ordinal long, model string")
    got = {r.controller: r.query_text for r in endpoints.assemble_context(raw(spark), models).collect()}
    assert got == {"C": "GET /a GET /a GET /unknown C N", None: "POST /a M"}


def test_context_of_a_specification(spark):
    vec = lambda text: vectors.fitted(vectors.hash_encoder(16)([text]), 16)[0].tolist()
    near = vec("POST /a M")
    base = [(i, name, [x + 0.01 * i for x in near]) for i in range(6) for name in ("test_patterns", "edge_cases", "code")] + [(9, "edge_cases", [9.0 + x for x in near])]
    items = spark.createDataFrame([(0, "Login", "Check <it>", [("Open", "Shown"), ("Type", None), ("Third", "x")]), (1, None, "", None)], "id long, title string, description string, steps array<struct<action:string,expected_result:string>>")
    models = spark.createDataFrame([(None, 1, "M")], "controller string, ordinal long, model string")
    rows = context.retrieve_context(raw(spark).where("controller is null"), models, spark.createDataFrame(base, "id long, index_name string, vec array<double>"), items, k=4, encoder=lambda t: vectors.hash_embedding(t, 16))
    r = rows.first()
    assert [h.id for h in r.similar_tests] == [0, 1, 2, 3] and [h.id for h in r.edge_cases] == [0, 1, 2, 3] and r.validation_patterns == []
    assert r.examples == context.HEADER + (
        "Example 1 (relevance: 100.0%): Login\n  Description: Check <it>\n  Step: Open\n    Expected: Shown\n  Step: Type\n\n"
        "Example 2 (relevance: 99.8%): Unknown\n\nExample 3 (relevance: 99.4%): Unknown\n\n"
    )
    none = context.retrieve_context(raw(spark), models, spark.createDataFrame([], "id long, index_name string, vec array<double>"), items, encoder=lambda t: vectors.hash_embedding(t, 16)).collect()
    assert {r.examples for r in none} == {context.NO_EXAMPLES} and len(none) == 2


def test_a_report_is_one_page(spark):
    schema = "id long, name string, passed boolean, test_type string, endpoint string, method string, execution_time double, error string"
    rows = spark.createDataFrame([(1, 'a<b & "c"', False, "security", "/x", "GET", 1.5, "x > y"), (2, None, True, None, None, "PUT", None, None)], schema)
    folder = shared_folder(spark)
    reports.write_html(rows, "T & U", "now", folder)
    page = "\n".join(open(f, encoding="utf-8").read().rstrip("\n") for f in sorted(glob.glob(f"{folder}/part-*")))
    assert page.startswith("<!DOCTYPE html>\n<html>\n<head>\n<title>T &amp; U</title>") and page.endswith("</body>\n</html>") and "<p><strong>Pass Rate:</strong> 50.00%</p>" in page
    assert '<div class="test-case failed critical">\n<h3>a&lt;b &amp; &quot;c&quot; - FAILED</h3>\n<p><strong>Type:</strong> security</p>\n<p><strong>Endpoint:</strong> GET /x</p>' in page
    assert "<p><strong>Error:</strong> x &gt; y</p>" in page and page.count("<strong>Error") == 1 and page.index("a&lt;b") < page.index("Unnamed Test")


def test_lists_and_sections(spark):
    texts = ['["x","y"]', "```\n[1, [2]]\n```", "- a\n\n 2. b\n*c", '{"a": 1}', None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r["items"] for r in responses.parse_list_responses(df).collect()}
    assert got == {0: ["x", "y"], 1: ["1", "[2]"], 2: ["a", "b", "c"], 3: ['{"a": 1}'], 4: None, 5: []}
    df = spark.createDataFrame([(1, "intro\n1. One Two\na\nb\n# One Two\nc\n**Other**\n"), (2, "only text"), (3, None)], "id long, text string")
    got = {(r.id, r.section): r.content for r in responses.parse_sections(df).collect()}
    assert got == {(1, "content"): ["intro"], (1, "one_two"): ["a\nb", "c"], (1, "other**"): [""], (2, "content"): ["only text"]}
