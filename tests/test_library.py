"""Small cases typed by hand, and comparisons with plain Python."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from qaspark.functions import tables
from qaspark.operators import assertions, cases, chunking, datagen, endpoints, knowledge, reports, rewards, sourcecode, validation, vectors
from qaspark.operators.results import result_summary
from qaspark.sources import adapters


def test_empty_results(spark):
    empty = spark.createDataFrame([], "passed boolean, execution_time double")
    assert result_summary(empty).first().asDict() == {"total": 0, "passed": 0, "failed": 0, "pass_rate": 0.0, "total_time": 0.0, "average_time": 0.0}


def test_sliding_chunks_cover_every_sentence():
    text = "One short sentence here. " * 40 + "x" * 600 + ". Last one."
    pieces = chunking.sliding(text)
    sentences = [s for s in chunking.SENTENCE_END.split(text) if s]
    assert all(any(s.strip() in p[0] for p in pieces) for s in sentences)
    assert all(len(p[0]) == p[2] - p[1] for p in pieces)
    assert chunking.sliding("") == []


def test_semantic_and_code_chunks():
    assert [p[0] for p in chunking.semantic("a\n\nb\n\n" + "c" * 600)] == ["a\n\nb", "c" * 600]
    assert [p[0] for p in chunking.code("import x\ndef a():\n  pass\nclass B:\n  y = 1\n")] == ["import x\n", "def a():\n  pass\n", "class B:\n  y = 1\n"]
    assert len(chunking.code("void f() {\n a();\n}\nvoid g() {\n}\n", "java")) == 2


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 8))
    rows = [(i, "a" if i % 2 else "b", [float(x) for x in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "id long, index_name string, vec array<float>")
    got = vectors.nearest(df, df.where("id < 5"), 3).collect()
    for q in range(5):
        for name in ("a", "b"):
            ids = [i for i, n, _ in rows if n == name]
            d = [(round(float(((np.float32(base[i]).astype(float) - np.float32(base[q]).astype(float)) ** 2).sum()), 6), i) for i in ids]
            assert [r.id for r in sorted((r for r in got if r.query_id == q and r.index_name == name), key=lambda r: r.rank)] == [i for _, i in sorted(d)[:3]]


def test_ivf_recall(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, "a", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 6)))], "id long, index_name string, vec array<float>")
    queries = df.where("id % 50 = 0")
    exact = {(r.query_id, r.id) for r in vectors.nearest(df, queries, 10).collect()}
    got = {(r.query_id, r.id) for r in vectors.ivf_search(df, queries, nlist=20, nprobe=12, exact=False).collect()}
    assert len(exact & got) >= 0.9 * len(exact)


def test_ivf_recall_of_the_fast_mode(spark):
    vectors_of = adapters.load(spark, "/root/testdata/sf0.01", "vectors")
    queries = vectors_of.where("id % 50 = 0").select("id", "vec")
    exact = {(r.query_id, r.id) for r in vectors.knn_join(vectors_of, queries).collect()}
    got = {(r.query_id, r.id) for r in vectors.ivf_search(vectors_of, queries, nprobe=30, exact=False).collect()}
    assert len(exact & got) >= 0.9 * len(exact)


def test_texts_without_tests_are_cut_by_sentences(spark):
    docs = spark.createDataFrame([(1, "No test here. " * 60), (2, "x\ndef test_a():\n  1\ndef test_b():\n  2"), (3, None)], "doc_id long, content string")
    got = {(r.doc_id, r.chunk_index): (r.text, r.test_name) for r in chunking.chunk_tests(docs).collect()}
    assert got[(2, 0)] == ("def test_a():\n  1", "test_a") and got[(2, 1)] == ("def test_b():\n  2", "test_b")
    assert [got[(1, i)][0] for i in range(2)] == [p[0] for p in chunking.sliding("No test here. " * 60)][:2] and (2, 2) not in got


def test_patterns_of_a_request_without_method(spark):
    patterns = spark.createDataFrame([("p", ["All", "GET"]), ("q", ["PUT"])], "pattern string, applicable_to array<string>")
    requests = spark.createDataFrame([(1, None), (2, "PUT"), (3, "GET")], "id long, method string")
    assert sorted(map(tuple, knowledge.patterns_for_method(requests, patterns).collect())) == [(1, "p"), (2, "p"), (2, "q"), (3, "p")]


def test_numbers_have_no_gaps(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2).alias("g"), "id")
    got = tables.numbered(rows, ["g"], [F.desc("id")], "n").collect()
    for g in (None, 0, 1):
        assert [r.n for r in sorted((r for r in got if r.g == g), key=lambda r: -r.id)] == list(range(sum(r.g == g for r in got)))


def test_mmr_without_diversity_keeps_score_order(spark):
    df = spark.createDataFrame([(i, "api_patterns", [float(i), 1.0]) for i in range(20)], "id long, index_name string, vec array<float>")
    got = vectors.mmr(df, df.where("id = 3"), k=4, diversity="none").orderBy("position").collect()
    assert [r.id for r in got] == [3, 2, 4, 1]
    assert vectors.mmr(df, df.where("id = 3"), k=4).count() == 4


@pytest.mark.parametrize(
    ("assertion", "body", "kind", "passed"),
    [
        ("a.length == 3", '{"a": "xyz"}', "length", True),
        ("a == null", '{"a": null}', "equals", False),
        ("ok == True", '{"ok": true}', "equals", True),
        ("a >= 5", '{"a": 9}', "error", False),
        ("a is null", "{}", "null", True),
        ("nonsense", "{}", "unknown", False),
        ("a.b > 2", '{"a": {"b": 2.5}}', "greater_than", True),
    ],
)
def test_assertions(spark, assertion, body, kind, passed):
    row = assertions.evaluate_assertions(spark.createDataFrame([(1, assertion, body)], "id long, assertion string, response_json string")).first()
    assert (row.type, row.passed) == (kind, passed)


def test_restbed_and_django_routes(spark):
    code = [("a.cpp", "cpp", 'r->set_path("/x"); r->set_method_handler("GET", f); r->set_method_handler("PUT", g);'), ("u.py", "python", "urlpatterns = [path('items/', views.items)]")]
    files = spark.createDataFrame(code, "path string, language string, code string")
    assert {(r.http_method, r.route) for r in sourcecode.endpoints_cpp(files).collect()} == {("GET", "/x"), ("PUT", "/x")}
    assert [(r.framework, r.function_name, r.route) for r in sourcecode.endpoints_python(files).collect()] == [("django", "items", "/items/")]


def test_missing_values_do_not_crash(spark):
    cases = spark.createDataFrame([(1, 1, None, None, None, None, None)], "ordinal long, suite_id long, name string, method string, endpoint string, test_type string, test_case string")
    assert validation.validate_test_cases(cases).first().error == "Missing required fields: ['name']"
    assert validation.valid_http_method(cases).first().valid is False


def test_dataclasses_and_models(spark):
    code = "import x\n\n@dataclass\nclass Point:\n    x: int\n    y: float = 0.0\n\n@dataclass(frozen=True)\nclass Name(Base):\n    text: str\n\nclass Plain:\n    z: int\n\nclass Item(BaseModel):\n    size: int\n\ndef f(a: int):\n    b: int = 1\n"
    files = spark.createDataFrame([("m.py", "python", code)], "path string, language string, code string")
    got = {(r.model, r.field, r.type) for r in sourcecode.models_inventory(files).collect()}
    assert got == {("Point", "x", "int"), ("Point", "y", "float"), ("Name", "text", "str"), ("Item", "size", "int")}


def test_parameters_of_handlers(spark):
    python = "@app.get('/a/{n}')\nasync def a(n: int = Path(...), h: str = Header(None), body: Item):\n    return n\n\n@app.delete('/b')\ndef b():\n    pass\n"
    java = '@RestController\nclass A {\n @PostMapping("/x")\n public Item add(@RequestBody Item item, @RequestParam(value = "page", required = false) int p, Locale where) {\n }\n}\n'
    files = spark.createDataFrame([("a.py", "python", python), ("A.java", "java", java)], "path string, language string, code string")
    assert {(r.function_name, r.parameters) for r in sourcecode.endpoints_python(files).collect()} == {("a", "n:int:path:required,h:str:header:optional,body:Item:body:required"), ("b", "")}
    assert [r.parameters for r in sourcecode.endpoints_java(files).collect()] == ["item:Item:body,page:int:query"]
    got = {(r.name, r.return_type, r.parameters) for r in sourcecode.methods_inventory(files).collect()}
    assert ("a", "", "n: int = Path(...), h: str = Header(None), body: Item") in got and ("add", "Item", '@RequestBody Item item, @RequestParam(value = "page", required = false) int p, Locale where') in got


def test_arrays_of_knowledge(spark, tmp_path):
    (tmp_path / "edge_cases.json").write_text('[\n  {"id": "a", "name": "x",\n   "tags": [1, 2]},\n  {"id": "b"}\n]\n')
    (tmp_path / "bug_patterns.json").write_text("[]")
    got = sorted(tuple(r) for r in reports.read_arrays(spark, str(tmp_path)).collect())
    assert got == [("edge_cases", "a", '{"id":"a","name":"x","tags":[1,2]}'), ("edge_cases", "b", '{"id":"b"}')]
    assert reports.read_arrays(spark, str(tmp_path / "nothing")).collect() == []


def test_responses_with_assertions(spark):
    rows = [(1, 200, 200, None, '{"a": 1}', None), (2, 200, 200, '{"a": {"b": 1}}', '{"a": {"b": 1, "c": 2}}', ["a.b == 1"]), (3, 200, 200, "{}", '{"a": 1}', ["a > 0", "a == 2"]), (4, 200, None, "{}", "broken", []), (5, 200, 200, '{"l": [1]}', '{"l": [1, 2]}', [])]
    df = spark.createDataFrame(rows, "id int, expected_status int, actual_status int, expected string, actual string, assertions array<string>")
    got = {r.id: (r.status_ok, r.body_ok, r.assertions_ok, r.passed) for r in assertions.validate_responses(df).collect()}
    assert got == {1: (True, True, True, True), 2: (True, True, True, True), 3: (True, True, False, False), 4: (False, True, True, False), 5: (True, False, True, False)}


def test_missing_columns_of_documents(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "d"), (3, None, None), (4, "", "d")], "id int, text string, description string")
    assert {r.id: r.content for r in cases.extract_content(df).collect()} == {1: "a", 2: "description: d"}
    case = spark.createDataFrame([(1, [("go", "", "")])], "id int, steps array<struct<action:string,expected_result:string,data:string>>")
    assert cases.format_case_document(case).first().document == "Test: Unnamed\nType: unknown\nEndpoint: \nMethod: \nSteps:\n  1. go"
    record = spark.createDataFrame([(1, "", "GET", None, 5)], "id int, endpoint string, method string, name string, size int")
    assert cases.structured_text(record).first().text == "Method: GET | size: 5"


def test_headers(spark):
    df = spark.createDataFrame([(1, "get", {"a": "b"}, None, None), (2, "POST", {}, {"Authorization": "x", "Accept": "y"}, "t")], "ordinal int, method string, test_data map<string,string>, headers map<string,string>, auth_token string")
    got = {r.ordinal: (r.query_params, r.body, r.headers) for r in endpoints.request_shape(df).collect()}
    assert got[1] == ("a=b", None, ["Accept: application/json", "Content-Type: application/json"])
    assert got[2] == (None, "{}", ["Accept: y", "Authorization: Bearer t", "Content-Type: application/json"])


def test_rewards_without_supplied_signals(spark):
    rows = adapters.load(spark, "/root/testdata/sf0.001", "results")
    plain = {r.session_id: r.raw for r in rewards.session_reward(rows).collect()}
    none = spark.createDataFrame([], "session_id long, test_failures int")
    assert {r.session_id: r.raw for r in rewards.session_reward(rows, supplied=none).collect()} == plain


def test_values_within_bounds(spark):
    df = spark.createDataFrame([(i, f"n{i}", "number", 3, 5, None, None) for i in range(50)], "id int, name string, type string, min_value int, max_value int, min_length int, max_length int")
    values = [float(r.value) for r in datagen.valid_values(df).collect()]
    assert all(3 <= v <= 5 for v in values) and any(v != int(v) for v in values)


def test_strategies_and_weights_are_pluggable(spark):
    docs = spark.createDataFrame([(1, "a|b", "bars"), (2, "One. Two.", "unheard of"), (3, "x\ndef test_a():\n  1\ndef test_b():\n  2", "test"), (4, "plain", None)], "doc_id long, content string, strategy string")
    bars = lambda text: [(p, 0, len(p)) for p in text.split("|")]
    got = {(r.doc_id, r.chunk_index): (r.text, r.strategy) for r in chunking.chunk_documents(docs, strategies=chunking.STRATEGIES | {"bars": bars}).collect()}
    assert got == {(1, 0): ("a", "bars"), (1, 1): ("b", "bars"), (2, 0): ("One. Two.", "sliding"), (3, 0): ("def test_a():\n  1", "test"), (3, 1): ("def test_b():\n  2", "test"), (4, 0): ("plain", "sliding")}
    results = spark.createDataFrame([(1, False, "security", "e", "GET", "{}", "boom"), (1, True, "edge_case", "e", "GET", "{}", None)], "session_id long, passed boolean, test_type string, endpoint string, method string, request_data string, error string")
    own = {k: 0.0 for k in rewards.WEIGHTS} | {"bugs_found": 7.0}
    assert rewards.session_reward(results, own).first().raw == 7.0
