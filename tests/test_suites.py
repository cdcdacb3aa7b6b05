"""Suite trees as JSON texts and as tables; broken files; rows in place of unbounded groups."""

import json
import random

from qaspark.operators import cases, endpoints, validation, validators


def tree(rng, depth, ids, table, parent=None):
    """A random suite as a dict; its rows go to ``table``: suites (id, parent_id, title) and cases (id, suite_id)."""
    me = len(table[0])
    title = rng.choice(["A", "B b", "", None])
    table[0].append((me, parent, title))
    found = {"cases": [{"id": next(ids), "title": "x", "n": 5} for _ in range(rng.randrange(3))]} | ({"title": title} if title is not None else {})
    table[1].extend((c["id"], me) for c in found["cases"])
    if depth:
        found["suites"] = [tree(rng, depth - 1, ids, table, me) for _ in range(rng.randrange(1, 3))]
    return found


def test_both_forms_give_equal_rows(spark):
    rng, table = random.Random(6), ([], [])
    ids = iter(range(10**6))
    files = [(f"f{k}", json.dumps({"suites": [tree(rng, 4, ids, table) for _ in range(2)]})) for k in range(4)]
    got = {(r.id, r.suite_path) for r in cases.flatten_suites(spark.createDataFrame(files, "path string, content string")).collect()}
    suites = spark.createDataFrame([*table[0], (900, 901, "cycle"), (901, 900, "cycle")], "id long, parent_id long, title string")
    rows = cases.flatten_suite_table(suites, spark.createDataFrame([*table[1], (-1, 900)], "id long, suite_id long")).collect()
    assert {(r.id, r.suite_path) for r in rows} == got and len(rows) == len(table[1])
    assert max(r.depth for r in rows) >= 4 and all(r.suite_path.count(" > ") == r.depth - 1 for r in rows)


def test_broken_files_do_not_stop_the_others(spark):
    deep = '{"suites":[' + '{"suites":[' * 400 + '{"title":"end","cases":[{"id":1,"x":null}]}' + "]}" * 400 + "]}"
    texts = {"null": None, "cut": '{"suites": [', "list": "[1, 2]", "text": '{"suites": ["x"]}', "none": "{}", "empty": '{"suites":[{"cases":[]}]}', "deep": deep, "lost": "[" * 200_000}
    got = {}
    for r in cases.flatten_suites(spark.createDataFrame(list(texts.items()), "path string, content string")).collect():
        got.setdefault(r.path, []).append((r.id, r.error))
    assert got == {"null": [(None, "no content")], "cut": [(None, "no JSON")], "list": [(None, "no suite tree")], "text": [(None, "no suite tree")], "deep": [(1, None)], "lost": [(None, "nested too deeply")]}


def test_groups_stay_rows(spark):
    rows = [(i, 1 if i < 90 else 2, "n", "GET", "/a", "t", None) if i % 3 or i >= 90 else (i, 1, None, "GET", "/a", "t", None) for i in range(100)]
    df = spark.createDataFrame(rows, "ordinal long, suite_id long, name string, method string, endpoint string, test_type string, test_case string")
    got = validation.validate_suite(df).collect()
    assert sorted(r.idx for r in got if r.suite_id == 1) == list(range(0, 90, 3)) and [(r.is_valid, r.error) for r in got if r.suite_id == 2] == [(True, None)]
    raw = spark.createDataFrame([(i, "/v1/a/b" if i % 2 else None, None) for i in range(20)], "ordinal long, path string, http_method string")
    got = endpoints.endpoints_by_resource(raw).collect()
    assert sorted((r.position, r.n) for r in got if r.resource == "a") == [(k, 10) for k in range(10)] and {r.endpoint for r in got} == {"GET /v1/a/b", "GET /"}
    rules = spark.createDataFrame([(2, "m", "f", ["c"], None), (1, "m", "f", ["a", "b"], ["v"]), (3, "m", "g", [], ["w"])], "ordinal long, model string, field string, rules array<string>, validations array<string>")
    got = {(r.key, r.kind, r.position): r.value for r in validators.merge_validators(rules).collect()}
    assert got == {("m_f", "rules", 0): "a", ("m_f", "rules", 1): "b", ("m_f", "rules", 2): "c", ("m_f", "validations", 0): "v", ("m_g", "validations", 0): "w"}
