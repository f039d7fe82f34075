"""First violations of a closed schema."""

from lakeloom.operators.schema import ORDER, first_violations

CASES = [
    ('{"id":1,"price":{"total":1},"lines":[]}', None),
    ('{"id":1,"price":{"total":1.5,"cents":null},"note":"x","lines":[{"n":1,"q":2}]}', None),
    ('{"id":true,"price":{"total":1},"lines":[]}', ("TYPE", "$.id")),
    ('{"id":1,"price":[],"lines":[]}', ("TYPE", "$.price")),
    ('{"id":1,"price":{},"lines":[]}', ("REQUIRED", "$.price.total")),
    ('{"zz":{"a":1},"id":1,"price":{"total":1},"lines":[]}', ("UNKNOWN_KEY", "$.zz")),
    ('{"id":1,"price":{"total":1},"lines":[' + ",".join(['{"n":1,"q":2}'] * 10) + ',{"n":1,"q":"2"}]}', ("TYPE", "$.lines[10].q")),
    ('{"id":1,"price":{"total":1},"lines":[' + ",".join(['{"n":1,"q":2}'] * 2 + ['{"n":1}'] + ['{"n":1,"q":2}'] * 7) + ",7]}", ("REQUIRED", "$.lines[2].q")),
    ("[1]", ("TYPE", "$")), ("", ("NOT_JSON", "$")), (None, ("NOT_JSON", "$")), ('{"id":1', ("NOT_JSON", "$")),
]


def test_first_violations(spark):
    docs = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(CASES)], "id long, body string")
    got = {r["id"]: (r["code"], r["path"]) for r in first_violations(docs, ORDER).collect()}
    assert got == {i: w for i, (_, w) in enumerate(CASES) if w}


def test_documents_are_parsed_once(spark):
    """Every level began at the documents again."""
    docs = spark.createDataFrame([(1, '{"a": [{"b": null}, 3], "zz": 1}'), (2, '{"a": [{"b": 1}]}'), (3, "{"), (4, None)], "id long, body string")
    out = first_violations(docs, {"$": ("object", True), "$.a": ("array", True), "$.a[]": ("object", True), "$.a[].b": ("integer|null", True)})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") + out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1
    assert sorted(map(tuple, out.collect())) == [(1, "TYPE", "$.a[1]"), (3, "NOT_JSON", "$"), (4, "NOT_JSON", "$")]
