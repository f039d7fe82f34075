"""Documents against a closed schema: the first violation by path.

A document is parsed once into a variant and taken apart level by level, only
along paths that the schema knows, so the number of levels is the schema's depth.
At each node the schema says what may be there; a key that it does not name, a
value of another type and a required key that is absent are violations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.derived import frame, oracle
from ..plans.registry import Tables, query

# fixed values: variant types that stand for a schema's types
KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "null": "VOID", "number": "(BIGINT|DOUBLE|DECIMAL)"}


def _kind_fits(kind: str) -> str:
    return "|".join(KINDS[k] for k in kind.split("|"))


def first_violations(docs: DataFrame, schema: dict[str, tuple[str, bool]]) -> DataFrame:
    """``(id, code, path)`` of documents ``(id, body)`` that break ``schema``.

    The schema maps paths (``$``, ``$.key``, ``$.key[].key``) to a type (or
    several, with ``|``) and whether the key is required.  Codes: NOT_JSON,
    UNKNOWN_KEY, TYPE, REQUIRED.  Paths of equal documents are compared as text
    with array places filled up with zeros, so ``$.a[2]`` comes before ``$.a[10]``.
    """
    spark = docs.sparkSession
    required = {path: [p.rpartition(".")[2] for p, (_, needed) in schema.items() if needed and p.rpartition(".")[0] == path and not p.endswith("[]")] for path in schema}
    rules = [(path, _kind_fits(kind), required[path]) for path, (kind, _) in schema.items()]
    known = F.broadcast(spark.createDataFrame(rules, "rule string, kind string, required array<string>"))  # as many rows as the schema has
    parsed = docs.select("id", F.try_parse_json("body").alias("v"))
    # a row is a violation (code) or a node (v); each level passes the ones on and takes the others apart, in one pass over the documents
    rows = parsed.select("id", F.when(F.col("v").isNull(), "NOT_JSON").alias("code"), F.lit("$").alias("path"), F.lit("$").alias("place"), F.lit("$").alias("rule"), "v")
    depth = max(p.count(".") + p.count("[]") for p in schema)
    for _ in range(depth + 2):
        met = rows.join(known, "rule", "left").withColumn("type", F.when(F.col("code").isNull(), F.schema_of_variant("v")))
        fits = F.coalesce(F.rlike(F.col("type"), F.concat(F.lit("^(?:"), F.col("kind"), F.lit(")"))), F.lit(False))
        wrong = F.coalesce("code", F.when(F.col("kind").isNull(), "UNKNOWN_KEY").when(~fits, "TYPE"))
        # objects as maps, arrays as arrays, both of variants; null for anything else
        inside = met.withColumns({
            "wrong": wrong, "fields": F.when(wrong.isNull() & F.col("type").startswith("OBJECT"), F.col("v")).cast("map<string,variant>"), "items": F.when(wrong.isNull() & F.col("type").startswith("ARRAY"), F.col("v")).cast("array<variant>"),
        })

        def row(code: Column, path: Column, place: Column, rule: Column | None = None, v: Column | None = None) -> Column:
            parts = {"code": code, "path": path, "place": place, "rule": F.lit(None).cast("string") if rule is None else rule, "v": F.lit(None).cast("variant") if v is None else v}
            return F.struct(*(c.alias(n) for n, c in parts.items()))

        under = lambda of, *tail: F.concat(F.col(of), *tail)
        none, dot = F.lit(None).cast("string"), F.lit(".")
        own = F.when(F.col("wrong").isNotNull(), F.array(row(F.col("wrong"), F.col("path"), F.col("place"))))
        absent = F.transform(F.array_except("required", F.map_keys("fields")), lambda n: row(F.lit("REQUIRED"), under("path", dot, n), under("place", dot, n)))
        fields = F.transform(F.map_entries("fields"), lambda e: row(none, under("path", dot, e["key"]), under("place", dot, e["key"]), under("rule", dot, e["key"]), e["value"]))
        items = F.transform("items", lambda v, i: row(none, under("path", F.lit("["), i, F.lit("]")), under("place", F.lit("["), F.lpad(i.cast("string"), 10, "0"), F.lit("]")), under("rule", F.lit("[]")), v))
        empty = F.array_repeat(row(none, none, none), 0)
        rows = inside.select("id", F.inline(F.concat(*(F.coalesce(x, empty) for x in (own, absent, fields, items)))))
    return rows.filter("code IS NOT NULL").groupBy("id").agg(F.min(F.struct("place", "code", "path")).alias("m")).select("id", "m.code", "m.path")


#: orders as documents
ORDER = {
    "$": ("object", True), "$.id": ("integer", True), "$.price": ("object", True), "$.price.total": ("number", True), "$.price.cents": ("integer|null", False), "$.note": ("string", False),
    "$.lines": ("array", True), "$.lines[]": ("object", True), "$.lines[].n": ("integer", True), "$.lines[].q": ("integer", True),
}


@query(
    "schema_violations", "FLT-17",
    oracle=oracle("""SELECT doc AS id, CASE doc % 8 WHEN 1 THEN 'UNKNOWN_KEY' WHEN 2 THEN 'TYPE' WHEN 3 THEN 'REQUIRED' WHEN 4 THEN 'TYPE' WHEN 5 THEN 'NOT_JSON' ELSE 'REQUIRED' END AS code,
CASE doc % 8 WHEN 1 THEN '$.price.zz' WHEN 2 THEN '$.id' WHEN 3 THEN concat('$.lines[', n - 1, '].q') WHEN 4 THEN '$.lines[0]' WHEN 5 THEN '$' ELSE '$.id' END AS path FROM {sheets} WHERE r = 0 AND doc % 8 BETWEEN 1 AND 6"""),
)
def schema_violations(t: Tables) -> DataFrame:
    """Orders written as documents, some of which break the schema."""
    last = F.col("r") == F.col("n") - 1
    line = F.concat(F.lit('{"n":'), "line", F.when((F.col("doc") % 8 == 3) & last, "").otherwise(F.concat(F.lit(',"q":'), "q")), F.lit("}"))
    line = F.when((F.col("doc") % 8 == 4) & (F.col("r") == 0), F.lit("[]")).otherwise(line)
    rows = frame(t, "sheets").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))).alias("lines"))
    kind = F.col("doc") % 8
    head = F.when(kind == 2, F.concat(F.lit('"id":"'), F.col("doc").cast("string"), F.lit('","zz":1,'))).when(kind == 6, F.lit("")).otherwise(F.concat(F.lit('"id":'), F.col("doc").cast("string"), F.lit(",")))
    price = F.concat(F.lit('"price":{"total":1.5,"cents":null'), F.when(kind == 1, ',"zz":2').otherwise(""), F.lit("},"))
    tail = F.when(kind == 5, F.lit("]")).otherwise(F.lit("]}"))
    body = F.concat(F.lit("{"), head, price, F.lit('"lines":['), F.array_join("lines.line", ","), tail)
    return first_violations(rows.select(F.col("doc").alias("id"), body.alias("body")), ORDER)
