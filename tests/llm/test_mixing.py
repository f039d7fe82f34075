import re

import duckdb
import pytest

from lakeloom.llm import mixing
from tests.llm.fixtures import documents, rows


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def reshare(sizes, weights=(3, 1, 2)):
    """Targets as the contract words them, step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, got = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not over:
            return got | {s: w[s] * level for s in open_}
        for s in over:
            got[s] = 2 * sizes[s]
            left -= got[s]
        open_ -= over
    return got


def check(out, data):
    sizes, taken, largest = {}, {}, {}
    size = {}
    for r in data:
        n = len(split(r[1]))
        sizes[r[3]] = sizes.get(r[3], 0) + n
        largest[r[3]] = max(largest.get(r[3], 0), n)
        size[r[0]] = (n, r[3])
    want = reshare(sizes)
    assert len(out) == len(data)
    for r in out:
        n, source = size[r["doc_id"]] if r["doc_id"] is not None else (r["size"], None)
        assert r["size"] == n and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source])
        assert r["taken"] in (0, n, 2 * n)
        taken[source] = taken.get(source, 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s]


def test_edge_rows(spark):
    check(mixing.mix_sources(documents(spark, clash=True)).collect(), rows())
    assert mixing.mix_sources(documents(spark, [])).collect() == []
    assert {r["taken"] for r in mixing.mix_sources(documents(spark, [(1, None, None, "a", 0), (2, "", None, "b", 0)])).collect()} == {0}


def test_query(spark, small):
    data = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    out = mixing.op6_mix_sources(spark, small).collect()
    check(out, data)
    assert sorted(out) == sorted(mixing.op6_mix_sources(spark, small).collect())


def test_oracle_agrees(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(mixing.ORACLE_SQL).fetchall()
    got = mixing.op6_mix_sources(spark, small)
    assert got.columns == [d[0] for d in con.sql(mixing.ORACLE_SQL).description]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_documents_are_repeated_as_taken(spark):
    docs = documents(spark, clash=True)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = sum(r["taken"] for r in mixing.mix_sources(docs).collect())
    assert want == out.select(mixing.words().alias("n")).groupBy().sum("n").first()[0]
