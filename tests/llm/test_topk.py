import math

import duckdb
import numpy as np

from lakeloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, norm string"


def brute(data, k=10, every=100):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in data if i is not None and v and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    out = set()
    for qid in {i for i, _ in ok if i % every == 0}:
        q = max(v for i, v in ok if i == qid)
        hits = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in ok if i != qid and len(v) == len(q))[:k]
        out |= {(qid, r, i, -s) for r, (s, i) in enumerate(hits, 1)}
    return out


def run(spark, data, **options):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in data], SCHEMA)
    got = topk.top_inner_products(df, **options).collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


def test_edge_vectors(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=5).tolist()) for i in range(60)] + [(100 * i, rng.normal(size=5).tolist()) for i in range(1, 5)]
    data += [(200 + i, [0.5] * 5) for i in range(1, 40)]  # ties
    data += [(700, None), (701, []), (702, [1.0, None, 0.0, 0.0, 0.0]), (800, [float("nan")] * 5), (801, [float("inf")] * 5), (None, [1.0] * 5)]
    data += [(900, [1.0, 2.0]), (901, [3.0, 4.0]), (1000, [0.0] * 5), (1001, [3e7] * 5)]
    assert run(spark, data) == brute(data)
    assert run(spark, []) == set()


def test_blocks_and_pruning(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "ROWS_PER_PARTITION", 200)
    rng = np.random.default_rng(2)
    lengths = np.exp(rng.normal(0, 1.5, 900))
    data = [(i, (rng.normal(size=16) * s).tolist()) for i, s in enumerate(lengths)]
    assert run(spark, data, query_every=25) == brute(data, every=25)


def test_huge_components_are_exact():
    big = np.array([[2**62, -3], [5, 2**40]], np.int64)
    want = np.clip(big.astype(object) @ big.astype(object).T, -(2**63), 2**63 - 1)
    assert (topk._exact(big, big) == want.astype(np.int64)).all()


def test_query_and_oracle(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    got = topk.op2_top_inner_products(spark, small)
    assert got.columns == [d[0] for d in con.sql(topk.ORACLE_SQL).description]
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(topk.ORACLE_SQL).fetchall())
