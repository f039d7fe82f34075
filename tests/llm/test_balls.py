import hashlib
import math

import duckdb
import numpy as np
import pytest

from lakeloom.llm import balls

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def kept(data, dim, scale=256):
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in data if v is not None and len(v) == dim and all(x is not None and math.isfinite(np.float32(x)) for x in v)]


def brute(data, k, dim, rounds=5):
    rows = kept(data, dim)
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    m = [v for _, v in first[:k]]
    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(m))
    for _ in range(rounds):
        own = {}
        for _, v in rows:
            own.setdefault(near(v)[1], []).append(v)
        m = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if j in own else m[j] for j in range(len(m))]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in rows), key=str), m


def run(spark, data, k, dim):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in data], SCHEMA)
    got, centroids = balls.cluster(df, k=k, dim=dim)
    return sorted(map(tuple, got.collect()), key=str), centroids.tolist()


@pytest.mark.parametrize("tree", [2048, 70])
def test_clumps_ties_and_odd_rows(spark, monkeypatch, tree):
    monkeypatch.setattr(balls, "TREE_ROWS", tree)
    monkeypatch.setattr(balls, "LEAF_ROWS", 4)
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(6, 5)) * 4
    data = [(i, (middle[i % 6] + rng.normal(size=5) * 0.1).tolist()) for i in range(300)]
    data += [(1000 + i, [0.5] * 5) for i in range(60)] + [(2000 + i, [float(i % 3), 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # equal vectors, ties
    data += [(None, [0.25] * 5), (3000, None), (3001, []), (3002, [1.0] * 4), (3003, [1.0, None, 1.0, 1.0, 1.0]), (3004, [float("nan")] * 5), (3005, [float("-inf")] * 5), data[0], data[0]]
    assert run(spark, data, 9, 5) == brute(data, 9, 5)


def test_few_and_no_rows(spark):
    assert run(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], 9, 2) == brute([(1, [1.0, 2.0]), (2, [3.0, 4.0])], 9, 2)
    assert run(spark, [], 9, 2)[0] == []
    assert run(spark, [(None, [1.0, 2.0])], 9, 2)[0] == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    for reach in (2e4, 3e6, 1e12):
        data = [(i, (rng.normal(size=3) * reach).tolist()) for i in range(80)]
        got, want = run(spark, data, 5, 3), brute(data, 5, 3)
        assert got[1] == want[1]
        assert got[0] == sorted(((i, c, min(d, 2**63 - 1)) for i, c, d in want[0]), key=str)


def test_balls_go_whole():
    """Far clumps: one centroid each, so whole balls go and few rows are compared."""
    rng = np.random.default_rng(3)
    middle = rng.integers(-100_000, 100_000, size=(8, 16))
    vectors = (middle[rng.integers(0, 8, 2000)] + rng.integers(-50, 50, size=(2000, 16))).astype(np.int64)
    _, tree = balls.Tree.build(vectors)
    pieces = list(tree.assign(middle.astype(np.int64)))
    assert sum(tree.last[n] - tree.first[n] for n, _, _ in pieces) == 2000
    assert sum(tree.last[n] - tree.first[n] for n, _, c in pieces if c is None) > 1600 and len(pieces) < 150


def test_query_and_oracle(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    got = balls.op13_ball_tree_clusters(spark, small)
    assert sorted(got.columns) == sorted(d[0] for d in con.sql(balls.ORACLE_SQL).description)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(balls.ORACLE_SQL).fetchall())
