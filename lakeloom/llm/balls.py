"""Centroid clustering with ball-tree filtering, in exact integers.

Every task packs the vectors it reads into metric trees of a few thousand
vectors, once: a node is a ball with its centre, radius, count and integer sum.
In a round the centroids come down each tree, all nodes of a level at once.  With
the distances of a ball's centre to the centroids, the triangle inequality
leaves those that can be nearest to some vector of the ball; if one is left, the
ball's count and sum go to it whole.  Leaves that are still open compare their
vectors with the remaining centroids by exact squared distances.

A task sends one count and one sum for each centroid and component, so what is
shuffled and what comes to the driver is bounded by centroids times components.

Defined cases: a vector counts if it has exactly ``DIM`` components, none null or
non-finite, whose integers fit in ``BITS`` bits (others leave the exact range and
take no part); rows without vec_id are clustered but never start a centroid;
repeated rows count as often as they occur; starts of equal digests are taken in
the order of their vectors; fewer vectors than centroids give fewer centroids; a
centroid without vectors stays; distances beyond 64 bits are cut to the nearest
long (comparisons and sums are exact); an empty table gives no rows; other
columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, record_batch, staged

SCALE, DIM, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, 2
#: integers of a vector fit in so many bits
BITS = 62
TREE_ROWS = 2048
LEAF_ROWS = 32
LONGEST = 2**63 - 1

_long, _bin = T.LongType(), T.BinaryType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


#: ids with their nulls, vectors in tree order; each node's rows [first, last), its children (or -1), radius and sum
TREES = _struct(ids=T.ArrayType(_long), vectors=_bin, first=_bin, last=_bin, child=_bin, radius=_bin, sums=_bin)
#: a sum of one component of a cluster (component -1: its count)
PARTS = _struct(cluster=T.IntegerType(), component=T.IntegerType(), total=T.DecimalType(38, 0))
NEAREST = _struct(vec_id=_long, cluster=T.IntegerType(), distance=_long)
#: integers up to this size have exact products and sums of DIM squares in doubles, and in longs
IN_DOUBLE, IN_LONG = 1 << 21, 1 << 27


def _exact_kind(reach: int) -> type:
    """The fastest kind of numbers in which squared distances of components up to ``reach`` are exact."""
    return np.float64 if reach < IN_DOUBLE else np.int64 if reach < IN_LONG else object


def squared(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows x to integer rows m."""
    kind = _exact_kind(max((int(abs(int(v.max()))) if v.size else 0) for v in (np.abs(x), np.abs(m))))
    x, m = x.astype(kind), m.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ m.T) + (m * m).sum(axis=1)[None, :]


class Tree:
    """A metric tree over integer vectors; nodes by levels, the root first."""

    def __init__(self, vectors: np.ndarray, first: np.ndarray, last: np.ndarray, child: np.ndarray, radius: np.ndarray, sums: np.ndarray):
        self.vectors, self.first, self.last, self.child, self.radius, self.sums = vectors, first, last, child, radius, sums
        self.centre = sums.astype(np.float64) / (last - first)[:, None]

    @staticmethod
    def build(vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, Tree]:
        """The order of the vectors in the tree, and the tree."""
        order = np.arange(len(vectors))
        real = vectors.astype(np.float64)
        wide = _exact_kind(int(np.abs(vectors).max(initial=0))) is object
        nodes, level = [[0, len(vectors), -1]], [0]
        while level:
            below = []
            for n in level:
                a, b, _ = nodes[n]
                if b - a <= leaf:
                    continue
                x = real[order[a:b]]
                # two poles far apart; the half of the rows nearer to one of them goes left
                one = x[np.argmax(np.square(x - x.mean(axis=0)).sum(axis=1))]
                other = x[np.argmax(np.square(x - one).sum(axis=1))]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(x @ (other - one), half)]
                nodes[n][2] = len(nodes)
                below += [len(nodes), len(nodes) + 1]
                nodes += [[a, a + half, -1], [a + half, b, -1]]
            level = below
        first, last, child = np.array(nodes, np.int64).T
        placed = vectors[order]
        kind = object if wide else np.int64
        upto = np.concatenate([np.zeros((1, vectors.shape[1]), kind), np.cumsum(placed.astype(kind), axis=0)])
        sums = upto[last] - upto[first]
        tree = Tree(placed, first, last, child, np.zeros(len(nodes)), sums)
        for n, (a, b) in enumerate(zip(first, last, strict=True)):
            tree.radius[n] = np.sqrt(np.square(real[order[a:b]] - tree.centre[n]).sum(axis=1).max())
        return order, tree

    def assign(self, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | None]]:
        """Nodes that together hold every row once: ``(node, cluster, None)`` for a ball that goes
        whole, ``(node, -1, candidates)`` for a leaf whose rows are to be decided one by one."""
        real = centroids.astype(np.float64)
        level = np.zeros(1, np.int64)
        open_ = np.ones((1, len(centroids)), bool)
        while len(level):
            centre, radius = self.centre[level], self.radius[level]
            norms = np.square(centre).sum(axis=1)[:, None] + np.square(real).sum(axis=1)[None, :]
            away = np.sqrt(np.maximum(0, norms - 2 * centre @ real.T))
            # what rounding can do: to the squares, then to their roots
            slack = 1e-6 * (1 + radius[:, None]) + np.sqrt(norms) * 1e-6
            within = np.where(open_, away + slack, np.inf).min(axis=1) + radius
            open_ &= away - slack - radius[:, None] <= within[:, None]
            alone = open_.sum(axis=1) == 1
            for i in np.flatnonzero(alone):
                yield int(level[i]), int(np.argmax(open_[i])), None
            leaf = ~alone & (self.child[level] < 0)
            for i in np.flatnonzero(leaf):
                yield int(level[i]), -1, np.flatnonzero(open_[i])
            down = ~alone & ~leaf
            level, open_ = np.repeat(self.child[level[down]], 2), np.repeat(open_[down], 2, axis=0)
            level[1::2] += 1

    def sums_of(self, centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add each cluster's count and sum."""
        for node, cluster, candidates in self.assign(centroids):
            if candidates is None:
                counts[cluster] += int(self.last[node] - self.first[node])
                sums[cluster] += self.sums[node].astype(object)
                continue
            x = self.vectors[self.first[node] : self.last[node]]
            nearest = candidates[np.argmin(squared(x, centroids[candidates]), axis=1)]
            for c in np.unique(nearest):
                own = x[nearest == c]
                counts[c] += len(own)
                kind = np.int64 if int(np.abs(own).max(initial=0)) < 1 << 40 else object
                sums[c] += own.astype(kind).sum(axis=0).astype(object)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each row, in tree order."""
        clusters, distances = np.zeros(len(self.vectors), np.int32), np.zeros(len(self.vectors), np.int64)
        for node, cluster, candidates in self.assign(centroids):
            a, b = self.first[node], self.last[node]
            some = np.array([cluster]) if candidates is None else candidates
            away = squared(self.vectors[a:b], centroids[some])
            best = np.argmin(away, axis=1)
            least = away[np.arange(b - a), best]
            clusters[a:b] = some[best]
            distances[a:b] = np.minimum(least, LONGEST) if least.dtype == object else least
        return clusters, distances


def _column(values: np.ndarray) -> bytes:
    return values.astype(np.int64).tobytes() if values.dtype != np.float64 else values.tobytes()


def _trees(batches: Iterator[pa.RecordBatch], scale: int, dim: int, size: int, leaf: int) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    held: list[np.ndarray] = []

    def tree() -> pa.RecordBatch:
        order, t = Tree.build(np.concatenate(held), leaf)
        own = [ids[i] for i in order]
        sums = t.sums if t.sums.dtype == np.int64 else np.zeros(0, np.int64)  # beyond 64 bits: summed again when read
        data = {"vectors": t.vectors, "first": t.first, "last": t.last, "child": t.child, "radius": t.radius, "sums": sums}
        return record_batch({"ids": [own]} | {k: [_column(v)] for k, v in data.items()}, TREES)

    for batch in batches:
        flat = np.asarray(batch.column("vector").flatten()).astype(np.float64)
        with np.errstate(all="ignore"):
            whole = np.floor(scale * flat).reshape(-1, dim)
        fits = (np.abs(whole) < 2.0**BITS).all(axis=1)
        vec_ids = batch.column("vec_id").to_pylist()
        whole = whole[fits].astype(np.int64)
        vec_ids = [v for v, ok in zip(vec_ids, fits, strict=True) if ok]
        at = 0
        while at < len(whole):
            more = min(size - len(ids), len(whole) - at)
            held.append(whole[at : at + more])
            ids += vec_ids[at : at + more]
            at += more
            if len(ids) >= size:
                yield tree()
                ids, held = [], []
    if ids:
        yield tree()


def _read(row: dict, dim: int) -> Tree:
    ints = {k: np.frombuffer(row[k], np.int64) for k in ("vectors", "first", "last", "child", "sums")}
    vectors = ints["vectors"].reshape(-1, dim)
    if len(ints["sums"]):
        sums = ints["sums"].reshape(-1, dim)
    else:
        upto = np.concatenate([np.zeros((1, dim), object), np.cumsum(vectors.astype(object), axis=0)])
        sums = upto[ints["last"]] - upto[ints["first"]]
    return Tree(vectors, ints["first"], ints["last"], ints["child"], np.frombuffer(row["radius"], np.float64), sums)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, dim = centroids.shape
    counts, sums = np.zeros(k, object), np.zeros((k, dim), object)
    for batch in batches:
        for row in batch.to_pylist():
            _read(row, dim).sums_of(centroids, counts, sums)
    import decimal

    rows = [(c, d, decimal.Decimal(int(sums[c, d] if d >= 0 else counts[c]))) for c in range(k) if counts[c] for d in range(-1, dim)]
    yield record_batch(dict(zip(PARTS.names, zip(*rows, strict=True) if rows else ([], [], []), strict=True)), PARTS)


def _nearest(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            clusters, distances = _read(row, centroids.shape[1]).nearest(centroids)
            yield record_batch({"vec_id": row["ids"], "cluster": clusters, "distance": distances}, NEAREST)


def starts(vectors: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest digests, as integers: k rows come to the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    small = F.forall("vector", lambda x: F.abs(F.floor(x * scale)) < 2**BITS)
    first = vectors.filter(F.col("vec_id").isNotNull() & small).orderBy(order, "vector").limit(k)
    return np.array([[int(np.floor(scale * x)) for x in row["vector"]] for row in first.collect()], np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` for every vector that counts, and the final centroids."""
    x = F.col("vector")
    whole = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).filter(whole)
    size = (TREE_ROWS, LEAF_ROWS)
    trees = staged(rows.mapInArrow(lean(lambda it: _trees(it, scale, dim, *size)), TREES), "trees")
    centroids = starts(rows, k, scale, seed).reshape(-1, dim)
    if not len(centroids):  # no row has an id: nothing starts
        return trees.select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    for _ in range(rounds):
        parts = trees.mapInArrow(lean(lambda it, now=centroids: _sums(it, now)), PARTS)
        totals = parts.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()  # k * (dim + 1) rows at most
        found = {(r["cluster"], r["component"]): int(r["total"]) for r in totals}
        centroids = np.array([[found[c, d] // found[c, -1] for d in range(dim)] if (c, -1) in found else centroids[c].tolist() for c in range(len(centroids))], np.int64)
    return trees.mapInArrow(lean(lambda it: _nearest(it, centroids)), NEAREST), centroids


def op13_ball_tree_clusters(spark, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds, its distance, the inertias and the centroid's digest."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = staged(found, "nearest")
    own = {r["cluster"]: int(r["own"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}  # a row for each centroid
    inertia = min(sum(own.values()), LONGEST)
    facts = [(c, min(own[c], LONGEST), inertia, hashlib.sha256(",".join(map(str, m.tolist())).encode()).hexdigest()) for c, m in enumerate(centroids) if c in own]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(n: int) -> str:
    return f"""
d{n} AS MATERIALIZED (
  SELECT v.n, v.vec_id, v.x, m.cluster, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v CROSS JOIN m{n} m),
a{n} AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY distance, cluster) AS near FROM d{n}) s WHERE near = 1)"""


def _move_sql(n: int) -> str:
    return f"""
s{n} AS (SELECT cluster, place, CAST(floor(sum(value) / count(*)) AS BIGINT) AS value FROM (SELECT cluster, unnest(range({DIM})) AS place, unnest(x) AS value FROM a{n}) u GROUP BY cluster, place),
m{n + 1} AS MATERIALIZED (
  SELECT m.cluster, coalesce(g.x, m.x) AS x FROM m{n} m LEFT JOIN (SELECT cluster, list(value ORDER BY place) AS x FROM s{n} GROUP BY cluster) g ON g.cluster = m.cluster)"""


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)), x) - 1 AS INTEGER) AS cluster, x FROM v WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)), x) <= {CENTROIDS}),
{",".join(_round_sql(n) + "," + _move_sql(n) for n in range(ROUNDS))},
{_round_sql(ROUNDS)},
t AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS own FROM a{ROUNDS} GROUP BY cluster)
SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, t.own AS cluster_inertia, (SELECT CAST(sum(own) AS BIGINT) FROM t) AS inertia,
  sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN t ON t.cluster = a.cluster JOIN m{ROUNDS} m ON m.cluster = a.cluster
"""
