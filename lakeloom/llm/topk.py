"""Exact top-k inner products over norm-sorted blocks.

Vectors become integers, are sorted by descending length and packed into blocks
of bounded size.  A block is searched in tiles from its longest vectors on.  A
rotation (right singular vectors of a bounded sample of blocks) moves most of
each vector's length into its first coordinates; for a query the partial sum
over these plus the product of the two residual lengths bounds the score
(Cauchy-Schwarz).  Only pairs whose bound reaches the query's current k-th score
are computed, exactly, in integers.  Queries stop at the first tile whose
longest vector cannot reach that score.

Each query first meets the block of longest vectors, which gives it a k-th score
to start from; then copies of each block of queries travel to all blocks of
candidates whose length can matter, and a task holds one block of candidates at
a time.  So neither side is broadcast or gathered, and the work is query blocks
times candidate blocks.

Defined cases: vectors that are null, empty, or hold null or non-finite
components (or components beyond 64 bits) and rows without vec_id take no part;
only vectors of equal dimension are compared; a query is a distinct vec_id
divisible by 100 (of several vectors under one such id the largest in dimension,
then bytes, asks); rows with the query's id are not its candidates; other
repeated rows are candidates as often as they occur; ties go to the smaller
vec_id; an empty table gives no rows; further input columns are ignored; scores
beyond 64 bits are cut to the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, record_batch, staged

SCALE = 1024
K = 10
QUERY_EVERY = 100
BLOCK_ROWS = 4096
QUERY_ROWS = 256
TILE = 512
#: blocks whose vectors fit the rotation
SAMPLE_BLOCKS = 8
ROWS_PER_PARTITION = 65_536
HEADS_PER_CHUNK = 16

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("dim", T.IntegerType()),
    T.StructField("norm", T.DoubleType()),
    T.StructField("data", T.BinaryType()),
])
BLOCKS = T.StructType([
    T.StructField("block", T.LongType()),
    T.StructField("dim", T.IntegerType()),
    T.StructField("longest", T.DoubleType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("kth", T.BinaryType()),
])
HITS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("vec_id", T.LongType()),
    T.StructField("score", T.LongType()),
])


def _integers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in VECTORS}
        column = batch.column("vector")
        offsets = np.asarray(column.offsets)
        values = column.values
        holes = np.asarray(values.is_null()) if values.null_count else np.zeros(len(values), bool)
        flat = np.asarray(values.fill_null(0)).astype(np.float64)
        with np.errstate(all="ignore"):
            whole = np.floor(scale * flat)
        bad = holes | ~np.isfinite(flat) | ~(np.abs(whole) < 2.0**63)
        whole[bad] = 0
        upto = np.r_[0, np.cumsum(bad)]
        use = np.asarray(column.is_valid()) & np.asarray(batch.column("vec_id").is_valid())
        use &= (np.diff(offsets) > 0) & (upto[offsets[1:]] == upto[offsets[:-1]])
        ids = batch.column("vec_id").fill_null(0).to_numpy()
        for r in np.flatnonzero(use):
            v = whole[offsets[r] : offsets[r + 1]].astype(np.int64)
            out["vec_id"].append(int(ids[r]))
            out["dim"].append(len(v))
            out["norm"].append(float(np.sqrt(np.square(v.astype(np.float64)).sum())))
            out["data"].append(v.tobytes())
        yield record_batch(out, VECTORS)


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted vectors to blocks of one dimension and at most ``rows`` vectors."""
    from pyspark import TaskContext

    base, number, held, dim = TaskContext.get().partitionId() << 32, 0, [], None

    def block() -> pa.RecordBatch:
        ids = np.array([h[0] for h in held], np.int64)
        return record_batch({"block": [base + number], "dim": [dim], "longest": [max(h[1] for h in held)], "ids": [ids.tobytes()], "data": [_narrow(b"".join(h[2] for h in held))], "kth": [None]}, BLOCKS)

    for batch in batches:
        for vec_id, d, norm, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (d != dim or len(held) >= rows):
                yield block()
                number, held = number + 1, []
            dim = d
            held.append((vec_id, norm, data))
    if held:
        yield block()


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products a @ b.T, exact; cut to 64 bits where they leave them."""
    reach = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if reach < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if reach < 2.0**63:
        return a @ b.T
    full = a.astype(object) @ b.astype(object).T
    return np.clip(full, -(2**63), 2**63 - 1).astype(np.int64)


def _ints(data: bytes, rows: int, dim: int) -> np.ndarray:
    """Packed vectors as 64-bit integers (stored as 32 bits where all of a block fit)."""
    kind = np.int32 if len(data) == 4 * rows * dim else np.int64
    return np.frombuffer(data, kind).reshape(-1, dim).astype(np.int64)


def _narrow(data: bytes) -> bytes:
    """64-bit integers as 32-bit ones, if all of them fit."""
    x = np.frombuffer(data, np.int64)
    small = x.astype(np.int32)
    return small.tobytes() if (small == x).all() else data


class Block:
    """One block of candidates, rotated."""

    def __init__(self, ids: bytes, data: bytes, dim: int, basis: np.ndarray | None):
        self.ids = np.frombuffer(ids, np.int64)
        self.ints = _ints(data, len(self.ids), dim)
        real = self.ints.astype(np.float64)
        self.basis = np.eye(dim) if basis is None else basis
        self.head = max(1, dim // 4)
        self.norm = np.sqrt(np.square(real).sum(axis=1))
        order = np.argsort(-self.norm, kind="stable")
        self.ids, self.ints, self.norm = self.ids[order], self.ints[order], self.norm[order]
        self.first = real[order] @ self.basis[:, : self.head]
        self.rest = np.sqrt(np.maximum(0, np.square(self.norm) - np.square(self.first).sum(axis=1)))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[int, list[tuple[int, int]]]]:
        """For each query its best hits in this block that reach ``kth``: (row, [(score, vec_id)])."""
        real = queries.astype(np.float64)
        norm = np.sqrt(np.square(real).sum(axis=1))
        first = real @ self.basis[:, : self.head]
        rest = np.sqrt(np.maximum(0, np.square(norm) - np.square(first).sum(axis=1)))
        kth = kth.copy()
        best: dict[int, list[tuple[int, int]]] = {}
        for a in range(0, len(self.ids), TILE):
            b = min(a + TILE, len(self.ids))
            slack = 1e-9 * norm * self.norm[a] + 0.5  # rounding of the bounds
            open_ = np.flatnonzero(norm * self.norm[a] + slack >= kth)
            if not len(open_):
                break
            bound = first[open_] @ self.first[a:b].T + rest[open_, None] * self.rest[None, a:b]
            keep = bound + slack[open_, None] >= kth[open_, None]
            some = keep.any(axis=1)
            rows, keep = open_[some], keep[some]
            if not len(rows):
                continue
            cols = np.flatnonzero(keep.any(axis=0))
            scores = _exact(queries[rows], self.ints[a:b][cols])
            hit = keep[:, cols] & (scores >= kth[rows, None]) & (self.ids[a:b][cols][None, :] != query_ids[rows, None])
            for i in np.flatnonzero(hit.any(axis=1)):
                at, row = np.flatnonzero(hit[i]), int(rows[i])
                s, ids = scores[i, at], self.ids[a:b][cols[at]]
                if len(s) > k:
                    floor = np.partition(s, len(s) - k)[len(s) - k]
                    s, ids = s[s >= floor], ids[s >= floor]
                pool = best.get(row, []) + list(zip(s.tolist(), ids.tolist(), strict=True))
                pool.sort(key=lambda p: (-p[0], p[1]))
                best[row] = pool[:k]
                if len(pool) >= k:
                    kth[row] = max(kth[row], pool[k - 1][0])
        return list(best.items())


def _start(batches: Iterator[pa.RecordBatch], seeds: dict[int, tuple], bases: dict[int, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """Give each query a first k-th score from the longest vectors."""
    ready = {}
    for batch in batches:
        for row in batch.to_pylist():
            dim, ids = row["dim"], np.frombuffer(row["ids"], np.int64)
            kth = np.full(len(ids), -np.inf)
            if dim in seeds:
                if dim not in ready:
                    ready[dim] = Block(*seeds[dim], dim, bases.get(dim))
                for r, hits in ready[dim].search(ids, _ints(row["data"], len(ids), dim), kth, k):
                    if len(hits) == k:
                        kth[r] = hits[-1][0]
            queries = _ints(row["data"], len(ids), dim).astype(np.float64)
            norm = np.sqrt(np.square(queries).sum(axis=1))
            # candidates shorter than this are out of reach for every query here
            need = np.where(np.isinf(kth), -np.inf, (kth - 1) / np.maximum(norm, 1e-9) * (1 - 1e-9))
            yield record_batch({**{c: [row[c]] for c in ("block", "dim", "ids", "data")}, "longest": [float(need.min())], "kth": [kth.tobytes()]}, BLOCKS)


def _searched(batches: Iterator[pa.RecordBatch], bases: dict[int, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that each block of candidates precedes the queries that visit it."""
    held, at = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kth"] is None:
                held, at = Block(row["ids"], row["data"], row["dim"], bases.get(row["dim"])), row["block"]
                continue
            if at != row["block"]:
                raise ValueError("a block of queries came without its candidates")
            ids = np.frombuffer(row["ids"], np.int64)
            queries = _ints(row["data"], len(ids), row["dim"])
            out: dict[str, list] = {f.name: [] for f in HITS}
            for r, hits in held.search(ids, queries, np.frombuffer(row["kth"], np.float64), k):
                out["query_id"] += [int(ids[r])] * len(hits)
                out["score"] += [s for s, _ in hits]
                out["vec_id"] += [v for _, v in hits]
            if out["query_id"]:
                yield record_batch(out, HITS)


def rotation(sample: list, dim: int) -> np.ndarray:
    """Right singular vectors of the sampled vectors, strongest first."""
    gram = np.zeros((dim, dim))
    for data in sample:
        x = data.astype(np.float64)
        gram += x.T @ x
    return np.linalg.eigh(gram / max(1.0, np.abs(gram).max()))[1][:, ::-1].copy()


def top_inner_products(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for every row whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    ints = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).mapInArrow(lean(lambda it: _integers(it, scale)), VECTORS)
    ints = staged(ints, "vectors")
    n = ints.count()
    # as many parts as the data needs; a part's blocks all have at most BLOCK_ROWS vectors
    parts = max(1, -(-n // ROWS_PER_PARTITION))
    ordered = ints.repartitionByRange(parts, F.col("dim"), F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("dim"), F.col("norm").desc(), F.col("vec_id"))
    blocks = staged(ordered.mapInArrow(lean(lambda it: _packed(it, BLOCK_ROWS)), BLOCKS), "blocks")
    asking = ints.filter(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.max(F.struct("dim", "norm", "data")).alias("v")).select("vec_id", "v.*")
    asking = asking.repartitionByRange(max(1, parts // query_every), F.col("dim"), F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("dim"), F.col("norm").desc(), F.col("vec_id"))
    asking = asking.mapInArrow(lean(lambda it: _packed(it, QUERY_ROWS)), BLOCKS)

    sampled = blocks.orderBy(F.xxhash64("block")).limit(SAMPLE_BLOCKS).select("dim", "ids", "data").collect()
    bases = {d: rotation([_ints(r["data"], len(r["ids"]) // 8, d) for r in sampled if r["dim"] == d], d) for d in {r["dim"] for r in sampled}}
    longest = blocks.filter(F.col("dim").isin([*bases])).groupBy("dim").agg(F.max_by(F.struct("ids", "data"), "longest").alias("b")).collect()
    seeds = {r["dim"]: (bytes(r["b"]["ids"]), bytes(r["b"]["data"])) for r in longest}
    asking = staged(asking.mapInArrow(lean(lambda it: _start(it, seeds, bases, k)), BLOCKS), "queries")

    # Query blocks meet block heads (one short row for 4,096 vectors) in chunks, so
    # that no task holds the heads of all blocks.
    chunks = max(1, -(-blocks.count() // HEADS_PER_CHUNK))
    heads = blocks.select("block", "dim", "longest", F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk")).alias("h")
    q = asking.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).alias("q")
    visits = q.join(heads, (F.col("q.dim") == F.col("h.dim")) & (F.col("q.chunk") == F.col("h.chunk")) & (F.col("h.longest") >= F.col("q.longest")))
    visits = visits.select("h.block", "q.dim", "q.longest", "q.ids", "q.data", "q.kth", F.col("q.block").alias("nth"))
    met = blocks.withColumn("nth", F.lit(-1).cast("long")).unionByName(visits)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = met.repartition(width, "block").sortWithinPartitions("block", "nth").drop("nth")
    hits = met.mapInArrow(lean(lambda it: _searched(it, bases, k)), HITS)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_top_inner_products(spark, sf_dir: str) -> DataFrame:
    """The ten largest integer inner products of each query vector."""
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
