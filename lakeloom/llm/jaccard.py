"""Exact n-gram Jaccard join with count vectors in an R-tree.

A document is the set of its word shingles (64-bit hashes).  Documents with equal
sets are one node.  Two nodes link when their Jaccard similarity reaches the
threshold; the result is the components of these links.

1. Frequent shingles are counted over all documents.  In every node shingles are
   ordered rare before frequent, then by hash.  Nodes that link must share one of
   their first ``n - ceil(t * n) + 1`` shingles in any such order, so sharing one
   is necessary, never guessed; where they share the first, enough must follow.
2. Nodes with equal min-hash bands are compared with the least node of their
   band.  What links there is merged first, so that a large group of near copies
   is never paired all with all.
3. Exact pass: nodes of different components that share a prefix shingle meet.
   Their shingles are hashed into ``GROUPS`` groups; the group counts are points.
   The points of a meeting are bulk-loaded into an R-tree: halved again and again,
   by size while a box spans sizes that cannot link, else by the coordinate that
   spreads most, down to pages of ``PAGE`` points; every box keeps its lower and
   upper corner.  Two subtrees are walked together only while their boxes allow a
   link: the overlap is at most the sum of the coordinate-wise minima of the upper
   corners, and what the lower corner of one exceeds the upper corner of the other
   by is missing from it.  In pages that meet, points are bounded the same way.
   For the pairs left, the first ``FINE`` groups are cut into 2**32 finer ones each
   and the minima summed again: the longer the texts, the less the coarse groups tell.
   Each node first proposes its likeliest partners only; what they verify is
   merged, and then every remaining pair of different components is looked at.
4. Surviving pairs are verified on the sets themselves, recomputed from the two
   texts.

A meeting of more than ``GROUP_ROWS`` nodes is cut into tiles by size, the
first level of a tree over all its nodes; a tile is copied to those tiles only
whose sizes can link with its own, and every such pair of tiles is a meeting of
its own: memory is bounded and no pair is left out.  (Among n nodes of like size
and different components that all share their rarest shingle, every tile still
meets every other; what they have in common decides that, not the corpus.)

Defined cases: a text without words, or null, has no shingles, links with nothing
and is its own component; fewer words than a shingle make one shingle of them
all; documents are rows (equal ids may repeat); a component is named by the least
non-null doc_id in it (null if there is none); an empty table gives no rows;
columns beside doc_id and text do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, lean, record_batch, release, slices, staged, text_bytes
from .components import components
from .shingles import mixed, shingle_sets

WIDTH, PERCENT = 5, 80
GROUPS = 128
#: of these, the groups that a second bound refines
FINE = 16
BANDS, ROWS = 8, 3
BATCH_BYTES = 1 << 20
#: a shingle is frequent if at least this share of documents has it (and LEAST_FREQUENT do)
FREQUENT_SHARE = 1 / 2000
LEAST_FREQUENT = 40
MOST_FREQUENT = 1 << 19
GROUP_ROWS = 4096
#: larger partners that a node proposes in a group before all are looked at
LIKELIEST = 4
PROPOSALS = 1
PAGE = 32
#: shingles of whole texts that a worker counts at a time
COUNTED = 2_000_000
#: pairs of a text that travel with one copy of it
PAIRS_PER_COPY = 256

SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("k1", T.LongType()),
    T.StructField("k2", T.LongType()),
    T.StructField("node", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("bands", T.BinaryType()),
    T.StructField("prefix", T.BinaryType()),
    T.StructField("point", T.BinaryType()),
    T.StructField("fine", T.BinaryType()),
])
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
TOKENS = T.StructType([T.StructField("token", T.LongType()), T.StructField("n", T.LongType())])


def row_keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """128 bits that identify a row by its id and text."""
    return F.xxhash64(doc_id, text, F.lit(1)), F.xxhash64(F.lit(2), text, doc_id)


def needed(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap at which sets of these sizes link: 100 i >= percent (a + b - i)."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def _frequent(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Shingles that several documents of this partition have, with how many."""
    held, size, docs = [], 0, 0
    found: dict[int, int] = {}

    def flush() -> None:
        nonlocal held, size, docs
        if held:
            items, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(3, docs * FREQUENT_SHARE / 2)
            for t, c in zip(items[often].tolist(), counts[often].tolist(), strict=True):
                found[t] = found.get(t, 0) + c
        held, size, docs = [], 0, 0

    for batch in slices(batches, "text", BATCH_BYTES):
        items, offsets = shingle_sets(*binary_parts(batch.column("text")), width)
        held.append(items.astype(np.int64))
        size, docs = size + len(items), docs + len(offsets) - 1
        if size > COUNTED:
            flush()
    flush()
    yield record_batch({"token": np.fromiter(found, np.int64, len(found)), "n": np.fromiter(found.values(), np.int64, len(found))}, TOKENS)


def frequent_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of frequent shingles; bounded, for ordering only."""
    n = texts.count()
    counts = texts.mapInArrow(lean(lambda it: _frequent(it, width)), TOKENS).groupBy("token").agg(F.sum("n").alias("n"))
    often = counts.filter(F.col("n") >= max(LEAST_FREQUENT, int(n * FREQUENT_SHARE)))
    rows = often.orderBy(F.col("n").desc(), "token").limit(MOST_FREQUENT).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(rows.view(np.uint64))


class Order:
    """Rare shingles before frequent ones."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(frequent & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def late(self, items: np.ndarray) -> np.ndarray:
        out = self.bits[(items & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            pos = np.minimum(np.searchsorted(self.frequent, items[at]), len(self.frequent) - 1)
            out[at] = self.frequent[pos] == items[at]
        return out


def _sketches(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    order = Order(frequent)
    bins = BANDS * ROWS
    for batch in slices(batches, "text", BATCH_BYTES):
        items, offsets = shingle_sets(*binary_parts(batch.column("text")), width)
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), n)
        late = order.late(items)
        # one-permutation min-hash: the least item of each hash range
        least = np.full(len(n) * bins, np.uint64(2**64 - 1))
        scrambled = mixed(items + np.uint64(12345))
        slot = doc * bins + ((scrambled >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(least, slot, scrambled)
        rows = least.reshape(len(n), BANDS, ROWS)
        bands = np.full((len(n), BANDS), np.uint64(0)) + np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
        grouped = mixed(items)
        group = (grouped >> np.uint64(64 - (GROUPS - 1).bit_length())).astype(np.int64)
        own = group < FINE
        fine = np.sort(doc[own].astype(np.uint64) << np.uint64(32) | grouped[own] & np.uint64(2**32 - 1))
        fine_at = np.searchsorted(fine, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(32))
        fine = fine.astype(np.uint32)
        points = np.bincount(doc * GROUPS + group, minlength=len(n) * GROUPS).reshape(len(n), GROUPS).astype(np.uint32)
        first = n - -(-percent * n // 100) + 1
        digests = np.zeros(len(n), np.uint64)
        if len(items):
            some = np.flatnonzero(n)
            digests[some] = mixed(np.bitwise_xor.reduceat(mixed(items), offsets[some]) + n[some].astype(np.uint64))
        out: dict[str, object] = {c: batch.column(c) for c in ("doc_id", "k1", "k2")}
        prefix = []
        for i in range(len(n)):
            own, rare = items[offsets[i] : offsets[i + 1]], ~late[offsets[i] : offsets[i + 1]]
            head = own[rare][: first[i]]
            if len(head) < first[i]:
                head = np.concatenate([head, own[~rare][: first[i] - len(head)]])
            prefix.append(head.tobytes() if n[i] else b"")
        out |= {"node": digests.view(np.int64), "n": n, "bands": [b.tobytes() for b in bands], "prefix": prefix, "point": [p.tobytes() for p in points], "fine": [fine[a:b].tobytes() for a, b in zip(fine_at[:-1], fine_at[1:], strict=True)]}
        yield record_batch(out, SKETCH)


def _longs(batches: Iterator[pa.RecordBatch], column: str, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Unfold a binary column of 64-bit values into rows ``item`` at ``pos``, with the other columns of ``schema``."""
    for batch in slices(batches, column, 4 << 20):
        data, offsets = binary_parts(batch.column(column))
        at = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8)
        out = {f.name: batch.column(f.name).take(pa.array(at)) for f in schema if f.name not in ("item", "pos")}
        pos = np.arange(len(at)) - (offsets[:-1] // 8)[at]
        yield record_batch(out | {"item": np.frombuffer(data.tobytes(), np.int64), "pos": pos.astype(np.int32)}, schema)


def _unfolded(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("item", T.LongType()), T.StructField("pos", T.IntegerType())])
    return df.select(*keep, column).mapInArrow(lean(lambda it: _longs(it, column, schema)), schema)


def _verified(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs ``(a, b)`` whose texts ``x`` and ``y`` have sets that link."""
    for batch in slices(batches, "x", BATCH_BYTES):
        (p, p_at), (q, q_at) = (shingle_sets(*binary_parts(batch.column(c)), width) for c in ("x", "y"))
        keep = []
        for i in range(batch.num_rows):
            one, two = p[p_at[i] : p_at[i + 1]], q[q_at[i] : q_at[i + 1]]
            if len(one) > len(two):
                one, two = two, one
            at = np.minimum(np.searchsorted(two, one), len(two) - 1)
            same = int((two[at] == one).sum()) if len(two) else 0
            keep.append(same > 0 and 100 * same >= percent * (len(one) + len(two) - same))
        yield record_batch({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")}, PAIRS)


def _copies(pairs: DataFrame) -> DataFrame:
    """(Staged) nodes that are in many pairs, by side, with how many copies of their facts travel."""
    sides = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("node")) for side in "ab")))
    often = pairs.select(sides.alias("s")).groupBy("s.side", "s.node").agg(F.ceil(F.count("*") / F.lit(PAIRS_PER_COPY)).cast("int").alias("copies"))
    return staged(often.filter("copies > 1"), "copies")


def _dealt(pairs: DataFrame, key: str, facts: DataFrame, copies: DataFrame) -> DataFrame:
    """``pairs`` with the facts of their node ``key``, in as many copies as it has.

    Spark broadcasts ``copies`` only while its files are under the session's threshold.
    """
    often, many = copies.filter(F.col("side") == key).drop("side"), F.coalesce("copies", F.lit(1))
    other = "b" if key == "a" else "a"
    salted = pairs.join(often.withColumnRenamed("node", key), key, "left").withColumn("salt", F.pmod(F.xxhash64(other), many).cast("int")).drop("copies")
    copied = facts.join(often, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("copies")
    return salted.join(copied.withColumnRenamed("node", key), [key, "salt"]).drop("salt")


def _verify(pairs: DataFrame, copies: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (staged) pairs of nodes that link, by their sets.

    Texts travel, not sets: Spark compresses them to a fraction of the hashes.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    reps = nodes.join(wanted, "node", "left_semi").select("node", "k1", "k2").dropDuplicates(["node"])
    k1, k2 = row_keys()
    kept = docs.select(k1.alias("k1"), k2.alias("k2"), "text").join(reps, ["k1", "k2"]).select("node", text_bytes().alias("text"))
    texts = staged(kept.dropDuplicates(["node"]), "texts")
    both = _dealt(_dealt(pairs, "a", texts.withColumnRenamed("text", "x"), copies), "b", texts.withColumnRenamed("text", "y"), copies)
    links = staged(both.select("a", "b", "x", "y").mapInArrow(lean(lambda it: _verified(it, width, percent)), PAIRS), "links")
    release(texts)
    return links


def fine_overlap(p: bytes, q: bytes) -> int:
    """At least the overlap of two sets in the refined groups, by their sorted finer coordinates."""
    one, two = sorted((np.frombuffer(x, np.uint32) for x in (p, q)), key=len)
    if not len(one):
        return 0
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    return int((two[at] == one).sum())


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, GROUPS) for c in ("x", "y"))
        need = needed(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
        least = np.minimum(p, q)
        rest = least[:, FINE:].sum(axis=1, dtype=np.int64)
        ok = rest + least[:, :FINE].sum(axis=1, dtype=np.int64) >= need
        for i in np.flatnonzero(ok):
            ok[i] = rest[i] + fine_overlap(batch.column("fx")[i].as_py(), batch.column("fy")[i].as_py()) >= need[i]
        keep = pa.array(ok)
        yield record_batch({c: batch.column(c).filter(keep) for c in ("a", "b")}, PAIRS)


def _possible(pairs: DataFrame, copies: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose points allow a link: texts are fetched for these only."""
    facts = nodes.select("node", "n", "point", "fine").dropDuplicates(["node"])
    a = facts.select("node", F.col("n").alias("na"), F.col("point").alias("x"), F.col("fine").alias("fx"))
    b = facts.select("node", F.col("n").alias("nb"), F.col("point").alias("y"), F.col("fine").alias("fy"))
    both = _dealt(_dealt(pairs, "a", a, copies), "b", b, copies).filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return both.select("a", "b", "na", "nb", "x", "y", "fx", "fy").mapInArrow(lean(lambda it: _bounded(it, percent)), PAIRS)


def overlap_bound(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum of coordinate-wise minima of rows of ``p`` against rows of ``q``."""
    return np.minimum(p[:, None, :], q[None, :, :]).sum(axis=2, dtype=np.int64)


class Tree:
    """Points bulk-loaded into a binary R-tree with lower and upper corners.

    ``order`` lists the rows page by page; box ``i`` holds ``order[start[i]:end[i]]`` and
    its children are boxes ``child[i]`` and ``child[i] + 1`` (a page has none: -1).
    """

    def __init__(self, n: np.ndarray, points: np.ndarray, percent: int, page: int):
        order = np.argsort(n, kind="stable")
        boxes, child = [(0, len(n))], []
        for i, (a, b) in enumerate(boxes):  # grows while it is walked
            if b - a <= page:
                child.append(-1)
                continue
            rows = order[a:b]
            sizes = n[rows]
            if 100 * sizes.min() < percent * sizes.max():
                by = sizes
            else:
                own = points[rows]
                by = own[:, np.argmax(own.max(axis=0) - own.min(axis=0))]
            middle = (b - a + page) // (2 * page) * page  # whole pages on the left
            middle = min(max(middle, page), b - a - 1)
            order[a:b] = rows[np.argpartition(by, middle)]
            child.append(len(boxes))
            boxes += [(a, a + middle), (a + middle, b)]
        self.order, self.child = order, np.array(child)
        self.start, self.end = np.array(boxes).T
        self.low, self.high = self.over(points)
        self.least, self.most = self.over(n)

    def over(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest value in each box."""
        rows = values[self.order]
        low, high = (np.empty((len(self.start), *values.shape[1:]), values.dtype) for _ in range(2))
        pages = np.flatnonzero(self.child < 0)
        for i in pages:
            low[i], high[i] = rows[self.start[i] : self.end[i]].min(axis=0), rows[self.start[i] : self.end[i]].max(axis=0)
        for i in np.flatnonzero(self.child >= 0)[::-1]:  # children come after their parent
            c = self.child[i]
            low[i], high[i] = np.minimum(low[c], low[c + 1]), np.maximum(high[c], high[c + 1])
        return low, high

    def may_link(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of boxes can hold points that link."""
        ok = 100 * np.minimum(self.most[i], self.most[j]) >= percent * np.maximum(self.least[i], self.least[j])
        for at in range(0, len(i), 4096):
            x, y = i[at : at + 4096], j[at : at + 4096]
            shared = np.minimum(self.high[x], self.high[y]).sum(axis=1, dtype=np.int64)
            ok[at : at + 4096] &= shared >= needed(self.least[x], self.least[y], percent)
            # low - high below zero wraps round in unsigned integers: compare, then subtract
            apart = np.maximum(self.low[x], self.high[y]) - self.high[y] + np.maximum(self.low[y], self.high[x]) - self.high[x]
            # |A or B| - |A and B| is at most this part of |A| + |B|
            ok[at : at + 4096] &= (100 + percent) * apart.sum(axis=1, dtype=np.int64) <= (100 - percent) * (self.most[x] + self.most[y])
        return ok

    def page_pairs(self, allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of pages under boxes that ``allowed`` passes all the way down, some at a time."""
        todo = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            i, j = todo.pop()
            ok = allowed(i, j)
            i, j = i[ok], j[ok]
            leaf = (self.child[i] < 0) & (self.child[j] < 0)
            if leaf.any():
                yield i[leaf], j[leaf]
            i, j = i[~leaf], j[~leaf]
            if not len(i):
                continue
            same = i == j
            c = self.child[i[same]]
            left, right = [c, c, c + 1], [c, c + 1, c + 1]
            i, j = i[~same], j[~same]
            # of two boxes the one with more points is opened
            size = self.end - self.start
            first = (self.child[i] >= 0) & ((self.child[j] < 0) | (size[i] >= size[j]))
            for k in (0, 1):
                left += [self.child[i[first]] + k, i[~first]]
                right += [j[first], self.child[j[~first]] + k]
            left, right = np.concatenate(left), np.concatenate(right)
            todo += [(left[at : at + 65536], right[at : at + 65536]) for at in range(0, len(left), 65536)]


def point_pairs(n: np.ndarray, points: np.ndarray, percent: int, component: np.ndarray | None = None, split: np.ndarray | None = None, best: int = 0, rest: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose points allow a link, by a tree over the points.

    With ``component`` only pairs of different components count, with ``split``
    only pairs of different parts, with ``rest`` only pairs that both have so many
    shingles left as they need.  ``best`` > 0 keeps for each row only so many
    partners, those whose bound exceeds what is needed by most.
    """
    if len(n) < 2:
        return
    tree = Tree(n, points, percent, PAGE)
    apart = [(tree.over(x), x) for x in (component, split) if x is not None]
    remain = tree.over(rest)[1] if rest is not None else None

    def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = tree.may_link(i, j, percent)
        for (low, high), _ in apart:  # one value in both boxes: none of their pairs count
            ok &= np.minimum(low[i], low[j]) != np.maximum(high[i], high[j])
        if remain is not None:
            ok &= np.minimum(remain[i], remain[j]) >= needed(tree.least[i], tree.least[j], percent)
        return ok

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for pages in tree.page_pairs(allowed):
        for i, j in zip(*pages, strict=True):
            p, q = tree.order[tree.start[i] : tree.end[i]], tree.order[tree.start[j] : tree.end[j]]
            least = needed(n[p, None], n[None, q], percent)
            over = overlap_bound(points[p], points[q]) - least
            may = over >= 0
            may &= 100 * np.minimum(n[p, None], n[None, q]) >= percent * np.maximum(n[p, None], n[None, q])
            if rest is not None:
                may &= np.minimum(rest[p, None], rest[None, q]) >= least
            for _, value in apart:
                may &= value[p, None] != value[None, q]
            if i == j:
                may &= np.arange(len(p))[:, None] < np.arange(len(q))[None, :]
            x, y = np.nonzero(may)
            if len(x):
                x, y, over = p[x], q[y], over[x, y]
                smaller = np.where((n[x] < n[y]) | (n[x] == n[y]) & (x < y), x, y)
                held.append((smaller, x + y - smaller, over / n[smaller]))
        if held and not best:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))[:2]
            held = []
        elif len(held) > 256:  # the best so far: what falls out here is among no later best
            held = [_most(*(np.concatenate(c) for c in zip(*held, strict=True)), best)]
    if held:
        yield _most(*(np.concatenate(c) for c in zip(*held, strict=True)), best)[:2]


def _most(x: np.ndarray, y: np.ndarray, slack: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each ``x`` the ``best`` partners by ``slack`` (all, if 0), with their slack."""
    if not best or not len(x):
        return x, y, slack
    order = np.lexsort((y, -slack, x))
    x, y, slack = x[order], y[order], slack[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    nth = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
    return x[nth < best], y[nth < best], slack[nth < best]


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, best: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, size) to pairs of different components that may link.

    All that a pair shares comes at or after the first shingle it shares, so in that
    shingle's group the shorter of the two remainders reaches the overlap it needs.
    """
    rest: pa.Table | None = None

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        group, node, n, component, part, pos = (table.column(c).to_numpy() for c in ("group", "node", "n", "component", "part", "pos"))
        rest_of = n - pos
        points = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint32).reshape(-1, GROUPS)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            ab = np.sort(np.c_[node[np.concatenate(left)], node[np.concatenate(right)]], axis=1)
            left.clear()
            right.clear()
            ab = np.unique(ab, axis=0) if len(ab) else ab
            return record_batch({"a": ab[:, 0], "b": ab[:, 1]}, PAIRS)

        small = sizes <= PAGE
        for m in np.unique(sizes[small & (sizes > 1)]):  # groups of one page, all at once
            base = starts[sizes == m]
            x, y = np.triu_indices(m, 1)
            for at in range(0, len(base), max(1, 100_000 // len(x))):
                some = base[at : at + max(1, 100_000 // len(x)), None]
                p, q = (some + x).ravel(), (some + y).ravel()
                ok = (component[p] != component[q]) & (100 * n[p] >= percent * n[q])
                ok &= np.minimum(rest_of[p], rest_of[q]) >= needed(n[p], n[q], percent)
                p, q = p[ok], q[ok]
                over = np.minimum(points[p], points[q]).sum(axis=1, dtype=np.int64) - needed(n[p], n[q], percent)
                ok = over >= 0
                p, q, _ = _most(p[ok], q[ok], over[ok] / n[p[ok]], best)
                left.append(p)
                right.append(q)
        for s, m in zip(starts[~small], sizes[~small], strict=True):
            parts = part[s : s + m]
            split = parts if parts.min() != parts.max() else None
            for p, q in point_pairs(n[s : s + m], points[s : s + m], percent, component[s : s + m], split, best, rest_of[s : s + m]):
                left.append(p + s)
                right.append(q + s)
                if sum(map(len, left)) > 500_000:
                    yield batch()
        if left:
            yield batch()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        group = rest.column("group")
        last = group[-1].as_py()
        cut = int(np.searchsorted(group.to_numpy(), last, side="left"))
        if cut:
            yield from pairs(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield from pairs(rest)


def _meetings(rows: DataFrame, counts: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """One meeting per set of nodes that share a shingle, or per pair of tiles of it where it is large.

    Shingles of one passage mostly have the same nodes: they are one meeting, in
    which a node has the place of the first of them, so that pairs meet once for a
    passage.  (Meetings are told apart by 64 bits; should two agree, their nodes
    meet in one, which loses nothing.)  Returns what is staged for it, too.
    """
    met = staged(rows.join(counts, "item").select("item", "node", "pos", "n"), "met")
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2)]
    sets = met.groupBy("item").agg(F.xxhash64(*same, F.count("*")).alias("set"), F.count("*").alias("holders"))
    joint = met.join(sets, "item").groupBy(F.col("set").alias("item"), "node").agg(F.min("pos").alias("pos"), F.min("n").alias("n"), F.max("holders").alias("holders"))
    joint = staged(joint, "joint")
    release(met)
    whole = joint.filter(F.col("holders") <= GROUP_ROWS).select(F.col("item").alias("group"), "node", F.lit(0).alias("part"), "pos")
    hot = joint.filter(F.col("holders") > GROUP_ROWS).drop("holders")
    if hot.isEmpty():
        return whole, [joint]
    # tiles by size, from counts per size; a size with very many nodes fills several
    tile = GROUP_ROWS // 2
    by_size = Window.partitionBy("item").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cells = hot.groupBy("item", "n").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(by_size), F.lit(0)))
    cells = staged(cells.select("item", "n", F.floor(F.col("before") / tile).alias("first"), F.ceil(F.col("c") / tile).alias("tiles")), "cells")
    spans = cells.withColumn("tile", F.explode(F.sequence("first", F.col("first") + F.col("tiles") - 1)))
    spans = spans.groupBy("item", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    one, two = spans.alias("s"), spans.alias("t")
    fit = (F.col("s.item") == F.col("t.item")) & (F.col("t.lo") * percent <= F.col("s.hi") * 100) & (F.col("s.lo") * percent <= F.col("t.hi") * 100)
    visits = one.join(two, fit).select("s.item", "s.tile", F.col("t.tile").alias("other"))
    tiled = hot.join(cells, ["item", "n"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("node"), F.col("tiles")))
    key = F.xxhash64("item", F.least("tile", "other"), F.greatest("tile", "other"))
    parts = staged(tiled.join(visits, ["item", "tile"]).select(key.alias("group"), "node", F.col("tile").cast("int").alias("part"), "pos"), "tiles")
    return whole.union(parts), [joint, cells, parts]


def _marked(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """Nodes with the component that they are known to be in."""
    return nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _may_link(meeting: DataFrame, marked: DataFrame, percent: int, best: int) -> DataFrame:
    """Distinct pairs of nodes of different components that meet and may link."""
    spark = meeting.sparkSession
    facts = marked.select("node", "n", "component", "point").dropDuplicates(["node"])
    known = meeting.join(facts.select("node", "component"), "node")
    mixed_groups = known.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("group")
    rows = meeting.join(mixed_groups, "group", "left_semi").join(facts, "node")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group", "n", "node")
    rows = rows.select("group", "node", "n", "component", "part", "pos", "point")
    return rows.mapInArrow(lean(lambda it: _candidates(it, percent, best)), PAIRS).distinct()


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, k1, k2, n_shingles, component_id, component)`` of every document.

    ``component_id`` is a name, which unlinked components can share (ids may repeat
    or be null); ``component`` is the least node hash of the component itself, null
    without shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    k1, k2 = row_keys()
    texts = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), text_bytes().alias("text"))
    frequent = frequent_shingles(texts.select("text"), width)
    sketch = staged(texts.mapInArrow(lean(lambda it: _sketches(it, frequent, width, percent)), SKETCH), "sketches")
    filled = sketch.filter("n > 0")
    reps = filled.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("r"))
    reps = reps.select("node", "least", "r.k1", "r.k2")
    reps = staged(reps, "representatives")
    nodes = staged(filled.drop("doc_id").join(reps.drop("least"), ["node", "k1", "k2"]), "nodes")
    rows = staged(sketch.select("doc_id", "k1", "k2", "node", "n"), "rows")
    release(sketch)

    # near copies of a band's least node
    bands = _unfolded(nodes, "bands", ["node"])
    pivots = bands.groupBy("item").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).filter("pivot < top").drop("top")
    star = bands.join(pivots, "item").filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = staged(star, "stars")
    copies = _copies(star)
    likely = staged(_possible(star, copies, nodes, percent), "band_pairs")
    sure = _verify(likely, copies, nodes, docs, width, percent)
    release(star, copies, likely)
    joined = staged(components(sure), "band_components")

    # nodes of different components that share a prefix shingle
    marked = _marked(nodes.drop("fine"), joined)
    tokens = _unfolded(marked, "prefix", ["node", "component", "n"])
    shared = tokens.groupBy("item").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("item")
    meeting, held = _meetings(tokens, shared, percent)
    facts = staged(nodes.select("node", "k1", "k2", "n", "point", "fine"), "facts")
    release(nodes)
    marked = _marked(facts, joined)
    # first the likeliest partners, so that what is much alike is one component...
    for _ in range(PROPOSALS):
        near = staged(_may_link(meeting, marked, percent, LIKELIEST), "likeliest")
        copies = _copies(near)
        likely = staged(_possible(near, copies, facts, percent), "likely_pairs")
        sure = sure.union(_verify(likely, copies, facts, docs, width, percent))
        release(near, copies, likely)
        marked = _marked(facts, staged(components(sure), "likely_components"))
    # ...then every pair of different components that the bounds allow
    near = staged(_may_link(meeting, marked, percent, 0), "near")
    release(*held)
    copies = _copies(near)
    pairs = staged(_possible(near, copies, facts, percent), "pairs")
    final = components(sure.union(_verify(pairs, copies, facts, docs, width, percent)))
    release(near, copies, pairs, facts)

    names = reps.select("node", "least").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = names.groupBy("component").agg(F.min("least").alias("component_id"))
    named = names.select("node", "component").join(least, "component").select("node", "component_id", "component")
    out = rows.withColumnRenamed("n", "n_shingles")
    full = out.filter("n_shingles > 0").join(named, "node").select("doc_id", "k1", "k2", "n_shingles", "component_id", "component")
    empty = out.filter("n_shingles = 0").select("doc_id", "k1", "k2", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return full.union(empty)


def distinct_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, columns unchanged: the one with the least doc_id.

    Documents without words all stay.  Of rows that share the least id (or have
    no id), the one whose row key is least stays.
    """
    k1, k2 = row_keys()
    found = staged(link_components(docs, width, percent), "components")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    keep = found.filter("n_shingles > 0").groupBy("component").agg(F.min(first).alias("r")).select("r.k1", "r.k2")
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = d.select("row", k1.alias("k1"), k2.alias("k2"))
    kept = keyed.join(keep.union(found.filter("n_shingles = 0").select("k1", "k2").distinct()), ["k1", "k2"], "left_semi")
    worded = F.col("row.text").rlike(r"[^\x20\x09-\x0D]")
    # rows of one id and text: the one whose columns hash lowest
    once = kept.filter(worded).groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return once.union(kept.filter(~F.coalesce(worded, F.lit(False))).select("row")).select("row.*")


def op5_jaccard_components(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are at least 85 % alike."""
    out = link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")
