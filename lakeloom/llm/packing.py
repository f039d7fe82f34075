"""Best-fit packing of tokenized documents by exact-complement hashing.

Every document becomes token ids followed by an end id.  A document longer
than a sequence is cut into whole-sequence pieces; only its first piece may be
shorter.  Piece lengths are integers up to the sequence length, so the packing
itself is decided on the *histogram* of lengths (one count per length, however
many documents there are):

1. lengths are taken from long to short; the gap each leaves is looked up among
   single lengths, pair sums and triple sums that still have counts, and such
   combinations are consumed as many times as the counts allow;
2. what has no exact complement is placed best-fit, again whole counts at once.

The result is a short list of rank intervals per length.  Documents find their
place by their rank among pieces of equal length; ranks are computed in salted
groups, so that a length shared by a third of all pieces is no hot group.

Defined cases: a null or empty text is the end id alone (one piece of length 1);
repeated rows are packed as often as they occur; an empty table gives no rows;
other input columns are ignored, whatever their names; invalid UTF-8 is decoded
with U+FFFD.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, lean, record_batch, staged, text_bytes

SEQUENCE = 1024
END_ID = 2
SALTS = 64
ROWS_PER_SALT = 100_000

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])
PACKED = T.StructType([
    *PIECES.fields,
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])


def default_vocabulary() -> str:
    """Path of the public byte-level BPE whose ids the packing uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """``text -> little-endian uint32 ids`` for a byte-level BPE in tokenizers' JSON.

    The merges run in tiktoken, which gives the same ids as tokenizers for a
    ByteLevel BPE (ranks are the merge order) several times faster; the tests
    compare the two.  The file's added tokens are recognised in a text, as
    tokenizers does by default.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], file.get("added_tokens") or []
    if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens that take more than their own string: {odd}")
    # ByteLevel BPE writes bytes as printable characters: the printable ones as
    # themselves, the others as code points from 256 on, in byte order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    merged = {a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if piece in merged or (len(piece) == 1 and piece in letters)}
    core = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
    return lambda text: core.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, sequence: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    end = np.array([end_id], dtype="<u4")
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in PIECES}
        ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
        for row, doc_id in enumerate(ids_of):
            ids = np.concatenate([encode(texts[row].as_py().decode("utf-8", "replace")), end])
            first = len(ids) % sequence or sequence
            cuts = [0, *range(first, len(ids) + 1, sequence)]
            raw = memoryview(ids.tobytes())
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                out["doc_id"].append(doc_id)
                out["piece"].append(piece)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(raw[4 * a : 4 * b]))
                out["ids"].append(bytes(raw[4 * a : 4 * b]) if keep_ids else None)
        yield record_batch(out, PIECES)


def token_pieces(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenize ``(doc_id, text)`` and cut documents longer than a sequence."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(lean(lambda it: _pieces(it, path, sequence, end_id, keep_ids)), PIECES)


class Plan:
    """Places for counts of lengths: per length, intervals of ranks."""

    def __init__(self, counts: np.ndarray, capacity: int, shortest: int = 1):
        """``shortest``: complements are looked up for lengths from this on."""
        self.shortest = shortest
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.taken = np.zeros_like(self.left)
        self.sequences = 0
        #: (length, first rank, end rank, sequence of the first rank, offset)
        self.places: list[tuple[int, int, int, int, int]] = []
        self._exact()
        self._best_fit()

    def _place(self, length: int, times: int, sequence: int, offset: int) -> None:
        a = int(self.taken[length])
        self.places.append((length, a, a + times, sequence, offset))
        self.taken[length] += times
        self.left[length] -= times

    def _open(self, lengths: list[int], times: int) -> int:
        first, offset = self.sequences, 0
        for x in lengths:
            self._place(x, times, first, offset)
            offset += x
        self.sequences += times
        return first

    def _times(self, lengths: list[int]) -> int:
        return min(int(self.left[x]) // lengths.count(x) for x in set(lengths))

    def _complement(self, length: int, gap: int) -> list[int] | None:
        """One, two or three lengths that fill the gap and are there (beside ``length``)."""
        free = self.left.copy()
        free[length] -= 1
        if free[gap] > 0:
            return [gap]
        there = free > 0
        low = np.arange((gap + 1) // 2, gap)
        hit = low[there[low] & there[gap - low]][::-1]
        for a in hit:
            if 2 * a != gap or free[a] > 1:
                return [int(a), int(gap - a)]
        for a in range(gap - 2, 0, -1):
            if not there[a]:
                continue
            rest = gap - a
            if 3 * a < gap:
                break
            b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
            for x in b[there[b] & there[rest - b]][::-1]:
                trio = [a, int(x), int(rest - x)]
                if all(free[y] >= trio.count(y) for y in trio):
                    return trio
        return None

    def _exact(self) -> None:
        if self.left[self.capacity]:
            self._open([self.capacity], int(self.left[self.capacity]))
        for length in range(self.capacity - 1, self.shortest - 1, -1):
            while self.left[length] > 0 and (fill := self._complement(length, self.capacity - length)):
                lengths = [length, *fill]
                self._open(lengths, self._times(lengths))

    def _best_fit(self) -> None:
        bins: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
        number = np.zeros(self.capacity + 1, np.int64)
        for length in range(self.capacity, 0, -1):
            while (n := int(self.left[length])) > 0:
                room = np.flatnonzero(number[length:])
                if len(room):
                    gap = length + int(room[0])
                    first, many = bins[gap].pop()
                    m = min(n, many)
                    if many > m:
                        bins[gap].append((first + m, many - m))
                    number[gap] -= m
                    self._place(length, m, first, self.capacity - gap)
                    rest = gap - length
                else:
                    each = min(self.capacity // length, n)
                    m = n // each
                    first = self._open([length] * each, m)
                    rest = self.capacity - each * length
                if rest:
                    bins.setdefault(rest, []).append((first, m))
                    number[rest] += m

    def arrays(self) -> dict[str, np.ndarray]:
        """Intervals sorted by (length, first rank)."""
        p = np.array(sorted(self.places), dtype=np.int64).reshape(-1, 5)
        return {k: p[:, i].copy() for i, k in enumerate(("length", "first", "end", "sequence", "offset"))}


def best_plan(counts: np.ndarray, capacity: int) -> Plan:
    """The plan with the fewest sequences over where the exact search stops.

    Filling every gap exactly uses up the short lengths and can leave middle
    ones that go together badly; so the search also ends at longer lengths, the
    rest being left to best-fit.  Ties go to the longer exact search.
    """
    stops = [1, *(capacity * k // 8 for k in range(1, 8)), capacity - capacity // 16, capacity - capacity // 64]
    return min((Plan(counts, capacity, max(1, s)) for s in dict.fromkeys(stops)), key=lambda p: p.sequences)


def _assign(batches: Iterator[pa.RecordBatch], plan: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    #: lengths and ranks share one sorted key
    key = (plan["length"].astype(np.uint64) << np.uint64(48)) + plan["first"].astype(np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        length, rank = (batch.column(c).to_numpy().astype(np.uint64) for c in ("length", "rank"))
        at = np.searchsorted(key, (length << np.uint64(48)) + rank, side="right") - 1
        columns: dict[str, object] = {f.name: batch.column(f.name) for f in PIECES}
        columns["sequence_id"] = plan["sequence"][at] + (rank.astype(np.int64) - plan["first"][at])
        columns["offset"] = plan["offset"][at]
        yield record_batch(columns, PACKED)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack ``docs`` into sequences; one row per piece with its place.

    ``keep_ids=True`` also carries each piece's ids (little-endian uint32) in
    ``ids``; otherwise that column is null and only their CRC-32 is kept.
    What reaches the driver is one count per length.
    """
    pieces = staged(token_pieces(docs, vocabulary, sequence, end_id, keep_ids), "pieces")
    counts = np.zeros(sequence + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    plan = best_plan(counts, sequence).arrays()
    salts = max(SALTS, int(counts.sum()) // ROWS_PER_SALT)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order) - 1).join(bases, ["length", "salt"])
    ranked = ranked.select(*PIECES.names, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(lean(lambda it: _assign(it, plan)), PACKED)


def op10_pack_best_fit(spark, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents, without the ids themselves."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
