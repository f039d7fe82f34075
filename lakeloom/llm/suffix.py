"""Exact removal of long repeated byte strings with a run-length BWT index.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else, in the same document or another.  Matches never cross documents and are
judged on the input.

Finding who could match whom (equal strings meet, whatever the size):

1. Every window of ``LENGTH`` bytes has an anchor: the least-hashed ``GRAM``-byte
   gram inside it, leftmost on ties (whole 64-bit hashes are compared).  Equal
   windows have equal anchors at equal places, so only windows whose anchor gram
   occurs twice need a look.  About one gram in 85 is an anchor; anchors that
   follow each other at one distance, as in a periodic text, are one row.
2. The windows of a repeated anchor are cut into two pieces, those that hold at
   least half of their other bytes left of the gram and the rest; all windows of
   a piece share a string of 116 bytes, whose hash is the piece's group.
3. Pieces of a group with equal text are one context with a number of occurrences
   (equal by 128 bits of hash).  A group whose only context occurs twice repeats
   whole, and one of a single occurrence needs no more: there is nothing to index.

Deciding, per group of two or more contexts, with a run-length index:

4. The contexts' suffixes are sorted into a Burrows-Wheeler transform that is kept
   as runs.  Text positions are sampled at run ends; only there the common prefix
   with the neighbouring suffix is computed.  Everywhere else it is streamed: if
   two neighbouring rows have the same preceding byte, the position before matches
   one byte longer, so matching statistics fall by one from a sample to the next
   (repetitive contexts have few runs).  Neighbouring rows that match over
   ``LENGTH`` bytes or more form classes; a class of two windows repeats, counting
   a context as often as it occurs.

A group of more than ``GROUP_CONTEXTS`` contexts is split on further bytes: its
windows are halved again by how far they reach to the left, and windows of a half
share a longer string, whose hash is their new group.  That ends at single
windows at the latest, so no task holds more than a bounded group, and nothing is
decided another way.

Defined cases: a null or empty text, or one shorter than ``LENGTH``, loses nothing;
equal texts repeat whole and go whole, and one of them with their number is what
the steps work on; texts are told apart by 128 bits; texts are any bytes; an empty table gives no rows; columns beside
doc_id and text do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, lean, record_batch, release, slices, staged, text_bytes

LENGTH = 200
GRAM = 32
BATCH_BYTES = 1 << 20
#: rows that a worker gathers before it hands them on
HELD_ROWS = 20_000
#: occurrences of a gram that are looked up together
ROWS_PER_COPY = 4096
#: suffix arrays are built for about this many bytes of contexts at a time
INDEX_BYTES = 1 << 20
GROUP_CONTEXTS = 2048
#: bits for the length of a run of windows
RUN_BITS = 31
#: anchors in one row, at most (17 bits)
MOST_TIMES = 65_535
#: bytes of a window beside its gram, and half of them
FREE = LENGTH - GRAM
HALF = FREE // 2

_long, _int, _bin = T.LongType(), T.IntegerType(), T.BinaryType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


ANCHORS = _struct(h=_long, k1=_long, k2=_long, place=_long)
#: a context's start and size, its gram's offset (core), the least reach to the left of its windows, and how often it follows at one step
PIECES = _struct(piece=_long, c1=_long, c2=_long, k1=_long, k2=_long, start=_long, size=_int, core=_int, low=_int, step=_int, times=_long, copies=_long)
OPEN = _struct(piece=_long, c1=_long, c2=_long, times=_long, kinds=_long, core=_int, low=_int, high=_int, context=_bin)
MARKS = _struct(piece=_long, c1=_long, c2=_long, first=_int, last=_int)
HALVES = _struct(piece=_long, c1=_long, c2=_long, offset=_int, piece_=_long, c1_=_long, c2_=_long, times=_long, core=_int, low=_int, high=_int, context=_bin)
CLEANED = _struct(doc_id=_long, n_bytes=_long, n_removed=_long, n_spans=_long, kept_sha256=T.StringType(), kept=_bin, spans=_bin)

_B = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position (GRAM a power of two)."""
    h = data.astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0xD6E8FEB86659FD93)
    step, base = 1, _B
    while step < GRAM:
        h = h[:-step] * base + h[step:]
        h ^= h >> np.uint64(29)
        with np.errstate(over="ignore"):
            base = base * base
        step *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram hash, anchor, first and last window start) of all anchors of a batch.

    Positions count from the beginning of the buffer.
    """
    n, width = len(data), LENGTH - GRAM + 1
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return none, none.view(np.uint64), none, none, none
    h = gram_hashes(data)
    low, at = h, np.arange(len(h), dtype=np.int64)
    step = 1
    while step < width:
        by = min(step, width - step)
        left = low[:-by] <= low[by:]  # leftmost on ties
        low, at = np.where(left, low[:-by], low[by:]), np.where(left, at[:-by], at[by:])
        step += by
    del low
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    inside = np.arange(len(at)) + LENGTH <= offsets[1:][text]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh & inside)
    # a text's windows end before those that would leave it
    after = np.flatnonzero(np.r_[fresh | ~inside, True])
    last = after[np.searchsorted(after, first, side="right")] - 1
    return text[first], h[at[first]], at[first], first, last


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, bytes, offsets) of overlapping stretches that hold all windows once."""
    if len(data) <= 2 * BATCH_BYTES:
        yield 0, data, offsets
        return
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for at in range(a, b, BATCH_BYTES):
            to = min(b, at + BATCH_BYTES + LENGTH - 1)
            yield at, data[at:to], np.clip(offsets, at, to) - at


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BATCH_BYTES):
        whole, ends = binary_parts(batch.column("text"))
        for begin, data, offsets in _stretches(whole, ends):
            text, h, at, first, last = anchors(data, offsets)
            if not len(text):
                continue
            # anchors that follow each other at one short distance are one row
            same = np.zeros(len(text), bool)
            same[1:] = (text[1:] == text[:-1]) & (h[1:] == h[:-1])
            for x in (at - first, last - first):
                same[1:] &= x[1:] == x[:-1]
            same &= last - first < GRAM
            nth = np.arange(len(text)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(text))))
            head = np.flatnonzero(nth % MOST_TIMES == 0)
            times = np.diff(np.r_[head, len(text)])
            text, h, at, first, last = (x[head] for x in (text, h, at, first, last))
            row = pa.array(text)
            # times, start in the text, anchor and last start from there
            place = (times << 47) | ((first + begin - ends[text]) << 16) | ((at - first) << 8) | (last - first)
            yield record_batch({"h": h.view(np.int64), "k1": batch.column("k1").take(row), "k2": batch.column("k2").take(row), "place": place}, ANCHORS)


def _digest(*parts: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(b"".join(parts), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _key(shared: bytes, low: int, high: int) -> int:
    """The group of windows that reach ``low`` to ``high`` bytes left of their gram."""
    return _digest(shared, bytes((low, high)))[0]


def _occurrences(place: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first start, anchor, last start, step, times) of the anchors in one row.

    Equal grams that overlap make the bytes under them periodic: the anchors whose
    windows all lie there have equal contexts and come together.
    """
    times, first, reach, more = place >> 47, place >> 16 & (1 << 31) - 1, place >> 8 & 255, place & 255
    step = more + 1
    a = -(-reach // step)
    b = ((times - 1) * step + GRAM - LENGTH - more + reach) // step
    nth = 0
    while nth < times:
        many = b - a + 1 if nth == a and b > a else 1
        at = first + nth * step
        yield at, at + reach, at + more, step, many
        nth += many


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of repeated anchors, in two pieces each."""
    out: dict[str, list] = {f.name: [] for f in PIECES}
    for batch in slices(batches, "text", BATCH_BYTES):
        keys = (batch.column(c).to_pylist() for c in ("k1", "k2", "copies"))
        for k1, k2, copies, value, places in zip(*keys, batch.column("text"), batch.column("places"), strict=True):
            text = memoryview(value.as_buffer())
            for place in places.values.to_numpy().tolist():
                for first, at, last, step, times in _occurrences(place):
                    middle = min(last, at - HALF)  # windows up to here hold HALF bytes left of the gram
                    for a, b, low, high in ((first, middle, HALF, FREE), (max(first, at - HALF + 1), last, 0, HALF - 1)):
                        if a > b:
                            continue
                        context = text[a : b + LENGTH]
                        core = at - a
                        c1, c2 = _digest(context, bytes((core,)))
                        piece = _key(text[at - low : at + LENGTH - high], low, high)
                        for k, v in zip(PIECES.names, (piece, c1, c2, k1, k2, a, len(context), core, low, step, times, copies), strict=True):
                            out[k].append(v)
                    if len(out["c1"]) >= HELD_ROWS:
                        yield record_batch(out, PIECES)
                        out = {f.name: [] for f in PIECES}
    if out["c1"]:
        yield record_batch(out, PIECES)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that an index has to decide, cut from their texts."""
    out: dict[str, list] = {f.name: [] for f in OPEN}
    for batch in slices(batches, "text", BATCH_BYTES):
        for value, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
            text = value.as_buffer()
            for w in wanted.values.to_pylist():
                w |= {"context": text[w["start"] : w["start"] + w["size"]].to_pybytes(), "high": FREE if w["low"] else HALF - 1}
                for c in OPEN.names:
                    out[c].append(w[c])
                if len(out["piece"]) >= HELD_ROWS:
                    yield record_batch(out, OPEN)
                    out = {f.name: [] for f in OPEN}
    if out["piece"]:
        yield record_batch(out, OPEN)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of a large group, each cut by how far its windows reach to the left."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in HALVES}
        for row in batch.to_pylist():
            context, core, low, high = (row[c] for c in ("context", "core", "low", "high"))
            last, middle = len(context) - LENGTH, (low + high + 1) // 2
            for a, b, lo, hi in ((0, min(last, core - middle), middle, high), (max(0, core - middle + 1), last, low, middle - 1)):
                if a > b:
                    continue
                half, at = context[a : b + LENGTH], core - a
                c1, c2 = _digest(half, bytes((at,)))
                piece = _key(context[core - lo : core + LENGTH - hi], lo, hi)
                for k, v in zip(HALVES.names, (row["piece"], row["c1"], row["c2"], a, piece, c1, c2, row["times"], at, lo, hi, half), strict=True):
                    out[k].append(v)
        if out["piece"]:
            yield record_batch(out, HALVES)


class RunLengthIndex:
    """Run-length BWT of grouped contexts with matching statistics from run ends."""

    def __init__(self, contexts: list[bytes], groups: np.ndarray):
        sizes = np.array([len(c) for c in contexts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1  # each context's terminator
        self.starts = self.ends - sizes
        text = np.zeros(int(self.ends[-1]) + 1, np.uint8)
        n = len(text)
        real = np.ones(n, bool)
        real[self.ends] = False
        text[real] = np.frombuffer(b"".join(contexts), np.uint8)
        self.context = np.repeat(np.arange(len(contexts)), sizes + 1)
        end_of = self.ends[self.context]
        group = np.unique(groups, return_inverse=True)[1][self.context]

        # ranks by the first 8, 16, 32, ... bytes; a context's end is a symbol of its own
        position = np.arange(n)
        packed = np.zeros(n, np.uint64)
        symbol = np.where(real, text.astype(np.uint64), np.uint64(0))
        for k in range(8):
            at = np.minimum(position + k, end_of)
            packed = packed << np.uint64(8) | np.where(position + k < end_of, symbol[at], np.uint64(0))
        # zero bytes of the text are told from the padding by how much of it there is
        padding = np.minimum(end_of - position, 8)
        tie = np.where(real, 0, self.context + 1)
        order = np.lexsort((tie, padding, packed, group))
        changed = np.ones(n, bool)
        for x in (group, packed, padding, tie):
            y = x[order]
            changed[1:] &= y[1:] == y[:-1]
        changed[1:] = ~changed[1:]
        changed[0] = True
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(changed) - 1
        self.levels = [(8, rank)]
        step = 8
        while rank.max() + 1 < n:
            key = rank * (n + 1) + rank[np.minimum(position + step, end_of)]
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
            step *= 2
            self.levels.append((step, rank))
        self.text, self.end_of, self.rows = text, end_of, order

        # the transform as runs; a context's first byte has no predecessor: its own symbol
        before = text[order - 1].astype(np.int64) + 1
        opening = np.zeros(n, bool)
        opening[self.starts] = True
        before[opening[order]] = -1 - self.context[order][opening[order]]
        ended = ~real[order - 1] & ~opening[order]
        before[ended] = -n - 1 - order[ended]
        row_group = group[order]
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (row_group[1:] != row_group[:-1])
        self.runs = int(head.sum())

        # common prefixes with the suffix before, computed at run ends and streamed between
        rows = np.flatnonzero(head)
        rows = rows[rows > 0]
        sampled = np.zeros(n, bool)
        value = np.zeros(n, np.int64)
        sampled[order[rows]] = True
        same = row_group[rows] == row_group[rows - 1]
        value[order[rows]] = np.where(same, self.common(order[rows - 1], order[rows]), 0)
        sampled[order[0]] = True
        nearest = np.maximum.accumulate(np.where(sampled, position, 0))
        self.matching = np.maximum(value[nearest] - (position - nearest), 0)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes (within their contexts)."""
        length = np.zeros(len(a), np.int64)
        for step, rank in reversed(self.levels):
            x, y = np.minimum(a + length, self.end_of[a]), np.minimum(b + length, self.end_of[b])
            fits = (x + step <= self.end_of[a]) & (y + step <= self.end_of[b])
            length += np.where(fits & (rank[x] == rank[y]), step, 0)
        for _ in range(8):
            x, y = np.minimum(a + length, self.end_of[a]), np.minimum(b + length, self.end_of[b])
            length += (x < self.end_of[a]) & (y < self.end_of[b]) & (self.text[x] == self.text[y])
        return length

    def repeated(self, times: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """At which positions a window starts that occurs twice (``times``: of each context)."""
        rows = self.rows
        window = rows + length <= self.end_of[rows]
        new = self.matching[rows] < length
        new[0] = True
        label = np.cumsum(new) - 1
        weight = np.bincount(label, weights=np.where(window, times[self.context[rows]], 0))
        out = np.zeros(len(rows), bool)
        out[rows] = window & (weight[label] >= 2)
        return out


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece to marked windows, about INDEX_BYTES of contexts at a time."""

    def marked(rows: list[tuple]) -> pa.RecordBatch:
        contexts = [r[4] for r in rows]
        index = RunLengthIndex(contexts, np.array([r[0] for r in rows], np.int64))
        hit = index.repeated(np.array([r[3] for r in rows], np.int64))
        some = np.unique(index.context[hit])
        out: dict[str, list] = {f.name: [] for f in MARKS}
        for i in some:
            own = np.diff(hit[index.starts[i] : index.ends[i]].astype(np.int8), prepend=0, append=0)
            for first, end in zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist(), strict=True):
                for c, v in zip(MARKS.names, (*rows[i][:3], first, end - 1), strict=True):
                    out[c].append(v)
        return record_batch(out, MARKS)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("piece", "c1", "c2", "times", "context")), strict=True):
            if size > INDEX_BYTES and row[0] != held[-1][0]:
                yield marked(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield marked(held)


def _spans(runs: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes that marked windows cover: (start, end) rows."""
    first = runs >> RUN_BITS
    end = first + (runs & ((1 << RUN_BITS) - 1)) + LENGTH
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    gap = np.flatnonzero(first[1:] > end[:-1])  # runs that touch or overlap make one span
    return np.c_[first[np.r_[0, gap + 1]], end[np.r_[gap, len(end) - 1]]]


def _without(raw: pa.Buffer, spans: np.ndarray) -> bytes:
    edges, view = [0, *spans.ravel().tolist(), raw.size], memoryview(raw)
    return b"".join(view[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 8 << 20):
        out: dict[str, list] = {f.name: [] for f in CLEANED if f.name != "doc_id"}
        for value, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
            raw = value.as_buffer()
            spans = _spans(runs.values.to_numpy()) if runs.is_valid else np.empty((0, 2), np.int64)
            kept = _without(raw, spans)
            removed = int((spans[:, 1] - spans[:, 0]).sum())
            for k, v in (("n_bytes", raw.size), ("n_removed", removed), ("n_spans", len(spans)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept), ("spans", spans.astype("<i8").tobytes())):
                out[k].append(v)
        yield record_batch(out | {"doc_id": batch.column("doc_id")}, CLEANED)


ID = ["piece", "c1", "c2"]


def _marked(open_: DataFrame, width: int, held: list[DataFrame]) -> DataFrame:
    """Marks of the contexts of groups with two or more, by index; large groups by halves first."""
    small = open_.filter(F.col("kinds") <= GROUP_CONTEXTS).select(*ID, "times", "context").repartition(width, "piece").sortWithinPartitions(*ID)
    marks = small.mapInArrow(lean(_indexed), MARKS)
    large = open_.filter(F.col("kinds") > GROUP_CONTEXTS)
    if large.isEmpty():
        return marks
    halves = staged(large.mapInArrow(lean(_halves), HALVES), "halves")
    new = [F.col(f"{c}_").alias(c) for c in ID]
    contexts = halves.groupBy(*new).agg(F.sum("times").alias("times"), F.first(F.struct("core", "low", "high", "context")).alias("r")).select(*ID, "times", "r.*")
    kinds = contexts.groupBy("piece").agg(F.count("*").alias("kinds"))
    contexts = staged(contexts.join(kinds, "piece").select(*OPEN.names), "half_contexts")
    held += [halves, contexts]
    whole = contexts.filter("times > 1").select(*ID, F.lit(0).alias("first"), (F.octet_length("context") - LENGTH).alias("last"))
    found = whole.union(_marked(contexts.filter("kinds > 1"), width, held))
    found = found.select(*(F.col(c).alias(f"{c}_") for c in ID), "first", "last")
    back = halves.drop("context").join(found, [f"{c}_" for c in ID]).select(*ID, (F.col("first") + F.col("offset")).alias("first"), (F.col("last") + F.col("offset")).alias("last"))
    return marks.union(back)


def text_keys() -> tuple[Column, Column]:
    """128 bits that identify a text."""
    return F.xxhash64("text", F.lit(1)), F.xxhash64(F.lit(2), "text")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(k1, k2, runs)``: for every different text with repeated windows, where they start.

    A run is ``first << RUN_BITS | length - 1``: so many windows of LENGTH bytes that
    occur twice or more in the corpus start from ``first`` on.
    """
    k1, k2 = text_keys()
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), text_bytes().alias("text"))
    found = staged(texts.filter(F.octet_length("text") >= LENGTH).mapInArrow(lean(_anchors), ANCHORS), "anchors")
    number = F.shiftright("place", 47)
    twice = staged(found.groupBy("h").agg(F.sum(number).alias("n")).filter("n > 1").select("h", F.ceil(F.col("n") / ROWS_PER_COPY).cast("int").alias("copies")), "twice")
    # a gram that occurs very often is looked up in as many copies as that takes
    often, many = twice.filter("copies > 1"), F.coalesce("copies", F.lit(1))
    salted = found.join(often, "h", "left").withColumn("salt", F.pmod(F.xxhash64("k1", "place"), many).cast("int"))
    copied = twice.select("h", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    # equal texts have equal places: a set holds those of one text, in every task and in all
    lists = salted.join(copied, ["h", "salt"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))
    lists = staged(lists, "places")
    release(found, twice)
    # one row for equal texts, with their number; each of them is one occurrence
    distinct = texts.join(lists.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    distinct = staged(distinct.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "copies", "places"), "texts")
    release(lists)
    occurrences = staged(distinct.mapInArrow(lean(_pieces), PIECES), "pieces")

    first = F.struct("k1", "k2", "start", "size", "core", "low")
    contexts = occurrences.groupBy(*ID).agg(F.sum(F.col("times") * F.col("copies")).alias("times"), F.min(first).alias("r"))
    contexts = staged(contexts.select(*ID, "times", "r.*"), "contexts")
    groups = contexts.groupBy("piece").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    # times > 1: the whole context repeats (its windows are all marked)
    whole = contexts.filter("times > 1").select(*ID)
    wanted = contexts.join(groups, "piece").groupBy("k1", "k2").agg(F.collect_list(F.struct(*ID, "times", "kinds", "start", "size", "core", "low")).alias("wanted"))
    wanted = staged(wanted, "wanted")
    # a context is cut from one text
    open_ = staged(distinct.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(lean(_contexts), OPEN), "open")
    release(distinct, wanted)
    held: list[DataFrame] = []
    partial = _marked(open_, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), held).join(whole, ID, "left_anti")
    marks = whole.select("*", F.lit(0).alias("first"), F.lit(None).cast("int").alias("last")).union(partial)
    rows = occurrences.select(*ID, "k1", "k2", "start", "size", "step", "times").join(marks, ID)
    # contexts that follow each other repeat whole, and so does what lies between them
    more = F.coalesce(F.col("last"), F.col("size") - LENGTH) - F.col("first") + (F.col("times") - 1) * F.col("step")
    run = F.shiftleft(F.col("start") + F.col("first"), RUN_BITS) + more
    runs = staged(rows.select("k1", "k2", run.alias("run")).groupBy("k1", "k2").agg(F.collect_list("run").alias("runs")), "runs")
    # the texts are shuffled next: what led here need not be on disk beside them
    release(occurrences, contexts, open_, *held)
    return runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: counts, digest, remaining bytes and removed spans (int64 pairs)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    k1, k2 = text_keys()
    runs = repeated_windows(docs)
    keyed = docs.select("doc_id", text_bytes().alias("text"), k1.alias("k1"), k2.alias("k2"))
    rows = keyed.join(runs, ["k1", "k2"], "left").select("doc_id", "text", "runs")
    return rows.mapInArrow(lean(_cleaned), CLEANED)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What remains of each document without its repeated 200-byte strings."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_documents(docs: DataFrame) -> DataFrame:
    """The documents without their repeated strings, columns unchanged.

    ``text`` loses the repeated bytes (and the rest of a character that a cut goes
    through); ``n_chars``, where there is such a column, follows.  Rows without
    repeats, null texts included, come as they are; no row is dropped.
    """
    schema, names = docs.schema, docs.columns
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    k1, k2 = text_keys()
    runs = repeated_windows(d.select("doc_id", "text"))
    rows = d.select("row", text_bytes().alias("text"), k1.alias("k1"), k2.alias("k2")).join(runs, ["k1", "k2"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            row = dict(zip(names, batch.column("row").flatten(), strict=True))
            texts = row["text"].to_pylist()
            sizes = row["n_chars"].to_pylist() if "n_chars" in row else None
            for i, (value, runs) in enumerate(zip(batch.column("text"), batch.column("runs"), strict=True)):
                if runs.is_valid:
                    texts[i] = _without(value.as_buffer(), _spans(runs.values.to_numpy())).decode("utf-8", "ignore")
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            row["text"] = texts
            if sizes is not None:
                row["n_chars"] = sizes
            yield record_batch(row, schema)

    return rows.select("row", "text", "runs").mapInArrow(lean(cut), schema)
