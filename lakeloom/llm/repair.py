"""Repair of conversation structure by a bidirectional tight-arc DAG.

Rows of a conversation are the levels of a grid; its states are those of the
role pattern ``(s?(ua)+)?``.  Arcs keep, re-role or delete a row or insert an
empty turn.  Forward and backward minimum costs over the grid tell which arcs lie
on a cheapest path (forward + arc + backward = total).  The traversal holds the
frontier of states that the letters chosen so far can have led to and takes the
least letter of the tight arcs that leave it.

A conversation is solved in its task if it lies there whole.  One that is long or
lies across tasks comes as runs of bounded size, each solved in parallel:

1. a digest of (role, text) that an earlier run holds marks later rows as
   duplicates (one row for each run and digest is grouped, not one for each row);
2. each run becomes a min-plus matrix from its entry to its exit states, and the
   chain of these few numbers gives every run the costs before and behind it;
3. each run is traversed from every entry state on a cheapest path;
4. the pieces that fit together are read in order, digests in a stream.

Defined cases: null roles and texts are one space; rows are sorted by turn, nulls
first, rows of one turn by role, newline, text; repeated rows are rows (the later
ones duplicates); rows without conv_id are one conversation without id; an empty
role has no initial and cannot be kept; an empty table gives no rows; other
columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import turns
from .common import lean, record_batch, staged
from .turns import in_order

WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: states of the pattern: nothing yet, after s, after u, after a
START, S, U, A = range(4)
STATES = (START, S, U, A)
#: state to the state behind one more user or assistant turn, and that turn's role
NEXT = (U, U, A, U)
ROLE = ("user", "user", "assistant", "user")
#: (state, initial of a kept role) to the state behind it
KEEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
#: cost of finishing the pattern from a state behind the last row
CLOSING = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 60

_long, _str, _bool = T.LongType(), T.StringType(), T.BooleanType()
_longs, _strs = T.ArrayType(_long), T.ArrayType(_str)


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


SEEN = _struct(conv_id=_long, part=_long, h=_str)
#: rows: how many; edges: initials of the first and the last row; counts: blank, duplicate, truncated, illegal, distinct turns
SUMMARY = _struct(conv_id=_long, part=_long, rows=_long, edges=_strs, counts=_longs, low=_long, high=_long, matrix=_longs)
TOTALS = {k: _long for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
CHAIN = _struct(conv_id=_long, part=_long, before=_longs, behind=_longs, last=_bool, **TOTALS)
REPAIRED = _struct(conv_id=_long, part=_long, entry=_long, leaves=_long, **TOTALS, audit=_str, role=_strs, text=_strs)
#: whole conversations repaired, runs of the others as they are
RUNS = T.StructType([*REPAIRED.fields, T.StructField("whole", _bool), T.StructField("turn", _longs)])


class Row:
    """What the grid needs to know of a row: can it stay, for how much more, and its initial."""

    __slots__ = ("initial", "gone", "more")

    def __init__(self, initial: str, gone: bool, more: int):
        self.initial, self.gone, self.more = initial, gone, more

    def arcs(self, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost, state behind) of the arcs that use up this row."""
        out = [("D", DELETE, q)]
        if not self.gone:
            out.append(("R", REROLE + self.more, NEXT[q]))
            kept = KEEP.get((q, self.initial))
            if kept is not None:
                out.append(("K", self.more, kept))
        return out


def faults(roles: list[str], texts: list[str], earlier: set[str] | None = None) -> tuple[list[Row], list[int]]:
    """The rows for the grid, and how many are blank, duplicate and truncated first of all."""
    seen: set[tuple[str, str]] = set()
    rows, found = [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        said = text.strip(WHITE)
        again = (role, text) in seen or bool(earlier) and digest(role, text) in earlier
        fault = 0 if not said else 1 if again else 2 if said[-1] not in ".!?" else None
        if fault is not None:
            found[fault] += 1
        seen.add((role, text))
        rows.append(Row(role[:1], fault in (0, 1), TRUNCATED if fault == 2 else 0))
    return rows, found


def digest(role: str, text: str) -> str:
    return hashlib.md5(f"{role}\n{text}".encode()).hexdigest()


def _inserted(costs: list[int]) -> list[int]:
    """Least costs of a level once turns may be inserted there."""
    u = min(costs[U], costs[START] + INSERT, costs[S] + INSERT, costs[A] + INSERT)
    return [costs[START], costs[S], u, min(costs[A], u + INSERT)]


def forward(rows: list[Row], costs: list[int]) -> list[list[int]]:
    """Least costs of reaching each state before each row (inserts there included), then behind the last (without)."""
    levels = []
    for row in rows:
        costs = _inserted(costs)
        levels.append(costs)
        after = [FAR] * len(STATES)
        for q in STATES:
            if costs[q] < FAR:
                for _, cost, to in row.arcs(q):
                    after[to] = min(after[to], costs[q] + cost)
        costs = after
    return [*levels, costs]


def backward(rows: list[Row], behind: list[int]) -> list[list[int]]:
    """Least costs from each state before each row to the end, then ``behind``, those behind the last row."""
    levels = [behind]
    for row in reversed(rows):
        least = [min(cost + levels[-1][to] for _, cost, to in row.arcs(q)) for q in STATES]
        a = min(least[A], INSERT + least[U])
        u = min(least[U], INSERT + a)
        levels.append([min(least[START], INSERT + u), min(least[S], INSERT + u), u, a])
    return levels[::-1]


def traverse(roles: list[str], texts: list[str], rows: list[Row], before: list[list[int]], behind: list[list[int]], total: int, entry: int, last: bool):
    """The least letters along tight arcs: (state at the end, letters, repaired roles, repaired texts)."""
    frontier, letters, new_roles, new_texts, i = {entry}, [], [], [], 0
    while True:
        if i == len(rows) and (not last or any(behind[i][q] == 0 for q in frontier)):
            break
        arcs: dict[str, set[tuple[int, int]]] = {}
        for q in frontier:
            if before[i][q] + INSERT + behind[i][NEXT[q]] == total:
                arcs.setdefault("I", set()).add((q, NEXT[q]))
            for letter, cost, to in rows[i].arcs(q) if i < len(rows) else ():
                if before[i][q] + cost + behind[i + 1][to] == total:
                    arcs.setdefault(letter, set()).add((q, to))
        letter = min(arcs)
        letters.append(letter)
        frontier = {to for _, to in arcs[letter]}
        if letter != "D":
            (q, _) = min(arcs[letter])  # a letter leads every state of a frontier to the same turn
            new_roles.append(roles[i] if letter == "K" else ROLE[q])
            new_texts.append("" if letter == "I" else texts[i])
        i += letter != "I"
    return min(frontier), "".join(letters), new_roles, new_texts


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _totals(gaps: int, counts: list[int], cost: int) -> dict[str, int]:
    return dict(zip(TOTALS, (gaps, *counts, cost), strict=True))


def _spread(turn: list[int | None]) -> tuple[int | None, int | None, int]:
    known = {t for t in turn if t is not None}
    return min(known, default=None), max(known, default=None), len(known)


def solve(turn: list[int | None], roles: list[str], texts: list[str]) -> dict[str, object]:
    """A whole conversation of sorted rows."""
    rows, found = faults(roles, texts)
    before = forward(rows, [0, FAR, FAR, FAR])
    before[-1] = _inserted(before[-1])
    behind = backward(rows, CLOSING)
    total = behind[0][START]
    leaves, audit, new_roles, new_texts = traverse(roles, texts, rows, before, behind, total, START, True)
    low, high, distinct = _spread(turn)
    gaps = 0 if low is None else high - low + 1 - distinct
    return _totals(gaps, [*found, _illegal([r[:1] for r in roles])], total) | {"entry": START, "leaves": leaves, "audit": audit, "role": new_roles, "text": new_texts}


def _runs(batches: Iterator[pa.RecordBatch], size: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[dict, int]]:
        for run in turns.runs(batches, *size):
            there = [r[1:] for r in run.rows if not r[0]]
            turn, role, text = map(list, zip(*there, strict=True)) if there else ([], [], [])
            held = solve(turn, role, text) if run.whole else {"turn": turn, "role": role, "text": text}
            yield {"conv_id": run.conv_id, "part": run.part, "whole": run.whole} | held, sum(map(len, text))

    yield from turns.gathered(rows(), RUNS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[dict, int]]:
        for row in _rows(batches):
            for h in sorted({digest(*said) for said in zip(row["role"], row["text"], strict=True)}):
                yield {"conv_id": row["conv_id"], "part": row["part"], "h": h}, 0

    yield from turns.gathered(rows(), SEEN, most_rows=10_000)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[dict, int]]:
        for row in _rows(batches):
            grid, found = faults(row["role"], row["text"], set(row["earlier"] or ()))
            initials = [r[:1] for r in row["role"]]
            low, high, distinct = _spread(row["turn"])
            matrix = [x for q in STATES for x in forward(grid, [0 if p == q else FAR for p in STATES])[-1]]
            out = {"rows": len(grid), "edges": initials[:1] + initials[-1:], "counts": [*found, _illegal(initials), distinct], "low": low, "high": high, "matrix": matrix}
            yield {"conv_id": row["conv_id"], "part": row["part"]} | out, 0

    yield from turns.gathered(rows(), SUMMARY)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries sorted by conversation and part; a conversation's are a few numbers for thousands of rows."""

    def chain(held: list[dict]) -> pa.RecordBatch:
        costs, before = [0, FAR, FAR, FAR], []
        for x in held:
            before.append(costs)
            costs = [min(FAR, *(costs[p] + x["matrix"][len(STATES) * p + q] for p in STATES)) for q in STATES]
        ends, behind = CLOSING, []
        for x in reversed(held):
            behind.append(ends)
            ends = [min(FAR, *(x["matrix"][len(STATES) * q + p] + ends[p] for p in STATES)) for q in STATES]
        counts, high, last = [0] * 5, None, None
        for x in held:
            counts = [a + b for a, b in zip(counts, x["counts"], strict=True)]
            if x["rows"]:
                counts[3] += last is not None and _illegal([last, x["edges"][0]])
                last = x["edges"][1]
            if x["low"] is not None:
                counts[4] -= high == x["low"]  # turns are sorted: only the border can hold one twice
                high = x["high"]
        low = next((x["low"] for x in held if x["low"] is not None), None)
        totals = _totals(0 if low is None else high - low + 1 - counts[4], counts[:4], ends[START])
        n = len(held)
        columns = {"conv_id": [held[0]["conv_id"]] * n, "part": [x["part"] for x in held], "before": before, "behind": behind[::-1], "last": [x is held[-1] for x in held]}
        return record_batch(columns | {k: [v] * n for k, v in totals.items()}, CHAIN)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                yield chain(held)
                held = []
            held.append(row)
    if held:
        yield chain(held)


def _traversed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with the costs around them: a piece for each entry state that a cheapest path can have."""

    def rows() -> Iterator[tuple[dict, int]]:
        for row in _rows(batches):
            grid, _ = faults(row["role"], row["text"], set(row["earlier"] or ()))
            before, behind = forward(grid, row["before"]), backward(grid, row["behind"])
            if row["last"]:
                before[-1] = _inserted(before[-1])
            for q in STATES:
                if row["before"][q] + behind[0][q] != row["cost"]:
                    continue
                leaves, audit, role, text = traverse(row["role"], row["text"], grid, before, behind, row["cost"], q, row["last"])
                yield {k: row[k] for k in ("conv_id", "part", *TOTALS)} | {"entry": q, "leaves": leaves, "audit": audit, "role": role, "text": text}, sum(map(len, text))

    yield from turns.gathered(rows(), REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """Sorted ``(conv_id, dropped, turn, role, text)`` to repaired pieces.

    A conversation's pieces in order of ``part`` that fit together (the first
    entered at ``START``, each other where the one before ``leaves``) are its
    letters, roles and texts; its totals stand in each.  Dropped rows only keep
    their conversation in the result.
    """
    size = (turns.RUN_ROWS, turns.RUN_CHARS)
    held = staged(rows.select("conv_id", "dropped", "turn", "role", "text").mapInArrow(lean(lambda it: _runs(it, size)), RUNS), "runs")
    solved = held.filter("whole").select(REPAIRED.names)
    cut = held.filter("NOT whole").select("conv_id", "part", "turn", "role", "text")

    seen = cut.mapInArrow(lean(_digests), SEEN)
    seen = seen.withColumn("first", F.min("part").over(Window.partitionBy("conv_id", "h"))).filter("part > first")
    seen = seen.groupBy("part").agg(F.collect_list("h").alias("earlier"))  # a run's rows at most
    cut = staged(cut.join(seen, "part", "left"), "cut")
    summaries = cut.mapInArrow(lean(_summaries), SUMMARY)
    chained = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(lean(_chained), CHAIN)
    costs = cut.join(chained.drop("conv_id"), "part")
    return solved.union(costs.mapInArrow(lean(_traversed), REPAIRED))


def damage(conversations: DataFrame) -> DataFrame:
    """The test bench: faults by a checksum of id and turn, on rows in order."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")}
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text["role"], text["text"])
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.col("code")
    faulty = in_order(rows).withColumn("code", F.crc32(key.cast("binary")) % 20)
    faulty = faulty.withColumn("copy", F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return faulty.select(
        "conv_id",
        (code == 0).alias("dropped"),
        "turn",
        F.when(code == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(code.isin(0, 1), F.lit("")).when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
    )


DIGEST = _struct(conv_id=_long, **TOTALS, audit=_str, repaired_sha256=_str)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation, part and entry to a row for each conversation."""
    at, state, said, done = None, START, None, None
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in DIGEST}

        def end():
            for k, v in (done | {"audit": "".join(done["audit"]), "repaired_sha256": said.hexdigest()}).items():
                out[k].append(v)

        for row in batch.to_pylist():
            if done is None or row["conv_id"] != done["conv_id"]:
                if done is not None:
                    end()
                at, state, said = None, START, hashlib.sha256()
                done, empty = {k: row[k] for k in ("conv_id", *TOTALS)} | {"audit": []}, True
            if row["entry"] != state or row["part"] == at:
                continue
            at, state = row["part"], row["leaves"]
            done["audit"].append(row["audit"])
            if row["role"]:
                piece = "\n".join(f"{r}:{t}" for r, t in zip(row["role"], row["text"], strict=True))
                said.update((piece if empty else "\n" + piece).encode())
                empty = False
        yield record_batch(out, DIGEST)
    if done is not None:
        out = {f.name: [] for f in DIGEST}
        end()
        yield record_batch(out, DIGEST)


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``."""
    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "entry").mapInArrow(lean(_read), DIGEST)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults and their cheapest repair."""
    return digests(repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
