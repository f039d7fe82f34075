"""Conversations in order, in runs of bounded size.

Rows are dealt by ranges of (conv_id, turn, role and text), so a conversation
that holds a third of all rows is shared out over tasks like any other range.
Within a task a conversation is a run, or several runs if it is long; ``whole``
marks a run that surely is its whole conversation.  The first and the last
conversation of a task may go on in another one, so they are never marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import record_batch

#: rows and characters of text in a run, at most (a single longer text still comes whole)
RUN_ROWS = 4096
RUN_CHARS = 1 << 21
#: leading characters of role and text that tell ranges apart
PREFIX = 128


def in_order(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` without nulls in role and text, sorted by conversation and turn.

    Nulls come first; rows of one turn follow each other by role, newline, text.
    """
    said = F.concat("role", F.lit("\n"), "text")

    def keys(tie: Column) -> list[Column]:
        return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), tie.asc()]

    return rows.repartitionByRange(*keys(F.substring(said, 1, PREFIX))).sortWithinPartitions(*keys(said))


class Run(NamedTuple):
    conv_id: int | None
    part: int
    whole: bool
    rows: list[tuple]


def runs(batches: Iterator[pa.RecordBatch], most_rows: int, most_chars: int) -> Iterator[Run]:
    """Runs of sorted rows whose first column is conv_id and whose last one is text; ``part`` grows along the table."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 40
    at, rows, chars, first, cut = None, [], 0, True, False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            other = rows and row[0] != at
            if other or len(rows) >= most_rows or chars >= most_chars:
                yield Run(at, part, bool(other) and not first and not cut, rows)
                first, cut = first and not other, not other
                part, rows, chars = part + 1, [], 0
            at = row[0]
            rows.append(row[1:])
            chars += len(row[-1] or "")
    if rows:
        yield Run(at, part, False, rows)


def gathered(rows: Iterator[tuple[dict, int]], schema: StructType, most_rows: int = 512, most_size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come with their sizes; a batch ends with the row that fills it."""
    held: dict[str, list] = {n: [] for n in schema.names}
    count = size = 0
    for row, own in rows:
        for n, values in held.items():
            values.append(row.get(n))
        count, size = count + 1, size + own
        if count >= most_rows or size >= most_size:
            yield record_batch(held, schema)
            held = {n: [] for n in schema.names}
            count = size = 0
    if count:
        yield record_batch(held, schema)
