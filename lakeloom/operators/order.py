"""Reading order repaired by exchanges of neighbours until none is left.

Two neighbours of one column change places if the second stands wholly above the
first and the page's own lines say so, too.  Figures, tables and blocks across
both columns stay where they are.  That one block stands above another in a
column is transitive, so whatever exchanges come first, the end is the same.

A round cuts the pages' orders into short stretches and settles each; the next
round's stretches lie across the first one's borders.  When a round of either
kind moves nothing, no two neighbours are wrong.  A page in one stretch takes one
round, longer ones go on by themselves; a page of a million blocks is thousands of
stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.derived import frame
from ..plans.registry import Tables, query
from ..sources.staging import release, staged
from .families import shifts
from .spatial import coverage_text, mapped

STRETCH = 512
#: what can move; the rest are borders
MOVABLE = ("paragraph", "heading", "list_item", "reference")
COLUMNS = ("page", "id", "old", "pos", "side", "y0", "y1", "top", "bottom", "exchanges", "moved")
STATE = "page long, id long, old long, pos long, side int, y0 double, y1 double, top double, bottom double, exchanges long, moved boolean"


def _goes_up(rows: pd.DataFrame) -> np.ndarray:
    """Whether a row stands above the one before it, both in one stretch and column."""
    first, second = rows.iloc[:-1], rows.iloc[1:]
    same = np.logical_and.reduce([second[c].to_numpy() == first[c].to_numpy() for c in ("page", "stretch", "side")])
    return same & (second["side"].to_numpy() > 0) & (second["y1"].to_numpy() <= first["y0"].to_numpy()) & (second["bottom"].to_numpy() <= first["top"].to_numpy())


def settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole stretches, sorted, in their settled order: each block goes up past the neighbours that it stands above."""
    up = np.flatnonzero(_goes_up(rows)) + 1
    ends = np.flatnonzero((np.diff(rows["page"].to_numpy()) != 0) | (np.diff(rows["stretch"].to_numpy()) != 0)) + 1
    ends = np.concatenate([[0], ends, [len(rows)]])
    whole, moved = np.arange(len(rows)), rows["exchanges"].to_numpy().copy()
    columns = [rows[c].to_numpy() for c in ("side", "y0", "y1", "top", "bottom")]
    for k in np.unique(np.searchsorted(ends, up, "right")):
        start, end = ends[k - 1], ends[k]
        side, y0, y1, top, bottom = (c[start:end].tolist() for c in columns)
        order: list[int] = []
        for i in range(end - start):
            at = len(order)
            while at and side[i] == side[j := order[at - 1]] and side[i] > 0 and y1[i] <= y0[j] and bottom[i] <= top[j]:
                moved[start + i] += 1
                moved[start + j] += 1
                at -= 1
            order.insert(at, i)
        whole[start:end] = start + np.array(order)
    out = rows.assign(exchanges=moved).iloc[whole]
    return out.assign(pos=rows["pos"].to_numpy(), moved=whole != np.arange(len(rows)))[list(COLUMNS)]


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Many stretches a call; the last one of a batch waits for its rest."""
    rest = None
    for rows in batches:
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        if len(rows):
            last = int(((rows["page"] == rows["page"].iat[-1]) & (rows["stretch"] == rows["stretch"].iat[-1])).to_numpy().argmax())
            rest = rows.iloc[last:]
            if last:
                yield settle(rows.iloc[:last])
    if rest is not None:
        yield settle(rest)


def _round(state: DataFrame, stretch: int, offset: int) -> DataFrame:
    cut = F.floor((F.col("pos") + offset) / stretch)
    rows = state.withColumn("stretch", cut).repartition("page", "stretch").sortWithinPartitions("page", "stretch", "pos")
    return rows.mapInPandas(_stretches, STATE)


def evidence(blocks: DataFrame, regions: DataFrame, width: float) -> DataFrame:
    """Blocks with their column (1 left, 2 right, 0 none or not to be moved) and the extent of the native lines in them."""
    said = coverage_text(F.coalesce("b.text", F.lit("")))
    proof = F.contains(said, coverage_text(F.col("a.text"))) & (F.length(F.regexp_replace("a.text", "[^A-Za-z]", "")) >= 3)
    lines = mapped(regions, blocks).groupBy(F.col("b.page").alias("page"), F.col("b.id").alias("id"))
    lines = lines.agg(F.bool_or(proof).alias("proven"), F.min("a.y0").alias("top"), F.max("a.y1").alias("bottom"))
    side = F.when(F.col("x1") <= 0.55 * width, 1).when(F.col("x0") >= 0.45 * width, 2).otherwise(0)
    movable = F.col("kind").isin(*MOVABLE) & F.coalesce("proven", F.lit(False))
    return blocks.join(lines, ["page", "id"], "left").withColumn("side", F.when(movable, side).otherwise(0))


def _placed(blocks: DataFrame, regions: DataFrame, width: float, places: DataFrame) -> DataFrame:
    rows = evidence(blocks, regions, width).join(places, ["page", "id"])
    return rows.select("page", "id", F.col("pos").alias("old"), "pos", "side", "y0", "y1", F.coalesce("top", F.lit(0.0)).alias("top"), F.coalesce("bottom", F.lit(0.0)).alias("bottom"), F.lit(0).cast("long").alias("exchanges"), F.lit(False).alias("moved"))


def repaired(blocks: DataFrame, regions: DataFrame, width: float = 600.0, stretch: int = STRETCH) -> DataFrame:
    """``(page, id, old, pos, exchanges)`` of blocks ``(page, id, ord, kind, text, x0, y0, x1, y1)`` in the order of ``ord``."""
    wanted = ("page", "id", "old", "pos", "exchanges")
    sizes = blocks.groupBy("page").agg(F.count("*").alias("n"))
    long = staged(sizes.filter(F.col("n") > stretch).select("page"), "long")
    # a page in one stretch: one round, places by a window of that many rows at most
    some = blocks.join(long, "page", "left_anti")
    places = some.select("page", "id", (F.row_number().over(Window.partitionBy("page").orderBy("ord", "id")) - 1).cast("long").alias("pos"))
    done = _round(_placed(some, regions, width, places), stretch, 0).select(*wanted)
    if long.isEmpty():
        return done
    some, regions = (df.join(long, "page", "left_semi") for df in (blocks, regions))
    places = shifts(some.select(F.struct("page", "ord", "id").alias("id"), F.col("page").alias("parent"), F.lit(1).cast("long").alias("size")))
    state = staged(_placed(some, regions, width, places.select("id.page", "id.id", (F.col("shift") - 1).alias("pos"))), "order")
    offset, still = 0, 0
    while still < 2:
        now = staged(_round(state, stretch, offset), "order")
        release(state)
        state = now
        still = 0 if state.filter("moved").limit(1).count() else still + 1
        offset = stretch // 2 - offset
    return done.union(state.select(*wanted))


@query("order_repair", "SRT-13")
def order_repair(t: Tables) -> DataFrame:
    """Blocks told column by column, with those that stand too late moved up."""
    blocks = frame(t, "layout").withColumn("ord", F.col("id") % 2 * 100000 + F.col("id"))
    return repaired(blocks, frame(t, "regions"))
