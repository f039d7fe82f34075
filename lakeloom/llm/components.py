"""Connected components of a table of links, without gathering them anywhere.

Alternating large-star and small-star steps (Kiveris et al., 2014) turn every
component into a star around its least node.  Each step is a grouped minimum and
a join on the same key; the state is written to the shared folder, so a lost
executor repeats at most one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links of comparable nodes to ``(node, component)`` for every linked node.

    A component is named by its least node.  Self links and repeated links are
    allowed; no links give no rows.
    """
    state = staged(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        stepped = staged(_star(_star(state, True), False), "stars")
        seen = stepped.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        state = stepped
        if mark == (seen["n"], seen["x"]):
            break
        mark = (seen["n"], seen["x"])
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
