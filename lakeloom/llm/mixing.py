"""Mixing sources to target weights with hash-threshold histograms.

Native: every step is a DataFrame operation.  Each document gets a hash; a
source's budget is met by taking the documents whose hash lies under the
source's threshold.  The threshold comes from histograms instead of a sort:
sizes are summed by (source, 12 hash bits); only the bucket in which the
running sum crosses the budget is refined by the next 12 bits; what is left in
that cell is summed by hash value.  Whole rounds of a source (a target of 1.4
times its size is one round and a rest) are taken without any threshold, and
thresholds are nested: a larger budget takes a superset.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a
source of its own, ordered last; a source of size 0 has target 0; rows that
agree in doc_id and text share a hash and are taken alike; an empty table gives
no rows; input columns beside doc_id, text and source play no part and, in
``mixed_documents``, are passed through whatever their names.

Per-source tables (one row a source, 4,096 histogram rows a source) are joined
back; Spark broadcasts them only while they are under its size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_ROUNDS = 2
BITS = 12  # of 60, per level
WORD = r"[^\x20\x09-\x0D]+"


def words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits that depend on the row's id and text only."""
    row = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(source, source_size)`` to targets: shares by weight, capped, the excess reshared.

    Resharing until no source is above its cap ends where all uncapped sources
    get ``level * weight``.  Sources in the order of cap / weight are capped
    until one is not; that one gives the level.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    s = per_source.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_rounds)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    s = s.withColumn("spent", F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    s = s.withColumn("open_weight", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(all_rows) * share_percent / F.lit(100.0) - F.col("spent")) / F.col("open_weight"))
    # behind the first open source the formula counts open ones as capped and falls
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(all_rows))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def _crossing(hist: DataFrame, bucket: str) -> DataFrame:
    """Per source, the bucket in which the running sum passes the rest of the budget."""
    by = Window.partitionBy("source").orderBy(bucket)
    run = hist.withColumn("upto", F.col("before") + F.sum("words").over(by))
    return run.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))).withColumn("before", F.col("upto") - F.col("words")).drop("upto", "words")


def mix_plan(sizes: DataFrame, **settings) -> DataFrame:
    """``(source, size, h)`` rows to one row per source: target, rounds, threshold.

    A document is taken ``rounds`` times, and once more if ``h <= threshold``.
    """
    plan = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), **settings)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = staged(plan.withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")), "targets")
    budget = plan.select("source", "rest", F.lit(0).cast("long").alias("before"))

    mask = F.lit((1 << BITS) - 1)
    b1, b2 = F.shiftright("h", 60 - BITS), F.shiftright("h", 60 - 2 * BITS).bitwiseAND(mask)
    sized = sizes.filter("size > 0").withColumn("b1", b1).withColumn("b2", b2)

    def joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """Equal keys, null sources being equal."""
        a, b = left.alias("a"), right.alias("b")
        on = F.col("a.source").eqNullSafe(F.col("b.source"))
        for k in keys:
            on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        return a.join(b, on).select("a.*", *(f"b.{c}" for c in right.columns if c not in left.columns))

    cells1 = sized.groupBy("source", "b1").agg(F.sum("size").alias("words"))
    at1 = staged(_crossing(joined(cells1, budget, ()), "b1"), "cells1")
    inside = joined(sized, at1, ("b1",))
    cells2 = inside.groupBy("source", "b1", "b2", "rest", "before").agg(F.sum("size").alias("words"))
    at2 = staged(_crossing(cells2, "b2"), "cells2")
    last = joined(sized, at2, ("b1", "b2")).groupBy("source", "b1", "b2", "rest", "before", "h").agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("h"))
    # the value that crosses the budget is taken if that ends nearer to it
    below = F.col("upto") - F.col("words")
    nearer = (below <= F.col("rest")) & (F.col("upto") - F.col("rest") < F.col("rest") - below)
    taken = last.withColumn("upto", upto).filter((F.col("upto") <= F.col("rest")) | nearer)
    ends = taken.groupBy("source").agg(F.max("h").alias("last_taken"))
    start = F.shiftleft("b1", 60 - BITS) + F.shiftleft("b2", 60 - 2 * BITS) - 1
    thresholds = at2.select("source", start.alias("cell_start"))
    plan = plan.alias("p").join(thresholds.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "left").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
    plan = plan.select("p.source", "p.source_size", "p.target", "p.rounds", F.coalesce("e.last_taken", "t.cell_start", F.lit(-1)).alias("threshold"))
    return staged(plan, "plan")


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes = staged(docs.select("doc_id", "source", words().alias("size"), mix_hash().alias("h")), "sizes")
    plan = mix_plan(sizes.select("source", "size", "h"), **settings)
    d, p = sizes.alias("d"), plan.alias("p")
    rows = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")))
    times = F.col("rounds") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0)
    return rows.select("d.doc_id", "d.size", "p.source_size", "p.target", (F.col("d.size") * times).alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as many times as it is taken, columns unchanged."""
    d = docs.alias("d")
    keyed = d.select(F.struct("d.*").alias("row"), F.col("d.source").alias("source"), words("d.text").alias("size"), mix_hash("d.doc_id", "d.text").alias("h"))
    plan = mix_plan(staged(keyed.select("source", "size", "h"), "sizes"), **settings).withColumnRenamed("source", "of")
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("of")))
    times = F.col("rounds") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0)
    copies = F.when((F.col("size") > 0) & (times > 0), F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<bigint>"))
    return rows.select("row", F.explode(copies).alias("copy")).select("row.*")


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix over all documents."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS spent,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total * 150 / CAST(100.0 AS DOUBLE) - spent) / open_weight AS level FROM o),
m AS (SELECT *, max(CASE WHEN level * weight < cap THEN level END) OVER () AS open_level FROM l),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * open_level, CAST(cap AS DOUBLE))) AS target FROM m),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM t),
c AS (
  SELECT d.*, r.source_size, r.target, r.rounds, r.target - r.rounds * r.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (rounds + CASE WHEN upto <= rest OR (upto - same <= rest AND upto - rest < rest - (upto - same)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
