"""Families of rows that name a parent: roots, depths, depth-first order, cycles and nearest ancestors.

Recursion goes one generation a step and Spark ends it at a number of rows.
Here every row keeps a pointer to an ancestor and each round doubles its reach
(row's ancestor's ancestor), so a chain of a million rows takes twenty rounds of
one aggregate and one join.  Rounds go on until nothing changes, not up to a cap;
their state is a table in the shared folder.

``forest`` also gives depth-first places: sizes of subtrees add up along the
pointers, a row's siblings before it shift it by their sizes, and shifts add up
to the root in a second run of doubling.  Siblings are summed in ranges, so a
parent of a third of all rows is not one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.derived import frame, oracle, run
from ..plans.registry import Tables, query
from ..sources.staging import release, staged


def _climbed(nodes: DataFrame) -> DataFrame:
    """``(id, parent)`` to ``(id, jump, root, depth, size)``; a row that never reaches a root keeps a ``jump``.

    After round r a row's jump is its ancestor 2**r generations up, or null when
    its root is nearer; size counts what lies fewer generations below it.  Rows
    whose ancestors leave the table are dropped when their pointer does.
    """
    root = F.when(F.col("parent").isNull(), F.col("id"))
    state = staged(nodes.select("id", F.col("parent").alias("jump"), root.alias("root"), F.when(root.isNotNull(), F.lit(0).cast("long")).alias("depth"), F.lit(1).cast("long").alias("size")), "families")
    reach, before = 1, None
    while True:
        open_ = state.filter("jump IS NOT NULL")
        left = open_.count()
        # depths have no holes: as long as one open row has a root, a round ends some
        if not left or left == before:
            return state
        below = open_.groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("more"))
        above = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("root").alias("found"), F.col("depth").alias("deep"))
        moved = open_.join(above, "jump").select("id", F.col("next").alias("jump"), F.col("found").alias("root"), (F.col("deep") + reach).alias("depth"), "size")
        grown = state.filter("jump IS NULL").select(moved.columns).union(moved).join(below, "id", "left")
        now = staged(grown.select("id", "jump", "root", "depth", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "families")
        release(state)
        state, reach, before = now, 2 * reach, left


def shifts(children: DataFrame) -> DataFrame:
    """``(id, parent, size)`` to ``(id, shift)``: one, and the sizes of the siblings of smaller id."""
    ranged = children.repartitionByRange("parent", "id").withColumn("range", F.spark_partition_id())
    ranged = staged(ranged, "siblings")
    part = ranged.groupBy("parent", "range").agg(F.sum("size").alias("total"))  # a parent has a row for each range it lies in
    before = Window.partitionBy("parent").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("parent", "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("parent", "range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return inside.join(part, ["parent", "range"]).select("id", (1 + F.col("earlier") + F.col("inside")).alias("shift"))


def forest(nodes: DataFrame) -> DataFrame:
    """``(id, parent)``, null for roots, to ``(root, id, depth, size, pos)`` of all rows under a root.

    ``pos`` is the place in depth-first order below the root, siblings by id.  Ids
    are a key.  Rows in or under a cycle and rows under a missing parent have no root.
    """
    climbed = _climbed(nodes).filter("root IS NOT NULL").drop("jump")
    children = climbed.filter("depth > 0").join(nodes, "id").select("id", "parent", "size")
    state = children.select("id", "parent").join(shifts(children), "id").select("id", F.col("parent").alias("jump"), F.col("shift").alias("pos"))
    state = staged(state.union(climbed.filter("depth = 0").select("id", F.lit(None).cast("long"), F.lit(0).cast("long"))), "places")
    while not state.filter("jump IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("pos").alias("more"))
        moved = state.filter("jump IS NOT NULL").join(above, "jump").select("id", F.col("next").alias("jump"), (F.col("pos") + F.col("more")).alias("pos"))
        now = staged(state.filter("jump IS NULL").union(moved), "places")
        release(state)
        state = now
    return climbed.join(state.select("id", "pos"), "id").select("root", "id", "depth", "size", "pos")


def _on_cycles(open_: DataFrame) -> DataFrame:
    """Ids on cycles, of ``(id, parent)`` rows that all lead into one.

    The rows that 2**r steps lead to become fewer until they are the cycles: if as
    many are left after twice as many steps, steps only permute them.
    """
    state, count = staged(open_.select("id", F.col("parent").alias("jump")), "cycles"), None
    while True:
        reached = state.select(F.col("jump").alias("id")).distinct()
        now = reached.count()
        if now == count:
            return reached
        far = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        state, count = staged(state.join(far, "jump").select("id", F.col("next").alias("jump")), "cycles"), now


def owners(nodes: DataFrame) -> DataFrame:
    """``(id, parent)`` to ``(id, owner, cyclic)`` of every row.

    An owner is the last row on the way up: a root, one whose parent is missing,
    or the first row of a cycle that the way meets (a row on a cycle owns itself).
    """
    there = nodes.select(F.col("id").alias("parent"))
    tied = staged(nodes.join(there.withColumn("known", F.lit(True)), "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent")), "tied")
    climbed = _climbed(tied)
    done = climbed.filter("root IS NOT NULL").select("id", F.col("root").alias("owner"), F.lit(False).alias("cyclic"))
    endless = staged(tied.join(climbed.filter("root IS NULL").select("id"), "id"), "endless")
    if endless.isEmpty():
        return done
    round_ = _on_cycles(endless).withColumn("closed", F.lit(True))
    opened = endless.join(round_, "id", "left").select("id", F.when(F.col("closed").isNull(), F.col("parent")).alias("parent"), F.coalesce("closed", F.lit(False)).alias("closed"))
    opened = staged(opened, "opened")
    tails = _climbed(opened.select("id", "parent")).select("id", F.col("root").alias("owner"))
    return done.union(tails.join(opened, "id").select("id", "owner", F.col("closed").alias("cyclic")))


def nearest(chain: DataFrame) -> DataFrame:
    """``(id, previous, kind)`` to ``(id, kind, found, distance)``: for each row and kind the nearest row back to itself.

    Rows whose way back ends in a cycle are left out (a broken history gives nothing):
    they are the ones that never come to an end.  A row's map has an entry for each
    kind, so kinds must be few.
    """
    own = F.create_map("kind", F.struct(F.lit(0).cast("long").alias("distance"), F.col("id").alias("found")))
    begun = staged(chain.select("id", F.col("previous").alias("jump"), own.alias("kinds")), "nearest")
    # rows that have come to an end are written once, by the round that ends them
    ended, open_, reach, before = [begun.filter("jump IS NULL")], begun.filter("jump IS NOT NULL"), 1, None
    while True:
        left = open_.count()
        # distances have no holes: as long as one open row has an end, a round ends some
        if not left or left == before:
            break
        known = reduce(DataFrame.union, [*ended, open_])
        above = known.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("kinds").alias("older"))
        by = F.lit(reach)
        further = F.transform_values("older", lambda _, v: F.struct((v["distance"] + by).alias("distance"), v["found"].alias("found")))  # noqa: B023
        both = F.when(F.col("older").isNull(), F.col("kinds")).otherwise(F.map_zip_with("kinds", further, lambda _, near, far: F.coalesce(near, far)))
        # a row that is not there ends the way, too
        now = staged(open_.join(above, "jump", "left").select("id", F.col("next").alias("jump"), both.alias("kinds")), "nearest")
        ended.append(now.filter("jump IS NULL"))
        open_, reach, before = now.filter("jump IS NOT NULL"), 2 * reach, left
    done = reduce(DataFrame.union, ended)
    return done.select("id", F.explode("kinds").alias("kind", "v")).select("id", "kind", "v.found", "v.distance")


# -- queries ----------------------------------------------------------------------------------

#: main jobs are roots whatever their parent link says
FAMILY = "SELECT id, CASE WHEN stage <> 'publish' THEN parent END AS parent FROM {jobs}"
#: with links that lead back: every order whose number is its quarter's follow-up, for some customers
TANGLED = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_custkey % 20 = 7 THEN o_orderkey * 4 + 1 ELSE CAST(floor(o_orderkey / 4.0) AS BIGINT) END AS parent FROM {orders}"""
#: a customer's orders as saved profiles, each naming the one before
PROFILES = "SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, o_orderpriority AS kind, o_custkey AS owner, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS newest FROM {orders}"
#: a block's owner is the nearest heading before it (a heading's: of a higher level)
SECTIONS = """SELECT page * 1000000 + id AS id, page * 1000000 + CASE WHEN level = 1 THEN NULL WHEN level = 2 THEN one WHEN level = 3 THEN greatest(one, two) ELSE greatest(one, two, three) END AS parent
FROM (SELECT page, id, level, max(CASE WHEN level = 1 THEN id END) OVER w AS one, max(CASE WHEN level = 2 THEN id END) OVER w AS two, max(CASE WHEN level = 3 THEN id END) OVER w AS three FROM {layout}
WINDOW w AS (PARTITION BY page ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) h"""


def _tree_oracle(nodes: str) -> str:
    return oracle(f"""WITH RECURSIVE n AS ({nodes}),
f AS (SELECT id AS root, id, 0 AS depth, [id] AS path FROM n WHERE parent IS NULL UNION ALL SELECT f.root, n.id, f.depth + 1 AS depth, list_append(f.path, n.id) AS path FROM f JOIN n ON n.parent = f.id),
s AS (SELECT above, count(*) AS size FROM (SELECT unnest(path) AS above FROM f) u GROUP BY above)
SELECT f.root, f.id, CAST(f.depth AS BIGINT) AS depth, s.size, row_number() OVER (PARTITION BY f.root ORDER BY f.path) - 1 AS pos FROM f JOIN s ON s.above = f.id""")


def _nodes(t: Tables, sql: str, *names: str) -> DataFrame:
    return run(t.spark, sql, **{n: frame(t, n) for n in names})


@query("job_family_tree", "JOIN-07", "SET-01", oracle=_tree_oracle(FAMILY))
def job_family_tree(t: Tables) -> DataFrame:
    """Every main job's family: depth, size of the subtree and depth-first place of each job."""
    return forest(_nodes(t, FAMILY, "jobs"))


@query("owner_tree_order", "SRT-12", oracle=_tree_oracle(SECTIONS))
def owner_tree_order(t: Tables) -> DataFrame:
    """Blocks under their headings, depth first."""
    return forest(_nodes(t, SECTIONS, "layout"))


@query(
    "owning_job", "JOIN-08",
    oracle=oracle(f"""WITH RECURSIVE n AS ({TANGLED}),
w AS (SELECT id, id AS owner, [id] AS seen FROM n
UNION ALL SELECT w.id, p.id AS owner, list_append(w.seen, p.id) AS seen FROM w JOIN n o ON o.id = w.owner JOIN n p ON p.id = o.parent WHERE len(list_distinct(w.seen)) = len(w.seen)),
l AS (SELECT id, owner, len(list_distinct(seen)) < len(seen) AS back, row_number() OVER (PARTITION BY id ORDER BY len(seen) DESC) AS last FROM w)
SELECT id, owner, back AND id = owner AS cyclic FROM l WHERE last = 1"""),
)
def owning_job(t: Tables) -> DataFrame:
    """The job that each job belongs to, where links can lead back."""
    return owners(_nodes(t, TANGLED, "orders"))


@query(
    "saved_profiles", "WIN-17",
    oracle=oracle(f"""WITH n AS ({PROFILES}),
h AS (SELECT o.o_custkey AS owner, o.o_orderpriority AS kind, o.o_orderkey AS found, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) - 1 AS distance FROM orders o),
k AS (SELECT *, row_number() OVER (PARTITION BY owner, kind ORDER BY distance) AS near FROM h)
SELECT n.id, k.kind, k.found, k.distance FROM k JOIN n ON n.owner = k.owner AND n.newest WHERE k.near = 1"""),
)
def saved_profiles(t: Tables) -> DataFrame:
    """For each chain's newest revision the latest profile of every protocol along its history."""
    chain = staged(_nodes(t, PROFILES, "orders"), "profiles")
    return nearest(chain.select("id", "previous", "kind")).join(chain.filter("newest").select("id"), "id")
