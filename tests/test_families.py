"""Families of any depth against plain walks."""

import random

from lakeloom.operators import families

SCHEMA = "id long, parent long"


def frame(spark, links):
    return spark.createDataFrame(links, SCHEMA)


def walk(links):
    """(root, id, depth, size, pos) by recursion-free depth-first search."""
    kids, out = {}, []
    for i, p in links:
        kids.setdefault(p, []).append(i)
    for root in sorted(kids.get(None, [])):
        stack, order = [(root, 0)], []
        while stack:
            i, depth = stack.pop()
            order.append((i, depth))
            stack += [(k, depth + 1) for k in sorted(kids.get(i, []), reverse=True)]
        size = dict.fromkeys((i for i, _ in order), 1)
        parent = dict(links)
        for i, depth in reversed(order):
            if depth:
                size[parent[i]] += size[i]
        out += [(root, i, depth, size[i], pos) for pos, (i, depth) in enumerate(order)]
    return sorted(out)


def test_long_chain_star_and_cycles(spark):
    chain = [(n, n - 1 if n else None) for n in range(10_000)]
    star = [(20_000, None), *((20_000 + n, 20_000) for n in range(1, 3000))]
    lost = [(30_000, 30_001), (30_001, 30_002), (30_002, 30_000), (30_003, 30_002), (30_004, 30_003), (40_000, 39_999), (40_001, 40_000), (50_000, 50_000)]
    got = sorted(map(tuple, families.forest(frame(spark, chain + star + lost)).collect()))
    assert got == walk(chain + star)
    assert got[9_999] == (0, 9_999, 9_999, 1, 9_999)
    assert families.forest(frame(spark, [])).collect() == []


def test_random_forests(spark):
    rng = random.Random(4)
    ids = rng.sample(range(10**12), 1500)
    links = [(i, None if n % 40 == 0 else ids[rng.randrange(max(0, n - 60), n)]) for n, i in enumerate(ids)]
    assert sorted(map(tuple, families.forest(frame(spark, links)).collect())) == walk(links)


def test_owners(spark):
    rng = random.Random(5)
    links = [(n, rng.choice([None, rng.randrange(400), rng.randrange(400), 10_000 + n])) for n in range(400)]
    links += [(1000 + n, 1000 + n + 1) for n in range(700)] + [(1700, 1690)]  # a tail of 690 rows into a cycle of 11
    parent = dict(links)
    want = set()
    for i in parent:
        at, seen = i, set()
        while parent[at] in parent and at not in seen:
            seen.add(at)
            at = parent[at]
        loop, back = parent[i], set()
        while loop in parent and loop not in back:
            back.add(loop)
            loop = parent[loop]
        want.add((i, at, i in back))
    assert {tuple(r) for r in families.owners(frame(spark, links)).collect()} == want


def test_nearest_profile_of_each_kind(spark):
    chain = [(n, n - 1 if n else None, "abc"[n % 7 % 3]) for n in range(300)] + [(500, 501, "a"), (501, 500, "b"), (502, 501, "c")]
    got = {tuple(r) for r in families.nearest(spark.createDataFrame(chain, "id long, previous long, kind string")).collect()}
    kinds = [k for _, _, k in chain[:300]]
    want = {(n, k, m, n - m) for n in range(300) for k in "abc" for m in [max((m for m in range(n + 1) if kinds[m] == k), default=None)] if m is not None}
    assert got == want  # a history that goes in circles gives nothing


def test_nearest_needs_no_second_climb(spark, monkeypatch):
    """Rows that never end are the broken ones; looking for owners first cost as many rounds again."""
    monkeypatch.setattr(families, "owners", None)
    chain = [(1, None, "a"), (2, 1, "b"), (3, 2, "a"), (4, 99, "c"), (5, 4, "a"), (6, 7, "a"), (7, 6, "b"), (8, 7, "c"), *((i, i - 1, "a" if i == 102 else "b") for i in range(102, 140)), (101, None, "c")]
    got = {tuple(r) for r in families.nearest(spark.createDataFrame(chain, "id long, previous long, kind string")).collect()}
    assert {r for r in got if r[0] < 100} == {(1, "a", 1, 0), (2, "b", 2, 0), (2, "a", 1, 1), (3, "a", 3, 0), (3, "b", 2, 1), (4, "c", 4, 0), (5, "a", 5, 0), (5, "c", 4, 1)}
    assert {r for r in got if r[0] == 139} == {(139, "b", 139, 0), (139, "a", 102, 37), (139, "c", 101, 38)}
