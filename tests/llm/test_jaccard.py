import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import jaccard, shingles
from tests.llm.fixtures import documents, rows


def sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def roots(data, width, percent):
    """The component of each row as the position of one of its rows, and the rows' sets."""
    s = [sets(r[1], width) for r in data]
    parent = list(range(len(s)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(s))], s


def names(data, width, percent):
    """The least id of each component (by root), null where it has none, and the above."""
    of, s = roots(data, width, percent)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[of[i]] = min(least.get(of[i], r[0]), r[0])
    return least, of, s


def brute(data, width, percent):
    least, of, s = names(data, width, percent)
    return sorted((str(r[0]), len(s[i]), str(least.get(of[i]) if s[i] else r[0])) for i, r in enumerate(data))


def survivors(data, width, percent):
    """The id of the one row that stays of each component with words (unlinked components can share it)."""
    least, of, s = names(data, width, percent)
    return sorted(str(least.get(c)) for c in {of[i] for i in range(len(data)) if s[i]})


def run(spark, data, width=4, percent=85):
    out = jaccard.link_components(documents(spark, data, clash=True), width, percent).collect()
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB \n\tcé", max_size=30), max_size=6), st.integers(1, 5))
def test_shingle_sets(texts, width):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    items, at = shingles.shingle_sets(data, offsets, width)
    want = [sets(t, width) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want]
    names = {}
    for i, w in enumerate(want):
        own = items[at[i] : at[i + 1]].tolist()
        assert own == sorted(set(own))
        for j in range(i):
            assert len(set(own) & set(items[at[j] : at[j + 1]].tolist())) == len(w & want[j])
    assert not names


def near(seed, n, groups):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=30)
    out = []
    for g in range(groups):
        base = rng.choices(vocab, k=rng.choice([3, 12, 40, 90, 200]))
        if g % 2:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append((len(out) + 5, " ".join(t), None, None, None))
    rng.shuffle(out)
    return out[:n]


def test_components_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 5)
    data = near(3, 160, 45)
    assert run(spark, data) == brute(data, 4, 85)


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 8)
    monkeypatch.setattr(jaccard, "PAGE", 4)
    data = near(4, 120, 40)
    assert run(spark, data, 5, 80) == brute(data, 5, 80)


def test_edge_rows(spark):
    assert run(spark, rows()) == brute(rows(), 4, 85)
    assert run(spark, []) == []


@pytest.mark.parametrize("a, b, linked", [(20, 17, True), (20, 16, False), (100, 85, True), (101, 85, False)])
def test_threshold_is_exact(a, b, linked):
    assert (min(a, b) >= jaccard.needed(np.int64(a), np.int64(b), 85)) == linked


def test_tree_pairs_lose_nothing():
    rng = np.random.default_rng(0)
    sets_ = []
    for _ in range(40):
        base = rng.integers(0, 1 << 40, rng.integers(5, 120))
        sets_ += [np.unique(np.where(rng.random(len(base)) < f, rng.integers(0, 1 << 40, len(base)), base)) for f in (0, 0.03, 0.06, 0.3)]
    sets_.sort(key=len)
    points = np.array([np.bincount(s % 64, minlength=64) for s in sets_])
    n = np.array([len(s) for s in sets_])
    got = {(x, y) for p, q in jaccard.point_pairs(n, points, 85) for x, y in zip(p.tolist(), q.tolist(), strict=True)}
    few = [x for p, _ in jaccard.point_pairs(n, points, 85, best=1) for x in p.tolist()]
    assert len(few) == len(set(few)) and set(few) == {x for x, _ in got}
    for i in range(len(sets_)):
        for j in range(i + 1, len(sets_)):
            same = len(np.intersect1d(sets_[i], sets_[j]))
            if 100 * same >= 85 * (n[i] + n[j] - same):
                assert (i, j) in got
    assert len(got) < 0.1 * len(sets_) ** 2


def test_one_document_of_each_group_stays(spark):
    data = near(7, 60, 20) + rows()
    docs = documents(spark, data, clash=True)
    kept = jaccard.distinct_documents(docs, 4, 85)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect() if sets(r["text"], 4)) == survivors(data, 4, 85)
    assert sum(not sets(r["text"], 4) for r in kept.collect()) == sum(not sets(r[1], 4) for r in data)


def test_components_that_share_a_name_stay_apart(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    data = [(i, text(w), None, None, None) for i, w in [(None, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "d"), (8, "d"), (None, "e"), (9, "e")]]
    kept = jaccard.distinct_documents(documents(spark, data), 4, 85).collect()
    want = [(7, text("c")), (7, text("d")), (9, text("e")), (None, text("a")), (None, text("b"))]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted((str(i), x) for i, x in want)


def test_query(spark, small):
    data = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    out = jaccard.op5_jaccard_components(spark, small)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((str(a), b, str(c)) for a, b, c in out.collect()) == brute(data, 4, 85)


@given(st.lists(st.integers(0, 400), max_size=300, unique=True), st.lists(st.integers(0, 400), max_size=300, unique=True))
def test_fine_overlap_is_a_bound(a, b):
    spread = lambda x: np.sort((np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) & np.uint32(1023)).astype(np.uint32)
    assert jaccard.fine_overlap(spread(a).tobytes(), spread(b).tobytes()) >= len(set(a) & set(b))
