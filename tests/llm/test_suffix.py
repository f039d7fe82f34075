import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lakeloom.llm import suffix
from tests.llm.fixtures import documents, rows

L = suffix.LENGTH


def brute(data):
    raw = [(r[1] or "").encode() for r in data]
    seen = Counter(t[i : i + L] for t in raw for i in range(len(t) - L + 1))
    out = []
    for r, t in zip(data, raw, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - L + 1):
            if seen[t[i : i + L]] > 1:
                gone[i : i + L] = b"\x01" * L
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(r[0]), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, data):
    out = suffix.remove_repeats(documents(spark, data, clash=True)).collect()
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.choice([30, 45, 60, 120])) for _ in range(5)]
    out = []
    for i in range(n):
        t = text(rng.choice([3, 40, 120, 300]))
        kind = rng.randrange(7)
        if kind == 0 and out:
            t = rng.choice(out)[1]
        elif kind == 1 and out:
            t = list(rng.choice(out)[1])
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = "é"
            t = "".join(t)
        elif kind in (2, 3):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 2)
            t = t + p[cut:] + text(20)
        elif kind == 4:
            t = "ab" * rng.choice([50, 150, 300]) + t
        elif kind == 5:
            t = t + "\n" + t
        out.append((i, t, None, None, None))
    return out


def test_random_corpora(spark):
    for seed in (1, 2):
        data = corpus(seed, 90)
        assert run(spark, data) == brute(data)


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP_CONTEXTS", 2)
    monkeypatch.setattr(suffix, "ROWS_PER_COPY", 3)
    monkeypatch.setattr(suffix, "HELD_ROWS", 5)
    monkeypatch.setattr(suffix, "BATCH_BYTES", 500)
    data = corpus(3, 80)
    assert run(spark, data) == brute(data)


def test_periodic_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "MOST_TIMES", 150)
    texts = ["a" * 200, "a" * 201, "a" * 5000, "x" + "ab" * 700 + "y", "b" * 150 + "abc" * 300, "abcdefghijklmnopqrstuvwxyz0123456789" * 20, "q" * 199, "ab" * 101, "0" * 340 + "1" + "0" * 340]
    data = [(i, t, None, None, None) for i, t in enumerate(texts)]
    assert run(spark, data) == brute(data)
    alone = [(1, "ab" * 4000, None, None, None), (2, "xyz" * 66 + "xy", None, None, None)]
    assert run(spark, alone) == brute(alone)


def test_a_long_periodic_text_is_one_row():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array([b"a" * 3_000_000], pa.binary()), "k1": pa.array([1], pa.int64()), "k2": pa.array([2], pa.int64())})
    rows = sum(b.num_rows for b in suffix._anchors(iter([batch])))
    assert rows < 100


def test_edge_rows(spark):
    assert run(spark, rows()) == brute(rows())
    assert run(spark, []) == []
    exact = "".join(chr(97 + i * i % 26) for i in range(L))
    data = [(1, exact, None, None, None), (2, "x" + exact + "y", None, None, None), (3, exact[:-1], None, None, None)]
    assert run(spark, data) == brute(data)


def test_anchors_cover_every_window():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, k, n).astype(np.uint8) for k, n in ((2, 900), (256, 1500), (1, 700), (4, 199), (4, 200), (4, 0), (3, 201))]
    data, offsets = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]
    text, _, at, first, last = suffix.anchors(data, offsets)
    got = [(t, i, a) for t, a, s, e in zip(text, at, first, last, strict=True) for i in range(s, e + 1)]
    want = [(t, offsets[t] + i) for t, x in enumerate(texts) for i in range(len(x) - L + 1)]
    assert [(t, i) for t, i, _ in got] == want
    assert all(i <= a <= i + L - suffix.GRAM for _, i, a in got)


@pytest.mark.parametrize("seed", range(6))
def test_index_is_a_suffix_array_with_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 3, 60).astype(np.uint8).tobytes()
    contexts = [base[rng.integers(0, 20) : rng.integers(30, 60)] + rng.integers(0, 2, rng.integers(0, 9)).astype(np.uint8).tobytes() for _ in range(12)]
    groups = rng.integers(0, 3, 12)
    index = suffix.RunLengthIndex(contexts, groups)
    named = np.unique(groups, return_inverse=True)[1]
    suffixes = []
    for c, text in enumerate(contexts):
        for i in range(len(text) + 1):
            suffixes.append((named[c], [b + 2 for b in text[i:]] + [1], c, index.starts[c] + i))
    suffixes.sort(key=lambda s: (s[0], s[1], s[2]))
    for length in (5, 9, 20):
        seen = Counter((named[c], t[i : i + length]) for c, t in enumerate(contexts) for i in range(len(t) - length + 1))
        want = [int(i + length <= len(t) and seen[named[c], t[i : i + length]] > 1) for c, t in enumerate(contexts) for i in range(len(t) + 1)]
        assert index.repeated(np.ones(12, np.int64), length).astype(int).tolist() == want
    assert index.runs < len(index.rows)


def test_query(spark, small):
    data = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    out = suffix.op3_suffix_dedup(spark, small)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == brute(data)


def test_thousands_of_equal_rows(spark):
    """Equal rows are one text with a number, whatever their ids."""
    rng = random.Random(8)
    long = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(4500))
    data = [(n % 5, long, None, None, None) for n in range(2000)] + [(9, long[500:900] + "x" * 150, None, None, None), (10, "y" * 150 + long[:199], None, None, None)]
    df = documents(spark, data)
    (row,) = suffix.repeated_windows(df.filter("doc_id < 9")).collect()
    assert len(row["runs"]) < 10_000
    out = {tuple(r) for r in suffix.remove_repeats(df).select("doc_id", "n_bytes", "n_removed").collect()}
    n = len(long)
    assert out == {*((i, n, n) for i in range(5)), (9, 550, 400), (10, 349, 0)}
