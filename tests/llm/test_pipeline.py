import os
from collections import Counter

import pytest

import corpus_pipeline
from lakeloom.llm import toxicity
from lakeloom.llm.common import staged
from tests.llm import test_jaccard, test_mixing, test_packing, test_suffix
from tests.llm.fixtures import documents, rows


def brute_cut(data):
    seen = Counter()
    raw = [(r[1] or "").encode() for r in data]
    for t in raw:
        seen.update(t[i : i + 200] for i in range(len(t) - 199))
    out = []
    for r, t in zip(data, raw, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        text = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else r[1]
        out.append((r[0], text, r[2], r[3], len(text) if any(gone) else r[4]))
    return out


@pytest.mark.parametrize("edge", [False, True])
def test_stages_against_brute_force(spark, small, tmp_path, edge):
    if edge:
        (tmp_path / "in").mkdir()
        documents(spark, rows() + test_jaccard.near(1, 30, 12) + test_suffix.corpus(5, 30)).write.parquet(str(tmp_path / "in/documents.parquet"))
        os.symlink(f"{small}/labels.parquet", tmp_path / "in/labels.parquet")
        small = str(tmp_path / "in")
    key = lambda r: tuple(map(str, r))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    data = [tuple(r) for r in docs.collect()]
    now = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, small), name)
        now[name] = [tuple(r) for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    model = toxicity.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    scores = model.scores(*toxicity._buffer([(r[1] or "").encode() for r in data]))
    data = [r for r, s in zip(data, scores, strict=True) if s < 0.7]
    assert sorted(now["toxicity"], key=key) == sorted(data, key=key)

    kept = now["ngram_jaccard_join"]
    assert sorted(str(r[0]) for r in kept if test_jaccard.sets(r[1], 5)) == test_jaccard.survivors(data, 5, 80)
    assert not Counter(map(key, kept)) - Counter(map(key, data))

    assert sorted(now["suffix_array_dedup"], key=key) == sorted(brute_cut(kept), key=key)

    before, after = now["suffix_array_dedup"], Counter(map(key, now["mix_sources"]))
    assert not set(after) - {key(r) for r in before} and max(after.values()) <= 2 * max(Counter(map(key, before)).values())
    sizes = lambda rs: Counter({s: sum(len(test_mixing.split(r[1])) for r in rs if r[3] == s) for s in {r[3] for r in rs}})
    want, largest = test_mixing.reshare(sizes(before)), max(len(test_mixing.split(r[1])) for r in before)
    for s, n in sizes(now["mix_sources"]).items():
        assert abs(n - want[s]) <= largest

    test_packing.check(docs.collect(), now["mix_sources"])


def test_run_is_the_stages(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0
