import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from lakeloom.llm import quality, toxicity
from lakeloom.llm.labelled import training_texts
from tests.llm.fixtures import documents, rows

LABELS = "doc_id long, quality int, toxic int"


def test_features_are_the_grams_of_each_text():
    texts = [b"Abcdefg", b"", b"xy", b"abcdefg abcdefg"]
    buffer, offsets = toxicity._buffer(texts)
    doc, h = toxicity.present(buffer, offsets)
    alone = [set(toxicity.present(*toxicity._buffer([t]))[1].tolist()) for t in texts]
    for i, want in enumerate(alone):
        assert set(h[doc == i].tolist()) == want
    spaced = [b" " + t.lower() + b" " for t in texts]
    grams = [len({s[i : i + n] for n in toxicity.GRAMS for i in range(len(s) - n + 1)}) for s in spaced]
    assert [len(a) for a in alone] == grams


def test_lexicon_is_learnt():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    pairs = []
    for i in range(400):
        text = rng.choice(words, 60).tolist()
        if i % 4 == 0:
            text[7] = f"blasted{'abcd'[i // 4 % 4]}"
        pairs.append((" ".join(text).encode(), int(i % 4 == 0)))
    model = toxicity.train(pairs[:300])
    got = model.scores(*toxicity._buffer([t for t, _ in pairs[300:]]))
    assert ((got >= 0.7) == np.array([y for _, y in pairs[300:]], bool)).mean() > 0.97


@pytest.mark.parametrize("module, score, label", [(toxicity, toxicity.score_toxicity, 0.7), (quality, quality.score_quality, 0.5)])
def test_edge_rows(spark, module, score, label):
    docs = documents(spark, clash=True)
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(0, 1, 0), (1, 1, None), (3, 0, 1), (9, 0, 1), (9, 0, 1), (5, None, None), (None, 1, 1), (7, 7, 7)], LABELS)
    for labels in (none, some):
        out = score(docs, module.fit(docs, labels)).collect()
        assert len(out) == len(rows())
        for r in out:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= label)
            assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    empty = documents(spark, [])
    assert score(empty, module.fit(empty, none)).collect() == []


def test_filter_keeps_columns(spark):
    docs = documents(spark, clash=True)
    model = toxicity.fit(docs, spark.createDataFrame([], LABELS))
    out = toxicity.clean_documents(docs, model)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()


def test_names_of_its_own_do_not_clash(spark):
    docs = documents(spark).withColumn("#text", F.lit("x")).withColumn("row", F.lit(1)).withColumn("text_", F.lit(2))
    out = toxicity.clean_documents(docs, toxicity.fit(docs, spark.createDataFrame([], LABELS)))
    assert out.schema.names == docs.schema.names and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_training_texts(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    data = [(i, "t" * (i + 1), None, None, None) for i in ids[:20]] + [(ids[0], "", None, None, None), (ids[1], None, None, None, None)]
    labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(ids)], LABELS)
    docs = documents(spark, data)
    all_ = training_texts(docs, labels, "toxic", {0: 100, 1: 100})
    assert len(all_) == 20 and {t for t, _ in all_} <= {(x[1] or "").encode() for x in data}
    assert all_ == training_texts(docs.orderBy("n_chars").repartition(3), labels, "toxic", {0: 100, 1: 100})
    # ids that have no document do not use up the sample's places
    assert len(training_texts(docs, labels, "toxic", {0: 9, 1: 9})) == 18
    few = training_texts(docs, labels, "toxic", {0: 100, 1: 100}, 100)
    assert 2 <= len(few) < 20 and sum(len(t) for t, y in few if y == 0) <= 50


def test_quality_is_the_curve_of_one_difference():
    rng = np.random.default_rng(0)
    good, bad = ([" ".join(rng.choice([f"{k}{i}" for i in range(200)], 80)).encode() for _ in range(60)] for k in ("good", "junk"))
    model = quality.train([(t, 1) for t in good] + [(t, 0) for t in bad])
    texts = [good[1], bad[1], b"", good[3] + bad[3]]
    d = np.array([model.difference(t) for t in texts])
    assert d[0] > 0 > d[1] and d[2] == 0 and model.slope > 0
    assert np.allclose(model.scores(texts), 1 / (1 + np.exp(-(model.slope * d + model.bias))))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = [r for r in quality.op9_quality(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(out) > 1000
    assert np.mean([r["predicted"] == labels[r["doc_id"]]["quality"] for r in out]) >= 0.97

    out = [(r["predicted"], labels[r["doc_id"]]["toxic"]) for r in toxicity.op8_toxicity(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p for p, y in out if y]) >= 0.9  # recall
    assert np.mean([p for p, y in out if not y]) <= 0.01  # false alarms


def test_a_huge_training_text_shuts_out_no_other(spark):
    from lakeloom.llm.labelled import training_texts

    n = 60
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 10 == 0 else 40)) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    every = training_texts(docs, labels, "toxic", {0: 100, 1: 100}, 1 << 20)
    some = training_texts(docs, labels, "toxic", {0: 100, 1: 100}, 2 * 2000)
    assert {t for t, _ in some} == {b"x" * 40} and len(some) == sum(len(t) == 40 for t, _ in every)
    assert training_texts(docs, labels, "toxic", {0: 100, 1: 100}, 2) == []


def test_training_holds_few_numbers_of_all_hashes():
    import random
    import tracemalloc

    from lakeloom.llm import toxicity

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    pairs = [((" ".join(rng.choices(words, k=60)) + (" vile" if i % 3 == 0 else "")).encode(), int(i % 3 == 0)) for i in range(300)]
    tracemalloc.start()
    model = toxicity.train(pairs)
    peak = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    assert peak < 100 and (model.scores(*toxicity._buffer([t for t, _ in pairs])) >= 0.7).tolist() == [y == 1 for _, y in pairs], peak
