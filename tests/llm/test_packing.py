import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import packing
from tests.llm.fixtures import documents, rows


def test_ids_are_those_of_tokenizers(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    texts = [r[1] or "" for r in rows()] + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += ["á  x\x85y\xa0z \x1c\x1d", "don't we'll I'M", "  lead", "trail  ", "1234567890 ½ ²", "\x00\x01\x7f"]
    for text in texts:
        assert packing.encoder(packing.default_vocabulary())(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_recognised():
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(packing.default_vocabulary()), packing.encoder(packing.default_vocabulary())
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    texts = [r[1] or "" for r in rows()] + ["<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n y", "<|endoftext", "<<|endoftext|>>  z", "don't<|ENDOFTEXT|>"]
    for text in texts:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def check(out, data, sequence=1024):
    encode = packing.encoder(packing.default_vocabulary())
    by_text = defaultdict(list)
    for r in data:
        by_text[r[0]].append(np.append(encode(r[1] or ""), 2).astype("<u4"))
    by_seq = defaultdict(list)
    seen = defaultdict(int)
    for r in out:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        part = [x[r["start"] : r["start"] + r["length"]] for x in by_text[r["doc_id"]]]
        assert any(zlib.crc32(p.tobytes()) == r["ids_crc32"] for p in part)
        assert r["piece"] == 0 or r["length"] == sequence
        seen[r["doc_id"]] += r["length"]
    assert seen == {k: sum(map(len, v)) for k, v in by_text.items()}
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= sequence
    return len(by_seq)


def test_edge_rows(spark):
    check(packing.pack_documents(documents(spark, clash=True)).collect(), rows())
    assert packing.pack_documents(documents(spark, [])).collect() == []


def test_query_packs_tightly(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = packing.op10_pack_best_fit(spark, small).collect()
    n = check(out, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n <= -(-sum(r["length"] for r in out) // 1024) + 2


def test_ids_are_kept_on_request(spark):
    for r in packing.pack_documents(documents(spark), sequence=16, keep_ids=True).collect():
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 9)), max_size=30))
def test_plan_places_every_rank_once(spec):
    counts = np.zeros(41, np.int64)
    for length, n in spec:
        counts[length] += n
    plan = packing.best_plan(counts, 40)
    fill, ranks = defaultdict(list), defaultdict(list)
    for length, a, b, seq, offset in plan.places:
        ranks[length] += range(a, b)
        for k in range(b - a):
            fill[seq + k].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in enumerate(counts) if c}
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40
    total = int((np.arange(41) * counts).sum())
    # no two lengths over half a sequence share one, so the best packing has at least as many
    least = max(-(-total // 40), int(counts[21:].sum()))
    assert len(fill) <= 11 / 9 * least + 3


@pytest.mark.parametrize("lengths, sequences", [([600, 424], 1), ([500, 300, 224], 1), ([400, 300, 200, 124], 1), ([512] * 6, 3), ([700, 700, 324], 2)])
def test_exact_complements(lengths, sequences):
    plan = packing.Plan(np.bincount(lengths, minlength=1025), 1024)
    assert plan.sequences == sequences
