import itertools
import random
import tempfile

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from lakeloom.llm import token_counts
from tests.llm.fixtures import documents, rows


def tokenizer():
    """The same vocabulary in a tokenizer that segments by unigram scores."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(token_counts.default_vocabulary(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def brute(text, vocab):
    """Pieces of the best path, by single-precision sums over all (start, end) in the tokenizer's order."""
    n = len(text)
    value, pieces = [np.float32(0)] + [None] * n, [0] * (n + 1)
    for start in range(n):
        if abs(value[start]) > 100_000:
            for end in range(start + 1, n + 1):
                value[end] = None if value[end] is None else value[end] - value[start]
            value[start] = np.float32(0)
        alone = text[start] in vocab.pieces
        for end in range(start + 1, n + 1):
            piece = text[start:end]
            if piece in vocab.pieces or (end == start + 1 and not alone):
                total = value[start] + np.float32(vocab.pieces.get(piece, vocab.unknown))
                if value[end] is None or total > value[end]:
                    value[end], pieces[end] = total, pieces[start] + (1 if piece in vocab.pieces else len(piece.encode()))
    return pieces[n]


EXTRA = ["été", "漢字", "x" * 300, "\U0001f600", "don't", "12345.678", "the the the", "  two  spaces ", "a\n\nb\tc", "Is and", "ndenen the", ""]


def test_whole_documents_agree_with_tokenizer(spark, small):
    t, vocab = tokenizer(), token_counts.vocabulary(token_counts.default_vocabulary())
    known = token_counts.Chunks(vocab)
    for x in EXTRA + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]:
        assert known.count(("▁" + x).replace(" ", "▁") if x else "")[0] == len(t.encode(x)), x[:80]
    assert vocab.count("▁the")[0] == 1


def test_ties_and_unknowns():
    vocab = token_counts.vocabulary(token_counts.default_vocabulary())
    known = token_counts.Chunks(vocab)
    for text in ("▁", "▁▁▁▁▁x", "▁a\nb", "é▁é", "aaaa", "▁the▁\U0001f600▁the", "", *map("".join, itertools.product("▁ab\x01", repeat=4))):
        assert vocab.count(text)[0] == brute(text, vocab) == known.count(text)[0]


@pytest.mark.parametrize("whole", [True, False])
def test_other_vocabularies(whole):
    """Scores as of trained unigram models, and whole ones near the limit: cache or not, results agree with the tokenizer."""
    rng = random.Random(4)
    proto = sentencepiece_model_pb2.ModelProto()
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        proto.pieces.add(piece=piece, score=0, type=kind)
    pieces = {"▁", *"abc", *("".join(rng.choices("abc", k=rng.randint(2, 4))) for _ in range(30)), *("▁" + "".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(15))}
    for piece in sorted(pieces):
        proto.pieces.add(piece=piece, score=-rng.randint(1, 60_000) if whole else -rng.uniform(1, 12), type=1)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.escape_whitespaces = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    with tempfile.NamedTemporaryFile(suffix=".model") as f:
        f.write(proto.SerializeToString())
        f.flush()
        t, vocab = sentencepiece.SentencePieceProcessor(model_file=f.name), token_counts.Vocabulary(f.name)
    known = token_counts.Chunks(vocab)
    for _ in range(300):
        text = " ".join("".join(rng.choices("abcd", k=rng.randint(0, 7), weights=(5, 5, 5, 1))) for _ in range(rng.randint(1, 30)))
        got = known.count(("▁" + text).replace(" ", "▁") if text else "")[0]
        assert got == vocab.count(("▁" + text).replace(" ", "▁") if text else "")[0] == len(t.encode(text)), text


def test_edge_rows(spark):
    vocab = token_counts.vocabulary(token_counts.default_vocabulary())
    out = token_counts.count_pieces(documents(spark, clash=True)).collect()
    want = sorted((str(r[0]), *(vocab.count(("▁" + r[1]).replace(" ", "▁")) if r[1] else (0, 0.0))) for r in rows())
    assert sorted((str(r["doc_id"]), r["n_pieces"], r["score"]) for r in out) == want
    assert token_counts.count_pieces(documents(spark, [])).collect() == []


def test_query(spark, small):
    vocab = token_counts.vocabulary(token_counts.default_vocabulary())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = token_counts.op4_token_counts(spark, small).collect()
    assert len(out) == len(docs)
    for r in out[:40]:
        assert (r["n_pieces"], r["score"]) == vocab.count(("▁" + docs[r["doc_id"]]).replace(" ", "▁"))


def test_memory_does_not_grow_with_a_word():
    import random
    import tracemalloc

    vocab = token_counts.vocabulary(token_counts.default_vocabulary())
    rng = random.Random(3)
    word = token_counts.SPACE + "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=400_000))
    known = token_counts.Chunks(vocab)
    known.count(word[:5000])
    tracemalloc.start()
    n, _ = known.count(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 50_000 and peak < 8_000_000  # the word itself and its copies, no list over positions


def test_long_words_as_the_tokenizer_has_them():
    import random

    rng = random.Random(4)
    vocab = token_counts.vocabulary(token_counts.default_vocabulary())
    for size in (4090, 4095, 4096, 9000):
        word = token_counts.SPACE + "".join(rng.choices("etaoinshrdlu\u4e00", k=size))
        pieces, score, after, _ = vocab.chunk(word, 0.0)
        assert vocab.segment(word)[:3] == (pieces, score, after)
