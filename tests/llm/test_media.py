import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import media
from tests.llm.fixtures import documents, rows


def filtered(rows, kinds, bpp=1):
    """A PNG row filterer, byte by byte as the format's definition has it."""
    out = []
    for y, kind in enumerate(kinds):
        line = [kind]
        for x in range(rows.shape[1]):
            a = int(rows[y, x - bpp]) if x >= bpp else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - bpp]) if y and x >= bpp else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(line)
    return np.array(out, np.uint8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=9), min_size=1, max_size=4), st.sampled_from([1, 3]), st.integers(0, 2**32 - 1))
def test_all_filters_are_undone(pictures, bpp, seed):
    rng = np.random.default_rng(seed)
    rows = [rng.integers(0, 256, (len(kinds), 4 * bpp), np.uint8) for kinds in pictures]
    got = media.unfilter([filtered(r, k, bpp) for r, k in zip(rows, pictures, strict=True)], bpp)
    assert all((a == b).all() for a, b in zip(got, rows, strict=True))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 12), st.integers(0, 2**32 - 1))
def test_rows_are_filtered_as_the_format_says(height, seed):
    rng = np.random.default_rng(seed)
    rows = np.cumsum(rng.integers(-3, 4, (height, 8)), axis=rng.integers(0, 2)).astype(np.uint8)
    got = media.filtered(rows, np.concatenate([np.zeros_like(rows[:1]), rows[:-1]]))
    assert (got == filtered(rows, got[:, 0].tolist())).all()
    cost = lambda r: np.abs(r.view(np.int8).astype(int)).sum()
    for k in range(5):
        assert (np.apply_along_axis(cost, 1, got[:, 1:]) <= np.apply_along_axis(cost, 1, filtered(rows, [k] * height)[:, 1:])).all()


def test_stored_bytes_are_what_is_digested(spark):
    stored = media.encode_png(documents(spark)).collect()
    kinds = set()
    for r in stored:
        kinds |= set(media.read_chunks(bytes(r["media"]))[0][:, 0].tolist())
    assert len(kinds) >= 4  # the query's own rows need unfiltering
    want = sorted((str(r["doc_id"]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) for r in stored)
    assert sorted((str(r["doc_id"]), r["media_bytes"], r["media_sha256"]) for r in media.media_features(media.encode_png(documents(spark))).collect()) == want


def test_damage_is_noticed():
    good = media.write_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    assert media.read_png(good).ravel().tolist() == list(range(128))
    for bad in (good[:-5], good[:40] + b"\x00" + good[41:], b"GIF" + good, good[:33] + good[-12:], b""):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            media.read_png(bad)


def test_hash_is_stable_under_noise():
    rng = np.random.default_rng(5)
    rows = np.cumsum(rng.integers(-3, 4, (200, 64)), axis=0).clip(-100, 100).astype(np.int64) + 128
    noisy = (rows + rng.integers(-2, 3, rows.shape)).clip(0, 255).astype(np.uint8)
    bits = np.unpackbits(np.frombuffer(media.perceptual_hash(rows.astype(np.uint8)), np.uint8)) != np.unpackbits(np.frombuffer(media.perceptual_hash(noisy), np.uint8))
    assert bits.sum() <= 8


def check(out, data):
    assert len(out) == len(data)
    want = {}
    for r in data:
        raw = (r[1] or "").encode()
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        want.setdefault(r[0], []).append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    for r in out:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
        assert len(r["feature"]) == 16 and r["error"] is None
    by = {}
    for r in out:
        assert by.setdefault(r["payload_sha256"], tuple(r)[2:]) == tuple(r)[2:]


def test_edge_rows(spark):
    check(media.media_features(media.encode_png(documents(spark, clash=True))).collect(), rows())
    assert media.media_features(media.encode_png(documents(spark, []))).collect() == []


def test_unreadable_media(spark):
    df = spark.createDataFrame([(1, 2, bytearray(b"no png")), (2, 0, None)], media.STORED)
    assert [r["error"] for r in media.media_features(df).collect()] == ["no PNG signature", "no media"]


def test_query(spark, small):
    data = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(media.op1_media_png(spark, small).collect(), data)
