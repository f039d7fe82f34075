"""Word shingles of whole texts as sets of 64-bit hashes, a batch at a time.

Words are runs of bytes other than the six ASCII white-space characters, with
A-Z in lower case.  A shingle's hash depends on its words and their order; a text
with fewer words than a shingle has one shingle, the whole sequence; a text
without words has none.

Bytes are looked at ``CHUNK`` at a time, cut between words, so beside its own bytes
a text needs about 80 bytes of memory for each of its words.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}
CHUNK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _cut(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that no word spans: white space or a text's end."""
    end = int(offsets[np.searchsorted(offsets, at)])
    while at < end:
        hit = np.flatnonzero(_SPACE[data[at : min(end, at + 4096)]])
        if len(hit):
            return at + int(hit[0])
        at += 4096
    return end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) of concatenated texts."""
    hashes, counts, at = [], np.zeros(len(offsets) - 1, np.int64), 0
    while at < len(data):
        to = _cut(data, offsets, min(at + CHUNK, len(data)))
        some, number = _word_hashes(data[at:to], np.clip(offsets, at, to) - at)
        hashes.append(some)
        counts += number
        at = to
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), counts


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < n]
    first[edges] = inside[edges]  # a word ends with its text
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_CLASS[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return hashes, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, offsets into them)."""
    hashes, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    starts = ends - counts
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + starts[doc]
    length = np.minimum(counts, width)[doc]
    out = length.astype(np.uint64) * _M1
    for k in range(width):
        step = mixed(out * _BASE + hashes[np.minimum(at + k, len(hashes) - 1)] if len(hashes) else out)
        out = np.where(k < length, step, out)
    # sort within texts: by the hash first, then stably by the text
    order = np.argsort(out, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, out = doc[order], out[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    doc, out = doc[fresh], out[fresh]
    return out, np.searchsorted(doc, np.arange(len(counts) + 1))
