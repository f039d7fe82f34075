"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes.

Features are the hashed byte n-grams of the text with A-Z in lower case, present
or not.  Each is scaled by its naive Bayes log-count ratio between the toxic and
the other training texts (Wang and Manning, 2012); grams that are rare or hardly
tell the classes apart are left out, so that a long text does not drown a few
telling words; a logistic regression is fitted on the scaled features.  The
model is one array of weights by hash.

Defined cases: a null or empty text has no features and gets the score of the
bias alone; whole texts are scored, however long; repeated rows get equal
scores; without labels of both classes every score is the smoothed share of
toxic labels (0.5 without any), capped below the threshold; an empty table gives
no rows; columns beside doc_id and text never matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, given_back, lean, record_batch, slices, text_bytes
from .labelled import TRAIN_BYTES, held_out, training_texts

BITS = 21
GRAMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: training rows by class, at most
PER_CLASS = {0: 3000, 1: 1500}
#: a gram is a feature if its likelihood-ratio statistic between the classes reaches this
LEAST_EVIDENCE = 15.0
BATCH_BYTES = 2 << 20
#: hashes that are weighed at a time
HASHES = 1 << 17

SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("held_out", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()),
])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = {4: 0xC2B2AE35, 5: 0x27D4EB2F, 6: 0x165667B1, 7: 0x9E3779B1, 8: 0x85EBCA6B}


def gram_hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hash of the n-gram that starts at each byte) over a buffer, n from 4 to 8."""
    b = _LOWER[data].astype(np.uint32)
    x2 = b[:-1] | (b[1:] << np.uint32(8))
    x4 = x2[:-2] | (x2[2:] << np.uint32(16))
    for n in GRAMS:
        if len(data) < n:
            continue
        size = len(data) - n + 1
        mixed = x4[:size] * np.uint32(_ODD[n])
        if n > 4:  # the first four and the last four bytes
            mixed ^= mixed >> np.uint32(15)
            mixed = (mixed + x4[n - 4 : n - 4 + size]) * np.uint32(_ODD[n] ^ 0x5BD1E994)
        yield n, (mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x7FEB352D) >> np.uint32(32 - BITS)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a space before and after each: buffer, starts, ends."""
    n = len(offsets) - 1
    sizes = np.diff(offsets) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(int(ends[-1]) if n else 0, 32, np.uint8)
    shift = np.repeat(starts + 1 - offsets[:-1], np.diff(offsets))
    out[np.arange(len(data)) + shift] = data
    return out, starts, ends


def present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once; ``wanted`` (by hash) leaves out others early."""
    buffer, starts, ends = spaced(data, offsets)
    found = []
    for n, h in gram_hashes(buffer):
        at = np.flatnonzero(wanted[h]) if wanted is not None else np.arange(len(h))
        doc = np.searchsorted(starts, at, side="right") - 1
        whole = at + n <= ends[doc]
        found.append((doc[whole].astype(np.int64) << BITS) | h[at[whole]])
    pairs = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]]
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray  # by hash; zero: not a feature
    bias: float

    def __getstate__(self):
        # features are few: only theirs travel
        at = np.flatnonzero(self.weights)
        return at.astype(np.int32), self.weights[at], self.bias

    def __setstate__(self, state):
        at, values, self.bias = state
        self.weights = np.zeros(1 << BITS, np.float32)
        self.weights[at] = values

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, h = present(data, offsets, self.weights != 0)
        z = self.bias + np.bincount(doc, weights=self.weights[h], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def train(pairs: list[tuple[bytes, int]], steps: int = 200, l2: float = 1e-3) -> Model:
    """Fit on (text, label) pairs."""
    y = np.array([label for _, label in pairs], float)
    size = 1 << BITS
    if len(set(y.tolist())) < 2:
        share = min((y.sum() + 0.5) / (len(y) + 1), THRESHOLD - 0.01)
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    pos, neg = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for part in _parts(pairs):
        doc, h = present(*_buffer([pairs[i][0] for i in part]))
        one = y[part][doc] == 1
        np.add.at(pos, h[one], 1)
        np.add.at(neg, h[~one], 1)
    use = np.zeros(size, bool)
    for at in range(0, size, HASHES):  # the driver holds few numbers of all hashes at a time
        some = slice(at, at + HASHES)
        use[some] = _evidence(pos[some], neg[some], y.sum(), (1 - y).sum()) >= LEAST_EVIDENCE
    scale = np.log((pos[use] + 0.5) / (y.sum() + 1)) - np.log((neg[use] + 0.5) / ((1 - y).sum() + 1))
    del pos, neg
    number = (np.cumsum(use) - 1).astype(np.int32)  # hash to position among the features
    docs, feats = [], []
    for part in _parts(pairs):
        doc, h = present(*_buffer([pairs[i][0] for i in part]), use)
        docs.append((doc + part[0]).astype(np.int32))
        feats.append(number[h])
    doc, feat = np.concatenate(docs), np.concatenate(feats)
    del docs, feats, number
    size = len(scale)
    # classes weigh alike, so the threshold does not hang on the sample's make-up
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, bias = np.zeros(size), 0.0
    m1, m2, b1, b2 = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the full batch
        z = bias + np.bincount(doc, weights=(w * scale)[feat], minlength=len(y))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        pull = err[doc]
        pull *= scale[feat]
        g = np.bincount(feat, weights=pull, minlength=size) + l2 * w
        gb = err.sum()
        m1, m2, b1, b2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        rate = 0.05 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * m1 / (np.sqrt(m2) + 1e-9)
        bias -= rate * b1 / (np.sqrt(b2) + 1e-9)
    weights = np.zeros(1 << BITS, np.float32)
    weights[use] = w * scale
    return Model(weights, float(bias))


def _parts(pairs: list[tuple[bytes, int]], limit: int = 1 << 17) -> Iterator[range]:
    """Runs of texts of about ``limit`` bytes, so that training holds few grams at a time."""
    start = size = 0
    for i, (text, _) in enumerate(pairs):
        size += len(text)
        if size >= limit or i + 1 == len(pairs):
            yield range(start, i + 1)
            start, size = i + 1, 0


def _evidence(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Likelihood-ratio statistic of presence against class."""
    share = (pos + neg) / (n_pos + n_neg)
    out = np.zeros(len(pos))
    for seen, total in ((pos, n_pos), (neg, n_neg)):
        for count, expected in ((seen, share * total), (total - seen, (1 - share) * total)):
            out += 2 * count * np.log(np.maximum(count, 1e-12) / np.maximum(expected, 1e-12)) * (count > 0)
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None, max_bytes: int = TRAIN_BYTES) -> Model:
    with given_back():
        return train(training_texts(docs, labels, "toxic", per_class or PER_CLASS, max_bytes))


def _scored(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BATCH_BYTES):
        scores = model.scores(*binary_parts(batch.column("text")))
        yield record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}, SCORES)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One score per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_bytes().alias("text"))
    return rows.mapInArrow(lean(lambda it: _scored(it, model, threshold)), SCORES)


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, columns unchanged."""
    schema, names = docs.schema, docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            ok = pa.array(model.scores(*binary_parts(batch.column("text"))) < threshold)
            columns = batch.column("row").flatten()
            yield record_batch({k: c.filter(ok) for k, c in zip(names, columns, strict=True)}, schema)

    # the row travels as one column: no name of its own can clash
    return docs.select(F.struct("*").alias("row"), text_bytes().alias("text")).mapInArrow(lean(kept), schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, fit(docs, labels))
