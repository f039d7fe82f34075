"""Quality: a compression classifier with two zstandard dictionaries.

One dictionary is built from good, one from bad labelled texts.  A text is
compressed block by block with either, so that the dictionaries count all
through a long text.  The normalised size difference (how much worse the bad
dictionary does, by the sum of both sizes) says which kind of text it is like; a
logistic curve over this one number, fitted on training texts that built no
dictionary, turns it into a calibrated score.

Defined cases: a null or empty text counts as difference 0; whole
texts are compressed, however long; repeated rows get equal scores; without
labels of both classes every score is the smoothed share of good labels (0.5
without any); an empty table gives no rows; columns beside doc_id and text never
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, record_batch, slices, text_bytes
from .labelled import TRAIN_BYTES, held_out, logistic, training_texts
from .toxicity import SCORES

BLOCK = 256
LEVEL = 3
DICTIONARY = 1 << 16
THRESHOLD = 0.5
#: training rows by class, at most
PER_CLASS = {0: 1500, 1: 2500}
#: bytes of a class's texts that build its dictionary: blocks at even distances of all of them
DICTIONARY_BYTES = 8 << 20
BATCH_BYTES = 8 << 20


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _dictionary(texts: list[bytes]) -> bytes:
    """Dictionary bytes; plain text where there is too little to train on."""
    parts = [b for t in texts for b in _blocks(t)]
    parts = parts[:: max(1, sum(map(len, parts)) // DICTIONARY_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    #: the curve: score = 1 / (1 + exp(-(slope * difference + bias))); without dictionaries the bias alone
    slope: float
    bias: float
    _ready: list = field(default_factory=list, repr=False, compare=False)

    def _compressors(self) -> list:
        if not self._ready:
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        return self._ready

    def __getstate__(self):
        return {**self.__dict__, "_ready": []}

    def difference(self, text: bytes) -> float:
        """(size by the bad dictionary - size by the good one) / their sum."""
        if not text or not self.good:
            return 0.0
        good, bad = self._compressors()
        blocks = _blocks(text)
        g = sum(len(good.compress(b)) for b in blocks)
        z = sum(len(bad.compress(b)) for b in blocks)
        return (z - g) / (z + g)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.slope * np.array([self.difference(t) for t in texts], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(pairs: list[tuple[bytes, int]]) -> Model:
    """Fit on (text, label) pairs: even rows build the dictionaries, odd ones the curve."""
    y = np.array([label for _, label in pairs], float)
    by = {k: [t for t, label in pairs if label == k] for k in (0, 1)}
    share = (y.sum() + 0.5) / (len(y) + 1)
    alone = Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    if not any(by[0]) or not any(by[1]):
        return alone
    build = {k: [t for t in v if t][::2] for k, v in by.items()}
    rest = [(t, k) for k, v in by.items() for t in (v[1::2] or v)]
    model = Model(_dictionary(build[1]), _dictionary(build[0]), 0.0, alone.bias)
    d = np.array([model.difference(t) for t, _ in rest])
    spread = float(d.std()) + 1e-6
    weights, bias = logistic(((d - d.mean()) / spread)[:, None], np.array([k for _, k in rest], float))
    model.slope, model.bias = float(weights[0]) / spread, bias - float(weights[0]) * float(d.mean()) / spread
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None, max_bytes: int = TRAIN_BYTES) -> Model:
    return train(training_texts(docs, labels, "quality", per_class or PER_CLASS, max_bytes))


def _scored(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BATCH_BYTES):
        scores = model.scores(batch.column("text").to_pylist())
        yield record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}, SCORES)


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One score per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_bytes().alias("text"))
    return rows.mapInArrow(lean(lambda it: _scored(it, model, threshold)), SCORES)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, fit(docs, labels))
