"""Count-only Viterbi segmentation under a unigram piece vocabulary.

The text is normalised as the vocabulary's tokenizer does (a leading space,
spaces as U+2581).  An Aho-Corasick automaton enumerates every vocabulary piece
in the text; dynamic programming over start positions carries only the best
value, the number of pieces and their summed score, never the pieces.

Ties and near ties go as in the tokenizer, which adds in single precision:

* starts are tried from left to right, and a later one must reach strictly more
  (after rounding) to replace what an end position has;
* where the best value of a start is further than ``LIMIT`` from 0, it is taken off
  every later position that has a value already, and the start goes on from 0;
* a character that no piece covers alone is one unknown at the least score less
  10, spelled as its bytes where the vocabulary falls back to bytes; else unknowns
  in a row are one piece.

A vocabulary with scores around -1e9 (unused spaces) so rounds values of a word
to multiples of 64, and which piece of a near tie wins hangs on the words before.

No piece has a space mark after another character (checked on loading; else the
whole text is one chunk), so a best path never spans two words: a text is cut
at spaces, and only the value at the cut passes from chunk to chunk.  (Characters
that are no piece of their own cut it, too: no longer piece has them.)  Results of
chunks are kept in a bounded cache by all that can change them (see ``Chunks``).

Defined cases: a null or empty text has 0 pieces and score 0; very long chunks
are segmented whole (linear time); repeated rows give repeated results; an empty
table gives no rows; input columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, record_batch, text_bytes

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: a best value beyond this, up or down, is taken off what follows (a constant of the tokenizer)
LIMIT = 100_000.0
CACHE_CHUNKS = 600_000
#: entries of the tables in front of that cache, which are quick to fill again
QUICK_CHUNKS = 400_000
#: bits of a count beside its score
BITS = 32
MASK = (1 << BITS) - 1
#: less than any sum; a count with no rounding, 12 bits of count below 128 and what rounding added
WORST, ROUNDED = -(1 << 60), 128 << 12
CACHED_LENGTH = 64
#: words of more characters go through a window of positions
LONG = 4095

COUNTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_pieces", T.LongType()),
    T.StructField("score", T.DoubleType()),
])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def single(x: float) -> float:
    """``x`` rounded to single precision."""
    if -16777216.0 <= x <= 16777216.0 and x == int(x):
        return x
    if 536870912.0 <= x < 1073741824.0:
        return round(x * 0.015625) * 64.0  # half to even, as floats are rounded
    return ctypes.c_float(x).value


class Vocabulary:
    """Pieces and scores of a sentencepiece model file, read as a unigram vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
        }
        self.byte_fallback = any(model.is_byte(i) for i in range(model.get_piece_size()))
        self.unknown = single(min(self.pieces.values()) - UNKNOWN_PENALTY)
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            # score and count in one integer, for whole scores
            self.automaton.add_word(piece, (len(piece), score, (int(-score) << BITS) + 1))
        self.automaton.make_automaton()
        self.singles = frozenset(p for p in self.pieces if len(p) == 1)
        self.words_apart = SPACE in self.pieces and not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.space = self.pieces.get(SPACE, self.unknown)
        #: sums of whole scores near 0 are exact
        self.whole = all(x == int(x) for x in (*self.pieces.values(), self.unknown))
        self.longest = max(map(len, self.pieces))
        #: the space's value is one that floats near it hold as a multiple of 64
        self.coarse_space = self.whole and -(2.0**30) + 1e6 < self.space < -(2.0**29) - 1e6
        #: for ``word``: what no path over single characters is worse than, by far
        near = {p: int(x) for p, x in self.pieces.items() if self.coarse_space and x >= -LIMIT}
        self.near_heads = {p: x for p, x in near.items() if p[0] == SPACE and len(p) > 1}
        self.begun = frozenset(p[:k] for p in self.near_heads for k in range(3, len(p) + 1))
        self.near_singles = frozenset(p for p in near if len(p) == 1 and p != SPACE)
        self.inner = ahocorasick.Automaton()
        for piece, score in near.items():
            if piece[0] != SPACE:
                self.inner.add_word(piece, (len(piece) - 1, score))
        if self.near_singles:
            self.inner.make_automaton()
        #: words of such characters, and others, which no piece joins to them
        known = "".join(map(re.escape, sorted(self.near_singles)))
        apart = self.near_singles and all(self.near_singles.issuperset(p.lstrip(SPACE)) for p in self.pieces if len(p) > 1)
        self.words = re.compile(f"{SPACE}+[{known}]*|[{known}]+|[^{known}{SPACE}]+") if apart else None

    def segment(self, text: str, value: float = 0.0) -> tuple[int, float, float, float, float, bool]:
        """(pieces, score, value after, least and greatest value of a start, whether values were taken off)."""
        n = len(text)
        if not n:
            return 0, 0.0, value, value, value, False
        # no piece is longer than ``longest``: what lies further back or ahead is never read, so
        # positions share slots and memory does not grow with the text
        longest, width = self.longest, self.longest + 1
        matches = self.automaton.iter(text)
        match = next(matches, None)
        begins: list[list[tuple[int, float]]] = [[] for _ in range(width)]
        values: list[float | None] = [value, *[None] * longest]
        counts, scores, strange = [0] * width, [0.0] * width, [False] * width
        reach, least, most, taken = 0, value, value, False
        # between these, sums are exact and need no rounding
        low, high = (-16777216.0, 16777216.0) if self.whole else (1.0, -1.0)
        for at in range(n):
            while match is not None and match[0] < at + longest:
                begins[(match[0] + 1 - match[1][0]) % width].append((match[0] + 1, match[1][1]))
                match = next(matches, None)
            slot = at % width
            base, before, so_far = values[slot], counts[slot], scores[slot]
            if not -LIMIT <= base <= LIMIT:
                for k in range(at + 1, reach + 1):
                    if values[k % width] is not None:
                        values[k % width] = single(values[k % width] - base)
                base, taken = 0.0, True
            else:
                least, most = min(least, base), max(most, base)
            values[slot], alone = None, False
            for end, score in begins[slot]:
                total, to = base + score, end % width
                if not low <= total <= high:
                    total = single(total)
                old = values[to]
                if old is None or total > old:
                    values[to], counts[to], scores[to], strange[to] = total, before + 1, so_far + score, False
                    if end > reach:
                        reach = end
                alone = alone or end == at + 1
            begins[slot].clear()
            if not alone:
                total, to = single(base + self.unknown), (at + 1) % width
                old = values[to]
                if old is None or total > old:
                    size = len(text[at].encode("utf-8", "replace")) if self.byte_fallback else int(not strange[slot])
                    values[to], counts[to], scores[to], strange[to] = total, before + size, so_far + self.unknown, True
                    reach = max(reach, at + 1)
        end = n % width
        return counts[end], scores[end], values[end], least, most, taken

    def chunk(self, text: str, value: float) -> tuple[int, float, float, tuple[float, ...]]:
        """(pieces, score, value after) as ``segment`` has them, for whole scores and bytes for unknowns.

        Also the scores of the pieces of two and more characters that the text begins with.
        """
        n = len(text)
        begins: list[list | None] = [None] * n
        for end, (length, score, both) in self.automaton.iter(text):
            at = end + 1 - length
            if begins[at] is None:
                begins[at] = [(end + 1, score, both)]
            else:
                begins[at].append((end + 1, score, both))
        values: list[float | None] = [value, *[None] * n]
        carried = [0] * (n + 1)
        reach, singles, unknown = 0, self.singles, self.unknown
        for at in range(n):
            base = values[at]
            if not -LIMIT <= base <= LIMIT:
                for k in range(at + 1, reach + 1):
                    x = values[k]
                    if x is not None:
                        x -= base
                        if not -16777216.0 <= x <= 16777216.0:
                            x = round(x * 0.015625) * 64.0 if 536870912.0 <= x < 1073741824.0 or -1073741824.0 < x <= -536870912.0 else single(x)
                        values[k] = x
                base = 0.0
            so_far, found = carried[at], begins[at]
            if found is not None:
                for end, score, both in found:
                    total = base + score
                    if total < -16777216.0:
                        total = round(total * 0.015625) * 64.0 if -1073741824.0 < total <= -536870912.0 else single(total)
                    old = values[end]
                    if old is None or total > old:
                        values[end] = total
                        carried[end] = so_far + both
                end = found[-1][0]  # pieces of one start come by their ends
                if end > reach:
                    reach = end
            if text[at] not in singles:
                total, end = single(base + unknown), at + 1
                if values[end] is None or total > values[end]:
                    values[end] = total
                    carried[end] = so_far + (int(-unknown) << BITS) + len(text[at].encode("utf-8", "replace"))
                    if end > reach:
                        reach = end
        head = tuple([score for end, score, _ in begins[0] if end > 1]) if begins[0] else ()
        return carried[n] & MASK, -float(carried[n] >> BITS), values[n], head

    def word(self, text: str, value: int) -> tuple[int, float, int, tuple[int, ...]] | None:
        """As ``chunk``, in whole numbers, for known characters, alone or behind a space near -1e9.

        Every position from the second on is reached by a piece that begins with the
        space, which is worth some 1e9 more than the space alone: what starts behind
        the space never wins, and sums count from the second position on.  All that
        rounding changes are the values of the pieces that begin with the space, against
        each other; what is taken off later changes no comparison.  None if this does
        not hold.  Without a space the value before has to be 0.
        """
        n = len(text)
        if text[0] != SPACE:
            if n > LONG or text[0] not in self.near_singles:
                return None
            values, counts = [WORST] * (n + 1), [0] * (n + 1)
            values[0], counts[0], second, start, head = 0, ROUNDED, 0, 0, ()
        else:
            heads = self.near_heads
            second = heads.get(text[:2])
            if second is None or n < 3 or n > LONG:
                return None
            values, counts = [WORST] * (n + 1), [0] * (n + 1)
            values[2], counts[2], start, head = 0, ROUNDED + 1, 2, (second,)
            first = value - 64 * round((value + self.space) * 0.015625)
            zero, begun = round((first + second) * 0.015625), self.begun
            for end in range(3, n + 1):
                begin = text[:end]
                if begin not in begun:
                    break
                score = heads.get(begin)
                if score is not None:
                    head += (score,)
                    values[end] = x = 64 * (round((first + score) * 0.015625) - zero)
                    # the count and what rounding has added to the sum of scores
                    counts[end] = ((x - score + second + 128) << 12) + 1
        for last, (more, score) in self.inner.iter(text, start):
            at = last - more
            total = values[at] + score
            last += 1
            if total > values[last]:
                values[last] = total
                counts[last] = counts[at] + 1
        after = total = values[n]
        if min(values[start:]) < -LIMIT:
            taken = 0
            for x in values[start:n]:
                if not -LIMIT <= x - taken <= LIMIT:
                    taken = x
            after = total - taken
        return counts[n] & 4095, float(total + second - (counts[n] >> 12) + 128), after, head if len(head) > 1 else ()

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path over normalised text."""
        return self.segment(text)[:2]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Chunks:
    """Results of chunks, by what they depend on; emptied when full.

    Behind a space whose own value is beyond ``LIMIT`` the start goes on from 0, so
    all that is left of the value before are the rounded values of the pieces that
    begin with the space: these and the chunk are the key, and the result ends at
    a value of its own.  Otherwise, with whole scores, sums near 0 are exact: while
    nothing is taken off, a chunk adds the same to whatever it starts from.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[tuple, tuple] = {}
        self.heads: dict[str, tuple[float, ...]] = {}
        #: near such a space, values matter by what they are off a multiple of 64 (one table each)
        self.quick = vocab.coarse_space and vocab.byte_fallback and vocab.words_apart and vocab.words is not None
        self.off = [v - 64 * round(v / 64) + 32 for v in range(128)]
        self.tables: list[dict[str, tuple[int, float, int]]] = [{} for _ in range(65)]
        self.held = 0

    def missing(self, chunk: str, value: int, table: dict) -> tuple[int, float, int]:
        """What ``tables`` does not hold: by what is left of the value, else anew."""
        known = self.known
        hit = known.get(chunk)
        if hit is None:
            head = self.heads.get(chunk)
            if head is not None:
                hit = known.get(self.variant(chunk, value, head))
        if hit is not None:
            if self.held >= QUICK_CHUNKS:
                self.held = 0
                for t in self.tables:
                    t.clear()
            table[chunk] = hit
            self.held += 1
            return hit
        if len(chunk) > LONG:  # one path whose memory the word's length does not matter to
            n, score, after, *_ = self.vocab.segment(chunk, float(value))
            return n, score, int(after) if -LIMIT <= after <= LIMIT else 0
        found = self.vocab.word(chunk, value)
        if found is None:
            n, score, after, head = self.vocab.chunk(chunk, float(value))
            head = (0, *head) if head else ()
        else:
            n, score, after, head = found
        hit = (n, score, int(after) if -LIMIT <= after <= LIMIT else 0)
        if len(chunk) <= CACHED_LENGTH and chunk[1:2] != SPACE:
            if len(known) >= CACHE_CHUNKS:
                known.clear()
                self.heads.clear()
            if head:
                self.heads[chunk] = head
                known[self.variant(chunk, value, head)] = hit
            else:
                known[chunk] = hit
        return hit

    def variant(self, chunk: str, value: int, head: tuple[float, ...]) -> tuple:
        """The chunk and how the values of its ``head`` are rounded against the first (0 stays 0)."""
        d = value - round((value + self.vocab.space) * 0.015625) * 64
        least = round((d + head[0]) * 0.015625)
        return (chunk, *[round((d + x) * 0.015625) - least for x in head[1:]])

    def head(self, chunk: str) -> tuple[float, ...]:
        """Scores of the pieces of two and more characters that the chunk begins with."""
        pieces = self.vocab.pieces
        found = tuple(pieces[chunk[:k]] for k in range(2, min(len(chunk), self.vocab.longest) + 1) if chunk[:k] in pieces)
        if len(chunk) <= CACHED_LENGTH:
            if len(self.heads) >= CACHE_CHUNKS:
                self.heads.clear()
            self.heads[chunk] = found
        return found

    def key(self, chunk: str, value: float) -> tuple | None:
        """What is left of the value before, where the start behind the space goes on from 0."""
        first = single(value + self.vocab.space)
        if chunk[0] != SPACE or -LIMIT <= first <= LIMIT:
            return None
        return (chunk, *[single(single(value + x) - first) for x in self.head(chunk)])

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a normalised text, chunk by chunk."""
        if self.quick:
            if text[:1] != SPACE:  # no normalised text
                return self.vocab.count(text)
            pieces, total, value = 0, 0.0, 0
            tables, off, missing = self.tables, self.off, self.missing
            for chunk in self.vocab.words.findall(text):
                table = tables[off[value & 127]]
                n, score, value = table.get(chunk) or missing(chunk, value, table)
                pieces += n
                total += score
            return pieces, total
        pieces, total, value = 0, 0.0, 0.0
        known, vocab, heads = self.known, self.vocab, self.heads
        space, coarse = vocab.space, vocab.coarse_space
        for chunk in CHUNK.findall(text):
            if not -LIMIT <= value <= LIMIT:
                value = 0.0
            if coarse and chunk in heads and chunk[1:2] != SPACE:
                # as key() has it, in units of 64: halves to even, as floats are rounded
                d = value - round((value + space) * 0.015625) * 64.0
                key = (chunk, *[round((d + x) * 0.015625) for x in heads[chunk]])
            else:
                key = self.key(chunk, value)
                if coarse and key is not None and chunk[1:2] != SPACE:
                    key = (chunk, *[round(x * 0.015625) for x in key[1:]])
            hit = known.get(key or chunk)
            if hit is not None and (key is not None or hit[3] <= value <= hit[4]):
                n, score, after = hit[:3]
                value = after if key is not None else value + after
            else:
                n, score, after, least, most, taken = vocab.segment(chunk, value)
                if len(chunk) <= CACHED_LENGTH and (key is not None or (vocab.whole and not taken)):
                    if len(known) >= CACHE_CHUNKS:
                        known.clear()
                    # without a reset: every start has to stay within LIMIT
                    known[key or chunk] = (n, score, after) if key is not None else (n, score, after - value, value - least - LIMIT, value - most + LIMIT)
                value = after
            pieces += n
            total += score
        return pieces, total


@functools.lru_cache(maxsize=1)
def chunks(path: str) -> Chunks:
    """The results that a worker has, kept for its later tasks."""
    return Chunks(vocabulary(path))


CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    known = chunks(path)
    # the cache is a million small tuples without cycles: looking for cycles in them is the dearest step
    gc.disable()
    try:
        yield from _batches(batches, known.vocab, known)
    finally:
        gc.enable()


def _batches(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, known: Chunks) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_pieces, scores = [], []
        for value in batch.column("text"):
            text = value.as_py().decode("utf-8", "replace")
            text = (" " + text).replace(" ", SPACE) if text else ""
            n, score = known.count(text) if vocab.words_apart else vocab.count(text)
            n_pieces.append(n)
            scores.append(score)
        yield record_batch({"doc_id": batch.column("doc_id"), "n_pieces": n_pieces, "score": scores}, COUNTS)


def count_pieces(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Pieces and score of every whole text."""
    path = vocabulary_path or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(lean(lambda it: _counted(it, path)), COUNTS)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Unigram piece counts of all documents."""
    return count_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
