"""Text functions: native columns first, Arrow-batched Python where SQL has no word for it."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import Decimal
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: rows that a kernel with many results a row takes at a time
SLICE_ROWS = 200


def comparison(column: str) -> Column:
    """Ligatures spelled out, soft hyphens dropped, wrapped words joined, white space collapsed; no NFKC."""
    c = F.replace(F.replace(F.replace(F.col(column), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("­"), F.lit(""))
    c = F.regexp_replace(c, r"(\p{L})-\n(\p{L})", "$1$2")
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))


# -- numbers ---------------------------------------------------------------------------------

# fixed values: powers of ten of scale words; one letter counts only before what models are measured in
SCALES = {
    "thousand": 3, "million": 6, "billion": 9, "trillion": 12, "b": 9, "m": 6,
    "万": 4, "十万": 5, "百万": 6, "千万": 7, "亿": 8, "十亿": 9, "万亿": 12,
    "萬": 4, "十萬": 5, "百萬": 6, "千萬": 7, "億": 8, "十億": 9, "萬億": 12,
}
# fixed values: full-width digits and signs that count as their ASCII forms
NARROW = str.maketrans("０１２３４５６７８９．％＋－", "0123456789.%+-")
# fixed values: the leading digit's powers of ten within which a number is written out
LEAST_LEAD, MOST_LEAD = -20, 30
_RUN = re.compile("[0-9]+")
_WORD = re.compile("[A-Za-z0-9_]")
_MEASURED = re.compile(r"\s+(?:parameter|model)s?\b", re.I)
_LONGEST_SCALE = max(map(len, SCALES))


class Number:
    """One number read from a text: where it stands, its parts, and what multiplies it.

    It is read forwards from a run of digits, each part only if the whole part is there.
    """

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.sign, self.whole, self.fraction, self.exponent = "", text[start:end], "", ""
        self.power, self.percent = 0, False

    def _digits(self, at: int) -> str:
        run = _RUN.match(self.text, at)
        return run[0] if run else ""

    def _blank(self, at: int) -> int:
        while self.text[at : at + 1] in (" ", "\t", "\u00a0", "\u202f"):
            at += 1
        return at

    def read(self, signed: bool) -> Number:
        if signed:
            self.start -= 1
            self.sign = self.text[self.start].replace("−", "-")
        # groups of exactly three digits behind commas, if at most three stand before the first
        while len(self.whole) <= 3 or "," in self.text[self.start : self.end]:
            group = self._digits(self.end + 1) if self.text[self.end : self.end + 1] == "," else ""
            if len(group) != 3:
                break
            self.whole += group
            self.end += 4
        for dot in (self.end, self._blank(self.end)):  # close, or with blanks on both sides
            if self.text[dot : dot + 1] != ".":
                continue
            after = self._blank(dot + 1)
            if (dot == self.end) == (after == dot + 1) and (digits := self._digits(after)):
                self.fraction, self.end = digits, after + len(digits)
                break
        if self.text[self.end : self.end + 1] in ("e", "E"):
            signed = self.text[self.end + 1 : self.end + 2] in ("+", "-")
            if digits := self._digits(self.end + 1 + signed):
                stop = self.end + 1 + signed + len(digits)
                self.exponent, self.end = self.text[self.end + 1 : stop], stop
        self._scale(self._blank(self.end))
        at = self._blank(self.end)
        if self.text[at : at + 1] == "%":
            self.percent, self.end = True, at + 1
        return self

    def _scale(self, at: int) -> None:
        for size in range(_LONGEST_SCALE, 0, -1):
            word, stop = self.text[at : at + size].lower(), at + size
            if word not in SCALES or re.match("[A-Za-z]", self.text[stop : stop + 1]):
                continue
            if word not in ("b", "m") or _MEASURED.match(self.text, stop):
                self.power, self.end = SCALES[word], stop
                return

    def value(self) -> str:
        """The exact value: no zeros that say nothing, an exponent only where digits would run long.

        An exponent of more than six digits is not computed with; the literal stands for it.
        """
        if len(self.exponent.lstrip("+-")) > 6:
            fraction = f".{self.fraction}" if self.fraction else ""
            return f"literal:{self.sign}{self.whole}{fraction}e{self.exponent}*1e{self.power}"
        digits = self.whole + self.fraction
        point = len(self.whole) + int(self.exponent or 0) + self.power  # digits before the decimal point
        shown = digits.lstrip("0")
        point -= len(digits) - len(shown)
        shown = shown.rstrip("0")
        if not shown:
            return "0"
        if not LEAST_LEAD <= point - 1 <= MOST_LEAD:
            out = shown[0] + ("." + shown[1:] if shown[1:] else "") + f"e{point - 1}"
        elif point <= 0:
            out = "0." + "0" * -point + shown
        else:
            out = shown[:point].ljust(point, "0") + ("." + shown[point:] if shown[point:] else "")
        return f"-{out}" if self.sign == "-" else out


def scan_numbers(text: str) -> Iterator[Number]:
    """Numbers from left to right; digits inside or right behind a word are none."""
    at = 0
    while run := _RUN.search(text, at):
        first = run.start()
        signed = first > at and text[first - 1] in "+-−" and not (first > 1 and _WORD.match(text, first - 2))
        if first and not signed and _WORD.match(text, first - 1):
            at = run.end()
            continue
        number = Number(text, *run.span()).read(signed)
        yield number
        at = number.end


def canonical(literal: str, scale: int = 0) -> str:
    """The exact value of one number's literal, times ten to the ``scale``."""
    text = literal.translate(NARROW)
    run = _RUN.search(text)
    number = Number(text, *run.span()).read(run.start() > 0)
    number.power = scale
    return number.value()


def numbers(text: str | None) -> list[dict]:
    narrow = (text or "").translate(NARROW)
    return [{"literal": text[n.start : n.end].strip(), "value": n.value() + "%" * n.percent} for n in scan_numbers(narrow)]


def number_udf():
    @F.pandas_udf("array<struct<literal string, value string>>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(numbers)

    return f


# -- phrases ---------------------------------------------------------------------------------

SEGMENT, WORD = re.compile(r"[^A-Za-z \t-]+"), re.compile(r"[a-z][a-z-]{1,35}")


def in_slices(frame: DataFrame, kernel: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInPandas`` with few rows at a time: what a task holds in Python besides Spark's batch is theirs."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (batch.slice(start, rows).to_pandas() for batch in batches for start in range(0, batch.num_rows, rows))
        for out in kernel(slices):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    return frame.mapInArrow(run, schema)


def phrases(frames: Iterator[pd.DataFrame], stop: list[str], most: int) -> Iterator[pd.DataFrame]:
    """Repeated phrases of two and three words of each ``(doc_id, text)``, the most frequent ones."""
    stopped = frozenset(stop)
    good: dict[str, bool] = {}
    for f in frames:
        rows = []
        for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
            seen: Counter[str] = Counter()
            for segment in SEGMENT.split(text or ""):
                words = segment.lower().split()
                for w in words:
                    if w not in good:
                        if len(good) > 100_000:
                            good.clear()
                        good[w] = w not in stopped and WORD.fullmatch(w) is not None
                ok = [good.get(w, False) for w in words]
                for k in range(len(words) - 1):
                    if ok[k] and ok[k + 1]:
                        two = f"{words[k]} {words[k + 1]}"
                        seen[two] += 1
                        if k + 2 < len(words) and ok[k + 2]:
                            seen[f"{two} {words[k + 2]}"] += 1
            best = sorted(((-n, term) for term, n in seen.items() if n >= 2))[:most]
            rows += [(doc_id, term, -n) for n, term in best]
        yield pd.DataFrame(rows, columns=["doc_id", "term", "n"])


# -- protected atoms -------------------------------------------------------------------------

ATOM = re.compile(r"https?://\S+|\$[^$\n]+\$|`[^`\n]+`|[\w.+-]+@[\w.-]+\.\w+|\d[\d,.]*")


def mask(text: str | None) -> dict:
    """Literals to placeholders in a namespace that the text does not use."""
    text, atoms, n = text or "", [], 0
    while f"{{{{a{n}_" in text:
        n += 1

    def put(m: re.Match) -> str:
        atoms.append(m[0])
        return f"{{{{a{n}_{len(atoms) - 1}}}}}"

    return {"masked": ATOM.sub(put, text), "atoms": atoms, "space": n}


def unmask(masked: str, atoms: list[str], space: int = 0) -> str:
    """Placeholders to literals; one whose last brace went missing still counts."""
    return re.sub(rf"\{{\{{a{space}_(\d+)\}}\}}?", lambda m: atoms[int(m[1])], masked)


def mask_udf():
    @F.pandas_udf("struct<masked string, atoms array<string>, space int>")
    def f(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mask(x) for x in s], columns=["masked", "atoms", "space"])

    return f


# -- similarity ------------------------------------------------------------------------------


def ratio(a: str, b: str) -> float:
    """Matching-block similarity with the query as first argument (it is not symmetric)."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def difference(query: str, text: str) -> str:
    """The ndiff report of two texts as one line each; empty if they are equal."""
    return "\n".join(difflib.ndiff([query], [text])) if query != text else ""


def rank_memory(memory: DataFrame, queries: DataFrame, least: float = 0.35) -> DataFrame:
    """All other items that contain a query (casefolded) or reach ``least``, by ratio, id.

    An empty query selects every item, without a ratio.  Pairs come from a cross
    join and stream through the kernel; neither side is gathered in Python.
    """

    def hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, last = difflib.SequenceMatcher(None, autojunk=False), None
        for f in frames:
            rows = []
            for q, query, i, text in zip(f["query_id"], f["query"], f["item_id"], f["text"], strict=True):
                if not query:
                    rows.append((q, i, None, None))
                    continue
                if text != last:  # the matcher keeps what it knows of its second text
                    matcher.set_seq2(text)
                    last = text
                matcher.set_seq1(query)
                similarity = matcher.ratio()
                if similarity >= least or query.casefold() in text.casefold():
                    rows.append((q, i, similarity, difference(query, text)))
            yield pd.DataFrame(rows, columns=["query_id", "item_id", "similarity", "difference"])

    from pyspark.sql import Window

    parts = int(memory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = memory.filter("text IS NOT NULL").select("item_id", "text").repartition(parts, "item_id")
    pairs = items.crossJoin(queries.select("query_id", F.col("text").alias("query"))).filter("item_id <> query_id")
    found = pairs.select("query_id", "query", "item_id", "text").mapInPandas(hits, "query_id long, item_id long, similarity double, difference string")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "item_id")
    return found.withColumn("rank", F.row_number().over(order))


# -- structured text -------------------------------------------------------------------------


def salvage(raw: str | None) -> dict:
    """The complete items of a JSON array that may be cut off; duplicate keys and NaN end it."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise ValueError("duplicate key")
        return dict(items)

    def no(_):
        raise ValueError("not a number")

    text, items = (raw or "").lstrip(), []
    if not text.startswith("["):
        return {"items": [], "complete": False}
    decoder, at = json.JSONDecoder(object_pairs_hook=pairs, parse_constant=no), 1
    while True:
        m = re.compile(r"\s*,?\s*").match(text, at)
        at = m.end()
        if text[at : at + 1] == "]":
            return {"items": items, "complete": True}
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return {"items": items, "complete": False}
        items.append(json.dumps(value, sort_keys=True))


def salvage_udf():
    @F.pandas_udf("struct<items array<string>, complete boolean>")
    def f(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([salvage(x) for x in s], columns=["items", "complete"])

    return f


class _Blocks(HTMLParser):
    KINDS = {"p": "paragraph", "li": "list_item", "pre": "code", "td": "table_cell", "th": "table_cell", "figcaption": "caption"} | {f"h{i}": "heading" for i in range(1, 7)}
    HIDDEN = ("script", "style", "template")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []
        self.open = self.hidden = None

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden = tag
        elif tag in self.KINDS:
            self.open = [self.KINDS[tag], int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0, ""]
            self.out.append(self.open)

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None
        elif tag in self.KINDS:
            self.open = None

    def handle_data(self, data):
        if self.open is not None and self.hidden is None:
            self.open[2] += data


def html_rows(html: str | None) -> list[tuple[str, int, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return [(k, n, t) for k, n, t in ((k, n, " ".join(t.split())) for k, n, t in parser.out) if t]


def html_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(p, i, *b) for p, h in zip(f["page_id"], f["html"], strict=True) for i, b in enumerate(html_rows(h))]
        yield pd.DataFrame(rows, columns=["page_id", "ord", "kind", "level", "text"])


def markdown(text: str | None) -> list[dict]:
    """Headings, fences, list items and paragraphs of a small CommonMark subset."""
    out, fence, para = [], None, []

    def flush():
        if para:
            out.append({"kind": "paragraph", "level": 0, "text": " ".join(para)})
            para.clear()

    for line in (text or "").split("\n"):
        if fence is not None:
            if line.strip().startswith("```"):
                out.append({"kind": "code", "level": 0, "text": "\n".join(fence)})
                fence = None
            else:
                fence.append(line)
        elif line.strip().startswith("```"):
            flush()
            fence = []
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            flush()
            out.append({"kind": "heading", "level": len(m[1]), "text": m[2].strip()})
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            flush()
            out.append({"kind": "list_item", "level": 0, "text": m[1].strip()})
        elif line.strip():
            para.append(line.strip())
        else:
            flush()
    if fence is not None:
        out.append({"kind": "code", "level": 0, "text": "\n".join(fence)})
    flush()
    return out


def markdown_udf():
    @F.pandas_udf("array<struct<kind string, level int, text string>>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(markdown)

    return f


# the first alternative that matches wins; a currency amount is no formula
INLINE = re.compile(r"(?P<url>https?://[^\s<>]+)|(?P<math>\\\(.+?\\\)|\$(?!\d+(?:\.\d+)?\b(?!\$))[^$\n]+\$)|(?P<citation>\[\d+(?:\s*[,–-]\s*\d+)*\]|\([A-Z]\w+(?: et al\.)?,? \d{4}[a-z]?\))|(?P<quantity>\d[\d,.]*\s?(?:%|km|kg|ms|GB|MB)\b|\d[\d,.]*\s?%)|(?P<scalar>\d[\d,]*(?:\.\d+)?)")


def inline(text: str | None) -> list[dict]:
    return [{"kind": m.lastgroup, "start": m.start(), "text": m[0]} for m in INLINE.finditer(text or "")]


def inline_udf():
    @F.pandas_udf("array<struct<kind string, start int, text string>>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(inline)

    return f


def core(text: str | None) -> str:
    """Letters and digits under NFKC and casefolding, accents stripped."""
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text or "").casefold())
    return "".join(c for c in plain if c.isalnum()).replace("ı", "i")


def core_udf():
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(core)

    return f
