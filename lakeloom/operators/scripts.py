"""Words in a script that neither the target's language nor the source accounts for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.derived import frame, oracle
from ..plans.registry import Tables, query

# fixed values: how the names of a script's characters begin
NAMED = {"Hangul": ("HANGUL ",), "Kana": ("HIRAGANA ", "KATAKANA ", "KATAKANA-HIRAGANA ", "HALFWIDTH KATAKANA ")}
# fixed values: languages and explicit script codes in which a script is expected
LANGUAGES = {"Hangul": ("ko",), "Kana": ("ja",)}
CODES = {"Hangul": ("Hang", "Kore"), "Kana": ("Hira", "Kana", "Jpan")}


def _class(names: tuple[str, ...]) -> str:
    """A pattern for runs of characters whose names begin so."""
    found = [c for c in range(0x10000) if unicodedata.name(chr(c), "").startswith(names)]
    starts = [c for c, b in zip(found, [-2, *found], strict=False) if c != b + 1]
    ends = [c for c, b in zip(found, [*found[1:], -2], strict=True) if c + 1 != b]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]+"


RUNS = {script: _class(names) for script, names in NAMED.items()}
#: characters that are written in parts: only texts with these are composed, in Python
PARTS = r"[\x{1100}-\x{11ff}\x{3099}\x{309a}\x{a960}-\x{a97f}\x{d7b0}-\x{d7ff}]"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(texts: DataFrame, column: str) -> DataFrame:
    """The column under NFC; what has no part to compose stays in the JVM."""
    rest = texts.filter(~F.coalesce(F.rlike(F.col(column), F.lit(PARTS)), F.lit(False)))
    return rest.union(texts.filter(F.rlike(F.col(column), F.lit(PARTS))).withColumn(column, _nfc(column)).select(rest.columns))


def words(texts: DataFrame, column: str = "text") -> DataFrame:
    """``(id, script, word)``: every run of a script in ``(id, text)``."""
    runs = F.map_from_arrays(F.array(*map(F.lit, RUNS)), F.array(*(F.regexp_extract_all(column, F.lit(p), 0) for p in RUNS.values())))
    return composed(texts.select("id", column), column).select("id", F.explode(runs).alias("script", "found")).select("id", "script", F.explode("found").alias("word"))


def expected(locale: Column) -> Column:
    """Scripts that a locale may use: those of its script code, or else of its language."""
    subtags = F.split(locale, "-")
    before = F.slice(subtags, F.lit(2), F.greatest(F.size(subtags) - 1, F.lit(0)))
    # what follows a single letter is an extension
    stop = F.array_position(F.transform(before, lambda p: (F.length(p) == 1).cast("int")), 1)
    own = F.filter(F.when(stop > 0, F.slice(before, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(before), lambda p: p.rlike("^[A-Za-z]{4}$"))
    code = F.initcap(F.try_element_at(own, F.lit(1)))
    named = [F.when(code.isin(*CODES[s]) | (code.isNull() & subtags[0].isin(*LANGUAGES[s])), F.lit(s)) for s in RUNS]
    return F.array_compact(F.array(*named))


def unexpected_scripts(units: DataFrame, literals: DataFrame) -> DataFrame:
    """``(id, source, target, locale)`` and allowed ``(id, literal)`` to ``(id, script, word, times)``."""
    known = words(units, "source").union(words(literals, "literal")).distinct()
    found = words(units, "target").groupBy("id", "script", "word").agg(F.count("*").alias("times"))
    found = found.join(units.select("id", expected(F.col("locale")).alias("allowed")), "id").filter(~F.array_contains("allowed", F.col("script"))).drop("allowed")
    return found.join(known, ["id", "script", "word"], "left_anti")


@query(
    "unexpected_scripts", "AGG-13", "STR-16",
    oracle=oracle("""WITH w AS (SELECT id, 'Hangul' AS script, unnest(regexp_extract_all(target, '[가-힣]+')) AS word, locale, source FROM {units} UNION ALL SELECT id, 'Kana' AS script, unnest(regexp_extract_all(target, '[ァ-ヺー]+')) AS word, locale, source FROM {units}),
k AS (SELECT id, unnest(regexp_extract_all(source, '[가-힣]+|[ァ-ヺー]+')) AS word FROM {units} UNION ALL SELECT id, unnest(regexp_extract_all(literal, '[가-힣]+|[ァ-ヺー]+')) AS word FROM {unit_literals})
SELECT w.id, script, w.word, count(*) AS times FROM w WHERE NOT (script = 'Hangul' AND locale IN ('ko', 'zh-Hang')) AND NOT (script = 'Kana' AND locale IN ('ja')) AND NOT EXISTS (SELECT 1 FROM k WHERE k.id = w.id AND k.word = w.word) GROUP BY w.id, script, w.word"""),
)
def scripts_of_units(t: Tables) -> DataFrame:
    """Kana and Hangul that crept into translations."""
    return unexpected_scripts(frame(t, "units"), frame(t, "unit_literals"))
