"""Identifiers of publications, and the newest revision of each scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.derived import derived, frame, oracle
from ..plans.registry import Tables, query

# fixed values: what a DOI looks like, what is written before it, and the closing brackets with their openers
DOI = r'^10\.\d{4,9}/[^\s<>"“”]+$'
BEFORE = r"(?i)^(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)"
PAIRS = ((")", "("), ("]", "["), ("}", "{"))


def _times(text: Column, c: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))


def normalized_doi(value: Column) -> Column:
    """A DOI in lower case, without what is written around it; null for anything else.

    Percent signs are decoded, white space and soft hyphens go, marks at the end go,
    and so does a closing bracket there as long as more close than open.
    """
    decoded = F.try_url_decode(F.replace(F.trim(value), F.lit("+"), F.lit("%2B")))
    text = F.replace(F.coalesce(decoded, F.trim(value)), F.lit("­"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, BEFORE, ""), r"\s+", ""), r"[.,;:]+$", "")
    closers = F.length(F.regexp_extract(text, r"([)\]}]*)$", 1))

    def shorter(kept: Column, _: Column) -> Column:
        extra = F.lit(False)
        for close, opener in PAIRS:
            extra |= kept.endswith(close) & (_times(kept, close) > _times(kept, opener))
        return F.when(extra, F.substring(kept, F.lit(1), F.length(kept) - 1)).otherwise(kept)

    text = F.when(closers > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(closers, F.lit(1))), text, shorter)).otherwise(text)
    return F.when((F.length(value) <= 2048) & text.rlike(DOI), F.lower(text))


@query(
    "normalized_dois", "STR-30",
    oracle=oracle("""SELECT id, CASE kind WHEN 0 THEN concat('10.1234/ab/c', n) WHEN 1 THEN concat('10.1234/x(', n, ')') WHEN 4 THEN concat('10.1234/z-', n) END AS doi FROM {cited}"""),
)
def normalized_dois(t: Tables) -> DataFrame:
    """Identifiers as papers print them."""
    return frame(t, "cited").select("id", normalized_doi(F.col("written")).alias("doi"))


derived(
    "effective_revisions", "JOIN-17",
    sql="""SELECT d.doc, d.lang, g.id AS global_revision, o.id AS own_revision FROM (SELECT DISTINCT doc, lang FROM {revisions} WHERE doc IS NOT NULL) d
LEFT JOIN (SELECT lang, id FROM (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY created DESC, id DESC) AS nth FROM {revisions} WHERE doc IS NULL) x WHERE nth = 1) g ON g.lang = d.lang
LEFT JOIN (SELECT doc, lang, id FROM (SELECT doc, lang, id, row_number() OVER (PARTITION BY doc, lang ORDER BY created DESC, id DESC) AS nth FROM {revisions} WHERE doc IS NOT NULL) y WHERE nth = 1) o ON o.doc = d.doc AND o.lang = d.lang""",
)
