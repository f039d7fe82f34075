"""Citations resolved in a document's own bibliography.

A label such as ``[3, 5–7]`` or ``(Smith & Jones, 2020; 2021)`` is taken apart,
ranges are written out, and every part is joined to the numbered or the
author-year index.  A label counts only if each of its parts has exactly one
entry; one with two or none leaves the whole label open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.derived import frame, oracle
from ..plans.registry import Tables, query

# fixed values: years, printed numbers of entries, citations, and what separates authors
YEAR = r"\b(?:19|20)\d{2}[a-z]?\b"
NUMBER = r"^\s*(?:\[(\d+[a-z]?)\]|(\d+[a-z]?)[.)])\s*"
NUMBERED = r"\[\s*\d+[a-z]?(?:\s*[,;–—-]\s*\d+[a-z]?)*\s*\]"
DATED = r"\([^()\[\]]*?\b(?:19|20)\d{2}[a-z]?(?:\s*;[^()\[\]]*)?\)"
RANGE = r"^(\d{1,9})\s*[-–—]\s*(\d{1,9})$"
AUTHORS = r",\s*(?:and\s+|&\s*)?|\s+(?:and|&)\s+"
#: entries that a document's labels meet as one array; those of larger documents are joined part by part
WHOLE = 64
INITIALS, NAME = r"^(?:[A-Z]\.?(?:\s+|$))+$", r"^\p{Lu}[\p{L}'’-]*$"
# fixed values: typographic forms of brackets, separators and digits that say the same
_FORMS = ("［【］】，、；–—−０１２３４５６７８９", "[[]],,;---0123456789")


def signature(label: Column) -> Column:
    """A numeric citation without its typography (null for anything else): digits, order, lists and ranges count."""
    plain = F.translate(label, *_FORMS)
    paired = F.array_contains(F.array(*map(F.lit, ("[]", "［］", "【】"))), F.concat(F.substring(label, 1, 1), F.right(label, F.lit(1))))
    return F.when(paired & plain.rlike(r"^\[\s*\d+[a-z]?(?:\s*[,;-]\s*\d+[a-z]?)*\s*\]$"), F.regexp_replace(F.regexp_replace(plain, r"[\[\]]", ""), r"\s+", ""))


def surnames(prefix: Column) -> Column:
    """Lower-case surnames of a complete author list; null for anything that could be a title."""
    fields = F.transform(F.split(F.regexp_replace(prefix, r"\s+et al\.?$", ""), AUTHORS), lambda f: F.trim(f))
    given = F.filter(fields, lambda _, i: i % 2 == 1)
    # surname and initials in turns, or full names
    paired = (F.size(fields) % 2 == 0) & F.forall(given, lambda f: f.rlike(INITIALS))
    names = F.when(paired, F.filter(fields, lambda _, i: i % 2 == 0)).otherwise(fields)

    def known(field: Column) -> Column:
        words = F.split(field, r"\s+")
        last = F.element_at(words, -1)
        fine = F.forall(words, lambda w: w.isin("de", "van", "von") | w.rlike(r"^[A-Z]\.$") | w.rlike(NAME))
        return fine & (F.size(words) <= 5) & (F.length(last) > 1) & ~last.endswith(".")

    return F.when(F.forall(names, known), F.transform(names, lambda f: F.lower(F.element_at(F.split(f, r"\s+"), -1))))


def index(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc, id, text)`` to the numbered index ``(doc, part, n, id)`` and the dated one ``(doc, name, year, id, names)``."""
    number = F.coalesce(F.nullif(F.regexp_extract("text", NUMBER, 1), F.lit("")), F.nullif(F.regexp_extract("text", NUMBER, 2), F.lit("")))
    rows = entries.select("doc", "id", number.alias("part"), F.regexp_replace("text", NUMBER, "").alias("rest"))
    numbered = rows.filter("part IS NOT NULL").groupBy("doc", "part").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    # what a generator gives is made once, filters and later columns do not repeat its expressions
    dated = rows.select("doc", "id", "rest", F.explode(F.array(F.array_distinct(F.regexp_extract_all("rest", F.lit(YEAR), 0)))).alias("years"))
    dated = dated.filter(F.size("years") == 1).select("doc", "id", "rest", F.get("years", F.lit(0)).alias("year"))
    before = F.regexp_replace(F.expr("substring_index(rest, year, 1)"), r"^[ .(]+|[ .(]+$", "")
    after = F.expr("ltrim(substring(rest, locate(year, rest) + length(year)))")
    dated = dated.filter((after == "") | F.substring(after, 1, 1).isin(*".,;:)")).select("doc", "id", "year", F.explode(F.array(before)).alias("before"))
    dated = dated.select("doc", "id", "year", F.explode(F.array(surnames(F.col("before")))).alias("names"))
    dated = dated.filter(F.size("names") > 0).select("doc", F.get("names", F.lit(0)).alias("name"), "year", "id", "names")
    return numbered, dated


def _labels(mentions: DataFrame, pattern: str) -> DataFrame:
    return mentions.select("doc", F.col("id").alias("mention"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("nth", "label"))


def _verdict(parts: DataFrame) -> DataFrame:
    """Parts ``(doc, mention, nth, label, at, found, id)``, found being how many entries a part has (null: no part)."""
    rows = parts.groupBy("doc", "mention", "nth", "label").agg(F.min("found").alias("least"), F.max("found").alias("most"), F.count_if(F.col("found").isNull()).alias("odd"), F.array_sort(F.collect_set(F.struct("at", "id"))).alias("t"))
    state = F.when(F.col("odd") > 0, "invalid").when(F.col("least") == 0, "dangling").when(F.col("most") > 1, "ambiguous").otherwise("resolved")
    targets = F.when(state == "resolved", F.array_distinct("t.id")).otherwise(F.array().cast("array<bigint>"))
    return rows.select("doc", "mention", "nth", "label", state.alias("state"), targets.alias("targets"))


def _settled(rows: DataFrame, found: Column) -> DataFrame:
    """``_verdict`` where a label has all its parts: an array of ``(n, id)``, null for no part."""
    rows = rows.select("doc", "mention", "nth", "label", F.explode(F.array(found)).alias("found"))
    state = F.when(F.exists("found", lambda f: f.isNull()), "invalid").when(F.exists("found", lambda f: f["n"] == 0), "dangling").when(F.exists("found", lambda f: f["n"] > 1), "ambiguous").otherwise("resolved")
    targets = F.when(state == "resolved", F.array_distinct(F.transform("found", lambda f: f["id"]))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("doc", "mention", "nth", "label", state.alias("state"), targets.alias("targets"))


def _by_size(labels: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels with ``size``, how many keys their document has: those with all of them in ``held`` (null: none), those of larger documents."""
    # a structure is never null: both parts read one shuffle of the labels
    labels = labels.withColumn("of", F.struct("doc")).repartition("of").distinct()
    rest = [c for c in keys.columns if c != "doc"]
    sized = keys.filter("doc IS NOT NULL").select(F.struct("doc").alias("of"), *rest).withColumn("size", F.count("*").over(Window.partitionBy("of")))
    sized = sized.groupBy("of").agg(F.max("size").alias("size"), F.collect_list(F.when(F.col("size") <= WHOLE, F.struct(*rest))).alias("held"))
    few = labels.join(sized, "of", "left").filter(F.col("size").isNull() | (F.col("size") <= WHOLE)).withColumn("size", F.coalesce("size", F.lit(0)))
    return few, labels.join(sized.filter(F.col("size") > WHOLE).drop("held"), "of")


def numbered_citations(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """``(doc, mention, nth, label, state, targets)`` of every numeric citation."""
    numbered, _ = index(entries)
    few, many = _by_size(_labels(mentions, NUMBERED), numbered)

    def read(part: Column) -> Column:
        low, high = (F.nullif(F.regexp_extract(part, RANGE, k), F.lit("")).cast("long").alias(name) for k, name in ((1, "low"), (2, "high")))
        return F.struct(part.alias("part"), low, high)

    def written(p: Column) -> Column:
        low, high = p["low"], p["high"]
        sound = (low <= high) & (high - low < F.col("size"))
        numbers = F.transform(F.sequence(low, F.greatest(low, F.least(high, low + F.col("size")))), lambda n: n.cast("string"))
        return F.when(p["part"].rlike(r"^\d+[a-z]?$"), F.array(p["part"])).when(sound, numbers).otherwise(F.array(F.lit(None).cast("string")))

    pieces = F.split(F.expr("substring(label, 2, length(label) - 2)"), "[,;]")
    parts = F.flatten(F.transform(F.transform(pieces, lambda p: read(F.trim(p))), written))
    few = few.withColumn("known", F.map_from_entries(F.transform("held", lambda h: F.struct(h["part"], h))))

    def entry(part: Column) -> Column:
        hit = F.try_element_at("known", part)
        return F.when(part.isNotNull(), F.struct(F.coalesce(hit["n"], F.lit(0)).alias("n"), hit["id"].alias("id")))

    found = many.select("doc", "mention", "nth", "label", F.posexplode(parts).alias("at", "part")).join(numbered, ["doc", "part"], "left")
    found = found.select("doc", "mention", "nth", "label", "at", F.when(F.col("part").isNotNull(), F.coalesce("n", F.lit(0))).alias("found"), "id")
    return _settled(few, F.transform(parts, entry)).union(_verdict(found))


def dated_citations(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """The same of every author-year citation; a part without names has those before it."""
    _, dated = index(entries)
    few, many = _by_size(_labels(mentions, DATED), dated)
    parts = F.split(F.regexp_replace("label", r"^[()]+|[()]+$", ""), ";")
    pieces = F.transform(parts, lambda p: F.struct(F.regexp_extract_all(p, F.lit(YEAR), 0).alias("years"), F.regexp_replace(F.regexp_replace(p, rf"(?s){YEAR}.*$", ""), r"^[ ,(]+|[ ,(]+$", "").alias("names")))

    def key(p: Column) -> Column:
        names = F.split(F.lower(F.regexp_replace(p["names"], r"\s+et al\.$", "")), r"\s*(?:&|\band\b)\s*")
        return F.when((F.size(p["years"]) == 1) & p["names"].isNotNull(), F.struct(names.alias("others"), F.get(p["years"], F.lit(0)).alias("year")))

    def taken(rows: DataFrame) -> DataFrame:
        carried = F.transform("pieces", lambda p, i: F.struct(p["years"].alias("years"), F.try_element_at(F.filter(F.slice("pieces", F.lit(1), i + 1), lambda q: q["names"] != ""), F.lit(-1))["names"].alias("names")))
        rows = rows.select("*", F.explode(F.array(pieces)).alias("pieces"))
        return rows.select(*(c for c in rows.columns if c != "pieces"), F.explode(F.array(F.transform(carried, key))).alias("keys"))

    def fits(others: Column, names: Column) -> Column:
        return F.forall(F.slice(others, F.lit(2), F.greatest(F.size(others), F.lit(1))), lambda n: F.array_contains(names, n))

    def entry(k: Column) -> Column:
        hits = F.filter("held", lambda h: (h["name"] == F.get(k["others"], F.lit(0))) & (h["year"] == k["year"]) & fits(k["others"], h["names"]))
        found = F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("id")), lambda a, h: F.struct((a["n"] + 1).alias("n"), F.least(a["id"], h["id"]).alias("id")))
        return F.when(k.isNotNull(), F.coalesce(found, F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("id"))))

    rows = taken(many).select("doc", "mention", "nth", "label", F.posexplode("keys").alias("at", "k"))
    rows = rows.select("doc", "mention", "nth", "label", "at", F.col("k").isNotNull().alias("sound"), "k.others", "k.year", F.get("k.others", F.lit(0)).alias("name"))
    found = rows.join(dated, ["doc", "name", "year"], "left")
    fit = F.col("id").isNotNull() & fits(F.col("others"), F.col("names"))
    found = found.groupBy("doc", "mention", "nth", "label", "at", "sound").agg(F.count_if(fit).alias("n"), F.min(F.when(fit, F.col("id"))).alias("id"))
    found = found.select("doc", "mention", "nth", "label", "at", F.when(F.col("sound"), F.col("n")).alias("found"), "id")
    return _settled(taken(few), F.transform("keys", entry)).union(_verdict(found))


# -- queries ----------------------------------------------------------------------------------

_NUMBERED_ORACLE = rf"""WITH e AS (SELECT doc, id, coalesce(nullif(regexp_extract(text, '^\s*\[(\d+[a-z]?)\]', 1), ''), nullif(regexp_extract(text, '^\s*(\d+[a-z]?)[.)]', 1), '')) AS part FROM {{entries}}),
x AS (SELECT doc, part, count(*) AS n, min(id) AS id FROM e WHERE part IS NOT NULL GROUP BY doc, part), z AS (SELECT doc, count(*) AS size FROM x GROUP BY doc),
l AS (SELECT doc, id AS mention, unnest(range(len(found))) AS nth, unnest(found) AS label FROM (SELECT doc, id, regexp_extract_all(text, '\[\s*\d+[a-z]?(?:\s*[,;–—-]\s*\d+[a-z]?)*\s*\]') AS found FROM {{mentions}}) m),
p AS (SELECT l.doc, mention, nth, label, coalesce(size, 0) AS size, place, trim(part) AS part FROM (SELECT doc, mention, nth, label, unnest(range(len(parts))) AS place, unnest(parts) AS part FROM (SELECT *, regexp_split_to_array(substring(label, 2, length(label) - 2), '[,;]') AS parts FROM l) s) l LEFT JOIN z ON z.doc = l.doc),
b AS (SELECT *, TRY_CAST(nullif(regexp_extract(part, '^(\d{{1,9}})\s*[-–—]\s*(\d{{1,9}})$', 1), '') AS BIGINT) AS low, TRY_CAST(nullif(regexp_extract(part, '^(\d{{1,9}})\s*[-–—]\s*(\d{{1,9}})$', 2), '') AS BIGINT) AS high FROM p),
w AS (SELECT doc, mention, nth, label, place, CAST(unnest(range(low, high + 1)) AS VARCHAR) AS part, low AS base FROM b WHERE low <= high AND high - low < size
UNION ALL SELECT doc, mention, nth, label, place, CASE WHEN low IS NULL AND regexp_matches(part, '^\d+[a-z]?$') THEN part END AS part, 0 AS base FROM b WHERE low IS NULL OR low > high OR high - low >= size),
r AS (SELECT w.*, CASE WHEN w.part IS NOT NULL THEN coalesce(x.n, 0) END AS found, x.id FROM w LEFT JOIN x ON x.doc = w.doc AND x.part = w.part),
g AS (SELECT doc, mention, nth, label, min(found) AS least, max(found) AS most, count(*) - count(found) AS odd FROM r GROUP BY doc, mention, nth, label),
v AS (SELECT *, CASE WHEN odd > 0 THEN 'invalid' WHEN least = 0 THEN 'dangling' WHEN most > 1 THEN 'ambiguous' ELSE 'resolved' END AS state FROM g),
d AS (SELECT doc, mention, nth, id, min(place * 1000000 + TRY_CAST(part AS BIGINT) - base) AS at FROM r GROUP BY doc, mention, nth, id)
SELECT v.doc, v.mention, CAST(v.nth AS INTEGER) AS nth, v.label, v.state, CASE WHEN v.state = 'resolved' THEN (SELECT string_agg(d.id, ',' ORDER BY d.at) FROM d WHERE d.doc = v.doc AND d.mention = v.mention AND d.nth = v.nth) ELSE '' END AS targets FROM v"""


def _listed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), ","))


@query("numbered_citations", "JOIN-20", oracle=oracle(_NUMBERED_ORACLE))
def numbered(t: Tables) -> DataFrame:
    """Numeric citations of customers' papers, ranges written out."""
    return _listed(numbered_citations(frame(t, "mentions"), frame(t, "entries")))


@query("dated_citations", "JOIN-20")
def dated(t: Tables) -> DataFrame:
    """Author-year citations of the same papers."""
    return _listed(dated_citations(frame(t, "mentions"), frame(t, "entries")))


@query(
    "citation_signatures", "STR-36",
    oracle=oracle(r"""SELECT doc, mention, label, regexp_replace(translate(substring(label, 2, length(label) - 2), '–—', '--'), '\s+', '', 'g') AS signature
FROM (SELECT doc, id AS mention, unnest(regexp_extract_all(text, '\[\s*\d+[a-z]?(?:\s*[,;–—-]\s*\d+[a-z]?)*\s*\]')) AS label FROM {mentions}) l"""),
)
def citation_signatures(t: Tables) -> DataFrame:
    """Numeric citations without their typography."""
    return _labels(frame(t, "mentions"), NUMBERED).select("doc", "mention", "label", signature(F.col("label")).alias("signature"))
