"""Concepts of documents: terms that are defined, abbreviated or repeated.

All three methods are columns over sentences: a definition is a phrase before or
behind a defining verb, an abbreviation stands for the shortest run of words
before it whose initials it has, and repeated phrases are counted pairs and
triples of words.  Candidates of a document are merged by spelling and section,
ranked, and the best are kept; a term that has one sense only counts for the
whole document.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.derived import frame
from ..plans.registry import Tables, query
from ..sources.staging import staged

MOST = 48
# fixed values: words that no term is, and the patterns of defining sentences and abbreviations
STOP = "a an the and or of to in on for with by from as is are be we our this that these those each it its into using use used has have not".split()
DEFINED = r"(?i)\b(?:we\s+(?:define|call)\s+(.{1,100}?)\s+(?:as|the)|(.{1,100}?)\s+(?:is defined as|refers to|denotes|means))\b"
ABBREVIATED = r"([A-Za-z][A-Za-z\s-]{3,120})\s*\(([A-Z][A-Za-z0-9-]{1,12})\)"
SENTENCE, SEGMENT = r"(?<=[.!?。！？])\s*", r"[.!?。！？;:\n]"
UNSAID = ("of", "the", "and")
#: scores of the methods; a repeated phrase has its count, up to the last
DEFINITION, ACRONYM, FREQUENT = 100, 90, 40


def cleaned(term: Column) -> Column:
    """Without marks around it and without an article; null if nothing is left that could be a term."""
    term = F.regexp_replace(F.regexp_replace(term, r'^[ \t\n.,;:"“”]+|[ \t\n.,;:"“”]+$', ""), r"(?i)^(?:the|a|an)\s+", "")
    return F.when((F.length(term) > 0) & (F.length(term) <= 120) & ~F.lower(term).isin(STOP), term)


def expansion(before: Column, acronym: Column) -> Column:
    """The shortest run of two to twelve words at the end of ``before`` whose initials are the acronym; else null."""
    plural = acronym.endswith("s") & F.rlike(F.substring(acronym, F.lit(1), F.length(acronym) - 1), F.lit("^[^a-z]*[A-Z][^a-z]*$"))
    letters = F.lower(F.when(plural, F.substring(acronym, F.lit(1), F.length(acronym) - 1)).otherwise(acronym))
    words = F.regexp_extract_all(before, F.lit("[A-Za-z]+"), 0)
    most = F.least(F.size(words), F.lit(12))

    def initials(width: Column) -> Column:
        said = F.filter(F.slice(words, F.size(words) - width + 1, width), lambda w: ~F.lower(w).isin(*UNSAID))
        return F.lower(F.array_join(F.transform(said, lambda w: F.substring(w, 1, 1)), ""))

    widths = F.when(most >= 2, F.filter(F.sequence(F.lit(2), F.greatest(most, F.lit(2))), lambda w: initials(w) == letters))
    width = F.try_element_at(widths, F.lit(1))
    # that many words up to the end, as they are written
    written = F.concat(F.lit("((?:[A-Za-z]+[^A-Za-z]+){"), (width - 1).cast("string"), F.lit("}[A-Za-z]+)[^A-Za-z]*$"))
    return F.when(width.isNotNull(), F.call_function("regexp_extract", before, written, F.lit(1)))


def _sentences(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("doc", "block", "scope", F.posexplode(F.split("text", SENTENCE)).alias("nth", "sentence"))
    return rows.withColumn("evidence", F.col("block") * 1000 + F.col("nth"))


def _named(blocks: DataFrame) -> DataFrame:
    """Candidates by definition and abbreviation, one row for each time."""
    rows = _sentences(blocks)
    defined = F.coalesce(F.nullif(F.regexp_extract("sentence", DEFINED, 1), F.lit("")), F.regexp_extract("sentence", DEFINED, 2))
    # two definitions can be two senses, so their sentence is part of the key
    first = rows.select("doc", "scope", "evidence", cleaned(defined).alias("source"), F.lit("definition").alias("method"), F.lit(DEFINITION).alias("score"), F.array().cast("array<string>").alias("aliases"), F.col("evidence").alias("sense"))
    pairs = F.explode(F.arrays_zip(*(F.regexp_extract_all("sentence", F.lit(ABBREVIATED), k).alias(n) for k, n in ((1, "before"), (2, "acronym")))))
    second = rows.select("doc", "scope", "evidence", pairs.alias("p")).select("doc", "scope", "evidence", cleaned(expansion(F.col("p.before"), F.col("p.acronym"))).alias("source"), F.lit("acronym").alias("method"), F.lit(ACRONYM).alias("score"), F.array("p.acronym").alias("aliases"), F.lit(None).cast("long").alias("sense"))
    return first.union(second).filter("source IS NOT NULL")


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each spelling, section and sense; lists in order of evidence."""
    entry = F.struct("evidence", "method", "source", "aliases")
    held = rows.groupBy("doc", F.lower("source").alias("key"), "scope", "sense").agg(F.array_sort(F.collect_set(entry)).alias("e"), F.max("score").alias("score"))
    return held.select("doc", "key", "scope", F.col("e")[0]["source"].alias("source"), F.col("e")[0]["method"].alias("method"), "score", F.array_distinct(F.flatten("e.aliases")).alias("aliases"), F.array_distinct("e.evidence").alias("evidence"))


def _repeated(blocks: DataFrame) -> DataFrame:
    """Phrases of two and three words that a document has twice or more."""
    rows = blocks.select("doc", "block", F.posexplode(F.split("text", SEGMENT)).alias("segment", "text"))
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z-]{1,35}|\S"), 0)
    rows = rows.withColumn("words", words).filter(F.size("words") > 1)

    def good(w: Column) -> Column:
        return w.rlike("^[A-Za-z][A-Za-z-]+$") & ~F.lower(w).isin(STOP)

    def phrases(size: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size("words") - 1), lambda i: (i + size - 1 <= F.size("words")) & F.forall(F.slice("words", i, size), good))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i, size), " ").alias("phrase")))

    rows = rows.select("doc", "block", "segment", F.explode(F.concat(phrases(2), phrases(3))).alias("p")).select("doc", "block", "segment", "p.*")
    place = F.struct("block", "segment", "at")
    held = rows.groupBy("doc", F.lower("phrase").alias("key")).agg(F.count("*").alias("n"), F.min_by("phrase", place).alias("source"), F.slice(F.array_sort(F.collect_set("block")), 1, 3).alias("evidence"))
    return held.filter("n >= 2").select("doc", "key", F.lit(None).cast("long").alias("scope"), "source", F.lit("frequency").alias("method"), F.least("n", F.lit(FREQUENT)).cast("int").alias("score"), F.array().cast("array<string>").alias("aliases"), "evidence")


def concepts(blocks: DataFrame, most: int = MOST) -> DataFrame:
    """``(doc, block, scope, text)`` to the ``most`` best concepts of each document.

    Columns: doc, source, scope (null: the whole document), method, score,
    aliases, evidence, occurrences (blocks of its scope that have one of its forms).
    """
    named = staged(_merged(_named(blocks)), "named")  # read four times
    repeated = _repeated(blocks).join(named.select("doc", "key"), ["doc", "key"], "left_anti")
    order = Window.partitionBy("doc").orderBy(F.col("score").desc(), "key", F.coalesce(F.col("scope").cast("string"), F.lit("")), "evidence")
    ranked = staged(named.union(repeated.select(named.columns)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most), "ranked")  # read three times
    # how often a form stands for something, among all that are defined or abbreviated
    form = named.select("doc", "key", F.explode(F.array_distinct(F.concat(F.array("source"), "aliases"))).alias("form"))
    forms = form.groupBy("doc", F.lower("form").alias("form")).agg(F.count("*").alias("n"))
    senses = named.groupBy("doc", "key").agg(F.count("*").alias("senses"))
    own = ranked.select("doc", "rank", F.explode(F.array_distinct(F.concat(F.array("source"), "aliases"))).alias("spelled"))
    shared = own.join(forms.withColumnRenamed("form", "key"), (own["doc"] == forms["doc"]) & (F.lower("spelled") == F.col("key"))).groupBy(own["doc"], "rank").agg(F.max("n").alias("shared"))
    ranked = ranked.join(senses, ["doc", "key"], "left").join(shared, ["doc", "rank"], "left")
    wide = (F.col("method") != "frequency") & (F.col("senses") == 1) & (F.col("shared") == 1)
    ranked = ranked.withColumn("scope", F.when(~wide, F.col("scope")))
    return _occurring(ranked, blocks).select("doc", "source", "scope", "method", "score", "aliases", "evidence", "occurrences")


def _plain(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _occurring(ranked: DataFrame, blocks: DataFrame) -> DataFrame:
    form = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), F.col("form"), F.lit(r"\E(?![A-Za-z0-9])"))
    own = ranked.select("doc", "rank", "scope", F.explode(F.concat(F.array("source"), "aliases")).alias("form")).alias("c")
    there = own.join(blocks.alias("b"), (F.col("c.doc") == F.col("b.doc")) & (F.col("c.scope").isNull() | F.col("c.scope").eqNullSafe(F.col("b.scope"))))
    # a pattern of its own for each pair is dear, so first whether the text has the letters at all (of any case, as the pattern: A to Z)
    there = there.filter(F.contains(_plain(F.col("b.text")), _plain(F.col("form")))).filter(F.rlike(F.col("b.text"), form)).groupBy("c.doc", "rank").agg(F.count_distinct("block").alias("occurrences"))
    return ranked.join(there, ["doc", "rank"], "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))


@query("document_concepts", "TRN-05", "STR-14")
def document_concepts(t: Tables) -> DataFrame:
    """The concepts of documents that describe parts."""
    rows = concepts(frame(t, "papers"))
    return rows.withColumns({"aliases": F.array_join("aliases", ","), "evidence": F.array_join(F.col("evidence").cast("array<string>"), ",")})
