"""What a page's own lines prove: misplaced duplicates, and repairs that keep every word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.derived import frame, oracle
from ..plans.registry import Tables, query
from ..sources.staging import staged
from .spatial import SIDES, mapped, says

# fixed values: least length of a duplicate, least size of its evidence, and the shares that prove and disprove a place
LEAST_TEXT, LEAST_PROOF, PROVEN, DISPROVEN = 80, 40, 0.85, 0.1
GRAPHIC = ("figure", "table", "formula", "code")


def _size(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def misplaced(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """``(page, id, retained)``: duplicates that the page does not bear out where they stand.

    Of paragraphs of one page with equal text exactly one has .85 of the native
    text in its box; another has .1 of it at most, and all that its box holds
    stands in other blocks, too.  Anything less clear stays.
    """
    paragraph = (F.col("kind") == "paragraph") & (F.length(F.trim("text")) >= LEAST_TEXT)
    same = F.when(paragraph, F.xxhash64(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    # both tables once, with a key for each row; pairs are made of boxes and hashes, few of them ask for texts
    key, code = F.monotonically_increasing_id().alias("k"), F.xxhash64("text").alias("code")
    lines = staged(regions.select(key, "page", "id", *SIDES, "text", code, _size(F.col("text")).alias("size")).filter("size > 0"), "lines")
    blocks = staged(blocks.select(key, "page", "id", *SIDES, "text", code, "kind", same.alias("same")), "blocks")
    line, block = ["k", "page", *SIDES, "code", "size"], ["k", "page", "id", *SIDES, "code"]
    long = blocks.filter("same IS NOT NULL").select(*block, "same")
    group = long.join(long.groupBy("page", "same").agg(F.count("*").alias("n")).filter("n > 1"), ["page", "same"], "left_semi")
    equal = (F.col("a.code") == F.col("b.code")).alias("said")
    pairs = staged(mapped(lines.select(*line), group).select(F.col("a.k").alias("line"), F.col("b.k").alias("block"), "b.page", "b.id", "b.same", "a.size", equal), "pairs")
    told = pairs.filter("said").unionByName(_compared(pairs.filter("NOT said"), lines, blocks)).groupBy("page", "id", "same")
    held = told.agg(F.sum("size").alias("whole"), (F.sum(F.when(F.col("said"), F.col("size")).otherwise(0)) / F.sum("size")).alias("support")).filter(F.col("whole") >= LEAST_PROOF)
    held = staged(held, "held")  # read twice
    proven = held.filter(F.col("support") >= PROVEN).groupBy("page", "same").agg(F.count("*").alias("n"), F.min("id").alias("retained")).filter("n = 1").drop("n")
    wrong = held.filter(F.col("support") <= DISPROVEN).join(proven, ["page", "same"]).select("page", "id", "retained")
    # every line in the box has to stand in a third block; only these lines look for one
    there = staged(pairs.join(wrong, ["page", "id"]).select("page", "id", "retained", "line"), "there")
    asked = lines.select(*line).join(there.select(F.col("line").alias("k")).distinct(), "k", "left_semi")
    said = F.coalesce(equal, F.lit(False)) | F.coalesce(F.col("b.kind").isin(*GRAPHIC), F.lit(False))
    fits = mapped(asked, blocks.select(*block, "kind")).select(F.col("a.k").alias("line"), F.col("b.k").alias("block"), F.col("b.id").alias("other"), said.alias("said"))
    fits = staged(there.join(fits, "line").filter((F.col("other") != F.col("id")) & (F.col("other") != F.col("retained"))), "fits")
    one = ["page", "id", "retained", "line"]
    sure = fits.filter("said").select(*one).distinct()
    unsure = fits.filter("NOT said").join(sure, one, "left_anti")
    stands = sure.union(_compared(unsure, lines, blocks).filter("said").select(*one).distinct()).withColumn("stands", F.lit(True))
    third = there.distinct().join(stands, one, "left")
    return third.groupBy("page", "id", "retained").agg(F.min(F.coalesce("stands", F.lit(False))).alias("all_stand")).filter("all_stand").drop("all_stand")


def _compared(pairs: DataFrame, lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """``pairs`` of rows of both tables, and whether the text of one stands in that of the other."""
    texts = (rows.select(F.col("k").alias(side), F.col("text").alias(f"{side}_text")) for rows, side in ((lines, "line"), (blocks, "block")))
    for rows in texts:
        pairs = pairs.join(rows, rows.columns[0])
    said = F.coalesce(says(F.col("block_text"), F.col("line_text")), F.lit(False))
    return pairs.withColumn("said", said).drop("line_text", "block_text")


def repair(original: Column, native: Column) -> Column:
    """How a native text may replace a recognised one: ``insertion``, ``word``, or null.

    An insertion keeps every token in order.  One word of twelve or more may be
    another if both have seven letters or more, begin with the same six, and share
    .7 of the longer one or differ by one letter more or less.  Texts have no limit of length.
    """
    old, new = (F.filter(F.split(c, r"\s+"), lambda t: t != "") for c in (original, native))
    plain = ~F.concat(original, native).rlike(r"[$\\^_=<>]")

    def related(p: Column) -> Column:
        a, b = p["o"], p["n"]
        # the letters that both begin with, by halves, so that words of any length take no square of their letters
        step = lambda k, bit: k + F.when((k + bit <= F.least(F.length(a), F.length(b))) & (F.substring(a, F.lit(1), k + bit) == F.substring(b, F.lit(1), k + bit)), bit).otherwise(0)
        shared = F.aggregate(F.array(*(F.lit(1 << n) for n in range(29, -1, -1))), F.lit(0), step)
        long, short = (F.when((F.length(a) > F.length(b)) == more, a).otherwise(b) for more in (True, False))
        one_letter = lambda k: (F.length(long) == F.length(short) + 1) & (F.substring(long, k + 2, F.length(long)) == F.substring(short, k + 1, F.length(long)))
        fits = F.transform(F.array(shared), lambda k: (k >= 6) & ((k >= 0.7 * F.greatest(F.length(a), F.length(b))) | one_letter(k)))
        return a.rlike("^[A-Za-z]{7,}$") & b.rlike("^[A-Za-z]{7,}$") & F.get(fits, F.lit(0))

    def how(s: Column) -> Column:
        old, new = s["old"], s["new"]
        kept = F.aggregate(new, F.lit(0), lambda n, t: n + F.when(F.get(old, n) == t, 1).otherwise(0))
        insertion = (F.size(old) > 0) & (F.size(new) > F.size(old)) & (kept == F.size(old))
        pairs = F.filter(F.arrays_zip(old.alias("o"), new.alias("n")), lambda p: p["o"] != p["n"])
        found = F.transform(F.when((F.size(old) >= 12) & (F.size(old) == F.size(new)), F.array(pairs)), lambda p: (F.size(p) == 1) & F.forall(p, related))
        return F.when(insertion, "insertion").when(F.coalesce(F.get(found, F.lit(0)), F.lit(False)) & plain, "word")

    # the words of both are taken apart once; equal texts need no repair
    return F.when(original != native, F.get(F.transform(F.array(F.struct(old.alias("old"), new.alias("new"))), how), F.lit(0)))


@query(
    "misplaced_duplicates", "JOIN-25",
    oracle=oracle("""WITH z AS (SELECT *, regexp_replace(trim(text), '\\s+', ' ', 'g') AS same FROM {copied} WHERE kind = 'paragraph' AND length(trim(text)) >= 80), g AS (SELECT * FROM z WHERE (page, same) IN (SELECT (page, same) FROM z GROUP BY page, same HAVING count(*) > 1)),
m AS (SELECT b.page, b.id, r.id AS line, length(regexp_replace(r.text, '[^\\pL\\pN]', '', 'g')) AS size, b.kind IN ('figure', 'table', 'formula', 'code') AS graphic, contains(regexp_replace(coalesce(b.text, ''), '\\s+', '', 'g'), regexp_replace(r.text, '\\s+', '', 'g')) AS said
FROM {copied} b JOIN {regions} r ON r.page = b.page AND r.x0 <= r.x1 AND b.x0 <= b.x1 AND b.y0 <= b.y1 AND (r.x1 - r.x0) * (r.y1 - r.y0) > 0 AND greatest(0.0, least(r.x1, b.x1) - greatest(r.x0, b.x0)) * greatest(0.0, least(r.y1, b.y1) - greatest(r.y0, b.y0)) / ((r.x1 - r.x0) * (r.y1 - r.y0)) >= 0.6
WHERE regexp_matches(r.text, '[\\pL\\pN]')),
h AS (SELECT g.page, g.id, g.same, sum(CASE WHEN m.said THEN m.size ELSE 0 END) / sum(m.size) AS support FROM g JOIN m ON m.page = g.page AND m.id = g.id GROUP BY g.page, g.id, g.same HAVING sum(m.size) >= 40),
p AS (SELECT page, same, min(id) AS retained FROM h WHERE support >= 0.85 GROUP BY page, same HAVING count(*) = 1), w AS (SELECT h.page, h.id, p.retained FROM h JOIN p ON p.page = h.page AND p.same = h.same WHERE h.support <= 0.1)
SELECT w.page, w.id, w.retained FROM w WHERE NOT EXISTS (SELECT 1 FROM m l WHERE l.page = w.page AND l.id = w.id AND NOT EXISTS (SELECT 1 FROM m o WHERE o.page = l.page AND o.line = l.line AND o.id <> w.id AND o.id <> w.retained AND (o.said OR o.graphic)))"""),
)
def misplaced_duplicates(t: Tables) -> DataFrame:
    """Paragraphs told twice, once in a place whose lines say something else."""
    # places are halves at the finest, as exact as doubles
    regions = frame(t, "regions").withColumns({c: F.col(c).cast("double") for c in SIDES})
    return misplaced(frame(t, "copied", regions=regions), regions)


@query("text_repairs", "STR-33")
def text_repairs(t: Tables) -> DataFrame:
    """Recognised lines and what their native text may do for them."""
    return frame(t, "repairs").select("id", repair(F.col("original"), F.col("native")).alias("repair"))
