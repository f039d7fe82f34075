"""Constraint queries: what breaks an invariant, one row per violation; and issue reports over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.derived import derived, frame, oracle
from ..plans.registry import query

derived(
    "source_violations", "VAL-01",
    sql="""WITH l AS (SELECT * FROM {tree})
SELECT page, id, 'bbox_outside_page' AS rule FROM l WHERE x0 < 0 OR x1 > 600 OR y0 < 0 OR y1 > 800 OR x0 > x1 OR y0 > y1
UNION ALL SELECT l.page, l.id, 'parent_not_heading' AS rule FROM l JOIN l p ON p.page = l.page AND p.id = l.parent WHERE p.kind <> 'heading'
UNION ALL SELECT l.page, l.id, 'parent_missing' AS rule FROM l LEFT JOIN l p ON p.page = l.page AND p.id = l.parent WHERE l.parent IS NOT NULL AND p.id IS NULL
UNION ALL SELECT page, id, 'duplicate_id' AS rule FROM l GROUP BY page, id HAVING count(*) > 1
UNION ALL SELECT l.page, l.id, 'caption_without_owner' AS rule FROM l LEFT JOIN l f ON f.page = l.page AND f.id = l.owner AND f.kind IN ('figure', 'table') WHERE l.kind = 'caption' AND f.id IS NULL
UNION ALL SELECT page, id, 'text_too_long' AS rule FROM l WHERE length(text) > 10000
UNION ALL SELECT page, min(id) AS id, 'no_title' AS rule FROM l GROUP BY page HAVING count(CASE WHEN kind = 'heading' THEN 1 END) = 0""",
)
derived(
    "translation_violations", "VAL-02",
    sql="""WITH b AS (SELECT doc_id, CAST(ord AS BIGINT) AS id, text FROM {blocks} WHERE text <> '')
SELECT b.doc_id, b.id, 'missing_result' AS rule FROM b LEFT JOIN {results} r ON r.doc_id = b.doc_id AND r.id = b.id WHERE r.id IS NULL
UNION ALL SELECT b.doc_id, b.id, CASE WHEN r.source_hash <> md5(b.text) THEN 'stale_hash' WHEN r.target = '' THEN 'empty_target' ELSE 'retained_changed' END AS rule
FROM b JOIN {results} r ON r.doc_id = b.doc_id AND r.id = b.id WHERE r.source_hash <> md5(b.text) OR r.target = '' OR (r.status = 'retained' AND r.target <> b.text)""",
)
derived(
    "retained_blocks", "VAL-03",
    sql="""SELECT page, id, CASE WHEN kind = 'figure' THEN 'original_figure' WHEN TRY_CAST(text AS DOUBLE) IS NOT NULL THEN 'numeric_cell' WHEN text LIKE 'http%' AND text NOT LIKE '% %' THEN 'identifier' WHEN references_ THEN 'original_reference' END AS reason
FROM (SELECT b.*, coalesce(h.section = 'references', false) AS references_ FROM (SELECT page, id, kind, text, max(CASE WHEN kind = 'heading' THEN id END) OVER (PARTITION BY page ORDER BY id ROWS UNBOUNDED PRECEDING) AS head FROM {tree}) b LEFT JOIN {tree} h ON h.page = b.page AND h.id = b.head) s WHERE kind = 'figure' OR TRY_CAST(text AS DOUBLE) IS NOT NULL OR (text LIKE 'http%' AND text NOT LIKE '% %') OR references_""",
)
derived(
    "output_violations", "VAL-04",
    sql="""WITH u AS (SELECT page AS doc_id, id FROM {layout} WHERE kind = 'paragraph')
SELECT u.doc_id, u.id, 'unit_missing' AS rule FROM u LEFT JOIN {results} r ON r.doc_id = u.doc_id AND r.id = u.id WHERE r.id IS NULL
UNION ALL SELECT r.doc_id, r.id, 'unit_unexpected' AS rule FROM {results} r LEFT JOIN u ON u.doc_id = r.doc_id AND u.id = r.id WHERE u.id IS NULL
UNION ALL SELECT r.doc_id, r.id, 'empty_target' AS rule FROM {results} r JOIN u ON u.doc_id = r.doc_id AND u.id = r.id WHERE trim(r.target) = ''
UNION ALL SELECT doc_id, id, 'unit_repeated' AS rule FROM {results} GROUP BY doc_id, id HAVING count(*) > 1""",
)
derived(
    "ungrounded_proposals", "VAL-05",
    sql="""WITH p AS (SELECT doc_id, id, split_part(target, ' ', 1) AS term, id + CASE WHEN id % 6 = 5 THEN 1 ELSE 0 END AS cited FROM {results} WHERE target <> '')
SELECT p.doc_id, p.id, 'quote_unknown' AS rule FROM p LEFT JOIN {layout} e ON e.page = p.doc_id AND e.id = p.cited WHERE e.id IS NULL
UNION ALL SELECT p.doc_id, p.id, 'term_not_in_quote' AS rule FROM p JOIN {layout} e ON e.page = p.doc_id AND e.id = p.cited WHERE NOT contains(e.text, p.term)
UNION ALL SELECT doc_id, min(id) AS id, 'proposed_twice' AS rule FROM p GROUP BY doc_id, term HAVING count(*) > 1""",
)
derived(
    "foreign_references", "VAL-06", "AGG-09",
    sql="SELECT s.item_id AS doc_id, n.number, count(*) AS times FROM {benchmark} s JOIN {numbers_of} n ON n.doc_id = s.item_id WHERE NOT contains(s.text, n.number) GROUP BY s.item_id, n.number",
)

QUALITY = """WITH b AS (SELECT doc_id, CAST(ord AS BIGINT) AS id, text FROM {blocks} WHERE text <> ''),
found AS (SELECT b.doc_id, b.id, 'MISSING_TRANSLATION' AS code, 'error' AS severity FROM b LEFT JOIN {results} r ON r.doc_id = b.doc_id AND r.id = b.id WHERE r.id IS NULL
UNION ALL SELECT r.doc_id, r.id, 'EMPTY_TARGET' AS code, 'error' AS severity FROM {results} r WHERE r.target = '' AND r.status = 'translated'
UNION ALL SELECT b.doc_id, b.id, 'SOURCE_CHANGED' AS code, 'error' AS severity FROM b JOIN {results} r ON r.doc_id = b.doc_id AND r.id = b.id WHERE r.source_hash <> md5(b.text)
UNION ALL SELECT b.doc_id, b.id, 'UNTRANSLATED' AS code, 'warning' AS severity FROM b JOIN {results} r ON r.doc_id = b.doc_id AND r.id = b.id WHERE r.status = 'translated' AND r.target = b.text
UNION ALL SELECT b.doc_id, b.id, 'LENGTH_RATIO' AS code, 'warning' AS severity FROM b JOIN {results} r ON r.doc_id = b.doc_id AND r.id = b.id WHERE r.target <> '' AND (length(r.target) > 3 * length(b.text) OR 3 * length(r.target) < length(b.text))
UNION ALL SELECT b.doc_id, b.id, 'REPEATED_BLOCK' AS code, 'info' AS severity FROM b JOIN (SELECT doc_id, text FROM b WHERE length(text) >= 20 GROUP BY doc_id, text HAVING count(*) >= 8) d ON d.doc_id = b.doc_id AND d.text = b.text)
"""
derived(
    "quality_run", "VER-04",
    sql=QUALITY + "SELECT f.doc_id, f.id, f.code, f.severity, md5(concat(CAST(f.doc_id AS STRING), '|', CAST(f.id AS STRING), '|', f.code)) AS fingerprint, l.doc_id IS NOT NULL AS resolved FROM found f LEFT JOIN (SELECT DISTINCT doc_id FROM {labels} WHERE quality = 1) l ON l.doc_id = f.doc_id",
)
derived(
    "issue_groups", "AGG-07",
    sql="""WITH raw AS (SELECT r.page, r.id, r.x0, r.y0, r.x1, r.y1, CASE WHEN p.page IS NULL THEN 'page_missing' WHEN d.page IS NOT NULL THEN 'duplicate' ELSE 'coverage' END AS category FROM {regions} r LEFT JOIN (SELECT page, text FROM {regions} GROUP BY page, text HAVING count(*) > 1) d ON d.page = r.page AND d.text = r.text LEFT JOIN (SELECT DISTINCT page FROM {layout} WHERE id > 0) p ON p.page = r.page
WHERE p.page IS NULL OR NOT EXISTS (SELECT 1 FROM {layout} b WHERE b.page = r.page AND b.id = r.id AND b.text = r.text)),
cut AS (SELECT *, CASE WHEN category = 'page_missing' THEN 0 WHEN y0 <= max(y1) OVER w + 12 AND greatest(0.0, least(x1, lag(x1) OVER v) - greatest(x0, lag(x0) OVER v)) >= 0.6 * greatest(1.0, least(x1 - x0, lag(x1 - x0) OVER v)) THEN 0 ELSE 1 END AS fresh FROM raw
WINDOW w AS (PARTITION BY page, category ORDER BY y0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY page, category ORDER BY y0, id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY page, category ORDER BY y0, id ROWS UNBOUNDED PRECEDING) AS part FROM cut)
SELECT page, category, part, CASE WHEN category = 'duplicate' THEN 'general' ELSE 'important' END AS severity, count(*) AS diagnostics, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(id) AS first_id FROM g GROUP BY page, category, part""",
)
derived(
    "term_checks", "STR-18",
    sql="""SELECT r.doc_id, r.id, t.term, t.mode FROM {results} r JOIN (VALUES ('the', 'required'), ('License', 'forbidden'), ('und', 'preferred')) AS t(term, mode) ON (t.mode = 'forbidden' AND contains(r.target, t.term)) OR (t.mode <> 'forbidden' AND contains(lower(r.target), t.term) AND NOT contains(r.target, t.term))""",
)
derived("code_like_documents", "STR-42", sql="SELECT doc_id, count(*) AS lines, count(CASE WHEN text LIKE '%;' OR text LIKE '    %' OR text LIKE '%):' OR text LIKE '% | %' THEN 1 END) AS code FROM {blocks} WHERE text <> '' GROUP BY doc_id HAVING count(*) >= 2 AND 10 * count(CASE WHEN text LIKE '%;' OR text LIKE '    %' OR text LIKE '%):' OR text LIKE '% | %' THEN 1 END) >= 6 * count(*)")
derived("safe_failures", "FLT-19", sql="SELECT doc_id, CAST(ord AS BIGINT) AS id, CASE WHEN contains(lower(text), 'password') OR contains(lower(text), 'secret') OR contains(lower(text), 'api_key') OR contains(text, 'sk-') OR contains(text, '@') THEN 'redacted' ELSE text END AS message FROM {blocks} WHERE text <> ''")
derived("first_occurrences", "AGG-24", "FN-15", sql="SELECT doc_id, text, min(ord) AS first, count(*) AS times FROM {blocks} WHERE text <> '' GROUP BY doc_id, text")
derived("model_filter", "FLT-12", sql="SELECT p_partkey, p_brand FROM {part} WHERE contains(lower(concat(p_name, ' ', p_type)), 'steel') OR p_brand IN (SELECT p_brand FROM {part} WHERE p_size = 50)")
derived("conditional_uploads", "JOIN-02", sql="SELECT e.event_id, o.o_orderkey AS document, u.doc_id AS upload FROM {events} e LEFT JOIN {orders} o ON o.o_orderkey = e.user_id LEFT JOIN {documents} u ON e.event_type = 'click' AND u.doc_id = TRY_CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT)")
derived("runtime_state", "JOIN-29", sql="SELECT n.n_nationkey AS id, CASE WHEN q.id IS NOT NULL THEN 'queued' ELSE coalesce(s.state, 'unavailable') END AS state FROM {nation} n LEFT JOIN (SELECT s_nationkey AS id, CASE WHEN max(s_acctbal) > 9000 THEN 'ready' ELSE 'idle' END AS state FROM {supplier} GROUP BY s_nationkey) s ON s.id = n.n_nationkey LEFT JOIN (SELECT DISTINCT c_nationkey AS id FROM {customer} WHERE c_acctbal < -990) q ON q.id = n.n_nationkey")
derived("lease_expiry", "FN-10", sql="SELECT job, event_id, lapsed FROM (SELECT user_id AS job, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts + INTERVAL 60 SECOND AS lapsed FROM {events}) x WHERE lapsed IS NOT NULL")
derived("stage_receipts", "STM-21", "STM-24", sql="SELECT user_id AS job, event_type AS stage, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS receipt, event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS started_by, CASE WHEN value < 0 THEN 'failed' ELSE 'succeeded' END AS status FROM {events}")
derived(
    "publication_dates", "FN-09",
    sql="""SELECT id, CASE WHEN m IS NULL THEN 'year' WHEN m NOT BETWEEN 1 AND 12 THEN NULL WHEN d IS NULL THEN 'month' WHEN d NOT BETWEEN 1 AND CASE WHEN m = 2 THEN CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 29 ELSE 28 END WHEN m IN (4, 6, 9, 11) THEN 30 ELSE 31 END THEN NULL ELSE 'day' END AS precision_
FROM (SELECT o_orderkey AS id, 1990 + o_orderkey % 30 AS y, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 14 END AS m, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 33 END AS d FROM {orders}) p""",
)
derived(
    "canonical_locales", "STR-38", "FN-22",
    sql="""SELECT doc_id, raw, CASE WHEN lower(split_part(raw, '-', 1)) IN ('und', 'auto', 'mul', 'zxx') OR length(split_part(raw, '-', 1)) NOT IN (2, 3) THEN NULL ELSE concat(lower(split_part(raw, '-', 1)),
CASE length(split_part(raw, '-', 2)) WHEN 4 THEN concat('-', upper(substr(split_part(raw, '-', 2), 1, 1)), lower(substr(split_part(raw, '-', 2), 2, 3))) WHEN 2 THEN concat('-', upper(split_part(raw, '-', 2))) ELSE '' END, CASE WHEN split_part(raw, '-', 3) <> '' THEN concat('-', upper(split_part(raw, '-', 3))) ELSE '' END) END AS locale
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(upper(lang), '-us') WHEN 1 THEN concat(lang, '-HANS-cn') WHEN 2 THEN 'und' WHEN 3 THEN 'x-private' ELSE lang END AS raw FROM {documents}) r""",
)
derived("reviewed_memory", "VER-13", sql="SELECT d.doc_id, md5(d.text) AS hash, length(d.text) AS size FROM {documents} d JOIN (SELECT doc_id FROM {labels} GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0) l ON l.doc_id = d.doc_id WHERE d.text <> ''")
derived("preparation_lookup", "VER-23", sql="SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'draft' END, CASE WHEN b.item_id IS NOT NULL THEN 'candidate' END, CASE WHEN r.doc_id IS NOT NULL THEN 'segment' END, 'unavailable') AS pack FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {labels} GROUP BY doc_id) l ON l.doc_id = d.doc_id LEFT JOIN {benchmark} b ON b.item_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM {results} WHERE status = 'retained') r ON r.doc_id = d.doc_id")
derived("review_selection", "TRN-11", sql="SELECT DISTINCT u.page AS doc_id, u.id FROM {layout} u JOIN {results} r ON r.doc_id = u.page AND r.id = u.id WHERE u.kind = 'paragraph' AND r.status = 'translated' AND r.target <> ''")
derived("index_refresh", "SNK-06", "VER-05", sql="SELECT b.doc_id, CAST(b.ord AS BIGINT) AS id, CASE WHEN d.lang = 'en' THEN 'same_language' ELSE 'translated' END AS reason, b.text AS source, CASE WHEN d.lang = 'en' THEN b.text ELSE r.target END AS target FROM {blocks} b JOIN {documents} d ON d.doc_id = b.doc_id LEFT JOIN {results} r ON r.doc_id = b.doc_id AND r.id = b.ord WHERE b.text <> ''")

UNIT = 1000


def units(documents):
    """Whole texts as units of ``UNIT`` characters: ordinal, count and text of each."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(UNIT))).cast("int")
    rows = documents.filter("text IS NOT NULL").select("doc_id", "text", n.alias("units")).withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("units").cast("long").alias("units"), F.substr("text", F.col("ordinal") * UNIT + 1, F.lit(UNIT)).alias("unit"))


UNITS_SQL = f"SELECT doc_id, CAST(o AS BIGINT) AS ordinal, units, substr(text, CAST(o * {UNIT} + 1 AS BIGINT), {UNIT}) AS unit FROM (SELECT doc_id, text, units, unnest(range(units)) AS o FROM (SELECT doc_id, text, CAST(greatest(1, ceil(length(text) / {UNIT}.0)) AS BIGINT) AS units FROM documents) d) u"


@query("unit_chunks", "TRN-01", "WIN-08", "SRT-04", oracle=UNITS_SQL)
def unit_chunks(t):
    return units(t("documents"))


@query("unit_reassembly", "TRN-02", oracle="SELECT doc_id, length(text) AS size, md5(text) AS digest, true AS complete FROM documents")
def unit_reassembly(t):
    """Units put together again in order; a missing one makes the document incomplete."""
    parts = units(t("documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "unit"))).alias("p"), F.max("units").alias("units"))
    text = F.array_join(F.transform("p", lambda x: x["unit"]), "")
    return parts.select("doc_id", F.length(text).alias("size"), F.md5(text.cast("binary")).alias("digest"), (F.size("p") == F.col("units")).alias("complete"))


def apply_edits(text, edits):
    """``text`` with disjoint edits (start, end, replacement; from 0) applied from the last to the first."""
    last_first = F.reverse(F.array_sort(edits))
    return F.aggregate(last_first, text, lambda s, e: F.concat(F.substr(s, F.lit(1), e["start"]), e["replacement"], F.substr(s, e["end"] + 1)))


@query(
    "edited_blocks", "FN-08", "STR-40", "VER-09",
    oracle=oracle("SELECT doc_id, CAST(ord AS BIGINT) AS id, concat(substr(text, 1, 2), '<', substr(text, 5, 3), '[', ord, ']', substr(text, 10)) AS text FROM {blocks} WHERE length(text) >= 12"),
)
def edited_blocks(t):
    rows = frame(t, "blocks").filter("length(text) >= 12")
    edit = lambda a, b, r: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), r.alias("replacement"))
    edits = F.array(edit(7, 9, F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("]"))), edit(2, 4, F.lit("<")))
    return rows.select("doc_id", F.col("ord").cast("long").alias("id"), apply_edits(F.col("text"), edits).alias("text"))
