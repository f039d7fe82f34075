"""Operators on page layouts, tables, job families, glossaries and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.derived import derived

SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def footnotes(notes: DataFrame, marked: DataFrame) -> DataFrame:
    """``(page, note, marker, mark)``: a page's one note of a number and the one line that ends with it in superscript.

    A mark stands at a line's end and a number at its beginning, so lines are looked at there only;
    a pattern would be tried at every character.
    """
    number = F.regexp_extract(F.substring(F.ltrim("text"), 1, 4), "^([0-9][0-9]?[0-9]?)[. ]", 1)
    noted = notes.select("page", "id", number.alias("digits"))
    before = F.rtrim("text", F.lit(SUPERSCRIPTS))
    ended = marked.filter(F.substring("text", -1, 1).isin(*SUPERSCRIPTS)).select("page", "id", "text", before.alias("before"))
    digits = F.translate(F.expr("substring(text, length(before) + 1)"), SUPERSCRIPTS, "0123456789")
    ended = ended.filter("before <> ''").select("page", "id", digits.alias("digits"))

    def only(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.filter("digits <> ''").select("page", "id", F.col("digits").try_cast("long").alias("mark")).filter("mark IS NOT NULL")
        return rows.groupBy("page", "mark").agg(F.min("id").alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")

    return only(noted, "note").join(only(ended, "marker"), ["page", "mark"]).select("page", "note", "marker", "mark")


derived(
    "reading_order", "SRT-10", "LAY-13",
    sql="""SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY band, col, y0, x0, id) AS pos FROM (SELECT page, id, x0, y0, col, sum(CASE WHEN col = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, col, id ROWS UNBOUNDED PRECEDING) AS band
FROM (SELECT page, id, x0, y0, CASE WHEN x1 - x0 > 360 THEN 0 WHEN x0 < 300 THEN 1 ELSE 2 END AS col FROM {regions}) c) o""",
)
derived(
    "paragraph_islands", "WIN-13", "WIN-14",
    sql="""SELECT page, id, sum(fresh) OVER (PARTITION BY page, col ORDER BY y0, x0, id ROWS UNBOUNDED PRECEDING) AS paragraph, col FROM (SELECT page, id, x0, y0, col,
CASE WHEN y0 - lag(y1) OVER (PARTITION BY page, col ORDER BY y0, x0, id) <= 0.45 * (y1 - y0) AND abs(x0 - lag(x0) OVER (PARTITION BY page, col ORDER BY y0, x0, id)) <= 0.5 * (y1 - y0) THEN 0 ELSE 1 END AS fresh FROM (SELECT page, id, x0, y0, y1, CASE WHEN x1 - x0 > 360 THEN 0 WHEN x0 < 300 THEN 1 ELSE 2 END AS col FROM {regions}) c) o""",
)
#: a list's numbers follow each other in one style at one indent; what has no number ends a list
derived(
    "numbered_runs", "WIN-15",
    sql="""SELECT page, min(id) AS first, count(*) AS items, min(n) AS lowest, max(n) AS highest FROM (SELECT page, id, n, sum(fresh) OVER (PARTITION BY page ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN n = lag(n) OVER w + 1 AND style = lag(style) OVER w AND abs(x0 - lag(x0) OVER w) <= 2 THEN 0 ELSE 1 END AS fresh
FROM (SELECT page, id, x0, TRY_CAST(nullif(regexp_extract(text, '^ *([0-9][0-9]?[0-9]?)[.)] ', 1), '') AS BIGINT) AS n, nullif(regexp_extract(text, '^ *[0-9][0-9]?[0-9]?([.)]) ', 1), '') AS style FROM {items}) i WINDOW w AS (PARTITION BY page ORDER BY id)) r) s WHERE n IS NOT NULL GROUP BY page, run HAVING count(*) >= 2""",
)
derived(
    "heading_stack", "WIN-06", "WIN-05",
    sql="""SELECT page, id, level, CASE level WHEN 2 THEN one WHEN 3 THEN greatest(one, two) END AS parent FROM (SELECT page, id, level, max(CASE WHEN level = 1 THEN id END) OVER w AS one, max(CASE WHEN level = 2 THEN id END) OVER w AS two
FROM {layout} WHERE kind = 'heading' WINDOW w AS (PARTITION BY page ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) h""",
)
derived("page_title", "AGG-16", sql="SELECT r.page, min(r.id) AS id, max(m.height) AS height FROM {regions} r JOIN (SELECT page, median(y1 - y0) AS height FROM {regions} GROUP BY page) m ON m.page = r.page WHERE r.y1 - r.y0 >= 1.2 * m.height AND r.y0 < 400 GROUP BY r.page")
derived("coordinate_flip", "FN-02", sql="SELECT page, id, x0, 800.0 - y1 AS top, x1, 800.0 - y0 AS bottom, (x0 >= 0 AND x0 <= x1 AND x1 <= 600 AND y0 <= y1 AND y1 <= 800) AS valid, 1000.0 * x0 / 600.0 AS unit_x0 FROM {layout}")
derived("page_furniture", "FLT-16", sql="SELECT page, id FROM {regions} WHERE (y0 < 40 OR y1 > 760) AND length(text) <= 4 AND TRY_CAST(text AS BIGINT) IS NOT NULL")
derived("row_group_gaps", "FN-04", sql="SELECT table_id, r0, before FROM (SELECT table_id, r0, lag(ends) OVER (PARTITION BY table_id ORDER BY r0) AS before FROM (SELECT table_id, r0, max(r0 + rs) AS ends FROM {cells} GROUP BY table_id, r0) g) h WHERE before <> r0")
#: a note belongs to the one superscript mark of its page that has its number, if no other note of the page does
derived(
    "footnote_index", "JOIN-21",
    sql="""SELECT n.page, n.id AS note, m.id AS marker, n.mark FROM (SELECT page, min(id) AS id, mark FROM (SELECT page, id, TRY_CAST(nullif(regexp_extract(text, '^ *([0-9][0-9]?[0-9]?)[. ]', 1), '') AS BIGINT) AS mark FROM {notes}) a WHERE mark IS NOT NULL GROUP BY page, mark HAVING count(*) = 1) n
JOIN (SELECT page, min(id) AS id, mark FROM (SELECT page, id, TRY_CAST(translate(nullif(regexp_extract(text, '[^⁰¹²³⁴⁵⁶⁷⁸⁹]([⁰¹²³⁴⁵⁶⁷⁸⁹]+)$', 1), ''), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789') AS BIGINT) AS mark FROM {marked}) b WHERE mark IS NOT NULL GROUP BY page, mark HAVING count(*) = 1) m ON m.page = n.page AND m.mark = n.mark""",
    build=footnotes,
)
derived(
    "glossary_override", "JOIN-16", "SET-05",
    sql="SELECT DISTINCT lower(term) AS term, target, scope FROM {glossary} g WHERE scope = 'doc' OR NOT EXISTS (SELECT 1 FROM {glossary} d WHERE d.scope = 'doc' AND lower(d.term) = lower(g.term))",
)
derived("glossary_conflicts", "SET-07", "STR-10", "AGG-14", sql="SELECT scope, lower(term) AS term, count(DISTINCT CASE WHEN mode <> 'forbidden' THEN target END) AS targets, count(DISTINCT CASE WHEN mode = 'forbidden' THEN target END) AS forbidden FROM {glossary} GROUP BY scope, lower(term) HAVING count(DISTINCT CASE WHEN mode <> 'forbidden' THEN target END) > 1")
derived("glossary_lines", "FN-23", sql="SELECT scope, term, target, CASE mode WHEN 'must' THEN concat(term, ' => ', target) WHEN 'preferred' THEN concat(term, ' ~> ', target) ELSE concat(term, ' !> ', target) END AS line FROM {glossary}")
derived("backoff_table", "FN-11", sql="SELECT l_orderkey, l_linenumber, greatest(CAST(l_quantity AS BIGINT), least(CAST(power(2, l_linenumber) AS BIGINT), 30)) AS wait FROM {lineitem}")
derived("concurrency_limits", "FN-12", sql="SELECT id, greatest(1, least(16, CAST(floor((ram - used) / 2048.0) AS BIGINT))) AS masters, greatest(0, least(16, CAST(floor((ram - used) / 256.0) AS BIGINT))) AS children FROM {capacity} WHERE ram IS NOT NULL")
derived("admission_reasons", "STM-08", "AGG-21", sql="SELECT id, CASE WHEN masters >= 2 THEN 'MASTER_LIMIT' WHEN children >= 1 THEN 'SUBJOB_LIMIT' WHEN ram IS NULL THEN 'TELEMETRY' WHEN used + need > ram THEN 'RAM' ELSE 'ADMIT' END AS reason FROM {capacity}")
derived("resident_memory", "AGG-21", sql="SELECT masters, children, sum(used) AS used, max(need) AS resident_once, sum(used) + max(need) AS total FROM {capacity} GROUP BY masters, children")
derived("price_validation", "VAL-07", "FN-21", "VAL-08", sql="SELECT id, inp IS NULL AS incomplete, coalesce(inp >= 0 AND outp >= 0 AND cached <= inp, false) AS valid, CASE WHEN inp IS NULL THEN 'price.input' WHEN outp < 0 THEN 'price.output' WHEN cached > inp THEN 'price.cached' END AS field FROM {prices}")
derived("context_mode", "TRN-10", sql="SELECT b.page, b.id, CASE WHEN m.family = 'plain' THEN 'none' WHEN b.kind IN ('caption', 'heading') THEN 'short' ELSE 'full' END AS context FROM {layout} b JOIN {models} m ON m.page = b.page")
