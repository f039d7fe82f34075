"""Versions, context and diffs over conversations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.registry import query, shared


def _sha(*parts):
    return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)


@query("current_segments", "WIN-01", "VER-02", "VER-03", oracle="SELECT conv_id, role, turn AS version, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def current_segments(t):
    newest = Window.partitionBy("conv_id", "role").orderBy(F.col("turn").desc())
    return t("conversations").withColumn("n", F.row_number().over(newest)).filter("n = 1").select("conv_id", "role", F.col("turn").alias("version"), "text")


@query(
    "turn_context", "WIN-03", "WIN-04", "FN-06", "FN-07",
    oracle="""SELECT conv_id, turn, right(coalesce(lag(text) OVER w, ''), 500) AS before, left(coalesce(lead(text) OVER w, ''), 500) AS after,
sha256(coalesce(sha256(lag(text) OVER w), '') || '|' || sha256(text) || '|' || coalesce(sha256(lead(text) OVER w), '')) AS context_hash FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def turn_context(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    before, after = F.lag("text").over(w), F.lead("text").over(w)
    digest = sha(F.concat(F.coalesce(sha(before), F.lit("")), F.lit("|"), sha(F.col("text")), F.lit("|"), F.coalesce(sha(after), F.lit(""))))
    return t("conversations").select("conv_id", "turn", F.expr("right(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), 500)").alias("before"), F.substring(F.coalesce(after, F.lit("")), 1, 500).alias("after"), digest.alias("context_hash"))


@query("section_scope", "WIN-05", "WIN-07", oracle="SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS scope FROM conversations")
def section_scope(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t("conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("scope"))


@query("segment_conflicts", "VER-03", "VER-08", "VER-15", "VER-20", oracle="WITH m AS (SELECT conv_id, role, max(turn) AS newest FROM conversations GROUP BY conv_id, role) SELECT c.conv_id, c.turn, c.role, c.turn <> m.newest AS conflict, coalesce(l.quality = 1, false) AS locked FROM conversations c JOIN m ON m.conv_id = c.conv_id AND m.role = c.role LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = c.conv_id")
def segment_conflicts(t):
    c = t("conversations")
    newest = c.groupBy("conv_id", "role").agg(F.max("turn").alias("newest"))
    reviews = t("labels").groupBy(F.col("doc_id").alias("conv_id")).agg(F.max("quality").alias("quality"))
    rows = c.join(newest, ["conv_id", "role"]).join(reviews, "conv_id", "left")
    return rows.select("conv_id", "turn", "role", (F.col("turn") != F.col("newest")).alias("conflict"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("locked"))


@query(
    "review_status", "WIN-02", "VER-05", "VER-06", "VER-07", "VER-16", "VER-24",
    oracle="""WITH s AS (SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1),
r AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT s.conv_id, s.role, s.turn, sha256(s.role || '|' || CAST(s.turn AS VARCHAR) || '|' || s.text) AS fingerprint,
CASE WHEN r.toxic = 1 THEN 'not_reviewed' WHEN r.quality = 1 THEN 'human_reviewed' WHEN r.quality = 0 THEN 'machine_checked' ELSE 'not_reviewed' END AS status FROM s LEFT JOIN r ON r.doc_id = s.conv_id""",
)
def review_status(t):
    newest = Window.partitionBy("conv_id", "role").orderBy(F.col("turn").desc())
    s = t("conversations").withColumn("n", F.row_number().over(newest)).filter("n = 1")
    r = t("labels").groupBy(F.col("doc_id").alias("conv_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    status = F.when(F.col("toxic") == 1, "not_reviewed").when(F.col("quality") == 1, "human_reviewed").when(F.col("quality") == 0, "machine_checked").otherwise("not_reviewed")
    print_ = F.sha2(F.concat("role", F.lit("|"), F.col("turn").cast("string"), F.lit("|"), "text").cast("binary"), 256)
    return s.join(r, "conv_id", "left").select("conv_id", "role", "turn", print_.alias("fingerprint"), status.alias("status"))


@query(
    "revision_diff", "JOIN-18", "JOIN-19", "VER-01", "JOIN-28",
    oracle="""WITH a AS (SELECT doc_id, sha256(text) AS sha, source FROM documents), b AS (SELECT doc_id, sha256(regexp_replace(text, '[0-9]', '', 'g')) AS sha, source FROM documents),
au AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY sha) = 1), bu AS (SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY sha) = 1)
SELECT coalesce(au.doc_id, -1) AS before_id, coalesce(bu.doc_id, -1) AS after_id,
CASE WHEN au.doc_id IS NULL THEN 'added' WHEN bu.doc_id IS NULL THEN 'removed' WHEN au.doc_id = bu.doc_id THEN 'exact' ELSE 'moved' END AS kind, au.source IS DISTINCT FROM bu.source AS context_changed FROM au FULL JOIN bu ON au.sha = bu.sha""",
)
def revision_diff(t):
    """All texts and their revision without digits, matched by content that is unique on either side."""
    sha = lambda x: t("documents").select("doc_id", F.sha2(x.cast("binary"), 256).alias("sha"), "source")
    once = lambda d: d.withColumn("c", F.count("*").over(Window.partitionBy("sha"))).filter("c = 1").drop("c")
    a, b = once(sha(F.col("text"))).alias("a"), once(sha(F.regexp_replace("text", "[0-9]", ""))).alias("b")
    kind = F.when(F.col("a.doc_id").isNull(), "added").when(F.col("b.doc_id").isNull(), "removed").when(F.col("a.doc_id") == F.col("b.doc_id"), "exact").otherwise("moved")
    rows = a.join(b, F.col("a.sha") == F.col("b.sha"), "full")
    return rows.select(F.coalesce("a.doc_id", F.lit(-1)).alias("before_id"), F.coalesce("b.doc_id", F.lit(-1)).alias("after_id"), kind.alias("kind"), (~F.col("a.source").eqNullSafe(F.col("b.source"))).alias("context_changed"))


shared("document_history", "VER-12", sql="SELECT doc_id AS id, 'source' AS kind, 0 AS at FROM documents UNION ALL SELECT item_id AS id, 'memory' AS kind, 1 AS at FROM benchmark UNION ALL SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'review' ELSE 'issue' END AS kind, 2 AS at FROM labels")
shared("tombstone_cascade", "STM-18", "SET-04", "VER-18", sql="SELECT d.lang, count(*) AS documents, count(CASE WHEN l.doc_id IS NOT NULL THEN 1 END) AS tombstoned, CAST(sum(CASE WHEN l.doc_id IS NULL THEN d.n_chars ELSE 0 END) AS BIGINT) AS kept_chars FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id GROUP BY d.lang")
shared("priority_truncation", "SRT-07", "SRT-06", sql="SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) AS n FROM conversations) x WHERE n <= 3")
shared("set_differences", "SET-02", "SET-06", sql="SELECT source, lang FROM documents EXCEPT SELECT source, lang FROM documents WHERE n_chars > 4000")


@query("issue_resolution", "VER-14", oracle="SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def issue_resolution(t):
    """Quotes and the documents that hold them.

    A document that holds a quote holds its second to fourth words in a row, so the
    two meet on these; quotes of fewer than five words have no such three and are
    looked for one by one.
    """
    quotes, docs = t("benchmark").select("item_id", F.col("text").alias("quote")), t("documents").select("doc_id", "text")
    words = F.split("quote", " ")
    key = lambda x, i: F.xxhash64(F.element_at(x, i), F.element_at(x, i + 1), F.element_at(x, i + 2))
    keyed = quotes.filter(F.size(words) >= 5).withColumn("key", key(words, F.lit(2)))
    keys = docs.withColumn("w", F.split("text", " ")).filter("size(w) >= 3").select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: key(F.col("w"), i)))).alias("key"))
    met = keys.join(keyed.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    found = met.join(docs, "doc_id").join(quotes, "item_id").filter(F.contains("text", "quote")).select("item_id", "doc_id")
    short = quotes.filter(F.size(words) < 5)
    return found.union(short.join(docs, F.contains("text", "quote")).select("item_id", "doc_id"))
