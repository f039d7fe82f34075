"""Catalogue reads: filters, search, snippets, keyset pages, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.registry import query, shared
from ..sources.views import BLOCKS_SQL, blocks

PAGE = 30
LIVE = "NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)"


@query(
    "search_blocks", "FLT-02", "FLT-03", "JOIN-01", "SRT-01", "JOIN-05",
    oracle=f"""WITH {BLOCKS_SQL}
SELECT b.doc_id, b.ord, substr(b.text, 1, 80) AS snippet, concat('/read/', CAST(b.doc_id AS VARCHAR), '#', CAST(b.ord AS VARCHAR)) AS href
FROM blocks b JOIN documents d ON d.doc_id = b.doc_id WHERE contains(b.text, 'tion') AND {LIVE} ORDER BY b.doc_id, b.ord LIMIT {PAGE + 1}""",
)
def search_blocks(t):
    """Case-sensitive literal search in live documents; one more row than a page tells of a next one."""
    dead = t("labels").filter("toxic = 1").select("doc_id").distinct()
    found = blocks(t("documents").select("doc_id", "text").filter(F.col("text").contains("tion"))).filter(F.col("text").contains("tion"))
    rows = found.join(dead, "doc_id", "left_anti")
    return rows.select("doc_id", "ord", F.substring("text", 1, 80).alias("snippet"), F.concat(F.lit("/read/"), "doc_id", F.lit("#"), "ord").alias("href")).orderBy("doc_id", "ord").limit(PAGE + 1)


@query("library_page", "FLT-01", "SRT-01", "SRC-01", oracle=f"SELECT d.doc_id, d.lang, d.source FROM documents d WHERE d.lang = 'en' AND d.source ILIKE 'src1%' AND d.doc_id > 50 AND {LIVE} ORDER BY d.doc_id LIMIT {PAGE + 1}")
def library_page(t):
    dead = t("labels").filter("toxic = 1").select("doc_id").distinct()
    return t("documents").filter((F.col("lang") == "en") & F.col("source").ilike("src1%") & (F.col("doc_id") > 50)).join(dead, "doc_id", "left_anti").select("doc_id", "lang", "source").orderBy("doc_id").limit(PAGE + 1)


shared("escaped_title_search", "FLT-01", "FLT-04", sql="SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a!_%' ESCAPE '!' OR p_size IN (1, 7, 14)")
shared("multi_term_search", "FLT-23", sql="SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(concat(source, ' ', lang)), 'en')")
shared("jobs_composite_page", "FLT-04", "SRT-02", sql="SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view' AND (ts < TIMESTAMP '2024-01-20 00:00:00' OR (ts = TIMESTAMP '2024-01-20 00:00:00' AND event_id < 5000)) ORDER BY ts DESC, event_id DESC LIMIT 51")
shared("log_cursor_page", "SRT-03", "SNK-07", sql="SELECT event_id, event_type, props FROM events WHERE event_id > 200 AND event_type IN ('click', 'purchase', 'error') ORDER BY event_id LIMIT 200")
shared("main_tasks", "FLT-06", sql="SELECT o_orderkey, o_custkey, (o_custkey % 5 = 0 OR o_orderstatus IN ('F', 'P')) AS main FROM orders")
shared(
    "effective_log_level", "FLT-08", "FLT-21",
    sql="SELECT event_id, CASE WHEN event_type IN ('error', 'purchase') THEN 'attention' WHEN value > 50 THEN 'active' WHEN value IS NULL THEN 'unknown' ELSE 'quiet' END AS tone, (value >= 0 AND value <= 100) AS progress_valid FROM events",
)
shared("time_selection", "FLT-15", "STM-16", sql="SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 7 DAY AND ts > TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 9 DAY")
shared("visible_selection", "FLT-22", sql="SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0 OR EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = d.doc_id AND x.toxic = 1)")


@query(
    "operation_of_event", "FLT-05", "FN-13", "FN-13",
    oracle="SELECT event_id, coalesce(json_extract_string(props, '$.operation'), json_extract_string(props, '$.k'), event_type) AS operation FROM events",
)
def operation_of_event(t):
    return t("events").select("event_id", F.coalesce(F.get_json_object("props", "$.operation"), F.get_json_object("props", "$.k"), "event_type").alias("operation"))


@query(
    "safe_details", "FLT-09", "FLT-10", "FN-14",
    oracle="""SELECT event_id, CASE WHEN regexp_full_match(event_type, '[a-z_]{1,32}') THEN event_type END AS code,
CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 0 AND 1e12 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def safe_details(t):
    k = F.get_json_object("props", "$.k")
    return t("events").select("event_id", F.when(F.col("event_type").rlike(r"^[a-z_]{1,32}$"), F.col("event_type")).alias("code"), F.when(k.cast("double").between(0, 1e12), k.cast("long")).alias("k"))


@query(
    "safe_urls", "FLT-11", "FLT-13", "FLT-14", "FLT-18",
    oracle=r"""SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host, regexp_replace(url, '[?#].*$', '') AS endpoint,
(length(url) <= 2048 AND regexp_matches(url, '^(https?://[^/?#@\\]+|mailto:)') AND NOT regexp_matches(url, '[\x00-\x20\\]')) AS safe,
NOT regexp_matches(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '(^|/)(\.{0,2})(/|$)') AS safe_path FROM pages""",
)
def safe_urls(t):
    safe = (F.length("url") <= 2048) & F.col("url").rlike(r"^(https?://[^/?#@\\]+|mailto:)") & ~F.col("url").rlike(r"[\x00-\x20\\]")
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    ok = ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", ".."))
    return t("pages").select("page_id", F.regexp_extract("url", "^(https?)://([^/?#]+)", 1).alias("scheme"), F.regexp_extract("url", "^(https?)://([^/?#]+)", 2).alias("host"), F.regexp_replace("url", "[?#].*$", "").alias("endpoint"), safe.alias("safe"), ok.alias("safe_path"))


@query("duplicate_assets", "JOIN-24", "SNK-01", "SNK-02", "AGG-22", oracle="WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents) SELECT doc_id, sha, count(*) OVER (PARTITION BY sha) AS copies, min(doc_id) OVER (PARTITION BY sha) AS first_id FROM h QUALIFY copies > 1")
def duplicate_assets(t):
    h = t("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    agg = h.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")
    return h.join(agg, "sha").select("doc_id", "sha", "copies", "first_id")


@query(
    "chunk_manifest", "SRC-02", "SRC-03", "SNK-03",
    oracle="""WITH c AS (SELECT doc_id, text, unnest(range(CAST(ceil(greatest(length(text), 1) / 4096.0) AS BIGINT))) AS idx FROM documents),
x AS (SELECT doc_id, idx, idx * 4096 AS start, substr(text, idx * 4096 + 1, 4096) AS data, text FROM c)
SELECT doc_id, count(*) AS chunks, sum(length(data)) AS size, sha256(string_agg(data, '' ORDER BY idx)) = sha256(any_value(text)) AS intact, sha256(string_agg(sha256(data), ',' ORDER BY idx)) AS manifest FROM x GROUP BY doc_id""",
)
def chunk_manifest(t):
    """Documents cut into upload chunks, put together in order and checked."""
    n = F.ceil(F.greatest(F.length("text"), F.lit(1)) / 4096).cast("int")
    c = t("documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    c = c.withColumn("data", F.substr("text", F.col("idx") * 4096 + 1, F.lit(4096)))
    parts = F.array_sort(F.collect_list(F.struct("idx", "data")))
    rows = c.groupBy("doc_id").agg(parts.alias("parts"), F.first(F.sha2(F.col("text").cast("binary"), 256)).alias("whole"))
    data = F.transform("parts", lambda p: p["data"])
    digest = lambda col: F.sha2(col.cast("binary"), 256)
    return rows.select(
        "doc_id", F.size("parts").cast("long").alias("chunks"), F.length(F.array_join(data, "")).cast("long").alias("size"), (digest(F.array_join(data, "")) == F.col("whole")).alias("intact"),
        digest(F.array_join(F.transform(data, lambda d: F.sha2(d.cast("binary"), 256)), ",")).alias("manifest"),
    )


shared("referenced_ids", "SET-04", "JOIN-27", "SNK-09", sql="SELECT doc_id FROM documents UNION SELECT doc_id FROM labels UNION SELECT item_id AS doc_id FROM benchmark")
shared("unreferenced_documents", "JOIN-27", "STM-18", sql="SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
shared("nullable_owner_memory", "JOIN-06", "JOIN-26", sql="SELECT b.item_id, d.doc_id AS owner FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id AND b.item_id % 2 = 0 WHERE d.doc_id IS NULL OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
shared("unique_key_audit", "AGG-23", sql="SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
shared("language_pairs", "STR-39", sql="SELECT DISTINCT a.lang AS source, b.lang AS target FROM (SELECT DISTINCT lang FROM documents) a JOIN (SELECT DISTINCT lang FROM documents) b ON a.lang <> b.lang")
shared("quality_summary", "AGG-06", "AGG-25", sql="SELECT d.lang, count(CASE WHEN l.quality = 0 THEN 1 END) AS errors, count(CASE WHEN l.toxic = 1 THEN 1 END) AS warnings, count(*) AS checked, CASE WHEN count(CASE WHEN l.quality = 0 THEN 1 END) > 0 THEN 'attention' ELSE 'completed' END AS state FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang")
shared("ranked_memory", "SRT-05", "SRT-11", sql="SELECT rank, item_id FROM (SELECT item_id, row_number() OVER (ORDER BY length(text) DESC, item_id) AS rank FROM benchmark) r WHERE rank > 5 AND rank <= 25")


@query("snapshot_conflicts", "SNK-01", "SNK-08", "STM-10", "STM-11", oracle="SELECT user_id, event_type, count(DISTINCT props) AS bodies, count(*) AS requests, count(DISTINCT props) > 1 AS conflict FROM events GROUP BY user_id, event_type")
def snapshot_conflicts(t):
    return t("events").groupBy("user_id", "event_type").agg(F.countDistinct("props").alias("bodies"), F.count("*").alias("requests")).withColumn("conflict", F.col("bodies") > 1)


@query("latest_metadata", "SNK-08", "WIN-10", "VER-19", "SRT-15", oracle="SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_metadata(t):
    newest = Window.partitionBy("user_id", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return t("events").select("user_id", "event_type", "event_id", "ts").withColumn("n", F.row_number().over(newest)).filter("n = 1").select("user_id", "event_type", "event_id")


@query("bijection_failures", "JOIN-23", "SET-03", oracle="SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NULL AS no_document, l.doc_id IS NULL AS no_label FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def bijection_failures(t):
    """Documents without a label and labels without a document, of the whole tables."""
    d = t("documents").select("doc_id", F.lit(True).alias("d"))
    both = d.join(t("labels").select("doc_id").distinct().withColumn("l", F.lit(True)), "doc_id", "full")
    return both.filter("d IS NULL OR l IS NULL").select("doc_id", F.col("d").isNull().alias("no_document"), F.col("l").isNull().alias("no_label"))
