"""Text operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.registry import query
from ..sources.views import BLOCKS_SQL, blocks

# fixed values: words of negation, condition and degree
RISK = "not|never|unless|only|without|less|greater|must|cannot|except"
RISK_ZH = "不|仅|除非|只有|未"
# fixed values: words that no phrase holds
STOP = "a an the and or of to in on for with by from as is are be we our this that these those each it its into using use used has have not".split()
MOST_TERMS = 48


@query("comparison_text", "STR-01", "STR-02", "STR-03", oracle=r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(173), ''), '(\p{L})-\n(\p{L})', '\1\2', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS sha FROM documents")
def comparison_text(t):
    return t("documents").select("doc_id", F.sha2(X.comparison("text").cast("binary"), 256).alias("sha"))


@query("number_tokens", "STR-05", "AGG-08", oracle="WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM documents) SELECT doc_id, number, count(*) AS n FROM x GROUP BY doc_id, number")
def number_tokens(t):
    return t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("number")).groupBy("doc_id", "number").agg(F.count("*").alias("n"))


@query(
    "number_multiset_diff", "AGG-08", "SET-02", "AGG-09",
    oracle="""WITH x AS (SELECT doc_id // 2 AS pair, unnest(regexp_extract_all(text, '[0-9]+')) AS number, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS src FROM documents)
SELECT pair, number, CAST(sum(src) AS BIGINT) AS source, CAST(sum(1 - src) AS BIGINT) AS target FROM x GROUP BY pair, number HAVING sum(src) <> sum(1 - src)""",
)
def number_multiset_diff(t):
    x = t("documents").select(F.expr("doc_id div 2").alias("pair"), F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("number"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("src"))
    return x.groupBy("pair", "number").agg(F.sum("src").alias("source"), F.sum(1 - F.col("src")).alias("target")).filter("source <> target")


@query("semantic_risk", "STR-17", oracle=rf"SELECT doc_id, len(regexp_extract_all(lower(text), '(^|[^a-z])({RISK})($|[^a-z])|{RISK_ZH}')) > 0 AS risky FROM documents")
def semantic_risk(t):
    return t("documents").select("doc_id", F.lower("text").rlike(rf"(^|[^a-z])({RISK})($|[^a-z])|{RISK_ZH}").alias("risky"))


@query("identifier_lines", "STR-19", "STR-22", oracle=rf"""WITH {BLOCKS_SQL} SELECT doc_id, ord, CASE WHEN regexp_matches(text, '^\s*(https?://)\S+\s*$') THEN 'url' WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{{2,}}') THEN 'email' WHEN regexp_matches(text, '^[0-9 .,%-]+$') THEN 'numeric' WHEN regexp_matches(text, '^[A-Z]{{1,4}}-?[0-9]+$') THEN 'identifier' END AS reason
FROM blocks WHERE length(text) BETWEEN 1 AND 1000 AND reason IS NOT NULL""")
def identifier_lines(t):
    x = F.col("text")
    reason = F.when(x.rlike(r"^\s*(https?://)\S+\s*$"), "url").when(x.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}"), "email").when(x.rlike(r"^[0-9 .,%-]+$"), "numeric").when(x.rlike(r"^[A-Z]{1,4}-?[0-9]+$"), "identifier")
    return blocks(t("documents")).filter(F.length("text").between(1, 1000)).select("doc_id", "ord", reason.alias("reason")).filter("reason IS NOT NULL")


@query("repetition_flags", "AGG-11", oracle=r"""WITH f AS (SELECT doc_id, source, trim(unnest(regexp_split_to_array(text, '[\n.!?]+')), ' ') AS piece FROM documents), g AS (SELECT doc_id, source, piece, count(*) AS n FROM f WHERE length(piece) >= 20 GROUP BY doc_id, source, piece),
s AS (SELECT source, piece, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY source, piece HAVING sum(n) >= 8)
SELECT 'document' AS scope, CAST(doc_id AS VARCHAR) AS key, max(n) AS most, count(*) AS pieces FROM g WHERE n >= 8 GROUP BY doc_id UNION ALL SELECT 'source' AS scope, source AS key, max(n) AS most, count(*) AS pieces FROM s GROUP BY source""")
def repetition_flags(t):
    """Fragments of 20 characters and more that occur eight times in a document, or over a source's documents."""
    f = t("documents").select("doc_id", "source", F.explode(F.split("text", r"[\n.!?]+")).alias("piece")).withColumn("piece", F.trim("piece")).filter("length(piece) >= 20")
    in_document = f.groupBy("doc_id", "piece").agg(F.count("*").alias("n")).filter("n >= 8").select(F.lit("document").alias("scope"), F.col("doc_id").cast("string").alias("key"), "n")
    in_source = f.groupBy("source", "piece").agg(F.count("*").alias("n")).filter("n >= 8").select(F.lit("source").alias("scope"), F.col("source").alias("key"), "n")
    return in_document.union(in_source).groupBy("scope", "key").agg(F.max("n").alias("most"), F.count("*").alias("pieces"))


@query(
    "phrase_terms", "AGG-12", "SRT-06",
    oracle=rf"""WITH seg AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z \t-]+')) AS s FROM documents),
x AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(s), '[ \t]+'), lambda w: w <> '') AS x FROM seg),
w AS (SELECT doc_id, list_transform(x, lambda w: CASE WHEN regexp_full_match(w, '[a-z][a-z-]{{1,35}}') AND w NOT IN ({", ".join(f"'{w}'" for w in STOP)}) THEN w END) AS x FROM x WHERE len(x) > 1),
i AS (SELECT doc_id, x, unnest(range(1, len(x))) AS i FROM w),
p AS (SELECT doc_id, x[i] || ' ' || x[i + 1] AS term FROM i UNION ALL SELECT doc_id, x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] AS term FROM i WHERE i + 2 <= len(x)),
g AS (SELECT doc_id, term, count(*) AS n FROM p WHERE term IS NOT NULL GROUP BY doc_id, term HAVING count(*) >= 2)
SELECT doc_id, term, n FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= {MOST_TERMS}""",
)
def phrase_terms(t):
    """Phrases of two and three words that a document repeats: counted inside its row, no shuffle.

    Words stand side by side in one sentence (anything but letters, hyphens and
    blanks ends it) and none is a stop word; the 48 most frequent are the report.
    """
    return X.in_slices(t("documents").select("doc_id", "text"), lambda it: X.phrases(it, STOP, MOST_TERMS), "doc_id long, term string, n long")


@query(
    "evidence_roles", "STR-11", "STR-12", "STR-13", "AGG-15", "TRN-04",
    oracle=rf"""WITH {BLOCKS_SQL} SELECT doc_id, ord, CASE WHEN ord = 0 THEN 'title' WHEN length(text) <= 60 AND NOT regexp_matches(text, '[.!?]$') THEN 'heading' WHEN regexp_matches(lower(text), '(^|[^a-z])(means|denotes|refers to)($|[^a-z])') THEN 'definition' ELSE 'passage' END AS role,
len(regexp_extract_all(text, '[.!?]( |$)')) AS sentences, length(text) > 700 AS oversized FROM blocks WHERE text <> ''""",
)
def evidence_roles(t):
    x = F.col("text")
    role = F.when(F.col("ord") == 0, "title").when((F.length(x) <= 60) & ~x.rlike(r"[.!?]$"), "heading").when(F.lower(x).rlike(r"(^|[^a-z])(means|denotes|refers to)($|[^a-z])"), "definition").otherwise("passage")
    return blocks(t("documents")).filter("text <> ''").select("doc_id", F.col("ord").cast("long").alias("ord"), role.alias("role"), F.size(F.regexp_extract_all("text", F.lit("[.!?]( |$)"), 0)).cast("long").alias("sentences"), (F.length(x) > 700).alias("oversized"))


@query("term_impact", "JOIN-15", "STR-09", oracle=r"WITH terms AS (SELECT * FROM (VALUES ('Apache License'), ('the'), ('stupid')) v(term)) SELECT t.term, d.doc_id FROM documents d JOIN terms t ON contains(concat(' ', regexp_replace(lower(d.text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), concat(' ', lower(t.term), ' '))")
def term_impact(t):
    """Glossary terms that occur as whole words; a handful of terms is broadcast."""
    terms = F.array(*(F.lit(x) for x in ("Apache License", "the", "stupid")))
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    hits = F.filter(terms, lambda x: F.contains(F.col("flat"), F.concat(F.lit(" "), F.lower(x), F.lit(" "))))
    return t("documents").select("doc_id", flat.alias("flat")).select(F.explode(hits).alias("term"), "doc_id")


@query("character_multiset", "AGG-10", oracle="WITH c AS (SELECT lang, unnest(string_split(regexp_replace(lower(text), '[^a-z]', '', 'g'), '')) AS letter FROM documents) SELECT lang, letter, count(*) AS n FROM c WHERE letter <> '' GROUP BY lang, letter")
def character_multiset(t):
    c = t("documents").select("lang", F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "")).alias("letter"))
    return c.filter("letter <> ''").groupBy("lang", "letter").agg(F.count("*").alias("n"))


@query("page_headings", "STR-24", "STR-26", "STR-29", oracle=r"SELECT page_id, regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '^[0-9.]+\s*', '') AS heading, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) BETWEEN 4 AND 300 AS valid_title FROM pages")
def page_headings(t):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), 0)).cast("long")
    return t("pages").select("page_id", F.regexp_replace(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), r"^[0-9.]+\s*", "").alias("heading"), n("<p>").alias("paragraphs"), n("<a ").alias("links"), F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).between(4, 300).alias("valid_title"))


# assistants' turns as they would come from a model: in a fence
FENCED_SQL = "CASE WHEN role = 'assistant' THEN concat('```text', chr(10), text, chr(10), '```') ELSE text END"


@query("fenced_turns", "STR-25", oracle=rf"SELECT conv_id, turn, regexp_replace(body, '^```[a-z]*\n|\n```$', '', 'g') AS body, len(string_split(body, chr(10))) AS lines FROM (SELECT conv_id, turn, {FENCED_SQL} AS body FROM conversations) c")
def fenced_turns(t):
    body = F.expr(FENCED_SQL)
    return t("conversations").select("conv_id", "turn", F.regexp_replace(body, r"^```[a-z]*\n|\n```$", "").alias("body"), F.size(F.split(body, "\n")).cast("long").alias("lines"))


@query("title_overlap", "STR-28", "STR-27", oracle="WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS x FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.x, b.x)) AS same FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.x, b.x)) > 0 AND 4 * len(list_intersect(a.x, b.x)) >= 3 * len(a.x)")
def title_overlap(t):
    """Titles that hold three quarters of the words of one before.

    Of a title's words, rarest first, at least one of the first quarter and one
    more is in any such match; only these words look for partners.
    """
    w = t("benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("x")).filter("size(x) > 0")
    words = w.select("item_id", F.explode("x").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("df"))
    ranked = words.join(often, "word").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("r"))
    rare = ranked.select(F.col("item_id").alias("a"), F.explode(F.expr("slice(r, 1, size(r) - cast(ceil(0.75 * size(r)) as int) + 1)")).alias("r")).select("a", F.col("r.word").alias("word"))
    pairs = rare.join(words.withColumnRenamed("item_id", "b"), "word").filter("a < b").select("a", "b").distinct()
    both = pairs.join(w.select(F.col("item_id").alias("a"), F.col("x").alias("xa")), "a").join(w.select(F.col("item_id").alias("b"), F.col("x").alias("xb")), "b")
    same = F.size(F.array_intersect("xa", "xb"))
    return both.filter(4 * same >= 3 * F.size("xa")).select("a", "b", same.cast("long").alias("same"))


@query("canonical_digest", "FN-05", "EXT-03", "FN-24", oracle="""SELECT doc_id, sha256('{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"lang":"' || lang || '","source":"' || source || '"}') AS digest, strlen(text) + 4096 <= 8192 AS fits FROM documents""")
def canonical_digest(t):
    body = F.to_json(F.struct("doc_id", "lang", "source"))
    return t("documents").select("doc_id", F.sha2(body.cast("binary"), 256).alias("digest"), (F.octet_length("text") + 4096 <= 8192).alias("fits"))


# Kernels that SQL cannot express: registered for their rows, held to goldens in the tests.


@query("canonical_numbers", "STR-05", "STR-06", "AGG-08")
def canonical_numbers(t):
    return t("documents").select("doc_id", F.explode(X.number_udf()("text")).alias("n")).select("doc_id", "n.literal", "n.value")


@query("masked_text", "STR-37", "TRN-03")
def masked_text(t):
    return t("documents").select("doc_id", X.mask_udf()("text").alias("m")).select("doc_id", "m.masked", "m.atoms")


@query("similar_memory", "SRT-09", "STR-41", "FN-20")
def similar_memory(t):
    """Every reviewed item asks all others; similarity and the diff report need Python."""
    return X.rank_memory(t("benchmark"), t("benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("salvaged_json", "SRC-07", "SRC-08", "FLT-20")
def salvaged_json(t):
    """Every event's properties as an array that was cut off behind them; an event is a unit, so a busy user is no hot group."""
    raw = t("events").select("event_id", F.concat(F.lit("["), "props", F.lit(', {"k": 1')).alias("raw"))
    return raw.select("event_id", X.salvage_udf()("raw").alias("s")).select("event_id", F.size("s.items").alias("items"), "s.complete")


@query("page_blocks", "SRC-06", "SRC-09", "LAY-08", "LAY-11")
def page_blocks(t):
    return X.in_slices(t("pages").select("page_id", "html"), X.html_blocks, "page_id long, ord int, kind string, level int, text string")


@query("markdown_blocks", "SRC-10", "STR-32")
def markdown_blocks(t):
    return t("conversations").select("conv_id", "turn", F.posexplode(X.markdown_udf()("text")).alias("ord", "b")).select("conv_id", "turn", "ord", "b.kind", "b.level", "b.text")


@query("inline_tokens", "STR-08", "JOIN-20")
def inline_tokens(t):
    return t("documents").select("doc_id", F.explode(X.inline_udf()("text")).alias("x")).select("doc_id", "x.kind", "x.start", "x.text")


@query("nfkc_core", "STR-04", "STR-27")
def nfkc_core(t):
    return t("documents").select("doc_id", F.sha2(X.core_udf()("text").cast("binary"), 256).alias("core"))


@query(
    "packed_context", "FN-16", "TRN-06",
    oracle="""WITH l AS (SELECT conv_id, list({'size': CAST(strlen(text) AS BIGINT), 'used': CAST(0 AS BIGINT), 'kept': CAST(0 AS BIGINT), 'omitted': CAST(0 AS BIGINT)} ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, list_reduce(list_prepend({'size': CAST(0 AS BIGINT), 'used': CAST(0 AS BIGINT), 'kept': CAST(0 AS BIGINT), 'omitted': CAST(0 AS BIGINT)}, l), lambda a, x: CASE WHEN a.used + x.size <= 3200
THEN {'size': a.size, 'used': a.used + x.size, 'kept': a.kept + 1, 'omitted': a.omitted} ELSE {'size': a.size, 'used': a.used, 'kept': a.kept, 'omitted': a.omitted + 1} END) AS r FROM l)
SELECT conv_id, r.used AS used, r.kept AS kept, r.omitted AS omitted FROM r""",
)
def packed_context(t):
    """Greedy packing of a conversation's turns under a byte budget, skipping what does not fit."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.octet_length("text").cast("long").alias("size"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("omitted"))

    def step(acc, x):
        fits = acc["used"] + x["size"] <= 3200
        return F.struct(F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"), (acc["kept"] + fits.cast("long")).alias("kept"), (acc["omitted"] + (~fits).cast("long")).alias("omitted"))

    return t("conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.aggregate("t", zero, step).alias("r")).select("conv_id", "r.*")
