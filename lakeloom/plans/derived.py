"""Operators as SQL over named tables, run on tables derived from the driver's.

``VIEWS`` derives layouts, cells, jobs and the like from whole base tables; an
operator is a SQL text whose ``{name}`` are its input tables.  Spark gets them
as DataFrames (``run`` takes any of the same columns), DuckDB as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import BLOCKS_SQL, blocks
from .registry import TABLES, Tables, query

_INPUT = re.compile(r"\{(\w+)\}")
_UNNESTED = {
    "blocks": (BLOCKS_SQL, lambda t: blocks(t("documents"))),
    "numbers_of": (
        "numbers_of AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM documents)",
        lambda t: t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("number")),
    ),
    "chars": (
        "chars AS (SELECT page, id, x0, y0, x1, y1, length(text) AS n, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS ch FROM regions WHERE id < 100000)",
        lambda t: characters(frame(t, "regions")),
    ),
    "slots": (
        "slots AS (SELECT table_id, id, r0, c0, rs, cs, r0 + dr AS r, c0 + unnest(range(cs)) AS c FROM (SELECT *, unnest(range(rs)) AS dr FROM cells) x)",
        lambda t: frame(t, "cells").withColumn("r", F.explode(F.expr("sequence(r0, r0 + rs - 1)"))).withColumn("c", F.explode(F.expr("sequence(c0, c0 + cs - 1)"))),
    ),
}
_NEEDS = {"slots": ("cells",), "chars": ("regions",)}

#: letters that glyphs draw in two, the letter and the accent
ACCENTED, LETTERS, ACCENTS = "éèêâôûîëïüöäñ", "eeeaouieiuoan", "´`^^^^^¨¨¨¨¨~"
#: derived tables; every line of a document is a region of the page that the document is, and a number in its margin is one more
VIEWS = {
    "regions": """SELECT doc_id AS page, CAST(ord AS BIGINT) AS id, text, CASE WHEN ord % 7 = 0 THEN 40.0 ELSE 40.0 + 260.0 * (ord % 2) END AS x0, floor(ord / 2.0) * 30.0 AS y0,
CASE WHEN ord % 7 = 0 THEN 560.0 ELSE 40.0 + 260.0 * (ord % 2) + least(250.0, 5.0 * length(text) + 10.0) END AS x1, floor(ord / 2.0) * 30.0 + 8.0 + length(text) % 17 AS y1 FROM {blocks} WHERE text <> ''
UNION ALL SELECT doc_id AS page, 100000 AS id, CAST(doc_id % 1000 AS STRING) AS text, 290.0 AS x0, 770.0 AS y0, 310.0 AS x1, 782.0 AS y1 FROM {documents}""",
    "layout": """SELECT page, id, CASE WHEN id % 7 = 0 THEN 'heading' WHEN id % 22 = 5 THEN 'table' WHEN id % 11 = 5 THEN 'figure' WHEN id % 11 = 6 THEN 'caption' ELSE 'paragraph' END AS kind, CASE WHEN id % 7 = 0 THEN 1 + CAST(floor(id / 7.0) AS BIGINT) % 3 END AS level, CASE WHEN id % 22 = 6 THEN 'table' ELSE 'figure' END AS owner_kind,
CASE WHEN id % 5 = 3 THEN replace(text, 'e', '') ELSE text END AS text, x0 - 2.0 - CASE WHEN id % 11 = 5 THEN 60.0 WHEN id % 11 = 6 THEN 260.0 - 520.0 * ((id + 1) % 2) ELSE 0.0 END AS x0, y0 - 1.0 - CASE WHEN id % 12 = 10 THEN 75.0 WHEN id % 11 = 6 THEN -40.0 ELSE 0.0 END AS y0,
x1 + 2.0 - CASE WHEN id % 13 = 4 THEN 0.5 * (x1 - x0) WHEN id % 11 = 6 THEN 260.0 - 520.0 * ((id + 1) % 2) ELSE 0.0 END AS x1, y1 + id % 3 + CASE WHEN id % 11 = 5 THEN 25.0 WHEN id % 11 = 6 THEN 40.0 ELSE 0.0 END - CASE WHEN id % 12 = 10 THEN 75.0 ELSE 0.0 END AS y1 FROM {regions} WHERE id % 29 <> 17 AND id < 100000""",
    # some paragraphs once more, in the box of the next block
    "copied": """SELECT page, id, kind, text, x0, y0, x1, y1 FROM {layout} UNION ALL SELECT a.page, a.id + 300000 AS id, a.kind, a.text, b.x0, b.y0, b.x1, b.y1 FROM {layout} a JOIN {layout} b ON b.page = a.page AND b.id = a.id + 1 WHERE a.kind = 'paragraph' AND a.id % 3 = 1""",
    # recognised lines that lost a word, or a letter of one, and their native texts
    "repairs": """SELECT doc_id * 100000 + ord AS id, text AS native, CASE ord % 4 WHEN 0 THEN concat(split_part(text, ' ', 1), substring(text, length(split_part(text, ' ', 1)) + length(split_part(text, ' ', 2)) + 2)) WHEN 1 THEN replace(text, concat(' ', split_part(text, ' ', 3), ' '), concat(' ', substring(split_part(text, ' ', 3), 2), ' '))
WHEN 2 THEN concat(text, ' more') ELSE text END AS original FROM {blocks} WHERE text <> ''""",
    # identifiers as papers print them, and revisions of glossaries with and without a document
    "cited": """SELECT l_orderkey * 100 + l_linenumber AS id, l_linenumber % 5 AS kind, l_partkey AS n, CASE l_linenumber % 5 WHEN 0 THEN concat('https://doi.org/10.1234/Ab%2Fc', l_partkey, ').') WHEN 1 THEN concat('doi: 10.1234/x(', l_partkey, ')') WHEN 2 THEN '10.12/short'
WHEN 3 THEN concat('(see 10.1234/y', l_partkey, ')') ELSE concat(' DOI:10.1234/z-', l_partkey, ',;') END AS written FROM {lineitem}""",
    "revisions": "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS BIGINT) END AS doc, o_orderpriority AS lang, o_orderdate AS created FROM {orders}",
    # the layout as a tree: a block hangs on the heading before it (some on the block before), a caption on its figure
    "tree": """SELECT *, CASE WHEN id % 13 = 3 THEN id - 1 ELSE max(CASE WHEN kind = 'heading' THEN id END) OVER (PARTITION BY page ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent, CASE WHEN kind = 'caption' THEN id - 1 END AS owner,
CASE WHEN kind = 'heading' AND id % 5 = 4 THEN 'references' WHEN kind = 'heading' THEN 'body' END AS section FROM {layout}""",
    # which family of models a page is translated by
    "models": "SELECT doc_id AS page, CASE doc_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'chat' ELSE 'reasoning' END AS family FROM {documents}",
    # numbered lines: two lists of a page in turns, with numbers left out here and there
    "items": "SELECT doc_id AS page, CAST(ord AS BIGINT) AS id, 40.0 + 20.0 * (doc_id % 2) AS x0, concat(CASE WHEN ord % 9 = 4 THEN '' ELSE concat(1 + ord % 6 + CASE WHEN ord % 11 = 5 THEN 1 ELSE 0 END, CASE WHEN doc_id % 3 = 0 THEN ')' ELSE '.' END, ' ') END, text) AS text FROM {blocks} WHERE text <> ''",
    # superscript marks at the ends of lines, and notes that begin with them
    "marked": "SELECT doc_id AS page, CAST(ord AS BIGINT) AS id, CASE WHEN ord % 4 = 1 THEN concat(text, translate(CAST(1 + ord % 5 AS STRING), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹')) ELSE text END AS text FROM {blocks} WHERE text <> ''",
    "notes": "SELECT doc_id AS page, CAST(ord AS BIGINT) AS id, concat(CAST(1 + ord % 5 AS STRING), CASE WHEN ord % 2 = 0 THEN ' ' ELSE '. ' END, text) AS text FROM {blocks} WHERE text <> '' AND ord % 6 = 5",
    "graphics": "SELECT page, id, x0 + 1.0 AS x0, y0 + 1.0 AS y0, x1 - 1.0 AS x1, y1 - 1.0 AS y1 FROM {layout} WHERE kind = 'figure'",
    "drawn": "SELECT page, id, kind, x0, y0, x1, y1 FROM {layout} UNION ALL SELECT page, id + 200000 AS id, kind, x0 + 3.0 AS x0, y0 + 3.0 AS y0, x0 + (x1 - x0) / (2 + id % 5) AS x1, y1 - 3.0 AS y1 FROM {layout} WHERE kind = 'figure' AND page % 3 = 1",
    "glyphs": f"""SELECT page, (id * 100000 + i) * 2 AS idx, translate(ch, '{ACCENTED}', '{LETTERS}') AS ch, x0 + (x1 - x0) / n * (i + 0.1) AS x0, y0 + 2.0 AS y0, x0 + (x1 - x0) / n * (i + 0.9) AS x1, y1 - 1.0 AS y1 FROM {{chars}}
UNION ALL SELECT page, (id * 100000 + i) * 2 + 1 AS idx, translate(ch, '{ACCENTED}', '{ACCENTS}') AS ch, x0 + (x1 - x0) / n * (i + 0.1) AS x0, y0 - 1.0 AS y0, x0 + (x1 - x0) / n * (i + 0.9) AS x1, y0 + 3.0 AS y1 FROM {{chars}} WHERE instr('{ACCENTED}', ch) > 0""",
    # forty parts are a document, ten of them a section
    "papers": """SELECT CAST(floor(p_partkey / 40.0) AS BIGINT) AS doc, CAST(p_partkey AS BIGINT) AS block, CASE WHEN p_partkey % 40 >= 10 THEN CAST(floor(p_partkey / 10.0) AS BIGINT) END AS scope,
concat('The ', lower(p_type), ' ', p_name, ' (', substring(p_type, 1, 1), upper(substring(split_part(p_name, ' ', 1), 1, 1)), upper(substring(split_part(p_name, ' ', 2), 1, 1)), CASE WHEN p_size % 7 = 0 THEN 's' ELSE '' END, ') comes in a ', lower(p_name), ' box. ',
CASE WHEN p_size % 4 = 0 THEN concat('A ', lower(p_name), ' refers to packing! ') ELSE '' END, CASE WHEN p_size % 6 = 1 THEN concat('We define ', lower(p_brand), ' as a label; see ', lower(p_type), '.') ELSE '' END) AS text FROM {part}""",
    # a customer's orders are the entries of a paper, the orders' items cite them
    "entries": """SELECT CAST(o_custkey AS BIGINT) AS doc, CAST(o_orderkey AS BIGINT) AS id, concat('[', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END, '] N', translate(CAST(o_orderkey % 50 AS STRING), '0123456789', 'abcdefghij'),
', J., Smith, A. (', year(o_orderdate), '). A title', CASE WHEN o_orderkey % 11 = 0 THEN ' of 1899 and 1999' ELSE '' END, '.') AS text FROM {orders}""",
    "mentions": """SELECT CAST(o.o_custkey AS BIGINT) AS doc, s.doc * 100 + s.r AS id, CASE s.r % 4 WHEN 0 THEN concat('As in [', 1 + s.pick % 5, ', ', 2 + s.pick % 5, '–', 4 + s.pick % 7, '] and [', s.pick % 9, '].')
WHEN 1 THEN concat('(N', translate(CAST(o.o_orderkey % 50 AS STRING), '0123456789', 'abcdefghij'), ', ', year(o.o_orderdate), ') and [ 1 ]') WHEN 2 THEN concat('See (N', translate(CAST(o.o_orderkey % 50 AS STRING), '0123456789', 'abcdefghij'), ' & Smith, ', year(o.o_orderdate), '; ', year(o.o_orderdate) - 1, ').')
ELSE concat('[9-3], (N', translate(CAST(o.o_orderkey % 50 AS STRING), '0123456789', 'abcdefghij'), ' et al., ', year(o.o_orderdate), ')') END AS text FROM {sheets} s JOIN {orders} o ON o.o_orderkey = s.doc""",
    # lines whose translations slip into other scripts
    "units": """SELECT doc_id * 100000 + ord AS id, CASE WHEN ord % 4 = 1 THEN translate(text, 'eu', '가나') ELSE text END AS source, CASE ord % 5 WHEN 1 THEN translate(text, 'eu', '가나') WHEN 3 THEN translate(text, 'aio', 'アイー') ELSE text END AS target,
CASE doc_id % 6 WHEN 0 THEN 'ja' WHEN 1 THEN 'ko' WHEN 2 THEN 'zh-Hang' WHEN 3 THEN 'ja-Latn' WHEN 4 THEN 'en-x-Jpan' ELSE 'de' END AS locale FROM {blocks} WHERE text <> ''""",
    "unit_literals": "SELECT doc_id * 100000 + ord AS id, translate(split_part(text, ' ', 1), 'aio', 'アイー') AS literal FROM {blocks} WHERE text <> ''",
    "sheets": """SELECT CAST(l_orderkey AS BIGINT) AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS r, count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(l_linenumber AS STRING) AS line,
CAST(CAST(l_quantity AS BIGINT) AS STRING) AS q, l_returnflag AS flag, l_orderkey % 5 AS kind, CAST(l_quantity AS BIGINT) AS pick FROM {lineitem}""",
    "cells": "SELECT l_orderkey AS table_id, l_partkey * 10 + l_linenumber AS id, CAST(l_linenumber - 1 AS BIGINT) AS r0, CAST(l_suppkey % 2 AS BIGINT) AS c0, CAST(1 + CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS BIGINT) AS rs, CAST(2 - l_suppkey % 2 AS BIGINT) AS cs FROM {lineitem}",
    "jobs": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(floor(o_orderkey / 4.0) AS BIGINT) END AS parent, CASE WHEN o_orderstatus = 'P' THEN 'publish' ELSE 'unit' END AS stage FROM {orders}",
    "glossary": "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'doc' ELSE 'global' END AS scope, p_type AS term, p_brand AS target, CASE p_size % 3 WHEN 0 THEN 'must' WHEN 1 THEN 'preferred' ELSE 'forbidden' END AS mode FROM {part}",
    "results": "SELECT doc_id, CAST(ord AS BIGINT) AS id, CASE WHEN ord % 17 = 8 THEN md5(concat(text, '?')) ELSE md5(text) END AS source_hash, CASE WHEN length(text) < 25 THEN 'retained' ELSE 'translated' END AS status, CASE WHEN ord % 19 = 7 THEN '' WHEN ord % 5 = 3 THEN replace(text, 'a', 'o') ELSE text END AS target FROM {blocks} WHERE text <> '' AND ord % 23 <> 11",
    "capacity": "SELECT s_suppkey AS id, s_suppkey % 4 AS masters, s_suppkey % 3 AS children, CASE WHEN s_nationkey % 9 = 0 THEN NULL ELSE 4096 + 512 * (s_suppkey % 29) END AS ram, 256 * (s_suppkey % 17) AS used, 1024 * (1 + s_nationkey % 5) AS need FROM {supplier}",
    "prices": "SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS inp, p_size % 7 AS cached, CASE WHEN p_partkey % 13 = 0 THEN -1 ELSE p_size * 2 END AS outp FROM {part}",
}


def frame(t: Tables, name: str, **made: DataFrame) -> DataFrame:
    """A base or derived table; ``made`` are tables that are there already."""
    if name in made:
        return made[name]
    if name in TABLES:
        return t(name)
    if name in _UNNESTED:
        return _UNNESTED[name][1](t)
    return run(t.spark, VIEWS[name], **{n: frame(t, n, **made) for n in set(_INPUT.findall(VIEWS[name]))})


def characters(regions: DataFrame) -> DataFrame:
    """``chars``: what the lines of a page are written in, without the numbers in its margin."""
    return regions.filter("id < 100000").select("page", "id", "x0", "y0", "x1", "y1", F.length("text").alias("n"), F.posexplode(F.split("text", "")).alias("i", "ch"))


def run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """An operator's SQL over tables given by name."""
    return spark.sql(sql, **tables)


def _ctes(name: str, out: dict[str, str]) -> None:
    if name in TABLES or name in out:
        return
    for n in _NEEDS.get(name, _INPUT.findall(VIEWS.get(name, ""))):
        _ctes(n, out)
    out[name] = _UNNESTED[name][0] if name in _UNNESTED else f"{name} AS ({_INPUT.sub(r'\1', VIEWS[name])})"


def oracle(sql: str, *, recursive: bool = False) -> str:
    """The same operator as one statement for DuckDB."""
    ctes: dict[str, str] = {}
    for n in _INPUT.findall(sql):
        _ctes(n, ctes)
    body = _INPUT.sub(r"\1", sql)
    own = re.match(r"WITH (RECURSIVE )?", body)
    if not ctes:
        return body
    head = "WITH RECURSIVE " if own and own[1] else "WITH "
    return head + ",\n".join(ctes.values()) + (",\n" + body[own.end() :] if own else "\n" + body)


OPERATORS: dict[str, str] = {}


def derived(name: str, *ids: str, sql: str, build: Callable[..., DataFrame] | None = None) -> None:
    """Register an operator on the derived tables, with the same SQL as its oracle.

    ``build`` takes the tables by name and does the same at less cost.
    """
    OPERATORS[name] = sql
    names = set(_INPUT.findall(sql))

    def made(t: Tables) -> DataFrame:
        tables = {n: frame(t, n) for n in names}
        return build(**tables) if build else run(t.spark, sql, **tables)

    query(name, *ids, oracle=oracle(sql))(made)
