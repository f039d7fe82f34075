"""Derived tables that the operators work on, with the same tables for the oracle.

Blocks are the lines of documents, turns are segment versions, orders are jobs,
line items their tasks and money permits, events a job's event stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"

BLOCKS_SQL = "blocks AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS text FROM documents)"
TASKS_SQL = """tasks AS (SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS task_no, l_returnflag AS flag, l_linestatus AS line,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 1000000) AS BIGINT) AS micro, l_shipdate AS due FROM lineitem)"""
EVENTS_SQL = "stream AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS generation, event_id, ts, event_type AS kind, value, props FROM events)"


def blocks(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))


def tasks(lineitem: DataFrame) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return lineitem.select(
        F.col("l_orderkey").alias("job_id"), F.row_number().over(order).alias("task_no"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line"),
        F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 1000000).cast("long").alias("micro"), F.col("l_shipdate").alias("due"),
    )


def stream(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("job_id"), F.row_number().over(order).alias("generation"), "event_id", "ts", F.col("event_type").alias("kind"), "value", "props")
