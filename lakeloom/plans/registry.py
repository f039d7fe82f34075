"""Registered queries: a name, the inventory ids it covers, Spark code and oracle SQL.

``@query`` registers a function ``(t) -> DataFrame`` where ``t(name)`` loads a
table.  ``shared`` registers SQL that both engines read: Spark plans it over
DataFrames, DuckDB runs the same text as the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAMED = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")


class Tables:
    """Loads a table of a data folder; keeps nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL whose FROM and JOIN clauses name tables of the folder."""
        used = {m[2] for m in _NAMED.finditer(text)}
        return self.spark.sql(_NAMED.sub(r"\1 {\2}", text), **{n: self(n) for n in used})


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, *ids: str, oracle: str | None = None) -> Callable:
    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"two queries named {name}")
        REGISTRY[name] = Query(name, ids, build, oracle)
        return build

    return add


def shared(name: str, *ids: str, sql: str) -> None:
    query(name, *ids, oracle=sql)(lambda t: t.sql(sql))


def coverage() -> dict[str, list[str]]:
    """Inventory id to the queries that cover it."""
    out: dict[str, list[str]] = {}
    for q in REGISTRY.values():
        for i in q.ids:
            out.setdefault(i, []).append(q.name)
    return out
