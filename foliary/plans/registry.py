"""Registry of runnable queries: an operator bound to the given tables, next to the SQL that must agree with it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from foliary.plans.tables import COMMON_TABLES, Tables

Builder = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def with_tables(sql: str) -> str:
    """Prefix the common table expressions that ``sql`` needs, in order of dependence."""
    needed, text = set(), sql
    for name in reversed(list(COMMON_TABLES)):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += COMMON_TABLES[name]
    head = ",\n".join(f"{name} AS ({body.strip()})" for name, body in COMMON_TABLES.items() if name in needed)
    if not head:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[len('WITH'):].strip()}"
    return f"WITH {head}\n{body}"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under its function name."""

    def register(build: Builder) -> Builder:
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = Query(key, build, with_tables(sql) if sql else None)
        return build

    return register
