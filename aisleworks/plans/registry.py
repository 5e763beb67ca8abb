"""Where bound queries and their SQL statements are collected."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.sources.fixtures import VIEW_SQL, Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def at_edge(df: DataFrame) -> DataFrame:
    """Zone-less timestamps at the output edge, as the Parquet inputs have them."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``, with its SQL if there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in _QUERIES:
            raise ValueError(f"query {key} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return at_edge(fn(Tables(spark, sf_dir)))

        run.__doc__ = fn.__doc__
        _QUERIES[key] = run
        if sql is not None:
            _SQL[key] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Put the fixture views a statement names in front of it as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\bv_[a-z_]+\b", text))):
            if name in VIEW_SQL and name not in needed:
                visit(VIEW_SQL[name])
                needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in needed)
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
