"""Registry of named queries: a Spark plan and, where it has one, the SQL text giving the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.plans.views import VIEW_SQL

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``build(spark, sf_dir)``; ``views`` are prepended to the SQL as common table expressions."""
    def wrap(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, build, with_views(sql, views) if sql else None)
        return build
    return wrap


def with_views(sql: str, views: tuple[str, ...]) -> str:
    heads = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in views)
    body = sql.strip()
    if not heads:
        return body
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {heads},\n{rest[10:]}"
        return f"WITH {heads},\n{rest}"
    return f"WITH {heads}\n{body}"


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double, so that sums taken in another order compare equal."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})
