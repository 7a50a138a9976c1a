"""Registry of the queries over the driver tables and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crossloom.plans.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``covers`` lists the inventory ids it exercises.

    ``sql`` may use the shared views and may start with more ``WITH`` parts
    written as ``@ name AS (...), ... @``.
    """

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            body, extra = sql.strip(), ""
            if body.startswith("@"):
                _, extra, body = body.split("@", 2)
                extra = "," + extra
            ORACLE[name] = f"WITH {SQL_VIEWS.strip()}{extra}\n{body}"
        return fn

    return wrap
