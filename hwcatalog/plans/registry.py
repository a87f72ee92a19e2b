"""The table of queries: name -> (function of a Catalog, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Catalog, duck

QUERIES: dict[str, Callable[[Catalog], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``sql`` may read the catalog views named in ``views``, whose definitions are put before it.

    SQL that starts with its own WITH list writes ``WITH more AS`` after the views as ``, more AS``.
    """

    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            head = duck(*views.split()) if views else ("WITH RECURSIVE _one AS (SELECT 1)" if sql.lstrip().startswith(",") else "")
            SQL[name] = f"{head} {sql}".strip()
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_queries, function_queries, source_queries  # noqa: F401  they register themselves

    return {n: (lambda spark, sf_dir, f=f: f(Catalog(spark, sf_dir))) for n, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
