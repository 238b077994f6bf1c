"""Named queries over the driver tables, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.driver_tables import DriverTables, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of DriverTables; sql may name the views of driver_tables.DUCKDB."""

    def add(f: Callable[[DriverTables], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(DriverTables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = with_views(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    from ledgerloom.plans import answer_queries, archive_queries, derivation_queries, entry_queries, kept_queries, page_queries, report_queries, upkeep_queries  # noqa: F401  (they register themselves)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
