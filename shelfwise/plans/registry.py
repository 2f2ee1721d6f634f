"""Where catalogue queries and their SQL counterparts are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Catalogue, duckdb_sql

Build = Callable[[Catalogue], DataFrame]


class Registry:
    """Queries by name; each takes the tables and views of one folder."""

    def __init__(self) -> None:
        self.builds: dict[str, Build] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Build, sql: str | None = None) -> None:
        self.builds[name] = build
        if sql is not None:
            self.sql[name] = duckdb_sql(sql)

    def also(self, name: str, known: str) -> None:
        """The query ``known`` under a further name."""
        self.builds[name] = self.builds[known]
        if known in self.sql:
            self.sql[name] = self.sql[known]

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {name: (lambda spark, sf_dir, build=build: build(Catalogue(spark, sf_dir))) for name, build in self.builds.items()}
