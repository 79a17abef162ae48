"""Registration of queries: a callable on (spark, sf_dir) and the SQL an independent engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.tables import table


class Tables:
    """Tables by attribute, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        """Register a function on ``Tables`` under its own name or ``name``."""

        def add(build: Callable[[Tables], DataFrame]):
            key = name or build.__name__

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(Tables(spark, sf_dir))

            self.queries[key] = run
            if sql:
                self.oracle[key] = sql
            return build

        return add

    def text(self, name: str, sql: str) -> None:
        """Register a SQL text that both engines run."""
        from loomspark.tables import register

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register(spark, sf_dir, sql)
            return spark.sql(sql)

        self.queries[name], self.oracle[name] = run, sql
