"""Submission of SQL texts: rows and a status, never an exception. Only SQL is run, no code."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from loomspark.catalogue import Catalogue, Tables
from loomspark.tables import register

CATALOGUE = Catalogue()


@dataclass(frozen=True)
class Result:
    status: str
    rows: list[Row] = field(default_factory=list)
    error: str = ""
    #: Whether there are more rows than those returned.
    cut: bool = False


def submit(spark: SparkSession, sql: str, most: int = 10_000) -> Result:
    """Run a query and return its rows, ``most`` of them at most (the answer goes through the driver); ``cut`` tells if there are more."""
    try:
        rows = spark.sql(sql).limit(most + 1).collect()
        return Result("ok", rows[:most], cut=len(rows) > most)
    except PySparkException as e:
        return Result("error", error=str(e).splitlines()[0])


@CATALOGUE.query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def submit_sql(t: Tables) -> DataFrame:
    register(t.spark, t.sf_dir)
    got = submit(t.spark, "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
    return t.spark.createDataFrame(got.rows, "r_name string, n long")
