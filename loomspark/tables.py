"""The star-schema tables: loading, temporary views and the derived part-supplier table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partsupp(lineitem: DataFrame) -> DataFrame:
    """Part-supplier pairs as the line items show them."""
    cost = F.min(F.col("l_extendedprice") / F.col("l_quantity"))
    return lineitem.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        (F.count(F.lit(1)) * 100).alias("ps_availqty"), cost.alias("ps_supplycost")
    )


def register(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """Temporary views of the star-schema tables, or of those that a text mentions."""
    for name in STAR:
        if sql is None or re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


#: The derived table as a common table expression.
PARTSUPP = """partsupp AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, count(*) * 100 AS ps_availqty,
         min(l_extendedprice / l_quantity) AS ps_supplycost
  FROM lineitem GROUP BY l_partkey, l_suppkey
)"""
