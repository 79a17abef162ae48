"""Delimited text in and out, with the schema given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.catalogue import Catalogue, Tables
from loomspark.scratch import scratch

CATALOGUE = Catalogue()


def read_csv(spark: SparkSession, path: str, schema: str, delimiter: str = "|") -> DataFrame:
    return spark.read.schema(schema).option("delimiter", delimiter).csv(path)


def write_csv(df: DataFrame, path: str, delimiter: str = "|", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("delimiter", delimiter).csv(path)


@CATALOGUE.query("SELECT * FROM supplier")
def csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv")
    write_csv(t.supplier, path)
    return read_csv(t.spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@CATALOGUE.query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def cached_agg(t: Tables) -> DataFrame:
    """Over a cached table."""
    return t.customer.select("c_mktsegment").cache().groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
