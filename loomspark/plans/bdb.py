"""The three queries of the Big Data Benchmark: filter, grouped sum over a substring, join with grouping.

Parts stand for rankings (name as page, size as rank), orders for visits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.catalogue import Catalogue, Tables

CATALOGUE = Catalogue()
query = CATALOGUE.query
c = F.col


def scan(rankings: DataFrame, least: int) -> DataFrame:
    return rankings.where(c("pageRank") > least).select("pageURL", "pageRank")


def revenue_by_prefix(visits: DataFrame, length: int) -> DataFrame:
    return visits.groupBy(F.substring("sourceIP", 1, length).alias("prefix")).agg(F.sum("adRevenue").alias("revenue"))


def join_revenue(rankings: DataFrame, visits: DataFrame, first: str, last: str) -> DataFrame:
    """Source, mean page rank and revenue of visits between two days, most revenue first."""
    kept = visits.where(c("visitDate").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    both = rankings.join(kept, c("pageURL") == c("destURL"))
    out = both.groupBy("sourceIP").agg(F.sum("adRevenue").alias("totalRevenue"), F.avg("pageRank").alias("avgRank"))
    return out.select("sourceIP", "totalRevenue", "avgRank").orderBy(c("totalRevenue").desc(), "sourceIP")


def rankings(t: Tables) -> DataFrame:
    return t.part.select(c("p_partkey").alias("pageURL"), c("p_size").alias("pageRank"))


def visits(t: Tables) -> DataFrame:
    lines = t.lineitem.select(c("l_suppkey").cast("string").alias("sourceIP"), c("l_partkey").alias("destURL"), c("l_shipdate").cast("date").alias("visitDate"), c("l_extendedprice").alias("adRevenue"))
    return lines


@query("""SELECT p_partkey AS "pageURL", p_size AS "pageRank" FROM part WHERE p_size > 40""")
def bdb_q1(t: Tables) -> DataFrame:
    return scan(rankings(t), 40)


@query("SELECT substring(cast(l_suppkey AS varchar), 1, 1) AS prefix, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1")
def bdb_q2(t: Tables) -> DataFrame:
    return revenue_by_prefix(visits(t), 1).select("prefix", F.round("revenue", 2).alias("revenue"))


@query("""SELECT cast(l_suppkey AS varchar) AS "sourceIP", round(sum(l_extendedprice), 2) AS "totalRevenue", round(avg(p_size), 6) AS "avgRank"
FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1998-01-01' GROUP BY l_suppkey""")
def bdb_q3(t: Tables) -> DataFrame:
    out = join_revenue(rankings(t), visits(t), "1996-01-01", "1997-12-31")
    return out.select("sourceIP", F.round("totalRevenue", 2).alias("totalRevenue"), F.round("avgRank", 6).alias("avgRank"))
