"""Scalar expressions on the DataFrame API."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.catalogue import Catalogue, Tables

CATALOGUE = Catalogue()
query = CATALOGUE.query
c = F.col


@query("""SELECT p_partkey, cast(p_retailprice AS float) AS f, cast(p_size AS double) AS d, cast(p_size AS bigint) AS l, cast(p_size AS varchar) AS s,
cast(substring(p_brand, 7) AS int) AS brand FROM part""")
def expr_cast(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", c("p_retailprice").cast("float").alias("f"), c("p_size").cast("double").alias("d"), c("p_size").cast("long").alias("l"), c("p_size").cast("string").alias("s"),
        F.substring("p_brand", 7, 9).cast("int").alias("brand"),
    )


@query("SELECT p_partkey, try_cast(p_brand AS int) AS none, try_cast(cast(p_size AS varchar) AS int) AS some FROM part")
def expr_try_cast(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", c("p_brand").try_cast("int").alias("none"), c("p_size").cast("string").try_cast("int").alias("some"))


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS both, CASE WHEN c_custkey % 2 = 0 THEN c_name END || '!' AS half FROM customer")
def expr_concat(t: Tables) -> DataFrame:
    half = F.concat(F.when(c("c_custkey") % 2 == 0, c("c_name")), F.lit("!"))
    return t.customer.select("c_custkey", F.concat("c_name", F.lit("/"), "c_mktsegment").alias("both"), half.alias("half"))


@query("SELECT p_partkey, substring(p_name, 1, 3) AS head, substring(p_name, length(p_name) - 1, 2) AS tail, substring(p_name, 4) AS rest FROM part")
def expr_substring(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.substring("p_name", 1, 3).alias("head"), F.substring("p_name", -2, 2).alias("tail"), F.substring("p_name", 4, 1000).alias("rest"))


@query("SELECT p_partkey, upper(p_name) AS name FROM part")
def expr_upper(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.upper("p_name").alias("name"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind FROM part")
def expr_case(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(c("p_size") < 10, "small").when(c("p_size") < 30, "medium").otherwise("large").alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size WHEN p_size > 45 THEN -p_size END AS v FROM part")
def expr_case_no_else(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(c("p_size") < 10, c("p_size")).when(c("p_size") > 45, -c("p_size")).alias("v"))


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 1 ELSE 0 END AS v, 'no' AS of_null FROM part")
def expr_if(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.expr("if(p_size > 20, 1, 0)").alias("v"), F.expr("if(cast(null as boolean), 'yes', 'no')").alias("of_null"))


@query("SELECT o_orderkey, cast(extract(year FROM o_orderdate) AS int) AS y FROM orders")
def expr_year(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"))


@query("SELECT o_orderkey, cast(cast(o_orderdate AS date) + 45 AS date) AS later FROM orders")
def expr_date_add(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.date_add(c("o_orderdate").cast("date"), 45).alias("later"))


@query("SELECT o_orderkey, cast(cast(o_orderdate AS date) + INTERVAL 1 MONTH AS date) AS month, cast(cast(o_orderdate AS date) - INTERVAL 2 YEAR AS date) AS year FROM orders")
def expr_date_interval(t: Tables) -> DataFrame:
    day = c("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", (day + F.expr("interval 1 month")).cast("date").alias("month"), (day - F.expr("interval 2 year")).cast("date").alias("year"))


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS r, round(sqrt(p_size), 6) AS s FROM part")
def expr_sqrt(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(F.sqrt("p_retailprice"), 6).alias("r"), F.round(F.sqrt("p_size"), 6).alias("s"))


@query("SELECT p_partkey, round(exp(-p_size / 10.0), 8) AS e FROM part")
def expr_exp(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(F.exp(-c("p_size") / F.lit(10.0)), 8).alias("e"))


@query("SELECT c_custkey, -c_acctbal AS owed, 0 - c_custkey AS k FROM customer")
def expr_unary_minus(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", (-c("c_acctbal")).alias("owed"), F.negative("c_custkey").alias("k"))


@query("SELECT p_partkey, list_value(p_size, p_size + 1, NULL) AS a FROM part")
def expr_array(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array("p_size", c("p_size") + 1, F.lit(None).cast("int")).alias("a"))


@query("SELECT p_partkey, p_retailprice / nullif(p_size - 11, 0) AS q FROM part")
def expr_divide_by_zero(t: Tables) -> DataFrame:
    """Division by zero is null, whatever the session's ANSI setting."""
    return t.part.select("p_partkey", F.try_divide(c("p_retailprice"), c("p_size") - 11).alias("q"))


@query()
def expr_rand(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.rand(42).alias("r"))


@query("SELECT p_partkey, p_size IN (1, NULL) AS in_null, (p_size > 5) AND NULL AS and_null, (p_size > 5) OR NULL AS or_null, NOT (p_size > 5) AS negated FROM part")
def expr_three_valued(t: Tables) -> DataFrame:
    null = F.lit(None).cast("boolean")
    big = c("p_size") > 5
    return t.part.select("p_partkey", F.expr("p_size in (1, null)").alias("in_null"), (big & null).alias("and_null"), (big | null).alias("or_null"), (~big).alias("negated"))


@query("SELECT a, count(*) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'NaN'::DOUBLE WHEN p_size % 3 = 1 THEN 0.0 ELSE 1.0 END AS a FROM part) v GROUP BY a")
def expr_float_keys(t: Tables) -> DataFrame:
    """NaN equals NaN and -0.0 equals 0.0 as keys."""
    zero = F.when(c("p_size") % 2 == 0, F.lit(0.0)).otherwise(-F.lit(0.0))
    a = F.when(c("p_size") % 3 == 0, F.lit(float("nan"))).when(c("p_size") % 3 == 1, zero).otherwise(1.0)
    return t.part.groupBy(a.alias("a")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, cast(o_totalprice AS decimal(12, 2)) * cast(1.5 AS decimal(3, 1)) AS d FROM orders")
def expr_decimal(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (c("o_totalprice").cast("decimal(12,2)") * F.lit("1.5").cast("decimal(3,1)")).alias("d"))
