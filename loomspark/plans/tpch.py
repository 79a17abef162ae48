"""TPC-H q1 to q22, adapted to the tables at hand: dates are moved, absent columns dropped, part-supplier pairs derived.

Each text runs unchanged in Spark and in an independent engine. Money is rounded where it is summed; every LIMIT
stands over a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.tables import PARTSUPP, register

TEXTS = {
    1: """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= date '1998-12-01' - interval '90' day
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    2: """
WITH sellers AS (
  SELECT s_suppkey, s_name, s_acctbal, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'
), offers AS (
  SELECT p_partkey, s_suppkey AS seller, min(l_extendedprice / l_quantity) AS cost
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN sellers ON s_suppkey = l_suppkey
  WHERE p_size = 15 AND p_type LIKE '%ECON%' GROUP BY p_partkey, s_suppkey
), ranked AS (
  SELECT p_partkey, seller, cost, min(cost) OVER (PARTITION BY p_partkey) AS least FROM offers
)
SELECT s_acctbal, s_name, n_name, p_partkey, s_suppkey FROM ranked JOIN sellers ON s_suppkey = seller
WHERE cost = least ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    3: """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, cast(o_orderdate AS date) AS o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < date '1998-03-15' AND l_shipdate > date '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    4: """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= date '1996-07-01' AND o_orderdate < date '1996-07-01' + interval '3' month
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + interval '30' day)
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    5: """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1997-01-01'
GROUP BY n_name ORDER BY revenue DESC, n_name""",
    6: """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01'
  AND l_discount BETWEEN cast(0.045 AS double) AND cast(0.075 AS double) AND l_quantity < 24""",
    7: """
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
  SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, cast(extract(year FROM l_shipdate) AS int) AS l_year,
         l_extendedprice * (1 - l_discount) AS volume
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
  WHERE ((a.n_name = 'NATION_6' AND b.n_name = 'NATION_7') OR (a.n_name = 'NATION_7' AND b.n_name = 'NATION_6'))
    AND l_shipdate BETWEEN date '1996-01-01' AND date '1997-12-31'
) v GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    8: """
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT cast(extract(year FROM o_orderdate) AS int) AS o_year, l_extendedprice * (1 - l_discount) AS volume, b.n_name AS nation
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN region ON a.n_regionkey = r_regionkey
  JOIN nation b ON s_nationkey = b.n_nationkey
  WHERE r_name = 'AMERICA' AND o_orderdate BETWEEN date '1996-01-01' AND date '1997-12-31' AND p_type = 'ECONOMY'
) v GROUP BY o_year ORDER BY o_year""",
    9: f"""
WITH {PARTSUPP}
SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
  SELECT n_name AS nation, cast(extract(year FROM o_orderdate) AS int) AS o_year,
         l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN partsupp ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%red%'
) v GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    10: """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= date '1996-10-01' AND o_orderdate < date '1996-10-01' + interval '3' month AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    11: """
WITH held AS (
  SELECT l_partkey AS ps_partkey, min(l_extendedprice / l_quantity) * (count(*) * 100) AS value FROM lineitem
  WHERE l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')
  GROUP BY l_partkey, l_suppkey
)
SELECT ps_partkey, round(sum(value), 2) AS value FROM held GROUP BY ps_partkey
HAVING sum(value) > (SELECT sum(value) * cast(0.001 AS double) FROM held) ORDER BY value DESC, ps_partkey""",
    12: """
SELECT l_returnflag, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high_line_count,
       sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag IN ('R', 'A') AND l_shipdate > o_orderdate AND l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01'
GROUP BY l_returnflag ORDER BY l_returnflag""",
    13: """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey
) c GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    14: """
SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END)
       / sum(l_extendedprice * (1 - l_discount)), 4) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= date '1996-09-01' AND l_shipdate < date '1996-10-01'""",
    15: """
WITH revenue AS (
  SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem
  WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1996-04-01' GROUP BY l_suppkey
)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    16: """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt
FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand <> 'Brand#12' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0 AND s_suppkey = l_suppkey)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    17: """
SELECT round(sum(l_extendedprice) / cast(7.0 AS double), 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#23' AND p_size < 20
  AND l_quantity < (SELECT cast(0.2 AS double) * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""",
    18: """
SELECT c_name, c_custkey, o_orderkey, cast(o_orderdate AS date) AS o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS quantity
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    19: """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_returnflag IN ('R', 'A') AND (
  (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
  OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
  OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45))""",
    20: """
WITH sold AS (
  SELECT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_name LIKE 'red%' GROUP BY l_partkey, l_suppkey
  HAVING count(*) * 100 > cast(0.5 AS double) * sum(CASE WHEN l_shipdate >= date '1996-01-01' AND l_shipdate < date '1999-01-01' THEN l_quantity END)
)
SELECT s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_name = 'NATION_3' AND s_suppkey IN (SELECT l_suppkey FROM sold) ORDER BY s_name""",
    21: """
SELECT s_name, count(*) AS numwait
FROM supplier JOIN lineitem l ON s_suppkey = l.l_suppkey JOIN orders ON o_orderkey = l.l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND l.l_shipdate > o_orderdate + interval '60' day AND n_name = 'NATION_7'
  AND EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_suppkey <> l.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem m JOIN orders p ON p.o_orderkey = m.l_orderkey
    WHERE m.l_orderkey = l.l_orderkey AND m.l_suppkey <> l.l_suppkey AND m.l_shipdate > p.o_orderdate + interval '60' day)
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    22: """
WITH rich AS (
  SELECT substring(c_name, length(c_name) - 1, 2) AS cntrycode, c_acctbal, c_custkey FROM customer
  WHERE substring(c_name, length(c_name) - 1, 2) IN ('13', '31', '23', '29', '30', '18', '17')
)
SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM rich
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM rich WHERE c_acctbal > 0)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= date '2000-06-01')
GROUP BY cntrycode ORDER BY cntrycode""",
}


def query(number: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, TEXTS[number])
        return spark.sql(TEXTS[number])

    return run


QUERIES = {f"tpch_q{n:02d}": query(n) for n in TEXTS}
ORACLE = {f"tpch_q{n:02d}": text for n, text in TEXTS.items()}
