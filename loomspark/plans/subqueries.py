"""Subqueries and common table expressions: SQL texts that Catalyst decorrelates into joins and aggregates."""

from __future__ import annotations

from loomspark.catalogue import Catalogue

CATALOGUE = Catalogue()

TEXTS = {
    "sub_scalar": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)",
    "sub_scalar_select": "SELECT n_name, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS top FROM nation",
    "sub_scalar_empty": "SELECT n_nationkey, (SELECT max(s_acctbal) FROM supplier WHERE s_suppkey < 0) AS none FROM nation",
    "sub_scalar_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sub_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "sub_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "sub_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "sub_not_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "sub_not_in_nulls": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END FROM supplier)",
    "sub_multi_column_in": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 2)",
    "sub_exists_or": "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "sub_in_case": "SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'yes' ELSE 'no' END AS here FROM supplier",
    "sub_in_having": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > (SELECT count(*) / 30.0 FROM customer)",
    "sub_nested_limit": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50))",
    "sub_union_inside": "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey < 10 UNION ALL SELECT s_nationkey FROM supplier WHERE s_suppkey < 10)",
    "sub_from": "SELECT m, count(*) AS n FROM (SELECT o_custkey, max(o_orderpriority) AS m FROM orders GROUP BY o_custkey) v GROUP BY m",
    "sub_scalar_arithmetic": "SELECT n_nationkey + (SELECT max(r_regionkey) FROM region) AS k FROM nation",
    "sub_scalar_two": "SELECT (SELECT min(s_acctbal) FROM supplier) AS low, (SELECT max(s_acctbal) FROM supplier) AS high FROM region",
    "sub_scalar_nested": "SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part WHERE p_retailprice < (SELECT avg(p_retailprice) FROM part))",
    "sub_scalar_count_zero": "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS n FROM nation",
    "sub_scalar_correlated_two_keys": "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_quantity > (SELECT avg(b.l_quantity) FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND b.l_returnflag = a.l_returnflag) AND l_tax > 0.07",
    "sub_scalar_case": "SELECT c_custkey, CASE WHEN c_acctbal > (SELECT avg(c_acctbal) FROM customer) THEN 'above' ELSE 'below' END AS side FROM customer",
    "sub_exists_and_not_exists": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_tax < 0.01)",
    "sub_exists_uncorrelated": "SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)",
    "sub_not_exists_uncorrelated": "SELECT r_regionkey FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 200)",
    "sub_exists_aggregate": "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT s_nationkey FROM supplier WHERE s_nationkey = n_nationkey GROUP BY s_nationkey HAVING count(*) > 3)",
    "sub_in_aggregate": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 3000000)",
    "sub_in_distinct": "SELECT p_partkey FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 50)",
    "sub_in_correlated": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > c_acctbal)",
    "sub_not_in_correlated": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > c_acctbal)",
    "sub_in_or_in": "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) OR n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')",
    "sub_not_in_or": "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)",
    "sub_in_both_sides": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))) AND o_totalprice > 400000",
    "sub_in_join": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500)",
    "sub_in_except": "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
    "sub_in_intersect": "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)",
    "sub_in_null_list": "SELECT count(*) AS n FROM nation WHERE n_nationkey IN (SELECT CASE WHEN s_acctbal > 0 THEN s_nationkey END FROM supplier)",
    "sub_in_empty": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0)",
    "sub_having_exists": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey)",
    "sub_having_in": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING max(o_totalprice) IN (SELECT max(o_totalprice) FROM orders GROUP BY o_orderpriority)",
    "sub_from_join": "SELECT a.n_nationkey, a.n, b.total FROM (SELECT n_nationkey, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey) a JOIN (SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey) b ON a.n_nationkey = b.c_nationkey",
    "sub_cte_in": "WITH rich AS (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING avg(c_acctbal) > 4500) SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM rich)",
    "sub_cte_twice": "WITH t AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT a.o_custkey FROM t a WHERE a.m > (SELECT avg(m) * 1.5 FROM t)",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 3000000) SELECT count(*) AS n, round(max(total), 2) AS most FROM top",
}

for _name, _sql in TEXTS.items():
    CATALOGUE.text(_name, _sql)
