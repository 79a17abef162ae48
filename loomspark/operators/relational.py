"""Projection, filter, join, aggregation, sort, limit and set operations on the DataFrame API."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.catalogue import Catalogue, Tables

CATALOGUE = Catalogue()
query = CATALOGUE.query
c = F.col




# ------------------------------------------------------------------ scan, project, filter


@query("SELECT * FROM nation")
def scan_parquet(t: Tables) -> DataFrame:
    return t.nation


@query("SELECT c_custkey, c_acctbal FROM customer")
def scan_project_pruned(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_acctbal")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber + 1 AS next_line FROM lineitem")
def project_arith(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"), (c("l_linenumber") + 1).alias("next_line"))


@query("SELECT c_custkey AS id, c_name, c_mktsegment, c_nationkey AS nationkey, 1 AS one FROM customer")
def project_columns(t: Tables) -> DataFrame:
    return t.customer.withColumnRenamed("c_custkey", "id").withColumnRenamed("c_nationkey", "nationkey").drop("c_acctbal").withColumn("one", F.lit(1))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderkey <> 7 AND o_custkey <= 900 AND o_custkey >= 100")
def filter_cmp(t: Tables) -> DataFrame:
    return t.orders.where((c("o_totalprice") > 250000) & (c("o_orderkey") != 7) & (c("o_custkey") <= 900) & (c("o_custkey") >= 100)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice < 50000) OR NOT (o_orderpriority < '5')")
def filter_and_or_not(t: Tables) -> DataFrame:
    return t.orders.where(((c("o_orderstatus") == "F") & (c("o_totalprice") < 50000)) | ~(c("o_orderpriority") < "5")).select("o_orderkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(t: Tables) -> DataFrame:
    return t.part.where(c("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') OR p_size NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)")
def filter_in(t: Tables) -> DataFrame:
    return t.part.where(c("p_brand").isin("Brand#1", "Brand#2") | ~c("p_size").isin(*range(1, 13))).select("p_partkey")


_HOLES = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price, CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS cust FROM orders"


def holes(t: Tables) -> DataFrame:
    """Orders with nulls in price and cust."""
    price = F.when(c("o_orderstatus") == "F", c("o_totalprice")).alias("price")
    return t.orders.select("o_orderkey", price, F.when(c("o_orderstatus") != "O", c("o_custkey")).alias("cust"))


@query(f"SELECT o_orderkey FROM ({_HOLES}) h WHERE price IS NULL")
def filter_is_null(t: Tables) -> DataFrame:
    return holes(t).where(c("price").isNull()).select("o_orderkey")


@query(f"SELECT o_orderkey FROM ({_HOLES}) h WHERE price IS NOT NULL AND cust IS NOT NULL")
def filter_is_not_null(t: Tables) -> DataFrame:
    return holes(t).where(c("price").isNotNull() & c("cust").isNotNull()).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE 'red%'")
def filter_like_prefix(t: Tables) -> DataFrame:
    return t.part.where(c("p_name").startswith("red")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%ring'")
def filter_like_suffix(t: Tables) -> DataFrame:
    return t.part.where(c("p_name").endswith("ring")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%e b%'")
def filter_like_contains(t: Tables) -> DataFrame:
    return t.part.where(c("p_name").contains("e b")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '_e_ %'")
def filter_like_underscore(t: Tables) -> DataFrame:
    return t.part.where(c("p_name").like("_e_ %")).select("p_partkey")


# ------------------------------------------------------------------ joins


# Over every row of customer and orders; rows go unmatched by a condition on values.
for _kind, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    query(f"SELECT c_custkey, c_name, o_orderkey FROM customer {_sql} orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 50", f"join_{_kind}")(
        lambda t, k=_kind: t.customer.join(t.orders, (c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > c("c_acctbal") * 50), k).select("c_custkey", "c_name", "o_orderkey")
    )
for _kind, _sql in (("semi", ""), ("anti", "NOT ")):
    query(f"SELECT c_custkey, c_name FROM customer WHERE {_sql}EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)", f"join_{_kind}")(
        lambda t, k=_kind: t.customer.join(t.orders, (c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > c("c_acctbal") * 50), f"left_{k}").select("c_custkey", "c_name")
    )


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 4")
def join_inner_residual(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, (c("o_orderkey") == c("l_orderkey")) & (c("l_extendedprice") > c("o_totalprice") / 4)).select("o_orderkey", "l_linenumber")


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice")
def join_left_residual(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, (c("o_orderkey") == c("l_orderkey")) & (c("l_extendedprice") > c("o_totalprice")), "left").select("o_orderkey", "l_linenumber")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t: Tables) -> DataFrame:
    return t.nation.crossJoin(F.broadcast(t.region)).select("n_name", "r_name")  # at most 25 by 5 rows


_SPANS = "(SELECT n_nationkey, n_nationkey * 20 AS lo FROM nation)"


def _spans(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", (c("n_nationkey") * 20).alias("lo"))


for _kind, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    query(f"SELECT s_suppkey, n_nationkey FROM supplier {_sql} {_SPANS} n ON s_suppkey < lo AND s_acctbal > lo * 20", f"join_theta_{_kind}")(
        lambda t, k=_kind: t.supplier.join(_spans(t), (c("s_suppkey") < c("lo")) & (c("s_acctbal") > c("lo") * 20), k).select("s_suppkey", "n_nationkey")
    )
for _kind, _sql in (("semi", ""), ("anti", "NOT ")):
    query(f"SELECT s_suppkey FROM supplier WHERE {_sql}EXISTS (SELECT 1 FROM {_SPANS} n WHERE s_suppkey > lo AND s_acctbal < lo * 20)", f"join_theta_{_kind}")(
        lambda t, k=_kind: t.supplier.join(_spans(t), (c("s_suppkey") > c("lo")) & (c("s_acctbal") < c("lo") * 20), f"left_{k}").select("s_suppkey")
    )


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    return a.join(b, (c("a.s_nationkey") == c("b.s_nationkey")) & (c("a.s_suppkey") < c("b.s_suppkey"))).select(c("a.s_suppkey").alias("a"), c("b.s_suppkey").alias("b"))


@query("""SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def join_multi_way(t: Tables) -> DataFrame:
    both = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return both.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))


@query(f"SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM ({_HOLES}) a FULL JOIN ({_HOLES}) b ON a.price = b.price AND a.o_orderkey = b.o_orderkey")
def join_null_keys(t: Tables) -> DataFrame:
    a, b = holes(t).alias("a"), holes(t).alias("b")
    return a.join(b, (c("a.price") == c("b.price")) & (c("a.o_orderkey") == c("b.o_orderkey")), "full").select(c("a.o_orderkey").alias("a"), c("b.o_orderkey").alias("b"))


@query("SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def join_using(t: Tables) -> DataFrame:
    left = t.lineitem.withColumnRenamed("l_orderkey", "k")
    return left.join(t.orders.where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "k"), ["k"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


CATALOGUE.text("join_natural", "SELECT k, n_name, customers FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY c_nationkey) b")


_NATIONS = "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(_NATIONS)
def join_broadcast_hint(t: Tables) -> DataFrame:
    return t.customer.join(F.broadcast(t.nation), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name")  # 25 rows


@query(_NATIONS)
def join_merge_hint(t: Tables) -> DataFrame:
    return t.customer.join(t.nation.hint("merge"), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name")


@query(_NATIONS)
def join_hash_hint(t: Tables) -> DataFrame:
    return t.customer.join(t.nation.hint("shuffle_hash"), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name")


# ------------------------------------------------------------------ aggregation

_ALL = """count(*) AS n, count(price) AS n_price, round(sum(price), 2) AS total, round(avg(price), 4) AS mean,
min(price) AS low, max(price) AS high, count(DISTINCT cust) AS custs"""


def _all(df) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("n_price"), F.round(F.sum("price"), 2).alias("total"), F.round(F.avg("price"), 4).alias("mean"),
        F.min("price").alias("low"), F.max("price").alias("high"), F.count_distinct("cust").alias("custs"),
    )


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem")
def agg_global(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(f"SELECT {_ALL} FROM ({_HOLES}) h")
def agg_all_functions(t: Tables) -> DataFrame:
    return _all(holes(t))


@query(f"SELECT cust, {_ALL} FROM ({_HOLES}) h GROUP BY cust")
def agg_null_group(t: Tables) -> DataFrame:
    return _all(holes(t).groupBy("cust"))


@query(f"SELECT {_ALL} FROM ({_HOLES}) h WHERE o_orderkey < 0")
def agg_empty_global(t: Tables) -> DataFrame:
    return _all(holes(t).where("o_orderkey < 0"))


@query(f"SELECT cust, {_ALL} FROM ({_HOLES}) h WHERE o_orderkey < 0 GROUP BY cust")
def agg_empty_group(t: Tables) -> DataFrame:
    return _all(holes(t).where("o_orderkey < 0").groupBy("cust"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS custs FROM orders GROUP BY o_orderstatus")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("custs"))


@query("SELECT count(*) AS pairs FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) d")
def agg_count_distinct_multi(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_distinct("l_partkey", "l_suppkey").alias("pairs"))


@query("SELECT l_returnflag, round(sum(DISTINCT l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag")
def agg_sum_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum_distinct("l_quantity"), 2).alias("qty"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def agg_multi_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("supps"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def agg_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 15")


@query("SELECT cast(extract(year FROM o_orderdate) AS int) AS y, substring(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_group_expr(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey")
def agg_first_last(t: Tables) -> DataFrame:
    """First and last need an order to be defined; the order is the key's."""
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_totalprice", "o_orderkey").alias("first_price"), F.max_by("o_totalprice", "o_orderkey").alias("last_price"))


@query("SELECT o_orderkey, first(o_custkey) AS one, last(o_orderdate) AS at FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def agg_first_last_constant(t: Tables) -> DataFrame:
    """Of what is the same in a whole group."""
    both = t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"))
    return both.groupBy("o_orderkey").agg(F.first("o_custkey").alias("one"), F.last("o_orderdate").alias("at"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_discount = 0), 4) AS tax FROM lineitem GROUP BY l_returnflag")
def agg_filter(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(c("l_quantity") > 25).alias("big"), F.round(F.sum(F.when(c("l_discount") == 0, c("l_tax"))), 4).alias("tax"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_type").distinct()


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def drop_duplicates(t: Tables) -> DataFrame:
    return t.customer.dropDuplicates(["c_nationkey", "c_mktsegment"]).select("c_nationkey", "c_mktsegment")


# ------------------------------------------------------------------ sort and limit


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def sort_asc(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort_desc(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_acctbal").orderBy(c("c_acctbal").desc(), "c_custkey")


@query("SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def sort_multi(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_size", "p_partkey").orderBy("p_brand", c("p_size").desc(), "p_partkey")


@query(f"SELECT o_orderkey, price FROM ({_HOLES}) h ORDER BY price DESC NULLS FIRST, o_orderkey LIMIT 500")
def sort_nulls(t: Tables) -> DataFrame:
    return holes(t).select("o_orderkey", "price").orderBy(c("price").desc_nulls_first(), "o_orderkey").limit(500)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def sort_within_partitions(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def repartition_by_range(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").repartitionByRange("o_totalprice").coalesce(2)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def topk(t: Tables) -> DataFrame:
    order = (c("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey")
    return t.lineitem.orderBy(*order).limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40")
def limit_total_order(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(40)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
def limit_offset(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(30).limit(20)


@query("SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").limit(0)


@query("SELECT r_regionkey FROM region ORDER BY r_regionkey DESC LIMIT 2")
def tail_rows(t: Tables) -> DataFrame:
    """The last rows of an order, through the driver: a number of rows that the caller gives."""
    return t.spark.createDataFrame(t.region.select("r_regionkey").orderBy("r_regionkey").tail(2), "r_regionkey int")


for _name, _limit in (("limit_sum", "2 + 1"), ("limit_cast", "CAST('4' AS INT)")):
    CATALOGUE.text(_name, f"SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT {_limit}")


@query("SELECT n_nationkey FROM nation")
def limit_all(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("nation")
    return t.spark.sql("SELECT n_nationkey FROM nation LIMIT ALL")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def repartition_by_key(t: Tables) -> DataFrame:
    """An aggregation over rows dealt by its key needs no second exchange."""
    return t.orders.select("o_custkey").repartition("o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name FROM part")
def coalesce_partitions(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name").repartition(6).coalesce(2)


# ------------------------------------------------------------------ set operations

# Over every row of customer and supplier.
_A, _B = "SELECT c_nationkey AS k, cast(floor(c_acctbal / 1000) AS BIGINT) AS b FROM customer", "SELECT s_nationkey AS k, cast(floor(s_acctbal / 1000) AS BIGINT) AS b FROM supplier"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.select(c("c_nationkey").alias("k"), F.floor(c("c_acctbal") / 1000).alias("b")), t.supplier.select(c("s_nationkey").alias("k"), F.floor(c("s_acctbal") / 1000).alias("b"))


for _name, _word in (("union_all", "unionAll"), ("intersect", "intersect"), ("except", "subtract"), ("intersect_all", "intersectAll"), ("except_all", "exceptAll")):
    query(f"{_A} {_name.replace('_', ' ').upper()} {_B}", _name)(lambda t, w=_word: getattr(_sides(t)[0], w)(_sides(t)[1]))


@query(f"{_A} UNION ALL {_B} UNION ALL SELECT n_nationkey AS k, 0 AS b FROM nation")
def union_all_three(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.union(b).union(t.nation.select(c("n_nationkey").alias("k"), F.lit(0).alias("b")))


@query(f"{_A} UNION {_B}")
def union_distinct(t: Tables) -> DataFrame:
    a, b = _sides(t)
    return a.union(b).distinct()


@query("SELECT c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def union_by_name(t: Tables) -> DataFrame:
    swapped = t.supplier.select(c("s_nationkey").alias("nation"), c("s_suppkey").alias("id"))
    return t.customer.select(c("c_custkey").alias("id"), c("c_nationkey").alias("nation")).unionByName(swapped)


# ------------------------------------------------------------------ beyond parity: windows, grouping sets, generators, samples


@query("SELECT o_orderkey, cast(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS int) AS rk, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS int) AS rn FROM orders")
def window_rank(t: Tables) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", F.rank().over(by.orderBy(c("o_totalprice").desc())).alias("rk"), F.row_number().over(by.orderBy("o_orderkey")).alias("rn"))


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")
def window_lag_lead(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3 FROM events")
def window_frame(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return t.events.select("event_id", F.round(F.sum("value").over(w), 4).alias("last3"))


for _kind in ("cube", "rollup"):
    query(f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY {_kind}(l_returnflag, l_linestatus)", _kind)(
        lambda t, k=_kind: getattr(t.lineitem, k)("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    )
CATALOGUE.text("grouping_sets", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def lateral_view_explode(t: Tables) -> DataFrame:
    t.part.createOrReplaceTempView("part")
    return t.spark.sql("SELECT p_partkey, word FROM part LATERAL VIEW explode(split(p_name, ' ')) w AS word")


@query()
def sample(t: Tables) -> DataFrame:
    return t.orders.sample(0.1, 5).select("o_orderkey")


@query("SELECT o_orderkey, 1 AS n FROM orders")
def random_split(t: Tables) -> DataFrame:
    """The parts of a random split hold every row once."""
    a, b = t.orders.randomSplit([0.3, 0.7], 5)
    return a.union(b).groupBy("o_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
