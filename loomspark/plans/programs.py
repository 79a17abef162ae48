"""Iterative and statistical programs: the model stays on the driver, each round is one aggregation over the data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import sqrt

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.catalogue import Catalogue, Tables
from loomspark.functions.vector import closest_point, dot, embeddings, rounded
from loomspark.scratch import scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query
c = F.col


def java_doubles(seed: int) -> Iterator[float]:
    """The doubles of the 48-bit linear congruential generator that the Java library specifies."""
    mask = (1 << 48) - 1
    state = (seed ^ 0x5DEECE66D) & mask
    while True:
        parts = []
        for bits in (26, 27):
            state = (state * 0x5DEECE66D + 0xB) & mask
            parts.append(state >> (48 - bits))
        yield ((parts[0] << 27) + parts[1]) / (1 << 53)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Z-scores of ``columns`` by mean and population deviation, sqrt(E[x^2] - E[x]^2)."""
    stats = df.agg(*[f(x).alias(f"_{n}_{x}") for x in columns for n, f in (("m", F.avg), ("s", lambda x: F.sqrt(F.avg(c(x) * c(x)) - F.avg(x) * F.avg(x))))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumns({x: (c(x) - c(f"_m_{x}")) / c(f"_s_{x}") for x in columns}).drop(*stats.columns)


def prepare(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """Features in array x, the label in y."""
    x = F.array(*[c(n).cast("double") for n in columns]).alias("x")
    return df.select(x, *([c(label).cast("double").alias("y")] if label else []))


def logistic(x: Column, w: Sequence[float]) -> Column:
    return 1.0 / (1.0 + F.exp(-dot(x, literal(w))))


def logreg_fit(data: DataFrame, dimensions: int, rate: float, iterations: int, seed: int = 42) -> list[float]:
    """Gradient ascent from weights uniform in [-1, 1)."""
    draws = java_doubles(seed)
    w = [2 * next(draws) - 1 for _ in range(dimensions)]
    for _ in range(iterations):
        error = c("y") - logistic(c("x"), w)
        step = data.select("x", error.alias("e")).agg(*[F.sum(c("x")[i] * c("e")) for i in range(dimensions)]).first()
        w = [a + rate * (g or 0.0) for a, g in zip(w, step, strict=True)]
    return w


def logreg_label(w: Sequence[float], data: DataFrame) -> DataFrame:
    """y_hat is the probability cut to an integer, as specified; ``probability`` has it whole."""
    return data.withColumn("probability", logistic(c("x"), w)).withColumn("y_hat", c("probability").cast("int"))


def kmeans_fit(points: DataFrame, k: int, tolerance: float, order: str, rounds: int = 50) -> list[list[float]]:
    """Lloyd's iterations from the first k points by ``order``, until the centres move by ``tolerance`` at most or for
    so many rounds; a centre without points is lost. Each round is one aggregation, by centre, of a count and sums."""
    centres = [list(r[0]) for r in points.orderBy(order).limit(k).select("p").collect()]
    for _ in range(rounds):
        near = points.select(closest_point(c("p"), F.array(*map(literal, centres))).alias("centre"), "p")
        sums = near.groupBy("centre").agg(F.count(F.lit(1)), *[F.sum(c("p")[i]) for i in range(len(centres[0]))]).collect()
        moved = {tuple(r[0]): [x / r[1] for x in r[2:]] for r in sums}
        shift = sum(sqrt(sum((a - b) ** 2 for a, b in zip(old, new, strict=True))) ** 2 for old, new in moved.items())
        centres = [moved[tuple(m)] for m in centres if tuple(m) in moved]
        if shift <= tolerance:
            break
    return centres


def least_squares_sums(df: DataFrame, x1: str, x2: str, y: str) -> DataFrame:
    """The sums of the normal equations of y on x1 and x2."""
    pairs = {"x1x1": (x1, x1), "x1x2": (x1, x2), "x2x2": (x2, x2), "x1y": (x1, y), "x2y": (x2, y)}
    return df.agg(*[F.sum(c(a) * c(b)).alias(n) for n, (a, b) in pairs.items()])


def solve_two(sums: DataFrame) -> DataFrame:
    d = c("x1x1") * c("x2x2") - c("x1x2") * c("x1x2")
    return sums.select(((c("x1y") * c("x2x2") - c("x2y") * c("x1x2")) / d).alias("w1"), ((c("x2y") * c("x1x1") - c("x1y") * c("x1x2")) / d).alias("w2"))


#: Links in a partition.
LINKS = 1 << 20


def pagerank(edges: DataFrame, ranks: DataFrame | None = None, iterations: int = 1, parts: int | None = None) -> DataFrame:
    """Rows (id, rank): rank = 0.15 + 0.85 * sum of rank * weight over incoming edges (src, dst, weight).

    Without ``weight`` each vertex shares its rank equally among its edges; without ``ranks`` each begins with 1. A
    vertex without incoming edges leaves the table, as in the plain join. Edges are dealt by src into ``parts`` (the
    session's number if None) once and, for several rounds, kept on disk: a round moves a row a vertex to them and
    what they send, summed by partition, and is written to the shared folder.
    """
    spark, weighted = edges.sparkSession, "weight" in edges.columns
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain, edges = edges, edges.repartition(parts, "src")
    if iterations > 1:
        plain = edges = edges.persist(StorageLevel.DISK_ONLY)

    def written(df: DataFrame, tag: str) -> DataFrame:
        if iterations == 1:
            return df
        path = scratch(spark, tag)
        df.write.parquet(path)
        return spark.read.parquet(path)

    try:
        out = written(plain.groupBy(c("src").alias("id")).agg((F.lit(1.0) / F.count(F.lit(1))).alias("part")), "parts")
        for _ in range(iterations):
            here = out.withColumn("rank", F.lit(1.0)) if ranks is None else ranks if weighted else ranks.join(out, "id")
            share = c("rank") * c("weight") if weighted else c("share")
            here = here.select("id", c("rank") if weighted else (c("rank") * c("part")).alias("share")).repartition(parts, "id")
            ranks = edges.join(here.hint("shuffle_hash"), c("src") == c("id")).groupBy(c("dst").alias("id")).agg((F.sum(share) * 0.85 + 0.15).alias("rank"))
            ranks = written(ranks, "ranks")
    finally:
        if iterations > 1:
            edges.unpersist()
    return ranks


@query("""SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal
FROM customer, (SELECT avg(c_acctbal) AS m, sqrt(avg(c_acctbal * c_acctbal) - avg(c_acctbal) * avg(c_acctbal)) AS s FROM customer) v""", "normalize")
def normalize_query(t: Tables) -> DataFrame:
    return normalize(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", rounded(c("c_acctbal"), 6).alias("c_acctbal"))


@query("SELECT [p_size::DOUBLE, p_retailprice] AS x, (p_partkey % 2)::DOUBLE AS y FROM part", "prepare")
def prepare_query(t: Tables) -> DataFrame:
    return prepare(t.part.withColumn("label", c("p_partkey") % 2), ["p_size", "p_retailprice"], "label")


@query("""SELECT round(sum(l_quantity * l_quantity), 2) AS x1x1, round(sum(l_quantity * l_discount), 2) AS x1x2, round(sum(l_discount * l_discount), 2) AS x2x2,
round(sum(l_quantity * l_extendedprice), 0) AS x1y, round(sum(l_discount * l_extendedprice), 1) AS x2y FROM lineitem""")
def least_squares(t: Tables) -> DataFrame:
    digits = {"x1x1": 2, "x1x2": 2, "x2x2": 2, "x1y": 0, "x2y": 1}
    return least_squares_sums(t.lineitem, "l_quantity", "l_discount", "l_extendedprice").select(*[F.round(n, d).alias(n) for n, d in digits.items()])


@query("""SELECT round((b * xz - c * xy) / nullif(d, 0), 4) AS w2, round((xy * e - c * xz) / nullif(d, 0), 4) AS w1 FROM (
SELECT sum(l_quantity * l_quantity) AS b, sum(l_quantity * l_discount) AS c, sum(l_discount * l_discount) AS e,
sum(l_quantity * l_extendedprice) AS xy, sum(l_discount * l_extendedprice) AS xz,
sum(l_quantity * l_quantity) * sum(l_discount * l_discount) - sum(l_quantity * l_discount) * sum(l_quantity * l_discount) AS d FROM lineitem) s""")
def least_squares_fit(t: Tables) -> DataFrame:
    out = solve_two(least_squares_sums(t.lineitem, "l_quantity", "l_discount", "l_extendedprice"))
    return out.select(F.round("w1", 4).alias("w1"), F.round("w2", 4).alias("w2"))


def _edges(t: Tables) -> tuple[DataFrame, int]:
    """A link each way for every line of an order: customers have even ids, suppliers odd ones; parallel links stay.

    Also into how many partitions to deal them; their number is that of the lines at most, twice.
    """
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * t.lineitem.count() // LINKS))
    orders, lines = t.orders.select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey"), t.lineitem.select("l_orderkey", "l_suppkey").repartition(parts, "l_orderkey")
    a, b = c("o_custkey") * 2, c("l_suppkey") * 2 + 1
    ways = F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst")))
    return orders.join(lines, c("o_orderkey") == c("l_orderkey")).select(F.inline(ways)), parts


@query("""WITH p AS (SELECT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
e AS (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p),
w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS weight FROM e)
SELECT dst AS id, round(0.15 + 0.85 * sum(weight), 6) AS rank FROM w GROUP BY dst""")
def pagerank_step(t: Tables) -> DataFrame:
    edges, parts = _edges(t)
    return pagerank(edges, parts=parts).select("id", F.round("rank", 6).alias("rank"))


@query()
def pagerank_five(t: Tables) -> DataFrame:
    edges, parts = _edges(t)
    return pagerank(edges, iterations=5, parts=parts)


def _labelled(t: Tables) -> DataFrame:
    return embeddings(t).select("vec_id", c("v").alias("x"), (c("label") % 2).cast("double").alias("y"))


@query()
def logreg_train(t: Tables) -> DataFrame:
    w = logreg_fit(_labelled(t), 64, 0.1, 3)
    return t.spark.createDataFrame([(i, x) for i, x in enumerate(w)], "i int, w double")


@query()
def logreg_predict(t: Tables) -> DataFrame:
    data = _labelled(t)
    return logreg_label(logreg_fit(data, 64, 0.1, 2), data).select("vec_id", "probability", "y_hat")


@query()
def kmeans(t: Tables) -> DataFrame:
    found = kmeans_fit(embeddings(t).select("vec_id", c("v").alias("p")), 4, 0.01, "vec_id", 8)
    return t.spark.createDataFrame([(i, m) for i, m in enumerate(found)], "i int, centre array<double>")
