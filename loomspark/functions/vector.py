"""Vector functions over ``array<double>`` columns, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.catalogue import Catalogue, Tables

CATALOGUE = Catalogue()
query = CATALOGUE.query


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length; null if either vector is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: _zero(x * y)), F.lit(0.0), lambda s, x: s + x)


def vector_add(a: Column, b: Column) -> Column:
    """Sum by element, the shorter padded with zeros; null if either vector is null."""
    return F.zip_with(a, b, lambda x, y: _zero(x) + _zero(y))


def rounded(x: Column, digits: int) -> Column:
    """SQL's round of a double: halves away from zero; what is below zero and comes to nothing is -0.0, as -0.0 itself.

    Spark's own takes the sign from such numbers. Where the scaled number isn't finite, it stays as it is.
    """
    scaled = F.abs(x) * F.lit(10.0**digits)
    return F.when(scaled < float("inf"), F.round(scaled) / F.lit(10.0**digits) * F.signum(x)).otherwise(x)


def vector_multiply(v: Column, k: Column) -> Column:
    return F.transform(v, lambda x: x * k)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def closest_point(p: Column, centres: Column) -> Column:
    """The centre nearest to ``p`` by squared distance; the first of equally near ones."""
    start = F.struct(F.lit(float("inf")).alias("d"), F.element_at(centres, 1).alias("c"))

    def nearer(best: Column, centre: Column) -> Column:
        d = squared_distance(p, centre)
        return F.when(d < best["d"], F.struct(d.alias("d"), centre.alias("c"))).otherwise(best)

    return F.aggregate(centres, start, nearer, lambda best: best["c"])


def vector_sum(df: DataFrame, keys: list[str], vector: str, name: str) -> DataFrame:
    """Sum of vectors by group: nulls are skipped, shorter ones padded, a group without any gives an empty array.

    Elements are summed by position with map-side combining, so a group of any size needs no more than one row a
    position; then the positions of a group (its vectors' length) are put in order.
    """
    flat = df.select(*keys, F.posexplode_outer(vector).alias("_pos", "_x"))
    sums = flat.groupBy(*keys, "_pos").agg(F.sum(_zero(F.col("_x"))).alias("_x"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_x"))))
    return sums.groupBy(*keys).agg(F.transform(pairs, lambda s: s["_x"]).alias(name))


def embeddings(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


_V = "(SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"SELECT vec_id, round(list_dot_product(v, list_reverse(v)), 6) AS d FROM {_V} e")
def vec_dot(t: Tables) -> DataFrame:
    return embeddings(t).select("vec_id", rounded(dot(F.col("v"), F.reverse("v")), 6).alias("d"))


@query(f"SELECT vec_id, list_transform(list_zip(v, list_reverse(v)), lambda p: round(p[1] + p[2], 6)) AS s FROM {_V} e")
def vec_add(t: Tables) -> DataFrame:
    return embeddings(t).select("vec_id", F.transform(vector_add(F.col("v"), F.reverse("v")), lambda x: rounded(x, 6)).alias("s"))


@query(f"SELECT vec_id, list_transform(v, lambda x: round(x * label, 6) + 0.0) AS s FROM {_V} e")
def vec_scale(t: Tables) -> DataFrame:
    return embeddings(t).select("vec_id", F.transform(vector_multiply(F.col("v"), F.col("label").cast("double")), lambda x: F.round(x, 6)).alias("s"))


@query(f"SELECT label, array_agg(s ORDER BY pos) AS total FROM (SELECT label, pos, round(sum(x), 4) AS s FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {_V} e) u GROUP BY label, pos) w GROUP BY label")
def vec_sum(t: Tables) -> DataFrame:
    summed = vector_sum(embeddings(t), ["label"], "v", "total")
    return summed.select("label", F.transform("total", lambda x: rounded(x, 4)).alias("total"))


_CENTRES = [[1.0] + [0.0] * 63, [0.0] * 63 + [1.0], [-1.0] + [0.0] * 63]


@query(f"SELECT vec_id, CASE WHEN v[1] >= v[64] AND v[1] >= -v[1] THEN 1.0 WHEN v[64] >= -v[1] THEN 0.0 ELSE -1.0 END::DOUBLE AS first FROM {_V} e")
def vec_closest(t: Tables) -> DataFrame:
    """With unit centres the nearest is the one of the largest inner product."""
    centres = F.array(*[F.array(*map(F.lit, m)) for m in _CENTRES])
    return embeddings(t).select("vec_id", F.element_at(closest_point(F.col("v"), centres), 1).alias("first"))
