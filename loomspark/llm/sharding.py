"""Hierarchical weighted hash tree: region, rack and shard levels by weighted hash draws.

Every key descends from the root. At a node each child draws ``-ln(u) / weight`` with ``u`` in (0, 1) hashed from
the key and the child's path; the smallest draw wins, so a child gets its weight's share. A changed weight changes
only that child's draw: keys move only into or out of subtrees whose weights change, the rest stays. A tree grows by
a region of its own for a new shard, so that rows move into the new shard and nowhere else.

Only DataFrame functions are used. Nulls: a null key is a key of its own (the tree decides for it like for any
other); a null text has size 8 and no checksum. Repeated rows go to the same shard with slots of their own. An empty
table gives an empty result. Columns of the input other than those read are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import materialize, positions


@dataclass(frozen=True)
class Tree:
    """Regions of racks of shard weights. Shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def balanced(regions: int = 2, racks: int = 3, shards: int = 4) -> Tree:
        return Tree(((((1.0,) * shards),) * racks,) * regions)

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: rows move only into it."""
        return Tree((*self.regions, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def draw(key: str, node: str, weight: float) -> str:
    """SQL for a child's draw: 52 bits of MD5 over key and node, as an exponential variate of rate ``weight``."""
    bits = f"cast(conv(substr(md5(concat(coalesce(cast({key} as string), 'null'), '/{node}')), 1, 13), 16, 10) as double)"
    return f"(-ln(({bits} + 0.5D) / 4503599627370496D) / {float(weight)!r}D)"


def pick(draws: Sequence[str]) -> Column:
    """The place of the smallest draw, the first of equals."""
    array = f"array({', '.join(draws)})"
    return F.expr(f"cast(array_position({array}, array_min({array})) - 1 as int)")


def place(df: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """Add column ``name``: the shard of each row's key."""
    region, rack = f"_{name}_region", f"_{name}_rack"
    out = df.withColumn(region, pick([draw(key, f"r{i}", sum(map(sum, racks))) for i, racks in enumerate(tree.regions)]))
    racks = shards = None
    base = 0
    for i, region_racks in enumerate(tree.regions):
        choice = pick([draw(key, f"r{i}k{j}", sum(weights)) for j, weights in enumerate(region_racks)])
        racks = F.when(F.col(region) == i, choice) if racks is None else racks.when(F.col(region) == i, choice)
        for j, weights in enumerate(region_racks):
            leaf = pick([draw(key, f"r{i}k{j}s{k}", w) for k, w in enumerate(weights)]) + F.lit(base)
            here = (F.col(region) == i) & (F.col(rack) == j)
            shards = F.when(here, leaf) if shards is None else shards.when(here, leaf)
            base += len(weights)
    return out.withColumn(rack, racks).withColumn(name, shards.cast("int")).drop(region, rack)


def shard(docs: DataFrame, tree: Tree, key: str = "doc_id", order: Sequence[Column] | None = None) -> DataFrame:
    """The input's columns with shard, grown_shard (one shard more) and slot: gapless from 0 in each shard.

    Slots are numbered over a range partitioning by shard and key, so a shard may span any number of tasks.
    """
    placed = place(place(docs, key, tree, "shard"), key, tree.grow(), "grown_shard")
    placed = materialize(placed, "placed")
    return positions(placed, ["shard"], order or [F.col(key)], "slot")


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    out = shard(docs, Tree.balanced(), order=[F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def oracle(tree: Tree) -> str:
    """The same law as SQL for an independent engine: draws by MD5, CRC-32 by its table, slots by a window."""

    def draw_sql(node: str, weight: float) -> str:
        bits = f"CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/{node}'), 1, 13) AS BIGINT) AS DOUBLE)"
        return f"(-ln(({bits} + 0.5) / 4503599627370496.0) / {float(weight)!r})"

    def first(nodes: list[tuple[str, float]]) -> str:
        draws = ", ".join(draw_sql(*n) for n in nodes)
        return f"list_position([{draws}], list_min([{draws}])) - 1"

    def levels(t: Tree, name: str) -> str:
        base, cases = 0, []
        for i, racks in enumerate(t.regions):
            inner = []
            for j, weights in enumerate(racks):
                inner.append(f"WHEN {j} THEN {base} + {first([(f'r{i}k{j}s{k}', w) for k, w in enumerate(weights)])}")
                base += len(weights)
            cases.append(f"WHEN {i} THEN CASE {first([(f'r{i}k{j}', sum(ws)) for j, ws in enumerate(racks)])} {' '.join(inner)} END")
        return f"CAST(CASE {first([(f'r{i}', sum(map(sum, r))) for i, r in enumerate(t.regions)])} {' '.join(cases)} END AS INTEGER) AS {name}"

    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab
), hashed AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size,
         CASE WHEN text = '' THEN CAST(0 AS BIGINT) WHEN text IS NOT NULL THEN xor(list_reduce(list_transform(range(strlen(text)),
           lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) END AS text_crc32
  FROM documents, crc
), placed AS (
  SELECT *, {levels(tree, "shard")}, {levels(tree.grow(), "grown_shard")} FROM hashed
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""


ORACLE = oracle(Tree.balanced())
