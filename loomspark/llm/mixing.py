"""Mixing sources to target weights by systematic sampling.

Each source has a target in words. A document's expected copies are its source's target over its source's size; the
expected copies are prefix-summed within the source, one random offset is added, and a document is emitted once for
each integer boundary that its step crosses. Documents stand in falling order of size, so the words taken differ
from the target by less than the source's largest document.

Nulls: the null source is a source (the last in order); a null or blank text has size 0, is sampled like any other
and takes 0 words. Ties are broken by doc_id, and, where a text is
there, by its digest; repeated rows are rows of their own. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import WORD, doc_key, materialize, positions, stage

#: Weights of the sources in code-point order, repeated in turn.
CYCLE = (1, 2, 3)
#: No source, and so no document, is taken more often than this.
MOST = 3


def with_size(docs: DataFrame, name: str = "size") -> DataFrame:
    return docs.withColumn(name, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sized: DataFrame, cycle: Sequence[int] = CYCLE, most: int = MOST) -> DataFrame:
    """Rows (source, source_size, target): the total shared by weight, no source over ``most`` times its size.

    What a stopped source can't take is shared again by weight among the others until none is above: the share per
    unit of weight only rises, so each round stops more sources or is the last. Only that number is on the driver.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(sizes, [], [F.col("source").asc_nulls_last()], "_llm_rank")
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    ranked = materialize(ranked.withColumn("_llm_w", F.element_at(weights, (F.col("_llm_rank") % len(cycle) + 1).cast("int"))), "sources")
    stop, weight = F.col("source_size") * most, F.col("_llm_w")
    first = ranked.agg(F.sum("source_size"), F.sum(weight)).first()
    share, stopped = (first[0] / first[1] if first[1] else 0.0), -1
    while True:
        over = weight * F.lit(float(share)) > stop
        n, taken, left = ranked.agg(F.count_if(over), F.sum(F.when(over, stop)), F.sum(F.when(~over, weight))).first()
        if not n or n == stopped or not left:
            break
        stopped, share = n, (first[0] - taken) / left
    target = F.least(stop.cast("double"), weight * F.lit(float(share)))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, cycle: Sequence[int] = CYCLE, most: int = MOST, seed: int = 17) -> DataFrame:
    """The input's columns with size, source_size, target and copies (how often the mix takes the row; may be 0).

    Input needs doc_id, source and size (see ``with_size``); columns named like the output's are replaced.
    """
    docs = docs.drop("source_size", "target", "copies")
    goal = targets(docs, cycle, most).select(F.col("source").alias("_llm_source"), "source_size", "target")
    ties = [doc_key()] if "text" in docs.columns else []
    placed = positions(docs, ["source"], [F.col("size").desc(), F.col("doc_id"), *ties], "_llm_k")
    out = placed.join(goal, F.col("source").eqNullSafe(F.col("_llm_source")))
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit("(null)"))))
    offset = F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    step = lambda k: F.floor(rate * k + offset)
    copies = F.least(step(F.col("_llm_k") + 1) - step(F.col("_llm_k")), F.lit(most)).cast("long")
    return out.withColumn("copies", copies).drop("_llm_k", "_llm_source")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_size(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("text")
    out = mix(materialize(docs, "sized"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it."""
    sized = mix(with_size(docs.select("doc_id", "text", "lang", "source", "n_chars")))
    return sized.withColumn("_llm_i", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select("doc_id", "text", "lang", "source", "n_chars")


#: Sources in rising order of the share at which they stop: those before the first whose share isn't reached are full.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM sized GROUP BY source
), filled AS (
  SELECT *, {MOST} * source_size AS stop, sum({MOST} * source_size) OVER o AS stopped, sum(w) OVER o AS used,
         sum(source_size) OVER () AS total, sum(w) OVER () AS weights,
         count(*) OVER o AS before
  FROM sources WINDOW o AS (ORDER BY {MOST} * source_size / CAST(w AS DOUBLE), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shares AS (
  SELECT *, (total - coalesce(stopped, 0)) / CAST(weights - coalesce(used, 0) AS DOUBLE) AS share FROM filled
), goal AS (
  SELECT source, source_size, least(CAST(stop AS DOUBLE), w * (SELECT arg_min(share, before) FROM shares WHERE w * share <= stop)) AS target FROM shares
), placed AS (
  SELECT d.*, g.source_size, g.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) - 1 AS k,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('17/' || coalesce(d.source, '(null)')), 1, 5) AS BIGINT) / CAST(1048576 AS DOUBLE) AS u
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(least(floor(rate * (k + 1) + u) - floor(rate * k + u), {MOST}) * size AS BIGINT) AS taken
FROM placed
"""
