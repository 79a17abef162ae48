"""Queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import jaccard, mixing, sharding, topk
from loomspark.llm.ann import op6_neighbours
from loomspark.llm.dac import op9_tokens
from loomspark.llm.jaccard import op10_jaccard
from loomspark.llm.langid import op2_langid
from loomspark.llm.mixing import op1_mix
from loomspark.llm.packing import op7_pack
from loomspark.llm.quality import op8_quality
from loomspark.llm.sharding import op4_shard
from loomspark.llm.substring import op3_substring



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of corpus_pipeline.py at the repository's top."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_mix": op1_mix,
    "op2_langid": op2_langid,
    "op3_substring": op3_substring,
    "op4_shard": op4_shard,
    "op5_topk": topk.op5_topk,
    "op6_neighbours": op6_neighbours,
    "op7_pack": op7_pack,
    "op8_quality": op8_quality,
    "op9_tokens": op9_tokens,
    "op10_jaccard": op10_jaccard,
}

ORACLE = {
    "op1_mix": mixing.ORACLE,
    "op4_shard": sharding.ORACLE,
    "op5_topk": topk.ORACLE,
    "op10_jaccard": jaccard.ORACLE,
}
