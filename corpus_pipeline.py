"""A corpus pipeline: quality, near copies, repeated passages, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.common import delete, scratch_path
from loomspark.llm.jaccard import jaccard_stage
from loomspark.llm.mixing import mix_stage
from loomspark.llm.packing import pack_stage
from loomspark.llm.quality import quality_stage
from loomspark.llm.substring import substring_stage

STAGES = [
    ("quality", quality_stage),
    ("near_copies", jaccard_stage),
    ("substrings", substring_stage),
    ("mixture", mix_stage),
    ("packing", pack_stage),
]

#: The stages' hashes, models and local search have no SQL; each is tested against brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage has written beside its output goes when the next one starts, its output when the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, [before])
        before = path
    return docs
