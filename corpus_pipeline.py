"""A corpus pipeline: quality rules, near-duplicates, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atril.llm import bpe, mixing, quality, simhash
from atril.llm.common import materialize

STAGES = [
    ("quality rules", quality.stage),
    ("near-duplicates", simhash.stage),
    ("mixing", mixing.stage),
    ("BPE", bpe.stage),
]

#: SimHash components, the trees and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
