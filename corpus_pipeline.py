"""Corpus pipeline: quality rules, near-duplicate join, substring dedup, decontamination, packing.

`STAGES` lists (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame, which `run` writes as Parquet and reads again as the docs of the
next stage.  All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcast.llm import stages
from loomcast.sources.lineage import materialize

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("substring_dedup", stages.substring_dedup),
    ("decontamination", stages.decontamination),
    ("best_fit_packing", stages.best_fit_packing),
]

# tokenizer ids and latent semantic search are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
