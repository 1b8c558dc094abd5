"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tambon.llm import decontaminate, language_id, near_dup, packing, quality_lm
from tambon.llm.shared import read_table, stored

STAGES = [
    ("language_id", language_id.keep),
    ("quality_classifier", quality_lm.keep),
    ("minhash_near_dedup", near_dup.keep),
    ("benchmark_decontamination", decontaminate.keep),
    ("best_fit_packing", packing.pack_stage),
]

#: SQL can't express models, signatures or tokenizers. The tests hold near-duplicates against brute force and the language model against its formula, and run every stage on odd and empty tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
