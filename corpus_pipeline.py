"""Corpus pipeline: from raw documents to records in training order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from joust.llm import decontam, mixing, order, quality, simhash
from joust.llm.common import stored, table

STAGES = [
    ("quality classifier", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontam.stage),
    ("mixing to target weights", mixing.stage),
    ("token output", order.stage),
]

#: No SQL form: a trained model, XXH64 and a byte-pair vocabulary take part. The tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
