"""Incremental ingestion of growing result folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.choices import complete_blocks, coverage, from_records, pair_estimates
from ..schemas import RECORD
from ..sources.records import deduplicated, defaulted


def records(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return defaulted(spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(path))


def running_estimates(spark: SparkSession, path: str) -> DataFrame:
    """Pair estimates over all files seen so far (complete mode)."""
    return pair_estimates(from_records(records(spark, path)))


def merge_into(store: str):
    """foreachBatch: append a batch with its number; latest() then applies the error-aware rule over all batches. An
    append is idempotent by batch number, so a replayed batch counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("seq", F.struct(F.lit(number).cast("bigint").alias("batch"), F.monotonically_increasing_id().alias("row"))).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return write


def latest(spark: SparkSession, store: str, key: list[str]) -> DataFrame:
    return deduplicated(spark.read.parquet(store).drop("batch"), key).drop("seq")


def complete_choices(spark: SparkSession, store: str, key: list[str], n_pairs: int) -> DataFrame:
    """Choices of a store that is still being written, without the blocks that are not complete yet."""
    x = from_records(latest(spark, store, key))
    return complete_blocks(x, coverage(x, n_pairs))


def counts_into(store: str, key: str):
    """foreachBatch: a batch's counts by key, a table of their own; counted() adds the batches up. Neither the stream's
    state nor its result is kept in memory, and a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return write


def counted(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).groupBy("key").agg(F.sum("n").alias("n"))
