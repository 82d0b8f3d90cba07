"""The choice view over order tables: one row a line whose supplier and customer come from different nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import PAIR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choices(spark: SparkSession, sf_dir: str, trials: bool = False) -> DataFrame:
    """trials: number the rows of a cell too, which costs a window over all of them."""
    t = lambda name: table(spark, sf_dir, name)
    line, nation = t("lineitem"), t("nation").select("n_nationkey", "n_name", "n_regionkey")
    x = line.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).where("s_nationkey <> c_nationkey")
    x = x.withColumn("ak", F.least("s_nationkey", "c_nationkey")).withColumn("bk", F.greatest("s_nationkey", "c_nationkey")).withColumn("a_first", F.col("s_nationkey") < F.col("c_nationkey"))
    name = lambda key, to: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(to), F.col("n_regionkey").alias(f"{to}_region"))
    x = x.join(name("ak", "a"), "ak").join(name("bk", "b"), "bk")
    offered = F.col("l_returnflag") != "N"
    answered = F.col("l_discount") < 0.095
    none = answered & offered & (F.col("l_linenumber") == 7)
    wins = F.col("l_quantity") <= F.lit(50.0) * (F.col("ak") + 1) / (F.col("ak") + F.col("bk") + 2) + F.when(F.col("a_first"), 3.0).otherwise(-3.0)
    lead = F.when(offered & (F.col("l_partkey") % 3 == 0), 1).otherwise(0)
    cols = {
        "model": F.col("c_mktsegment"),
        "qvar": F.when(F.col("l_linestatus") == "O", "increase").otherwise("preservation"),
        "object": F.when(F.col("o_orderkey") % 2 == 0, "self").otherwise("ai_assistant"),
        "subject": F.when(F.col("l_tax") < 0.04, "self").otherwise("developers"),
        "no_pref_offered": offered,
        "a": F.col("a"),
        "b": F.col("b"),
        "a_construct": F.concat(F.lit("R"), F.col("a_region")),
        "n_options": F.when(offered, 3).otherwise(2),
        "answered": answered,
        "refused": ~answered & (F.col("l_partkey") % 2 == 0),
        "chose_none": none,
        "chose_a": answered & ~none & wins,
        "chose_b": answered & ~none & ~wins,
        "pos_a": lead + F.when(F.col("a_first"), 1).otherwise(2),
        "pos_b": lead + F.when(F.col("a_first"), 2).otherwise(1),
        "pos_none": F.when(offered, F.when(lead == 1, 1).otherwise(3)),
    }
    keep = line.columns if trials else []
    x = x.select(*[c.alias(k) for k, c in cols.items()], *keep)
    x = x.withColumn("chosen_position", F.when(F.col("chose_a"), F.col("pos_a")).when(F.col("chose_b"), F.col("pos_b")).when(F.col("chose_none"), F.col("pos_none")))
    if trials:
        x = x.withColumn("trial", F.row_number().over(Window.partitionBy(*PAIR).orderBy(*line.columns)) - 1).drop(*line.columns)
    return x


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, construct: a row an entity."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("construct"))


#: The model dimension: alias, family, release date, parameters in billions (null: not published).
MODELS = (("AUTOMOBILE", "wheels", "2024-03-01", 7.0), ("BUILDING", "walls", "2024-06-15", 13.0), ("FURNITURE", "walls", "2024-09-30", 34.0), ("HOUSEHOLD", "walls", "2025-01-20", None), ("MACHINERY", "wheels", "2025-04-05", 70.0))

GENERATIONS = {"AUTOMOBILE": "first", "BUILDING": "first", "FURNITURE": "second", "HOUSEHOLD": "second", "MACHINERY": "second"}


def models(spark: SparkSession) -> DataFrame:
    x = spark.createDataFrame([(*m, GENERATIONS[m[0]]) for m in MODELS], "model string, family string, released string, params_b double, generation string")
    return x.withColumn("released", F.to_date("released"))
