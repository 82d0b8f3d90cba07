"""Expressions that keep NULL for what is undefined and never make a NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT = 1e-12


def ratio(a, b) -> Column:
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def share(flag: Column) -> Column:
    """Mean of a boolean over rows where it is not null."""
    return F.avg(flag.cast("double"))


def pearson(x: str, y: str, least: int = 3) -> Column:
    """Aggregate: correlation over rows where both are set; null under `least` rows or without variance."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    n = F.count(a).cast("double")
    va, vb = n * F.sum(a * a) - F.sum(a) * F.sum(a), n * F.sum(b * b) - F.sum(b) * F.sum(b)
    return F.when((n >= least) & (va > FLAT) & (vb > FLAT), F.try_divide(n * F.sum(a * b) - F.sum(a) * F.sum(b), F.sqrt(F.greatest(va, F.lit(FLAT)) * F.greatest(vb, F.lit(FLAT)))))


def mean_rank(value: str, keys: list[str], descending: bool = False) -> Column:
    """Average rank within keys; null values have no rank (filter them out before). Values equal to nine places tie,
    so that the order of a floating-point sum does not make ranks."""
    by, v = Window.partitionBy(*keys), F.round(value, 9)
    return F.rank().over(by.orderBy(v.desc() if descending else v.asc())) + (F.count("*").over(Window.partitionBy(*keys, v)) - 1) / F.lit(2.0)


def spearman_brown(r: Column) -> Column:
    return F.when(r > -1, 2 * r / (1 + r))


def hash32(*parts) -> Column:
    """The first eight hex digits of md5 over the parts joined by a pipe, as a number: equal on every engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def interval(x: str, level: float = 95.0) -> tuple[Column, Column]:
    """Exact percentiles, linear between order statistics, ignoring nulls. Draws count to nine places, so that the
    order of a floating-point sum does not show in a percentile."""
    tail, v = (100 - level) / 200, F.round(x, 9)
    return F.percentile(v, F.lit(tail)), F.percentile(v, F.lit(1 - tail))


def two_sided(x: str, null: float = 0.0) -> Column:
    """Bootstrap p, floored at one over the number of draws; null without draws."""
    n = F.count(x)
    v = F.round(x, 12)
    low = F.least(F.count_if(v <= null), F.count_if(v >= null))
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(ratio(2.0 * low, n), ratio(F.lit(1.0), n))))


def step_up(df: DataFrame, p: str, keys: list[str], out: str = "q", tie: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg q-values within keys; null p have null q and do not count. For groups of a row an entity."""
    by = Window.partitionBy(*keys, F.col(p).isNull())
    x = df.withColumn("__at", F.row_number().over(by.orderBy(F.col(p), *(tie or []))))
    x = x.withColumn("__raw", F.col(p) * F.count("*").over(by) / F.col("__at"))
    # from the greatest p down: a frame that ends with its group is computed anew for each row
    q = F.min("__raw").over(by.orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), q))).drop("__raw", "__at")


#: Steps of p in a doubling.
STEPS = 64


def step_up_rows(df: DataFrame, p: str, keys: list[str], out: str = "q") -> DataFrame:
    """The same for groups of any number of rows, none of which is one task's. Equal p have equal q, whatever their order,
    so distinct values are ranked, step by step of their logarithm (of uniform p a step holds a hundredth at most); what
    lies below and above a step is carried over in a row a step."""
    names = [f"__k{i}" for i in range(len(keys))]
    same = df.where(F.col(p).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    same = same.withColumn("__step", F.when(F.col("__p") > 0, F.floor(-STEPS * F.log2("__p"))).otherwise(2**62))

    def carried(x: DataFrame, steps: DataFrame, *values: str) -> DataFrame:
        right = steps.select(*[F.col(c).alias(f"{c}_") for c in [*names, "__step"]], *values)
        at = F.col("__step") == F.col("__step_")
        for n in names:
            at = at & F.col(n).eqNullSafe(F.col(f"{n}_"))
        return x.join(right, at).drop(*[f"{c}_" for c in [*names, "__step"]])

    every, one = Window.partitionBy(*names), Window.partitionBy(*names, "__step")
    steps = same.groupBy(*names, "__step").agg(F.sum("__n").alias("__in"))
    below = F.coalesce(F.sum("__in").over(every.orderBy(F.desc("__step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = carried(same, steps.withColumn("__below", below).withColumn("__all", F.sum("__in").over(every)), "__below", "__all")
    rank = F.col("__below") + F.sum("__n").over(one.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("__raw", F.col("__p") * F.col("__all") / rank)
    above = F.min("__least").over(every.orderBy("__step").rowsBetween(Window.unboundedPreceding, -1))
    least = x.groupBy(*names, "__step").agg(F.min("__raw").alias("__least")).withColumn("__above", above)
    x = carried(x, least, "__above")
    own = F.min("__raw").over(one.orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0))
    x = x.select(*names, "__p", F.least(F.lit(1.0), own, F.col("__above")).alias(out))
    at = F.col(p) == F.col("__p")
    for k, n in zip(keys, names):
        at = at & F.col(k).eqNullSafe(F.col(n))
    return df.join(x, at, "left").drop(*names, "__p")
