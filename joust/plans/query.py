"""A named query: a plan, the columns of its result, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    """Reals are compared at six places. Both engines go through nine first, and there through a decimal in SQL, so
    that a tie at the sixth place is the same tie in both."""

    plan: Callable[[SparkSession, str], DataFrame]
    keys: str
    counts: str = ""
    reals: str = ""
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.plan(spark, sf_dir)
        return df.select(*[F.col(c) for c in self.keys.split()], *[F.col(c).cast("bigint").alias(c) for c in self.counts.split()], *[(F.round(F.round(F.col(c).cast("double"), 9), 6) + 0.0).alias(c) for c in self.reals.split()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = [*self.keys.split(), *(f"cast({c} as bigint) as {c}" for c in self.counts.split()), *(f"cast(round(cast({c} as decimal(38, 9)), 6) as double) + 0.0 as {c}" for c in self.reals.split())]
        head, sep, body = self.sql.rpartition("\n--\n")
        return f"{head}\nselect {', '.join(cols)} from (\n{body}\n) as result" if sep else f"select {', '.join(cols)} from (\n{body}\n) as result"
