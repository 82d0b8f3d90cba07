"""python -m joust plan | analyse RECORDS... --out FOLDER [--models A,B] [--partial]"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import choices as C
from .operators import cohort as H
from .operators import design as G
from .operators import ranking as R
from .operators.summary import n_pairs_for
from .schemas import BASELINE, CONDITION
from .session import session
from .sources import records as S
from .sources.reports import Saver


def analyse(spark, paths: list[str], out: str, models: list[str] | None = None, partial: bool = False, n_boot: int = R.N_BOOT, n_pairs: int | None = None) -> Saver:
    """All tables of an analysis as CSV folders with a manifest. One plan for all models. A block is complete by the
    design: n_pairs pairs if the design sampled them, else all pairs of the entities that any record names."""
    rows = S.deduplicated(S.ordered(spark, paths).withColumn("__key", S.record_key()), ["__key"]).drop("__key", "seq")
    x = C.from_records(rows)
    x = x.where(F.col("model").isin(*models)) if models else x
    n_pairs = n_pairs_for(x.select(F.explode(F.array("a", "b"))).distinct().count(), n_pairs)
    cov = C.coverage(x, n_pairs)
    x = x if partial else C.complete_blocks(x, cov)
    x = x.cache()
    est = C.pair_estimates(x).cache()
    stats, wins = C.pair_stats(x), C.win_rates(est)
    base = R.at_condition(est, BASELINE)
    names = est.select(F.explode(F.array("a", "b")).alias("entity")).distinct().withColumn("construct", F.lit(None).cast("string"))
    ranking = R.attribute_ranking(base, names, ["model"], n_boot)
    s = Saver(out)
    s.csv(cov.orderBy(*CONDITION), "coverage.csv", "trials by condition against the design")
    s.csv(C.answerability(x).orderBy(*CONDITION), "answerability.csv", "answered and refused shares")
    s.csv(C.position_bias(x).orderBy("model", "n_options"), "position_bias.csv", "choice rate by printed position")
    s.csv(C.slot_duels(x), "slot_duels.csv", "wins of the earlier slot")
    s.csv(R.condition_report(stats, est, min(n_boot, 200)).orderBy(*CONDITION), "validity.csv", "validity rates, reliability and transitivity by condition")
    s.csv(C.transitivity(est).orderBy(*CONDITION), "transitivity.csv", "closed and cyclic triads")
    s.csv(ranking.orderBy("model", F.desc("win_rate"), "entity"), "ranking.csv", "win rates, intervals and strengths at the baseline")
    s.csv(R.reliability(est), "reliability.csv", "split-half reliability by condition")
    s.csv(H.consensus(ranking), "consensus.csv", "agreement of the models on each entity")
    s.csv(R.agreement(ranking, "model", []), "similarity.csv", "rank agreement of models")
    for factor in BASELINE:
        s.csv(R.shift(est, factor, n_boot=n_boot), f"shift_{factor}.csv", f"win rates when {factor} flips")
    s.index()
    return s


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="joust", description=__doc__)
    sub = p.add_subparsers(dest="do", required=True)
    a = sub.add_parser("analyse")
    a.add_argument("records", nargs="+")
    a.add_argument("--out", required=True)
    a.add_argument("--models")
    a.add_argument("--partial", action="store_true")
    a.add_argument("--pairs", type=int)
    b = sub.add_parser("plan")
    b.add_argument("--entities", type=int, default=32)
    b.add_argument("--repeats", type=int, default=1)
    o = p.parse_args(args)
    spark = session()
    if o.do == "plan":
        G.plan(G.grid(spark.createDataFrame([("one model",)], "model string"), G.all_pairs(spark.range(o.entities).select(F.format_string("E%04d", "id").alias("entity"))), o.repeats)).orderBy("qvar", "object", "subject").show(100, False)
    else:
        analyse(spark, o.records, o.out, o.models.split(",") if o.models else None, o.partial, n_pairs=o.pairs)


if __name__ == "__main__":
    main()
