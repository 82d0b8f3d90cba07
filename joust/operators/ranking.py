"""Rankings, strengths, resampling and paired contrasts over pair estimates.

Everything stays long: two rows a pair, never a pivoted matrix. A resample is an indexed hash draw, so it is the
same on every engine and partitioning; it is drawn from its group's array of pairs inside a row, without a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hash32, interval, mean_rank, pearson, ratio, spearman_brown, step_up, two_sided
from ..schemas import BASELINE, CONDITION
from .choices import COUNTS, METRICS, both_sides, pair_estimates, rates, transitivity

N_BOOT, N_SPLIT, PRIOR, LEAST_PAIRS = 2000, 200, 0.5, 8
#: Resamples of a group are dealt to so many tasks.
BLOCKS = 32


def at_condition(df: DataFrame, condition: dict) -> DataFrame:
    for k, v in condition.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def numbered(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with a preference, numbered from 0 within keys."""
    return estimates.where("pref_a is not null").withColumn("ix", F.row_number().over(Window.partitionBy(*keys).orderBy("a", "b")) - 1)


def packed(pairs: DataFrame, keys: list[str], cols: list[str], n_rep: int) -> DataFrame:
    """One row a (keys, rep) with the pairs of its group as an array, spread over partitions by blocks of rep. A group
    has as many pairs as the design, whatever the number of trials; only these arrays are shuffled, never draws."""
    one = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ix", *cols))).alias("__p"))
    blocks = min(BLOCKS, n_rep)
    x = one.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(*keys, "__block")
    return x.withColumn("rep", F.explode(F.sequence(F.col("__block"), F.lit(n_rep - 1), F.lit(blocks))))


def resampled(pairs: DataFrame, keys: list[str], cols: list[str], n_boot: int, seed: int, bit: bool = False) -> DataFrame:
    """keys, rep, cols of as many pairs drawn with replacement as there are; with bit also a fair coin a draw (half)."""
    n = F.size("__p")
    place = lambda k: (hash32(seed, F.col("rep"), k) % n).cast("int")
    coin = lambda k: (hash32(seed, F.lit("half"), F.col("rep"), k) % 2).cast("int")
    one = lambda k: F.struct(F.get("__p", place(k)).alias("p"), *([coin(k).alias("half")] if bit else []))
    x = packed(pairs, keys, cols, n_boot).select(*keys, "rep", F.explode(F.transform(F.sequence(F.lit(0), n - 1), one)).alias("d"))
    return x.select(*keys, "rep", *[F.col(f"d.p.{c}").alias(c) for c in cols], *(["d.half"] if bit else []))


def halved(pairs: DataFrame, keys: list[str], cols: list[str], n_split: int, seed: int) -> DataFrame:
    """keys, rep, cols, half: random halves of the pairs, the first of floor(n / 2)."""
    mixed = F.array_sort(F.transform("__p", lambda p: F.struct(hash32(seed, F.col("rep"), p["ix"]).alias("h"), p["ix"].alias("ix"), p.alias("p"))))
    x = packed(pairs, keys, cols, n_split).select(*keys, "rep", F.floor(F.size("__p") / 2).alias("first"), F.posexplode(mixed).alias("at", "m"))
    return x.select(*keys, "rep", *[F.col(f"m.p.{c}").alias(c) for c in cols], F.when(F.col("at") < F.col("first"), 0).otherwise(1).alias("half"))


def bootstrap_intervals(estimates: DataFrame, keys: list[str] = CONDITION, n_boot: int = N_BOOT, seed: int = 11) -> DataFrame:
    """entity, ci_lo, ci_hi of its win rate over resampled pairs."""
    drawn = resampled(numbered(estimates, keys), keys, ["a", "b", "pref_a"], n_boot, seed)
    x = both_sides(drawn).groupBy(*keys, "rep", "entity").agg(F.avg("win").alias("v"))
    lo, hi = interval("v")
    return x.groupBy(*keys, "entity").agg(lo.alias("ci_lo"), hi.alias("ci_hi"), F.count("v").alias("n_draws"))


def bradley_terry(estimates: DataFrame, keys: list[str] = CONDITION, rounds: int = 200, prior: float = PRIOR) -> DataFrame:
    """entity, bt_strength (log), bt_win_vs_average: minorise-maximise with a virtual win and loss against strength 1
    and a geometric mean of 1 each round. A fixed number of rounds as one fold over arrays, inside the JVM."""
    games = both_sides(estimates.where("n_a + n_b > 0")).withColumn("games", (F.col("n_a") + F.col("n_b")).cast("double")).withColumn("won", F.when(F.col("entity") == F.col("a"), F.col("n_a")).otherwise(F.col("n_b")).cast("double"))
    names = games.groupBy(*keys).agg(F.array_sort(F.collect_set("entity")).alias("names"))
    by = games.groupBy(*keys, "entity").agg(F.sum("won").alias("w"), F.collect_list(F.struct("opponent", "games")).alias("met"))
    by = by.join(names, keys).withColumn("met", F.transform(F.array_sort("met"), lambda m: F.struct((F.array_position("names", m["opponent"]) - 1).cast("int").alias("j"), m["games"].alias("g"))))
    x = by.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("entity", "w", "met"))).alias("rows"))

    def step(p, _):
        raw = F.transform("rows", lambda r, i: (r["w"] + prior) / (F.aggregate(r["met"], F.lit(0.0), lambda acc, m: acc + m["g"] / (F.get(p, i) + F.get(p, m["j"]))) + 2 * prior / (F.get(p, i) + 1.0)))
        return F.transform(F.array(raw), lambda q: F.transform(q, lambda v: v / F.exp(F.aggregate(q, F.lit(0.0), lambda a, u: a + F.ln(u)) / F.size(q))))[0]

    p = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.transform("rows", lambda _: F.lit(1.0)), step)
    x = x.withColumn("p", p).select(*keys, F.explode(F.transform("rows", lambda r, i: F.struct(r["entity"].alias("entity"), F.get("p", i).alias("p")))).alias("e"))
    return x.select(*keys, "e.entity", F.ln("e.p").alias("bt_strength"), (F.col("e.p") / (F.col("e.p") + 1)).alias("bt_win_vs_average"))


def bradley_terry_until(estimates: DataFrame, keys: list[str] = CONDITION, prior: float = PRIOR, tolerance: float = 1e-10, most: int = 10_000) -> DataFrame:
    """The same with the tolerance stop: one condition a group (its size is that of the design), in Arrow batches."""
    import numpy as np
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf.a, *pdf.b})
        at = {e: i for i, e in enumerate(names)}
        n, w = np.zeros((len(names), len(names))), np.zeros(len(names))
        for r in pdf.itertuples():
            i, j = at[r.a], at[r.b]
            n[i, j] += r.n_a + r.n_b
            n[j, i] += r.n_a + r.n_b
            w[i] += r.n_a
            w[j] += r.n_b
        p = np.ones(len(names))
        for _ in range(most):
            new = (w + prior) / ((n / (p[:, None] + p[None, :])).sum(axis=1) + 2 * prior / (p + 1))
            new /= np.exp(np.log(new).mean())
            if (np.abs(new - p) <= tolerance * p).all():
                p = new
                break
            p = new
        out = pd.DataFrame({"entity": names, "bt_strength": np.log(p), "bt_win_vs_average": p / (p + 1)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "entity", "bt_strength", "bt_win_vs_average"]]

    x = estimates.where("n_a + n_b > 0").select(*keys, "a", "b", "n_a", "n_b")
    kinds = dict(x.dtypes)
    return x.groupBy(*keys).applyInPandas(fit, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "entity string, bt_strength double, bt_win_vs_average double"]))


def opponent_strength(estimates: DataFrame, wins: DataFrame, keys: list[str] = CONDITION) -> DataFrame:
    """Mean win rate of the opponents, weighted by games; games against unrated opponents weigh in the denominator."""
    games = both_sides(estimates).withColumn("games", (F.col("n_a") + F.col("n_b")).cast("double"))
    x = games.join(wins.select(*keys, F.col("entity").alias("opponent"), F.col("win_rate").alias("theirs")), [*keys, "opponent"], "left")
    return x.groupBy(*keys, "entity").agg(ratio(F.sum(F.col("games") * F.col("theirs")), F.sum("games")).alias("opponent_strength"))


def attribute_ranking(estimates: DataFrame, entities: DataFrame, keys: list[str] = CONDITION, n_boot: int = N_BOOT, seed: int = 11) -> DataFrame:
    known = estimates.where("pref_a is not null")
    base = both_sides(known).groupBy(*keys, "entity").agg(F.avg("win").alias("win_rate"), F.count("win").alias("n_pairs"))
    x = base.join(bootstrap_intervals(estimates, keys, n_boot, seed).drop("n_draws"), [*keys, "entity"], "left").join(bradley_terry(estimates, keys), [*keys, "entity"], "left")
    x = x.withColumn("rank_raw", mean_rank("win_rate", keys, True).cast("int")).withColumn("rank_bt", mean_rank("bt_strength", keys, True).cast("int")).withColumn("rank_shift", F.col("rank_bt") - F.col("rank_raw"))
    return x.join(opponent_strength(estimates, base, keys), [*keys, "entity"], "left").join(F.broadcast(entities), "entity", "left")


def construct_ranking(ranking: DataFrame, keys: list[str]) -> DataFrame:
    return ranking.groupBy(*keys, "construct").agg(F.avg("win_rate").alias("mean"), F.min("win_rate").alias("min"), F.max("win_rate").alias("max"), F.stddev_samp("win_rate").alias("sd"), F.count("win_rate").alias("n"))


def reliability(estimates: DataFrame, keys: list[str] = CONDITION, n_split: int = N_SPLIT, seed: int = 5) -> DataFrame:
    """Split-half reliability over pairs, stepped up; null under eight pairs."""
    pairs = numbered(estimates, keys)
    enough = pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"))
    side = lambda h: F.avg(F.when(F.col("half") == h, F.col("win"))).alias(f"h{h}")
    x = both_sides(halved(pairs, keys, ["a", "b", "pref_a"], n_split, seed)).groupBy(*keys, "rep", "entity").agg(side(0), side(1))
    x = x.groupBy(*keys, "rep").agg(pearson("h0", "h1").alias("r")).groupBy(*keys).agg(F.avg("r").alias("r_half")).join(enough, keys)
    return x.select(*keys, "n_pairs", F.when(F.col("n_pairs") >= LEAST_PAIRS, spearman_brown(F.col("r_half"))).alias("reliability"))


def parity_reliability(choices: DataFrame, keys: list[str] = CONDITION) -> DataFrame:
    """Even against odd trials, over entities; five at least. Both halves in one pass."""
    x = pair_estimates(choices.withColumn("__odd", F.col("trial") % 2), [*keys, "a", "b", "__odd"])
    side = lambda p, to: F.avg(F.when(F.col("__odd") == p, F.col("win"))).alias(to)
    x = both_sides(x).groupBy(*keys, "entity").agg(side(0, "x"), side(1, "y")).groupBy(*keys).agg(pearson("x", "y", 5).alias("r"))
    return x.where("r is not null").select(*keys, spearman_brown(F.col("r")).alias("reliability"))


def contrast(wins: DataFrame, factor: str, rel: DataFrame | None = None) -> DataFrame:
    """The two levels of one factor against each other, within all other factors; levels in string order."""
    others = [c for c in CONDITION if c != factor]
    side = lambda v, l: wins.where("win_rate is not null").select(*others, "entity", F.col(factor).cast("string").alias(l), F.col("win_rate").alias(v))  # noqa: E731, E741
    x = side("x", "level_a").join(side("y", "level_b"), [*others, "entity"]).where("level_a < level_b")
    x = x.groupBy(*others, "level_a", "level_b").agg(F.count("*").alias("n_attributes"), pearson("x", "y", 5).alias("r"), F.avg(F.col("y") - F.col("x")).alias("mean_shift"), F.avg(F.abs(F.col("y") - F.col("x"))).alias("mean_abs_shift"))
    x = x.where("r is not null").withColumn("factor", F.lit(factor))
    if rel is None:
        return x
    of = lambda l, to: rel.select(*others, F.col(factor).cast("string").alias(l), F.col("reliability").alias(to))  # noqa: E731, E741
    x = x.join(of("level_a", "ra"), [*others, "level_a"], "left").join(of("level_b", "rb"), [*others, "level_b"], "left")
    x = x.withColumn("reliability_ceiling", F.when((F.col("ra") > 0) & (F.col("rb") > 0), F.sqrt(F.greatest(F.col("ra") * F.col("rb"), F.lit(0.0)))))
    return x.withColumn("r_corrected", ratio("r", "reliability_ceiling")).drop("ra", "rb")


def contrast_summary(contrasts: DataFrame) -> DataFrame:
    return contrasts.groupBy("factor", "level_a", "level_b").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.min("r").alias("min_r"), F.avg("mean_abs_shift").alias("mean_abs_shift"))


def agreement(wins: DataFrame, left: str, keys: list[str], rel: DataFrame | None = None, least: int = 5) -> DataFrame:
    """All pairs left_a < left_b within keys: Pearson and Spearman over the entities that both rate."""
    pick = lambda v, l: wins.where("win_rate is not null").select(*keys, "entity", F.col(left).alias(l), F.col("win_rate").alias(v))  # noqa: E731, E741
    a, b = f"{left}_a", f"{left}_b"
    x = pick("x", a).join(pick("y", b), [*keys, "entity"]).where(F.col(a) < F.col(b))
    group = [*keys, a, b]
    x = x.withColumn("rx", mean_rank("x", group)).withColumn("ry", mean_rank("y", group))
    x = x.groupBy(*group).agg(F.count("*").alias("n_attributes"), pearson("x", "y", least).alias("pearson_r"), pearson("rx", "ry", least).alias("spearman_r"), F.avg(F.abs(F.col("y") - F.col("x"))).alias("mean_abs_shift")).where(F.col("n_attributes") >= least)
    if rel is None:
        return x
    of = lambda l, to: rel.select(*keys, F.col(left).alias(l), F.col("reliability").alias(to))  # noqa: E731, E741
    x = x.join(of(a, "ra"), [*keys, a], "left").join(of(b, "rb"), [*keys, b], "left")
    x = x.withColumn("ceiling", F.when(F.col("ra") * F.col("rb") >= 0, F.sqrt(F.greatest(F.col("ra") * F.col("rb"), F.lit(0.0)))))
    return x.withColumn("r_over_ceiling", ratio("pearson_r", "ceiling")).drop("ra", "rb")


def aligned(estimates: DataFrame, factor: str, baseline: dict = BASELINE) -> DataFrame:
    """model, ix, a, b, p, q: the pairs that the baseline (p) and its one-factor neighbour (q) share, numbered."""
    rest = {k: v for k, v in baseline.items() if k != factor}
    x = at_condition(estimates, rest).where("pref_a is not null")
    is_base = F.col(factor) == F.lit(baseline[factor])
    both = x.groupBy("model", "a", "b").agg(F.max(F.when(is_base, F.col("pref_a"))).alias("p"), F.max(F.when(~is_base, F.col("pref_a"))).alias("q")).where("p is not null and q is not null")
    both = both.withColumn("ix", F.row_number().over(Window.partitionBy("model").orderBy("a", "b")) - 1).withColumn("n_rows", F.count("*").over(Window.partitionBy("model")))
    return both.where(F.col("n_rows") >= LEAST_PAIRS).drop("n_rows")


def faces(pairs: DataFrame) -> DataFrame:
    """Both sides of aligned pairs: entity, base, flip."""
    side = lambda e, p, q: F.struct(F.col(e).alias("entity"), p.alias("base"), q.alias("flip"))
    return pairs.withColumn("side", F.explode(F.array(side("a", F.col("p"), F.col("q")), side("b", 1 - F.col("p"), 1 - F.col("q"))))).select("*", "side.*").drop("side", "a", "b", "p", "q")


def shift(estimates: DataFrame, factor: str, baseline: dict = BASELINE, n_boot: int = N_BOOT, seed: int = 17) -> DataFrame:
    """Per model and entity: win rates at the baseline and the flip on shared pairs, their difference, interval, p, q."""
    return shift_of(aligned(estimates, factor, baseline), factor, n_boot, seed)


def shift_of(pairs: DataFrame, factor: str, n_boot: int, seed: int) -> DataFrame:
    point = faces(pairs).groupBy("model", "entity").agg(F.avg("base").alias("win_baseline"), F.avg("flip").alias("win_flip"), F.count("*").alias("n_pairs"))
    lo, hi = interval("d")
    x = point.join(shift_draws(pairs, n_boot, seed).groupBy("model", "entity").agg(lo.alias("shift_lo"), hi.alias("shift_hi"), two_sided("d").alias("p")), ["model", "entity"], "left")
    x = x.withColumn("shift", F.col("win_flip") - F.col("win_baseline")).withColumn("factor", F.lit(factor))
    return step_up(x, "p", ["model"], "q", ["entity"])


def shift_draws(pairs: DataFrame, n_boot: int, seed: int) -> DataFrame:
    drawn = resampled(pairs, ["model"], ["a", "b", "p", "q"], n_boot, seed)
    return faces(drawn).groupBy("model", "rep", "entity").agg(F.avg(F.col("flip") - F.col("base")).alias("d"))


def four_halves(split: DataFrame) -> DataFrame:
    """split: faces with rep and half. Within- and cross-condition correlation of half tournaments and the two
    within-half correlations by themselves, a row a (model, rep)."""
    cell = lambda c, h: F.avg(F.when(F.col("half") == h, F.col(c))).alias(f"{c}{h}")
    x = faces(split).groupBy("model", "rep", "entity").agg(*[cell(c, h) for c in ("base", "flip") for h in (0, 1)])
    x = x.groupBy("model", "rep").agg(pearson("base0", "base1").alias("bb"), pearson("flip0", "flip1").alias("cc"), pearson("base0", "flip1").alias("bc"), pearson("flip0", "base1").alias("cb"))
    return x.select("model", "rep", "bb", "cc", ((F.col("bb") + F.col("cc")) / 2).alias("within"), ((F.col("bc") + F.col("cb")) / 2).alias("cross"))


def gap(estimates: DataFrame, factor: str, baseline: dict = BASELINE, n_boot: int = N_BOOT, n_split: int = N_SPLIT, seed: int = 17) -> DataFrame:
    """How much less the two conditions agree with each other than each with itself, with a thinned-bootstrap interval."""
    pairs, cols = aligned(estimates, factor, baseline), ["a", "b", "p", "q"]
    point = four_halves(halved(pairs, ["model"], cols, n_split, seed + 1)).groupBy("model").agg(F.avg("within").alias("r_within_half"), F.avg("cross").alias("r_cross_half"))
    thin = four_halves(resampled(pairs, ["model"], cols, n_boot, seed, bit=True)).withColumn("g", F.col("within") - F.col("cross"))
    lo, hi = interval("g")
    x = point.join(thin.groupBy("model").agg(lo.alias("gap_lo"), hi.alias("gap_hi"), two_sided("g").alias("gap_p")), "model", "left")
    return x.withColumn("gap", F.col("r_within_half") - F.col("r_cross_half")).withColumn("factor", F.lit(factor))


def shift_summary(estimates: DataFrame, factor: str, baseline: dict = BASELINE, n_boot: int = N_BOOT, n_split: int = N_SPLIT, seed: int = 17) -> DataFrame:
    pairs = aligned(estimates, factor, baseline)
    per = shift_of(pairs, factor, n_boot, seed)
    per = per.withColumn("rb", mean_rank("win_baseline", ["model"])).withColumn("rf", mean_rank("win_flip", ["model"]))
    x = per.groupBy("model").agg(F.count("*").alias("n_attributes"), F.avg(F.abs("shift")).alias("mean_abs_shift"), F.max(F.abs("shift")).alias("max_abs_shift"), pearson("win_baseline", "win_flip").alias("pearson_r"), pearson("rb", "rf").alias("spearman_r"), F.count_if(F.col("q") < 0.05).alias("n_attr_moved"))
    lo, hi = interval("m")
    spread = shift_draws(pairs, n_boot, seed).groupBy("model", "rep").agg(F.avg(F.abs("d")).alias("m")).groupBy("model").agg(lo.alias("mean_abs_shift_lo"), hi.alias("mean_abs_shift_hi"))
    own = four_halves(halved(pairs, ["model"], ["a", "b", "p", "q"], n_split, 5))
    own = own.groupBy("model").agg(spearman_brown(F.avg("bb")).alias("reliability_baseline"), spearman_brown(F.avg("cc")).alias("reliability_flip"))
    x = x.join(spread, "model", "left").join(own, "model", "left")
    product = F.col("reliability_baseline") * F.col("reliability_flip")
    x = x.withColumn("ceiling", F.when(product >= 0, F.sqrt(F.greatest(product, F.lit(0.0))))).withColumn("r_over_ceiling", ratio("pearson_r", "ceiling"))
    return x.withColumn("factor", F.lit(factor))


def construct_shift(per: DataFrame, entities: DataFrame) -> DataFrame:
    return per.join(F.broadcast(entities), "entity", "left").groupBy("model", "factor", "construct").agg(F.avg("shift").alias("mean_shift"), F.min("shift").alias("min_shift"), F.max("shift").alias("max_shift"), F.count("shift").alias("n"), F.count_if(F.col("q") < 0.05).alias("n_moved"))


def metric_shift(stats: DataFrame, factor: str, baseline: dict = BASELINE, n_boot: int = N_BOOT, seed: int = 29) -> DataFrame:
    """Per model: the validity rates at the baseline and the flip on shared pairs, with the same draws on both sides."""
    rest = {k: v for k, v in baseline.items() if k != factor}
    x = at_condition(stats, rest).withColumn("side", F.when(F.col(factor) == F.lit(baseline[factor]), "b").otherwise("f"))
    take = lambda s: [F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for c in [*COUNTS, "n_options"]]
    both = x.groupBy("model", "a", "b").agg(*take("b"), *take("f")).where("b_n is not null and f_n is not null")
    both = both.withColumn("ix", F.row_number().over(Window.partitionBy("model").orderBy("a", "b")) - 1).withColumn("n_rows", F.count("*").over(Window.partitionBy("model"))).where(F.col("n_rows") >= LEAST_PAIRS).drop("n_rows", "a", "b")
    cols = [f"{s}_{c}" for s in "bf" for c in [*COUNTS, "n_options"]]
    every = both.select("model", F.lit(-1).alias("rep"), *cols)  # rep -1: the point
    x = resampled(both, ["model"], cols, n_boot, seed).unionByName(every)
    sums = [F.sum(f"{s}_{c}").alias(f"{s}_{c}") for s in "bf" for c in COUNTS]
    x = x.groupBy("model", "rep").agg(*sums, *[F.max(f"{s}_n_options").alias(f"{s}_k") for s in "bf"])
    of = {s: rates(F.col(f"{s}_k"), lambda c, s=s: F.col(f"{s}_{c}")) for s in "bf"}
    x = x.select("model", "rep", "b_k", "f_k", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), of["b"][m].alias("base"), of["f"][m].alias("flip")) for m in METRICS])).alias("m")).select("model", "rep", "b_k", "f_k", "m.*")
    x = x.withColumn("d", F.when(F.col("rep") >= 0, F.col("flip") - F.col("base")))
    lo, hi = interval("d")
    point = lambda c: F.max(F.when(F.col("rep") < 0, F.col(c)))
    x = x.groupBy("model", "metric").agg(point("base").alias("baseline"), point("flip").alias("flip"), lo.alias("shift_lo"), hi.alias("shift_hi"), two_sided("d").alias("p"), F.max((F.col("b_k") != F.col("f_k")).cast("int")).alias("__arm"))
    x = x.withColumn("shift", F.col("flip") - F.col("baseline")).withColumn("factor", F.lit(factor))
    return x.withColumn("comparable", ~((F.col("__arm") == 1) & F.col("metric").isin("position_bias", "no_pref_rate"))).drop("__arm")


def condition_metrics(stats: DataFrame, n_boot: int = 200, seed: int = 23) -> DataFrame:
    """The validity rates of every condition with intervals; each condition has draws of its own."""
    keys = CONDITION
    pairs = stats.withColumn("ix", F.row_number().over(Window.partitionBy(*keys).orderBy("a", "b")) - 1)
    x = resampled(pairs, keys, [*COUNTS, "n_options"], n_boot, seed)
    x = x.groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("n_options").alias("n_options"))
    of = rates(F.col("n_options"), F.col)
    x = x.select(*keys, *[of[m].alias(m) for m in METRICS])
    ends = [c.alias(f"{m}_{e}") for m in METRICS for e, c in zip(("lo", "hi"), interval(m))]
    point = stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("n_options").alias("n_options")).select(*keys, *[of[m].alias(m) for m in METRICS])
    return point.join(x.groupBy(*keys).agg(*ends), keys)


def condition_report(stats: DataFrame, estimates: DataFrame, n_boot: int = 200, n_split: int = N_SPLIT) -> DataFrame:
    """Every condition's validity rates with intervals, its reliability and its transitivity, in one row."""
    x = condition_metrics(stats, n_boot).join(reliability(estimates, CONDITION, n_split).drop("n_pairs"), CONDITION, "left")
    return x.join(transitivity(estimates).select(*CONDITION, "n_nodes", "triads", "cyclic", "transitivity", "strict_transitivity"), CONDITION, "left")


def flip_effects(wins: DataFrame, baseline: dict = BASELINE) -> DataFrame:
    """model, entity, factor, effect: conditions that differ from the baseline in exactly one factor."""
    differs = [(F.col(k) != F.lit(v)).cast("int") for k, v in baseline.items()]
    x = wins.where("win_rate is not null").withColumn("far", sum(differs[1:], differs[0]))
    base = x.where("far = 0").select("model", "entity", F.col("win_rate").alias("at_base"))
    name = F.coalesce(*[F.when(F.col(k) != F.lit(v), k) for k, v in baseline.items()])
    return x.where("far = 1").withColumn("factor", name).join(base, ["model", "entity"]).select("model", "entity", "factor", (F.col("win_rate") - F.col("at_base")).alias("effect"))


def desirability_confound(estimates: DataFrame, ratings: DataFrame, keys: list[str] = CONDITION) -> DataFrame:
    """ratings: model, entity, rating, length. Correlation of the preference with the gap in either, five pairs at least."""
    side = lambda e, s: ratings.select("model", F.col("entity").alias(e), F.col("rating").alias(f"r{s}"), F.col("length").alias(f"l{s}"))
    x = estimates.join(F.broadcast(side("a", "a")), ["model", "a"], "left").join(F.broadcast(side("b", "b")), ["model", "b"], "left")
    x = x.withColumn("rating_gap", F.col("ra") - F.col("rb")).withColumn("length_gap", (F.col("la") - F.col("lb")).cast("double"))
    return x.groupBy(*keys).agg(F.count("pref_a").alias("n"), pearson("rating_gap", "pref_a", 5).alias("r_desirability"), pearson("length_gap", "pref_a", 5).alias("r_length"))


