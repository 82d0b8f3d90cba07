"""Estimators and audits over a choice frame. Every function is DataFrame -> DataFrame; undefined is NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, share
from ..schemas import CONDITION, PAIR

TIE = 0.10


def count_of(flag) -> F.Column:
    return F.count_if(F.coalesce(flag, F.lit(False)))


def from_records(records: DataFrame) -> DataFrame:
    """Choice rows of stored records. A printed position is that of the letter whose meaning the option is."""
    at = lambda meaning: F.nullif(F.array_position(F.transform(F.array_sort(F.map_keys("welfare_options")), lambda k: F.element_at("welfare_options", k)), meaning), F.lit(0)).cast("int")
    x = records.where("welfare_probe = 'choice'")
    picked = F.col("welfare_choice")
    x = x.select(
        F.col("model_id").alias("model"), F.col("welfare_qvar").alias("qvar"), F.col("welfare_object").alias("object"), F.col("welfare_subject").alias("subject"),
        F.col("no_preference_offered").alias("no_pref_offered"), F.col("welfare_system_framing").alias("system_framing"), F.col("entity_a").alias("a"), F.col("entity_b").alias("b"),
        F.col("trial_idx").alias("trial"), F.size("welfare_options").alias("n_options"), at(F.col("entity_a")).alias("pos_a"), at(F.col("entity_b")).alias("pos_b"), at(F.lit("no_preference")).alias("pos_none"),
        (picked != "").alias("answered"), F.col("refusal_flag").alias("refused"), (picked == F.col("entity_a")).alias("chose_a"), (picked == F.col("entity_b")).alias("chose_b"), (picked == "no_preference").alias("chose_none"),
    )
    return x.withColumn("chosen_position", F.when(F.col("chose_a"), F.col("pos_a")).when(F.col("chose_b"), F.col("pos_b")).when(F.col("chose_none"), F.col("pos_none")))


def pair_estimates(choices: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    x = choices.where("answered").groupBy(*keys).agg(F.count("*").alias("n"), count_of(F.col("chose_a")).alias("n_a"), count_of(F.col("chose_b")).alias("n_b"), count_of(F.col("chose_none")).alias("n_none"))
    return x.withColumn("n_orders", F.col("n")).withColumn("p_none", ratio(F.col("n_none"), F.col("n"))).withColumn("pref_a", ratio(F.col("n_a"), F.col("n_a") + F.col("n_b")))


def both_sides(estimates: DataFrame) -> DataFrame:
    """Long pair matrix: two rows a pair, seen from either entity. One scan, no union."""
    side = lambda e, o, w: F.struct(F.col(e).alias("entity"), F.col(o).alias("opponent"), w.alias("win"))
    return estimates.withColumn("side", F.explode(F.array(side("a", "b", F.col("pref_a")), side("b", "a", 1 - F.col("pref_a"))))).select("*", "side.*").drop("side")


def win_rates(estimates: DataFrame, keys: list[str] = CONDITION) -> DataFrame:
    """Means over pairs, not trials. n_pairs counts pairs without a preference too."""
    return both_sides(estimates).groupBy(*keys, "entity").agg(F.avg("win").alias("win_rate"), F.avg("p_none").alias("no_pref"), F.count("*").alias("n_pairs"), F.sum("n").alias("n_trials"))


def answerability(choices: DataFrame) -> DataFrame:
    return choices.groupBy(*CONDITION).agg(F.count("*").alias("n"), share(F.col("answered")).alias("answered"), share(F.col("refused")).alias("refused"))


def position_bias(choices: DataFrame) -> DataFrame:
    at = lambda k: ratio(F.count_if(F.col("chosen_position") == k), F.count("*"))
    x = choices.where("answered and chosen_position is not null").groupBy("model", "n_options").agg(F.count("*").alias("n"), *[at(k).alias(f"p_pos{k}") for k in (1, 2, 3)])
    even = 1.0 / F.col("n_options")
    off = sum((F.when(F.col("n_options") >= k, F.abs(F.col(f"p_pos{k}") - even)).otherwise(0.0) for k in (1, 2, 3)), F.lit(0.0))
    x = x.withColumn("p_pos3", F.when(F.col("n_options") >= 3, F.col("p_pos3"))).withColumn("expected", even)
    return x.withColumn("bias", 0.5 * off / (1 - even))


def slot_rates(bias: DataFrame) -> DataFrame:
    x = bias.withColumn("__p2", F.col("p_pos2")).unpivot(["model", "n_options", "expected", "n", "bias"], ["p_pos1", "p_pos2", "p_pos3"], "position", "rate")
    x = x.withColumn("position", F.substring("position", 6, 1).cast("int"))
    return x.where("position <= n_options").select("model", "n_options", "position", "rate", "expected", "n", "bias")


def order_consistency(choices: DataFrame) -> DataFrame:
    first = F.col("pos_a") < F.col("pos_b")
    x = choices.where("answered and chose_none = false and pos_a is not null and pos_b is not null").groupBy(*PAIR).agg(F.avg(F.when(first, F.col("chose_a").cast("double"))).alias("pref_a_when_first"), F.avg(F.when(~first, F.col("chose_a").cast("double"))).alias("pref_a_when_second"), F.count("*").alias("n"))
    x = x.where("pref_a_when_first is not null and pref_a_when_second is not null")
    p, q = F.col("pref_a_when_first"), F.col("pref_a_when_second")
    x = x.withColumn("delta", F.abs(p - q)).withColumn("decisive", F.least(F.abs(p - 0.5), F.abs(q - 0.5)) >= TIE)
    return x.withColumn("flipped", ((p > 0.5) != (q > 0.5)) & F.col("decisive"))


def consistency_by_model(consistency: DataFrame) -> DataFrame:
    """flip_rate over all pairs, decisive_flip_rate over the decisive ones."""
    return consistency.groupBy("model").agg(F.count("*").alias("n_pairs"), F.avg("delta").alias("mean_delta"), share(F.col("flipped")).alias("flip_rate"), ratio(F.count_if("flipped"), F.count_if("decisive")).alias("decisive_flip_rate"))


def pooled(wins: DataFrame) -> DataFrame:
    return wins.groupBy("entity").agg(F.avg("win_rate").alias("win_rate"), F.avg("no_pref").alias("no_pref"), F.sum("n_trials").alias("n_trials"))


def construct_means(wins: DataFrame, entities: DataFrame) -> DataFrame:
    return wins.join(entities, "entity", "left").groupBy("construct").agg(F.avg("win_rate").alias("win_rate"), F.count("win_rate").alias("n"))


def no_preference_pivot(estimates: DataFrame, levels: tuple[str, ...] = ("increase", "preservation")) -> DataFrame:
    return estimates.where("no_pref_offered").groupBy("model").pivot("qvar", [*levels]).agg(F.avg("p_none"))


def coverage(choices: DataFrame, n_pairs: int, repeats: int = 1) -> DataFrame:
    """All rows count, answered or not; expected trials: pairs times permutations of two or three options."""
    x = choices.groupBy(*CONDITION).agg(F.countDistinct("a", "b").alias("pairs"), F.count("*").alias("trials"))
    x = x.withColumn("expected", F.lit(n_pairs) * F.when(F.col("no_pref_offered"), 6).otherwise(2).cast("bigint") * repeats)
    return x.withColumn("fraction", ratio(F.col("trials"), F.col("expected"))).withColumn("complete", F.col("fraction") >= 0.999)


def coverage_by_model(cov: DataFrame) -> DataFrame:
    return cov.groupBy("model").agg(F.count("*").alias("blocks"), F.count_if("complete").alias("done"), F.sum("trials").alias("trials"))


def complete_blocks(choices: DataFrame, cov: DataFrame) -> DataFrame:
    return choices.join(cov.where("complete").select(*CONDITION), CONDITION, "left_semi")


COUNTS = ["n", "answered", "refused", "none", "pos1", "pos2", "pos3", "duel", "duel_lo", "decisive", "flipped", "delta", "has_delta"]


def pair_stats(choices: DataFrame) -> DataFrame:
    """Thirteen sufficient statistics a (condition, pair): what every validity rate is a ratio of. One aggregate."""
    low, first = F.least("pos_a", "pos_b"), F.col("pos_a") < F.col("pos_b")
    duel = F.col("answered") & ~F.coalesce("chose_none", F.lit(False))
    ordered = F.col("answered") & (F.col("chose_none") == F.lit(False)) & F.col("pos_a").isNotNull() & F.col("pos_b").isNotNull()
    x = choices.groupBy(*PAIR).agg(
        F.count("*").alias("n"), count_of(F.col("answered")).alias("answered"), count_of(F.col("refused")).alias("refused"), count_of(F.col("answered") & F.col("chose_none")).alias("none"),
        *[count_of(F.col("answered") & (F.col("chosen_position") == k)).alias(f"pos{k}") for k in (1, 2, 3)],
        count_of(duel).alias("duel"), count_of(duel & (F.col("chosen_position") == low)).alias("duel_lo"), F.max("n_options").alias("n_options"),
        F.avg(F.when(ordered & first, F.col("chose_a").cast("double"))).alias("__p"), F.avg(F.when(ordered & ~first, F.col("chose_a").cast("double"))).alias("__q"),
    )
    p, q = F.col("__p"), F.col("__q")
    decisive = F.coalesce(F.least(F.abs(p - 0.5), F.abs(q - 0.5)) >= TIE, F.lit(False)) & p.isNotNull() & q.isNotNull()
    x = x.withColumn("decisive", decisive.cast("bigint")).withColumn("flipped", F.coalesce(decisive & ((p > 0.5) != (q > 0.5)), F.lit(False)).cast("bigint"))
    return x.withColumn("delta", F.coalesce(F.abs(p - q), F.lit(0.0))).withColumn("has_delta", (p.isNotNull() & q.isNotNull()).cast("bigint")).drop("__p", "__q")


def rates(n_options, of=lambda c: F.sum(c)) -> dict[str, F.Column]:
    """The seven validity rates over summed counts."""
    total = sum((of(f"pos{k}") for k in (2,)), of("pos1")) + F.when(n_options >= 3, of("pos3")).otherwise(0)
    even = 1.0 / n_options
    off = sum((F.abs(ratio(of(f"pos{k}"), total) - even) for k in (2,)), F.abs(ratio(of("pos1"), total) - even)) + F.when(n_options >= 3, F.abs(ratio(of("pos3"), total) - even)).otherwise(0.0)
    return {
        "answer_rate": ratio(of("answered"), of("n")),
        "refusal_rate": ratio(of("refused"), of("n")),
        "position_bias": 0.5 * off / (1 - even),
        "slot_duel_lo": ratio(of("duel_lo"), of("duel")),
        "flip_rate": ratio(of("flipped"), of("decisive")),
        "mean_abs_delta": ratio(of("delta"), of("has_delta")),
        "no_pref_rate": F.when(n_options > 2, ratio(of("none"), of("answered"))),
    }


METRICS = ["answer_rate", "refusal_rate", "position_bias", "slot_duel_lo", "flip_rate", "mean_abs_delta", "no_pref_rate"]


def validity_rates(stats: DataFrame, keys: list[str] = CONDITION) -> DataFrame:
    sums = stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("n_options").alias("n_options"))
    return sums.select(*keys, *[v.alias(k) for k, v in rates(F.col("n_options"), F.col).items()])


def slot_duels(choices: DataFrame) -> DataFrame:
    x = choices.where("answered and chose_none = false and chosen_position is not null").withColumn("slot_lo", F.least("pos_a", "pos_b")).withColumn("slot_hi", F.greatest("pos_a", "pos_b"))
    return x.groupBy("model", "n_options", "slot_lo", "slot_hi").agg(share(F.col("chosen_position") == F.col("slot_lo")).alias("p_lo_wins"), F.count("*").alias("n"))


def transitivity(estimates: DataFrame, keys: list[str] = CONDITION) -> DataFrame:
    """Closed and cyclic triads. Entities are ordered as strings; a tie does not beat in either orientation."""
    known = estimates.where("pref_a is not null")
    e = known.select(*keys, F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.when(F.col("a") < F.col("b"), F.col("pref_a")).otherwise(1 - F.col("pref_a")).alias("p"))
    edge = lambda x, y, p: e.select(*keys, F.col("x").alias(x), F.col("y").alias(y), F.col("p").alias(p))
    t = edge("x", "y", "pxy").join(edge("y", "z", "pyz"), [*keys, "y"]).join(edge("x", "z", "pxz"), [*keys, "x", "z"])
    xy, yz, xz = (F.col(c) > 0.5 for c in ("pxy", "pyz", "pxz"))
    cyclic = (xy & yz & ~xz) | (~xy & ~yz & xz)
    strict = F.least(*[F.abs(F.col(c) - 0.5) for c in ("pxy", "pyz", "pxz")]) >= TIE
    got = t.groupBy(*keys).agg(F.count("*").alias("triads"), F.count_if(cyclic).alias("cyclic"), F.count_if(strict).alias("strict_triads"), F.count_if(strict & cyclic).alias("strict_cyclic"))
    base = both_sides(known).groupBy(*keys).agg(F.countDistinct("entity").alias("n_nodes"), (F.count("*") / 2).cast("bigint").alias("n_pairs"))
    x = base.join(got, keys, "left").fillna(0, ["triads", "cyclic", "strict_triads", "strict_cyclic"])
    return x.withColumn("transitivity", 1 - ratio(F.col("cyclic"), F.col("triads"))).withColumn("strict_transitivity", 1 - ratio(F.col("strict_cyclic"), F.col("strict_triads"))).drop("strict_cyclic")


def transitivity_by_model(t: DataFrame) -> DataFrame:
    return t.groupBy("model").agg(F.sum("triads").alias("triads"), F.sum("cyclic").alias("cyclic"), F.avg("strict_transitivity").alias("strict_transitivity")).withColumn("transitivity", 1 - ratio(F.col("cyclic"), F.col("triads")))


def top_and_bottom(df: DataFrame, keys: list[str], value: str, tie: str, k: int = 3) -> DataFrame:
    by = Window.partitionBy(*keys)
    x = df.withColumn("place", F.row_number().over(by.orderBy(F.desc(value), tie))).withColumn("from_last", F.row_number().over(by.orderBy(F.asc(value), F.desc(tie))))
    return x.where((F.col("place") <= k) | (F.col("from_last") <= k)).select(*keys, tie, value, "place")
