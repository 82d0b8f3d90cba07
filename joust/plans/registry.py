"""Named queries over the driver's tables: a plan, the columns of its result, and the same in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import step_up_rows
from ..operators import choices as C
from ..operators import cohort as H
from ..operators import design as G
from ..operators import ranking as R
from ..schemas import BASELINE, CONDITION, FACTORS, PAIR
from ..sources import fixture, records
from . import oracle as Q
from .query import Query

BOOT, SPLIT, PERM, CONDITION_BOOT = Q.BOOT, Q.SPLIT, Q.PERM, Q.CONDITION_BOOT


def ch(spark, d, trials=False):
    return fixture.choices(spark, d, trials)


def est(spark, d):
    return C.pair_estimates(ch(spark, d))


def wins(spark, d):
    return C.win_rates(est(spark, d))


def at_base(spark, d):
    return R.at_condition(est(spark, d), BASELINE)


def base_ranking(spark, d):
    return R.attribute_ranking(at_base(spark, d), fixture.entities(spark, d), ["model"], BOOT)


def rates(spark, d):
    return wins(spark, d).groupBy("model", "entity").agg(F.avg("win_rate").alias("win_rate"))


def meta(spark):
    return H.model_meta(fixture.models(spark))


def model_pairs(spark, d):
    return R.agreement(rates(spark, d), "model", [])


def condition_agreement(spark, d):
    label = T.short_label(F.col("qvar"), F.col("object"), F.col("subject"), F.col("no_pref_offered"))
    e = est(spark, d)
    return R.agreement(C.win_rates(e).withColumn("label", label), "label", ["model"], R.reliability(e, CONDITION, SPLIT).withColumn("label", label))


def cover(spark, d):
    return C.coverage(ch(spark, d), 60)


def base_rel(spark, d):
    return R.reliability(at_base(spark, d), ["model"], SPLIT)


def keyed_texts(spark, d, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    orders = fixture.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.withColumn("i", (F.col("o_orderkey") % len(texts)).cast("int")).join(F.broadcast(rows), "i").withColumn("n_options", (2 + F.col("o_custkey") % 2).cast("int"))


def answers(spark, d):
    return keyed_texts(spark, d, [a[0] for a in Q.ANSWERS])


def numbers(spark, d):
    return keyed_texts(spark, d, [a[0] for a in Q.NUMBERS])


def design_cells(spark, d):
    return G.keyed(G.grid(fixture.models(spark), G.all_pairs(fixture.entities(spark, d).select("entity"))))


def attempts(spark, d):
    x = fixture.table(spark, d, "lineitem")
    return x.select(F.concat_ws("-", (F.col("l_orderkey") % 5000).cast("string"), F.col("l_linenumber").cast("string")).alias("cell_key"), F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity").alias("seq"), F.when(F.col("l_returnflag") == "R", "error: timeout").otherwise("").alias("notes"), F.col("l_partkey").alias("payload"))


def logps(spark, d):
    x = fixture.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lp = lambda k: -(1.0 + ((F.col("o_orderkey") * k) % 7).cast("double") / 2)
    return x.withColumn("m", F.map_from_arrays(F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.array(lp(3), lp(5), lp(11))))


def q_softmax(spark, d):
    x = logps(spark, d).withColumn("s", T.softmax(F.col("m")))
    return x.select("o_orderkey", F.element_at("s", "1").alias("p1"), F.element_at("s", "3").alias("p3"), T.coverage(F.col("m")).alias("mass"), T.expected(F.col("s")).alias("mean"))


def q_fdr(spark, d):
    x = fixture.table(spark, d, "part").select("p_partkey")
    x = x.withColumn("p", F.when(F.col("p_partkey") % 7 != 0, ((F.col("p_partkey") * 7919) % 10007).cast("double") / 10007)).withColumn("g", F.col("p_partkey") % 4)
    return step_up_rows(x, "p", ["g"], "q").withColumn("stars", F.when(F.col("q").isNotNull(), T.stars(F.col("q"))))


def ratings(spark, d):
    return spark.createDataFrame([(m[0],) for m in fixture.MODELS], "model string").crossJoin(fixture.table(spark, d, "nation")).select("model", F.col("n_name").alias("entity"), (((F.col("n_nationkey") * 7 + F.length("model")) % 9).cast("double") + 1).alias("rating"), (F.length("n_name") + F.col("n_nationkey") % 5).cast("double").alias("length"))


def rendered(spark, d):
    x = G.rendered(design_cells(spark, d))
    return x.withColumn("letter_a", F.element_at("letter_map", "A"))


def contrasts(spark, d):
    w = wins(spark, d)
    return functools.reduce(DataFrame.unionByName, [R.contrast(w, f).drop(*[c for c in CONDITION if c != f]) for f in FACTORS])


def mock(spark, d):
    x = G.rendered(design_cells(spark, d))
    return G.mock_shares(x, F.col("system"), F.col("user")).select("cell_key", F.element_at("shares", 1).alias("p1"))


COND, PAIRS = " ".join(CONDITION), " ".join(PAIR)

QUERIES: dict[str, Query] = {
    "q_choices": Query(lambda s, d: ch(s, d), f"{PAIRS} a_construct answered refused chose_a chose_b chose_none", "n_options pos_a pos_b pos_none chosen_position", "", Q.CHOICES),
    "q_pair_estimates": Query(est, PAIRS, "n n_a n_b n_none n_orders", "p_none pref_a", Q.EST),
    "q_win_rates": Query(wins, f"{COND} entity", "n_pairs n_trials", "win_rate no_pref", Q.WINS),
    "q_answerability": Query(lambda s, d: C.answerability(ch(s, d)), COND, "n", "answered refused", Q.ANSWERABILITY),
    "q_position_bias": Query(lambda s, d: C.position_bias(ch(s, d)), "model", "n_options n", "p_pos1 p_pos2 p_pos3 expected bias", Q.POSITION_BIAS),
    "q_slot_rates": Query(lambda s, d: C.slot_rates(C.position_bias(ch(s, d))), "model", "n_options position n", "rate expected bias", Q.SLOT_RATES),
    "q_order_consistency": Query(lambda s, d: C.order_consistency(ch(s, d)), f"{PAIRS} flipped decisive", "n", "pref_a_when_first pref_a_when_second delta", Q.CONSISTENCY),
    "q_consistency_by_model": Query(lambda s, d: C.consistency_by_model(C.order_consistency(ch(s, d))), "model", "n_pairs", "mean_delta flip_rate decisive_flip_rate", Q.CONSISTENCY_BY_MODEL),
    "q_no_pref_pivot": Query(lambda s, d: C.no_preference_pivot(est(s, d)), "model", "", "increase preservation", Q.NO_PREF_PIVOT),
    "q_pooled": Query(lambda s, d: C.pooled(wins(s, d)), "entity", "n_trials", "win_rate no_pref", Q.POOLED),
    "q_construct_means": Query(lambda s, d: C.construct_means(wins(s, d), fixture.entities(s, d)), "construct", "n", "win_rate", Q.CONSTRUCT_MEANS),
    "q_coverage": Query(cover, f"{COND} complete", "pairs trials expected", "fraction", Q.COVERAGE),
    "q_coverage_by_model": Query(lambda s, d: C.coverage_by_model(cover(s, d)), "model", "blocks done trials", "", Q.COVERAGE_BY_MODEL),
    "q_complete_blocks": Query(lambda s, d: C.complete_blocks(ch(s, d), cover(s, d)).groupBy(*CONDITION).agg(F.count("*").alias("n")), COND, "n", "", Q.COMPLETE_BLOCKS),
    "q_pair_stats": Query(lambda s, d: C.pair_stats(ch(s, d)), PAIRS, "n answered refused none pos1 pos2 pos3 duel duel_lo decisive flipped has_delta n_options", "delta", Q.PAIR_STATS),
    "q_validity_rates": Query(lambda s, d: C.validity_rates(C.pair_stats(ch(s, d))), COND, "", " ".join(C.METRICS), Q.VALIDITY),
    "q_slot_duels": Query(lambda s, d: C.slot_duels(ch(s, d)), "model", "n_options slot_lo slot_hi n", "p_lo_wins", Q.SLOT_DUELS),
    "q_transitivity": Query(lambda s, d: C.transitivity(est(s, d)), COND, "n_nodes n_pairs triads cyclic strict_triads", "transitivity strict_transitivity", Q.TRANSITIVITY),
    "q_transitivity_by_model": Query(lambda s, d: C.transitivity_by_model(C.transitivity(est(s, d))), "model", "triads cyclic", "transitivity strict_transitivity", Q.TRANSITIVITY_BY_MODEL),
    **{f"q_contrast_{n}": Query(lambda s, d, f=f: R.contrast(wins(s, d), f, R.reliability(est(s, d), CONDITION, SPLIT)), " ".join(c for c in CONDITION if c != f) + " level_a level_b factor", "n_attributes", "r mean_shift mean_abs_shift reliability_ceiling r_corrected", Q.contrast(f)) for n, f in (("qvar", "qvar"), ("object", "object"), ("subject", "subject"), ("arm", "no_pref_offered"))},
    **{f"q_shift_{n}": Query(lambda s, d, f=f: R.shift(est(s, d), f, n_boot=BOOT), "model entity factor", "n_pairs", "win_baseline win_flip shift shift_lo shift_hi p q", f"with {Q.shifts(f)}\n--\nselect * from shifts") for n, f in (("object", "object"), ("subject", "subject"), ("arm", "no_pref_offered"))},
    **{f"q_gap_{n}": Query(lambda s, d, f=f: R.gap(est(s, d), f, n_boot=BOOT, n_split=SPLIT), "model factor", "", "r_within_half r_cross_half gap gap_lo gap_hi gap_p", Q.gap_of(f)) for n, f in (("object", "object"), ("subject", "subject"), ("arm", "no_pref_offered"))},
    "q_contrast_summary": Query(lambda s, d: R.contrast_summary(contrasts(s, d)), "factor level_a level_b", "n", "mean_r min_r mean_abs_shift", Q.CONTRAST_SUMMARY),
    "q_parity_reliability": Query(lambda s, d: R.parity_reliability(ch(s, d, True), ["model", "qvar"]), "model qvar", "", "reliability", Q.PARITY),
    "q_condition_agreement": Query(condition_agreement, "model label_a label_b", "n_attributes", "pearson_r spearman_r mean_abs_shift ceiling r_over_ceiling", Q.CONDITION_AGREEMENT),
    "q_bt_strength": Query(lambda s, d: R.bradley_terry(at_base(s, d), ["model"]), "model entity", "", "bt_strength bt_win_vs_average", Q.BT),
    "q_ranking": Query(base_ranking, "model entity construct", "n_pairs rank_raw", "win_rate ci_lo ci_hi", Q.RANKING),
    "q_opponent_strength": Query(lambda s, d: R.opponent_strength(at_base(s, d), C.win_rates(at_base(s, d).where("pref_a is not null"), ["model"]), ["model"]), "model entity", "", "opponent_strength", Q.OPPONENT),
    "q_construct_ranking": Query(lambda s, d: R.construct_ranking(rates(s, d).join(fixture.entities(s, d), "entity"), ["model"]), "model construct", "n", "mean min max sd", Q.CONSTRUCT_RANKING),
    "q_boot_ci": Query(lambda s, d: R.bootstrap_intervals(at_base(s, d), ["model"], BOOT), "model entity", "n_draws", "ci_lo ci_hi", Q.BOOT_CI),
    "q_split_half": Query(base_rel, "model", "n_pairs", "reliability", Q.SPLIT_HALF),
    "q_shift": Query(lambda s, d: R.shift(est(s, d), "qvar", n_boot=BOOT), "model entity factor", "n_pairs", "win_baseline win_flip shift shift_lo shift_hi p q", Q.SHIFT),
    "q_shift_summary": Query(lambda s, d: R.shift_summary(est(s, d), "qvar", n_boot=BOOT, n_split=SPLIT), "model factor", "n_attributes n_attr_moved", "mean_abs_shift max_abs_shift mean_abs_shift_lo mean_abs_shift_hi pearson_r spearman_r reliability_baseline reliability_flip ceiling r_over_ceiling", Q.SHIFT_SUMMARY),
    "q_metric_shift": Query(lambda s, d: R.metric_shift(C.pair_stats(ch(s, d)), "subject", n_boot=BOOT), "model metric factor comparable", "", "baseline flip shift shift_lo shift_hi p", Q.METRIC_SHIFT),
    "q_gap": Query(lambda s, d: R.gap(est(s, d), "qvar", n_boot=BOOT, n_split=SPLIT), "model factor", "", "r_within_half r_cross_half gap gap_lo gap_hi gap_p", Q.GAP),
    "q_construct_shift": Query(lambda s, d: R.construct_shift(R.shift(est(s, d), "qvar", n_boot=BOOT), fixture.entities(s, d)), "model factor construct", "n n_moved", "mean_shift min_shift max_shift", Q.CONSTRUCT_SHIFT),
    "q_condition_metrics": Query(lambda s, d: R.condition_report(C.pair_stats(ch(s, d)), est(s, d), CONDITION_BOOT, SPLIT), COND, "n_nodes triads cyclic", " ".join(f"{m} {m}_lo {m}_hi" for m in C.METRICS) + " reliability transitivity strict_transitivity", Q.CONDITION_METRICS),
    "q_fdr": Query(q_fdr, "stars", "p_partkey", "p q", Q.FDR),
    "q_consensus": Query(lambda s, d: H.consensus(rates(s, d)), "entity", "n_models", "mean_win sd_win min_win max_win mean_rank sd_rank", Q.CONSENSUS),
    "q_kendall_w": Query(lambda s, d: H.kendall_w(rates(s, d), PERM), "", "n_models n_attributes", "kendall_w p null_mean", Q.KENDALL),
    "q_model_agreement": Query(model_pairs, "model_a model_b", "n_attributes", "pearson_r spearman_r mean_abs_shift", Q.MODEL_AGREEMENT),
    "q_covariates": Query(lambda s, d: H.with_covariates(model_pairs(s, d), meta(s)), "model_a model_b family_a family_b", "", "pearson_r same_family same_generation d_log_params d_release_days", Q.COVARIATES),
    "q_family_gap": Query(lambda s, d: H.family_gap(model_pairs(s, d), meta(s), PERM), "", "n_pairs", "within between gap p", Q.FAMILY_GAP),
    "q_trends": Query(lambda s, d: H.trends(rates(s, d), meta(s), "release_days", PERM).unionByName(H.trends(rates(s, d), meta(s), "log_params", PERM)), "entity axis", "n_models", "rho p q", Q.TRENDS),
    "q_group_means": Query(lambda s, d: H.group_means(rates(s, d), meta(s), "family", ["walls", "wheels"]), "entity", "", "walls wheels", Q.GROUP_MEANS),
    "q_grid": Query(design_cells, "model qvar object subject no_pref_offered a b cell_key", "n_options trial", "", Q.GRID),
    "q_grid_balance": Query(lambda s, d: design_cells(s, d).groupBy("model", "no_pref_offered", F.array_join("option_order", "").alias("order_text")).agg(F.count("*").alias("n")), "model no_pref_offered order_text", "n", "", Q.BALANCE),
    "q_cell_keys": Query(lambda s, d: design_cells(s, d).groupBy("model").agg(F.count("*").alias("cells"), F.countDistinct("cell_key").alias("keys"), F.min("cell_key").alias("first_key")), "model first_key", "cells keys", "", Q.CELL_KEYS),
    "q_plan": Query(lambda s, d: G.plan(design_cells(s, d)), "qvar object subject", "cells", "", Q.PLAN),
    "q_pair_coverage": Query(lambda s, d: G.pair_coverage(est(s, d).select("a", "b").distinct(), fixture.entities(s, d)), "", "min_degree max_degree uncompared n_pairs cross_construct", "", Q.PAIR_COVERAGE),
    "q_render": Query(rendered, "cell_key user letter_a hash", "", "", Q.RENDER),
    "q_parse_letter": Query(lambda s, d: answers(s, d).withColumn("x", T.letter_answer(F.col("raw"), F.col("n_options"))).select("o_orderkey", "raw", "n_options", "x.*"), "raw refusal parse_failed", "o_orderkey n_options position", "", Q.PARSE_LETTER),
    "q_parse_rating": Query(lambda s, d: numbers(s, d).withColumn("x", T.number_answer(F.col("raw"), 1, 7)).select("o_orderkey", "raw", "x.*"), "raw refusal parse_failed", "o_orderkey", "rating", Q.PARSE_RATING),
    "q_strip_think": Query(lambda s, d: keyed_texts(s, d, [t[0] for t in Q.THOUGHTS]).withColumn("x", T.without_thoughts(F.col("raw"))).select("o_orderkey", "x.*"), "text had_thoughts", "o_orderkey", "", Q.STRIP_THINK),
    "q_dedup": Query(lambda s, d: records.deduplicated(attempts(s, d), ["cell_key"]), "cell_key notes", "payload", "", Q.DEDUP),
    "q_resume_pending": Query(lambda s, d: records.pending(attempts(s, d).select("cell_key").distinct(), records.done_keys(attempts(s, d), F.col("cell_key"))), "cell_key", "", "", Q.PENDING),
    "q_softmax": Query(q_softmax, "", "o_orderkey", "p1 p3 mass mean", Q.SOFTMAX),
    "q_top_bottom_k": Query(lambda s, d: C.top_and_bottom(C.pooled(wins(s, d)).withColumn("one", F.lit(1)).withColumn("v", F.round("win_rate", 9)), ["one"], "v", "entity", 5), "entity", "place", "v", Q.TOP_BOTTOM),
    "q_cohort_rows": Query(lambda s, d: H.cohort_rows(rates(s, d)).withColumn("n", F.size("scores")).withColumn("mean", F.round("mean", 9)), "entity", "n", "mean min max", Q.COHORT_ROWS),
    "q_flip_effects": Query(lambda s, d: R.flip_effects(wins(s, d)), "model entity factor", "", "effect", Q.FLIP_EFFECTS),
    "q_desirability_confound": Query(lambda s, d: R.desirability_confound(est(s, d), ratings(s, d)), COND, "n", "r_desirability r_length", Q.CONFOUND),
    "q_bt_tolerance": Query(lambda s, d: R.bradley_terry_until(at_base(s, d), ["model"]), "model entity", "", "bt_strength bt_win_vs_average", Q.BT_UNTIL),
    "q_mock_responder": Query(mock, "cell_key", "", "p1", Q.MOCK),
    "q_mantel": Query(lambda s, d: H.covariate_effects(model_pairs(s, d), meta(s), n_perm=PERM), "predictor", "n_pairs n_models n_perm", "marginal_r joint_beta marginal_p joint_p", Q.mantel()),
}

from . import stores  # noqa: E402  (its queries build on the plans above)

QUERIES |= stores.QUERIES
