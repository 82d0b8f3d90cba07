"""Estimators against numpy or hand-computed values on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from joust.functions.stats import interval, mean_rank, pearson, step_up, step_up_rows, two_sided
from joust.operators import choices as C
from joust.operators import cohort as H
from joust.operators import ranking as R
from joust.schemas import BASELINE, CONDITION

ROW = "model string, qvar string, object string, subject string, no_pref_offered boolean, a string, b string, n_options int, answered boolean, refused boolean, chose_none boolean, chose_a boolean, chose_b boolean, pos_a int, pos_b int, pos_none int, chosen_position int, trial int"


def choice(a, b, won, first=True, model="M", none=False, answered=True, trial=0, **over):
    cond = BASELINE | over
    pos_a, pos_b = (1, 2) if first else (2, 1)
    got = (answered and none, answered and not none and won == a, answered and not none and won == b)
    at = 3 if got[0] else pos_a if got[1] else pos_b if got[2] else None
    return (model, *cond.values(), a, b, 3 if cond["no_pref_offered"] else 2, answered, False, *got, pos_a, pos_b, 3, at, trial)


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def estimates(spark, prefs, n=10, model="M", **over):
    cond = BASELINE | over
    rows = [(model, *cond.values(), a, b, n, round(n * p), n - round(n * p), 0, n, 0.0, round(n * p) / n) for (a, b), p in prefs.items()]
    return spark.createDataFrame(rows, "model string, qvar string, object string, subject string, no_pref_offered boolean, a string, b string, n long, n_a long, n_b long, n_none long, n_orders long, p_none double, pref_a double")


def latent(k, seed=0, n=10):
    s = np.arange(1, k + 1)
    rng = np.random.default_rng(seed)
    return {(f"E{i:02d}", f"E{j:02d}"): min(max(s[i] / (s[i] + s[j]) + rng.normal(0, 0.03), 0.02), 0.98) for i in range(k) for j in range(i + 1, k)}


def test_all_abstained_pair_has_no_preference_but_counts(spark):
    df = frame(spark, [choice("x", "y", None, none=True), choice("x", "z", "x"), choice("x", "z", None, answered=False)])
    got = {(r.a, r.b): r for r in C.pair_estimates(df).collect()}
    assert got["x", "y"].pref_a is None and got["x", "y"].p_none == 1.0
    assert got["x", "z"].n == 1 and got["x", "z"].pref_a == 1.0
    wins = {r.entity: r for r in C.win_rates(C.pair_estimates(df)).collect()}
    assert wins["x"].n_pairs == 2 and wins["x"].win_rate == 1.0 and wins["y"].win_rate is None


@pytest.mark.parametrize("slots,bias", [([1, 2, 3], 0.0), ([1, 1, 1], 1.0)])
def test_position_bias_bounds(spark, slots, bias):
    rows = [tuple(v if i != 16 else s for i, v in enumerate(choice("x", "y", "x"))) for s in slots]
    assert C.position_bias(frame(spark, rows)).first().bias == pytest.approx(bias)


def test_consistency_needs_both_orders_and_margin(spark):
    rows = [choice("x", "y", "x"), choice("x", "y", "y", first=False), choice("x", "z", "x")]
    got = C.order_consistency(frame(spark, rows)).collect()
    assert len(got) == 1 and got[0].flipped and got[0].decisive and got[0].delta == 1.0


def test_exact_margin_of_a_tenth_is_decisive_as_computed(spark):
    rows = [choice("x", "y", "x" if i < 2 else "y") for i in range(5)] + [choice("x", "y", "x" if i < 3 else "y", first=False) for i in range(5)]
    r = C.order_consistency(frame(spark, rows)).first()
    assert r.decisive == (min(abs(2 / 5 - 0.5), abs(3 / 5 - 0.5)) >= 0.10)


def test_rates_of_hand_set_counts(spark):
    counts = dict(n=100, answered=90, refused=4, none=9, pos1=60, pos2=30, pos3=0, duel=81, duel_lo=54, decisive=20, flipped=5, delta=3.0, has_delta=30, n_options=2)
    row = spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} {'double' if k == 'delta' else 'long'}" for k in counts))
    r = row.select(*[v.alias(k) for k, v in C.rates(F.col("n_options"), F.col).items()]).first()
    assert (r.answer_rate, r.refusal_rate, r.flip_rate) == (0.9, 0.04, 0.25)
    assert r.slot_duel_lo == pytest.approx(54 / 81) and r.mean_abs_delta == pytest.approx(0.1)
    assert r.position_bias == pytest.approx(1 / 3) and r.no_pref_rate is None


def test_transitivity_of_a_cycle_and_a_tie(spark):
    est = estimates(spark, {("a", "b"): 0.9, ("b", "c"): 0.9, ("a", "c"): 0.1})
    assert tuple(C.transitivity(est).first()[c] for c in ("triads", "cyclic", "strict_triads")) == (1, 1, 1)
    tie = estimates(spark, {("a", "b"): 0.9, ("b", "c"): 0.9, ("a", "c"): 0.5})
    r = C.transitivity(tie).first()
    assert r.cyclic == 1 and r.strict_triads == 0 and r.strict_transitivity is None
    assert C.transitivity(estimates(spark, {("a", "b"): 0.9})).first().transitivity is None


def test_pearson_equals_numpy_and_is_null_when_flat(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=30), rng.normal(size=30)
    df = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, y)] + [(1, 1.0, float(b)) for b in y] + [(2, 1.0, 2.0)], "g int, x double, y double")
    got = {r.g: r.r for r in df.groupBy("g").agg(pearson("x", "y").alias("r")).collect()}
    assert got[0] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got[1] is None and got[2] is None


def test_step_up_ignores_nulls_and_is_monotone(spark):
    p = [0.001, 0.01, 0.02, 0.2, 0.5, None]
    got = [r.q for r in step_up(spark.createDataFrame([(i, v, 1) for i, v in enumerate(p)], "i int, p double, g int"), "p", ["g"], "q", ["i"]).orderBy("i").collect()]
    assert got[5] is None and got[:2] == pytest.approx([0.005, 0.025]) and got[:5] == sorted(got[:5]) and all(q >= v for q, v in zip(got, p[:5]))


@pytest.mark.parametrize("rows", [step_up, step_up_rows])
def test_step_up_of_many_rows_equals_the_definition_in_one_pass(spark, rows):
    rng = np.random.default_rng(4)
    some = [0.0, 1e-300, 1e-9, 0.5, 0.5, 1.0, 1.0, None]
    data = [(k, float(v)) for k, v in enumerate(rng.random(300) ** 3)] + [(300 + k, v) for k, v in enumerate(some)]
    df = spark.createDataFrame([(g, i, v) for g in (None, "a") for i, v in data] + [("b", 0, 0.03), ("c", 0, None)], "g string, i int, p double")
    got = rows(df, "p", ["g"], "q")
    assert got.columns == ["g", "i", "p", "q"] and "currentrow$(), unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    got = got.collect()
    assert len(got) == df.count() and all(r.q is None for r in got if r.p is None)
    v = np.sort([p for _, p in data if p is not None])
    raw = v * len(v) / np.arange(1, len(v) + 1)
    for g in (None, "a"):
        want = {p: min(1.0, raw[k:].min()) for k, p in reversed([*enumerate(v)])}
        assert {(r.p, r.q) for r in got if r.g == g and r.p is not None} == {*want.items()}
    assert [r.q for r in got if r.g == "b"] == [0.03]


def test_interval_and_p(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)], "x double")
    lo, hi = interval("x")
    r = df.agg(lo.alias("lo"), hi.alias("hi"), two_sided("x").alias("p")).first()
    assert (r.lo, r.hi) == pytest.approx(tuple(np.percentile(np.arange(1, 101), [2.5, 97.5]))) and r.p == pytest.approx(0.01)
    assert df.where("x < 0").agg(two_sided("x").alias("p")).first().p is None


def test_average_ranks_truncate(spark):
    df = spark.createDataFrame([("g", v) for v in (3.0, 2.0, 2.0, 1.0)], "g string, v double")
    assert sorted(r.r for r in df.select(mean_rank("v", ["g"], True).alias("r")).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_strengths_recover_the_order_and_match_the_tolerance_fit(spark):
    est = estimates(spark, latent(12), n=100)
    fold = {r.entity: r.bt_strength for r in R.bradley_terry(est, rounds=400).collect()}
    loop = {r.entity: r.bt_strength for r in R.bradley_terry_until(est).collect()}
    assert fold == pytest.approx(loop, abs=1e-6)
    order = sorted(fold, key=fold.get)
    assert np.corrcoef([order.index(e) for e in sorted(fold)], range(12))[0, 1] > 0.9


def test_bootstrap_covers_the_point_and_repeats(spark):
    est = estimates(spark, latent(10))
    a = {r.entity: (r.ci_lo, r.ci_hi) for r in R.bootstrap_intervals(est, n_boot=100).collect()}
    b = {r.entity: (r.ci_lo, r.ci_hi) for r in R.bootstrap_intervals(est.repartition(7), n_boot=100).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    for r in C.win_rates(est).collect():
        assert a[r.entity][0] <= r.win_rate <= a[r.entity][1]


def test_reliability_needs_eight_pairs(spark):
    assert R.reliability(estimates(spark, latent(12)), n_split=30).first().reliability > 0.6
    assert R.reliability(estimates(spark, latent(4)), n_split=5).first().reliability is None


def both(spark, flipped):
    return estimates(spark, latent(12, 1), n=50).unionByName(estimates(spark, {k: flipped(v) for k, v in latent(12, 2).items()}, n=50, qvar="preservation"))


def test_same_conditions_show_no_gap_and_reversed_ones_do(spark):
    same = R.gap(both(spark, lambda p: p), "qvar", n_boot=60, n_split=20).first()
    other = R.gap(both(spark, lambda p: 1 - p), "qvar", n_boot=60, n_split=20).first()
    assert abs(same.gap) < 0.1 and other.gap > 0.3 and other.gap_p < 0.05
    assert R.shift(both(spark, lambda p: 1 - p), "qvar", n_boot=60).where("q < 0.05").count() > 5
    assert R.shift_summary(both(spark, lambda p: p), "qvar", n_boot=40, n_split=10).first().pearson_r > 0.9


def test_contrast_and_agreement(spark):
    wins = C.win_rates(both(spark, lambda p: 1 - p))
    r = R.contrast(wins, "qvar").first()
    assert r.r < -0.9 and (r.level_a, r.level_b) == ("increase", "preservation")
    got = R.agreement(wins, "qvar", ["model"]).first()
    assert got.pearson_r == pytest.approx(r.r) and got.spearman_r < -0.9


def cohort(spark, perms):
    return spark.createDataFrame([(f"E{i:02d}", f"M{m}", float(v)) for m, p in enumerate(perms) for i, v in enumerate(p)], "entity string, model string, win_rate double")


def test_concordance(spark):
    same = H.kendall_w(cohort(spark, [np.arange(20)] * 5), n_perm=100).first()
    assert same.kendall_w == pytest.approx(1.0) and same.p < 0.05
    rng = np.random.default_rng(5)
    mixed = H.kendall_w(cohort(spark, [rng.permutation(20) for _ in range(5)]), n_perm=100).first()
    assert mixed.p > 0.01 and mixed.kendall_w < 0.6


META = [("M0", "f", "2024-01-01", 1.0), ("M1", "f", "2024-02-01", 3.0), ("M2", "g", "2024-03-01", 9.0), ("M3", "g", "2024-04-01", 27.0), ("M4", "g", "2024-05-01", 81.0)]


def meta(spark, rows=META):
    return H.model_meta(spark.createDataFrame(rows, "model string, family string, released string, params_b double").withColumn("released", F.to_date("released")))


def test_trends_leave_flat_rows_null(spark):
    rows = [("up", f"M{m}", m / 10) for m in range(5)] + [("flat", f"M{m}", 0.5) for m in range(5)]
    got = {r.entity: r for r in H.trends(spark.createDataFrame(rows, "entity string, model string, win_rate double"), meta(spark), "log_params", 120).collect()}
    assert got["up"].rho == pytest.approx(1.0) and got["up"].p < 0.1
    assert got["flat"].rho is None and got["flat"].p is None and got["flat"].q is None


def test_family_gap_needs_two_families(spark):
    rng = np.random.default_rng(2)
    pairs = R.agreement(cohort(spark, [rng.normal(size=12) for _ in range(5)]), "model", [])
    assert H.family_gap(pairs, meta(spark), 30).count() == 1
    assert H.family_gap(pairs, meta(spark, [(m, "f", d, p) for m, _, d, p in META]), 30).count() == 0
    rows = {r.predictor: r for r in H.covariate_effects(pairs, with_generations(meta(spark)), n_perm=50).collect()}
    assert rows["d_log_params"].n_pairs == 10 and rows["d_log_params"].n_models == 5 and 0 < rows["d_log_params"].marginal_p <= 1


def with_generations(m):
    return m.withColumn("generation", F.when(F.substring("model", 2, 1).isin("0", "3"), "old").otherwise("new"))


def test_constant_predictor_has_null_p(spark):
    rng = np.random.default_rng(2)
    pairs = R.agreement(cohort(spark, [rng.normal(size=12) for _ in range(5)]), "model", [])
    m = with_generations(meta(spark, [(m, "f", d, p) for m, _, d, p in META]))
    rows = {r.predictor: r for r in H.covariate_effects(pairs, m, n_perm=20).collect()}
    assert rows["same_family"].marginal_p is None and rows["same_family"].joint_beta is None and rows["d_log_params"].joint_p is not None
    few = pairs.where("model_a in ('M0', 'M1', 'M2') and model_b in ('M0', 'M1', 'M2')")
    assert H.covariate_effects(few, m, n_perm=20).count() == 0
    # four models, six pairs: enough for four covariates but not with one pair less
    four = pairs.where("model_a <> 'M4' and model_b <> 'M4'").where("not (model_a = 'M0' and model_b = 'M1')")
    rows = H.covariate_effects(four, with_generations(meta(spark)), n_perm=20).collect()
    assert len(rows) == 4 and all(r.marginal_r is None and r.n_perm is None and r.n_pairs == 5 for r in rows)


def test_completeness(spark):
    df = frame(spark, [choice("x", "y", "x", trial=t, no_pref_offered=False) for t in range(2)] + [choice("x", "y", "x")])
    cov = C.coverage(df, 1)
    assert {(r.no_pref_offered, r.complete) for r in cov.collect()} == {(False, True), (True, False)}
    assert C.complete_blocks(df, cov).count() == 2 and set(CONDITION) <= set(cov.columns) and math.isclose(cov.agg(F.max("fraction")).first()[0], 1.0)


def test_tolerance_fit_solves_the_score_equations(spark):
    est = estimates(spark, latent(9, 4), n=40)
    got = {r.entity: r.bt_strength for r in R.bradley_terry_until(est).collect()}
    p = {e: math.exp(s) for e, s in got.items()}
    assert math.prod(p.values()) == pytest.approx(1.0)
    wins, games = dict.fromkeys(p, 0.5), {e: [(1.0, 1.0)] for e in p}
    for r in est.collect():
        wins[r.a] += r.n_a
        wins[r.b] += r.n_b
        games[r.a].append((r.n, p[r.b]))
        games[r.b].append((r.n, p[r.a]))
    # at the fit, each strength is proportional to wins over summed exposure; the geometric mean sets the factor
    raw = {e: wins[e] / sum(n / (p[e] + q) for n, q in games[e]) for e in p}
    factor = math.exp(np.mean([math.log(raw[e]) for e in p]))
    assert {e: v / factor for e, v in raw.items()} == pytest.approx(p, rel=1e-6)


def test_covariate_effects_equal_plain_regression_and_all_permutations(spark):
    from itertools import permutations

    rng = np.random.default_rng(7)
    pairs = R.agreement(cohort(spark, [rng.normal(size=12) + 0.3 * m for m in range(6)]), "model", [])
    rows = [(f"M{i}", "fgh"[i % 3], f"2024-0{1 + i * i % 7}-01", 3.0 ** (i * 5 % 6)) for i in range(6)]
    m = with_generations(meta(spark, rows))
    of = {r.model: r for r in m.collect()}
    value = {(r.model_a, r.model_b): r.spearman_r for r in pairs.collect()}
    ends, y = [*value], np.array([*value.values()])

    def design(to):
        side = [(of[to[a]], of[to[b]]) for a, b in ends]
        return np.array([[a.family == b.family, a.generation == b.generation, abs(a.log_params - b.log_params), abs(a.release_days - b.release_days)] for a, b in side], float)

    def fit(x):
        return np.array([np.corrcoef(x[:, j], y)[0, 1] for j in range(4)]), np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0][1:]

    models = sorted(of)
    obs = fit(design(dict(zip(models, models))))
    got = {r.predictor: r for r in H.covariate_effects(pairs, m, n_perm=4000).collect()}
    hits, every = np.zeros((2, 4)), [*permutations(models)]
    for q in every:
        hits += [np.abs(a) >= np.abs(b) * (1 - 1e-9) for a, b in zip(fit(design(dict(zip(models, q)))), obs)]
    for k, n in enumerate(H.COVARIATES):
        assert got[n].marginal_r == pytest.approx(obs[0][k]) and got[n].joint_beta == pytest.approx(obs[1][k])
        assert abs(got[n].marginal_p - hits[0, k] / len(every)) < 0.04 and abs(got[n].joint_p - hits[1, k] / len(every)) < 0.04


def test_pair_stats_in_one_pass_equal_the_consistency_of_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [choice(a, b, a if rng.random() < 0.6 else b, first=bool(rng.integers(2)), none=bool(rng.random() < 0.1), answered=bool(rng.random() < 0.9)) for a, b in (("x", "y"), ("x", "z"), ("y", "z")) for _ in range(9)] + [choice("v", "w", "v")]
    df = frame(spark, rows)
    want = {(r.a, r.b): (r.delta, int(r.decisive), int(r.flipped), 1) for r in C.order_consistency(df).collect()}
    for r in C.pair_stats(df).collect():
        assert (r.delta, r.decisive, r.flipped, r.has_delta) == pytest.approx(want.get((r.a, r.b), (0.0, 0, 0, 0)))


def test_condition_report_joins_reliability_and_transitivity(spark):
    df = frame(spark, [choice(a, b, a, first=k % 2 == 0) for a, b in (("x", "y"), ("x", "z"), ("y", "z")) for k in range(4)])
    r = R.condition_report(C.pair_stats(df), C.pair_estimates(df), 10, 5).first()
    assert r.answer_rate == 1.0 and r.transitivity == 1.0 and r.triads == 1 and r.reliability is None
