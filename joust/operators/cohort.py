"""Operators across models: consensus, concordance, covariates, trends. Win rates stay long: entity, model, win_rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import FLAT, hash32, mean_rank, pearson, ratio, step_up

N_PERM = 5000
LEAST_MODELS = 4


def model_meta(models: DataFrame) -> DataFrame:
    """model, family, released, params_b -> plus log_params and days since the earliest release."""
    return models.withColumn("log_params", F.log10("params_b")).withColumn("release_days", F.datediff("released", F.min("released").over(Window.partitionBy())))


def consensus(rates: DataFrame) -> DataFrame:
    x = rates.where("win_rate is not null").withColumn("r", mean_rank("win_rate", ["model"], True))
    return x.groupBy("entity").agg(F.avg("win_rate").alias("mean_win"), F.stddev_samp("win_rate").alias("sd_win"), F.min("win_rate").alias("min_win"), F.max("win_rate").alias("max_win"), F.count("*").alias("n_models"), F.avg("r").alias("mean_rank"), F.stddev_samp("r").alias("sd_rank"))


def complete(rates: DataFrame) -> DataFrame:
    """Rows of entities that every model rates, with n (entities) and m (models)."""
    x = rates.where("win_rate is not null")
    m = x.agg(F.countDistinct("model").alias("m"))
    x = x.crossJoin(F.broadcast(m)).withColumn("__c", F.count("*").over(Window.partitionBy("entity"))).where(F.col("__c") == F.col("m")).drop("__c")
    return x.withColumn("n", F.count("*").over(Window.partitionBy("model")))


def concordance(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Kendall's W without tie correction; ranked: keys, entity, r, n, m."""
    s = ranked.groupBy(*keys, "entity").agg(F.sum("r").alias("s"), F.max("n").alias("n"), F.max("m").alias("m"))
    n, m = F.max("n").cast("double"), F.max("m").cast("double")
    w = ratio(12.0 * (F.sum(F.col("s") * F.col("s")) - F.sum("s") * F.sum("s") / n), m * m * (n * n * n - n))
    return s.groupBy(*keys).agg(w.alias("kendall_w"), F.max("m").alias("n_models"), F.max("n").alias("n_attributes"))


def kendall_w(rates: DataFrame, n_perm: int = N_PERM, seed: int = 41) -> DataFrame:
    """The statistic with its permutation null: every model's ranks are dealt anew, independently, by hash order."""
    x = complete(rates)
    x = x.withColumn("r", mean_rank("win_rate", ["model"])).withColumn("one", F.lit(1))
    obs = concordance(x, ["one"]).drop("one")
    pos = x.withColumn("ix", F.row_number().over(Window.partitionBy("model").orderBy("entity"))).select("model", "entity", "ix", "r", "n", "m")
    perm = pos.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    by = Window.partitionBy("rep", "model").orderBy(hash32(seed, F.col("rep"), F.col("model"), F.col("entity")), "entity")
    dealt = perm.select("rep", "model", "entity", F.row_number().over(by).alias("ix"), "n", "m").join(F.broadcast(pos.select("model", "ix", "r")), ["model", "ix"])
    null = concordance(dealt, ["rep"]).select(F.col("kendall_w").alias("v"))
    return null.crossJoin(F.broadcast(obs)).groupBy("kendall_w", "n_models", "n_attributes").agg(((F.count_if(F.col("v") >= F.col("kendall_w") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"), F.avg("v").alias("null_mean"))


#: What may predict how much two models agree.
COVARIATES = ("same_family", "same_generation", "d_log_params", "d_release_days")


def covariates(a, b) -> dict:
    """The covariates of two models from their family, generation, log_params, release_days (structs or prefixed
    columns); null where either is not known."""
    same = lambda x, y: F.coalesce((x == y).cast("double"), F.when(x.isNotNull() | y.isNotNull(), 0.0))
    return dict(zip(COVARIATES, (same(a["family"], b["family"]), same(a["generation"], b["generation"]), F.abs(a["log_params"] - b["log_params"]), F.abs(a["release_days"] - b["release_days"]).cast("double"))))


def with_generation(meta: DataFrame) -> DataFrame:
    return meta if "generation" in meta.columns else meta.withColumn("generation", F.lit(None).cast("string"))


def with_covariates(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """pairs: model_a, model_b, ...; adds family_a, family_b and the covariates."""
    known = F.struct("family", "generation", "log_params", "release_days")
    side = lambda s: with_generation(meta).select(F.col("model").alias(f"model_{s}"), known.alias(f"__{s}"))
    x = pairs.join(F.broadcast(side("a")), "model_a", "left").join(F.broadcast(side("b")), "model_b", "left")
    x = x.withColumns({"family_a": F.col("__a.family"), "family_b": F.col("__b.family")} | covariates(F.col("__a"), F.col("__b")))
    return x.drop("__a", "__b")


def family_gap(pairs: DataFrame, meta: DataFrame, n_perm: int = N_PERM, seed: int = 47) -> DataFrame:
    """Mean agreement within families less that between them, and a permutation p over the models' labels. Needs two
    families of two models, else no row."""
    big = meta.groupBy("family").count().where("count >= 2").agg(F.count("*").alias("k"))
    x = with_covariates(pairs, meta).where("pearson_r is not null and same_family is not null")
    parts = lambda f: [F.avg(F.when(F.col(f), F.col("pearson_r"))).alias("within"), F.avg(F.when(~F.col(f), F.col("pearson_r"))).alias("between")]
    obs = x.withColumn("f", F.col("same_family") == 1).agg(*parts("f"), F.count("*").alias("n_pairs")).withColumn("gap", F.col("within") - F.col("between"))
    order = meta.select("model", "family", F.row_number().over(Window.orderBy("model")).alias("ix"))
    perm = order.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    by = Window.partitionBy("rep").orderBy(hash32(seed, F.col("rep"), F.col("model")), "model")
    dealt = perm.select("rep", "model", F.row_number().over(by).alias("ix")).join(F.broadcast(order.select("ix", "family")), "ix")
    side = lambda s: dealt.select("rep", F.col("model").alias(f"model_{s}"), F.col("family").alias(f"new_{s}"))
    y = x.select("model_a", "model_b", "pearson_r").join(side("a"), "model_a").join(side("b"), ["rep", "model_b"]).withColumn("f", F.col("new_a") == F.col("new_b"))
    null = y.groupBy("rep").agg(*parts("f")).select((F.col("within") - F.col("between")).alias("v"))
    got = null.crossJoin(F.broadcast(obs)).groupBy("within", "between", "gap", "n_pairs").agg(((F.count_if(F.abs("v") >= F.abs("gap") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))
    return got.crossJoin(F.broadcast(big)).where("k >= 2").drop("k")


def trends(rates: DataFrame, meta: DataFrame, axis: str, n_perm: int = N_PERM, seed: int = 53) -> DataFrame:
    """Per entity, Spearman of its win rate with a model covariate. One permutation of the models serves every row;
    fewer than four models give no row, a flat row has null rho, p and q."""
    m = meta.where(F.col(axis).isNotNull()).withColumn("xr", mean_rank(axis, [])).withColumn("ix", F.row_number().over(Window.orderBy("model"))).withColumn("k", F.count("*").over(Window.partitionBy())).where(F.col("k") >= LEAST_MODELS).select("model", "xr", "ix")
    # only models with a place on the axis are ranked
    x = rates.where("win_rate is not null").join(F.broadcast(m), "model").withColumn("r", mean_rank("win_rate", ["entity"]))
    obs = x.groupBy("entity").agg(F.count("*").alias("n_models"), pearson("r", "xr").alias("rho"))
    perm = m.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    by = Window.partitionBy("rep").orderBy(hash32(seed, F.col("rep"), F.col("model")), "model")
    dealt = perm.select("rep", "model", F.row_number().over(by).alias("ix")).join(F.broadcast(m.select("ix", F.col("xr").alias("x2"))), "ix")
    null = x.select("entity", "model", "r").join(dealt, "model").groupBy("rep", "entity").agg(pearson("r", "x2").alias("v"))
    p = null.join(F.broadcast(obs.select("entity", "rho")), "entity").groupBy("entity").agg(F.when(F.max("rho").isNotNull(), (F.count_if(F.abs("v") >= F.abs("rho") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))
    return step_up(obs.join(p, "entity", "left").withColumn("axis", F.lit(axis)), "p", ["axis"], "q", ["entity"])


def group_means(rates: DataFrame, meta: DataFrame, by: str, levels: list[str]) -> DataFrame:
    return rates.join(F.broadcast(meta.select("model", by)), "model").groupBy("entity").pivot(by, levels).agg(F.avg("win_rate"))


def cohort_rows(rates: DataFrame) -> DataFrame:
    """A row an entity with its models' scores as a list, and its place by mean score."""
    x = rates.where("win_rate is not null").groupBy("entity").agg(F.avg("win_rate").alias("mean"), F.min("win_rate").alias("min"), F.max("win_rate").alias("max"), F.array_sort(F.collect_list(F.struct("model", "win_rate"))).alias("scores"))
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "entity")))


def covariate_effects(pairs: DataFrame, meta: DataFrame, value: str = "spearman_r", n_perm: int = N_PERM, seed: int = 43) -> DataFrame:
    """predictor, marginal_r, marginal_p, joint_beta, joint_p, n_pairs, n_models, n_perm: how each covariate goes with the
    agreement of two models, alone (a correlation) and beside the others (a least-squares slope), with the share of
    permutations of the models' labels that reach as much.

    A permutation is a hash order of the models, the metadata dealt anew, and its pairs are rows like any others: they add
    up to the sums of the normal equations in partial aggregates, so permutations are spread over tasks and nothing but
    one row a permutation meets. A covariate without variance here has nulls; the others are solved without it, as a
    Cholesky factor in columns. A permutation that leaves some varying covariate without variance, or too few pairs, is
    not used; nor has a singular one a slope. Under LEAST_MODELS models or four pairs there is no row, and with fewer
    pairs than what has to be fitted only nulls. Statistics that are equal but for rounding count as equal.
    """
    ends = pairs.select(F.explode(F.array("model_a", "model_b")).alias("model")).distinct()
    models = ends.join(with_generation(meta).select("model", "family", "generation", "log_params", "release_days"), "model", "left")
    # one row: the models in order of their names, a row a model
    listed = models.agg(F.array_sort(F.collect_list(F.struct("model", "family", "generation", "log_params", "release_days"))).alias("models"))
    reps = pairs.sparkSession.range(n_perm + 1).withColumnRenamed("id", "rep").crossJoin(F.broadcast(listed))
    by_hash = F.array_sort(F.transform("models", lambda m: F.struct(hash32(seed, F.col("rep"), m["model"]).alias("h"), m["model"].alias("k"), m.alias("m"))))
    dealt = F.when(F.col("rep") == 0, F.col("models")).otherwise(F.transform(by_hash, lambda x: x["m"]))
    reps = reps.withColumn("to", F.map_from_arrays(F.transform("models", lambda m: m["model"]), dealt)).withColumn("n_models", F.size("models")).drop("models")
    x = reps.crossJoin(pairs.select("model_a", "model_b", F.col(value).cast("double").alias("y")))
    x = x.withColumns(covariates(F.element_at("to", F.col("model_a")), F.element_at("to", F.col("model_b"))))
    x = x.select("rep", "n_models", "y", *[F.col(c).alias(f"x{j}") for j, c in enumerate(COVARIATES)]).where(" and ".join(f"{c} is not null" for c in ["y", "x0", "x1", "x2", "x3"]))
    # centred sums of squares and products, y as the last one
    names = [f"x{j}" for j in range(len(COVARIATES))] + ["y"]
    at = [(j, k) for k in range(len(names)) for j in range(k + 1)]
    n = F.count("*").cast("double")
    centred = [(F.sum(F.col(names[j]) * F.col(names[k])) - F.sum(names[j]) * F.sum(names[k]) / n).alias(f"c{j}{k}") for j, k in at]
    sums = x.groupBy("rep", "n_models").agg(F.count("*").alias("n"), *centred)
    first = sums.where("rep = 0 and n >= 4").select(F.col("n").alias("n_pairs"), *[(F.col(f"c{j}{j}") > FLAT).alias(f"live{j}") for j in range(len(COVARIATES))])
    sums = sums.join(F.broadcast(first)).where(F.col("n_models") >= LEAST_MODELS)
    fitted = solved(sums)
    obs = fitted.where("rep = 0").select(*[F.col(c).alias(f"o_{c}") for j in range(len(COVARIATES)) for c in (f"r{j}", f"b{j}")])
    reach = lambda c: F.count_if((F.col("rep") > 0) & F.col("used") & (F.abs(c) >= F.abs(F.col(f"o_{c}")) * (1 - 1e-9) - FLAT))
    done = F.count_if((F.col("rep") > 0) & F.col("used"))
    out = fitted.join(F.broadcast(obs)).groupBy("n_pairs", "n_models").agg(
        F.max(F.when(F.col("rep") == 0, F.col("used"))).alias("used"), done.alias("done"),
        *[F.struct(F.max(f"o_r{j}").alias("r"), reach(f"r{j}").alias("hits_r"), F.max(f"o_b{j}").alias("b"), reach(f"b{j}").alias("hits_b")).alias(f"of{j}") for j in range(len(COVARIATES))],
    )
    out = out.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("predictor"), F.col(f"of{j}").alias("of")) for j, c in enumerate(COVARIATES)])).alias("e"))
    share = lambda what: F.when(F.col("used") & F.col(f"e.of.{what}").isNotNull(), (F.col(f"e.of.hits_{what}") + 1) / (F.col("done") + 1))
    given = lambda what: F.when(F.col("used"), F.col(f"e.of.{what}"))
    return out.select(F.col("e.predictor").alias("predictor"), given("r").alias("marginal_r"), share("r").alias("marginal_p"), given("b").alias("joint_beta"), share("b").alias("joint_p"), "n_pairs", "n_models", F.when(F.col("used"), F.col("done")).alias("n_perm"))


def solved(sums: DataFrame) -> DataFrame:
    """Of the sums of covariate_effects(): used, and by covariate its correlation r and slope b. Without variance it has
    neither, and stands in the system as a row of the unit matrix."""
    m = len(COVARIATES)
    c = lambda j, k: F.col(f"c{min(j, k)}{max(j, k)}")
    live = lambda *js: F.forall(F.array(*[F.col(f"live{j}") for j in js]), lambda v: v)
    entry = lambda j, k: F.when(live(j, k), c(j, k)).otherwise(1.0 if j == k else 0.0)
    n_live = sum((F.col(f"live{j}").cast("int") for j in range(m)), F.lit(0))
    varies = F.forall(F.array(*[~F.col(f"live{j}") | (c(j, j) > FLAT) for j in range(m)]), lambda v: v)
    x = sums.withColumn("used", varies & (n_live > 0) & (F.col("n") >= n_live + 2))
    x = x.withColumns({f"r{j}": F.when(live(j) & (c(j, j) > FLAT) & (c(m, m) > FLAT), c(j, m) / F.sqrt(c(j, j) * c(m, m))) for j in range(m)})
    # the lower factor by columns; a pivot that is all but nothing makes the system singular
    for j in range(m):
        rest = entry(j, j) - sum((F.col(f"l{j}{i}") * F.col(f"l{j}{i}") for i in range(j)), F.lit(0.0))
        x = x.withColumn(f"l{j}{j}", F.when(rest > 1e-10 * entry(j, j), F.sqrt(F.greatest(rest, F.lit(0.0)))))
        for k in range(j + 1, m):
            x = x.withColumn(f"l{k}{j}", F.try_divide(entry(j, k) - sum((F.col(f"l{k}{i}") * F.col(f"l{j}{i}") for i in range(j)), F.lit(0.0)), F.col(f"l{j}{j}")))
    for j in range(m):
        right = F.when(live(j), c(j, m)).otherwise(0.0) - sum((F.col(f"l{j}{i}") * F.col(f"z{i}") for i in range(j)), F.lit(0.0))
        x = x.withColumn(f"z{j}", F.try_divide(right, F.col(f"l{j}{j}")))
    for j in reversed(range(m)):
        right = F.col(f"z{j}") - sum((F.col(f"l{k}{j}") * F.col(f"s{k}") for k in range(j + 1, m)), F.lit(0.0))
        x = x.withColumn(f"s{j}", F.try_divide(right, F.col(f"l{j}{j}")))
    return x.withColumns({f"b{j}": F.when(live(j), F.col(f"s{j}")) for j in range(m)})
