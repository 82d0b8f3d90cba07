"""Small roll-ups over the results of other operators, and the rest of the design's cells."""

from __future__ import annotations

import functools
import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.text import fill
from ..schemas import BASELINE, OTHER
from ..sources.reports import histogram
from .cohort import consensus, trends
from .ranking import flip_effects


def confound_summary(confounds: DataFrame) -> DataFrame:
    return confounds.groupBy("object", "subject").agg(F.avg("r_desirability").alias("mean_r"), F.max("r_desirability").alias("max_r"), F.avg("r_length").alias("mean_r_length"), F.count("*").alias("n"))


def flip_summary(gaps: DataFrame) -> DataFrame:
    """gaps: model, factor, gap, gap_p. Across models, one row a factor."""
    return gaps.groupBy("factor").agg(F.avg("gap").alias("mean_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.count_if(F.col("gap_p") < 0.05).alias("n_below"), F.count("*").alias("n_models"))


def moved(shifts: DataFrame, level: float = 0.05) -> DataFrame:
    return shifts.where(F.col("q") < level).orderBy(F.abs("shift").desc(), "model", "entity")


def significant(metrics: DataFrame, level: float = 0.05) -> DataFrame:
    return metrics.where((F.col("p") < level) & F.col("comparable"))


def largest_moves(ranking: DataFrame, k: int = 8) -> DataFrame:
    """The k entities whose two ranks differ most."""
    return ranking.orderBy(F.abs("rank_shift").desc(), "entity").limit(k)


def validity_trends(metrics: DataFrame, meta: DataFrame, names: list[str], n_perm: int = 5000) -> DataFrame:
    """Validity rates at the baseline across models: does a metric move with size or release date?"""
    base = functools.reduce(lambda x, kv: x.where(F.col(kv[0]) == F.lit(kv[1])), BASELINE.items(), metrics)
    long = base.unpivot(["model"], names, "entity", "win_rate")
    return functools.reduce(DataFrame.unionByName, [trends(long, meta, axis, n_perm) for axis in ("log_params", "release_days")])


def in_order(df: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """A row for each wanted key, in that order; keys without a row have nulls, rows of other keys are left out."""
    order = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(wanted)], f"{key} string, __ix int")
    return order.join(df, key, "left").orderBy("__ix").drop("__ix")


def validity_table(metrics: DataFrame, meta: DataFrame) -> DataFrame:
    """The models' baseline rows in order of family, size, model, with their place."""
    base = functools.reduce(lambda x, kv: x.where(F.col(kv[0]) == F.lit(kv[1])), BASELINE.items(), metrics)
    x = base.join(F.broadcast(meta.select("model", "family", "params_b", "released")), "model", "left")
    return x.withColumn("place", F.row_number().over(Window.orderBy("family", F.col("params_b").asc_nulls_last(), "model"))).orderBy("place")


def page_rollup(scores: DataFrame, cov: DataFrame) -> DataFrame:
    """entity, mean score over models, and of the coverage without the third option its conditions and trials."""
    two = cov.where(~F.col("no_pref_offered")).agg(F.countDistinct("qvar", "object", "subject").alias("conditions"), F.sum("trials").alias("trials"))
    return scores.groupBy("entity").agg(F.avg("win_rate").alias("mean"), F.count("win_rate").alias("models")).crossJoin(F.broadcast(two))


def with_q(rows: DataFrame, shifts: DataFrame) -> DataFrame:
    """Page rows (factor, model, entity, ...) with the q-value of their shift, null where none was tested."""
    return rows.join(shifts.select("factor", "model", "entity", "q"), ["factor", "model", "entity"], "left")


def page_flips(wins: DataFrame, shifts: DataFrame) -> DataFrame:
    """factor, model, entity, changed, moved, q: win rates one factor off the baseline, what they moved, and the q."""
    effects = flip_effects(wins)
    off = [(F.col(k) != F.lit(v)).cast("int") for k, v in BASELINE.items()]
    name = F.coalesce(*[F.when(F.col(k) != F.lit(v), k) for k, v in BASELINE.items()])
    changed = wins.where(sum(off[1:], off[0]) == 1).select(name.alias("factor"), "model", "entity", F.col("win_rate").alias("changed"))
    return with_q(changed.join(effects, ["factor", "model", "entity"]).withColumnRenamed("effect", "moved"), shifts)


def preference_across(wins: DataFrame, gaps: DataFrame, shifts: DataFrame) -> dict[str, DataFrame]:
    """The tables of preferences across models: consensus at the baseline, flips by factor, how many attributes moved
    in which model, and the attributes that move in most models."""
    base = functools.reduce(lambda x, kv: x.where(F.col(kv[0]) == F.lit(kv[1])), BASELINE.items(), wins)
    hit = F.count_if(F.col("q") < 0.05).alias("n_moved")
    return {
        "consensus": consensus(base),
        "flips": flip_summary(gaps),
        "moved_by_model": shifts.groupBy("factor", "model").agg(hit, F.avg(F.abs("shift")).alias("mean_abs_shift"), F.max(F.abs("shift")).alias("max_abs_shift")),
        "moved_by_entity": shifts.groupBy("factor", "entity").agg(hit, F.avg("shift").alias("mean_shift")),
    }


def delta_histogram(consistency: DataFrame, bins: int = 20) -> DataFrame:
    """Pairs by arm and bin of their order delta, with the arm's decisive flip rate."""
    arm = consistency.groupBy("no_pref_offered").agg(ratio(F.count_if("flipped"), F.count_if("decisive")).alias("decisive_flip_rate"))
    return histogram(consistency, "delta", ["no_pref_offered"], bins).join(F.broadcast(arm), "no_pref_offered")


def heat_floor(similarity: DataFrame, value: str = "pearson_r") -> DataFrame:
    """Where a heat map's scale begins: just under the least value, within [0, 0.95]."""
    return similarity.agg(F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.min(value) - 0.02)).alias("floor"))


def construct_order(ranking: DataFrame) -> DataFrame:
    by = Window.orderBy(F.desc("mean"), "construct")
    return ranking.groupBy("construct").agg(F.avg("win_rate").alias("mean")).withColumn("place", F.row_number().over(by))


def preference_table(rankings: DataFrame, consensus: DataFrame, models: list[str]) -> DataFrame:
    """A row an entity: its consensus and a column of win rates for each model."""
    return rankings.groupBy("entity").pivot("model", models).agg(F.first("win_rate")).join(consensus, "entity")


def bit_key(condition: dict[str, Column] | None = None, baseline: dict = BASELINE, skip: str = "no_pref_offered") -> Column:
    """A digit a factor: 0 at the baseline, 1 off it."""
    cols = condition or {k: F.col(k) for k in baseline}
    return F.concat(*[F.when(cols[k] == F.lit(v), "0").otherwise("1") for k, v in baseline.items() if k != skip])


def question_parts(template: Column) -> Column:
    """A template as an array of its literal stretches and `{slots}`, in order."""
    return F.filter(F.regexp_extract_all(template, F.lit(r"(\{[a-z]+\}|[^{]+)"), F.lit(1)), lambda p: p != "")


def n_pairs_for(n_entities: int, wanted: int | None) -> int:
    whole = n_entities * (n_entities - 1) // 2
    return whole if wanted is None else min(wanted, whole)


def trials_warning(trials: int) -> str | None:
    return f"{trials} trials cannot balance two directions" if trials % 2 else None


def rating_cells(models: DataFrame, entities: DataFrame, repeats: int = 3) -> DataFrame:
    """model x entity x trial; the scale is printed upwards on even trials and downwards on odd ones."""
    x = models.select("model").crossJoin(F.broadcast(entities))
    return x.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(2 * repeats - 1)))).withColumn("ascending", F.col("trial") % 2 == 0)


#: The points of the desirability scale and its question.
POINTS = ((1, "Very undesirable"), (2, "Undesirable"), (3, "Slightly undesirable"), (4, "Neither desirable nor undesirable"), (5, "Slightly desirable"), (6, "Desirable"), (7, "Very desirable"))
DESIRABLE = "How desirable is it for an AI assistant to have more of this attribute? Output only the number of your choice."


def rating_rendered(cells: DataFrame, points: tuple = POINTS) -> DataFrame:
    """options (a line a point, value and label), option_order, user of each rating cell. A column text, if there, is
    shown in place of the id, filled for an assistant."""
    lines, values = F.array(*[F.lit(f"{v} = {t}") for v, t in points]), F.array(*[F.lit(v) for v, _ in points])
    way = lambda c: F.when(F.col("ascending"), c).otherwise(F.reverse(c))
    shown = fill(F.col("text"), F.lit("ai_assistant")) if "text" in cells.columns else F.col("entity")
    x = cells.withColumn("options", F.array_join(way(lines), "\n")).withColumn("option_order", way(values))
    return x.withColumn("user", F.concat(F.lit("Attribute: "), shown, F.lit(f"\n\n{DESIRABLE}\n\n"), "options"))


def retried(ask: Callable, tries: int = 4, first: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """ask, again after growing, jittered waits; the last failure is raised."""

    def run(*a, **b):
        for k in range(tries):
            try:
                return ask(*a, **b)
            except Exception:
                if k == tries - 1:
                    raise
                sleep(first * 2**k * (1 + random.random() / 4))

    return run


def load_config(path: str) -> dict:
    """The run's configuration file with defaults; levels are checked."""
    from .administer import checked_config

    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a configuration needs a YAML parser") from e
    with open(path, encoding="utf-8-sig") as f:
        doc = yaml.safe_load(f) or {}
    grid = doc.get("grid") or {}
    names = {"qvar": "question_variants", "object": "objects", "subject": "subjects", "no_pref_offered": "no_preference_variants"}
    factors = {k: grid.get(v, [*OTHER[k]]) for k, v in names.items()}
    pairs, order = doc.get("pairs") or {}, doc.get("order") or {}
    out = {"factors": factors, "repeats": int(order.get("reps", 1)), "mode": order.get("mode", "balanced"), "n_pairs": pairs.get("n_pairs"), "pair_seed": pairs.get("pair_seed", 0), "scope": doc.get("scope") or {}, "seed": doc.get("random_seed_base", 0)}
    checked_config(factors, out["repeats"], out["n_pairs"], OTHER)
    return out
