"""URL filter: allow/block rules by host and path prefix, and gradient-boosted trees where no rule fits.

The trees are boosted on lexical features of the url (lengths, depth, digit ratio, entropy, parameters, suffix
statistics), trained from the urls that the rules label. Each tree is oblivious: one split a level, chosen from one
histogram aggregate (leaf x feature x bin) that Spark computes; the driver sees sums of a bounded number of cells,
never rows. A model is a Column expression, so scoring stays in code generation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (rule, verdict); a rule is host + path prefix and fits the host and all subdomains, the longest wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Most labelled rows that the fit reads; they are chosen by hash of the url, so each run takes the same.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, SUFFIXES = 10, 3, 12, 0.3, 1.0, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """df plus __host and __path."""
    x = df.withColumn("__url", F.col(url))
    host, path = host_path(F.col("__url"))
    return x.withColumn("__host", host).withColumn("__path", path)


def ruled(df: DataFrame, rules=RULES) -> DataFrame:
    """Parsed rows plus __rule and __ruled, the longest fitting rule and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        host, path = text.split("/", 1)
        fits = ((F.col("__host") == host) | F.col("__host").endswith("." + host)) & F.col("__path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return df.withColumn("__rule", rule).withColumn("__ruled", verdict)


def bucket() -> Column:
    """A bounded number of host suffixes: the last label, hashed."""
    return F.pmod(F.xxhash64(F.substring_index("__host", ".", -1)), F.lit(SUFFIXES)).cast("int")


def features(rates: list[float]) -> dict[str, Column]:
    """rates: share of blocked labelled urls by suffix bucket, smoothed."""
    url, path = F.coalesce(F.col("__url"), F.lit("")), F.col("__path")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    chars = F.array_remove(F.split(url, ""), "")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - F.log2((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n) * (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    return {
        "url_len": F.length(url).cast("double"),
        "host_len": F.length("__host").cast("double"),
        "path_len": F.length(path).cast("double"),
        "depth": count(path, "/").cast("double"),
        "labels": count(F.col("__host"), ".").cast("double"),
        "digits": count(url, "0123456789") / n,
        "hyphens": count(url, "-_").cast("double"),
        "entropy": entropy,
        "params": F.when(F.contains(url, F.lit("?")), count(url, "&") + 1).otherwise(0).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "suffix": F.element_at(F.array(*map(F.lit, rates)), bucket() + 1),
        "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1).cast("string").isin("html", "htm", "php", "asp").cast("double"),
    }


@dataclass
class Forest:
    base: float = 0.0
    rates: list[float] = field(default_factory=lambda: [0.5] * SUFFIXES)
    trees: list[tuple[list[tuple[str, float]], list[float]]] = field(default_factory=list)

    def margin(self, named: dict[str, Column]) -> Column:
        total = F.lit(float(self.base))
        for splits, leaves in self.trees:
            total = total + F.element_at(F.array(*map(F.lit, leaves)), leaf(named, splits) + 1)
        return total


def leaf(named: dict[str, Column], splits: list[tuple[str, float]]) -> Column:
    ix = F.lit(0)
    for name, at in splits:
        ix = ix * 2 + (named[name] > at).cast("int")
    return ix


def weight(g: float, h: float) -> float:
    return g * g / (h + RIDGE)


def halves(bins: list[list[float]]) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    """For each cut between bins, the sums of gradient and curvature below and above it."""
    total, low, out = [sum(b[z] for b in bins) for z in (0, 1)], [0.0, 0.0], []
    for b in bins[:-1]:
        low = [low[0] + b[0], low[1] + b[1]]
        out.append((tuple(low), (total[0] - low[0], total[1] - low[1])))
    return out


def fit(labelled: DataFrame, most: int = TRAIN_ROWS) -> Forest:
    """labelled: parsed rows with __block 0/1. Without rows of both labels the forest is a constant."""
    x = cut(labelled.orderBy(F.xxhash64("__url"), "__url").limit(most).select("__url", "__host", "__path", F.col("__block").cast("double").alias("y")).coalesce(2))
    stats = x.groupBy(bucket().alias("b")).agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()
    rows, ones = sum(r["n"] for r in stats), sum(r["s"] for r in stats)
    if not rows or ones in (0, rows):
        return Forest(base=-4.0 if not ones else 4.0)
    prior, out = ones / rows, Forest(base=math.log(ones / (rows - ones)))
    out.rates = [prior] * SUFFIXES
    for r in stats:
        out.rates[r["b"]] = float((r["s"] + 10 * prior) / (r["n"] + 10))
    made = features(out.rates)
    x = cut(x.select("y", *[c.alias(k) for k, c in made.items()]))
    cuts = x.agg(*[F.percentile(k, F.array(*[F.lit(i / BINS) for i in range(1, BINS)])).alias(k) for k in made]).first().asDict()
    cuts = {k: sorted(set(v)) for k, v in cuts.items()}
    bins = [F.struct(F.lit(i).alias("f"), sum(((F.col(k) > t).cast("int") for t in cuts[k]), F.lit(0)).alias("b")) for i, k in enumerate(made)]
    names, named = list(made), {k: F.col(k) for k in made}
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-out.margin(named)))
        work = x.withColumn("g", F.col("y") - p).withColumn("h", p * (1 - p)).withColumn("cell", F.explode(F.array(*bins)))
        splits: list[tuple[str, float]] = []
        for level in range(DEPTH):
            cells = [[[[0.0, 0.0] for _ in range(len(cuts[k]) + 1)] for k in names] for _ in range(2**level)]
            for r in work.groupBy(leaf(named, splits).alias("l"), "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                cells[r["l"]][r["cell"]["f"]][r["cell"]["b"]] = [r["g"], r["h"]]
            best = (1e-9, None)
            for i, k in enumerate(names):
                sides = [halves(of[i]) for of in cells]
                for j, at in enumerate(cuts[k]):
                    gain = sum(weight(*low) + weight(*high) - weight(low[0] + high[0], low[1] + high[1]) for low, high in (s[j] for s in sides))
                    if gain > best[0]:
                        best = (gain, (k, at), [RATE * g / (h + RIDGE) for s in sides for g, h in s[j]])
            if best[1] is None:
                break
            splits.append(best[1])
            leaves = best[2]
        if not splits:
            break
        out.trees.append((splits, leaves))
    return out


def judge(df: DataFrame, url: str = "url", rules=RULES, model: Forest | None = None, most: int = TRAIN_ROWS) -> DataFrame:
    """All rows of df plus host, path, rule, verdict and the model's block probability.

    Defined cases: null urls and urls without `://` have empty host and path, fit no rule and get the model's
    verdict; repeated rows are judged alike; without labelled urls the model allows; input columns named as the
    outputs are dropped for them, all others pass through.
    """
    x = ruled(parsed(df, url), rules)
    model = model or fit(x.where("__ruled is not null").withColumn("__block", (F.col("__ruled") == "block").cast("int")), most)
    risk = 1 / (1 + F.exp(-model.margin(features(model.rates))))
    x = x.withColumn("__risk", risk)
    verdict = F.coalesce("__ruled", F.when(F.col("__risk") >= 0.5, "block").otherwise("allow"))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "risk")]
    return x.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"), F.col("__risk").alias("risk"))


def op3_url_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
