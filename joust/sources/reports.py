"""Report sinks and the payload of the presentation page."""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import tempfile
import textwrap
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .records import write_csv


def json_safe(value, digits: int = 6):
    """Not-a-number and infinities become null, floats are rounded, dates ISO strings."""
    if isinstance(value, dict):
        return {str(k): json_safe(v, digits) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [json_safe(v, digits) for v in value]
    if isinstance(value, float):
        return round(value, digits) if math.isfinite(value) else None
    return value.isoformat() if hasattr(value, "isoformat") else value


class Saver:
    """Report files with a manifest of themselves."""

    def __init__(self, folder: str) -> None:
        self.folder, self.rows = folder, []

    def csv(self, df: DataFrame, name: str, what: str = "") -> str:
        """Report tables are small: one file with a header, written by Spark into a folder of that name."""
        write_csv(df, f"{self.folder}/{name}")
        return self.artifact(name, what)

    def text(self, value: str, name: str, what: str = "") -> str:
        os.makedirs(self.folder, exist_ok=True)
        Path(self.folder, name).write_text(value, encoding="utf-8")
        return self.artifact(name, what)

    def artifact(self, name: str, what: str = "") -> str:
        """Lists a file that something else writes."""
        self.rows.append((name, what))
        return f"{self.folder}/{name}"

    def json(self, value, name: str, what: str = "") -> str:
        os.makedirs(self.folder, exist_ok=True)
        Path(self.folder, name).write_text(json.dumps(json_safe(value), indent=1, sort_keys=True))
        self.rows.append((name, what))
        return f"{self.folder}/{name}"

    def index(self) -> str:
        os.makedirs(self.folder, exist_ok=True)
        Path(self.folder, "README.md").write_text("".join(f"- `{n}`: {w}\n" for n, w in self.rows))
        return f"{self.folder}/README.md"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def number(cell: Column, digits: int = 4) -> Column:
    """A cell as a rounded number; empty, nan and text are null (cell_value() keeps text)."""
    v = cell.try_cast("double")
    return F.when(~F.isnan(v), F.round(v, digits))


def cell_value(cell: Column, digits: int = 4) -> Column:
    """A cell of a report as a variant: a rounded number, or text as it is; empty and nan are null."""
    return F.coalesce(number(cell, digits).cast("variant"), F.when(cell.try_cast("double").isNull() & (cell != ""), cell).cast("variant"))


def scores_checked(ranking: DataFrame, intervals: DataFrame, slack: float = 5e-4) -> DataFrame:
    """Points joined with their intervals; fails where the two files disagree on a point."""
    x = ranking.join(intervals.withColumnRenamed("win_rate", "__same"), ["model", "entity"])
    ok = F.abs(F.col("win_rate") - F.col("__same")) <= slack
    return x.withColumn("win_rate", F.when(ok, F.col("win_rate")).otherwise(F.raise_error(F.concat(F.lit("interval and point disagree: "), "model", F.lit("/"), "entity")).cast("double"))).drop("__same")


def payload(scores: DataFrame, meta: dict) -> str:
    """One JSON text: scores of every model by entity, with roll-ups. The page's frames are a few hundred rows."""
    per = scores.groupBy("entity").agg(F.avg("win_rate").alias("mean"), F.min("win_rate").alias("min"), F.max("win_rate").alias("max"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.round("win_rate", 4).alias("v"))))).alias("by_model"))
    rows = [json.loads(r[0]) for r in per.orderBy(F.desc("mean"), "entity").select(F.to_json(F.struct("entity", F.round("mean", 4).alias("mean"), F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), "by_model"))).collect()]
    return json.dumps(json_safe({"meta": meta, "entities": rows}), sort_keys=True)


def built_page(template: str, data: str, marker: str = "/*DATA*/") -> str:
    if marker not in template:
        raise ValueError("the template has no place for the data")
    return template.replace(marker, data, 1)


def page_data(page: str, marker: str = "const DATA = "):
    """The first JSON value after the marker in a built page."""
    return json.JSONDecoder().raw_decode(page[page.index(marker) + len(marker) :])[0]


def gaps(cov: DataFrame, levels: DataFrame) -> DataFrame:
    """(model, factor) of levels without a complete block."""
    return levels.join(cov.where("complete"), [c for c in levels.columns if c in cov.columns], "left_anti")


def item_case(x: Column) -> Column:
    """Every letter that follows no letter is upper case, the others lower; Ai before or after a space is AI, whatever
    follows, and an S after an apostrophe is small."""
    chars = F.split(F.lower(x), "")
    is_letter = lambda c: F.coalesce(c.rlike(r"^\p{L}$"), F.lit(False))
    title = F.array_join(F.transform(chars, lambda c, i: F.when(is_letter(F.get(chars, i - 1)) & (i > 0), c).otherwise(F.upper(c))), "")
    for old, new in (("Ai ", "AI "), (" Ai", " AI"), ("'S", "'s"), ("’S", "’s")):
        title = F.replace(title, F.lit(old), F.lit(new))
    return title


def wrapped(text: str, width: int) -> str:
    """Lines of whole words, none broken, also not at hyphens."""
    return "\n".join(textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


def bar(x: float, low: float = 0.0, high: float = 1.0, width: int = 24) -> str:
    """A value's place on a line with its middle marked."""
    at = max(0, min(width - 1, round((x - low) / (high - low) * (width - 1))))
    return "".join("#" if i == at else "|" if i == (width - 1) // 2 else "-" for i in range(width))


def shown(v: float | None, digits: int = 3) -> str:
    return "—" if v is None or not math.isfinite(v) else f"{v:.{digits}f}"


def checked_page(models: list[str], wanted: list[str], entities: DataFrame, scored: DataFrame, hues: int = 4) -> None:
    """Fails if a wanted model has no scores, an entity none, or the page would need more hues than it has."""
    if missing := [m for m in wanted if m not in models]:
        raise ValueError(f"no scores of {missing}")
    if lost := sorted(r[0] for r in entities.select("entity").join(scored.select("entity"), "entity", "left_anti").distinct().collect()):
        raise ValueError(f"no scores for {lost}")
    if len(wanted) > hues:
        raise ValueError(f"{len(wanted)} models for {hues} hues")


def at_baseline(stated: dict, own: dict) -> None:
    """Fails if results were made at another baseline than the page's."""
    if off := sorted(k for k in own if str(stated.get(k)).lower() != str(own[k]).lower()):
        raise ValueError(f"another baseline in {off}")


def ellipsis(x: Column, width: int) -> Column:
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 1), F.lit("…"))).otherwise(x)


def histogram(df: DataFrame, value: str, keys: list[str], bins: int = 20) -> DataFrame:
    """Counts in equal bins of [0, 1]; the last bin holds its upper end."""
    at = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def fitted_line(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Least-squares slope and intercept; null where x does not vary."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    s = df.where(ok).groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    s = s.withColumn("slope", ratio(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))))
    return s.select(*keys, "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))


def write_status(path: str, **fields) -> None:
    """Replaced as a whole, so a reader never sees half of it."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w") as f:
        json.dump(json_safe({"updated": time.time(), **fields}), f)
    os.replace(temp, path)


def read_status(path: str) -> dict | None:
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None


def duration(seconds: float | None) -> str:
    if seconds is None:
        return "?"
    s = int(seconds)
    return f"{s // 3600}h{s % 3600 // 60:02d}m" if s >= 3600 else f"{s // 60}m{s % 60:02d}s" if s >= 60 else f"{s}s"


def age(then: str | None, now: dt.datetime) -> str:
    try:
        return duration((now - dt.datetime.fromisoformat(then)).total_seconds()) + " ago"
    except (TypeError, ValueError):
        return "?"
