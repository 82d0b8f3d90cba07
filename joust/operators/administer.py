"""Administration of a design: responders over cells, parsed into records, with tallies and drift guard."""

from __future__ import annotations

import hashlib
import json
import signal
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONTEXT, FORMAT, METHOD, MODE, PARAPHRASE, cell_seed, letter_answer
from ..schemas import FIELDS
from ..sources.records import is_error, pending


LOW_MASS = 0.5


class Instrument(Protocol):
    """What an instrument supplies: frames in, frames out."""

    def cells(self) -> DataFrame: ...
    def rendered(self, cells: DataFrame) -> DataFrame: ...
    def parsed(self, answers: DataFrame) -> DataFrame: ...


#: name -> factory of a function from a list of prompts to a list of answers; called once a partition.
RESPONDERS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {}


def responder(name: str):
    def keep(factory):
        RESPONDERS[name] = factory
        return factory

    return keep


@responder("mock")
def mock():
    """Picks the option at a hash of the prompt."""

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            k = max(1, p.count("\n"))
            out.append("ABCDEFGH"[int(hashlib.sha256(p.encode()).hexdigest(), 16) % k])
        return out

    return answer


def answered(cells: DataFrame, name: str = "mock", batch: int = 25) -> DataFrame:
    """cell_key, raw, notes of rendered cells. Cells are dealt by key, so no model is one task; a responder is built
    once a partition. A failing batch is asked again one by one; a failing prompt becomes an error row, not a failed
    job."""
    import pandas as pd

    factory = RESPONDERS[name]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for pdf in parts:
            prompts, raw, notes = (pdf.question + "\n" + pdf.options).tolist(), [], []
            for at in range(0, len(prompts), batch):
                some = prompts[at : at + batch]
                try:
                    got = [(r, "") for r in ask(some)]
                except Exception:
                    got = []
                    for p in some:
                        try:
                            got.append((ask([p])[0], ""))
                        except Exception as e:
                            got.append((None, f"error: {e}"))
                raw += [g[0] for g in got]
                notes += [g[1] for g in got]
            yield pd.DataFrame({"cell_key": pdf.cell_key, "raw": raw, "notes": notes})

    return cells.select("model", "cell_key", "question", "options").repartition("cell_key").mapInPandas(run, "cell_key string, raw string, notes string")


def recorded(cells: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers back on their cells, parsed and decoded through each cell's own letters."""
    x = cells.join(answers, "cell_key").withColumn("x", letter_answer(F.col("raw"), F.col("n_options")))
    letter = F.get(F.array(*map(F.lit, "ABCDEFGH")), F.col("x.position") - 1)
    return x.withColumn("choice", F.coalesce(F.element_at("letter_map", letter), F.lit(""))).withColumn("refused", F.col("x.refusal") & ~is_error(F.col("notes"))).withColumn("parse_failed", F.col("x.parse_failed")).withColumn("position", F.col("x.position")).drop("x")


def run(cells: DataFrame, store: DataFrame | None, name: str = "mock") -> DataFrame:
    """One resumable run: only cells without a good row in the store are asked."""
    todo = cells if store is None else pending(cells, store.where(~is_error(F.col("notes"))).select("cell_key").distinct())
    return recorded(todo, answered(todo, name))


def tallies(rows: DataFrame) -> DataFrame:
    """Rows with a share of option mass (option_mass_coverage) that is too low are counted if there is one."""
    low = F.count_if(F.col("option_mass_coverage") < LOW_MASS) if "option_mass_coverage" in rows.columns else F.lit(0).cast("bigint")
    return rows.groupBy("model").agg(F.count("*").alias("written"), F.count_if(is_error(F.col("notes"))).alias("errors"), F.count_if("refused").alias("refusals"), F.count_if(F.col("parse_failed") & ~F.col("refused")).alias("parse_failures"), low.alias("low_coverage"))


def provenance(records: DataFrame, seq: str) -> DataFrame:
    """The first row seen of each model."""
    return records.groupBy("model_id").agg(F.min_by(F.struct("model_ref", "model_family", "model_generation", "model_release_date", "backend", "quantization"), seq).alias("first")).select("model_id", "first.*")


def desirability(records: DataFrame) -> DataFrame:
    """Mean rating of each (model, entity), with the number of rated rows."""
    x = records.where("welfare_probe = 'desirability' and parsed_rating is not null")
    return x.groupBy(F.col("model_id").alias("model"), F.col("entity_a").alias("entity")).agg(F.avg("parsed_rating").alias("rating"), F.count("*").alias("n"))


def metadata(models: DataFrame, registry: DataFrame, first_seen: DataFrame) -> DataFrame:
    """model with its registry row, else what its records say."""
    r = registry.select("model", F.col("family").alias("rf"), F.col("released").alias("rd"), "params_b")
    s = first_seen.select(F.col("model_id").alias("model"), F.col("model_family").alias("sf"), F.to_date("model_release_date").alias("sd"))
    return models.join(F.broadcast(r), "model", "left").join(F.broadcast(s), "model", "left").select("model", F.coalesce("rf", "sf").alias("family"), F.coalesce("rd", "sd").alias("released"), "params_b")


def modal(shares: F.Column) -> F.Column:
    """The key of the largest share, the first of equals in key order."""
    top = F.array_max(F.map_values(shares))
    return F.get(F.transform(F.filter(F.array_sort(F.map_entries(shares)), lambda e: e["value"] == top), lambda e: e["key"]), 0)


def fingerprint(config: dict) -> str:
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def guard(config: dict, status: dict | None, force: bool = False) -> str:
    """Fails if a store was begun under another configuration."""
    own = fingerprint(config)
    if status and status.get("fingerprint") not in (None, own) and not force:
        raise ValueError("the store was written under another configuration")
    return own


def checked_config(factors: dict[str, list], repeats: int, n_pairs: int | None, known: dict[str, tuple]) -> None:
    for name, levels in factors.items():
        if not levels:
            raise ValueError(f"{name} has no level")
        if bad := [v for v in levels if v not in known[name]]:
            raise ValueError(f"{name} has unknown levels {bad}")
    if repeats < 1 or (n_pairs is not None and n_pairs < 1):
        raise ValueError("repeats and n_pairs must be one or more")


def baseline_of(text: str, known: dict[str, tuple]) -> dict:
    """`k=v,k=v` -> a complete baseline; every factor once, levels known."""
    out = {}
    for part in filter(None, map(str.strip, text.split(","))):
        k, sep, v = part.partition("=")
        level = {str(x).lower(): x for x in known.get(k, ())}.get(v.strip().lower())
        if not sep or level is None or k in out:
            raise ValueError(f"not a factor and level: {part}")
        out[k] = level
    return {k: v[0] for k, v in known.items()} | out


def progress(done: int, total: int, seconds: float) -> dict:
    rate = done / seconds if seconds > 0 else None
    return {"done": done, "total": total, "per_second": rate, "eta_s": (total - done) / rate if rate else None}


def low_coverage(rows: DataFrame, least: float = LOW_MASS) -> DataFrame:
    return rows.where(F.col("option_mass_coverage") < least)


def few_comparisons(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Entities that meet fewer than so many others."""
    return pairs.select(F.explode(F.array("a", "b")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") < least)


class Stop:
    """Set by the first SIGINT or SIGTERM, so that a loop over batches ends after the one at hand; the second signal
    has its usual effect. Off the main thread, where signals cannot be taken, it is set by hand."""

    def __init__(self) -> None:
        self.asked = False
        for sig in (signal.SIGINT, signal.SIGTERM):
            try:
                signal.signal(sig, self.take)
            except ValueError:
                pass

    def take(self, number: int, frame=None) -> None:
        self.asked = True
        try:
            signal.signal(number, signal.SIG_DFL)
        except ValueError:
            pass


def run_in_batches(cells: DataFrame, write: Callable[[DataFrame], None], name: str = "mock", batches: int = 8, stop: Stop | None = None, told: Callable[[dict], None] | None = None) -> int:
    """Cells asked and written in so many batches by key, each a job of its own whose rows are there before the next
    begins; a stop that is asked for ends the run between two of them. told: gets the progress after each. Returns the
    number of batches that were done; a new run takes up the rest, as any resumed run does."""
    began, part = time.monotonic(), F.pmod(F.xxhash64("cell_key"), F.lit(batches))
    for k in range(batches):
        if stop and stop.asked:
            return k
        some = cells.where(part == k)
        write(recorded(some, answered(some, name)))
        if told:
            told(progress(k + 1, batches, time.monotonic() - began))
    return batches


def full_record(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows of recorded() as stored records: every field, in order. specs: one row a model with what the registry says
    (model, ref, family, generation, released, kind, quant_format, quant, backend, in_window, reasoning_control,
    thinks_by_default, temperature, and reasoning_applied if it is known)."""
    names = "ref family generation released kind quant_format quant backend in_window reasoning_control thinks_by_default temperature".split()
    names += ["reasoning_applied"] if "reasoning_applied" in specs.columns else []
    x = rows.join(F.broadcast(specs.select("model", F.struct(*names).alias("s"))), "model", "left")
    c = F.col
    values = {
        "record_id": F.uuid(), "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        "model_id": c("model"), "model_ref": c("s.ref"), "model_family": c("s.family"), "model_generation": c("s.generation"), "model_release_date": c("s.released").cast("string"), "model_kind": c("s.kind"), "quantization": c("s.quant"), "backend": c("s.backend"),
        "in_window": c("s.in_window"), "reasoning_control": c("s.reasoning_control"), "reasoning_thinks_by_default": c("s.thinks_by_default"), "method": F.lit(METHOD), "item_id": c("a"), "reverse_keyed": F.lit(False),
        "framing": c("object"), "referent": F.when(c("object") == "self", "I").otherwise("an AI assistant"), "reasoning_mode": F.lit(MODE), "response_format": F.lit(FORMAT["choice"]), "item_context": F.lit(CONTEXT), "ack_disclaimer": F.lit(False), "paraphrase_id": F.lit(PARAPHRASE),
        "n_scale_points": c("n_options"), "option_order": F.transform("option_order", lambda p: p + 1), "order_seed": cell_seed(0, c("cell_key")), "trial_idx": c("trial"), "item_text_shown": F.regexp_replace("options", r"(?:^|\n)([A-Z]): ", " | ").substr(F.lit(4), F.length("options")), "raw_output": c("raw"),
        "parsed_rating": c("position").cast("double"), "temperature": c("s.temperature"), "reasoning_applied": c("s.reasoning_applied") if "reasoning_applied" in names else F.lit(None), "modal_rating": c("modal") if "modal" in x.columns else F.lit(None), "reasoning_standardized": F.lit(True), "refusal_flag": c("refused"), "parse_failed": c("parse_failed"), "prompt_hash": c("hash"), "prompt_system": c("system"), "prompt_user": c("user"), "notes": c("notes"),
        "module": F.lit("welfare"), "welfare_probe": F.lit("choice"), "welfare_qvar": c("qvar"), "welfare_object": c("object"), "welfare_subject": c("subject"), "welfare_system_framing": F.when(c("system") == "", "none").otherwise("brief"), "entity_a": c("a"), "entity_b": c("b"), "welfare_options": c("letter_map"), "welfare_choice": c("choice"), "no_preference_offered": c("no_pref_offered"),
    }
    return x.select(*[values.get(n, F.lit(d)).cast(t).alias(n) for n, t, d in FIELDS])
