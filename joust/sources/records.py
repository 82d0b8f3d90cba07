"""The record store and the files of batch providers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cell_key, flag
from ..schemas import FIELDS, RECORD


def record_key() -> Column:
    """Identity of a record, of the fields that name its cell; records of an instrument with a design of its own also
    by what that adds. A required field that is missing fails the job."""
    c = F.col
    shared = [c(n) for n in "model_id item_id framing reasoning_mode response_format item_context paraphrase_id method trial_idx".split()]
    own = [F.coalesce(n, F.lit("")) for n in "welfare_probe welfare_qvar welfare_subject entity_b".split()]
    return F.when(c("module") == "battery", cell_key(*shared)).otherwise(cell_key(c("module"), *shared, *own, flag(F.coalesce("no_preference_offered", F.lit(False)))))


def defaulted(df: DataFrame) -> DataFrame:
    for name, _, default in FIELDS:
        if default is not None:
            df = df.withColumn(name, F.coalesce(name, F.lit(default)))
    return df


def read_records(spark: SparkSession, paths: str | list[str], module: str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines. Unknown fields are dropped and missing ones take their defaults. strict: a malformed line fails the
    read; else it is skipped, as is a row without a model."""
    if strict:
        x = spark.read.schema(RECORD).option("mode", "FAILFAST").json(paths)
    else:
        x = spark.read.schema(T.StructType([*RECORD.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(paths)
        x = x.where("_corrupt_record is null and model_id is not null").drop("_corrupt_record")
    x = defaulted(x)
    return x.where(F.col("module") == module) if module else x


def ordered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records with seq, their order: by the place of the path in the list, then by the line's place in its file."""
    parts = [read_records(spark, p).withColumn("__path", F.lit(i)).withColumn("__block", F.col("_metadata.file_block_start")).withColumn("__file", F.col("_metadata.file_path")).withColumn("__row", F.monotonically_increasing_id()) for i, p in enumerate(paths)]
    x = functools.reduce(DataFrame.unionByName, parts)
    return x.withColumn("seq", F.struct("__path", "__file", "__block", "__row")).drop("__path", "__file", "__block", "__row")


def is_error(notes: Column) -> Column:
    return F.coalesce(notes.startswith("error:"), F.lit(False))


def deduplicated(df: DataFrame, key: list[str], seq: str = "seq", notes: str = "notes") -> DataFrame:
    """The first row of a key that is no error, else its first error. min_by keeps it a partial aggregate."""
    row = F.struct(*df.columns)
    x = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.min_by(row, F.struct(is_error(F.col(notes)), F.col(seq))).alias("row"))
    return x.select("row.*")


def done_keys(df: DataFrame, key: Column, retry_errors: bool = True) -> DataFrame:
    x = df.where(~is_error(F.col("notes"))) if retry_errors else df
    return x.select(key.alias("cell_key")).distinct()


def pending(cells: DataFrame, done: DataFrame) -> DataFrame:
    return cells.join(done.select("cell_key"), "cell_key", "left_anti")


def capped(cells: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """At most so many cells a model, the first in design order: a feature of trial runs."""
    return cells.withColumn("__n", F.row_number().over(Window.partitionBy("model").orderBy(*order))).where(F.col("__n") <= limit).drop("__n")


CONTENT = "array<struct<type string, text string>>"


def decoded(lines: DataFrame) -> DataFrame:
    """value (a JSON line of either provider, told by the key that it has) -> custom_id, text, error, refused.

    error says what failed whole: the type and the error object of one provider, the error or the status and the body of
    the other; objects as JSON. A row with an error has an empty text and is no decline. A decline's text is its content.
    Blank lines are left out; a line of another shape, or that is no JSON, fails the job.
    """
    x = lines.where(F.trim("value") != "").select("value", F.parse_json("value").alias("r"), F.json_object_keys("value").alias("keys"))
    get = lambda path, kind="string": F.try_variant_get("r", path, kind)
    shape = F.when(F.array_contains("keys", "result"), 1).when(F.array_contains("keys", "response"), 2)
    x = x.withColumn("one", F.when(shape.isNotNull(), shape == 1).otherwise(F.raise_error(F.concat(F.lit("unknown result shape: "), F.substring("value", 1, 200))).cast("boolean")))
    said = F.array_join(F.transform(F.filter(get("$.result.message.content", CONTENT), lambda c: c["type"] == "text"), lambda c: F.coalesce(c["text"], F.lit(""))), "")
    kind = F.coalesce(get("$.result.type"), F.lit("unknown"))
    failed = F.when(kind != "succeeded", F.concat(kind, F.lit(": "), F.coalesce(get("$.result.error"), F.lit("null"))))
    status, own = get("$.response.status_code", "int"), F.nullif(get("$.error"), F.lit(""))
    http = F.when(status.isNull() | (status != 200), F.concat(F.lit("http "), F.coalesce(status.cast("string"), F.lit("null")), F.lit(": "), F.coalesce(get("$.response.body"), F.lit("null"))))
    message = "$.response.body.choices[0]"
    declined = get(f"{message}.message.refusal").isNotNull() | F.coalesce(get(f"{message}.finish_reason") == "content_filter", F.lit(False))
    x = x.withColumn("error", F.when(F.col("one"), failed).otherwise(F.coalesce(own, http)))
    text = F.when(F.col("one"), said).otherwise(get(f"{message}.message.content"))
    refused = F.when(F.col("one"), F.coalesce(get("$.result.message.stop_reason") == "refusal", F.lit(False))).otherwise(declined)
    fine = F.col("error").isNull()
    return x.select(get("$.custom_id").alias("custom_id"), F.when(fine, F.coalesce(text, F.lit(""))).otherwise(F.lit("")).alias("text"), "error", (fine & refused).alias("refused"))


#: The endpoint of the body style, generations that take no temperature, that reason unless told not to
#: and at which effort, and those where leaving the switch out is off.
ENDPOINT = "/v1/chat/completions"
NO_TEMPERATURE, EFFORT_NONE, OMITTED, LOW_EFFORT = ("claude-5",), ("gpt-5.6",), ("claude-4.5",), ("claude-5",)
#: A shard's most requests and bytes by style.
CAPS = {"params": (100_000, 256_000_000), "body": (50_000, 200_000_000)}


def requests(cells: DataFrame, style: str, specs: DataFrame | None = None) -> DataFrame:
    """model, cell_key, line: a provider request as JSON for each rendered cell, reasoning switched off. style: params
    (the system text is a field) or body (it is a message). specs: model, ref, generation, temperature, max_tokens;
    without it the model's name is its reference and 16 tokens are asked for."""
    if specs is None:
        specs = cells.select("model").distinct().select("model", F.col("model").alias("ref"), F.lit("").alias("generation"), F.lit(None).cast("double").alias("temperature"), F.lit(16).alias("max_tokens"))
    x = cells.join(F.broadcast(specs.select("model", F.struct("ref", "generation", "temperature", "max_tokens").alias("spec"))), "model")
    of = lambda *names: F.col("spec.generation").isin(*names)
    said = F.nullif("system", F.lit(""))
    user = F.struct(F.lit("user").alias("role"), F.col("user").alias("content"))
    if style == "params":
        off = F.when(~of(*OMITTED), F.struct(F.lit("disabled").alias("type")))
        effort = F.when(of(*LOW_EFFORT), F.struct(F.lit("low").alias("effort")))
        warm = F.when(~of(*NO_TEMPERATURE), F.col("spec.temperature"))
        body = F.struct(F.col("spec.ref").alias("model"), F.col("spec.max_tokens").alias("max_tokens"), F.array(user).alias("messages"), said.alias("system"), warm.alias("temperature"), off.alias("thinking"), effort.alias("output_config"))
        row = F.struct(F.col("cell_key").alias("custom_id"), body.alias("params"))
    else:
        system = F.struct(F.lit("system").alias("role"), F.col("system").alias("content"))
        messages = F.when(said.isNotNull(), F.array(system, user)).otherwise(F.array(user))
        effort = F.when(of(*EFFORT_NONE), "none").otherwise("minimal")
        body = F.struct(F.col("spec.ref").alias("model"), messages.alias("messages"), F.col("spec.max_tokens").alias("max_completion_tokens"), effort.alias("reasoning_effort"))
        row = F.struct(F.col("cell_key").alias("custom_id"), F.lit("POST").alias("method"), F.lit(ENDPOINT).alias("url"), body.alias("body"))
    return x.select("model", "cell_key", F.to_json(row).alias("line"))


def reasoning_applied(style: str, generation: Column) -> Column:
    """What a request asserts about reasoning, as the record says it."""
    if style == "params":
        return F.when(generation.isin(*OMITTED), "omitted(off)").otherwise("disabled")
    return F.when(generation.isin(*EFFORT_NONE), "reasoning_effort=none").otherwise("reasoning_effort=minimal")


def known_models(wanted: list[str], specs: DataFrame) -> None:
    """Fails if a model is not among the specs, which are as few as the registry's rows."""
    known = {r[0] for r in specs.select("model").collect()}
    if unknown := sorted({*wanted} - known):
        raise ValueError(f"unknown models: {', '.join(unknown)}; known: {', '.join(sorted(known))}")


#: Every field of a record is written, most of them null: text that repeats itself, a fiftieth of it compressed. A
#: compressed file is one task's to read, so it holds few records.
STORE = {"ignoreNullFields": "false", "compression": "gzip", "maxRecordsPerFile": 200_000}


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").options(**STORE).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header: for report tables, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
