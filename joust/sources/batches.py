"""Files of batch providers: requests packed under two caps and written with their sidecars, results folded into records.

Request files go through a Python data source. Its tasks write whole files under passing names, and its commit, which runs
once all of them are done, gives the files their names and writes each model's sidecar; a job that fails or a task that
runs twice leaves neither half a file nor a file twice.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import letter_answer
from ..operators.administer import full_record
from ..session import fresh
from .banks import safe_name
from .records import CAPS, ENDPOINT, NO_TEMPERATURE, STORE, decoded, done_keys, pending, read_records, reasoning_applied, record_key, requests

#: The endpoint of the style whose system text is a field, the note of a decline, and the temperature that
#: is recorded where a request sends none.
PARAMS_ENDPOINT, DECLINED, PROVIDER_TEMPERATURE = "/v1/messages", "refusal: provider policy decline", 1.0


def places(lines: DataFrame) -> DataFrame:
    """model, cell_key, own (bytes with the line's end), r (place in the model, from 0), before (bytes before it), in key
    order: a range shuffle of narrow rows, sums inside a range, and sums of ranges before it. A model may fill any number
    of ranges."""
    x = lines.select("model", "cell_key", (F.octet_length("line") + 1).cast("long").alias("own"))
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = stored(x.repartitionByRange(n, "model", "cell_key").sortWithinPartitions("model", "cell_key").withColumn("at", F.monotonically_increasing_id()), "places")
    x = x.withColumn("block", F.shiftright("at", 33))
    inside = Window.partitionBy("block", "model").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy("block", "model").agg(F.count("*").alias("n"), F.sum("own").alias("size"))
    earlier = Window.partitionBy("model").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = sums.select("block", "model", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size0"))
    x = x.withColumn("n1", F.count("*").over(inside)).withColumn("size1", F.coalesce(F.sum("own").over(inside), F.lit(0)))
    return x.join(sums, ["block", "model"]).select("model", "cell_key", "own", (F.col("n0") + F.col("n1")).alias("r"), (F.col("size0") + F.col("size1")).alias("before"))


def stored(df: DataFrame, name: str) -> DataFrame:
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def next_starts(x: DataFrame, max_requests: int, max_bytes: int) -> DataFrame:
    """model, r, to: where the next file begins if one begins at line r; null if it takes all that is left.

    Lines are cut by their ends into stretches of max_bytes, so the first line beyond the cap is in the stretch of the
    cap's place or is the first of the next one that has lines. A window runs over a stretch, never over a model.
    """
    x = x.withColumn("end", F.col("before") + F.col("own")).withColumn("limit", F.col("before") + F.lit(max_bytes))
    stretch = lambda c: F.floor(F.col(c) / F.lit(max_bytes)).cast("long").alias("stretch")
    ends = x.select("model", stretch("end"), F.col("end").alias("v"), F.lit(0).alias("asks"), "r")
    asked = x.select("model", stretch("limit"), F.col("limit").alias("v"), F.lit(1).alias("asks"), "r")
    # of equal values the line is before the question: it still fits
    after = Window.partitionBy("model", "stretch").orderBy("v", "asks", "r").rowsBetween(1, Window.unboundedFollowing)
    found = ends.unionByName(asked).withColumn("to", F.min(F.when(F.col("asks") == 0, F.col("r"))).over(after)).where("asks = 1").drop("asks", "v")
    firsts = ends.groupBy("model", "stretch").agg(F.min("r").alias("first"))  # a row a stretch
    # a stretch that is asked for may have no line of its own
    known = firsts.unionByName(found.select("model", "stretch").distinct().join(firsts, ["model", "stretch"], "left_anti").withColumn("first", F.lit(None).cast("long")))
    known = known.withColumn("later", F.min("first").over(Window.partitionBy("model").orderBy("stretch").rowsBetween(1, Window.unboundedFollowing))).drop("first")
    size = x.groupBy("model").agg(F.count("*").alias("size"))
    got = found.join(known, ["model", "stretch"]).join(size, "model")
    # a line that is over the cap alone is a file of its own
    to = F.greatest(F.col("r") + 1, F.least(F.coalesce("to", "later", "size"), F.col("r") + F.lit(max_requests)))
    return got.select("model", "r", F.when(to < F.col("size"), to).alias("to"))


def file_starts(jumps: DataFrame) -> DataFrame:
    """model, r: where files begin, from line 0 on, by pointer doubling: a round doubles both the files that are known
    and what a jump leaps over, so there are as many rounds as the logarithm of the files of a model."""
    jumps = stored(jumps, "jumps")
    known = jumps.where("r = 0").select("model", "r")
    while True:
        more = stored(known.join(jumps.where("to is not null"), ["model", "r"]).select("model", F.col("to").alias("r")), "starts")
        if more.isEmpty():
            return known
        known = stored(known.unionByName(more), "starts")
        further = jumps.select("model", F.col("r").alias("to"), F.col("to").alias("beyond"))
        jumps = stored(jumps.join(further, ["model", "to"], "left").select("model", "r", F.col("beyond").alias("to")), "jumps")


def sharded(lines: DataFrame, max_requests: int, max_bytes: int) -> DataFrame:
    """model, shard (from 0), cell_key, line: packed in key order, a new shard where either cap would break."""
    x = stored(places(lines), "placed")
    starts = file_starts(next_starts(x, max_requests, max_bytes))
    by = Window.partitionBy("model").orderBy("r")  # a row a file
    starts = starts.select("model", "r", (F.row_number().over(by) - 1).alias("shard"), F.lead("r").over(by).alias("end"))
    # a file is no longer than a stretch of max_requests lines, so it lies in two of them at most
    stretch = lambda c: F.floor(c / F.lit(max_requests)).cast("long")
    ends = x.groupBy("model").agg(F.count("*").alias("size"))
    starts = starts.join(ends, "model").withColumn("stretch", F.explode(F.sequence(stretch(F.col("r")), stretch(F.coalesce("end", "size") - 1))))
    starts = starts.select("model", "stretch", F.greatest("r", F.col("stretch") * max_requests).alias("r"), F.lit(0).alias("kind"), "shard", F.lit(None).cast("string").alias("cell_key"))
    rows = x.select("model", stretch(F.col("r")).alias("stretch"), "r", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("shard"), "cell_key")
    upto = Window.partitionBy("model", "stretch").orderBy("r", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(starts).withColumn("shard", F.last("shard", ignorenulls=True).over(upto)).where("kind = 1")
    return found.select("model", "cell_key", "shard").join(lines, ["model", "cell_key"]).select("model", "shard", "cell_key", "line")


# what is written


@dataclass
class Written(WriterCommitMessage):
    """model, shard, passing name, requests, bytes of each file."""

    files: list[tuple[str, int, str, int, int]]


class RequestWriter(DataSourceWriter):
    """Rows model, shard, folder, line, all rows of a file in one task and in order."""

    def __init__(self, options: dict) -> None:
        self.folder, self.style = options["path"], options["style"]
        self.array = options.get("array", "false").lower() == "true"
        self.sidecars = json.loads(options.get("sidecars", "{}"))

    def write(self, iterator: Iterator) -> Written:
        fs, top = filesystem(self.folder)
        fs.create_dir(top, recursive=True)
        files, now, out, n, size = [], None, None, 0, 0

        def put(text: str) -> None:
            nonlocal size
            raw = text.encode()
            out.write(raw)
            size += len(raw)

        def close() -> None:
            if out is not None:
                if self.array:
                    put("\n]}\n")
                out.close()
                files.append((now[0], now[1], name, n, size))

        for row in iterator:
            if (row["model"], row["shard"]) != now:
                close()
                now, name, n, size = (row["model"], row["shard"]), f".{uuid.uuid4().hex}", 0, 0
                out = fs.open_output_stream(f"{top}/{name}")
                if self.array:
                    put('{"requests": [\n')
            put((",\n" if n else "") + row["line"] if self.array else row["line"] + "\n")
            n += 1
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = filesystem(self.folder)
        by: dict[str, list] = {}
        for m in messages:
            for model, shard, name, n, size in m.files if m else []:
                by.setdefault(model, []).append((shard, name, n, size))
        end = "body.json" if self.array else "batch.jsonl"
        for model, files in sorted(by.items()):
            listed, stem = [], f"{folder_name(model)}.{self.style}"
            for shard, name, n, size in sorted(files):
                part = f".part{shard + 1:02d}" if len(files) > 1 else ""
                fs.move(f"{top}/{name}", f"{top}/{stem}{part}.{end}")
                listed.append({"path": f"{stem}{part}.{end}", "requests": n, "bytes": size})
            if model in self.sidecars:
                meta = self.sidecars[model] | {"requests_written": sum(f["requests"] for f in listed), "files": listed, "generated_at": dt.datetime.now(dt.timezone.utc).isoformat()}
                with fs.open_output_stream(f"{top}/{stem}.meta.json") as out:
                    out.write((json.dumps({k: meta[k] for k in SIDECAR}, indent=2) + "\n").encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = filesystem(self.folder)
        for m in messages:
            for _, _, name, _, _ in m.files if m else []:
                fs.delete_file(f"{top}/{name}")


class RequestFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "request_files"

    def schema(self) -> str:
        return "model string, shard int, line string"

    def writer(self, schema, overwrite: bool) -> RequestWriter:
        return RequestWriter(dict(self.options))


def filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "", 1))


def folder_name(model: str) -> str:
    """What banks.safe_name() makes of a model's name."""
    return re.sub(r"\A[._]+|[._]+\Z", "", re.sub(r"[^A-Za-z0-9._-]+", "_", model)) or "model"


#: The fields of a sidecar in their order.
SIDECAR = ["model_id", "model_ref", "backend", "endpoint", "module", "config_hash", "cells_planned", "cells_skipped_already_done", "requests_written", "files", "reasoning_applied", "reasoning_standardized", "max_tokens", "temperature_sent", "temperature_recorded", "generated_at"]


def sends_temperature(style: str) -> Column:
    return F.lit(False) if style == "body" else ~F.col("generation").isin(*NO_TEMPERATURE)


def prepared(specs: DataFrame, style: str) -> DataFrame:
    """specs with what a request of the style sends, and what a record then says: a temperature that is not sent is the
    provider's own."""
    sent = F.when(sends_temperature(style), F.col("temperature"))
    return specs.withColumn("temperature_sent", sent).withColumn("temperature", F.when(sends_temperature(style), F.col("temperature")).otherwise(PROVIDER_TEMPERATURE)).withColumn("reasoning_applied", reasoning_applied(style, F.col("generation")))


def build(cells: DataFrame, specs: DataFrame, style: str, folder: str, store: str | None = None, config_hash: str = "", backend: str | None = None, caps: tuple[int, int] | None = None, array: bool = False) -> None:
    """Request files of all rendered cells that the store has no good record of, a sidecar beside those of each model.
    array: files are one JSON body each instead of lines. A model without a cell left has no file.

    Defined cases: a store that is not there is empty; models without a spec fail the job; names of models that make the
    same file name are an error."""
    spark = cells.sparkSession
    spark.dataSource.register(RequestFiles)
    names = specs.select("model", safe_name(F.col("model")).alias("folder")).collect()  # a row a model
    if len({r["folder"] for r in names}) < len(names):
        raise ValueError("two models have the same file name")
    todo = cells if store is None or not is_there(spark, store) else pending(cells, done_keys(read_records(spark, store, "welfare", strict=False).withColumn("cell_key", record_key()), F.col("cell_key")))
    planned = cells.groupBy("model").agg(F.count("*").alias("cells_planned"))
    left = todo.groupBy("model").agg(F.count("*").alias("left"))
    spec = prepared(specs, style)
    said = planned.join(left, "model", "left").join(spec, "model").select(
        F.col("model").alias("model_id"), F.col("ref").alias("model_ref"), F.lit(backend or style).alias("backend"), F.lit(ENDPOINT if style == "body" else PARAMS_ENDPOINT).alias("endpoint"), F.lit("welfare").alias("module"), F.lit(config_hash).alias("config_hash"),
        "cells_planned", (F.col("cells_planned") - F.coalesce("left", F.lit(0))).alias("cells_skipped_already_done"), "reasoning_applied", F.lit(True).alias("reasoning_standardized"), "max_tokens", "temperature_sent", F.col("temperature").alias("temperature_recorded"),
    )
    sidecars = {r["model_id"]: r.asDict() for r in said.collect()}  # a row a model
    lines = requests(todo, style, specs)
    files = sharded(lines, *(caps or CAPS[style])).repartition("model", "shard").sortWithinPartitions("model", "shard", "cell_key").select("model", "shard", "line")
    files.write.format("request_files").mode("append").option("style", style).option("array", array).option("sidecars", json.dumps(sidecars)).save(folder)


def is_there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


# what comes back


def observed(results: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of decoded() on their cells (without one: matched is false): raw, position, choice, refused, parse_failed and
    notes. An error is a note and will be asked again. A decline by the provider is an observation: a refusal with the
    text that came, done for good. Everything else is parsed as any answer."""
    x = results.join(cells, F.col("custom_id") == F.col("cell_key"), "left").withColumn("matched", F.col("cell_key").isNotNull())
    fine = F.col("error").isNull() & ~F.col("refused")
    x = x.withColumn("x", F.when(fine, letter_answer(F.col("text"), F.col("n_options"))))
    letter = F.get(F.array(*map(F.lit, "ABCDEFGH")), F.col("x.position") - 1)
    notes = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).when(F.col("refused"), DECLINED).otherwise("")
    x = x.withColumn("notes", notes).withColumn("raw", F.col("text")).withColumn("position", F.col("x.position")).withColumn("modal", F.col("position").cast("double"))
    x = x.withColumn("choice", F.coalesce(F.element_at("letter_map", letter), F.lit(""))).withColumn("declined", F.col("refused"))
    return x.withColumn("refused", F.coalesce("x.refusal", "declined")).withColumn("parse_failed", F.coalesce("x.parse_failed", F.lit(True))).drop("x")


def collect(lines: DataFrame, result_id: str, cells: DataFrame, specs: DataFrame, store: str) -> dict:
    """Folds the lines of one results file into complete records of the store and returns the tally (rows, errors,
    refusals, parse_failures, unmatched), gathered in the one pass that writes. cells: rendered; specs: prepared().

    Records go to a folder of the store that the file's id names and replace what was there: a file that is collected
    twice is there once. Results without a cell are counted and not written.
    """
    fine = F.col("matched") & F.col("error").isNull() & ~F.col("declined")
    seen = Observation()
    count = lambda c: F.count_if(c)
    x = observed(decoded(lines), cells).observe(
        seen, count(F.col("matched")).alias("rows"), count(F.col("matched") & F.col("error").isNotNull()).alias("errors"), count(F.col("matched") & F.col("refused")).alias("refusals"),
        count(fine & F.col("parse_failed")).alias("parse_failures"), count(~F.col("matched")).alias("unmatched"),
    )
    full_record(x.where("matched"), specs).write.mode("overwrite").options(**STORE).json(f"{store}/results={folder_name(result_id)}")
    return dict(seen.get)
