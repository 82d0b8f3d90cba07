"""JSON lines with their places: a data source over byte ranges (gzip files whole) that knows where each line stands."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import RECORD
from .batches import filesystem
from .records import defaulted

#: Bytes of a range, and lines of a batch.
RANGE, BATCH = 64 << 20, 4096
#: Tasks for each core, at least, and the most bytes of a task of small ranges.
TASKS, TASK = 4, 64 << 20
#: Counts of ranges that are broadcast up to so many.
BROADCAST_RANGES = 200_000
LINES = "path int, file string, start long, offset long, nth long, value string"
COUNTS = "path int, file string, start long, n long"
#: The fields without which a record has no key.
KEY_FIELDS = "model_id item_id framing reasoning_mode response_format item_context paraphrase_id method trial_idx".split()


@dataclass
class ByteRange:
    path: int
    file: str
    start: int
    end: int


@dataclass
class Run(InputPartition):
    """Neighbouring ranges of one task."""

    ranges: list[ByteRange]


class LineReader(DataSourceReader):
    """A line belongs to the range that holds its first byte, so ranges of a file need not know of each other. A task
    reads a run of ranges, as many as there are bytes for, however small they are."""

    def __init__(self, options: dict) -> None:
        self.paths, self.size = json.loads(options["paths"]), int(options.get("range", RANGE))
        self.tasks, self.counts = int(options.get("tasks", 1)), options.get("counts") == "true"

    def partitions(self) -> list[Run]:
        from pyarrow import fs as arrow

        out = []
        for k, path in enumerate(self.paths):
            fs, top = filesystem(path)
            info = fs.get_file_info(top)
            files = [info] if info.type == arrow.FileType.File else [i for i in fs.get_file_info(arrow.FileSelector(top, recursive=True)) if i.type == arrow.FileType.File and not i.base_name.startswith(("_", "."))]
            for i in sorted(files, key=lambda i: i.path):
                whole = i.path.endswith(".gz")  # offsets are those of its text, whose length is not known
                out += [ByteRange(k, i.path, 0, sys.maxsize)] if whole else [ByteRange(k, i.path, s, min(s + self.size, i.size)) for s in range(0, i.size, self.size)]
        size = lambda r: min(r.end - r.start, TASK)
        most, runs, left = min(TASK, sum(map(size, out)) // self.tasks), [], -1
        for r in out:
            if left < size(r):
                runs.append(Run([]))
                left = most
            runs[-1].ranges.append(r)
            left -= size(r)
        return runs

    def read(self, part: Run | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there is no file
            return
        rows: list[tuple] = []
        schema = COUNTS if self.counts else LINES
        kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])

        for r in part.ranges:
            nth = -1
            for nth, (at, one) in enumerate(self.lines(r)):
                if not self.counts:
                    rows.append((r.path, r.file, r.start, at, nth, one.rstrip(b"\r\n").decode("utf-8", "replace")))
                    if len(rows) == BATCH:
                        yield batch()
                        rows = []
            if self.counts:
                rows.append((r.path, r.file, r.start, nth + 1))
        if rows:
            yield batch()

    def lines(self, part: ByteRange) -> Iterator[tuple[int, bytes]]:
        """The lines of a range and their places."""
        fs, _ = filesystem(part.file)
        with fs.open_input_stream(part.file) if part.file.endswith(".gz") else fs.open_input_file(part.file) as raw:
            # from one byte before: if that ends a line, the next one begins here
            at = max(part.start - 1, 0)
            if at:
                raw.seek(at)
            text = lines_of(raw, min(part.end - at + (1 << 12), 1 << 20))
            if part.start:
                at += len(next(text, b""))
            for one in text:
                if at >= part.end:
                    break
                yield at, one
                at += len(one)


def lines_of(raw, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines with their ends."""
    rest = b""
    while piece := raw.read(size):
        *whole, rest = (rest + piece).split(b"\n")
        for one in whole:
            yield one + b"\n"
    if rest:
        yield rest


class RecordLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_lines"

    def schema(self) -> str:
        return COUNTS if self.options.get("counts") == "true" else LINES

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))


def read_lines(spark: SparkSession, paths: list[str], size: int = RANGE, counts: bool = False) -> DataFrame:
    """path (its place in the list), file, start (of the range), offset (of the line, in bytes), nth (line of the range),
    value of every line of files or folders; counts: path, file, start, n (lines) of every range."""
    spark.dataSource.register(RecordLines)
    options = {"paths": json.dumps(paths), "range": str(size), "tasks": str(TASKS * spark.sparkContext.defaultParallelism), "counts": str(counts).lower()}
    return spark.read.format("record_lines").options(**options).load()


def numbered(lines: DataFrame, ranges: DataFrame | None = None, broadcast: bool = False) -> DataFrame:
    """lines plus line, its number in the file from 1: lines of earlier ranges, which are counted by range, and its own.
    ranges: the counts, if they are known; broadcast: they are few."""
    if ranges is None:
        ranges = lines.groupBy("path", "file", "start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path", "file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranges.select("path", "file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(ranges) if broadcast else ranges, ["path", "file", "start"]).withColumn("line", F.col("before") + F.col("nth") + 1).drop("before")


def scan(spark: SparkSession, paths: list[str], module: str | None = None, strict: bool = True, size: int = RANGE, places: bool = False) -> DataFrame:
    """Records of JSON lines with seq, their order: the path's place in the list, the file's name, the line's offset.
    places: also line, its number in the file, by a pass that counts the lines of ranges; no line is shuffled for it.

    strict: a line that is no JSON object fails the job and is named by its file, its offset and its number in the range
    that begins at a named byte. Else it is left out, as is a line without some field of the key: it was cut off, or is of
    an older schema. Blank lines are no lines; unknown fields are dropped; missing ones take their defaults. No path, or a
    folder without files, gives no records.
    """
    broken = T.StructType([*RECORD.fields, T.StructField("broken", T.StringType())])
    x = read_lines(spark, paths, size)
    if places:
        x = numbered(x, read_lines(spark, paths, size, counts=True), sum(len(r.ranges) for r in LineReader({"paths": json.dumps(paths), "range": size}).partitions()) <= BROADCAST_RANGES)
    x = x.where(F.trim("value") != "")
    x = x.withColumn("r", F.from_json("value", broken, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    bad = F.col("r").isNull() | F.col("r.broken").isNotNull()
    if strict:
        says = F.concat(F.lit("no record: "), "file", F.lit(", line "), F.col("nth") + 1, F.lit(" from byte "), F.col("start"), F.lit(" (at byte "), F.col("offset"), F.lit("): "), F.substring("value", 1, 80))
        x = x.withColumn("r", F.when(bad, F.raise_error(says).cast(broken)).otherwise(F.col("r")))
    else:
        whole = F.forall(F.array(*[F.col(f"r.{k}").isNotNull() for k in KEY_FIELDS]), lambda v: v)
        x = x.where(~bad & whole)
    x = defaulted(x.select(F.struct("path", "file", "offset").alias("seq"), *(["line"] if places else []), *[F.col(f"r.{f.name}").alias(f.name) for f in RECORD.fields]))
    return x.where(F.col("module") == module) if module else x
