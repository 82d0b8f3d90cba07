"""Token output in training order.

Documents are tokenised and cut into sequences of at most LENGTH tokens, the last one of each ended by a separator.
In order of doc_id the sequences have dense indices; a keyed Feistel permutation on the next even power of two,
cycle-walked into range, gives each its slot. A record has a fixed stride, so slot s is record s mod RECORDS of
shard s div RECORDS, at a known byte. Slots are dense, so a record's partition is arithmetic too: partitions are
ranges of whole shards, without sampling. write_shards() writes each shard as one file of its records, and read_from()
resumes at any slot without reading what comes before.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, stored, table

LENGTH = 2048
RECORDS = 1024
KEY = 0x5EED
ROUNDS = 6
#: GPT-2 style pre-tokens; the vocabulary file's own pattern.
VOCABULARY = "byte_bpe_50k.tiktoken"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def half_bits(n: int) -> int:
    return max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)


def feistel(x: np.ndarray, half: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The permutation of [0, 4**half)."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mixed(left ^ k) & mask), left
        else:
            left, right = right, left ^ (mixed(right ^ k) & mask)
    return (left << np.uint64(half)) | right


def slots(index: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The permutation of [0, n): walk the cycle until it is in range. Under four steps each on average."""
    half = half_bits(n)
    x = feistel(index.astype(np.uint64), half, key, back)
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = feistel(x[out], half, key, back)
    return x.astype(np.int64)


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The vocabulary file's bytes and its split pattern; read on the driver and sent along (about 1 MB). Only what
    is not given is taken from the installed public vocabularies."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return f.read(), pattern


@lru_cache(maxsize=2)
def encoder(raw: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenised(df: DataFrame, ident: str, text: str, length: int, vocab: tuple[bytes, str]) -> DataFrame:
    """doc_id, ids (packed, compressed), parts (sequences) and before (those earlier in the partition), in order of
    doc_id over range partitions."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(vocab)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, z = encoder(*sent.value), zstandard.ZstdCompressor(level=3)
        end, count = enc.n_vocab, 0
        for b in batches:
            ids, parts, before = [], [], []
            for t in b.column(1).to_pylist():
                got = np.array([*enc.encode_ordinary((t or b"").decode("utf-8", "replace")), end], "<u2")
                ids.append(z.compress(got.tobytes()))
                parts.append(-(-len(got) // length))
                before.append(count)
                count += parts[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(parts, pa.int64()), pa.array(before, pa.int64())], ["doc_id", "ids", "parts", "before"])

    # the bounds of the ranges are sampled by running the input twice, so nothing is done to it before
    slim = df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    placed = slim.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.coalesce("text", F.lit(b"")))
    return placed.mapInArrow(encode, "doc_id long, ids binary, parts long, before long")


ROW = "slot long, shard long, offset long, doc_id long, part int, n_tokens int, record binary"


def training_order(df: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH, records: int = RECORDS, key: int = KEY, vocab: tuple[bytes, str] | None = None) -> DataFrame:
    """One row a sequence, range-partitioned and sorted by slot: slot, shard, offset (byte in the shard), doc_id,
    part, n_tokens, record (4 bytes of count, then length x 2 bytes of ids, zero-padded).

    Defined cases: null and empty texts are one sequence of just the separator; long texts take as many sequences
    as they need; rows with one doc_id are ordered by text, equal rows are sequences of their own; null ids come
    first; an empty table gives an empty result; other columns are not read. The same rows and key give the same
    slots, however the input is partitioned.
    """
    spark = df.sparkSession
    vocab = vocab or vocabulary()
    n = partitions(spark)
    tok = stored(tokenised(df, ident, text, length, vocab).withColumn("at", F.monotonically_increasing_id()), "tokens")
    block = F.shiftright("at", 33).alias("block")
    sums = {r["block"]: r["n"] for r in tok.groupBy(block).agg(F.sum("parts").alias("n")).collect()}  # one a partition
    bases, total = {}, 0
    for b in sorted(sums):
        bases[b], total = total, total + sums[b]
    stride = 4 + 2 * length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            doc, part, count, index, body = [], [], [], [], []
            for d, ids, before, home in zip(*(b.column(i).to_pylist() for i in range(4))):
                got, first = plain.decompress(ids), bases[home] + before
                for k, at in enumerate(range(0, len(got), 2 * length)):
                    piece = got[at : at + 2 * length]
                    doc.append(d)
                    part.append(k)
                    count.append(len(piece) // 2)
                    index.append(first + k)
                    body.append(z.compress(piece))
            to = slots(np.array(index, np.int64), total, key) if index else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(count, pa.int32()), pa.array(body, pa.binary())], ["slot", "doc_id", "part", "n_tokens", "body"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                slot = c.column(0).to_numpy()
                rec = [(len(x := plain.decompress(p)) // 2).to_bytes(4, "little") + x.ljust(2 * length, b"\0") for p in c.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(slot // records), pa.array(slot % records * stride), c.column(1), c.column(2), c.column(3), pa.array(rec, pa.binary())], [x.split()[0] for x in ROW.split(", ")])

    placed = tok.select("doc_id", "ids", "before", block).mapInArrow(place, "slot long, doc_id long, part int, n_tokens int, body binary")
    # whole shards to a partition, in order of slots
    each = max(1, -(-total // (n * records))) * records
    home = F.floor(F.col("slot") / F.lit(each)).cast("int")
    return placed.repartitionById(max(1, -(-total // each)), home).sortWithinPartitions("slot").mapInArrow(finish, ROW)


def shards(rows: DataFrame) -> DataFrame:
    """shard, n_records, payload of training_order()'s rows: the records of each shard in order, `records` x stride
    bytes (the last: fewer). No shuffle: a partition of those rows holds whole shards, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["shard", "n_records", "payload"])

        for b in batches:
            for shard, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if shard != now and held:
                    yield one()
                    held = []
                now = shard
                held.append(record)
        if held:
            yield one()

    return rows.select("shard", "record").mapInArrow(run, "shard long, n_records int, payload binary")


def shard_name(shard: int) -> str:
    return f"shard-{shard:010d}.bin"


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each shard as a file of that folder (a URI or path that all machines see) and returns shard, n_records,
    bytes once all are written. A file is written under another name and moved into place, so a task that is lost and
    runs again puts the same bytes there, and a reader never sees half of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = files(folder)
        for b in batches:
            for shard, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                part = f"{at}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(payload)
                fs.move(part, f"{at}/{shard_name(shard)}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(p) for p in b.column(2).to_pylist()], pa.int64())], ["shard", "n_records", "bytes"])

    fs, at = files(folder)
    fs.create_dir(at, recursive=True)
    return stored(shards(rows).mapInArrow(run, "shard long, n_records int, bytes long"), "shards")


def files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "", 1))


def read_from(folder: str, slot: int = 0, length: int = LENGTH, records: int = RECORDS) -> Iterator[np.ndarray]:
    """Token ids of the records from a slot on, in training order: one seek, then sequential reads."""
    fs, at = files(folder)
    stride, shard, place = 4 + 2 * length, slot // records, slot % records
    while fs.get_file_info(f"{at}/{shard_name(shard)}").is_file:
        with fs.open_input_file(f"{at}/{shard_name(shard)}") as f:
            f.seek(place * stride)
            while len(record := f.read(stride)) == stride:
                yield tokens_of(record)
        shard, place = shard + 1, 0


def tokens_of(record: bytes) -> np.ndarray:
    return np.frombuffer(record, "<u2", int.from_bytes(record[:4], "little"), 4)


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the records in training order."""
    return training_order(docs)
