"""Exact removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

The task: remove each byte covered by a 100-byte string that also starts earlier in the corpus. No machine can
hold the transform of a corpus, so the strings that may be equal are brought together first:

1. Every 100-byte window is keyed by the least hash of its 32-byte substrings. Equal windows have equal keys, and
   neighbouring windows mostly share one, so a run of windows is one row (about one in 35 bytes): its key, a hash
   of its bytes, its place.
2. Runs meet by key. A run whose bytes an earlier run holds too is wholly repeated; that is decided here, by the
   57 bits of the key and a 64-bit hash of the run's bytes together, and most repeated runs take this way. Of keys
   with different runs the first of each kind go on, with their bytes, and so do runs of a short period, which may
   repeat a window themselves; other keys that occur once end here.
3. Those runs are packed into blocks of whole keys. In each block the transform is built and intervals are extended
   backwards breadth first, which sets common prefix lengths by increasing value; it stops at 100. What is still
   unset there separates suffixes that share 100 bytes, so stretches of unset places are classes of equal windows.
   All but the first of a class are repeated.
4. Repeated windows become spans of their document, and each document is cut in one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored, table

LENGTH = 100
GRAM = 32
BLOCK = 1 << 20
SLICE = 8 << 20

#: start: the place in the text, below the number of the text among those of its id.
RUNS = "key long, same long, doc_id long, start long, windows int, twin boolean"
LOW = (1 << 32) - 1
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
with np.errstate(over="ignore"):
    BYTE = (np.arange(1, 257, dtype=np.uint64) * MIX[0]) ^ ((np.arange(1, 257, dtype=np.uint64) * MIX[1]) >> np.uint64(29))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[: len(h) - have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def minima(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start, the least substring hash with the place of it in the low 7 bits, and whether that hash
    is there twice (the first and the last place differ). gram: a power of two, length - gram under 128."""
    h, step = BYTE[data], 1
    while step < gram:
        h = h[: len(h) - step] * MIX[step.bit_length() % 5] + h[step:]
        step *= 2
    h ^= h >> np.uint64(31)
    h *= MIX[2]
    h ^= h >> np.uint64(29)
    h &= ~np.uint64(127)
    h |= (np.arange(len(h), dtype=np.uint64)) & np.uint64(127)
    first = sliding_min(h, length - gram + 1)
    last = sliding_min(h ^ np.uint64(127), length - gram + 1)
    return first, (first ^ last) & np.uint64(127) != 127


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, start, number of windows and `twin` of each run of a text, which is taken in slices of bounded size. Only
    a twin, a run with a window that holds its key's substring twice, can hold one window twice."""
    keys, starts, twins = [], [], []
    total = len(text) - length + 1
    for at in range(0, max(total, 0), SLICE):
        low, twice = minima(np.frombuffer(text, np.uint8, count=min(SLICE, total - at) + length - 1, offset=at), length, gram)
        first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
        keys.append((low[first] >> np.uint64(7)).astype(np.int64))
        starts.append(first + at)
        twins.append(np.logical_or.reduceat(twice, first))
    if not keys:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(bool)
    key, start = np.concatenate(keys), np.concatenate(starts)
    return key, start, np.diff(np.append(start, total)), np.concatenate(twins)


def all_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc, sub, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not text:
                    continue
                key, start, n, twin = runs(text, length, gram)
                same = [xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(start.tolist(), (start + n + length - 1).tolist())]
                parts = (key, np.array(same, np.uint64).view(np.int64), None, start.astype(np.int64) + (sub << 32), n.astype(np.int32), twin)
                for to, x in zip(out, parts):
                    to.append(x if x is not None else pa.repeat(pa.scalar(doc, pa.int64()), len(key)))
                held += len(key)
                if held > 200_000:
                    yield batch(out)
                    out, held = [[], [], [], [], [], []], 0
            if held:
                yield batch(out)

    def batch(out: list[list]) -> pa.RecordBatch:
        cols = [pa.concat_arrays(x) if isinstance(x[0], pa.Array) else pa.array(np.concatenate(x)) for x in out]
        return pa.RecordBatch.from_arrays(cols, ["key", "same", "doc_id", "start", "windows", "twin"])

    return docs.mapInArrow(run, RUNS)


def suffix_array(t: np.ndarray, length: int) -> np.ndarray:
    """Places of t in order of their first `length` or more symbols, by prefix doubling; t ends in 0."""
    n = len(t)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = t
    code = np.zeros(n, np.uint64)
    for k in range(7):  # nine bits hold a symbol
        code = (code << np.uint64(9)) | wide[k : k + n]
    have = 7
    while True:
        order = np.argsort(code, kind="stable")
        sorted_code = code[order]
        if have >= length:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], sorted_code[1:] != sorted_code[:-1])), dtype=np.uint64) + np.uint64(1)
        code = rank << np.uint64(32)
        code[: n - have] |= rank[have:] if n > have else np.uint64(0)
        have *= 2


def unset_after(bwt: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix order but the first, whether its common prefix with the one before is unset
    after all values under `length` are set, by backward extension of intervals in order of that value."""
    n = len(bwt)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    symbols, first = np.unique(bwt[by], return_index=True)
    rows = {int(c): by[s:e] for c, s, e in zip(symbols, first, [*first[1:], n])}
    base = {int(c): int(s) for c, s in zip(symbols, first)}
    low, high = np.array([0]), np.array([n])  # half open
    for value in range(length):
        got_low, got_high = [], []
        size = high - low
        one = low[size == 1]
        one = one[bwt[one] > 0]
        got_low.append(lf[one])
        got_high.append(lf[one] + 1)
        some = (size > 1) & (size <= 32)
        if some.any():
            a, m = low[some], size[some]
            owner = np.repeat(np.arange(len(a)), m)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m) + a[owner]
            fine = bwt[place] > 0
            owner, place = owner[fine], place[fine]
            key = owner * 512 + bwt[place]
            at = np.lexsort((lf[place], key))
            key, to = key[at], lf[place][at]
            if len(key):
                head = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
                got_low.append(to[head])
                got_high.append(to[np.append(head[1:], len(to)) - 1] + 1)
        many = size > 32
        if many.any():
            a, z = low[many], high[many]
            for c, where in rows.items():
                if c or value == 0:
                    i, j = np.searchsorted(where, a), np.searchsorted(where, z)
                    fine = i < j
                    got_low.append(base[c] + i[fine])
                    got_high.append(base[c] + j[fine])
        low, high = np.concatenate(got_low), np.concatenate(got_high)
        if value == 0 and n == 1:
            break
        new = ~known[high]
        low, high = low[new], high[new]
        if len(high):
            high, pick = np.unique(high, return_index=True)
            low = low[pick]
            known[high] = True
        else:
            break
    return ~known[:n]


def repeats(strings: list[bytes], places: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """(string, start, stop): windows of the strings that are equal to a window with an earlier place. places: an
    ordered pair (document, start) for each string, increasing within it."""
    symbols = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + np.uint16(1), np.uint16(0)) for s in strings])
    sizes = np.array([len(s) + 1 for s in strings])
    order = suffix_array(symbols, length)
    bwt = symbols[order - 1].astype(np.int64)
    unset = unset_after(bwt, length)
    owner = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = offset + length < sizes[owner]  # the window ends before the separator
    group = np.cumsum(~unset)
    keep = whole[order]
    order, group = order[keep], group[keep]
    # equal or interleaved windows compare by (document, start + offset)
    docs = {d: i for i, d in enumerate(sorted({p[0] for p in places}, key=lambda d: (d is not None, d)))}
    by_doc = np.array([docs[p[0]] for p in places])
    by_start = np.array([p[1] for p in places])
    start = by_start[owner[order]] + offset[order]
    at = np.lexsort((start, by_doc[owner[order]], group))
    order, group, doc, start = order[at], group[at], by_doc[owner[order]][at], start[at]
    if not len(order):
        return []
    head = np.concatenate(([True], group[1:] != group[:-1]))
    lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    later = (doc != doc[lead]) | (start != start[lead])
    hit = np.sort(order[later])
    if not len(hit):
        return []
    cutting = np.concatenate(([0], np.flatnonzero((np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])) + 1))
    ends = np.append(cutting[1:], len(hit)) - 1
    return [(int(owner[hit[i]]), int(offset[hit[i]]), int(offset[hit[j]]) + length) for i, j in zip(cutting, ends)]


def placed(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc_id, sub, text, own): own is the row's id. Rows are documents by id and text: doc_id orders them, and sub
    numbers the different texts of one id by their hash. Rows without an id come first, in order of their text's hash,
    each text a document of its own, so they are no group. Only ids with several texts, if there are any, are joined."""
    hashed = F.xxhash64(F.coalesce("text", F.lit(b"")))
    docs = df.select(F.col(ident).cast("long").alias("own"), F.col(text).cast("binary").alias("text"))
    first = F.lit(-(2**63)).cast("long") + hashed.bitwiseAND(F.lit((1 << 61) - 1))
    docs = docs.select(F.coalesce("own", first).alias("doc_id"), "text", "own")
    seen = docs.select("doc_id", hashed.alias("h"))
    several = seen.groupBy("doc_id").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("doc_id")
    several = stored(several, "several")
    if several.isEmpty():
        return docs.select("doc_id", F.lit(0).alias("sub"), "text", "own")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1
    subs = stored(seen.join(several, "doc_id", "left_semi").distinct().withColumn("n", number).select(F.col("doc_id").alias("__of"), "h", "n"), "several")
    both = docs.join(subs, (F.col("doc_id") == F.col("__of")) & (hashed == F.col("h")), "left")
    return both.select("doc_id", F.coalesce("n", F.lit(0)).alias("sub"), "text", "own")


def packed(docs: DataFrame) -> DataFrame:
    """placed() with the text compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press.compress(t or b"") for t in b.column(2).to_pylist()], pa.binary()), b.column(3)], ["doc_id", "sub", "text", "own"])

    return docs.mapInArrow(run, "doc_id long, sub int, text binary, own long")


def merged(spans: list[int], n: int) -> list[tuple[int, int]]:
    """Spans packed as start << 32 | stop -> maximal runs."""
    out: list[list[int]] = []
    for s in sorted(spans):
        a, z = s >> 32, min(s & 0xFFFFFFFF, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def remove_repeats(df: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """One row a row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with keep_text also kept (binary).

    Defined cases: null and empty texts have no bytes; texts shorter than the length lose nothing; equal rows are one
    document and each gets its result; different texts under one id are documents of their own, one after another in
    order of a hash of the text; rows without an id are too, before all ids (which have to be over -2**62); an empty
    table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    n = partitions(spark)
    docs = placed(df, ident, text)
    place = Window.partitionBy("key", "same").orderBy("doc_id", "start")
    of_key = Window.partitionBy("key")
    # dealt by key once: finer windows sort within it
    found = all_runs(docs, length, gram).repartition(n, "key").withColumn("r", F.rank().over(place))
    found = found.withColumn("lo", F.min(F.struct("doc_id", "start")).over(of_key)).withColumn("hi", F.max(F.struct("doc_id", "start")).over(of_key))
    found = found.withColumn("mixed", F.min("same").over(of_key) != F.max("same").over(of_key))
    found = found.where("r > 1 or twin or (lo <> hi and mixed)")
    found = stored(found.select("doc_id", "start", "windows", F.when(F.col("r") == 1, F.col("key")).alias("key")), "runs")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for b in batches:
            for doc, text, todo in zip(*(b.column(i).to_pylist() for i in range(3))):
                whole = plain.decompress(text)
                rows = [(x["key"], x["start"], whole[x["start"] & LOW : (x["start"] & LOW) + x["windows"] + length - 1]) for x in {(y["key"], y["start"]): y for y in todo}.values()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([doc] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["key", "doc_id", "start", "bytes"])

    sub = F.shiftright("start", 32).cast("int")
    wanted = found.where("key is not null").groupBy(F.col("doc_id").alias("__of"), sub.alias("__sub")).agg(F.collect_list(F.struct("key", "start", "windows")).alias("todo"))
    mine = (F.col("doc_id") == F.col("__of")) & (F.col("sub") == F.col("__sub"))
    pieces = packed(docs).join(wanted, mine).select("doc_id", "text", "todo").mapInArrow(slices, "key long, doc_id long, start long, bytes binary")
    pieces = pieces.repartition(n, "key").sortWithinPartitions("key", "doc_id", "start")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None

        def solve() -> pa.RecordBatch:
            got = repeats([r[2] for r in rows], [(r[0], r[1]) for r in rows], length)
            doc, sub = [rows[i][0] for i, _, _ in got], [rows[i][1] >> 32 for i, _, _ in got]
            span = [(((rows[i][1] & LOW) + a) << 32) | ((rows[i][1] & LOW) + z) for i, a, z in got]
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(sub, pa.int32()), pa.array(span, pa.int64())], ["doc_id", "sub", "span"])

        for b in batches:
            for key, doc, start, piece in zip(*(b.column(i).to_pylist() for i in range(4))):
                if key != last and size >= BLOCK:
                    yield solve()
                    rows, size = [], 0
                if key == last and rows and rows[-1][:2] == (doc, start):
                    continue
                last = key
                rows.append((doc, start, piece))
                size += len(piece)
        if rows:
            yield solve()

    at = F.col("start").bitwiseAND(F.lit(LOW))
    spans = found.where("key is null").select("doc_id", sub.alias("sub"), (F.shiftleft(at, 32) + at + F.col("windows") + (length - 1)).alias("span"))
    spans = spans.unionAll(pieces.mapInArrow(expand, "doc_id long, sub int, span long"))
    spans = spans.groupBy(F.col("doc_id").alias("__of"), F.col("sub").alias("__sub")).agg(F.collect_set("span").alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                whole = plain.decompress(text) if text else b""
                cuts = merged(spans or [], len(whole))
                kept = b"".join(whole[a:z] for a, z in zip([0, *(z for _, z in cuts)], [*(a for a, _ in cuts), len(whole)])) if cuts else whole
                out.append((doc, len(whole), len(whole) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds[: 5 + keep_text]], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    names = [x.split()[0] for x in schema.split(", ")]
    return packed(docs).join(spans, mine, "left").select("own", "text", "spans").mapInArrow(finish, schema)


def op5_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
