"""Vector code compression: product codes whose entries are found through segment-mean lower bounds.

Components become integers, vectors are cut into PARTS parts, and each part has a codebook of ENTRIES entries, fitted in
ROUNDS rounds of exact k-means over all vectors. A round is one pass over the table: tasks assign parts to entries and
emit one partial sum an entry, a shuffle adds these up, and only the entries (PARTS x ENTRIES rows) reach the driver.

An entry is found without most exact distances. Part and entry are compared by the means of 1, 2, 4, ... segments: with
S the difference of two segment sums over w positions, S * S / w bounds the squared distance there from below, and the
difference of the norms of what the means leave (the residual) adds to it, by the triangle inequality. The exact distance
to the entry with the nearest finest means is the limit; from the coarsest level to the finest, entries whose bound is
above it go, and what survives the last level gets exact integer distances. The limit is raised by more than bounds can
lose by rounding, so no nearest entry is lost, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest integer component: sums of squared differences of 32,768 of them stay in 64 bits.
LARGEST = 1 << 22
#: Vectors that are compared with a codebook at once (a bound takes 8 bytes an entry and vector).
BATCH = 256


class Book:
    """The entries of one part with their segment sums and residual norms at each level."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.levels = [(starts, *summary(entries, starts)) for starts in segmentations(entries.shape[1])]


def segmentations(n: int) -> list[np.ndarray]:
    """First positions of 1, 2, 4, ... segments, while a segment has two positions at least."""
    return [np.arange(k) * n // k for k in (1 << j for j in range(max(1, n.bit_length()))) if k == 1 or 2 * k <= n]


def summary(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment sums of each row, and the norm of what the segment means leave of it."""
    sums = np.add.reduceat(x, starts, axis=1)
    width = np.diff([*starts, x.shape[1]])
    left = (x * x).sum(axis=1, dtype=np.float64) - (sums.astype(np.float64) ** 2 / width).sum(axis=1)
    return sums, np.sqrt(np.maximum(left, 0))


def bounds(x: np.ndarray, starts: np.ndarray, their_sums: np.ndarray, their_norm: np.ndarray) -> np.ndarray:
    """Of every row and entry, a lower bound of their squared distance, before rounding."""
    sums, norm = summary(x, starts)
    root = np.sqrt(np.diff([*starts, x.shape[1]]))
    mine, theirs = sums / root, their_sums / root
    gap = (mine * mine).sum(axis=1)[:, None] + (theirs * theirs).sum(axis=1) - 2 * (mine @ theirs.T)
    return gap + (norm[:, None] - their_norm) ** 2


def assign(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, ties to the lower index; integers."""
    at, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for first in range(0, len(x), BATCH):
        part = slice(first, first + BATCH)
        at[part], best[part] = assign_batch(x[part], book)
    return at, best


def assign_batch(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    entries = book.entries
    # of doubles of this size a bound has lost far less than that by rounding, also where a norm is the root of nearly 0
    size = np.maximum((x * x).sum(axis=1, dtype=np.float64), (entries * entries).sum(axis=1, dtype=np.float64).max())
    slack = 1e-6 * size + 1e-3
    # the entry whose finest segment means are nearest is mostly the nearest one: its exact distance is a close limit
    guess = bounds(x, *book.levels[-1]).argmin(axis=1)
    limit = ((x - entries[guess]) ** 2).sum(axis=1) + slack
    open_ = np.arange(len(x))
    alive = np.ones((len(x), len(entries)), bool)
    for level in book.levels:
        alive[open_] &= bounds(x[open_], *level) <= limit[open_, None]
        open_ = open_[alive[open_].sum(axis=1) > 1]
    row, entry = np.nonzero(alive)
    exact = ((x[row] - entries[entry]) ** 2).sum(axis=1)
    # rows are in order and each has a survivor: the one that its limit came from
    best = np.minimum.reduceat(exact, np.flatnonzero(np.diff(row, prepend=-1)))
    hit = np.flatnonzero(exact == best[row])
    return entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]], best


def integers(df: DataFrame, ident: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, x (array of long) of the rows that take part."""
    whole = F.col(vector).cast("array<double>")
    fine = F.forall(whole, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = df.where(F.coalesce(fine, F.lit(False))).select(F.col(ident).alias("vec_id"), F.col(label).alias("label"), F.transform(whole, lambda e: F.floor(e * float(scale))).alias("x"))
    wide = F.exists("x", lambda e: F.abs(e) > LARGEST)
    return x.withColumn("x", F.when(wide, F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).otherwise(F.col("x")))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, length)


def sums(x: DataFrame, books: list[Book], length: int) -> DataFrame:
    """part, entry, n, s0, s1, ...: how many parts each entry has, and their sums by position."""
    wide = length // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), len(books[0].entries), 1 + wide), np.int64)
        for b in batches:
            v = matrix(b.column(0), length)
            for p, book in enumerate(books):
                own = v[:, p * wide : (p + 1) * wide]
                at, _ = assign(own, book)
                order = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                if len(starts):
                    total[p, at[order[starts]], 1:] += np.add.reduceat(own[order], starts, axis=0)
                    total[p, :, 0] += np.bincount(at, minlength=len(book.entries))
        p, e = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "sums"])

    some = x.select("x").mapInArrow(run, "part long, entry long, sums array<long>")
    return some.groupBy("part", "entry").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(1 + wide)])


def fit(x: DataFrame, length: int, parts: int, entries: int, rounds: int) -> list[Book]:
    """The codebooks after all rounds."""
    wide = length // parts
    first = np.array([r["x"] for r in x.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()], np.int64)
    books = [Book(first[:, p * wide : (p + 1) * wide]) for p in range(parts)]
    for _ in range(rounds):
        now = [b.entries.copy() for b in books]
        for r in sums(x, books, length).collect():  # one row an entry
            now[r["part"]][r["entry"]] = [r[f"s{i + 1}"] // r["s0"] for i in range(wide)]
        books = [Book(e) for e in now]
    return books


def compressed(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): vec_id, label, code (array of entry indices), error of every vector that takes part, and the
    entries of each part. entries: up to 256.

    Defined cases: vectors that are null or hold null or non-finite components take no part, nor do those of another
    length than most (of equally frequent lengths, the shorter one); a length that parts does not divide is an error, as
    is a component beyond LARGEST after scaling, of which no distance would fit in 64 bits; with fewer vectors than
    entries a codebook has one entry a vector; rows that share an id are vectors of their own, in order of their
    components where the first entries are taken, and null ids come last there; equal entries tie to the lower index; an
    empty table gives an empty result and empty codebooks; other columns are not read.
    """
    x = integers(df, ident, vector, label, scale)
    length = x.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None or not length["n"]:
        none = x.limit(0).select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
        return none, [np.empty((0, 0), np.int64)] * parts
    length = length["n"]
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    x = x.where(F.size("x") == length)
    books = fit(x, length, parts, entries, rounds)
    wide = length // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(2), length)
            found = [assign(v[:, p * wide : (p + 1) * wide], book) for p, book in enumerate(books)]
            code = np.stack([at for at, _ in found], axis=1).astype(np.int32) if len(v) else np.empty((0, parts), np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(code), pa.list_(pa.int32())), pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return x.select("vec_id", "label", "x").mapInArrow(run, f"{kinds}, code array<int>, error long"), [b.entries for b in books]


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for e in books for c in e.ravel().tolist()).encode()).hexdigest()


def op13_segment_mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined cases: those of compressed(); rows without a label share one sum."""
    rows, books = compressed(table(spark, sf_dir, "embeddings"))
    rows = stored(rows, "codes")
    same = rows.groupBy(F.col("label").alias("__of")).agg(F.sum("error").alias("label_error"))
    got = rows.join(same, F.col("label").eqNullSafe(F.col("__of")))
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return got.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """The query in SQL: distances from inner products, which are exact in doubles here."""
    cte = [
        f"v as (select vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::double)) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)",
        "r as (select *, row_number() over (order by vec_id) as rn, len(e) // 4 as w from v)",
        "p as (select rn, part, list_slice(e, part * w + 1, part * w + w) as x from r, range(4) t(part))",
        f"b0 as (select part, rn - 1 as idx, x as c from p where rn <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        cte.append(f"a{k} as materialized (select rn, p.part, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'i': idx}}) as m from p join b{k} b on p.part = b.part group by all)")
        if k < ROUNDS:
            cte.append(f"u{k} as (select p.part, m.i as idx, pos, floor(sum(x[pos]) / count(*)) as c from p join a{k} a on p.rn = a.rn and p.part = a.part, range(1, 1 + (select any_value(w) from r)) t(pos) group by all)")
            cte.append(f"b{k + 1} as materialized (select b.part, b.idx, coalesce(n.c, b.c) as c from b{k} b left join (select part, idx, list(c order by pos) as c from u{k} group by all) n on b.part = n.part and b.idx = n.idx)")
    return "with " + ",\n".join(cte) + f"""
, z as (select rn, string_agg(printf('%02x', m.i::int), '' order by part) as code, sum(m.d)::bigint as error from a{ROUNDS} group by rn),
s as (select sha256(string_agg(array_to_string(list_transform(c, lambda e: e::bigint), ','), ',' order by part, idx)) as codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from r join z using (rn), s
"""
