"""Approximate nearest neighbours by inner product over an inverted multi-index.

A vector is cut in two halves, each with its own codebook of CODES centroids; the pair of nearest centroids is its
cell. A query walks centroid pairs by summed inner product, largest first, with a heap over the two sorted halves,
until the cells reached hold its candidates, and those are reranked exactly in double precision.

Codebooks, and the share of all vectors that a query takes as candidates, are fitted on a bounded sample
(SAMPLE vectors by hash of the id): the share is the least one at which the sample's own queries reach GOAL recall
against brute force. Every vector is indexed. Large cells are split into blocks, vectors and queries alike.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

CODES = 16
SAMPLE = 6000
PROBES = 300
GOAL = 0.96
K = 20
BLOCK = 4096


@dataclass
class Index:
    half: int
    books: tuple[np.ndarray, np.ndarray]
    share: float


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (2 * (x @ book.T) - (book * book).sum(axis=1)).argmax(axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    book = np.unique(x, axis=0)
    if len(book) > k:
        book = book[np.random.default_rng(7).choice(len(book), k, replace=False)].copy()
        for _ in range(rounds):
            at = nearest(x, book)
            for j in range(k):
                if len(own := x[at == j]):
                    book[j] = own.mean(axis=0)
    return book


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells (i * len(b) + j) by falling a[i] + b[j], until they hold `want` vectors."""
    p, q = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b = a[p], b[q]
    heap, out, have = [(-(a[0] + b[0]), 0, 0)], [], 0
    while heap and have < want:
        _, i, j = heapq.heappop(heap)
        cell = int(p[i]) * len(b) + int(q[j])
        if counts[cell]:
            out.append(cell)
            have += int(counts[cell])
        if i + 1 < len(a) and (j == 0):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
    return out


def fit(sample: np.ndarray, codes: int = CODES, goal: float = GOAL, k: int = K) -> Index:
    half = sample.shape[1] // 2
    books = (kmeans(sample[:, :half], codes), kmeans(sample[:, half:], codes))
    cell = nearest(sample[:, :half], books[0]) * len(books[1]) + nearest(sample[:, half:], books[1])
    counts = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    need = []
    for i in range(min(PROBES, len(sample))):
        s = sample @ sample[i]
        s[i] = -np.inf
        true = np.argsort(-s)[: min(k, len(sample) - 1)]
        reached = walk(books[0] @ sample[i, :half], books[1] @ sample[i, half:], counts, len(sample))
        have = dict(zip(reached, np.cumsum(counts[reached])))
        need += [have[c] / len(sample) for c in cell[true]]
    return Index(half, books, float(np.quantile(need, goal)) if need else 1.0)


def usable(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """(row, vec_id, v double array): vectors that take part, a table in which row tells them apart, also those that
    share an id. Of several lengths the most frequent one takes part."""
    x = df.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    x = stored(x.where(F.coalesce(fine, F.lit(False))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return x.where(F.size("v") == (sizes["n"] if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays([flat])
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", each: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score, query_row: for every row whose id is divisible by `each` the k best found, ties
    to the smaller id.

    Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    with a null id or of another length than most; rows that share an id are vectors of their own, each a candidate
    and, if the id says so, a query of its own list (query_row tells the lists apart); fewer than k candidates are all
    returned; an empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    x = usable(df, ident, vector)
    rows = x.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).collect()
    schema = "query_id long, rank int, vec_id long, score double, query_row long"
    if not rows:
        return spark.createDataFrame([], schema)
    index = fit(np.array([r["v"] for r in rows], np.float64), k=k)
    half, books = index.half, index.books

    def place(batches):
        for b in batches:
            v = matrix(b.column(2))
            cell = nearest(v[:, :half], books[0]) * len(books[1]) + nearest(v[:, half:], books[1]) if len(v) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["row", "vec_id", "v", "cell"])

    x = stored(x.select("row", "vec_id", "v").mapInArrow(place, "row long, vec_id long, v array<double>, cell int"), "cells")
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in x.groupBy("cell").count().collect():  # one row a cell
        counts[r["cell"]] = r["count"]
    want = max(int(np.ceil(index.share * counts.sum())), 4 * k)

    def probe(batches):
        for b in batches:
            v = matrix(b.column(2))
            cells = [walk(books[0] @ q[:half], books[1] @ q[half:], counts, want) for q in v]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], ["query_row", "query_id", "q", "cells"])

    asked = x.where(F.col("vec_id") % each == 0).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = stored(asked.mapInArrow(probe, "query_row long, query_id long, q array<double>, cells array<int>"), "probes")
    askers = np.zeros_like(counts)
    for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():  # one row a cell
        askers[r["cell"]] = r["count"]
    blocks = lambda n: F.element_at(F.array(*[F.lit(int(-(-c // BLOCK)) or 1) for c in n]), F.col("cell") + 1)
    some = lambda n, key: F.pmod(F.xxhash64(key), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    left = asked.select("query_row", "query_id", "q", F.explode("cells").alias("cell")).withColumn("qb", some(askers, "query_row")).withColumn("vb", every(counts))
    right = x.withColumn("vb", some(counts, "row")).withColumn("qb", every(askers))

    def rerank(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = ([], [], [], [])
        if queries.num_rows and vectors.num_rows:
            qs, vs = matrix(queries["q"]), matrix(vectors["v"])
            ids, rows = vectors["vec_id"].to_numpy(), vectors["row"].to_numpy()
            for q, query, own in zip(qs, queries["query_id"].to_numpy(), queries["query_row"].to_numpy()):
                score = (vs * q).sum(axis=1)  # in the order of the components, so that equal vectors tie
                at = np.flatnonzero(rows != own)
                if len(at) > k:
                    at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((ids[at], -score[at]))][:k]
                for to, part in zip(found, (np.full(len(at), own), np.full(len(at), query), ids[at], score[at])):
                    to.append(part)
        cols = [np.concatenate(f) if f else np.empty(0, t) for f, t in zip(found, (np.int64, np.int64, np.int64, np.float64))]
        return pa.table(cols, names=["query_row", "query_id", "vec_id", "score"])

    keys = ("cell", "qb", "vb")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
