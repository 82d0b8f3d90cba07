"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of byte classes, word shape and length of itself
and of both neighbours; adjacent labels are tied by a transition weight. A document's score is the mean of its
lines' forward-backward marginals of "good", weighted by their length in bytes.

The field is fitted here, on the driver, on a bounded sample of labelled documents (TRAIN_DOCS), by gradient ascent
on the likelihood. Only documents are labelled, so the lines of a bad one start as bad and after a first fit those
that look good are set free to be good (TURN).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import own_names, table

#: Most labelled documents that the fit reads, by hash of their id; whole texts.
TRAIN_DOCS = 2000
#: Lines of a training document are fitted in chains of at most this many; scoring takes whole documents.
CHAIN = 64
KEEP = 0.7
TURN = 0.9

CLASSES = np.zeros(256, np.uint8)
CLASSES[ord("a") : ord("z") + 1] = 1
CLASSES[ord("A") : ord("Z") + 1] = 2
CLASSES[ord("0") : ord("9") + 1] = 3
CLASSES[[9, 11, 12, 13, 32]] = 4
CLASSES[[ord(c) for c in "*%&$#@^~_=+\\"]] = 5
CLASSES[ord("!")] = 6
CLASSES[ord("|")] = 7
CLASSES[[ord(c) for c in ".,;:'\"?()-"]] = 8
CLASSES[128:] = 9
CLASSES[[ord(c) for c in "<>{}[]/"]] = 10
OWN = 15
SIGN = np.random.default_rng(11).integers(1, 1 << 40, 256)
SIGN[[9, 10, 11, 12, 13, 32]] = 0


@dataclass
class Field:
    weights: np.ndarray  # features
    tie: float


def repeated(data: np.ndarray, blank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each line, the number of words that equal the word before (by a sum of random values of their bytes)."""
    head = ~blank
    head[1:] &= blank[:-1]
    word = np.flatnonzero(head)
    if not len(word):
        return np.zeros(len(starts))
    total = np.add.reduceat(SIGN[data], word)
    again = np.append(False, total[1:] == total[:-1])
    at = np.searchsorted(word, starts)
    again[at[at < len(word)]] = False
    sums = np.concatenate(([0], np.cumsum(again)))
    return sums[np.append(at[1:], len(word))] - sums[at]


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by line, length by line, number of lines by text. A text without bytes is one empty line."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    lines = np.diff(np.concatenate(([0], np.searchsorted(ends, text_ends) + 1)))
    kind = CLASSES[data]
    size = (ends - starts).astype(np.float64)
    n = np.maximum(size, 1)
    counts = {k: np.add.reduceat(kind == k, starts, dtype=np.int32) for k in range(1, 11)}
    words = counts[4] + 1.0
    letters = np.maximum(counts[1] + counts[2], 1)
    own = np.empty((len(starts), OWN))
    own[:, 0] = np.log1p(size) / 8
    own[:, 1] = counts[2] / letters
    own[:, 2] = counts[2] > 0.5 * letters
    own[:, 3] = 10 * counts[3] / n
    own[:, 4] = np.minimum(counts[5] / words, 3)
    own[:, 5] = counts[5] > 0.5 * words
    own[:, 6] = np.minimum(counts[6] / words, 3)
    own[:, 7] = counts[6] > 0.5 * words
    own[:, 8] = np.minimum(counts[7] / words, 2)
    own[:, 9] = counts[7] > 0.25 * words
    own[:, 10] = np.minimum(counts[8] / words, 2)
    own[:, 11] = np.minimum(n / words, 30) / 10
    own[:, 12] = counts[10] / n * 10
    own[:, 13] = words <= 3
    own[:, 14] = 3 * repeated(data, kind == 4, starts) / words
    first = np.zeros(len(starts), bool)
    first[np.concatenate(([0], np.cumsum(lines)[:-1]))] = True
    last = np.zeros(len(starts), bool)
    last[np.cumsum(lines) - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(starts), 1))]), np.maximum(size, 1), lines


def marginals(energy: np.ndarray, lines: np.ndarray, tie: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, P(same label) of each line and the one before it, log partition of each chain.

    Energies: +e/2 for good, -e/2 for bad; +tie for a pair of equal labels. All chains advance together.
    """
    base = np.concatenate(([0], np.cumsum(lines)[:-1]))
    order = np.argsort(-lines, kind="stable")
    base, count = base[order], lines[order]
    live = [int(np.searchsorted(-count, -t)) for t in range(int(count[0]) if len(count) else 0)]  # chains longer than t
    score = np.stack([energy / 2, -energy / 2], axis=1)
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    link = np.array([[tie, 0.0], [0.0, tie]])
    for t, k in enumerate(live):
        at = base[:k] + t
        forward[at] = score[at] if not t else score[at] + np.logaddexp(forward[at - 1, :1] + link[0], forward[at - 1, 1:] + link[1])
    for t in range(len(live) - 2, -1, -1):
        at = base[: live[t + 1]] + t
        ahead = score[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(link[:, 0] + ahead[:, :1], link[:, 1] + ahead[:, 1:])
    end = base + count - 1
    log_z = np.empty(len(lines))
    log_z[order] = np.logaddexp(forward[end, 0], forward[end, 1])
    z = np.repeat(log_z, lines)
    good = np.exp(np.minimum(forward[:, 0] + backward[:, 0] - z, 0))
    same = np.zeros(len(energy))
    inner = np.ones(len(energy), bool)
    inner[np.concatenate(([0], np.cumsum(lines)[:-1]))] = False
    i = np.flatnonzero(inner)
    for y in (0, 1):
        same[i] += np.exp(np.minimum(forward[i - 1, y] + tie + score[i, y] + backward[i, y] - z[i], 0))
    return good, same, log_z


def fit(texts: list[bytes], labels: list[int], rounds: int = 100) -> Field:
    """Without documents of both labels the field is flat: every score is 0.5."""
    if len(set(labels)) < 2:
        return Field(np.zeros(3 * OWN + 3), 0.0)
    x, size, lines = line_features(texts)
    y = np.repeat(np.array(labels, float), lines)
    bad = y == 0
    chains = np.concatenate([np.diff(np.append(np.arange(0, n, CHAIN), n)) for n in lines])
    first = np.zeros(len(x), bool)
    first[np.concatenate(([0], np.cumsum(chains)[:-1]))] = True
    # each document counts alike, each line by its length
    share = size / np.repeat(np.add.reduceat(size, np.concatenate(([0], np.cumsum(lines)[:-1]))), lines)
    share = np.maximum(share, 0.02)
    w, tie = np.zeros(x.shape[1]), 0.0
    for turn in range(2):
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        truly = np.where(first, 0.0, (y == np.roll(y, 1)).astype(float))
        for r in range(1, rounds + 1):
            good, same, _ = marginals(x @ w, chains, tie)
            grad = np.append(x.T @ ((y - good) * share), np.sum((truly - same) * ~first * share)) / len(lines) - 1e-4 * np.append(w, tie)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            step = 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-9)
            w, tie = w + step[:-1], float(np.clip(tie + step[-1], 0, 4))
        if not turn:
            good, _, _ = marginals(x @ w, chains, tie)
            y = np.where(bad & (good > TURN), 1.0, y)
    return Field(w, tie)


def scores(texts: list[bytes], field: Field) -> np.ndarray:
    if not texts:
        return np.empty(0)
    x, size, lines = line_features(texts)
    good, _, _ = marginals(x @ field.weights, lines, field.tie)
    at = np.concatenate(([0], np.cumsum(lines)[:-1]))
    return np.clip(np.add.reduceat(good * size, at) / np.add.reduceat(size, at), 0, 1)


def scored(df: DataFrame, field: Field, text: str = "text", out: str = "score") -> DataFrame:
    """df with a score in [0, 1] for every row; a column of that name is replaced."""
    kept = [c for c in df.columns if c != out]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            got, held, size = [], [], 0
            for t in raw:  # a few MB of text at a time
                held.append(t)
                size += len(t)
                if size > 2_000_000:
                    got.append(scores(held, field))
                    held, size = [], 0
            got.append(scores(held, field))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(got))], schema=pa.schema([*b.schema, pa.field(out, pa.float64())]))

    slim = df.select(*kept)
    return slim.mapInArrow(run, StructType([*slim.schema.fields, StructField(out, DoubleType())]))


def held_out(ident):
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Field:
    """labels: doc_id, quality. Documents of the held-out remainder never take part."""
    chosen = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["text"] or b""), r["quality"]))
    return fit([bytes(r["text"] or b"") for r in rows], [r["quality"] for r in rows])


def op2_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined cases: null and empty texts are one empty line; without labels every score is 0.5; a null doc_id is
    not held out; repeated rows are scored alike; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = trained(docs, table(spark, sf_dir, "labels"))
    got = scored(docs, field)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go.

    Defined cases: null and empty texts are one empty line and scored as such; without labels every score is 0.5 and all
    documents go; rows without an id, and rows that share one, are judged by their texts; an empty table gives an empty
    result; the columns of docs pass through, whatever their names.
    """
    field = trained(docs, table(spark, sf_dir, "labels"))
    [score] = own_names(docs, "__score")
    return scored(docs, field, out=score).where(F.col(score) >= KEEP).select(*docs.columns)
