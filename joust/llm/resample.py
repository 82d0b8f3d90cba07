"""Target-distribution importance resampling over hashed word features.

Every feature (a run of one or two words) falls into one of BUCKETS buckets. A first pass writes the corpus as blocks:
the packed uint16 buckets of many documents in one stream, with the offset at which each document begins. A second one
sorts each stream and run-length encodes it into counts, which add up in a task and then in one small shuffle (BUCKETS
rows at most, all that the driver sees). With the gain of each bucket, a third pass reads the blocks again, gathers gains
by the stream and sums them by document with np.add.reduceat. Texts are read once.

Documents are drawn without replacement by Gumbel noise from a hash of the id. Their ranks come from one range shuffle of
narrow rows and counts by partition, never from one task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, scratch, stored, table

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Buckets of one stream; a document is never cut, so a longer one is a stream of its own.
STREAM = 1 << 18
#: Lower case, and a blank for every byte that is in no word.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def buckets(text: bytes | None, n: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Words of a whole text, and the bucket of each of its features."""
    words = (text or b"").translate(PLAIN).split()
    if not words:
        return 0, np.empty(0, np.uint16)
    one = list(map(zlib.crc32, words))
    # a checksum goes on where that of the first word ended
    two = map(zlib.crc32, words[1:], map(zlib.crc32, repeat(b" "), one))
    crc = np.fromiter((*one, *two), np.uint32, 2 * len(words) - 1)
    return len(words), (crc % np.uint32(n)).astype(np.uint16)


BLOCK = "docs array<long>, words array<long>, offsets array<long>, stream binary"


def blocks(df: DataFrame, ident: str, text: str, n: int, size: int = STREAM) -> DataFrame:
    """docs, words, offsets (in buckets), stream: the packed buckets of several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, words, offsets, parts, have = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            kinds = (pa.list_(pa.int64()),) * 3
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((docs, words, offsets), kinds)] + [pa.array([np.concatenate(parts).astype("<u2").tobytes()], pa.binary())], ["docs", "words", "offsets", "stream"])

        for b in batches:
            for doc, t in zip(*(c.to_pylist() for c in b.columns)):
                count, own = buckets(t, n)
                docs.append(doc)
                words.append(count)
                offsets.append(have)
                parts.append(own)
                have += len(own)
                if have >= size or len(docs) >= size:
                    yield block()
                    docs, words, offsets, parts, have = [], [], [], [], 0
        if docs:
            yield block()

    return df.select(F.col(ident).cast("long"), F.col(text).cast("binary")).mapInArrow(run, BLOCK)


def counts(streams: DataFrame, n: int) -> np.ndarray:
    """Features in each bucket: each stream is sorted and run-length encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for raw in b.column(0):
                x = np.sort(np.frombuffer(raw.as_buffer(), "<u2"))
                first = np.flatnonzero(np.diff(x, prepend=np.uint16(1) ^ x[:1])) if len(x) else np.empty(0, np.int64)
                total[x[first]] += np.diff(first, append=len(x))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    out = np.zeros(n, np.int64)
    for r in streams.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the ratio of smoothed frequencies, floored."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(streams: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, words, n_features, weight, score of each document of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, words, offsets, raw in zip(*(b.column(i) for i in range(4))):
                ids, at = docs.as_py(), offsets.values.to_numpy()
                x = np.frombuffer(raw.as_buffer(), "<u2")
                size = np.diff(at, append=len(x))
                weight, own = np.zeros(len(ids), np.int64), np.flatnonzero(size)
                if len(own):  # those without a feature would get the next one's
                    weight[own] = np.add.reduceat(gain[x], at[own]) // size[own]
                score = weight + np.array([noise(d, seed) for d in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), words.values, pa.array(size), pa.array(weight), pa.array(score)], ["doc_id", "words", "n_features", "weight", "score"])

    return streams.mapInArrow(run, "doc_id long, words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows plus __rank, 1, 2, ... in that order: a range shuffle, and counts by partition for what is before."""
    placed = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(placed, "ranked").withColumn("__block", F.shiftright("__at", 33))
    # one row a partition
    sizes = placed.groupBy(F.col("__block").alias("__b")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    sizes = sizes.select("__b", (F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__first") + 1).alias("__before"))
    return placed.join(stored(sizes, "ranked-blocks"), F.col("__block") == F.col("__b")).withColumn("__rank", F.col("__at") + F.col("__before")).drop("__at", "__block", "__b", "__before")


def resampled(df: DataFrame, target: DataFrame, ident: str = "doc_id", text: str = "text", target_text: str = "text", n: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, words, n_features, weight, score, rank of every row; rank counts those that are drawn (percent of the rows
    with so many words, highest scores first, ties to the smaller doc_id), the others have null. n: up to 65,536.

    Defined cases: null and empty texts, and texts without words, have no features and weight 0; a null doc_id has the
    noise of an empty one and comes last among ties; rows that share an id are drawn one by one, equal rows in any order;
    an empty table gives an empty result, an empty target one of no features; other columns are not read.
    """
    with scratch(df.sparkSession) as work:
        streams = stored(blocks(df, ident, text, n), "streams")
        wanted = counts(blocks(target.withColumn("__no", F.lit(None).cast("long")), "__no", target_text, n), n)
        rows = work.kept(stored(weighed(streams, gains(counts(streams, n), wanted), seed), "weighed"))
    long_enough = F.col("words") >= least
    drawn = rows.where(long_enough).count() * percent // 100
    got = ranked(rows.where(long_enough), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    got = got.withColumn("rank", F.when(F.col("__rank") <= drawn, F.col("__rank"))).drop("__rank")
    return got.unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))


def op12_sorted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 by a table that the rule of the polynomial gives.
ORACLE = rf"""
with recursive k as (select 0 as j, range::bigint as i, range::bigint as c from range(256) union all select j + 1, i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from k where j < 8),
crc as materialized (select list(c order by i) as t from k where j = 8),
texts as (select 'd' as side, doc_id as id, row_number() over () as n, text from documents union all select 'b', item_id, row_number() over (), text from benchmark),
w as materialized (select side, id, n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
f as materialized (select side, id, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as feature from w where len(w) > 0),
b as materialized (select feature, xor(list_reduce(list_transform(range(1, 1 + len(h) // 2), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::bigint), 4294967295) % {BUCKETS} as bucket
  from (select feature, hex(encode(feature)) as h from (select distinct feature from f)), crc),
c as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from f join b using (feature) group by bucket),
g as (select bucket, floor(1000 * ln((t + 1)::double * ((sum(s) over ())::double + {BUCKETS}) / ((s + 1)::double * ((sum(t) over ())::double + {BUCKETS}))))::bigint as gain from c),
d as (select n, count(*)::bigint as n_features, floor(sum(gain)::double / count(*))::bigint as weight from f join b using (feature) join g using (bucket) where side = 'd' group by n),
x as (select id as doc_id, len(w) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{SEED}:' || coalesce(id::varchar, '')), 1, 8))::bigint as h from w left join d using (n) where side = 'd'),
y as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from x),
r as (select *, row_number() over (partition by words >= {LEAST_WORDS} order by score desc, doc_id nulls last) as place, count(*) filter (words >= {LEAST_WORDS}) over () as enough from y)
select doc_id, n_features, weight, score, case when words >= {LEAST_WORDS} and place <= enough * {PERCENT} // 100 then place end as rank from r
"""
