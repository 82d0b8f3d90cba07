"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments, so among four or fewer differing bits one segment differs in one
bit at most. Every distinct fingerprint is indexed under 64 keys: a segment with one of its bits wild. Equal keys
propose links, the whole fingerprints verify them.

Groups of copies are never expanded into pairs. Documents collapse to distinct fingerprints first; in a key's
group everything is verified against one pivot (the most frequent fingerprint), the links found form provisional
components, and only members outside the pivot's component are compared with the others. Pairs inside one
component are connected already, so the components are exact.

Copies by similarity (similar(), the pipeline's stage) need more: texts whose sets of five-word shingles are 0.8
alike differ in some ten of 64 bits, out of reach of a radius that three segments can guarantee. There a fingerprint
has WORDS words of 64 bits, each indexed by the same deletion variants, so a pair has three chances a word to agree in
a segment but for one bit; another word of both fingerprints has to be near, and the shingle sets themselves decide.
The share of pairs of 0.8 that meet at all is measured in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, few, own_names, partitions, scratch, small, stored, table

WIDTH = 4
SEED = 42
RADIUS = 4
#: Copies by similarity: words a shingle, least share of common shingles, 64-bit words a fingerprint, and how many
#: bits another word may differ in (at a similarity of 0.8 its differing bits are 9.7 on average, deviation 2.9).
SHINGLE, SIMILARITY, WORDS, CHECK = 5, 0.8, 3, 22
#: Over all words a pair may differ in so many bits a word, over four deviations more than at that similarity; rounds in
#: which each text is compared with one pivot before all that is left is.
ALL_BITS, FIRST_ROUNDS = 17, 2
#: Partners that are compared with one shingle set in one task.
PARTNERS = 1000
#: Members of a key that are compared with each other, for each 2^20 texts begun: by chance a key has one a 2^20 texts.
CROWD = 8
SEGMENTS = ((0, 21), (21, 42), (42, 64))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each shingle of a whole text in order, repeats included; none without words."""
    norm = b" ".join((text or b"").lower().split())
    if not norm:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(gaps) < width - 1:
        return np.array([digest(norm, SEED)], np.uint64)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(norm)][width - 1 :]
    return np.array([digest(norm[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Signed; a bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    full = n // 255 * 255
    ones = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The signed 64-bit fingerprint of a whole text; 0 without words (null and empty texts too)."""
    return majority(shingles(text, width))


def long_fingerprint(text: bytes | None, width: int = SHINGLE, words: int = WORDS) -> list[int]:
    """Of the set of shingles, `words` signed words; each word sees every shingle under another hash."""
    own, out = np.unique(shingles(text, width)), []
    for k in range(words):
        x = own * np.uint64(0x9E3779B97F4A7C15 + 2 * k) if k else own
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(x ^ (x >> np.uint64(29))))
    return out


def fingerprints(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


#: Each segment in three parts: the segment's number and first bit, and the part's first bit and end within it.
PARTS = tuple((k, lo, (hi - lo) * t // 3, (hi - lo) * (t + 1) // 3) for k, (lo, hi) in enumerate(SEGMENTS) for t in range(3))


def spread(fps: DataFrame, words: list[tuple[str, str]], *kept: str) -> DataFrame:
    """kept, part, other, key, check: the 64 one-wildcard variants of each word of the fingerprints (words: its column and
    that of its check) as int keys, dealt out so that equal keys meet.

    The variants of one part of a segment, those that leave out one of its seven bits, have the segment's other bits in
    common. A row is dealt by those, nine a word, and its variants are made where it arrives. A table of fingerprints is a
    few small files and its keys are many rows, so it is dealt to all tasks first."""
    n = partitions(fps.sparkSession)
    x = fps.repartition(n).select(*kept, F.explode(F.array(*[F.struct(F.col(f).alias("f"), F.col(c).alias("check"), F.lit(i).alias("word")) for i, (f, c) in enumerate(words)])).alias("w"))
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(lo).alias("lo"), F.lit((1 << (SEGMENTS[k][1] - lo)) - 1).alias("ones"), F.lit((1 << b) - (1 << a)).alias("wild")) for i, (k, lo, a, b) in enumerate(PARTS)])
    x = x.select(*kept, "w.*", F.explode(parts).alias("v")).withColumn("seg", F.expr("cast(shiftrightunsigned(f, v.lo) & v.ones as int)"))
    x = x.select(*kept, "check", (F.col("word") * 16 + F.col("v.part")).alias("part"), F.expr("seg & ~v.wild").alias("other"), "seg").repartition(n, "part", "other")
    of = lambda i: F.get(F.array(*[F.lit(p[i]) for p in PARTS]), F.col("part") % 16)
    x = x.withColumn("bit", F.explode(F.sequence(of(2), of(3) - 1))).withColumn("lo", of(1))
    return x.select(*kept, "part", "other", F.expr("((seg & ~shiftleft(1, bit)) * 64 + lo + bit) * 4 + cast(part / 16 as int)").alias("key"), "check")


def near(a, b, radius: int = RADIUS):
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def classes(fps: DataFrame) -> DataFrame:
    """(fp, n) rows, fp distinct -> (fp, comp): comp of linked fingerprints; those without links are left out."""
    with scratch(fps.sparkSession) as work:
        return work.kept(stored(linked(fps), "simhash-classes"))


def linked(fps: DataFrame) -> DataFrame:
    w = Window.partitionBy("part", "other", "key")
    groups = spread(fps, [("fp", "fp")], "fp", "n").select("key", "fp", F.count("*").over(w).alias("size"), F.max(F.struct("n", "fp")).over(w)["fp"].alias("pivot")).where("size > 1 and fp <> pivot")
    # two alone are settled by the comparison with the pivot
    groups = groups.where((F.col("size") > 2) | near(F.col("fp"), F.col("pivot"))).select("key", "fp", "pivot")
    groups = stored(groups, "simhash")
    direct = components(groups.where(near(F.col("fp"), F.col("pivot"))), "fp", "pivot")
    of = lambda name, to: direct.select(F.col("node").alias(name), F.col("comp").alias(to))
    known = groups.join(of("fp", "c"), "fp", "left").join(of("pivot", "p"), "pivot", "left")
    known = stored(known.select("key", "fp", F.coalesce("c", "fp").alias("c"), F.coalesce("p", "pivot").alias("p")), "simhash")
    rest = known.where("c <> p").select("key", F.col("fp").alias("x"), F.col("c").alias("cx"))
    pairs = rest.join(known, "key").where((F.col("cx") != F.col("c")) & ((F.col("c") == F.col("p")) | (F.col("x") < F.col("fp"))) & near(F.col("x"), F.col("fp")))
    joined = components(pairs.select(F.col("cx").alias("a"), F.col("c").alias("b")).distinct(), "a", "b")
    # components() knows only components with a further link; nodes keep their own otherwise
    lone = joined.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    first = direct.join(lone, "comp", "left").select(F.col("node").alias("fp"), F.coalesce("top", "comp").alias("comp"))
    other = joined.join(direct.select("node"), "node", "left_anti").select(F.col("node").alias("fp"), "comp")
    return first.unionAll(other)


def near_duplicates(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Defined cases: null and empty texts have fingerprint zero and link like any other; a text of fewer words
    than a shingle is one shingle; repeated rows are rows of the same class; a null id takes part, but never names
    a class unless no other id is there (then component_id is null); an empty table gives an empty result; other
    columns are not read.
    """
    docs = stored(fingerprints(df, ident, text), "simhash-fp")  # the result reads it
    distinct = docs.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    comp = classes(distinct.select("fp", "n"))
    named = distinct.join(comp, "fp", "left").select("fp", "low", F.coalesce("comp", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(least, "comp").select("fp", "component_id")
    return docs.join(named, "fp")


def op9_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar(df: DataFrame, ident: str = "doc_id", text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(k, comp): classes of texts, by hash k of the text, that are linked by a similarity (in whole percent) of their sets
    of shingles; texts without a link are left out. words: up to 4.

    Defined cases: null is the empty text; texts without words are alike; a text of fewer words than a shingle is one
    shingle; repeated rows and texts are one text; an empty table gives an empty result; other columns are not read.
    """
    with scratch(df.sparkSession) as work:
        return work.kept(similar_texts(df.select(text_key(text).alias("k"), F.col(text).cast("binary").alias("text")), width, similarity, words))


def similar_texts(docs: DataFrame, width: int, similarity: float, words: int) -> DataFrame:
    names = [f"f{i}" for i in range(words)]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            got = [long_fingerprint(t, width, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[i] for g in got], pa.int64()) for i in range(words)]], ["k", *names])

    fps = docs.mapInArrow(prints, ", ".join(f"{c} long" for c in ["k", *names])).groupBy("k").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in names])
    fps = stored(fps, "similar-fp")
    # each key travels with another word of the fingerprint, which must be near too
    entries = spread(fps, [(names[i], names[(i + 1) % words]) for i in range(words)], "k", "n")
    w = Window.partitionBy("part", "other", "key")
    groups = entries.select("key", "k", "check", F.count("*").over(w).alias("size"), F.max(F.struct("n", "k", "check")).over(w).alias("pivot")).where("size > 1 and k <> pivot.k")
    groups = groups.select("key", "k", "check", "size", F.col("pivot.k").alias("pivot"), near(F.col("check"), F.col("pivot.check"), CHECK).alias("hit")).where("size > 2 or hit")
    groups = stored(groups, "similar-groups")
    # of those near their pivot in one word, the ones near it over all words
    total = lambda d: sum((F.bit_count(F.col(f"{c}").bitwiseXOR(F.col(f"{d}{c}"))) for c in names[1:]), F.bit_count(F.col(names[0]).bitwiseXOR(F.col(f"{d}{names[0]}"))))
    theirs = fps.select(F.col("k").alias("other"), *[F.col(c).alias(f"o{c}") for c in names])
    pairs = groups.where("hit").select("k", F.col("pivot").alias("other")).distinct().join(fps.drop("n"), "k").join(theirs, "other")
    pairs = stored(pairs.where(total("o") <= ALL_BITS * words).select("k", "other"), "similar-proposed")
    # a text has up to 64 pivots a word, yet one link joins it to its class: first the most wanted pivot of each, then
    # the next of those that are still apart, so that copies are not compared in all ways
    wanted = pairs.groupBy(F.col("other").alias("__of")).agg(F.count("*").alias("votes"))
    ranked = pairs.join(wanted, F.col("other") == F.col("__of")).drop("__of")
    links, open_, direct = None, ranked, None
    for _ in range(FIRST_ROUNDS):
        picked = stored(open_.groupBy("k").agg(F.max(F.struct("votes", "other")).alias("m")).select("k", F.col("m.other").alias("other")), "similar-picked")
        found = verified(docs, picked, width, similarity)
        links = found if links is None else links.unionByName(found)
        direct = stored(components(links, "k", "other"), "similar-direct")
        open_ = open_.join(picked, ["k", "other"], "left_anti").drop("c", "d")
        open_ = open_.join(direct.select(F.col("node").alias("k"), F.col("comp").alias("c")), "k", "left").join(direct.select(F.col("node").alias("other"), F.col("comp").alias("d")), "other", "left")
        open_ = stored(open_.where(F.coalesce("c", "k") != F.coalesce("d", "other")), "similar-open")
    of = lambda name, to: direct.select(F.col("node").alias(name), F.col("comp").alias(to))
    known = groups.select("key", "k", "check", "pivot", "size").join(of("k", "c"), "k", "left").join(of("pivot", "p"), "pivot", "left")
    known = stored(known.select("key", "k", "check", "size", F.coalesce("c", "k").alias("c"), F.coalesce("p", "pivot").alias("p")), "similar-known")
    # groups of few are compared as they are: no pair of texts that are still apart is dropped
    few_here = F.col("size") <= CROWD * (1 + fps.count() // (1 << 20))
    rest = known.where(few_here & (F.col("c") != F.col("p"))).select("key", F.col("k").alias("x"), F.col("check").alias("seen"), F.col("c").alias("cx"))
    other = rest.join(known.where(few_here), "key").where((F.col("cx") != F.col("c")) & ((F.col("c") == F.col("p")) | (F.col("x") < F.col("k"))) & near(F.col("seen"), F.col("check"), CHECK))
    other = other.select(F.col("x").alias("k"), F.col("k").alias("other")).distinct().join(fps.drop("n"), "k").join(theirs, "other")
    left = open_.select("k", "other").unionByName(other.where(total("o") <= ALL_BITS * words).select("k", "other")).distinct()
    links = links.unionByName(verified(docs, left, width, similarity))
    # larger ones are no chance: near copies of one text, mostly too far from each other. All links among their texts are
    # found by the prefixes of their sets, which grows with the texts and not with their pairs
    large = known.where(~few_here)
    crowd = large.join(large.where("c <> p").select("key").distinct(), "key", "left_semi")
    crowd = stored(crowd.select("k").distinct(), "similar-crowd")
    if not crowd.isEmpty():
        from . import ngrams  # which has its shingles from here

        texts = stored(docs.join(small(crowd), "k", "left_semi").dropDuplicates(["k"]), "similar-texts")
        before = stored(components(links, "k", "other"), "similar-before")
        links = links.unionByName(ngrams.joined(texts, before, width, round(100 * similarity)))
    return stored(components(links, "k", "other").select(F.col("node").alias("k"), "comp"), "similar")


def text_key(text: str):
    """Texts are told apart by a 64-bit hash."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def verified(docs: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """pairs: (k, other), distinct -> those whose sets of shingles have at least that share in common. Only texts of
    pairs are shuffled; a text with very many partners is copied to several tasks, so none meets them all."""
    pairs = stored(pairs, "similar-pairs")
    ends = pairs.select(F.explode(F.array("k", "other")).alias("k")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingles(t, width)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["k", "own"])

    texts = docs.join(small(stored(ends, "similar-ends")), "k", "left_semi").dropDuplicates(["k"]).mapInArrow(sets, "k long, own binary")
    texts = stored(texts, "similar-sets")
    busy = pairs.groupBy(F.col("other").alias("__of")).agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / PARTNERS).cast("int"))
    salted = pairs.join(busy.select("__of", "salts"), F.col("other") == F.col("__of")).withColumn("salt", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int")).drop("__of", "salts")
    theirs = texts.join(busy, F.col("k") == F.col("__of")).select(F.col("k").alias("other"), F.col("own").alias("their"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = []
            for raw, own in zip(b.column(2), b.column(3)):  # as they stand in the batch, without a copy of each
                x, their = (np.frombuffer(v.as_buffer(), np.uint64) for v in (own, raw))
                both = len(np.intersect1d(x, their, assume_unique=True))
                fine.append(both >= similarity * (len(x) + len(their) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["k", "other"]).filter(pa.array(fine, pa.bool_()))

    joined = salted.join(texts, "k").join(theirs, ["other", "salt"]).select("k", "other", "their", "own")
    return stored(joined.mapInArrow(compare, "k long, other long"), "similar-links")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of similar documents one row stays, the one of the smallest doc_id (a null one is
    the greatest), of equal ids the one whose text has the smaller hash, of equal rows any one.

    Defined cases: those of similar(); an empty table gives an empty result; the columns of docs pass through.
    """
    mine = docs.select(F.col("doc_id").alias("id"), text_key("text").alias("k"))
    with scratch(spark) as work:
        rows = mine.groupBy("id", "k").agg(F.count("*").alias("n")).join(similar(docs), "k", "left")
        rows = stored(rows.select("id", "k", "n", F.coalesce("comp", "k").alias("c")), "similar-rows")
        first = F.struct(F.col("id").isNull(), "id", "k")
        best = rows.groupBy(F.col("c").alias("of")).agg(F.min(first).alias("best"), F.sum("n").alias("all")).where("all > 1")
        # what goes is mostly far less than what stays: an anti join whose right side may be small
        gone = rows.join(best, F.col("c") == F.col("of")).where(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("k") == F.col("best.k"))))
        gone = work.kept(stored(gone.select("id", "k"), "similar-gone"))
        again = work.kept(stored(rows.where("n > 1").select("id", "k"), "similar-again"))
    key, id_, k = own_names(docs, "__key", "__id", "__k")
    left, same = docs.withColumn(key, text_key("text")), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(k))
    named = lambda x: x.select(F.col("id").alias(id_), F.col("k").alias(k))
    left = left.join(small(named(gone)), same, "left_anti")
    if not again.isEmpty():  # equal rows: one of each
        left = left.join(small(named(again)), same, "left_anti").unionByName(left.join(small(named(again)), same, "left_semi").dropDuplicates(["doc_id", key]))
    return left.select(*docs.columns)
