"""N-gram Jaccard join over prefix trees.

A document is the set of its word shingles, in one global order: rarest first, by counts over all documents in buckets of
a sketch of fixed size. Two sets that are similar enough share one of the first tokens of each (the prefix filter), so
sets are grouped by those tokens. Tokens with the same members are one group, kept at the first of them, and a pair is
looked for where its first common token is.

A group stores its ordered sets, from that token to the end of the prefix, in a path-compressed trie. Each set is walked
through the trie once: what partners have in common is counted once for all of them, and a subtree goes where the common
tokens so far and the tokens that remain at most are too few, where lengths are out of range, or where everything is in
the set's own component already. What is left has to be near in the parities of its tokens by BITS buckets (two sets
differ in as many tokens at least as in parities), and is then decided by the whole sets.

Only components are asked for, so copies are never expanded into all their pairs: equal texts and sets collapse first;
in a first round each set of a group proposes its most promising partner only, which joins nearly all that belongs
together; a second round proposes every pair whose ends are still apart, in the groups where a set had more than one. A group beyond BLOCK sets is cut into blocks,
and in the second round what is outside of the group's largest component meets every block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, few, partitions, scratch, small, stored, table
from .simhash import shingles, text_key

WIDTH, PERCENT = 3, 90
#: Counters of the sketch that orders tokens, in pieces of so many that are sent on their own.
COUNTERS, PIECE = 1 << 21, 1 << 11
#: Sets of a group that are in one trie, and the tokens of each in it.
BLOCK, DEPTH = 1024, 64
#: Parities of a set's tokens.
BITS = 1024
#: Partners that are compared with one set in one task.
PARTNERS = 500


def counted(docs: DataFrame, width: int) -> np.ndarray:
    """How many sets hold a token of each counter, up to 2**31: the sketch. A task sends its counters in pieces, which are
    added up by piece; 4 bytes a counter reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in few(batches):
            for t in b.column(0).to_pylist():
                # distinct tokens of one set may still share a counter
                np.add.at(total, (np.unique(shingles(t, width)) % np.uint64(COUNTERS)).astype(np.int64), 1)
        yield from pieces(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for piece, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[piece * PIECE : (piece + 1) * PIECE] += unpacked(raw)
        yield from pieces(total)

    schema = "piece int, counts binary"
    own = docs.select("text").mapInArrow(count, schema)
    added = own.repartition(min(partitions(docs.sparkSession), COUNTERS // PIECE), "piece").mapInArrow(add, schema)
    out = np.zeros(COUNTERS, np.int64)
    for r in added.collect():  # one row a piece
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = unpacked(r["counts"])
    return out


def pieces(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """piece, counts: those with a count, each in as many bytes a counter as its largest takes."""
    rows = np.minimum(total, 2**31).reshape(-1, PIECE)
    most = rows.max(axis=1)
    used = np.flatnonzero(most)
    kinds = ["<u1" if m < 2**8 else "<u2" if m < 2**16 else "<u4" for m in most[used]]
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([rows[i].astype(k).tobytes() for i, k in zip(used, kinds)], pa.binary())], ["piece", "counts"])


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // PIECE}").astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Four levels a doubling of the count; a byte a counter."""
    return np.minimum(4 * np.log2(counts + 1.0), 127).astype(np.uint8)


def coded(own: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Tokens in global order: the level of each, then 56 bits of its hash; none is negative."""
    first = level[(own % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
    return np.sort(first | (own >> np.uint64(8))).astype(np.int64)


def parities(own: np.ndarray) -> bytes:
    return np.packbits(np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


SET = "doc_id long, k long, n long, s long, prefix array<long>, bits binary"


def encoded(docs: DataFrame, level: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, k (hash of the text), n (tokens), s (hash of the set, null without tokens), prefix (the first tokens, one
    of which any partner has among its own), bits (parities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            n, s, prefix, bits = [], [], [], []
            for t in b.column(2).to_pylist():
                own = np.unique(shingles(t, width))
                size = len(own)
                n.append(size)
                s.append(np.int64(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).astype(np.int64)) if size else None)
                prefix.append(coded(own, level)[: size - -(-percent * size // 100) + 1] if size else None)
                bits.append(parities(own) if size else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], [c.split()[0] for c in SET.split(", ")])

    return docs.mapInArrow(run, SET)


def least_common(a, b, percent: int):
    """Common tokens that sets of a and b tokens need."""
    return -(-percent * (a + b) // (100 + percent))


@dataclass
class Node:
    """A piece of path that the sets lo to hi, in lexicographic order, share; those up to mid end here. least, most: of
    their sizes; rest: the most tokens that one of them has from the group's token on; comp: theirs, if it is one."""

    path: np.ndarray
    lo: int
    mid: int
    hi: int
    least: int
    most: int
    rest: int
    comp: int | None
    below: list[Node] = field(default_factory=list)


@dataclass
class Sets:
    """Of each set: its id, size, place of the group's token in it, prefix from there on (DEPTH tokens at most),
    parities and component."""

    ids: list[int]
    n: np.ndarray
    at: np.ndarray
    seqs: list[np.ndarray]
    bits: np.ndarray
    comps: np.ndarray


def trie(sets: Sets) -> tuple[Node, list[int]]:
    """The root, and the sets in lexicographic order."""
    order = sorted(range(len(sets.ids)), key=lambda i: sets.seqs[i].astype(">i8").tobytes())
    seqs = [sets.seqs[i] for i in order]
    n, at, comps = sets.n[order], sets.at[order], sets.comps[order]

    def node(lo: int, hi: int, depth: int) -> tuple[Node, int]:
        a, b = seqs[lo][depth:], seqs[hi - 1][depth:]
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[:short] != b[:short])
        common = int(differ[0]) if len(differ) else short
        mid = lo
        while mid < hi and len(seqs[mid]) == depth + common:
            mid += 1
        same = comps[lo:hi]
        return Node(a[:common], lo, mid, hi, int(n[lo:hi].min()), int(n[lo:hi].max()), int((n[lo:hi] - at[lo:hi]).max()), int(same[0]) if (same == same[0]).all() else None), depth + common

    root, depth = node(0, len(order), 0)
    todo = [(root, depth)]
    while todo:
        top, depth = todo.pop()
        lo = top.mid
        while lo < top.hi:
            hi, token = lo + 1, seqs[lo][depth]
            while hi < top.hi and seqs[hi][depth] == token:
                hi += 1
            kid, end = node(lo, hi, depth)
            top.below.append(kid)
            todo.append((kid, end))
            lo = hi
    return root, order


def partners(sets: Sets, x: int, root: Node, order: list[int], theirs: Sets, percent: int, after: int = -1) -> Iterator[tuple[int, int]]:
    """(set, least number of tokens that differ) of all of theirs that may be similar enough to x and are of another
    component; after: only those beyond that place of the order."""
    seq, n, comp = sets.seqs[x], int(sets.n[x]), int(sets.comps[x])
    rest, last = n - int(sets.at[x]), sets.seqs[x][-1]
    low, high = -(-percent * n // 100), 100 * n // percent
    todo = [(root, 0, 0, 0)]
    while todo:
        top, common, i, j = todo.pop()
        if top.comp == comp or top.most < low or top.least > high or top.hi <= after + 1:
            continue
        if i < len(seq) and len(top.path):
            known = int(np.searchsorted(top.path, last, "right"))  # beyond, x's tokens are not known
            some = top.path[:known]
            common += int((seq[np.searchsorted(seq, some)] == some).sum())
            j += known
            i = int(np.searchsorted(seq, top.path[-1], "right")) if known == len(top.path) else len(seq)
        if common + min(rest - i, top.rest - j) < least_common(n, max(top.least, low), percent):
            continue
        for k in range(max(top.lo, after + 1), top.mid):
            y = order[k]
            size = int(theirs.n[y])
            if theirs.comps[y] == comp or not low <= size <= high:
                continue
            need = least_common(n, size, percent)
            if common + min(rest - i, size - int(theirs.at[y]) - j) >= need:
                differ = int(np.bitwise_count(sets.bits[x] ^ theirs.bits[y]).sum())
                if differ <= n + size - 2 * need:
                    yield y, differ
        todo += [(kid, common, i, j) for kid in top.below]


def proposed(asking: Sets, theirs: Sets, percent: int, every: bool) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of ids: every one, once if both sides are the same; or of each set the most promising one only, and whether
    some set had more."""
    root, order = trie(theirs)
    out, more = [], False
    place = {x: k for k, x in enumerate(order)} if every and asking is theirs else {}
    for x in range(len(asking.ids)):
        found = list(partners(asking, x, root, order, theirs, percent, place.get(x, -1)))
        if every:
            out += [(asking.ids[x], theirs.ids[y]) for y, _ in found]
        elif found:
            best = min((d / (int(asking.n[x]) + int(theirs.n[y])), theirs.ids[y]) for y, d in found)
            out.append((asking.ids[x], best[1]))
            more |= len(found) > 1
    return out, more


def shared(sets: DataFrame, percent: int) -> DataFrame:
    """token, s, bit of the tokens that at least two sets have, by a range shuffle in which the sets of a token may fill
    any number of partitions. What comes first or last in one stays, as it may go on in the next.

    bit: the set's length class, out of 64 that begin again; similar sets are of one class or of neighbouring ones."""
    ratio = max(float(np.log(100 / percent)) * 1.0001, 0.01)
    bit = F.expr(f"shiftleft(1L, cast(pmod(floor(ln(n) / {ratio!r}D), 64) as int))").alias("bit")
    members = sets.select(F.explode("prefix").alias("token"), "s", bit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = held = None
        for b in batches:
            if not b.num_rows:
                continue
            token = b.column(0).to_numpy()
            same = token[1:] == token[:-1]
            kept = np.concatenate([[previous is None or token[0] == previous], same]) | np.concatenate([same, [False]])
            if held is not None and token[0] == previous:
                yield held
            yield b.filter(pa.array(kept))
            previous, held = token[-1], None if kept[-1] else b.slice(b.num_rows - 1)
        if held is not None:
            yield held

    dealt = members.repartitionByRange(partitions(sets.sparkSession), "token", "s").sortWithinPartitions("token", "s")
    return stored(dealt.mapInArrow(run, "token long, s long, bit long"), "ngram-shared")


def groups(sets: DataFrame, percent: int) -> DataFrame:
    """token, s, size: the members of each group of two sets or more, one group for all tokens with the same members, at
    the first of them in global order. Members without any other of a fitting length are left out; size counts them."""
    x = shared(sets, percent)
    next_to = lambda c, d: c.bitwiseAND(F.shiftleft(d, 1).bitwiseOR(F.shiftrightunsigned(d, 63)))
    same = [F.bit_xor(F.xxhash64(F.lit(i), "s")).alias(f"same{i}") for i in range(2)]
    tokens = x.groupBy("token").agg(F.count("*").alias("size"), F.bit_or("bit").alias("any"), *same)
    crowded = F.col("size") > F.bit_count("any")  # some class has two
    tokens = tokens.where(crowded | (next_to(F.col("any"), F.col("any")) != 0)).where("size > 1")
    first = stored(tokens.groupBy("size", "any", "same0", "same1").agg(F.min("token").alias("token")).select("token", "size", "any"), "ngram-tokens")
    bit = F.col("bit")
    fits = crowded | (next_to(bit, F.col("any")) != 0) | (next_to(F.col("any"), bit) != 0)
    return stored(x.join(first, "token").where(fits).select("token", "s", "size"), "ngram-groups")


def walked(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """(s, other), s < other: what the groups propose, and rows that only have the token of a group in which a set had
    more to propose. rows: token, i, b (a trie for each of them), role (0: asks and is asked, 1: is asked, 2: asks), s, n,
    at, seq, bits, comp."""
    columns = ["token", "i", "b", "role", "s", "n", "at", "seq", "bits", "comp"]

    def one(b: pa.Table) -> list[tuple[int | None, int | None, int | None]]:
        role = b["role"].to_numpy()

        def side(at: np.ndarray) -> Sets:
            x = b.take(pa.array(at))
            bits = np.frombuffer(b"".join(x["bits"].to_pylist()), np.uint64).reshape(len(at), -1)
            return Sets(x["s"].to_pylist(), x["n"].to_numpy(), x["at"].to_numpy(), [np.array(v, np.int64) for v in x["seq"].to_pylist()], bits, x["comp"].to_numpy())

        if (role == 0).all():
            both = side(np.arange(len(role)))
            found, more = proposed(both, both, percent, every)
        else:
            asking, theirs = np.flatnonzero(role == 2), np.flatnonzero(role == 1)
            found, more = proposed(side(asking), side(theirs), percent, every) if len(asking) and len(theirs) else ([], False)
        return [(min(p), max(p), None) for p in found] + [(None, None, b["token"][0].as_py())] * more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            keys = np.stack([t[c].to_numpy() for c in ("token", "i", "b")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if kept and [kept[-1][c][0].as_py() for c in ("token", "i", "b")] != keys[lo].tolist():
                    out += one(pa.concat_tables(kept))
                    kept = []
                kept.append(t.slice(lo, hi - lo))
            yield pairs(out)
        if kept:
            yield pairs(one(pa.concat_tables(kept)))

    def pairs(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(3)], ["s", "other", "token"])

    dealt = rows.select(*columns).repartition(partitions(rows.sparkSession), "token", "i", "b").sortWithinPartitions("token", "i", "b")
    return stored(dealt.mapInArrow(run, "s long, other long, token long").distinct(), "ngram-walked")


def filled(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows plus what the walk needs of their sets."""
    got = rows.join(sets.select("s", "n", "prefix", "bits"), "s").withColumn("at", F.array_position("prefix", F.col("token")) - 1)
    return got.withColumn("seq", F.expr(f"slice(prefix, cast(at + 1 as int), {DEPTH})"))


def blocks(size) -> F.Column:
    return F.ceil(size / F.lit(BLOCK)).cast("int")


def dealt(size, *key) -> F.Column:
    """The block of a row."""
    return F.pmod(F.xxhash64(*key), blocks(size)).cast("int")


def apart(members: DataFrame, unsettled: DataFrame, comps: DataFrame, outside: bool = False) -> DataFrame:
    """token, i, b, role, s, comp: the groups that still hold several components, of those that are unsettled or of more
    than a block (in the others the first round has proposed all). A group of more than a block is walked
    by those outside of its largest component, each block of them in each block of the group; with outside, so is every
    group."""
    left = members.join(unsettled.withColumn("open", F.lit(True)), "token", "left").where(F.col("open") | (F.col("size") > BLOCK)).drop("open")
    known = left.join(comps.select(F.col("node").alias("s"), "comp"), "s", "left").withColumn("comp", F.coalesce("comp", "s"))
    known = stored(known, "ngram-members")
    mixed = known.groupBy("token", "comp").agg(F.count("*").alias("n")).groupBy(F.col("token").alias("__t"))
    mixed = mixed.agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("most")).where("comps > 1").select("__t", F.col("most.comp").alias("top"), F.col("most.n").alias("in_top"))
    rows = known.join(stored(mixed, "ngram-mixed"), F.col("token") == F.col("__t"))
    at_once = F.lit(not outside) & (F.col("size") <= BLOCK)
    small = rows.where(at_once).select("token", F.lit(0).alias("i"), F.lit(0).alias("b"), F.lit(0).alias("role"), "s", "comp")
    rest = F.col("size") - F.col("in_top")
    large = rows.where(~at_once)
    asked = large.select("token", F.explode(F.sequence(F.lit(0), blocks(rest) - 1)).alias("i"), dealt(F.col("size"), "s").alias("b"), F.lit(1).alias("role"), "s", "comp")
    asks = large.where("comp <> top").select("token", dealt(rest, "s").alias("i"), F.explode(F.sequence(F.lit(0), blocks(F.col("size")) - 1)).alias("b"), F.lit(2).alias("role"), "s", "comp")
    return small.unionByName(asked).unionByName(asks)


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of (s, other) pairs, those that are similar. Only texts of pairs are read into sets; a set with very many partners
    is copied to several tasks, so none meets them all."""
    pairs = stored(pairs, "ngram-pairs")
    ends = stored(pairs.select(F.explode(F.array("s", "other")).alias("s")).distinct().join(sets.select("s", "k"), "s"), "ngram-ends")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingles(t, width)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["s", "own"])

    own = docs.select("k", "text").join(small(ends), "k").dropDuplicates(["s"]).select("s", "text").mapInArrow(whole, "s long, own binary")
    own = stored(own, "ngram-whole")
    busy = pairs.groupBy(F.col("other").alias("__of")).agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    salted = pairs.join(busy, F.col("other") == F.col("__of")).select("s", "other", F.pmod(F.xxhash64("s"), F.col("salts")).cast("int").alias("salt"))
    theirs = own.join(busy, F.col("s") == F.col("__of")).select(F.col("s").alias("other"), F.col("own").alias("their"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = []
            for x, y in zip(b.column(2), b.column(3)):  # as they stand in the batch, without a copy of each
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                fine.append(len(np.intersect1d(x, y, assume_unique=True)) >= least_common(len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["s", "other"]).filter(pa.array(fine, pa.bool_()))

    joined = salted.join(own, "s").join(theirs, ["other", "salt"]).select("s", "other", "own", "their")
    return stored(joined.mapInArrow(compare, "s long, other long"), "ngram-links")


def linked(docs: DataFrame, sets: DataFrame, width: int, percent: int, known: DataFrame | None = None) -> DataFrame:
    """(node, comp) of the sets that have links. known: (node, comp) of sets that are linked already; they are not compared
    with each other again, and what is outside of a group's largest component asks the others."""
    members = groups(sets, percent)
    if known is None:
        rows = members.select("token", F.lit(0).alias("i"), dealt(F.col("size"), "s", "token").alias("b"), F.lit(0).alias("role"), "s", F.col("s").alias("comp"))
    else:
        rows = stored(apart(members, members.select("token").distinct(), known, outside=True), "ngram-apart")
    found = walked(filled(rows, sets), percent, every=False)
    links = verified(docs, sets, found.where("s is not null").select("s", "other"), width, percent)
    if known is not None:
        links = links.unionByName(known.select(F.col("node").alias("s"), F.col("comp").alias("other")))
    first = stored(components(links, "s", "other"), "ngram-first")
    rows = stored(apart(members, found.where("token is not null").select("token"), first, outside=known is not None), "ngram-apart")
    found = walked(filled(rows, sets), percent, every=True)
    more = verified(docs, sets, found.select("s", "other"), width, percent)
    return stored(components(links.unionByName(more), "s", "other"), "ngram-classes")


def joined(docs: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """(k, other): edges that join all texts of docs (k, text; k distinct) that are linked; those of one class meet in its
    smallest k. known: (node, comp) of texts that are linked already. Texts without words are alike."""
    rows = stored(encoded(docs.select(F.col("k").alias("doc_id"), "k", "text"), levels(counted(docs, width)), width, percent), "ngram-sets")
    sets = rows.where("n > 0").groupBy("s").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    before = rows.where("n > 0").join(known, F.col("k") == F.col("node")).groupBy("s").agg(F.min("comp").alias("comp")).select(F.col("s").alias("node"), "comp")
    comps = linked(docs, stored(sets, "ngram-distinct"), width, percent, stored(before, "ngram-known"))
    named = rows.select("k", "s").join(comps, F.col("s") == F.col("node"), "left").select("k", F.coalesce("comp", "s", F.lit(-1)).alias("c"))
    named = stored(named, "ngram-named")
    least = named.groupBy(F.col("c").alias("__c")).agg(F.min("k").alias("other"))
    return named.join(least, F.col("c") == F.col("__c")).where("k <> other").select("k", "other")


def similar_sets(df: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, s (hash of the set, null without words), component_id (the smallest doc_id reachable over
    links, itself included) of every row; documents are linked if their sets of shingles of `width` words have percent of
    their union in common.

    Defined cases: null and empty texts, and texts without words, have no set and no link; a text of fewer words than a
    shingle is one shingle; repeated rows and equal texts are linked; a null id takes part but never names a class unless
    no other id is there (then component_id is null); an empty table gives an empty result; other columns are not read.
    Sets are told apart by 64-bit hashes.
    """
    docs = df.select(F.col(ident).cast("long").alias("doc_id"), text_key(text).alias("k"), F.col(text).cast("binary").alias("text"))
    with scratch(df.sparkSession) as work:
        rows = stored(encoded(docs, levels(counted(docs, width)), width, percent), "ngram-sets")
        # one row a set: its first tokens and parities are the same in all of its texts
        sets = rows.where("n > 0").groupBy("s").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
        comps = linked(docs, stored(sets, "ngram-distinct"), width, percent)
        slim = rows.select("doc_id", F.col("n").alias("n_shingles"), "s")
        named = slim.where("s is not null").groupBy("s").agg(F.min("doc_id").alias("low")).join(comps, F.col("s") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "s"))
        least = named.groupBy(F.col("comp").alias("__c")).agg(F.min("low").alias("component_id"))
        named = named.join(least, F.col("comp") == F.col("__c")).select(F.col("s").alias("__s"), "component_id")
        got = slim.join(named, F.col("s") == F.col("__s"), "left")
        return work.kept(stored(got.select("doc_id", "n_shingles", "s", F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "ngram-result"))


def op11_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: All pairs of sets that share a shingle: for small tables.
ORACLE = rf"""
with recursive w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
g as (select r, doc_id, case when len(w) = 0 then []::varchar[] when len(w) < {WIDTH} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(list_slice(w, i, i + {WIDTH - 1}), ' '))) end as g from w),
d as materialized (select r, doc_id, len(g) as n, sha256(array_to_string(list_sort(g), chr(10))) as s, g from g),
sets as materialized (select s, any_value(n) as n, any_value(g) as g from d where n > 0 group by s),
t as materialized (select s, n, unnest(g) as token from sets),
p as (select a.s as a, b.s as b from t a join t b on a.token = b.token and a.s < b.s and 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) group by all having 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
e as materialized (select a, b from p union all select b, a from p),
low as materialized (select s, min(doc_id) as low from d where n > 0 group by s),
reach(s, c) as (select s, low from low union select e.b, c from reach join e on e.a = reach.s),
c as (select s, min(c) as component_id from reach group by s)
select doc_id, n::bigint as n_shingles, case when n = 0 then doc_id else component_id end as component_id from d left join c using (s)
"""
