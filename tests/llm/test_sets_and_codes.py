"""N-gram joins, resampling and product codes against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from joust.llm import codes, ngrams, resample
from joust.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def duck():
    import duckdb

    return duckdb.connect()


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# n-gram join


def plain_sets(texts, width=3):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def plain_components(ids, sets, percent=90):
    comp = [i if i is not None else math.inf for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        old = list(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if old == comp:
            return [None if c == math.inf else c for c in comp]


def near_copies(rng, n_base, n_copies, size):
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n_base):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(n_copies):
            x = list(base)
            for _ in range(rng.randrange(0, 1 + max(2, size // 40))):
                x[rng.randrange(len(x))] = rng.choice(words)
            out.append(" ".join(x[: len(x) - rng.randrange(0, 3)]))
    return out


@pytest.mark.parametrize("block,depth", [(1024, 64), (3, 2)])
def test_components_of_similar_sets_equal_brute_force(spark, monkeypatch, block, depth):
    monkeypatch.setattr(ngrams, "BLOCK", block)
    monkeypatch.setattr(ngrams, "DEPTH", depth)
    rng = random.Random(block)
    texts = near_copies(rng, 3, 14, 60) + near_copies(rng, 2, 12, 200) + near_copies(rng, 1, 25, 120)
    texts += ["", None, " \t\n", "one", "ONE", "one two", "a b c", "a b c", "a\tB  c", "É b c", "x " * 400, "x " * 5, "a b c d " * 500]
    ids = [*range(len(texts) - 3), 7, None, None]
    rows = [(i, t, "x", 1, 2, "y", 3) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, n int, s int, component_id string, token int")
    got = ngrams.similar_sets(df.repartition(3)).collect()
    sets = plain_sets(texts)
    comp = plain_components(ids, sets)
    want = sorted(((-1 if i is None else i), len(s), (-1 if c is None else c)) for i, s, c in zip(ids, sets, comp))
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, (-1 if r.component_id is None else r.component_id)) for r in got) == want
    assert len({c for c in comp}) < len(texts) - 20


def test_sets_of_an_empty_table(spark):
    assert ngrams.similar_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = ngrams.similar_sets(spark.createDataFrame([(5, None), (5, "a b"), (6, "b a")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in one) == [(5, 0, 5), (5, 1, 5), (6, 1, 6)]


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_the_walk_loses_no_similar_pair(percent):
    rng = np.random.default_rng(percent)
    level = np.zeros(ngrams.COUNTERS, np.uint8)
    for size in (1, 4, 30, 200):
        base = rng.integers(0, 2**63, size, np.uint64)
        sets = []
        for _ in range(30):
            x = base.copy()
            x[rng.integers(0, size, rng.integers(0, 1 + size // 5))] = rng.integers(0, 2**63, dtype=np.uint64)
            sets.append(np.unique(np.concatenate([x[rng.random(size) < 0.97], rng.integers(0, 2**63, rng.integers(0, 3), np.uint64), base[:1]])))
        whole = [ngrams.coded(s, level) for s in sets]
        prefix = [w[: len(w) - -(-percent * len(w) // 100) + 1] for w in whole]
        found = set()
        for token in {t for p in prefix for t in p.tolist()}:
            own = [i for i, p in enumerate(prefix) if token in p]
            at = [int(np.searchsorted(prefix[i], token)) for i in own]
            both = ngrams.Sets(own, np.array([len(sets[i]) for i in own]), np.array(at), [prefix[i][a : a + 8] for i, a in zip(own, at)], np.array([np.frombuffer(ngrams.parities(sets[i]), np.uint64) for i in own]), np.array(own))
            found |= {(min(p), max(p)) for p in ngrams.proposed(both, both, percent, True)[0]}
            best, more = ngrams.proposed(both, both, percent, False)
            every = {(min(p), max(p)) for p in ngrams.proposed(both, both, percent, True)[0]}
            assert len(best) <= len(own) and {(min(p), max(p)) for p in best} <= every and (more or {(min(p), max(p)) for p in best} == every)
        for a in range(30):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    assert (b, a) in found


# resampling


def plain_resample(docs, target, least=20, percent=25, n=10_000):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [zlib.crc32(f.encode()) % n for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    own = [(i, *features(t)) for i, t in docs]
    s, t = np.zeros(n), np.zeros(n)
    for _, _, f in own:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + n) / ((a + 1) * (t.sum() + n)))) for a, b in zip(s, t)]
    out = []
    for i, words, f in own:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: len(enough) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_resampling_equals_the_definition(spark, duck):
    rng = random.Random(3)
    words = ["Alpha", "beta", "x9", "ÉTÉ", "été", "naïve", "7", "gamma-delta", "it's", "日本"] + [f"v{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(None, "a " * 30), (None, None), (300, ""), (301, " .,! "), (5, docs[5][1]), (302, "A b " * 30_000), (303, "one")]
    target = ["alpha beta v1 v2 v3", None, "", "V1 v2 v3 v4 " * 20]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], "doc_id long, text string, words int, stream string, rank string")
    bench = spark.createDataFrame([(1, t, "x") for t in target], "item_id long, text string, doc_id string")
    key = lambda r: tuple((v is None, v or 0) for v in r)
    got = sorted((tuple(r) for r in resample.resampled(df.repartition(3), bench).drop("words").collect()), key=key)
    assert got == sorted(plain_resample(docs, target), key=key)
    documents, benchmark = df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}), bench.select("item_id", "text").toPandas()  # noqa: F841
    duck.execute("create table documents as select doc_id::bigint as doc_id, text from documents")
    duck.execute("create table benchmark as select * from benchmark")
    assert sorted(duck.execute("select doc_id, n_features, weight, score, rank from (" + ORACLE_SQL["op12_sorted_counts"] + ")").fetchall(), key=key) == got


def test_resampling_of_empty_tables(spark):
    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample.resampled(none, bench).count() == 0
    some = spark.createDataFrame([(i, "a b c " * 10) for i in range(8)], "doc_id long, text string")
    got = resample.resampled(some, bench.limit(0)).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2]


def test_blocks_of_streams_are_cut_between_documents(spark):
    df = spark.createDataFrame([(i, "a b c " * n) for i, n in enumerate((0, 1, 50, 0, 0, 3))], "doc_id long, text string").coalesce(1)
    got = resample.blocks(df, "doc_id", "text", 10_000, size=20).collect()
    assert [(r.docs, r.offsets, len(r.stream) // 2) for r in got] == [([0, 1, 2], [0, 0, 5], 304), ([3, 4, 5], [0, 0, 0], 17)]


# codes


@pytest.mark.parametrize("wide", [1, 2, 3, 5, 16, 33])
@pytest.mark.parametrize("scale", [1, 3, 1000, codes.LARGEST])
def test_nearest_entries_equal_brute_force(wide, scale):
    rng = np.random.default_rng(wide)
    x = rng.integers(-scale, scale + 1, (700, wide))
    entries = np.concatenate([x[:40], x[:10], rng.integers(-scale, scale + 1, (50, wide)), np.full((1, wide), -scale)])
    x[-1], x[-2] = scale, -scale
    at, best = codes.assign(x, codes.Book(entries))
    exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == exact.min(axis=1)).all() and (at == exact.argmin(axis=1)).all()


def plain_codes(rows, parts, entries, rounds):
    """rows: (vec_id, label, vector), those that take part."""
    x = np.floor(1024 * np.array([v for _, _, v in rows])).astype(np.int64)
    wide = x.shape[1] // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].tolist()))[:entries]
    out, books = [], []
    for p in range(parts):
        own = x[:, p * wide : (p + 1) * wide]
        book = own[order].copy()
        for r in range(rounds + 1):
            d = ((own[:, None] - book[None]) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            if r < rounds:
                for e in range(len(book)):
                    if (at == e).any():
                        book[e] = own[at == e].sum(axis=0) // (at == e).sum()
        out.append((at, d.min(axis=1)))
        books.append(book)
    return np.stack([a for a, _ in out], axis=1), sum(d for _, d in out), books


def test_codes_equal_the_definition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 8)).round(3)
    x[100:140] = x[3]
    fine = [(int(i), int(i) % 3 if i % 7 else None, v.tolist()) for i, v in enumerate(x)]
    fine += [(4, 1, x[9].tolist()), (4, 1, x[8].tolist()), (None, 2, x[7].tolist()), (4, 1, x[9].tolist())]
    odd = [(600, 1, None), (601, 1, [None] * 8), (602, 1, [math.nan] * 8), (603, 1, [math.inf] + [0.0] * 7), (604, 1, [1.0] * 4), (605, 1, [])]
    df = spark.createDataFrame([(i, c, v, "x", 1, "y") for i, c, v in fine + odd], "vec_id long, label int, embedding array<double>, x string, code int, part string")
    rows, books = codes.compressed(df.repartition(4), entries=20, rounds=3)
    code, error, want = plain_codes(fine, 4, 20, 3)
    assert all((a == b).all() for a, b in zip(books, want))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2], r[3])
    assert sorted(((r.vec_id, r.label, tuple(r.code), r.error) for r in rows.collect()), key=key) == sorted(((i, c, tuple(k), e) for (i, c, _), k, e in zip(fine, code.tolist(), error.tolist())), key=key)


def test_codes_of_few_and_of_odd_vectors(spark):
    kind = "vec_id long, label int, embedding array<double>"
    rows, books = codes.compressed(spark.createDataFrame([], kind))
    assert rows.count() == 0 and rows.columns == ["vec_id", "label", "code", "error"]
    rows, books = codes.compressed(spark.createDataFrame([(2, 1, [1.0, 2.0, 3.0, 4.0]), (1, 1, [0.0] * 4)], kind))
    assert sorted((r.vec_id, list(r.code), r.error) for r in rows.collect()) == [(1, [0] * 4, 0), (2, [1] * 4, 0)] and books[1].tolist() == [[0], [2048]]
    with pytest.raises(ValueError, match="equal parts"):
        codes.compressed(spark.createDataFrame([(2, 1, [1.0, 2.0])], kind))
    with pytest.raises(Exception, match="beyond"):
        codes.compressed(spark.createDataFrame([(2, 1, [1e30] * 4)], kind))


@pytest.mark.parametrize("name", ["op11_prefix_tree", "op12_sorted_counts", "op13_segment_mean_codes"])
def test_queries_equal_their_sql(spark, duck, name):
    d = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "embeddings"):
        duck.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = QUERIES[name](spark, d)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    want = duck.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
