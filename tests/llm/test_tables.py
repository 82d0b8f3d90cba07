"""Table operators: mixing, urls, neighbours, training order, the pipeline."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from joust.llm import mixing, neighbours, order, queries, urls

SF = "/root/testdata/sf0.001"


# mixing


def brute_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        goal = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = {s for s in rest if goal[s] > cap * sizes[s]}
        if not over:
            return goal | {s: cap * sizes[s] for s in full}
        full |= over


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("mine")).withColumn("rank", F.lit(0))
    return mixing.mix(df, F.col("size")).collect()


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_words_taken(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "é", "z", None, ""]
    rows = [(i, rng.choices(names, [50, 5, 1, 20, 3, 1])[0], rng.choice([0, 1, 5, 20, 100, 100])) for i in range(1500)]
    got = mixed(spark, rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0]["__target"] == pytest.approx(want[s]) and all(0 <= r["__copies"] <= 3 for r in own)
        assert abs(sum(r["__copies"] * r["size"] for r in own) - want[s]) <= max(r["size"] for r in own) + 1e-6
    again = mixed(spark, rows[::-1])
    assert {(r.doc_id, r["__copies"]) for r in got} == {(r.doc_id, r["__copies"]) for r in again} and got[0].target == "mine"


def test_mixing_of_empty_and_repeated_rows(spark):
    assert mixed(spark, []) == [] and all(r["__copies"] in (0, 1, 2, 3) for r in mixed(spark, [(1, "a", 0)] * 3 + [(None, None, 0)]))
    same = mixed(spark, [(1, "a", 7)] * 100 + [(2, "b", 7)] * 100)
    assert sum(r["__copies"] for r in same if r.source == "b") in (133, 134)


# urls

URLS = [
    ("HTTP://Sub.Example.ORG:80/a", "sub.example.org:80", "/a", None), ("x://example.org/es/q?x=1", "example.org", "/es/q", "example.org/es/"), ("x://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("x://a.example.org/de/", "a.example.org", "/de/", "org/"), ("x://notexample.com/de/1#t", "notexample.com", "/de/1", "com/de/"), ("x://org", "org", "", None), ("x://a.b.com?/fr/", "a.b.com", "", None),
    ("nothing", "", "", None), (None, "", "", None), ("", "", "", None), ("x://", "", "", None), ("x://É.com/fr/", "É.com", "/fr/", "com/fr/"), ("a://b://c/d", "b:", "//c/d", None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, r[0], "h", 1) for i, r in enumerate(URLS)], "page_id long, url string, host string, features int")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(URLS))] == [r[1:] for r in URLS]
    assert all(r.verdict in ("allow", "block") for r in got.values()) and got[1].verdict == "block" and got[3].verdict == "allow"
    assert urls.judge(df.limit(0)).count() == 0


def test_boosting_learns_lexical_labels(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        bad = rng.random() < 0.4
        rows.append((f"https://h{i}.net/" + ("".join(rng.choice("0123456789") for _ in range(25)) + "?a=1&b=2&c=3" if bad else "news/today"), int(bad)))
    x = urls.parsed(spark.createDataFrame(rows, "url string, __block int"))
    model = urls.fit(x.where(F.crc32(F.col("url").cast("binary")) % 2 == 0))
    test = x.where(F.crc32(F.col("url").cast("binary")) % 2 == 1).select("__block", (model.margin(urls.features(model.rates)) > 0).cast("int").alias("p")).collect()
    assert np.mean([r["__block"] == r.p for r in test]) > 0.95
    assert urls.fit(x.where("__block = 1")).trees == []


# neighbours


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(8, 16))[rng.integers(0, 8, 1500)]
    x[700:730] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [1.0] * 15 + [None]), (2060, [1.0] * 15 + [math.nan]), (2080, [1.0] * 3), (None, [1.0] * 16), (2100, [math.inf] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("c")).withColumn("score", F.lit(1)).withColumn("row", F.lit("r"))
    got = neighbours.search(df).collect()
    x = x.astype(np.float32).astype(np.float64)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 20))
    hits = []
    for q, found in by.items():
        s = (x * x[q]).sum(axis=1)
        assert all(abs(s[v] - sc) < 1e-12 and v != q for v, sc in found) and found == sorted(found, key=lambda t: (-t[1], t[0])) and len(found) == 20
        s[q] = -np.inf
        hits.append(len({v for v, _ in found} & set(np.lexsort((np.arange(1500), -s))[:20])) / 20)
    assert np.mean(hits) >= 0.9
    assert neighbours.search(df.limit(0)).count() == 0
    few = neighbours.search(spark.createDataFrame([(i, [float(i + 1)]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r.rank)] == [4, 3, 2, 1]


def test_vectors_that_share_an_id_are_vectors_of_their_own(spark):
    rows = [(20, [3.0, 1.0]), (20, [1.0, 1.0]), (20, [3.0, 1.0]), (5, [2.0, 2.0])]
    lists = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        lists.setdefault(r.query_row, []).append((r.rank, r.vec_id, r.score))
    assert sorted(sorted(x) for x in lists.values()) == [[(1, 5, 4.0), (2, 20, 4.0), (3, 20, 4.0)], [(1, 20, 10.0), (2, 5, 8.0), (3, 20, 4.0)], [(1, 20, 10.0), (2, 5, 8.0), (3, 20, 4.0)]]


def test_walk_visits_cells_by_summed_product():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=6), rng.normal(size=5)
    cells = neighbours.walk(a, b, np.ones(30, int), 30)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(30)) and sums == sorted(sums, reverse=True)
    assert len(neighbours.walk(a, b, np.ones(30, int), 7)) == 7


# training order


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_slots_are_a_permutation_with_an_inverse(n):
    s = order.slots(np.arange(n), n, key=9)
    assert sorted(s.tolist()) == list(range(n)) and (order.slots(s, n, key=9, back=True) == np.arange(n)).all()
    if n >= 1000:
        assert (order.slots(np.arange(n), n, key=10) != s).mean() > 0.9


def test_records_read_back_in_shards(spark, tmp_path):
    texts = ["", None, "short", "é long " * 3000, "same", "same"]
    df = spark.createDataFrame([(min(i, 4), t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("slot", F.lit(1))
    rows = order.training_order(df, length=64, records=7)
    got = rows.collect()
    enc = order.encoder(*order.vocabulary())
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert {(r.slot, r.doc_id, r.part) for r in order.training_order(df.repartition(5), length=64, records=7).collect()} == {(r.slot, r.doc_id, r.part) for r in got}
    docs = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.part)):
        docs.setdefault(r.doc_id, []).extend(order.tokens_of(bytes(r.record)).tolist())
    assert enc.decode([t for t in docs[3] if t != enc.n_vocab]) == texts[3] and docs[0] == docs[1] == [enc.n_vocab]
    stride = 4 + 2 * 64
    payloads = {s.shard: bytes(s.payload) for s in order.shards(rows).collect()}
    for r in got:
        assert payloads[r.shard][r.offset : r.offset + stride] == bytes(r.record)
    folder = f"{tmp_path}/shards"
    written = order.write_shards(rows, folder).collect()
    assert {r.shard: r.bytes for r in written} == {k: len(p) for k, p in payloads.items()} and sum(r.n_records for r in written) == len(got)
    order.write_shards(rows, folder)  # again: the same files
    assert sorted(f.name for f in tmp_path.joinpath("shards").iterdir() if f.suffix == ".bin" and f.name[0] != ".") == [order.shard_name(k) for k in sorted(payloads)]
    whole = [order.tokens_of(bytes(r.record)).tolist() for r in sorted(got, key=lambda r: r.slot)]
    for slot in (0, 1, 6, 7, len(got) - 1, len(got)):
        assert [t.tolist() for t in order.read_from(folder, slot, 64, 7)] == whole[slot:]
    assert order.training_order(df.limit(0)).count() == 0


# registered queries with SQL, and the pipeline


@pytest.mark.parametrize("name", [*queries.ORACLE_SQL])
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in "documents pages embeddings benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    tidy = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(tidy(r[k]) for k in sorted(names)) for r in df.collect()) == sorted(tuple(tidy(dict(zip(names, r))[k]) for k in sorted(names)) for r in cur.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    from joust.llm.common import stored
    from test_text import brute_similar

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        rows = docs.collect()
        kept.append({r.doc_id: r.text for r in rows})
        assert kept[-1].items() <= kept[-2].items()
    assert len(kept[1]) < len(kept[0])
    ids = sorted(kept[1])
    comp = brute_similar([kept[1][i] for i in ids])
    first = {i for k, i in enumerate(ids) if comp[k] == k}
    assert first <= set(kept[2]) and len(kept[2]) <= len(first) + 0.05 * (len(ids) - len(first))
    last = p.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(kept[4])


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.limit(3).selectExpr(*[f"cast(null as {t}) {c}" for c, t in docs.dtypes])
    both = docs.unionByName(docs.limit(5)).unionByName(odd).unionByName(docs.limit(2).withColumn("text", F.lit(""))).unionByName(docs.limit(4).withColumn("doc_id", F.lit(None).cast("bigint")))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    rows = p.run(spark, str(tmp_path)).collect()
    assert rows and sorted(r.slot for r in rows) == list(range(len(rows)))
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_columns_with_names_of_their_own_alone(spark, tmp_path):
    """Every name that a stage adds for itself, and some of its results' names, as columns of the caller."""
    from joust.llm import decontam, quality, simhash

    names = ["__id", "__k", "__key", "__score", "__size", "__source", "__copies", "__many", "__place", "k", "n", "id", "score", "size", "comp", "of", "best", "__at", "__block", "__target", "__KEY"]
    texts = [f"the quick brown fox number {i} jumps over the lazy dog near river {i * 7}" for i in range(12)] + ["same words in one text again and again"] * 3 + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        if n.lower() not in {c.lower() for c in docs.columns}:
            docs = docs.withColumn(n, F.concat(F.lit("mine "), F.col("doc_id").cast("string")))
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "the quick brown fox number 3 jumps over the lazy dog near river 21")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for stage in (quality.stage, simhash.stage, decontam.stage, mixing.stage):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        rows = got.collect()
        assert all(r[c] == f"mine {r.doc_id}" for r in rows for c in own)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_mixing_stage_takes_what_the_mix_takes_of_equal_rows_too(spark):
    rows = [(i % 40, f"w{i % 40} " * (1 + i % 5), "abc"[i % 3] if i % 7 else None) for i in range(120)] + [(None, "x y", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {}
    for r in mixing.mix(docs.withColumn("k", F.xxhash64("text")), mixing.words(F.col("text"))).collect():
        want[(r.doc_id, r.text, r.source)] = want.get((r.doc_id, r.text, r.source), 0) + r["__copies"]
    got = {}
    for r in mixing.stage(spark, docs.repartition(3), "").collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == {k: v for k, v in want.items() if v}
