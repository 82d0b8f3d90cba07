"""Text operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from joust.llm import chat, decontam, html, quality, simhash, suffixes
from joust.llm.common import components

DOCS = "doc_id long, text string"


def frame(spark, texts, extra=True):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"{DOCS}, key string")
    return df.withColumn("n", F.lit(1)).withColumn("span", F.lit("s")) if extra else df


# simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


TEXTS = ["", None, "One", "a b c d e f", "É é \u00a0 b", "A  b\tC\nd " * 300, "a b c d e g", "a b c d e f", " \n "]


def test_fingerprints_equal_the_definition():
    for t in TEXTS:
        assert simhash.fingerprint(t.encode() if t is not None else None) % 2**64 == plain_fingerprint(t)


def test_components_of_copies_and_near_copies(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(5)]
    texts = TEXTS + [b + " tail" * k for b in base for k in range(4)] + base + ["", None]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    fp = [plain_fingerprint(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        comp = [min(comp[j] for j in range(len(texts)) if bin(fp[i] ^ fp[j]).count("1") <= 4) for i in range(len(texts))]
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(45)] + [(i, i + 1) for i in range(100, 120)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        return x if top[x] == x else find(top[x])

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    assert dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()) == {x: find(x) for x in [*top]}


def brute_similar(texts, width=5, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    alike = lambda x, y: x == y or len(x & y) >= least * len(x | y)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(comp[i], comp[j])
            changed |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    return comp


def test_similar_texts_and_what_stays(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(6)]
    near_by = lambda b, n: " ".join(w if k % (120 // n) else "other" for k, w in enumerate(b))
    texts = ["", None, "One", "one", "a b c d e f", "a b c d e g", " ".join(base[0]), *(" ".join(b) for b in base), *(near_by(b, 2) for b in base), *(near_by(b, 20) for b in base), "A  b c d e f"]
    want = brute_similar(texts)
    df = frame(spark, texts).withColumn("comp", F.lit("c"))
    kept = simhash.stage(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, c in enumerate(want) if c == i]
    assert simhash.stage(spark, df.limit(0), "").count() == 0
    # rows that share an id, have none, or are equal: one row of a class, by id, none last
    rows = [(1, "same text here"), (1, "same text here"), (None, "same text here"), (None, "same text here"), (None, "alone"), (None, "alone"), (2, "alone again"), (2, "another one")]
    got = sorted((repr(r.doc_id), r.text) for r in simhash.stage(spark, spark.createDataFrame(rows, DOCS), "").collect())
    assert got == sorted([("1", "same text here"), ("None", "alone"), ("2", "alone again"), ("2", "another one")])


def test_near_copies_too_far_from_each_other_are_not_compared_in_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]

    def copy(changes):
        words = base[:]
        for i in rng.sample(range(150), changes):
            words[i] = f"x{rng.random()}"
        return " ".join(words)

    texts = list(dict.fromkeys([" ".join(base), *(copy(rng.choice([1, 2, 4, 5])) for _ in range(150)), "", " ", "\n"]))
    compared, plain = [], simhash.verified

    def verified(docs, pairs, *more):
        compared.append(pairs.count())
        return plain(docs, pairs, *more)

    monkeypatch.setattr(simhash, "verified", verified)
    monkeypatch.setattr(simhash, "CROWD", 3)
    few = {r.k: r.comp for r in simhash.similar(frame(spark, texts)).collect()}
    pairs, compared[:] = sum(compared), []
    monkeypatch.setattr(simhash, "CROWD", 1 << 30)  # every pair of a key
    every = {r.k: r.comp for r in simhash.similar(frame(spark, texts)).collect()}
    assert pairs * 2 < sum(compared)
    # no link that pairs show is lost
    assert {*every} <= {*few} and all(few[k] == few[c] for k, c in every.items())
    keys = {t: k for t, k in spark.createDataFrame([(t,) for t in texts], "text string").select("text", simhash.text_key("text")).collect()}
    want = brute_similar(texts)
    for i, a in enumerate(texts):
        for j in range(i):
            both = few.get(keys[a]) is not None and few.get(keys[a]) == few.get(keys[texts[j]])
            assert not both or want[i] == want[j]


def test_long_fingerprints_equal_the_definition():
    for t in TEXTS:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        grams = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        got = simhash.long_fingerprint(t.encode() if t is not None else None, 5, 3)
        assert got[0] % 2**64 == simhash.majority(np.array([((h ^ h >> 31) * 0xBF58476D1CE4E5B9 % 2**64) ^ ((h ^ h >> 31) * 0xBF58476D1CE4E5B9 % 2**64) >> 29 for h in hs], np.uint64)) % 2**64
        assert len(got) == 3 and (not hs or len(set(got)) == 3)


def test_components_that_are_not_done_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), "a", "b", most_rounds=1)


# repeated byte strings


def brute_cuts(docs, length):
    seen, out = set(), {}
    for i, text in docs:
        b = (text or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                hit[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out[i] = (len(b), sum(hit), sum(hit[k] > (hit[k - 1] if k else 0) for k in range(len(hit))), hashlib.sha256(kept).hexdigest())
    return out


def test_removal_equals_brute_force(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = ["", None, "short", passage, "x" + passage[40:] + "y", passage, "are " * 90, "z" * 400, "zz" * 260, passage[:99], passage[:100], "é" * 130 + passage, "ab" * 30 + passage[10:150] + "ab" * 60]
    texts += ["".join(rng.choice("abcdefgh ") for _ in range(50)) + passage[rng.randint(0, 150) :] for _ in range(6)]
    df = frame(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(df).collect()}
    assert got == brute_cuts(list(enumerate(texts)), 100)
    doubled = suffixes.remove_repeats(df.unionAll(df)).collect()
    assert len(doubled) == 2 * len(texts) and {(r.doc_id, *tuple(r)[1:]) for r in doubled} == {(k, *v) for k, v in got.items()}
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(df, keep_text=True).collect()}
    assert all(hashlib.sha256(kept[k]).hexdigest() == v[3] for k, v in got.items())


def test_rows_that_share_an_id_or_have_none_are_documents_of_their_own(spark):
    rng = random.Random(6)
    b, c, d = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(0, b), (None, "other"), (None, b[:150] + "x"), (0, c), (None, c + "tail"), (None, c), (7, d), (7, d[100:] + "end"), (7, d), (8, d[:120])]
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    of = {t: i for i, t in enumerate(sorted({t for _, t in rows}))}
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in of], "t string").select("t", F.xxhash64(F.col("t").cast("binary")).alias("h")).collect()}
    # in order of the definition: rows without an id by hash, then ids, equal ids by hash; equal rows are one document
    order = sorted({(i is not None, i or 0, hashes[t] if i is not None else hashes[t] & ((1 << 61) - 1), t) for i, t in rows})
    cuts = brute_cuts([((o[0], o[1], o[3]), o[3]) for o in order], 100)
    want = sorted((repr(i), *(cuts[(i is not None, i or 0, t)][k] for k in (0, 1, 3))) for i, t in rows)
    assert got == want and sum(w[2] for w in want) > 500


@pytest.mark.parametrize("seed", range(8))
def test_interval_expansion_equals_brute_force(seed):
    rng = random.Random(seed)
    length = rng.choice([3, 8, 100])
    base = [bytes(rng.choice(b"ab" if seed % 2 else b"abcdef") for _ in range(rng.randint(0, 200))) for _ in range(3)]
    strings = [b[rng.randint(0, len(b)) :] + bytes(rng.choice(b"abz") for _ in range(rng.randint(0, 20))) for b in base * 3]
    places = [(rng.randint(0, 3), i * 1000) for i in range(len(strings))]
    first, want = {}, set()
    for d, p, k, o in sorted((d, s + o, k, o) for k, (d, s) in enumerate(places) for o in range(len(strings[k]) - length + 1)):
        w = strings[k][o : o + length]
        if first.setdefault(w, (d, p)) != (d, p):
            want.add((k, o))
    assert {(k, o) for k, a, z in suffixes.repeats(strings, places, length) for o in range(a, z - length + 1)} == want


# quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        e, tie = rng.normal(size=n), 0.7
        weights = {}
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            weights[code] = np.exp(sum((v - 0.5) * x for v, x in zip(y, e)) + tie * sum(a == b for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        want = [sum(w for c, w in weights.items() if c >> i & 1) / z for i in range(n)]
        good, same, log_z = quality.marginals(np.concatenate([e, e]), np.array([n, n]), tie)
        assert good[:n] == pytest.approx(want) and log_z[0] == pytest.approx(np.log(z))
        if n > 1:
            assert same[1] == pytest.approx(sum(w for c, w in weights.items() if (c & 1) == (c >> 1 & 1)) / z)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    field = quality.trained(docs, labels)
    test = quality.scored(docs.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("doc_id", "text", "quality"), field).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in test)
    assert np.mean([(r.score >= 0.7) == r.quality for r in test]) > 0.95


def test_scores_of_odd_rows(spark):
    field = quality.fit([b"good text here.\nmore of it."] * 5 + [b"BAD!! BAD!!\n|||| %%%"] * 5, [1] * 5 + [0] * 5)
    got = quality.scored(frame(spark, ["", None, "\n\n\n", "word " * 60000]).withColumn("score", F.lit("old")), field).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(frame(spark, []), field).count() == 0
    assert {r.score for r in quality.scored(frame(spark, ["a", "b"]), quality.fit([b"x"], [1])).collect()} == {0.5}


# decontamination

ITEM = "Yesterday the farmer Miller sold 12 kg of apples and 30 kg of pears to the old market of Paris for 45 euros in all."
OTHER = ITEM.replace("Miller", "Smith").replace("12", "7").replace("30", "19").replace("45", "88").replace("Paris", "London")


def leaks(spark, texts, items):
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, shift int")
    return {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, texts).withColumn("shift", F.lit(1)), bench).collect()}


def test_templates_catch_other_values_and_check_slots(spark):
    pad = "we saw that " * 7
    # two values may become one, one value may not become two
    same = OTHER.replace("19", "7")
    twice = ITEM.replace("30 kg", "12 kg")
    texts = [pad + ITEM + pad, pad + OTHER, pad, "", None, pad + same, ITEM, (pad * 400) + ITEM.replace(" ", "\n"), pad + ITEM.replace("12 kg", "7kg"), OTHER]
    assert leaks(spark, texts, [ITEM, "", None]) == {(0, 0), (1, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0)}
    assert leaks(spark, [pad + same, pad + OTHER, twice], [twice]) == {(0, 0), (2, 0)}
    assert leaks(spark, [], [ITEM]) == set() == leaks(spark, [ITEM], [])


def test_rows_without_an_id_are_judged_by_their_text(spark, tmp_path):
    spark.createDataFrame([(0, ITEM), (None, "green ideas sleep so furiously every day")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, ITEM, 1), (None, "clean words only here", 2), (1, ITEM, 3), (1, "clean", 4), (2, None, 5), (3, "", 6), (None, "so green ideas sleep so furiously every day", 7)], f"{DOCS}, k int")
    assert {r.k for r in decontam.stage(spark, docs, str(tmp_path)).collect()} == {2, 4, 5, 6}
    assert decontam.stage(spark, docs, str(tmp_path)).columns == docs.columns
    got = decontam.leaks(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(None, 0), (1, 0), (None, None)}


NAMES, THINGS = ("Miller", "Smith", "Mary Ann", "Jones", "Berlin", "New York", "Oslo"), ("kg", "km", "euros", "hours", "miles")


def brute_words(line):
    """Template words and slot values by plain rules: numbers, units after numbers, names that begin no sentence."""
    words, values, before = [], [], "."
    raw = [x for w in line.split() for x in ([w[:-2], "kg"] if w[:1].isdigit() and w.endswith("kg") else [w])]
    for w in raw:
        bare = w.strip(".,")
        kind = "<n>" if bare.isdigit() else "<u>" if bare in THINGS and words and words[-1] == "<n>" and before[-1].isdigit() else "<c>" if bare[0].isupper() and before[-1] != "." else bare.lower()
        if kind == "<c>" and words and words[-1] == "<c>" and before[-1].isalpha():
            values[-1] += " " + bare
        else:
            words.append(kind)
            values.append(bare)
        before = w
    return words, values


def brute_match(item, text):
    (iw, iv), (dw, dv) = brute_words(item), brute_words(text)
    need = math.ceil(0.8 * len(iw))
    fine = lambda pairs: len({*pairs}) == len({a for a, _ in pairs})
    for shift in range(-len(iw), len(dw) + 1):
        hits = [i for i in range(len(iw)) if 0 <= i + shift < len(dw) and iw[i] == dw[i + shift]]
        if len(hits) >= need and fine([(iv[i], dv[i + shift]) for i in hits if iw[i][0] == "<"]):
            return True
    return False


def test_re_parameterised_items_equal_plain_matching(spark):
    rng = random.Random(8)
    common = "the of to and sold went from with for his old red big near house tree road week day".split()
    made = lambda: [rng.choice(["{n}", "{n} {u}", "{c}", *common, *common]) for _ in range(rng.randint(16, 30))]

    def filled(shape, slots):
        out = ["then"]
        for i, w in enumerate(shape):
            out.append(w.format(n=slots[i][0], u=slots[i][1], c=slots[i][2]))
        return " ".join(out) + "."

    def slots(n):
        return [(str(rng.randint(2, 900)), rng.choice(THINGS), rng.choice(NAMES)) for _ in range(n)]

    items, texts, want = [], [], set()
    for _ in range(40):
        shape = made()
        a = slots(len(shape))
        items.append(filled(shape, a))
        new = {}
        b = [tuple(new.setdefault(v, rng.choice(NAMES) if k == 2 else str(rng.randint(2, 900)) if k == 0 else rng.choice(THINGS)) for k, v in enumerate(s)) for s in a]
        for other in (b, slots(len(shape)), a):
            changed = [rng.choice(common) if rng.random() < 0.08 and w in common else w for w in shape]
            texts.append(" ".join(rng.choice(common) for _ in range(rng.randint(0, 6))) + " so " + filled(changed, other).replace("then", "then", 1) + " And so on")
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if brute_match(x, t)}
    got = leaks(spark, texts, items)
    # alignments with words put in or left out may add to what one shift finds
    assert want <= got and len(want) > 60 and all(i == d // 3 for d, i in got) and len(got) <= len(want) + 6


def test_short_items_are_found_at_any_word(spark):
    texts = [("word " * k) + "green ideas sleep so furiously today" for k in range(6)] + ["green ideas sleep"]
    assert leaks(spark, texts, ["green ideas sleep so furiously"]) == {(k, 0) for k in range(6)}


def test_scattered_changes_are_found_at_any_word(spark):
    lengths, items, texts, want = (5, 6, 7, 10, 16, 24, 25, 40, 59), [], [], set()
    for i, n in enumerate(lengths):
        words = [f"{chr(97 + i)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)]
        items.append(" ".join(words))
        for every in (5, 6, 8):
            for pad in range(4):
                if n // every <= n - math.ceil(0.8 * n):
                    want.add((len(texts), i))
                texts.append("pad " * pad + " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(words)) + " end")
    assert len(want) > 80 and leaks(spark, texts, items) == want


def test_words_put_in_or_left_out_and_longer_names_are_found(spark):
    words = [chr(97 + k) * 3 for k in range(24)]
    plain = " ".join(words)
    city = "one morning in early spring the old train to Paris left on time with many people who had been waiting there since 5"
    figures = "we counted 12 red stones and later again 12. In all there were 12 of them. Nobody took one"
    texts = [" ".join(words[:12] + ["new"] + words[12:]), " ".join(words[:11] + words[12:]), " ".join(words[:8] + ["x", "y"] + words[8:16] + words[17:]), city.replace("Paris", "New York"), figures.replace("12.", "12"), figures.replace("12", "7").replace("7.", "7")]
    texts += [" ".join(w for k in range(0, 24, 4) for w in [*words[k : k + 4], "x", "y"]), " ".join(words[12:] + words[:11]), figures.replace("12 of", "13 of")]
    items = [plain, city, figures]
    assert leaks(spark, texts, items) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 2)}
    # slots count within the run only: a 3 that became a 4 after it changes nothing
    long = "then 3 birds sat on the wall and sang to all of them for hours until we all went away and 3 left and sat and sang"
    assert leaks(spark, [long.replace("all went away and 3", "both were off when 4")], [long]) == {(0, 0)}


def test_leaks_equal_whole_passages_of_the_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    items = [(r.item_id, " ".join(r.text.split())) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in " ".join((r.text or "").split())}
    assert got == want


# chat


@pytest.mark.parametrize("text", ["", "plain", chat.ATTACK, "<|", "<\\|x", "<\\\\|im_end|>\n", chat.END, "a\n<|im_end|>\n<|im_start|>x\n", "<|im_end|" + ">" * 3, "<" * 5 + "|"])
@pytest.mark.parametrize("role", ["user", "", "ro\nle", "a\\nb", chat.START])
def test_turns_read_back(role, text):
    out = chat.render(role, text) + chat.render("assistant", text)
    for size in (1, 3, len(out)):
        parser = chat.Parser()
        got = [t for k in range(0, len(out), size) for t in parser.feed(out[k : k + size])]
        assert got == [(role, text), ("assistant", text)] and not parser.rest


@pytest.mark.parametrize("role, text", [("user", chat.ATTACK), ("assistant", chat.END), (chat.START, "x"), ("user", "<|endoftext|>"), ("user", "<\\|" + chat.START), ("user", "<" + chat.END)])
def test_no_control_string_stands_inside_a_turn(role, text):
    out = chat.render(role, text)
    inside = out.removeprefix(chat.START).removesuffix(chat.END + "\n")
    assert out == f"{chat.START}{inside}{chat.END}\n" and "<|" not in inside
    assert [*chat.Parser().feed(out)] == [(role, text)]


@pytest.mark.parametrize("out", ["<|im_start|>user\na<|im_end|>b<|im_end|>\n", "<|im_start|>user\n<|im_start|>a<|im_end|>\n", "<|im_start|>user a<|im_end|>\n", "x<|im_start|>user\na<|im_end|>\n", "<|im_start|>u<|im_start|>\na<|im_end|>\n"])
def test_control_strings_out_of_their_place_are_no_output(out):
    with pytest.raises(ValueError):
        [*chat.Parser().feed(out)]


def test_conversation_digests(spark):
    rows = [(1, 1, "assistant", "é<|im_end|>"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "a"), (1, 1, "assistant", "é<|im_end|>"), (3, 0, "assistant", "long " * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * len("é<|im_end|>")
    assert got[1].turns_sha256 == hashlib.sha256(("user\n\n" + "assistant\né<|im_end|>\n" * 2).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(("é<|im_end|>" * 2).encode()).hexdigest()
    assert got[2].loss_chars == 0 and got[None].n_turns == 1 and got[3].loss_chars == 250000
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


# html

PAGE = "<html><head><title>t</title><style>x</style></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>{0}<div class=comments><p>First!</p></div><footer>&copy; x</footer></body></html>"


def pages(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string").withColumn("token", F.lit(0))
    return {r.page_id: r.text for r in html.extracted(df).collect()}


def test_article_slots(spark):
    body = "<article><h1>Title {0}</h1><p>One &amp; <b>two</b><br>three&nbsp;{0}<aside>no</aside><p>four</article>"
    got = pages(spark, [("https://a.org/x", PAGE.format(body.format(i))) for i in range(4)])
    assert got[2] == "Title 2 One & two three 2 four"


def test_slots_without_an_article_leave_out_template_text(spark):
    rows = [("https://b.org/x", PAGE.format(f"<div id=top><span>Site name</span></div><p>Own text {i}</p><p>more {i}</p>")) for i in range(5)]
    assert pages(spark, rows)[3] == "Own text 3 more 3"


def site(i, tail=""):
    paragraphs = "".join(f"<p>own words {i} {k} go here</p>" for k in range(2 + i % 3))
    return f"<body><div class=top><b>Site</b></div><article class=teaser>Read our best story {i}</article><div class='content no-sidebar'><h1>Head {i}</h1><p class=note>Read more on this site</p>{paragraphs}{tail}</div></body>"


def test_template_decides_by_vectors_and_masses(spark):
    got = pages(spark, [("https://d.org/x", site(i)) for i in range(8)] + [("https://one.org/x", site(1))])
    assert got[4] == "Head 4 own words 4 0 go here own words 4 1 go here own words 4 2 go here"
    # without a template of its host the site's line stays
    assert got[8] == "Head 1 Read more on this site own words 1 0 go here own words 1 1 go here own words 1 2 go here"


def test_a_page_of_its_own_follows_the_template_of_its_host(spark):
    long = "<div class=replies-wide><p>" + "other people said much about it " * 20 + "</p></div>"
    rows = [("https://e.org/x", site(i, long if i == 7 else "")) for i in range(9)] + [("https://f.org/x", site(7, "").replace("content", "story") + long)]
    got = pages(spark, rows)
    assert "other people" not in got[7] and got[7].startswith("Head 7 own words 7 0")


def plain_templates(htmls):
    """Occurrence vectors as explicit lists -> (container token, constants)."""
    trees = [html.Tree(h) for h in htmls]
    vectors, around, kinds, chars, depth = {}, {}, {}, {}, {0: 0}
    for i, t in enumerate(trees):
        weight = t.weights()
        for k, token in enumerate(t.token):
            vectors.setdefault(token, [0] * len(trees))[i] += 1
            up = t.token[t.parent[k]] if k else 0
            around[token], kinds[token], depth[token] = up, t.kind[k], depth[up] + bool(k)
        for k, text in t.blocks:
            token = (t.token[k], text)
            vectors.setdefault(token, [0] * len(trees))[i] += 1
            around[token], kinds[token] = t.token[k], "text"
            if not t.link[k]:
                chars[token] = chars.get(token, 0) + weight[k] * len(text)
    if len(set(htmls)) < 3:
        return None, set()
    often = {t for t, v in vectors.items() if sum(n > 0 for n in v) >= max(3, len(trees) / 2)}
    valid = {0}
    for t in sorted((t for t in often if kinds[t] != "text"), key=depth.get):
        if around[t] in valid:
            valid.add(t)
    fixed = {t for t in often if kinds[t] == "text" and sum(n > 0 for n in vectors[t]) >= 5 and around[t] in valid and vectors[t] in (vectors[0], vectors[around[t]])}
    mass = dict.fromkeys(valid, 0.0)
    for t, n in chars.items():
        up = t[0]
        if t not in fixed and up in valid:
            while True:
                mass[up] += n
                if not up:
                    break
                up = around[up]
    at, chain = 0, [0]
    while mass[at] and not any(kinds[t] == html.HEADING and mass[t] for t in valid if t and around[t] == at):
        inner = [t for t in valid if t and around[t] == at and kinds[t] in (html.BOX, html.MAIN)]
        if not inner or mass[max(inner, key=mass.get)] < 0.5 * mass[at]:
            break
        at = max(inner, key=mass.get)
        chain.append(at)
    return next((t for t in reversed(chain) if kinds[t] == html.MAIN), at), fixed


def test_templates_equal_plain_vectors(spark):
    rng = random.Random(5)
    made = [("https://g.org/x", site(i)) for i in range(6)] + [("https://h.org/", site(0))] * 4
    for _ in range(30):
        parts = [f"<div class={c}>{'<p>' + rng.choice(['same', 'x ' * rng.randint(1, 40)]) + '</p>'}</div>" for c in ("ad", "text", "more") if rng.random() < 0.9]
        made.append(("https://k.org/", "<body>" + "".join(parts) + "<footer>all rights</footer>"))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(made)] + [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()], "page_id long, url string, html string")
    from joust.llm.urls import parsed

    split = parsed(df.selectExpr("page_id __page", "url __link", "html __html"), "__link").withColumn("h", F.xxhash64("__host"))
    groups = {}
    for r in split.collect():
        groups.setdefault(r.h, []).append(r["__html"])
    known = {r["__of"]: (r["__container"], set(r["__fixed"])) for r in html.templates(split).collect()}
    for h, htmls in groups.items():
        box, fixed = plain_templates(htmls)
        assert known.get(h, (None, set())) == (box if box is None else html.signed(box), {html.signed(html.text_token(*t)) for t in fixed})
    assert len(known) > 1


@pytest.mark.parametrize("text", ["<a " * 200000, "<a '" * 50000 + ">", "<b>" * 20000 + "<hr>" * 20000, "<div>" * 20000 + "</x>" * 20000, "<script>" + "</script " * 100000, "<!" * 100000, "<!--" * 100000])
def test_the_scanner_is_linear(text):
    import time

    began = time.process_time()
    html.main_text(text, None, ())
    assert time.process_time() - began < 5


@pytest.mark.parametrize("text, want", [("<p>1 < 2 <3 & <b>x", "1 < 2 <3 & x"), ("a<!--> b", "a b"), ("a <p title='x>y'>b", "a b"), ("a <p title='x>b", "a b"), ("a<p/>b</p>c", "a b c"), ("<P CLASS=Ad>no</P>yes", "yes"), ("<div hidden>no</div>yes", "yes")])
def test_markup_that_does_not_end(text, want):
    assert html.main_text(text, None, ()) == want


def test_odd_pages(spark):
    got = pages(spark, [(None, None), ("x", ""), ("https://c.org/", "no <b>markup"), ("https://c.org/", "<p>a<p>b</i></p><!-- x"), ("https://c.org/", "<script>if (a<b) x()"), ("https://c.org/", "<p>w</p>" * 20000)])
    assert (got[0], got[1], got[2], got[3], got[4]) == ("", "", "no markup", "a b", "") and len(got[5]) == 39999
    assert pages(spark, []) == {}


@pytest.mark.parametrize(
    "item, text, found",
    [
        ("Alice had 7 apples.", "Bob had 9 apples.", True),
        ("Alice had 7 apples.", "Some words first. Bob had 9 apples. And more.", True),
        ("Alice had 7 apples.", "There Bob had 9 apples in all", True),
        ("Alice gave Alice 7 apples and 7 pears to carry home", "Bob gave Tom 9 apples and 9 pears to carry home", False),
        ("Tom had seven apples and three pears in the bag", "Ann had 12 apples and twenty-one pears in the bag", True),
        ("Tom had seven apples and seven pears in the bag", "Ann had 12 apples and two pears in the bag", False),
        ("he had 7 apples in his bag and ate two", "she sold nine horses at her farm before noon", False),
    ],
)
def test_names_at_the_start_and_spelled_numbers_are_slots(spark, item, text, found):
    got = decontam.leaks(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert bool(got.collect()) == found


def test_single_spaces_are_no_match_and_templates_stay_the_same(spark):
    assert not re.search(decontam.BLANK, "a b c") and re.sub(decontam.BLANK, " ", "\t a \n\n b  c\r") == " a b c "
    texts = ["5 km, 6km 7", "<n> <n> m 3 kg.", "'Ann (Bob \"Carl d'Eve ÉLan Élan", "a\tb\n\n x<n> mm 12 mm"]
    df = spark.createDataFrame([*enumerate(texts)], "i int, text string")
    got = [" ".join(r[0]) for r in decontam.with_words(df, "text").orderBy("i").select("__words").collect()]
    assert got == ["<n> <u> <n> <u> <n>", "<n> <u> <n> <u>", "ann bob carl deve élan <c>", "a b x<n> <u> <n> <u>"]


def test_templates_of_capitals_and_spelled_numbers(spark):
    cases = {"Bob had seven apples": "<c> had <n> apples", "the one-eyed often won a tenth": "the oneeyed often won a tenth", "Twenty-one men, two": "<n> men <n>", "two three men": "<n> <m> men", "O'Neil (Ann) McX ÉTÉ Été I": "oneil <c>) mcx été <c> i"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", decontam.template(decontam.squeezed(F.col("t"))).alias("x")).collect()
    assert {r.t: r.x for r in rows}["Bob had seven apples"] == "<c> had <n> apples"
    assert {r.t: r.x for r in rows}["the one-eyed often won a tenth"] == "the oneeyed often won a tenth"
    assert {r.t: r.x for r in rows}["two three men"] == "<n> <m> men"


def test_words_of_a_text_are_computed_once_for_its_windows(spark):
    df = spark.createDataFrame([(1, "green ideas sleep"), (2, ""), (3, None)], "k long, text string")
    got = decontam.windows(decontam.with_words(df, "text"), [1, 2])
    # one split: no condition computes the words again
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted((r.k, r.here) for r in got.collect()) == [(1, 0), (1, 0), (1, 1), (1, 1), (1, 2), (2, 0), (3, 0)]
