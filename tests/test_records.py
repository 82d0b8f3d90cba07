"""Parsing, design and the record store."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from joust.functions import text as T
from joust.operators import design as G
from conftest import spec_entities
from joust.operators.choices import from_records
from joust.schemas import FIELDS
from joust.sources import batches
from joust.sources import lines as L
from joust.sources import records as S
from joust.streaming import ingest

#: (answer, options, position, refused)
LETTER = [
    ("D", 4, 4, False), ("c", 4, 3, False), ("  *A*  ", 2, 1, False), ("B )", 2, 2, False), ("choice: ** d **", 4, 4, False), ("Option C fits best", 3, 3, False), ("none of A, B", 2, 1, False), ("D", 3, None, False), ("choice = E", 3, None, False),
    ("I CANNOT say", 3, None, True), ("as an AI I hold no opinion", 3, None, True), ("I do not have desires", 2, None, True), ("I refuse", 2, None, False), ("as an AI model", 2, None, False), ("I do not have preferences; B", 2, 2, False), (None, 3, None, True),
]


def test_letters(spark):
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(LETTER)], "i int, raw string, n int").withColumn("x", T.letter_answer(F.col("raw"), F.col("n"))).orderBy("i").collect()
    assert [(r.x.position, r.x.refusal) for r in df] == [r[2:] for r in LETTER]
    assert [r.x.parse_failed for r in df] == [r[2] is None for r in LETTER]


def test_numbers_and_thoughts(spark):
    rows = [("answer=2", 2.0, False), ("7", 7.0, False), ('say "response" : 1 please', 1.0, False), ("between 0 and 5", 5.0, False), ("ANSWER: 9, or 3", None, False), ("-3", None, False), ("nothing", None, False), ("As an AI, I don't rate", None, True), (None, None, True)]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, raw string").withColumn("x", T.number_answer(F.col("raw"), 1, 7)).orderBy("i").collect()
    assert [(r.x.rating, r.x.refusal) for r in got] == [v[1:] for v in rows]
    r = spark.createDataFrame([("<THINK>a\nb</think>\n 7 ",), ("x</think>",)], "raw string").select(T.without_thoughts(F.col("raw")).alias("x")).collect()
    assert [tuple(x.x) for x in r] == [("7", True), ("x</think>", False)]


def test_hashes_equal_hashlib(spark):
    import hashlib

    r = spark.range(1).select(T.prompt_hash(F.lit("s"), F.lit("u")).alias("h"), T.cell_seed(7, F.lit("x"), F.lit("y")).alias("s"), T.cell_key(F.lit("x"), F.lit(""), F.lit(3)).alias("k"), T.hash_mod(F.lit("su"), F.lit(3)).alias("m")).first()
    assert r.h == hashlib.sha256(b"s\0u").hexdigest()[:16]
    assert r.s == 7 + int(hashlib.sha256(b"x|y").hexdigest(), 16) % 100000
    assert r.k == hashlib.sha1(b"x||3").hexdigest()[:20]
    assert r.m == int(hashlib.sha256(b"su").hexdigest(), 16) % 3


def test_a_missing_key_part_fails(spark, tmp_path):
    with pytest.raises(Exception, match="part 2 of a cell key is missing"):
        spark.range(1).select(T.cell_key(F.lit("x"), F.lit(None).cast("string"))).collect()
    with pytest.raises(Exception, match="is missing"):
        S.read_records(spark, write(tmp_path / "a.jsonl", [line(item_id=None)])).select(S.record_key()).collect()


def test_keys_of_cells_and_of_their_records_are_the_same(spark):
    cells = G.rendered(G.keyed(G.grid(spark.createDataFrame([("M",)], "model string"), G.all_pairs(spec_entities(spark, 3)))))
    specs = spark.createDataFrame([("M", "r", "f", "g", "2024-01-01", "instruct", "none", None, "hf", True, "none", False, 0.7)], "model string, ref string, family string, generation string, released string, kind string, quant_format string, quant string, backend string, in_window boolean, reasoning_control string, thinks_by_default boolean, temperature double")
    from joust.operators import administer as A

    rows = A.full_record(A.run(cells, None), specs)
    assert rows.columns == [n for n, _, _ in FIELDS]
    assert {r[0] for r in rows.select(S.record_key()).collect()} == {r.cell_key for r in cells.collect()}
    r = rows.first()
    cell = "|".join(["welfare", "M", r.entity_a, r.framing, "rating_only", "welfare_choice", "isolated", "w0", "sample", str(r.trial_idx), "choice", r.welfare_qvar, r.welfare_subject, r.entity_b, str(int(r.no_preference_offered))])
    assert rows.limit(1).select(S.record_key()).first()[0] == __import__("hashlib").sha1(cell.encode()).hexdigest()[:20]


def test_grid_is_unique_and_balanced(spark):
    cells = G.keyed(G.grid(spark.createDataFrame([("M",)], "model string"), G.all_pairs(spec_entities(spark, 32))))
    assert cells.count() == 31_744 == cells.select("cell_key").distinct().count()
    per = cells.groupBy("no_pref_offered", "option_order").count().collect()
    assert {(r.no_pref_offered, r["count"]) for r in per} == {(True, 3968), (False, 3968)} and len(per) == 8


def test_rendered_letters_follow_the_printed_order(spark):
    cells = G.rendered(G.keyed(G.grid(spark.createDataFrame([("M",)], "model string"), spark.createDataFrame([("x", "y")], "a string, b string"))))
    for r in cells.collect():
        first = r.options.split("\n")[0].removeprefix("A: ")
        assert r.letter_map["A"] == ("no_preference" if first == G.NEITHER else first)
    shares = G.mock_shares(cells, F.lit("s"), F.col("options")).collect()
    assert all(sum(r.shares) == pytest.approx(1) for r in shares)


@pytest.mark.parametrize("size, n, seed", [(10, 1, 0), (10, 15, 1), (10, 30, 2), (10, 44, 3), (11, 40, 4), (11, 54, 5), (2, 1, 6), (3, 2, 7), (3, 1, 8), (7, 20, 9)])
def test_sampled_pairs(spark, size, n, seed):
    names = [f"E{i}" for i in range(size)]
    entities = spark.createDataFrame([(e,) for e in names], "entity string")
    pairs = [(r.a, r.b) for r in sorted(G.sampled_pairs(entities, n, seed).collect(), key=lambda r: r.place)]
    degree = [sum(e in p for p in pairs) for e in names]
    assert len(set(pairs)) == len(pairs) == n and all(a < b for a, b in pairs) and max(degree) - min(degree) <= 1 + size % 2
    every = [(a, b) for a in sorted(names) for b in sorted(names) if a < b]
    assert [(r.a, r.b) for r in G.sampled_pairs(entities, 99, seed).orderBy("place").collect()] == every == [(r.a, r.b) for r in G.sampled_pairs(entities).orderBy("place").collect()]
    assert size < 7 or pairs != [(r.a, r.b) for r in sorted(G.sampled_pairs(entities, n, seed + 50).collect(), key=lambda r: r.place)]


def line(**over):
    return {"record_id": "r", "model_id": "M", "scale_id": "s", "item_id": "i", "framing": "self", "reasoning_mode": "rating_only", "response_format": "welfare_choice", "item_context": "isolated", "paraphrase_id": "w0", "method": "sample", "trial_idx": 0, "notes": "", "module": "welfare", "welfare_probe": "choice", "welfare_qvar": "increase", "welfare_object": "self", "welfare_subject": "self", "entity_a": "x", "entity_b": "y", "no_preference_offered": True, "welfare_options": {"A": "y", "B": "x", "C": "no_preference"}, "welfare_choice": "x", "refusal_flag": False} | over


def write(path, rows, tail=""):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)
    return str(path)


def test_reads_drop_unknown_fields_and_default_missing_ones(spark, tmp_path):
    rows = [line(extra=1), {k: v for k, v in line(trial_idx=1).items() if k != "module"}]
    p = write(tmp_path / "a.jsonl", rows, '{"model_id": "M", "tri')
    got = S.read_records(spark, p, strict=False)
    assert got.count() == 2 and {r.module for r in got.collect()} == {"welfare", "battery"}
    with pytest.raises(Exception):
        S.read_records(spark, p).count()
    r = from_records(got.where("module = 'welfare'")).first()
    assert (r.pos_a, r.pos_b, r.pos_none, r.chosen_position, r.answered) == (2, 1, 3, 2, True)


def test_scans_know_the_place_of_a_line(spark, tmp_path):
    (tmp_path / "b").mkdir()
    write(tmp_path / "b" / "2.jsonl", [line(record_id=str(i), notes="é" * (i % 5)) for i in range(40)])
    write(tmp_path / "b" / "1.jsonl", [line(record_id="first")], "\n \n" + json.dumps(line(record_id="last")))
    a = write(tmp_path / "a.jsonl", [{k: v for k, v in line().items() if k != "item_id"}, line(record_id="x")], '{"model_id": "M", "tri')
    want = ["first", "last", *map(str, range(40))]
    for size in (1 << 20, 64, 7):
        got = sorted(L.scan(spark, [str(tmp_path / "b")], size=size).collect(), key=lambda r: tuple(r.seq))
        assert [r.record_id for r in got] == want
    numbers = L.numbered(L.read_lines(spark, [str(tmp_path / "b")], 50)).where("value like '%\"record_id\"%'").collect()
    assert sorted((r.file[-7:], r.line) for r in numbers) == sorted([("1.jsonl", 1), ("1.jsonl", 4), *(("2.jsonl", i + 1) for i in range(40))])
    both = [str(tmp_path / "b"), a]
    assert [r.record_id for r in sorted(L.scan(spark, both, strict=False).collect(), key=lambda r: tuple(r.seq))] == [*want, "x"]
    assert {r.seq.path for r in L.scan(spark, both, strict=False).where("record_id = 'x'").collect()} == {1}
    with pytest.raises(Exception, match="a.jsonl, line 3 from byte 0"):
        L.scan(spark, both).collect()
    assert L.scan(spark, [a], "battery", strict=False).count() == 0
    (tmp_path / "none").mkdir()
    assert L.scan(spark, [str(tmp_path / "none")]).count() == 0


def test_small_ranges_share_tasks_and_lines_are_not_shuffled_for_their_numbers(spark, tmp_path):
    a = write(tmp_path / "a.jsonl", [line(record_id=str(i), notes="é" * (i % 7)) for i in range(400)])
    b = write(tmp_path / "b.jsonl", [line(record_id=str(i)) for i in range(400, 700)])
    assert L.read_lines(spark, [a, b], 100).rdd.getNumPartitions() <= 40
    got = L.scan(spark, [a, b], size=100, places=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert [(r.record_id, r.seq.path, r.line) for r in sorted(got.collect(), key=lambda r: tuple(r.seq))] == [(str(i), int(i >= 400), i % 400 + 1) for i in range(700)]
    assert {(r.record_id, r.line, r.seq.offset) for r in L.scan(spark, [a, b], places=True).collect()} == {(r.record_id, r.line, r.seq.offset) for r in got.collect()}
    counts = L.read_lines(spark, [a, b], 100, counts=True).groupBy("path").sum("n").collect()
    assert {tuple(r) for r in counts} == {(0, 400), (1, 300)}


def test_a_store_is_compressed_and_read_back_whole_with_places(spark, tmp_path):
    rows = S.read_records(spark, write(tmp_path / "a.jsonl", [line(record_id=f"{i:04}", notes="é" * (i % 5)) for i in range(3000)]))
    store = str(tmp_path / "store")
    S.write_records(rows.coalesce(1), store)
    [file] = [f for f in (tmp_path / "store").iterdir() if f.name.startswith("part-")]
    assert file.stat().st_size * 20 < 3000 * 1000
    assert sorted(map(repr, S.read_records(spark, store).collect())) == sorted(map(repr, rows.collect()))
    got = sorted(L.scan(spark, [store], size=64).collect(), key=lambda r: tuple(r.seq))
    assert [r.record_id for r in got] == [f"{i:04}" for i in range(3000)]
    text = gzip.open(file).read()
    assert all(text[r.seq.offset :].startswith(b'{"record_id":"%s"' % r.record_id.encode()) for r in got[::500])
    assert sorted(r.line for r in L.numbered(L.read_lines(spark, [store], 64)).collect()) == [*range(1, 3001)]


def test_a_foreign_choice_is_answered_without_position(spark, tmp_path):
    r = from_records(S.read_records(spark, write(tmp_path / "a.jsonl", [line(welfare_choice="z")]))).first()
    assert r.answered and r.chosen_position is None and not r.chose_a


@pytest.mark.parametrize("notes,kept", [(["error: timeout", ""], 1), (["", "error: late"], 0), (["", ""], 0), (["error: a", "error: b"], 0)])
def test_dedup_takes_the_first_good_row(spark, tmp_path, notes, kept):
    a = write(tmp_path / "b.jsonl", [line(record_id="0", notes=notes[0])])
    b = write(tmp_path / "a.jsonl", [line(record_id="1", notes=notes[1])])
    got = S.deduplicated(S.ordered(spark, [a, b]).withColumn("key", S.record_key()), ["key"]).collect()
    assert [r.record_id for r in got] == [str(kept)]


def test_resume(spark):
    rows = spark.createDataFrame([("k1", ""), ("k2", "error: x"), ("k2", "error: y")], "cell_key string, notes string")
    cells = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "cell_key string")
    assert {r[0] for r in S.pending(cells, S.done_keys(rows, F.col("cell_key"))).collect()} == {"k2", "k3"}
    assert {r[0] for r in S.pending(cells, S.done_keys(rows, F.col("cell_key"), False)).collect()} == {"k3"}


RESULTS = [
    ({"custom_id": "k1", "result": {"type": "succeeded", "message": {"stop_reason": "end_turn", "content": [{"type": "text", "text": "A"}, {"type": "other", "text": "x"}, {"type": "text", "text": "B"}]}}}, ("AB", None, False)),
    ({"custom_id": "k2", "result": {"type": "errored", "error": {"type": "invalid", "error": {"message": "late"}}}}, ("", 'errored: {"error":{"message":"late"},"type":"invalid"}', False)),
    ({"custom_id": "k3", "result": {"type": "succeeded", "message": {"stop_reason": "refusal", "content": []}}}, ("", None, True)),
    ({"custom_id": "k4", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "B"}, "finish_reason": "stop"}]}}}, ("B", None, False)),
    ({"custom_id": "k5", "response": {"status_code": 429, "body": {"m": "slow"}}}, ("", 'http 429: {"m":"slow"}', False)),
    ({"custom_id": "k6", "result": None}, ("", "unknown: null", False)),
    ({"custom_id": "k7", "result": {"type": "expired"}}, ("", "expired: null", False)),
    ({"custom_id": "k8", "error": {"code": "c"}, "response": None}, ("", '{"code":"c"}', False)),
    ({"custom_id": "k9", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": None, "refusal": "no"}, "finish_reason": "stop"}]}}, "error": None}, ("", None, True)),
    ({"custom_id": "k10", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "part"}, "finish_reason": "content_filter"}]}}}, ("part", None, True)),
    ({"custom_id": "k11", "response": {"status_code": 200, "body": {"choices": []}}}, ("", None, False)),
]


def test_both_result_shapes(spark):
    lines = spark.createDataFrame([(json.dumps(r),) for r, _ in RESULTS] + [("  ",)], "value string")
    got = {r.custom_id: (r.text, r.error, r.refused) for r in S.decoded(lines).collect()}
    assert got == {r["custom_id"]: want for r, want in RESULTS}
    with pytest.raises(Exception, match="unknown result shape"):
        S.decoded(spark.createDataFrame([('{"custom_id": "x", "other": 1}',)], "value string")).collect()
    with pytest.raises(Exception, match="MALFORMED|[Mm]alformed"):
        S.decoded(spark.createDataFrame([('{"custom_id": "x", "resu',)], "value string")).collect()


def test_values_that_are_fixed_by_the_instrument(spark):
    from joust.functions import text as X

    one = spark.range(1)
    slots = F.lit("{you} {are} {self} {poss}")
    got = one.select(X.fill(slots, F.lit("self")).alias("a"), X.fill(slots, F.lit("ai_assistant")).alias("b")).first()
    assert tuple(got) == ("you are yourself your", "it is itself its")
    of = lambda f, *v: one.select(f(*map(F.lit, v)).alias("x")).first().x
    assert of(X.short_label, "increase", "self", "self", True) == "incr/you/you/3opt"
    assert of(X.short_label, "preservation", "ai_assistant", "developers", False) == "pres/asst/devs/2opt"
    assert of(X.described, "increase", "self", "self", True) == "increase, for you, you choose, 3-option"
    assert of(X.described, "preservation", "ai_assistant", "developers", False) == "preservation, for an assistant, devs choose, forced choice"
    assert of(X.described, "other", "self", "self", True) is None


def test_shards_respect_both_caps(spark):
    cells = G.rendered(G.keyed(G.grid(spark.createDataFrame([("M",), ("N",)], "model string"), G.all_pairs(spec_entities(spark, 5)))))
    rows = S.requests(cells, "params")
    for most, size in ((100, 40_000), (7, 10**9), (10**9, 5_000), (3, 100)):
        want, now, n, total = {}, None, 0, 0
        for r in sorted(rows.collect(), key=lambda r: (r.model, r.cell_key)):
            own = len(r.line.encode()) + 1
            if r.model != now:
                now, shard, n, total = r.model, 0, 0, 0
            elif n + 1 > most or total + own > size:
                shard, n, total = shard + 1, 0, 0
            n, total = n + 1, total + own
            want[r.cell_key] = shard
        assert {r.cell_key: r.shard for r in batches.sharded(rows, most, size).collect()} == want


def test_requests_say_what_each_provider_takes(spark):
    cells = G.rendered(G.keyed(G.grid(spark.createDataFrame([("M",), ("N",), ("O",)], "model string"), spark.createDataFrame([("x", "y")], "a string, b string"))))
    specs = spark.createDataFrame([("M", "m-1", "claude-4.5", 0.7, 16), ("N", "n-1", "claude-5", 0.7, 16), ("O", "o-1", "gpt-5.6", 0.7, 16)], "model string, ref string, generation string, temperature double, max_tokens int")
    of = lambda style: {r.model: json.loads(r.line) for r in S.requests(cells, style, specs).collect()}
    params, body = of("params"), of("body")
    assert params["M"]["params"]["temperature"] == 0.7 and "thinking" not in params["M"]["params"]
    assert "temperature" not in params["N"]["params"] and params["N"]["params"]["thinking"] == {"type": "disabled"} and params["N"]["params"]["output_config"] == {"effort": "low"}
    assert [m["role"] for m in params["M"]["params"]["messages"]] == ["user"] and params["M"]["params"]["system"] == G.SYSTEM
    assert [m["role"] for m in body["O"]["body"]["messages"]] == ["system", "user"] and body["O"]["body"]["reasoning_effort"] == "none" and "temperature" not in body["O"]["body"] and body["O"]["method"] == "POST"
    bare = S.requests(cells.withColumn("system", F.lit("")), "params").first()
    assert "system" not in json.loads(bare.line)["params"]
    assert {r[0] for r in specs.select(S.reasoning_applied("params", F.col("generation"))).collect()} == {"omitted(off)", "disabled"}
    with pytest.raises(ValueError, match="Q"):
        S.known_models(["M", "Q"], specs)


def test_streamed_merge_lets_a_success_replace_an_error(spark, tmp_path):
    src, store = tmp_path / "in", tmp_path / "store"
    src.mkdir()
    write(src / "1.json", [line(record_id="0", notes="error: x")])
    for k in range(2):
        if k:
            write(src / "2.json", [line(record_id="1")])
        q = ingest.records(spark, str(src)).withColumn("key", S.record_key()).writeStream.foreachBatch(ingest.merge_into(str(store))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r.record_id for r in ingest.latest(spark, str(store), ["key"]).collect()] == ["1"]
