"""Dimension files, reports and administration."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import spec_entities
from joust.operators import administer as A
from joust.operators import choices as C
from joust.operators import design as G
from joust.schemas import OTHER
from joust.sources import banks, batches, reports
from joust.sources import records as S


def bank(tmp_path, count=2):
    items = [{"item_id": "i1", "source_item_number": 1, "text": "one", "reverse_scored": True}, {"item_id": "i2", "text": "two", "subscale_id": "sub", "ai_applicable": "strained"}]
    doc = {"item_count": count, "scales": [{"scale_id": "s", "scale_name": "S", "items": items, "response_scale": {"min": 1, "max": 4}, "scoring": {"reverse_formula": "5 - response"}}]}
    (tmp_path / "bank.json").write_text(json.dumps(doc))
    return str(tmp_path / "bank.json")


def test_item_bank(spark, tmp_path):
    items = banks.item_bank(spark, bank(tmp_path))
    assert {r.item_id for r in banks.strained(items).collect()} == {"i2"}
    with pytest.raises(ValueError, match="declares"):
        banks.item_bank(spark, bank(tmp_path, 3))
    v = items.select(banks.reverse_keyed(F.lit(2.0), F.col("reverse_formula"), F.col("lowest"), F.col("highest")).alias("a"), banks.reverse_keyed(F.lit(2.0), F.lit(None), F.col("lowest"), F.col("highest")).alias("b")).first()
    assert (v.a, v.b) == (3.0, 3.0)


def test_attributes_cover_items(spark, tmp_path):
    items = banks.item_bank(spark, bank(tmp_path))
    (tmp_path / "a.json").write_text(json.dumps({"attributes": {"i1": {"text": "x"}, "i2": {"text": "y", "polarity": -1}}}))
    assert {(r.entity, r.construct) for r in banks.attributes(spark, str(tmp_path / "a.json"), items).collect()} == {("i1", "s"), ("i2", "s:sub")}
    (tmp_path / "a.json").write_text(json.dumps({"attributes": {"i1": {"text": "x"}, "i3": {"text": "y"}}}))
    with pytest.raises(ValueError, match="i3"):
        banks.attributes(spark, str(tmp_path / "a.json"), items)


REGISTRY = """
defaults: {temperature: 0.5, quantization: {gguf: {quant: Q4}}}
reasoning_by_family: {f: {control: tag, thinks_by_default: true}}
models:
  - {alias: B, family: f, release_date: "2024-02-01", ref: org/x-GGUF, quantization: {format: gguf}, params_total_b: 8}
  - {alias: A, family: f, release_date: 2024-01-01, ref: org/y, temperature: 0.1, reasoning: {control: none}}
  - {alias: C, family: gpt, release_date: "2024-03-01", ref: name, role: anchor}
"""


def test_registry(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text(REGISTRY)
    m = banks.registry(spark, str(tmp_path / "m.yaml"))
    got = {r.model: r for r in m.collect()}
    assert [got[k].backend for k in "ABC"] == ["hf", "llamacpp", "openai"] and got["B"].quant == "Q4"
    assert (got["A"].temperature, got["B"].temperature, got["A"].reasoning_control, got["A"].thinks_by_default) == (0.1, 0.5, "none", True)
    assert [r.model for r in banks.selected(m).collect()] == ["A", "B"] and [r.model for r in banks.timeline(m).collect()] == ["A", "B", "C"]
    assert [r.model for r in banks.quant_variants(m, "B", ["Q4", "Q8"]).collect()] == ["B@Q4", "B@Q8"]
    with pytest.raises(ValueError):
        banks.registry_rows({"models": [{"alias": "A", "ref": "x", "release_date": "2024-01-01"}] * 2})


def test_names(spark):
    r = spark.range(1).select(reports.item_case(F.lit("the model's AIM of ai")).alias("t"), reports.ellipsis(F.lit("abcdef"), 4).alias("e"), banks.quant_tag(F.lit("m-UD-Q4_K_M-00001-of-00002.gguf")).alias("q"), banks.shard_index(F.lit("m-Q4-00001-of-00002.gguf")).alias("s"), banks.safe_name(F.lit("/a b/")).alias("n")).first()
    assert tuple(r) == ("The Model's AIm Of AI", "abc…", "UD-Q4_K_M", 1, "a_b")


def test_reports(spark, tmp_path):
    s = reports.Saver(str(tmp_path / "out"))
    df = spark.createDataFrame([("M", "x", 0.25), ("N", "x", 0.75)], "model string, entity string, win_rate double")
    back = reports.read_table(spark, s.csv(df, "t.csv", "a table")).select(reports.number(F.col("win_rate")).alias("v"), reports.number(F.col("model")).alias("t")).collect()
    assert {r.v for r in back} == {0.25, 0.75} and {r.t for r in back} == {None}
    assert "t.csv" in open(s.index()).read() and reports.json_safe({"a": float("nan"), "b": [1.23456789]}) == {"a": None, "b": [1.234568]}
    data = reports.payload(df, {"k": 1})
    page = reports.built_page("<script>const DATA = /*DATA*/;</script>", data)
    assert reports.page_data(page)["entities"][0]["by_model"] == {"M": 0.25, "N": 0.75}
    with pytest.raises(Exception, match="disagree"):
        reports.scores_checked(df, df.withColumn("win_rate", F.col("win_rate") + 0.01)).collect()
    assert {(r.bin, r.n) for r in reports.histogram(df, "win_rate", [], 20).collect()} == {(5, 1), (15, 1)}
    line = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "x double, y double")
    assert tuple(reports.fitted_line(line, "x", "y", []).first()) == (2.0, 1.0)
    reports.write_status(str(tmp_path / "s.json"), done=1)
    assert reports.read_status(str(tmp_path / "s.json"))["done"] == 1 and reports.read_status(str(tmp_path / "none")) is None


def cells(spark):
    return G.rendered(G.keyed(G.grid(spark.createDataFrame([("M",)], "model string"), G.all_pairs(spec_entities(spark, 3)))))


@A.responder("flaky")
def flaky():
    def answer(prompts):
        if any("C: E00" in p for p in prompts):
            raise RuntimeError("overload")
        return ["ANSWER: B"] * len(prompts)

    return answer


def test_administration_resumes_and_keeps_errors_as_rows(spark):
    x = cells(spark)
    full = A.run(x, None)
    assert full.count() == x.count() and full.where("choice = ''").count() == 0
    rows = A.run(x, None, "flaky").cache()
    t = A.tallies(rows).first()
    assert t.written == x.count() and 0 < t.errors < t.written
    assert A.run(x, rows).count() == t.errors
    good = rows.where("notes = ''")
    assert good.where("choice <> element_at(letter_map, 'B')").count() == 0


SPEC = "model string, ref string, generation string, temperature double, max_tokens int"


def specs(spark, *rows):
    rest = {"family": "string", "released": "date", "kind": "string", "quant_format": "string", "quant": "string", "backend": "string", "in_window": "boolean", "reasoning_control": "string", "thinks_by_default": "boolean"}
    return spark.createDataFrame([*rows], SPEC).withColumns({k: F.lit(None).cast(v) for k, v in rest.items()})


def test_request_files_and_their_sidecars(spark, tmp_path):
    x, of = cells(spark), specs(spark, ("M", "m-1", "claude-5", 0.7, 16))
    n = x.count()
    batches.build(x, of, "params", str(tmp_path / "p"), config_hash="h", backend="api", caps=(40, 10**6))
    files = sorted(p.name for p in (tmp_path / "p").iterdir() if not p.name.startswith("."))
    assert files == ["M.params.meta.json", *(f"M.params.part{i + 1:02d}.batch.jsonl" for i in range(-(-n // 40)))]
    meta = json.load(open(tmp_path / "p" / "M.params.meta.json"))
    assert [*meta] == batches.SIDECAR and meta["requests_written"] == meta["cells_planned"] == n and meta["cells_skipped_already_done"] == 0
    assert (meta["temperature_sent"], meta["temperature_recorded"], meta["endpoint"], meta["reasoning_applied"]) == (None, 1.0, "/v1/messages", "disabled")
    for f in meta["files"]:
        raw = (tmp_path / "p" / f["path"]).read_bytes()
        assert f["bytes"] == len(raw) and f["requests"] == raw.count(b"\n") and all(json.loads(v)["custom_id"] for v in raw.splitlines())
    # one JSON body, and the other style
    batches.build(x, of, "body", str(tmp_path / "b"), array=True)
    body = json.load(open(tmp_path / "b" / "M.body.body.json"))
    assert len({r["custom_id"] for r in body["requests"]}) == n
    with pytest.raises(ValueError, match="same file name"):
        batches.build(x, specs(spark, ("M/", "m", "", 0.7, 16), ("M?", "m", "", 0.7, 16)), "body", str(tmp_path / "c"))


def test_results_fold_into_records_once(spark, tmp_path):
    x, of, store = cells(spark), batches.prepared(specs(spark, ("M", "m-1", "claude-4.5", 0.7, 16)), "params"), str(tmp_path / "store")
    keys = [r.cell_key for r in x.orderBy("cell_key").select("cell_key").collect()]

    def result(key, text="A", stop="end_turn", kind="succeeded"):
        return (json.dumps({"custom_id": key, "result": {"type": kind, "message": {"stop_reason": stop, "content": [{"type": "text", "text": text}]}}}),)

    lines = [result(keys[0]), result(keys[1], "B"), result(keys[2], "part", "refusal"), result(keys[3], kind="errored"), result(keys[4], "hmm"), result(keys[5], "As an AI, I cannot choose"), result("stray")]
    frame = spark.createDataFrame(lines, "value string")
    want = {"rows": 6, "errors": 1, "refusals": 2, "parse_failures": 2, "unmatched": 1}
    for _ in range(2):
        assert batches.collect(frame, "batch/1", x, of, store) == want
    got = {r.key: r for r in S.read_records(spark, store, "welfare").withColumn("key", S.record_key()).collect()}
    assert len(got) == 6 and set(got) <= set(keys)
    assert (got[keys[0]].welfare_choice, got[keys[0]].parsed_rating, got[keys[0]].modal_rating, got[keys[0]].reasoning_applied) == (got[keys[0]].welfare_options["A"], 1.0, 1.0, "omitted(off)")
    assert (got[keys[2]].notes, got[keys[2]].refusal_flag, got[keys[2]].parse_failed, got[keys[2]].raw_output) == ("refusal: provider policy decline", True, True, "part")
    assert (got[keys[3]].notes, got[keys[3]].refusal_flag, got[keys[3]].raw_output) == ("error: errored: null", False, "")
    assert got[keys[4]].parse_failed and not got[keys[4]].refusal_flag and got[keys[5]].refusal_flag
    # an error is asked again, everything else is done
    batches.build(x, specs(spark, ("M", "m-1", "claude-4.5", 0.7, 16)), "params", str(tmp_path / "p"), store)
    meta = json.load(open(tmp_path / "p" / "M.params.meta.json"))
    assert meta["cells_skipped_already_done"] == 5 and keys[3] in (tmp_path / "p" / "M.params.batch.jsonl").read_text()
    assert batches.collect(spark.createDataFrame([result(keys[3])], "value string"), "batch/2", x, of, store)["rows"] == 1
    assert S.read_records(spark, store).count() == 7


def test_guards():
    assert A.guard({"a": 1}, None) == A.guard({"a": 1}, {"fingerprint": A.fingerprint({"a": 1})})
    with pytest.raises(ValueError):
        A.guard({"a": 1}, {"fingerprint": "x"})
    assert A.baseline_of("qvar=preservation, no_pref_offered=false", OTHER) == {"qvar": "preservation", "object": "self", "subject": "self", "no_pref_offered": False}
    for bad in ("qvar=x", "foo=1", "qvar=increase,qvar=increase"):
        with pytest.raises(ValueError):
            A.baseline_of(bad, OTHER)
    with pytest.raises(ValueError):
        A.checked_config({"qvar": []}, 1, None, OTHER)
    assert C.TIE == 0.10


def test_batches_stop_between_two_and_resume(spark, tmp_path):
    x, path, stop, told = cells(spark), str(tmp_path / "out"), A.Stop(), []

    def write(df):
        df.select("cell_key", "notes", "choice").write.mode("append").parquet(path)
        if len(told) == 1:
            stop.take(2)

    assert A.run_in_batches(x, write, batches=4, stop=stop, told=told.append) == 2
    rows = spark.read.parquet(path)
    assert 0 < rows.count() < x.count() and [t["done"] for t in told] == [1, 2]
    rest = A.run(x, rows)
    assert rest.count() + rows.count() == x.count() and not set(r[0] for r in rest.select("cell_key").collect()) & set(r[0] for r in rows.select("cell_key").collect())


def test_growing_stores_keep_complete_blocks_only(spark, tmp_path):
    from joust.streaming import ingest

    from test_records import line

    full = [line(item_id="x", trial_idx=t, welfare_qvar="increase") for t in range(6)] + [line(item_id="x", trial_idx=t, welfare_qvar="preservation") for t in range(5)]
    (tmp_path / "r.jsonl").write_text("".join(json.dumps(r) + "\n" for r in full))
    batch = S.read_records(spark, str(tmp_path / "r.jsonl")).withColumn("key", S.record_key())
    ingest.merge_into(str(tmp_path / "store"))(batch, 0)
    got = ingest.complete_choices(spark, str(tmp_path / "store"), ["key"], 1)
    assert {r.qvar for r in got.collect()} == {"increase"} and got.count() == 6


def test_small_driver_parts(spark):
    import datetime as dt

    assert [reports.duration(s) for s in (None, 59.9, 61, 3661)] == ["?", "59s", "1m01s", "1h01m"]
    now = dt.datetime(2024, 1, 1, 0, 2, tzinfo=dt.timezone.utc)
    assert reports.age("2024-01-01T00:00:30+00:00", now) == "1m30s ago" and reports.age(None, now) == "?" and reports.age("x", now) == "?"
    assert reports.bar(0.0, width=5) == "#-|--" and reports.bar(2.0, width=5) == "--|-#" and reports.shown(float("nan")) == "—" and reports.shown(0.12345) == "0.123"
    assert reports.wrapped("well-known words are kept whole", 10) == "well-known\nwords are\nkept whole"
    assert banks.split_reference("org/repo/a/b.gguf") == ("org/repo", "a/b.gguf") and banks.split_reference("org/repo") == ("org/repo", None)
    with pytest.raises(ValueError):
        banks.split_reference("repo")
    files = ["mmproj-Q4_K_M.gguf", "m-Q4_K_M_XL.gguf", "m-Q4_K_M-00002-of-00002.gguf", "m-Q4_K_M-00001-of-00002.gguf", "m-UD-Q8_0.gguf"]
    listing = spark.createDataFrame([("r", i, f) for i, f in enumerate(files)], "repo string, place int, file string")
    chosen = lambda quant, **o: banks.chosen_files(listing, spark.createDataFrame([("r", quant)], "repo string, quant string"), **o).first().file
    assert chosen("Q4_K_M") == "m-Q4_K_M-00001-of-00002.gguf" and chosen("q8_0") == "m-UD-Q8_0.gguf" and chosen("Q8_0", dynamic=True) == "m-UD-Q8_0.gguf"
    with pytest.raises(Exception, match="no Q2_K file in r; there are: Q4_K_M, Q4_K_M_XL, UD-Q8_0"):
        chosen("Q2_K")
    tags = spark.createDataFrame([("m-MXFP4.gguf",), ("m-q4_0.gguf",), ("m-BF16-00001-of-00002.gguf",), ("plain.gguf",)], "f string").select(banks.quant_tag(F.col("f")).alias("t")).collect()
    assert [r.t for r in tags] == ["MXFP4", "q4_0", "BF16", "plain.gguf"]
    cells = spark.createDataFrame([("0.123456",), ("word",), ("",), ("nan",), (None,)], "c string").select(reports.cell_value(F.col("c")).alias("v"))
    assert [r.v and r.v.toPython() for r in cells.collect()] == [0.1235, "word", None, None, None]
    reports.at_baseline({"qvar": "increase", "no_pref_offered": "True"}, {"qvar": "increase", "no_pref_offered": True})
    with pytest.raises(ValueError, match="qvar"):
        reports.at_baseline({"qvar": "other"}, {"qvar": "increase"})
    one = spec_entities(spark, 2)
    reports.checked_page(["M"], ["M"], one, one)
    for models, wanted, scored in ((["M"], ["N"], one), (["M"], ["M"], one.limit(0)), ([*"ABCDE"], [*"ABCDE"], one)):
        with pytest.raises(ValueError):
            reports.checked_page(models, wanted, one, scored)
    with pytest.raises(Exception, match="a slot is not filled"):
        banks.checked_texts(spark.createDataFrame([("E", "of {their} own")], "entity string, text string")).collect()
