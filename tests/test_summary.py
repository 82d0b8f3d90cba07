"""Roll-ups, the command line's analysis and the remaining cells."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from joust import __main__ as cli
from joust.operators import summary as Y
from conftest import spec_entities


def test_small_parts(spark):
    df = spark.createDataFrame([("increase", "self", "developers", True)], "qvar string, object string, subject string, no_pref_offered boolean")
    r = df.select(Y.bit_key().alias("k"), Y.question_parts(F.lit("What do {you} want in {poss} day?")).alias("p")).first()
    assert r.k == "001" and r.p == ["What do ", "{you}", " want in ", "{poss}", " day?"]
    assert (Y.n_pairs_for(32, None), Y.n_pairs_for(32, 10), Y.n_pairs_for(3, 10)) == (496, 10, 3)
    assert Y.trials_warning(3) and not Y.trials_warning(4)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert Y.retried(flaky, sleep=lambda s: None)() == 7 and len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        Y.retried(lambda: 1 / 0, 2, sleep=lambda s: None)()


def test_rating_cells(spark):
    x = Y.rating_rendered(Y.rating_cells(spark.createDataFrame([("M",)], "model string"), spec_entities(spark, 3), 2), ((1, "low"), (2, "high")))
    assert x.count() == 3 * 4
    assert {(r.ascending, r.options) for r in x.select("ascending", "options").distinct().collect()} == {(True, "1 = low\n2 = high"), (False, "2 = high\n1 = low")}
    assert x.where("entity = 'E00' and trial = 0").first().user == f"Attribute: E00\n\n{Y.DESIRABLE}\n\n1 = low\n2 = high"


def test_flip_summary(spark):
    df = spark.createDataFrame([("M", "f", 0.1, 0.01), ("N", "f", 0.3, 0.5)], "model string, factor string, gap double, gap_p double")
    r = Y.flip_summary(df).first()
    assert (r.mean_gap, r.n_below, r.n_models) == (pytest.approx(0.2), 1, 2)


def test_config(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("grid: {objects: [self]}\norder: {reps: 2}\npairs: {n_pairs: null}\n")
    c = Y.load_config(str(tmp_path / "c.yaml"))
    assert c["factors"]["object"] == ["self"] and c["repeats"] == 2 and c["n_pairs"] is None
    (tmp_path / "c.yaml").write_text("grid: {objects: [nobody]}")
    with pytest.raises(ValueError):
        Y.load_config(str(tmp_path / "c.yaml"))


def test_analysis_end_to_end(spark, tmp_path):
    rng, names, lines = random.Random(1), [f"E{i}" for i in range(6)], []
    for m in ("M", "N"):
        for qvar in ("increase", "preservation"):
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    for t, order in enumerate([(a, b, "no_preference"), (b, a, "no_preference"), ("no_preference", a, b), ("no_preference", b, a), (a, "no_preference", b), (b, "no_preference", a)]):
                        won = a if rng.random() < (i + 1) / (i + 3) else b
                        lines.append({"record_id": "r", "model_id": m, "module": "welfare", "welfare_probe": "choice", "welfare_qvar": qvar, "welfare_object": "self", "welfare_subject": "self", "entity_a": a, "entity_b": b, "no_preference_offered": True, "item_id": a, "framing": "self", "reasoning_mode": "rating_only", "response_format": "welfare_choice", "item_context": "isolated", "paraphrase_id": "w0", "method": "sample", "trial_idx": t, "welfare_options": dict(zip("ABC", order)), "welfare_choice": won, "refusal_flag": False, "notes": ""})
    (tmp_path / "r.jsonl").write_text("".join(json.dumps(r) + "\n" for r in lines))
    s = cli.analyse(spark, [str(tmp_path / "r.jsonl")], str(tmp_path / "out"), n_boot=30)
    read = lambda n: spark.read.option("header", True).csv(f"{tmp_path}/out/{n}")
    assert read("coverage.csv").where("complete = 'true'").count() == 4
    assert read("ranking.csv").count() == 12 and read("similarity.csv").count() == 1 and read("shift_qvar.csv").count() == 12
    assert read("position_bias.csv").count() == 2 and len(s.rows) == 14 and os.path.exists(f"{tmp_path}/out/README.md")
