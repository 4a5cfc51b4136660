import pytest
from pyspark.sql import functions as F

from gradus.operators import evaluation, profiling, runs, splits, validation

from .conftest import plan

QA = "qa_id string, source string, path string, category string, question string, A string, B string, C string, D string, answer string"


@pytest.fixture
def references(spark):
    rows = [
        ("q1", "HAU", "clip-1", "multi", "?", "a", "b", "c", "d", "AC"), ("q2", "HAU", "clip-1", "sequence", "?", "a", "b", "c", "d", "ABDC"),
        ("q3", "HARn", "clip-2", "single", "?", "a", "b", "c", "", "B"), ("q4", "", "clip-3", "emotion", "?", "a", "b", "c", "d", "D"),
    ]
    return spark.createDataFrame(rows, QA)


def test_metric(spark, references):
    p = spark.createDataFrame([("q1", "CA"), ("q2", "ACBD"), ("q3", "D"), ("q4", " d ")], "qa_id string, prediction string")
    evaluation.require_aligned(references, p)
    rows = evaluation.assessed(references, p).cache()
    cube = {(r["grain"], r["source"], r["category"]): r for r in evaluation.accuracy_cube(rows).collect()}
    every = cube["all", None, None]
    assert (every["correct"], every["total"], every["invalid"], every["accuracy"]) == (2, 4, 1, 0.5)
    assert cube["source", evaluation.MISSING, None]["correct"] == 1
    macro = evaluation.clip_macro(rows).first()
    assert (macro["clips"], macro["accuracy"]) == (3, 0.5)
    assert [r["qa_id"] for r in evaluation.invalid_examples(rows, "qa_id").collect()] == ["q3"]


@pytest.mark.parametrize("ids, word", [(["q1", "q2", "q3"], "differ"), (["q1", "q1", "q2", "q3", "q4"], "duplicate"), (["q1", "q2", "q3", " "], "blank"), (["q1", "q2", "q3", "q4", "q5"], "differ")])
def test_misaligned(spark, references, ids, word):
    with pytest.raises(evaluation.InputError, match=word):
        evaluation.require_aligned(references, spark.createDataFrame([(i, "A") for i in ids], "qa_id string, prediction string"))


def test_percentiles(spark):
    r = profiling.describe(spark.range(1, 101).select(F.col("id").cast("double").alias("v")), "v").first()
    assert [r[f"p{p}"] for p in (50, 90, 95, 99)] == [50, 90, 95, 99]
    r = profiling.describe(spark.createDataFrame([(7.0,)], "v double"), "v").first()
    assert (r["p50"], r["p99"], r["stdev"]) == (7, 7, 0)
    assert profiling.describe(spark.createDataFrame([], "v double"), "v").first()["count"] == 0


def test_steady_state(spark):
    rows = spark.createDataFrame([("r", i, v, "valid", 1) for i, v in enumerate([900.0, 800.0, 100.0, 100.0, 100.0])] + [("s", 0, 5.0, "failed", None)], "run string, seq int, total_ms double, status string, generation_tokens int")
    got = {r["run"]: r for r in profiling.throughput(rows, ("run",), ["seq"], warmup=2).collect()}
    assert (got["r"]["steady_rps"], got["r"]["warmup_skipped"], got["r"]["steady_valid_rate"]) == (10.0, 2, 1.0)
    assert (got["s"]["warmup_skipped"], got["s"]["steady_requests"], got["s"]["steady_token_rate"]) == (0, 1, None)


def test_batches(spark):
    b = spark.createDataFrame([(8, 1000.0, 0), (4, 500.0, 0)], "size int, batch_ms double, generation_tokens int")
    r = profiling.batch_view(b).first()
    assert (r["throughput_rps"], r["amortized_ms"], r["token_rate"]) == (8.0, 125.0, None)
    t = profiling.coverage(spark.createDataFrame([(40.0,), (80.0,), (None,), (float("nan"),)], "ttft double").where("ttft is null or not isnan(ttft)"), "ttft").first()
    assert (t["p50"], t["p95"], round(t["coverage"], 4)) == (40, 80, 0.6667)


def test_coverage_and_leaks(spark):
    rows = spark.createDataFrame([(f"q{i}", i, s) for i, s in enumerate("aabbcc")], "qa_id string, fold int, subject string").where("fold < 5").withColumn("split", splits.split_of("fold"))
    cov = {r["split"]: r for r in splits.coverage(rows, rows.where("qa_id <> 'q1'"), "qa_id").collect()}
    assert (cov["train"]["expected"], cov["train"]["missing"], cov["train"]["examples"], cov["dev"]["status"]) == (3, 1, ["q1"], "PASS")
    assert {r["subject"] for r in splits.leaking_groups(rows, "subject").collect()} == {"a", "b"}
    assert splits.total_variation(rows, rows, "subject").first()[0] == 0


def test_resume(spark):
    t = spark.createDataFrame([(f"q{i}", i) for i in range(6)], "qa_id string, pos int")
    r = spark.createDataFrame([("q0", "valid", 1), ("q1", "invalid", 2), ("q2", "failed", 1)], "qa_id string, status string, attempts int")
    left = runs.pending(runs.first_targets(t, 4), r)
    assert {x["qa_id"] for x in left.collect()} == {"q1", "q2", "q3"} and "LeftAnti" in plan(left)
    with pytest.raises(ValueError):
        runs.first_targets(t, 0)
    done = runs.upsert(r, spark.createDataFrame([("q1", "valid", 0), ("q3", "valid", 0)], "qa_id string, status string, attempts int"))
    assert {(x["qa_id"], x["status"], x["attempts"]) for x in done.collect()} == {("q0", "valid", 1), ("q1", "valid", 3), ("q2", "failed", 1), ("q3", "valid", 1)}
    assert runs.status_counts(t, r).first()["pending"] == 3


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 33])
def test_replica_blocks(spark, n):
    got = [r["count"] for r in runs.replica_blocks(spark.range(n), ["id"], 2).groupBy("replica").count().orderBy("replica").collect()]
    assert got == [x for x in (n - n // 2, n // 2) if x]


def test_best_repeat(spark):
    rows = spark.createDataFrame([("k", 0, 1.39), ("k", 1, 1.41), ("k", 2, 1.52), ("l", 3, 9.0), ("m", 4, 2.0), ("m", 5, 2.0)], "key string, pos int, throughput_rps double")
    measured = rows.withColumn("measured", F.lit(True))
    assert {r["pos"] for r in runs.best_repeats(measured, ["key"]).collect()} == {2, 4}
    assert {r["pos"] for r in runs.best_repeats(measured.withColumn("measured", F.col("pos") != 2), ["key"]).collect()}.isdisjoint({2})


def test_generate(spark):
    class Fake:
        def generate_batch(self, prompts, allowed):
            if "bad" in prompts:
                raise ValueError("no")
            return [a[0] for a in allowed]

        def close(self):
            pass

    rows = spark.createDataFrame([("q1", "x", ["A", "B"])], "qa_id string, prompt string, allowed array<string>")
    assert runs.generate(rows, Fake).collect()[0]["raw_output"] == "A"
    assert "ValueError" in runs.generate(rows.withColumn("prompt", F.lit("bad")), Fake).collect()[0]["error"]


def _tables(spark, predictions):
    tests = spark.createDataFrame([(i, f"q{i + 1}", "HAU", "p", k, "?", "a", "b", "c", "d") for i, k in enumerate(["single", "multi", "sequence", "emotion"])], "pos int, qa_id string, source string, path string, category string, question string, A string, B string, C string, D string")
    template = tests.select("pos", "qa_id", F.lit("A").alias("prediction"))
    return tests, template, spark.createDataFrame([(i, q, p) for i, (q, p) in enumerate(predictions)], "pos int, qa_id string, prediction string")


GOOD = [("q1", "A"), ("q2", "AC"), ("q3", "ABDC"), ("q4", "D")]


def test_submission_passes(spark):
    r = validation.verdict(validation.submission_report(*_tables(spark, GOOD))).first()
    assert (r["status"], r["checks"], r["failed"]) == ("PASS", 17, [])


@pytest.mark.parametrize(
    "rows, failed",
    [
        ([GOOD[1], GOOD[0], *GOOD[2:]], ["submission_id_order"]), ([*GOOD[:3]], ["submission_id_order", "submission_id_set", "submission_row_count"]), ([*GOOD, GOOD[0]], ["submission_id_order", "submission_row_count", "submission_unique_ids"]),
        ([("q1", "a"), *GOOD[1:]], ["prediction_format"]), ([GOOD[0], ("q2", "CA"), *GOOD[2:]], ["prediction_format"]), ([GOOD[0], ("q2", "A C"), *GOOD[2:]], ["prediction_format"]), ([*GOOD[:3], ("q4", "")], ["prediction_format"]),
    ],
)
def test_submission_faults(spark, rows, failed):
    report = validation.submission_report(*_tables(spark, rows))
    assert validation.verdict(report).first()["failed"] == failed
    with pytest.raises(ValueError, match=failed[0]):
        validation.required(report)


def test_invalid_counts_unknown_ids(spark):
    tests, _, sent = _tables(spark, [*GOOD[:3], ("q4", "E"), ("q9", "A"), ("", "B")])
    r = validation.submission_totals(sent, tests).first()
    assert (r["rows"], r["canonical"], r["invalid"], r["unknown"]) == (6, 3, 3, 2)


def test_submission_examples_of_failed_checks(spark):
    tests, template, sent = _tables(spark, [("q1", "A"), ("q1", "A"), ("q3", "ABDC"), ("q7", "D")])
    rows = {r["code"]: r for r in validation.submission_report(tests, template, sent).collect()}
    assert rows["submission_unique_ids"]["detail"].endswith(": q1") and rows["submission_id_set"]["observed"] == "2,1"
    assert rows["submission_id_order"]["observed"] == "first mismatch at data row 2" and rows["prediction_format"]["detail"].endswith("q7:unknown id")


def test_option_order(spark):
    rows = spark.createDataFrame([("q1", "multi", "AC"), ("q2", "sequence", "ABDC"), ("q3", "single", None), ("q4", "single", "B"), ("q5", "single", "C")], "qa_id string, category string, given string")
    shown = spark.createDataFrame([("q1", "multi", "BD"), ("q2", "sequence", "DABC"), ("q3", "single", "A"), ("q4", "single", "A"), ("q5", "single", "D")], "qa_id string, category string, given string")
    orders = spark.createDataFrame([("q1", [3, 0, 1, 2]), ("q2", [1, 3, 2, 0]), ("q3", [0, 1, 2, 3]), ("q4", [0, 1, 2]), ("q5", [2, 1, 0])], "qa_id string, order array<int>")
    got = {r["category"]: r for r in evaluation.option_order_consistency(rows, shown, orders).collect()}
    # B, D as shown are A, C; D, A, B, C as shown are A, B, D, C; D is shown nowhere among three
    assert (got["multi"]["same"], got["multi"]["consistency"], got["sequence"]["same_moved"]) == (1, 1.0, 1)
    assert (got["single"]["questions"], got["single"]["both_valid"], got["single"]["same"], got["single"]["moved"]) == (3, 1, 0, 1)


def test_fold_gates(spark):
    kinds = ("single", "multi")
    good = [(f"q{u}{c}{k}", f"u{u}", f"c{u}{c}", u % 2, s, k, f"a{c}") for u in range(4) for c, s in enumerate(("HAU", "HARn")) for k in kinds]
    schema = "qa_id string, subject_id string, clip_key string, fold int, source string, category string, action string"
    gates = lambda rows: {r["code"]: (r["status"], r["observed"]) for r in splits.fold_gates(spark.createDataFrame(rows, schema), ("HAU", "HARn"), kinds, 2).collect()}
    got = gates(good)
    assert len(got) == 11 and {s for s, _ in got.values()} == {"PASS"} and got["training_keeps_actions"][1] == "2,2"
    # one question of a clip in the other fold; an action of one subject alone; a fold that is no fold
    bad = gates([(*r[:3], 1 - r[3], *r[4:]) if r[0] == "q00single" else r for r in good])
    assert {c for c, (s, _) in bad.items() if s == "FAIL"} == {"subjects_assigned_once", "clips_assigned_once", "subjects_in_one_fold", "clip_questions_together"}
    lone = gates([*good, ("q9", "u0", "c00", 0, "HAU", "multi", "rare")])
    assert lone["training_keeps_actions"] == ("FAIL", "2,3") and lone["action_coverage_at_bound"] == ("PASS", "0")
    apart = gates([(*r[:6], "both") if r[1] in ("u0", "u2") else r for r in good])
    assert apart["action_coverage_at_bound"] == ("FAIL", "3")
    assert gates([*good, ("q9", "u9", "c9", 7, "HAU", "multi", None)])["fold_ids"] == ("FAIL", "0,1,7")
    assert gates([*good, ("q9", "u9", "c9", None, "HAU", "multi", None)])["questions_assigned_once"][0] == "FAIL"


def test_engine_metrics_are_numbers_or_missing(spark):
    rows = [(0, None), (1, "{}"), (2, '{"num_cached_tokens": 0}'), (3, '{"num_cached_tokens": "12", "cached_tokens": true, "cache_metrics": {"num_cached_tokens": 7.5}}'), (4, '{"e2e_latency": 1e-3, "kv_cache_metrics": null}'), (5, "[1]"), (6, '{"other": 3}')]
    df = spark.createDataFrame(rows, "i int, text string").select("i", F.parse_json("text").alias("metrics"))
    got = {r["i"]: (r["reported"], r["num_cached_tokens"], r["e2e_latency"]) for r in profiling.engine_metrics(df).collect()}
    assert got == {0: (False, None, None), 1: (False, None, None), 2: (True, 0.0, None), 3: (True, 7.5, None), 4: (True, None, 0.001), 5: (False, None, None), 6: (False, None, None)}
