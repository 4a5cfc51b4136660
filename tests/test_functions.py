import hashlib

import pytest
from pyspark.sql import functions as F

from gradus.functions import answers, arrays, hashing, paths, prompts, text

ACCEPTED = [(" a ", "single", "A"), ("CA", "multi", "AC"), ("A", "multi", "A"), ("CADB", "sequence", "CADB"), ("D", "emotion", "D"), ("b", " Single ", "B")]
REJECTED = [
    ("", "single", "ABCD", "empty"), (None, "single", "ABCD", "empty"), ("AA", "multi", "ABCD", "duplicate"), ("AB", "single", "ABCD", "exactly one"), ("D", "single", "ABC", "unavailable option(s): D"),
    ("A,C", "multi", "ABCD", "only letters"), ("ACC", "multi", "ABCD", "duplicate"), ("ABC", "sequence", "ABCD", "permutation"), ("AABC", "sequence", "ABCD", "duplicate"), ("ABCE", "sequence", "ABCD", "only letters"),
    ("A", "unknown", "ABCD", "unknown category"), ("A", "single", "", "no available"),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_accepted_answers(spark):
    rows = spark.createDataFrame(ACCEPTED, "v string, c string, want string")
    for r in answers.with_assessment(rows, "v", "c", F.lit("ABCD"), "a").collect():
        assert r["a"]["canonical"] == r["want"] and r["a"]["error"] is None


def test_rejected_answers(spark):
    rows = spark.createDataFrame(REJECTED, "v string, c string, o string, why string")
    for r in answers.with_assessment(rows, "v", "c", "o", "a").collect():
        assert r["a"]["canonical"] is None and r["why"] in r["a"]["error"], r


@pytest.mark.parametrize(
    "raw, kind, options, prediction, method",
    [
        ("BA", "sequence", "AB", "BA", "exact"), ("BA", "multi", "AB", "AB", "exact"), ("a, c", "multi", "ABCD", "AC", "exact"), ("Final answer: B", "single", "ABCD", "B", "labeled"),
        ("\\boxed{ A , C }", "multi", "ABCD", "AC", "boxed"), ("答案：D", "single", "ABCD", "D", "labeled"), ("answer A then \\boxed{B}", "single", "ABCD", None, "ambiguous"), ("dunno", "single", "ABCD", None, None),
        ("", "single", "ABCD", None, None), ("answer is A, \\boxed{A}", "single", "ABCD", "A", "boxed"),
    ],
)
def test_parse(spark, raw, kind, options, prediction, method):
    got = answers.with_parsed(spark.range(1), F.lit(raw), F.lit(kind), F.lit(options), "a").first()["a"]
    assert (got["prediction"], got["method"], got["is_valid"]) == (prediction, method, prediction is not None)
    assert (got["error"] is None) == (prediction is not None)


def test_answer_space(spark):
    rows = answers.answer_space(spark).where("options = 'AB'").orderBy("ord").collect()
    by = {}
    for r in rows:
        by.setdefault(r["category"], []).append(r["output"])
    assert by["sequence"] == ["AB", "BA"] and by["multi"] == ["A", "B", "AB"] and by["single"] == ["A", "B"]


def test_next_tokens(spark):
    outs = spark.createDataFrame([([1],), ([1, 2],), ([2],)], "output array<int>")
    prefixes = spark.createDataFrame([(1, []), (2, [1]), (3, [1, 2]), (4, [7])], "id int, prefix array<int>")
    got = {r["id"]: (r["tokens"], r["end"]) for r in answers.next_tokens(prefixes, outs).collect()}
    assert got == {1: ([1, 2], False), 2: ([2], True), 3: ([], True)}


def test_strip_follows_python(spark):
    for s in ("　a b ", "\x1c x\x1f", "\x85y\t", "plain", " "):
        assert one(spark, text.strip(F.lit(s))) == s.strip()
    assert one(spark, text.clean(F.lit(None).cast("string"))) == ""
    assert one(spark, text.squeeze(F.lit(" A  B\tc "))) == "a b c"


def test_prompt_and_leakage(spark):
    row = spark.createDataFrame([("Q?", "x", "y", "z", "", "sequence", "/clips/secret7")], "question string, A string, B string, C string, D string, category string, path string")
    p = row.select(prompts.prompt().alias("p"), F.col("path"))
    body = p.first()["p"]
    assert "permutation of ABC in" in body and body.endswith("Final answer:") and "D. " not in body
    leaky = p.withColumn("p", F.concat("p", F.lit(" /CLIPS/secret7 a.mp4 LM_test_3 C:\\")))
    assert leaky.select(prompts.leakage("p", ("path",))).first()[0] == ["path", "raw_video_extension", "test_clip_id", "windows_path"]
    assert p.select(prompts.leakage("p", ("path",))).first()[0] == []


def test_fingerprints(spark):
    row = spark.createDataFrame([("b", None, ["x", "中"])], "z string, a string, m array<string>")
    want = hashlib.sha256('{"a":null,"m":["x","中"],"z":"b"}'.encode()).hexdigest()
    assert row.select(hashing.fingerprint("z", "a", "m")).first()[0] == want
    got = row.withColumn("f", F.lit(1e-05)).select(hashing.fingerprint_any(F.struct("z", "f"))).first()[0]
    assert got == hashlib.sha256(b'{"f":1e-05,"z":"b"}').hexdigest()


def test_arrays(spark):
    assert one(spark, arrays.unpack(F.lit("1;2"), "int")) == [1, 2] and one(spark, arrays.unpack(F.lit(""))) == []
    near = F.array(F.lit(0.0), F.lit(1.0000009))
    assert one(spark, arrays.close(near, F.array(F.lit(0.0), F.lit(1.0)))) and not one(spark, arrays.close(near, F.array(F.lit(0.0))))
    assert one(spark, arrays.midpoints(4)) == [0.125, 0.375, 0.625, 0.875]
    assert one(spark, arrays.pick(F.array(*map(F.lit, "abcd")), [1, 3])) == ["b", "d"]
    row = spark.createDataFrame([([0, 5, 6, 7, 9, 0], [0, 1, 1, 1, 1, 0], [5, 6], [1, 1], [7])], "full array<int>, mask array<int>, prefix array<int>, pm array<int>, answer array<int>")
    assert row.select(arrays.completion_labels("full", "mask", "prefix", "pm", "answer", 9)).first()[0] == [-100, -100, -100, 7, 9, -100]
    assert row.select(arrays.completion_labels("full", "mask", "prefix", "pm", "answer", 8)).first()[0] is None


@pytest.mark.parametrize("name, ok", [("a/b.jpg", True), ("../a", False), ("/a", False), ("a//b", False), ("a\\b", False), ("c:x", False), ("a/./b", False), ("", False), ("a\nb", False)])
def test_safe_relative(spark, name, ok):
    assert one(spark, paths.safe_relative(F.lit(name))) is ok


def test_names(spark):
    assert one(spark, paths.clip_path(F.lit(" a\\b\\IR\\x.mp4 "))) == "a/b" and one(spark, paths.clip_path(F.lit("a/b/"))) == "a/b"
    assert one(spark, paths.is_run_id(F.lit("run_1-a"))) and not one(spark, paths.is_run_id(F.lit("-x")))
    assert one(spark, paths.trainable_module(F.lit("model.layers.0.self_attn.q_proj"))) and not one(spark, paths.trainable_module(F.lit("visual.layers.0.q_proj")))


def test_data_uri(spark):
    import base64

    raw = [b"", b"\x89PNG", bytes(range(256)) * 40]
    rows = spark.createDataFrame([(r,) for r in raw], "content binary").select(text.data_uri("content").alias("u"), text.data_uri("content", "image/jpeg").alias("j"))
    assert sorted(r["u"] for r in rows.collect()) == sorted("data:image/png;base64," + base64.b64encode(x).decode() for x in raw)
    assert rows.first()["j"].startswith("data:image/jpeg;base64,")
