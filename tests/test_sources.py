import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gradus.operators import validation
from gradus.sources import archives, files, sinks
from gradus.streaming import live

QA = "qa_id,source,path,category,question,A,B,C,D\n"


def put(folder, name, content):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(content, encoding="utf-8")
    return str(p)


def test_strict_csv(spark, tmp_path):
    path = put(tmp_path, "qa.csv", "﻿" + QA + 'q1,HAU,p,single,"a, ""b""\nc",1,2,3,\nq2,HAU,p,multi,x,1,2,3,4\n')
    rows = files.read_qa(spark, path, 2).orderBy("pos").collect()
    assert rows[0]["question"] == 'a, "b"\nc' and rows[0]["D"] == "" and [r["pos"] for r in rows] == [0, 1]
    with pytest.raises(files.SourceError):
        files.read_qa(spark, path, 3)


@pytest.mark.parametrize("text", ["a,a\n1,2\n", "a,\n1,2\n", "a,b\n", "a,b\n1\n", "a,b\n1,2,3\n"])
def test_broken_csv(spark, tmp_path, text):
    with pytest.raises(files.SourceError):
        files.read_csv(spark, put(tmp_path, "x.csv", text))


def test_columns(spark, tmp_path):
    path = put(tmp_path, "x.csv", "b,a\n1,2\n")
    assert files.read_csv(spark, path, ("a", "b"), mode="set").first()["a"] == "2"
    with pytest.raises(files.SourceError):
        files.read_csv(spark, path, ("a", "b"), mode="ordered")


def test_manifest_and_files(spark, tmp_path):
    put(tmp_path, "root/a.txt", "hello")
    put(tmp_path, "root/sub/b.txt", "x")
    seen = files.read_files(spark, str(tmp_path / "root"))
    by = {r["path"]: r for r in seen.collect()}
    assert set(by) == {"a.txt", "sub/b.txt"} and by["a.txt"]["bytes"] == 5
    m = put(tmp_path, "m.json", json.dumps({"schema_version": 1, "baseline_id": "x", "files": [{"path": "data/a.txt", "bytes": 5, "sha256": by["a.txt"]["sha256"]}, {"path": "data/c.txt", "bytes": 1, "sha256": "0"}]}))
    problems = {(r["path"], r["problem"]) for r in validation.file_report(files.read_manifest(spark, m, "x"), seen).collect()}
    assert problems == {("c.txt", "missing"), ("sub/b.txt", "unexpected")}
    with pytest.raises(files.SourceError):
        files.read_manifest(spark, m, "other")


def test_checkpoint(spark, tmp_path):
    from gradus.functions.hashing import fingerprint

    rows = spark.createDataFrame([("q1", "valid", "A", "A", None, 1, "s", "h", ["f"])], files.CHECKPOINT.rsplit(",", 1)[0])
    rows = rows.withColumn("record_sha256", fingerprint(*files.RECORD))
    sinks.write_json_lines(rows, str(tmp_path / "c"))
    back = files.read_checkpoint(spark, str(tmp_path / "c"))
    targets = spark.createDataFrame([("q1", 0), ("q2", 1)], "qa_id string, pos int")
    report = {r["code"]: r["status"] for r in validation.run_report(back, targets, "PASS").collect()}
    assert report == {"unique_records": "PASS", "known_records": "PASS", "record_hashes": "PASS", "claimed_status": "FAIL"}
    forged = back.withColumn("record_sha256", F.lit("x"))
    assert {r["code"] for r in validation.run_report(forged, targets, "INCOMPLETE").where("status = 'FAIL'").collect()} == {"record_hashes"}


def test_runs(spark, tmp_path):
    put(tmp_path, "out/a/b/run_summary.json", json.dumps({"status": "PASS", "target_ids": ["q1", "q2"], "elapsed_seconds": 10.0, "counts": {"valid": 2}, "backend": {"load_seconds": 4.0}}))
    put(tmp_path, "out/a/b/resume_state.json", json.dumps({"contract": {"engine": "fast", "dataset": "test"}}))
    put(tmp_path, "out/c/run_summary.json", json.dumps({"status": "INCOMPLETE"}))
    got = {r["run_id"]: r for r in files.discover_runs(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {"a/b", "c"} and got["a/b"]["engine"] == "fast" and got["a/b"]["targets"] == 2 and got["c"]["engine"] == "transformers"


def test_preferred_predictions(spark):
    a = spark.createDataFrame([("r1", "q1", "A")], "run_id string, qa_id string, prediction string")
    b = spark.createDataFrame([("r1", "q1", "B", "valid"), ("r2", "q1", "C", "valid"), ("r2", "q2", "D", "failed")], "run_id string, qa_id string, prediction string, status string")
    assert {tuple(r) for r in files.preferred_predictions(a, b).collect()} == {("r1", "q1", "A"), ("r2", "q1", "C")}


def test_sinks(spark, tmp_path):
    template = spark.createDataFrame([("q2", 0), ("q1", 1)], "qa_id string, pos int")
    records = spark.createDataFrame([("q1", "valid", "A"), ("q2", "valid", "B")], "qa_id string, status string, prediction string")
    sinks.write_submission(records, template, str(tmp_path / "s"))
    text = next((tmp_path / "s").glob("part-*")).read_text()
    assert text == "qa_id,prediction\nq2,B\nq1,A\n"
    with pytest.raises(ValueError):
        sinks.write_submission(records.where("qa_id = 'q1'"), template, str(tmp_path / "t"))
    assert sinks.write_once(records, str(tmp_path / "w")) and not sinks.write_once(records, str(tmp_path / "w"))
    with pytest.raises(ValueError):
        sinks.write_once(records.limit(1), str(tmp_path / "w"))
    with sinks.run_lock(str(tmp_path / "l")), pytest.raises(FileExistsError), sinks.run_lock(str(tmp_path / "l")):
        pass


def test_archives(spark, tmp_path):
    one, two = str(tmp_path / "a.zip"), str(tmp_path / "b.zip")
    content = {"x/a.txt": b"hello" * 10, "b.txt": b""}
    archives.write_archive(one, content, "m.json", {"id": 1})
    archives.write_archive(two, content, "m.json", {"id": 1})
    assert open(one, "rb").read() == open(two, "rb").read()
    manifest = spark.createDataFrame(json.loads(zipfile.ZipFile(one).read("m.json"))["files"], "path string, bytes long, sha256 string")
    entries = archives.read_entries(spark, one)
    assert validation.verdict(validation.archive_report(entries, manifest, "m.json", 100)).first()["status"] == "PASS"
    bad = entries.withColumn("name", F.regexp_replace("name", "^b.txt", "../b.txt"))
    assert validation.verdict(validation.archive_report(bad, manifest, "m.json", 1 << 30)).first()["failed"] == ["archive_bytes", "manifest_entries", "safe_names"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(src)
    schema = spark.read.parquet(src).schema
    events = spark.readStream.schema(schema).parquet(src)
    q = live.live_latency(events.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("memory").queryName("lat").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("lat").agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()

    def run(rows):
        return rows.select(F.col("event_id").cast("string").alias("qa_id"), F.lit("valid").alias("status"))

    named = events.withColumn("qa_id", F.col("event_id").cast("string"))
    for _ in range(2):
        live.resume_into(named, str(tmp_path / "out"), str(tmp_path / "ck"), run).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(src).select("event_id").distinct().count()
