"""Composed suites on files' rows, settings documents and lenient sources."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gradus.operators import evaluation, runs, suites
from gradus.sources import archives, files, settings
from gradus.sources.files import SourceError

SETTINGS = """
schema_version: 1
profile: small_v1
qa: a.csv
folds: b.csv
pilot: c.csv
fold_version: subject_grouped_v1
splits: {train: [0, 1, 2], dev: [3], confirm: [4]}
caches: [{frames_root: x, frame_index: y}]
lora: {r: 16, alpha: 32, dropout: 0.05}
optimizer: {learning_rate: 0.0002, epochs: 1, gradient_accumulation_steps: 8, warmup_ratio: 0.03, max_grad_norm: 0.3, seed: 42, max_sequence_length: 4096, optim: adamw_torch, dataloader_num_workers: 2}
"""


def test_settings():
    pytest.importorskip("yaml")
    good = settings.read_settings(SETTINGS)
    assert settings.training_errors(good, "small_v1") == []
    for text in ("a: 1\na: 2", "a: {b: 1, b: 1}", "1: 2", "- a", "a: [{x: 1, x: 2}]"):
        with pytest.raises(SourceError):
            settings.read_settings(text)
    assert settings.equal({"a": 1, "b": [2]}, {"b": [2], "a": 1}) and not settings.equal(True, 1) and not settings.equal(1, 1.0)
    assert settings.training_errors({**good, "schema_version": True}, "small_v1") == ["schema_version: True is not 1"]
    for part, key, value in (("lora", "r", 65), ("lora", "r", True), ("lora", "dropout", 1), ("optimizer", "epochs", 3), ("optimizer", "learning_rate", 0), ("optimizer", "optim", "sgd"), ("optimizer", "dataloader_num_workers", 9), ("optimizer", "seed", 0)):
        assert settings.training_errors({**good, part: {**good[part], key: value}}, "small_v1") == [f"{key}: out of range"]
    assert settings.training_errors({k: v for k, v in good.items() if k != "qa"}, "small_v1") == ["training: missing ['qa']"]
    assert len(settings.training_errors({**good, "caches": [], "splits": {}}, "small_v1")) == 2


def test_lenient_csv(spark, tmp_path):
    rows, why = files.try_csv(spark, f"{tmp_path}/none.csv", ("qa_id", "prediction"))
    assert rows.columns == ["pos", "qa_id", "prediction"] and rows.count() == 0 and "missing" in why
    (tmp_path / "twice.csv").write_text("a,a\n1,2\n")
    assert files.try_csv(spark, f"{tmp_path}/twice.csv", ("a",))[1]
    (tmp_path / "ok.csv").write_text("a,b\n1,2\n")
    rows, why = files.try_csv(spark, f"{tmp_path}/ok.csv", ("a",))
    assert why is None and rows.select("a", "b").collect() == [("1", "2")]


def test_questions_are_exact(spark, tmp_path):
    head = "qa_id,source,path,category,question,A,B,C,D\n"
    for n, (row, ok) in enumerate([("1,s,p,single,q?,a,b,c,d\n", True), (" 1,s,p,single,q?,a,b,c,d\n", False), ("1,s,p,Single,q?,a,b,c,d\n", False)]):
        (tmp_path / f"{n}.csv").write_text(head + row)
        if ok:
            assert files.read_qa(spark, f"{tmp_path}/{n}.csv", 1).count() == 1
        else:
            with pytest.raises(SourceError):
                files.read_qa(spark, f"{tmp_path}/{n}.csv", 1)


def test_targets_are_fixed(spark):
    rows = spark.range(4).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("qa_id"))
    assert runs.first_targets(rows, 4).count() == 4 and runs.first_targets(rows, None).count() == 4
    for limit in (0, 5):
        with pytest.raises(ValueError):
            runs.first_targets(rows, limit)
    records = spark.createDataFrame([("1", "valid"), ("2", "failed")], "qa_id string, status string")
    assert sorted(r["qa_id"] for r in runs.pending(rows, records).collect()) == ["0", "2", "3"]
    with pytest.raises(ValueError, match="no target"):
        runs.pending(rows.where("pos < 1"), records)


def test_order_over_blocks(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([0, 1, 9, 2, 3, 10, 4, 11])], "seq long, pos long")
    for block in (1, 2, 3, 100):
        assert sorted(r["pos"] for r in evaluation.order_violations(rows, block).collect()) == [2, 3, 4]


def test_taxonomy_order(spark):
    rows = spark.createDataFrame([(c,) for c in ("emotion", "zebra", "single", "sequence", "apple", "multi")], "category string")
    assert [r[0] for r in evaluation.in_taxonomy_order(rows).collect()] == ["single", "multi", "sequence", "emotion", "apple", "zebra"]


def test_cached_inputs(spark):
    """One good clip and one with a shared, a grey and an unregistered image."""
    row = lambda i, frames: (f"s{i}", f"q{i}", "1", f"k{i}", "HAU", "test", "ok", "IR", "h", "v", "1;2", "0.25;0.75", "1.0;2.0", "1.0;2.0", frames, f"c{i}/metadata.json")
    names = "sample_id qa_ids qa_count clip_key source split status modality config_hash protocol_version source_frame_indices normalized_positions target_timestamps_seconds actual_timestamps_seconds frame_paths metadata_path".split()
    frames = spark.createDataFrame([row(1, "c1/a;c1/b"), row(2, "c1/b;c2/z")], ", ".join(f"{n} string" for n in names))
    meta = lambda i, folder, found: (f"s{i}", f"k{i}", "HAU", "test", "ok", "IR", "h", "v", [f"q{i}"], 1, 2, 2, 2, 448, "letterbox", [0.25, 0.75], [1.0, 2.0], [1.0, 2.0], [1, 2], found, folder)
    schema = "sample_id string, clip_key string, source string, split string, status string, modality string, config_hash string, protocol_version string, qa_ids array<string>, qa_count int, num_frames int, requested_frames int, actual_frames int, image_size int, resize_mode string, normalized_positions array<double>, target_timestamps_seconds array<double>, actual_timestamps_seconds array<double>, source_frame_indices array<int>, frame_files array<string>, folder string"
    sidecars = spark.createDataFrame([meta(1, "c1", ["a", "b"]), meta(2, "c2", ["y", "z"])], schema)
    images = spark.createDataFrame([("c1/a", 448, 448, 3, True), ("c1/b", 448, 448, 3, True), ("c2/z", 448, 448, 1, True)], "path string, width int, height int, channels int, is_jpeg boolean")
    files_ = spark.createDataFrame([(p, 5, "ab") for p in ("c1/a", "c1/b", "c2/z", "c1/metadata.json", "c2/metadata.json")], "path string, bytes long, sha256 string")
    manifest = files_.where("path <> 'c2/z'").withColumn("bytes", F.when(F.col("path") == "c1/a", 6).otherwise(F.col("bytes")))
    qa = spark.createDataFrame([("q1", "HAU"), ("q2", "HAU")], "qa_id string, source string")
    fixed = {"status": "ok", "split": "test"}
    failed = lambda q: {r["code"]: r["observed"] for r in suites.cached_input_report(q, frames, sidecars, images, manifest, files_, fixed, q, n=2).where("status = 'FAIL'").collect()}
    assert failed(qa.where("qa_id = 'q1'")) == {"assets": "1"}
    assert failed(qa) == {"frame_files": "1", "frames_of_one_clip": "1", "images": "1", "assets_registered": "1", "assets": "2"}


def test_archives_are_bounded(tmp_path):
    path, content = f"{tmp_path}/a.zip", {"m/a.txt": b"one", "m/b/c.bin": bytes(range(256))}
    archives.write_archive(path, content, "m.json", {"id": 1}, ("m/",))
    assert archives.extract_archive(path, f"{tmp_path}/out", "m.json")["id"] == 1
    assert (tmp_path / "out/m/b/c.bin").read_bytes() == content["m/b/c.bin"]
    for bad in ({"x/a": b"1"}, {"m/../a": b"1"}, {"m.json": b"1"}):
        with pytest.raises(SourceError):
            archives.write_archive(path, bad, "m.json", {}, ("m/",))
    raw = (tmp_path / "a.zip").read_bytes()

    def remade(change) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(raw)) as a, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as b:
            entries = {i.filename: a.read(i) for i in a.infolist()}
            for name, data in change(entries).items():
                b.writestr(name, data)
        return out.getvalue()

    changes = [lambda e: e | {"m/a.txt": b"two"}, lambda e: e | {"m/extra": b""}, lambda e: {k: v for k, v in e.items() if k != "m/a.txt"}, lambda e: e | {"../up": b""}, lambda e: e | {"M/A.txt": b"one"}, lambda e: {k: v for k, v in e.items() if k != "m.json"}, lambda e: e | {"m/bomb": bytes(1 << 20)}]
    for n, change in enumerate(changes):
        (tmp_path / f"bad{n}.zip").write_bytes(remade(change))
        with pytest.raises(SourceError):
            archives.extract_archive(f"{tmp_path}/bad{n}.zip", f"{tmp_path}/bad{n}", "m.json")
        assert not (tmp_path / f"bad{n}").exists()
