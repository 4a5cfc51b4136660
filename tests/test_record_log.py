import random

import pytest
from pyspark.sql import functions as F

from gradus.operators import runs
from gradus.sources.files import SourceError
from gradus.sources.record_log import RecordLog

SCHEMA = "qa_id string, status string, attempts int, raw_output string"


def best(batches):
    out = {}
    for rows in batches:
        for r in rows:
            if r[0] not in out or (r[2], r[1], r[3] or "") > (out[r[0]][2], out[r[0]][1], out[r[0]][3] or ""):
                out[r[0]] = r
    return sorted(out.values())


def retries(seed, n):
    """Batches in which ids are tried again and again."""
    r, tried, out = random.Random(seed), {}, []
    for _ in range(n):
        rows = []
        for i in r.sample(range(30), 8):
            tried[i] = tried.get(i, 0) + 1
            rows.append((f"q{i}", r.choice(["valid", "invalid", "failed"]), tried[i], r.choice([None, "A", "B"])))
        out.append(rows)
    return out


def got(log):
    return sorted(tuple(r) for r in log.read().select("qa_id", "status", "attempts", "raw_output").collect())


def test_many_retries_and_compactions(spark, tmp_path):
    log, batches = RecordLog(spark, str(tmp_path / "log")), retries(1, 12)
    with pytest.raises(SourceError):
        log.read()
    for k, rows in enumerate(batches):
        log.append(spark.createDataFrame(rows, SCHEMA).coalesce(1))
        if k % 2:
            version = log.compact(fan=2)
            assert log.segments() == [] and len({r["level"] for r in version.runs}) == len(version.runs)
            assert got(log) == best(batches[: k + 1])
    assert version.number == 6 and max(r["level"] for r in version.runs) >= 3
    assert log.compact() == version  # nothing new
    with pytest.raises(ValueError):
        log.compact(fan=1)
    assert log.vacuum() > 0 and got(log) == best(batches)
    by_upsert = spark.createDataFrame([], SCHEMA)
    for rows in batches:
        by_upsert = spark.createDataFrame(runs.upsert(by_upsert, spark.createDataFrame(rows, SCHEMA)).collect(), SCHEMA)
    assert sorted((r["qa_id"], r["attempts"]) for r in by_upsert.collect()) == sorted((r[0], r[2]) for r in got(log))


def test_a_crash_between_write_and_publish_loses_nothing(spark, tmp_path, monkeypatch):
    log, batches = RecordLog(spark, str(tmp_path / "log")), retries(2, 4)
    for rows in batches[:2]:
        log.append(spark.createDataFrame(rows, SCHEMA))
    log.compact()
    for rows in batches[2:]:
        log.append(spark.createDataFrame(rows, SCHEMA))

    def crash(version):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(log, "_publish", crash)
        with pytest.raises(RuntimeError):
            log.compact(fan=2)
    again = RecordLog(spark, str(tmp_path / "log"))
    assert again.version().number == 1 and got(again) == best(batches)
    assert again.compact().number == 2 and got(again) == best(batches)
    assert again.vacuum() >= 4 and got(again) == best(batches)


def test_an_unfinished_segment_does_not_count_and_a_named_one_counts_once(spark, tmp_path):
    log = RecordLog(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([("q1", "valid", 1, "A")], SCHEMA)
    log.append(rows, "batch-0")
    log.append(rows.withColumn("attempts", F.lit(9)), "batch-0")
    assert got(log) == [("q1", "valid", 1, "A")]
    log.append(rows.withColumn("attempts", F.lit(5)), "batch-1")
    (tmp_path / "log" / "segments" / "batch-1" / "_SUCCESS").unlink()
    assert got(log) == [("q1", "valid", 1, "A")]
    log.append(rows.withColumn("attempts", F.lit(2)), "batch-1")
    log.compact()
    log.append(rows.withColumn("attempts", F.lit(7)), "batch-1")  # covered by now
    assert got(log) == [("q1", "valid", 2, "A")]


def test_one_of_two_writers_publishes(spark, tmp_path):
    one, two = RecordLog(spark, str(tmp_path / "log")), RecordLog(spark, str(tmp_path / "log"))
    one.append(spark.createDataFrame([("q1", "valid", 1, "A")], SCHEMA))
    real = two._run

    def slow(folders, level):
        one.compact()
        return real(folders, level)

    two._run = slow
    with pytest.raises(SourceError, match="another writer"):
        two.compact()
    assert one.version().number == 1 and got(two) == [("q1", "valid", 1, "A")]
    assert not [n for n in one._names("versions") if not n.endswith(".json")]
