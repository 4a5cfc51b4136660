import os
import random

import pytest
from pyspark.sql import functions as F

from gradus.operators import runs
from gradus.streaming import stateful

RUN = "run string, seq long, batch long, status string"


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stateful.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream(spark, folder, batches, schema):
    """A stream that takes one of the tables in each micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
        for f in os.listdir(f"{folder}/in/{k}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{folder}/all", exist_ok=True)
                os.rename(f"{folder}/in/{k}/{f}", f"{folder}/all/{k}.parquet")
                os.utime(f"{folder}/all/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/all")


def drained(out, folder):
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.parquet(f"{folder}/out")


def run_rows(seed):
    r = random.Random(seed)
    rows = {f"r{k}": [(f"r{k}", i, i // 4, "valid" if r.random() < 0.93 else r.choice(["failed", "invalid"])) for i in range(24)] for k in range(9)}
    parts = [[x for v in rows.values() for x in v[a:e]] for a, e in ((0, 7), (7, 15), (15, 24))]
    return parts, [x for p in parts for x in p]


@pytest.mark.parametrize("batch", [None, "batch"])
def test_until_failure(spark, store, tmp_path, batch):
    parts, every = run_rows(4)
    redelivered = [parts[0], parts[1], parts[1], parts[2]]
    got = drained(stateful.until_failure_stream(stream(spark, str(tmp_path), redelivered, RUN), "run", "seq", batch), str(tmp_path))
    want = runs.until_failure(spark.createDataFrame(every, RUN), ("run",), "seq", batch)
    found = sorted(tuple(r) for r in got.select("run", "seq", "batch", "status").collect())
    assert found == sorted(tuple(r) for r in want.select("run", "seq", "batch", "status").collect())
    assert 0 < len(found) < len(every)


def test_attempts(spark, store, tmp_path):
    schema = "qa_id string, seq long, status string"
    known = spark.createDataFrame([("q0", "failed", 2), ("q1", "invalid", 1), ("q8", "valid", 4)], "qa_id string, status string, attempts int")
    r = random.Random(5)
    parts, seq = [], 0
    for _ in range(3):
        part = []
        for i in sorted(r.sample(range(6), 4)):
            seq += 1
            part.append((f"q{i}", seq, r.choice(["valid", "failed"])))
        parts.append(part)
    out = stateful.attempts_stream(stream(spark, str(tmp_path), [parts[0], parts[0], parts[1], parts[2]], schema), known)
    got = drained(out, str(tmp_path))
    assert got.count() == sum(map(len, parts))
    table = known
    for part in parts:
        new = spark.createDataFrame(part, schema).drop("seq").withColumn("attempts", F.lit(0))
        table = spark.createDataFrame(runs.upsert(table, new).collect(), known.schema)
    last = got.groupBy("qa_id").agg(F.max_by("status", "attempts").alias("status"), F.max("attempts").alias("attempts"))
    of_stream = known.join(last.select("qa_id"), "qa_id", "left_anti").unionByName(last)
    assert sorted(map(tuple, of_stream.collect())) == sorted(map(tuple, table.select("qa_id", "status", "attempts").collect()))


def test_a_restart_goes_on_from_the_state(spark, store, tmp_path):
    parts, every = run_rows(6)
    want = sorted(tuple(r) for r in runs.until_failure(spark.createDataFrame(every, RUN), ("run",), "seq").collect())
    for k in range(3):
        rows = stream(spark, str(tmp_path / f"s{k}"), parts[k : k + 1], RUN)
        del rows
        os.makedirs(tmp_path / "all", exist_ok=True)
        os.rename(tmp_path / f"s{k}" / "all" / "0.parquet", tmp_path / "all" / f"{k}.parquet")
        rows = spark.readStream.schema(RUN).parquet(str(tmp_path / "all"))
        got = drained(stateful.until_failure_stream(rows, "run", "seq"), str(tmp_path))
    assert sorted(tuple(r) for r in got.select("run", "seq", "batch", "status").collect()) == want
