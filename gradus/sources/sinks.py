"""Sinks: ordered CSV and JSON lines, writes that refuse to change what is there, locks."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_predictions(records: DataFrame, targets: DataFrame, path: str) -> None:
    """Valid predictions in target order as one CSV file."""
    rows = records.where("status = 'valid'").select("qa_id", "prediction").join(targets.select("qa_id", "pos"), "qa_id")
    rows.orderBy("pos").select("qa_id", "prediction").coalesce(1).write.mode("errorifexists").csv(path, header=True, lineSep="\n")


def write_submission(records: DataFrame, template: DataFrame, path: str) -> None:
    """A prediction for every template row in its order; ids must be the same on both sides."""
    a, b = template.select("qa_id"), records.where("status = 'valid'").select("qa_id")
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("template and valid records differ in ids")
    write_predictions(records, template, path)


def json_lines(rows: DataFrame) -> DataFrame:
    """Each row as JSON text with its fields in order of name and nulls kept."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    json_lines(rows).write.mode("errorifexists").text(path)


def content_hash(rows: DataFrame) -> str:
    """A hash of a table's rows that does not depend on their order."""
    h = F.xxhash64("value")
    got = json_lines(rows).agg(F.count("*"), F.sum(h.cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{got[0]}:{got[1]}".encode()).hexdigest()


def write_once(rows: DataFrame, path: str) -> bool:
    """Write a Parquet table, or confirm that the same rows are there; others are refused."""
    spark = rows.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        rows.write.parquet(path)
        return True
    if content_hash(spark.read.parquet(path)) != content_hash(rows):
        raise ValueError(f"{path} holds other rows")
    return False


def atomic_write(path: str, content: bytes) -> None:
    """Small driver-side files: written beside their place, flushed, and moved there at once."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


@contextmanager
def run_lock(folder: str) -> Iterator[None]:
    """Only one driver works on a run's folder at a time."""
    os.makedirs(folder, exist_ok=True)
    name = os.path.join(folder, ".lock")
    handle = os.open(name, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        os.write(handle, str(os.getpid()).encode())
        yield
    finally:
        os.close(handle)
        os.unlink(name)


def bench_json(runs: DataFrame) -> DataFrame:
    """Run facts without predictions and backend metadata, as JSON text."""
    return json_lines(runs.drop("predictions", "backend_metadata"))
