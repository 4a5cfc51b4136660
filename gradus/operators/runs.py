"""Runs: targets and resuming, batches and replicas, attempts, repeats, fail-fast, generation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import numbered


def first_targets(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows by position; before any resuming, so a resumed run has the same targets."""
    if limit is None:
        return rows
    if limit <= 0:
        raise ValueError("limit must be positive")
    if limit > (n := rows.count()):
        raise ValueError(f"limit {limit} is beyond the {n} rows")
    return rows.where(F.col("pos") < limit)


def pending(targets: DataFrame, records: DataFrame, id_col: str = "qa_id") -> DataFrame:
    """Targets without a valid record; invalid and failed ones are tried again. Records of other ids are refused."""
    if (row := unknown_records(targets, records, id_col).first()) is not None:
        raise ValueError(f"record of an id that is no target: {row[id_col]}")
    return targets.join(records.where("status = 'valid'").select(id_col), id_col, "left_anti")


def unknown_records(targets: DataFrame, records: DataFrame, id_col: str = "qa_id") -> DataFrame:
    return records.join(targets.select(id_col), id_col, "left_anti")


def status_counts(targets: DataFrame, records: DataFrame, id_col: str = "qa_id") -> DataFrame:
    """valid, invalid, failed and pending, and PASS only if every target is valid."""
    rows = targets.select(id_col).join(records.select(id_col, "status"), id_col, "left")
    out = rows.agg(F.count("*").alias("targets"), *(F.count_if(F.col("status") == s).alias(s) for s in ("valid", "invalid", "failed")), F.count_if(F.col("status").isNull()).alias("pending"))
    return out.withColumn("result", F.when((F.col("targets") > 0) & (F.col("valid") == F.col("targets")), "PASS").otherwise("INCOMPLETE"))


def upsert(records: DataFrame, new: DataFrame, id_col: str = "qa_id") -> DataFrame:
    """New records over old ones, each with one more attempt than before."""
    tried = new.drop("attempts").join(records.select(id_col, F.col("attempts").alias("_n")), id_col, "left").withColumn("attempts", F.coalesce("_n", F.lit(0)) + 1).drop("_n")
    return records.join(new.select(id_col), id_col, "left_anti").unionByName(tried.select(*records.columns))


def batches(rows: DataFrame, order: list[str], size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``batch``: consecutive rows by ``size``; without keys over all rows, by `numbered` (which then runs its jobs)."""
    if keys:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
        return rows.withColumn("batch", F.floor(place / size).cast("int"))
    rows, _ = numbered(rows, order, "_row")
    return rows.withColumn("batch", F.expr(f"_row div {size}")).drop("_row")


def replica_blocks(rows: DataFrame, order: list[str], replicas: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``replica``: contiguous blocks of equal size, the first ones one longer."""
    if keys:
        return rows.withColumn("replica", F.ntile(replicas).over(W.partitionBy(*keys).orderBy(*order)) - 1)
    rows, n = numbered(rows, order, "_row")
    size, longer = divmod(n, replicas)
    head = longer * (size + 1)
    block = F.when(F.col("_row") < head, F.expr(f"_row div {size + 1}")).otherwise(F.expr(f"{longer} + (_row - {head}) div {max(1, size)}"))
    return rows.withColumn("replica", block.cast("int")).drop("_row")


def round_robin(rows: DataFrame, order: list[str], replicas: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``replica``: rows dealt in turn."""
    if keys:
        return rows.withColumn("replica", F.pmod(F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1, F.lit(replicas)))
    rows, _ = numbered(rows, order, "_row")
    return rows.withColumn("replica", F.pmod("_row", F.lit(replicas)).cast("int")).drop("_row")


def until_failure(rows: DataFrame, keys: tuple[str, ...], seq: str = "seq", batch: str | None = None) -> DataFrame:
    """Rows up to the first that is not valid; with batches, to the end of its batch."""
    at = batch or seq
    bad = F.min(F.when(F.col("status") != "valid", F.col(at))).over(W.partitionBy(*keys))
    return rows.withColumn("_bad", bad).where(F.col("_bad").isNull() | (F.col(at) <= F.col("_bad"))).drop("_bad")


def first_mismatch(actual: DataFrame, expected: DataFrame, id_col: str = "qa_id") -> DataFrame:
    """1-based place of the first row whose id differs, over the places that both have."""
    both = actual.select("pos", F.col(id_col).alias("x")).join(expected.select("pos", F.col(id_col).alias("y")), "pos")
    return both.agg(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("pos") + 1)).alias("row"))


def best_repeats(runs: DataFrame, key: list[str], rate: str = "throughput_rps", order: str = "pos") -> DataFrame:
    """The fastest single measured run of each configuration that was measured at least twice, the earlier one of equals."""
    w = W.partitionBy(*key)
    ok = runs.where(F.col(rate).isNotNull() & F.col("measured"))
    ok = ok.withColumn("repeats", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.col(rate).desc(), order)))
    return ok.where("repeats >= 2 and _rn = 1").drop("_rn")


def config_label(dp: str = "data_parallel", tp: str = "tensor_parallel", batch: str = "batch_size", seqs: str = "max_seqs"):
    """Short name of a configuration: kind of parallelism with its width, and batch size."""
    d, t = F.coalesce(dp, F.lit(1)), F.coalesce(tp, F.lit(1))
    return F.concat(F.when(d > 1, F.concat(F.lit("DP"), d)).otherwise(F.concat(F.lit("TP"), t)), F.lit("-B"), F.coalesce(F.nullif(F.col(batch), F.lit(0)), F.coalesce(seqs, F.lit(1)) * d))


def capacity_errors(configs: DataFrame) -> DataFrame:
    """Configurations whose batch exceeds what all replicas take at once, or that use both kinds of parallelism."""
    d, t = F.coalesce("data_parallel", F.lit(1)), F.coalesce("tensor_parallel", F.lit(1))
    return configs.where((F.coalesce("batch_size", F.lit(1)) > F.coalesce("max_seqs", F.lit(1)) * d) | ((d > 1) & (t > 1)))


def latest_complete(checkpoints: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """The checkpoint of the highest step whose receipt verifies."""
    return checkpoints.where("verified").groupBy(*keys).agg(F.max("step").alias("step"), F.max_by("path", "step").alias("path"))


def same_contract(signature: str, stored: str | None) -> None:
    """A run may be resumed only under the contract that it began with."""
    if stored is not None and stored != signature:
        raise ValueError("the stored run has another signature")


class Backend(Protocol):
    """What generates answers: loaded once per task, asked batch by batch."""

    def generate_batch(self, prompts: list[str], allowed: list[list[str]]) -> list[str]: ...

    def close(self) -> None: ...


def generate(requests: DataFrame, factory: Callable[[], Backend], id_col: str = "qa_id") -> DataFrame:
    """raw_output of each request (id, prompt, allowed: array), one backend per task; a request that fails has an error."""
    schema = f"{id_col} string, raw_output string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend: Any = None
        try:
            for f in frames:
                if not len(f):
                    continue
                backend = backend or factory()
                try:
                    out, bad = backend.generate_batch(list(f["prompt"]), [list(a) for a in f["allowed"]]), None
                except Exception as e:  # noqa: BLE001 - a failed batch is a result, not the end of the run
                    out, bad = [None] * len(f), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({id_col: f[id_col], "raw_output": out, "error": [bad] * len(f)})
        finally:
            if backend is not None:
                backend.close()

    return requests.select(id_col, "prompt", "allowed").mapInPandas(run, schema)
