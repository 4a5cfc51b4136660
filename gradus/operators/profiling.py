"""Timing summaries of runs: exact percentiles, warm-up, phases, coverage, batches, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .percentiles import PERCENTILES, summary  # noqa: F401

#: Requests (or steps) at a run's start that steady-state figures leave out.
WARMUP = 3


def _keys(keys: list[str] | tuple[str, ...]) -> list[Column]:
    return [F.col(k) for k in keys]


def describe(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """count, total, mean, min, max, population deviation and percentiles of a series; nulls do not count."""
    return summary(rows, value, keys).drop("requests")


def reported(c: Column | str) -> Column:
    """A measured value, or null if it is not a finite number from 0 on."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when((c >= 0) & ~F.isnan(c) & (c < float("inf")), c)


def coverage(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of the values that were reported, and the share of rows that reported one."""
    return summary(rows.withColumn(value, reported(value)), value, keys).withColumn("coverage", F.try_divide("count", "requests"))


def steady(rows: DataFrame, keys: tuple[str, ...], order: list[str], warmup: int = WARMUP) -> DataFrame:
    """Rows after the warm-up of each run; all of a run that is no longer than that."""
    w = W.partitionBy(*keys)
    return rows.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).where(f"_rn > {warmup} or _n <= {warmup}").drop("_rn", "_n")


def with_overhead(rows: DataFrame, total: str = "total_ms", parts: tuple[str, ...] = ("image_ms", "generate_ms")) -> DataFrame:
    """Adds what is left of the total after its parts, 0 at least."""
    rest = F.col(total)
    for p in parts:
        rest = rest - F.col(p)
    return rows.withColumn("overhead_ms", F.greatest(F.lit(0.0), rest))


def phase_shares(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each phase and its share of the mean total."""
    phases = ("image_ms", "generate_ms", "overhead_ms")
    out = rows.groupBy(*_keys(keys)).agg(F.avg("total_ms").alias("total_ms"), *(F.avg(p).alias(p) for p in phases))
    return out.select(*keys, "total_ms", *phases, *(F.try_divide(F.col(p), F.col("total_ms")).alias(f"{p[:-3]}_share") for p in phases))


def throughput(rows: DataFrame, keys: tuple[str, ...], order: list[str], warmup: int = WARMUP) -> DataFrame:
    """Requests a second over a whole run and in its steady state, valid rate and tokens a second there."""
    per_second = lambda n, ms: F.coalesce(F.try_divide(n, F.sum(ms) / 1000.0), F.lit(0.0))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("requests"), per_second(F.count("*"), "total_ms").alias("run_rps"))
    late = steady(rows, keys, order, warmup).groupBy(*keys).agg(
        F.count("*").alias("steady_requests"), per_second(F.count("*"), "total_ms").alias("steady_rps"),
        F.try_divide(F.count_if(F.col("status") == "valid"), F.count("*")).alias("steady_valid_rate"),
        F.try_divide(F.nullif(F.sum(F.coalesce("generation_tokens", F.lit(0))), F.lit(0)), F.sum("total_ms") / 1000.0).alias("steady_token_rate"),
    )
    return whole.join(late, list(keys)).withColumn("warmup_skipped", F.col("requests") - F.col("steady_requests"))


def batch_view(batches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Batches, requests, means, requests and tokens a second, and milliseconds per request."""
    seconds = F.sum("batch_ms") / 1000.0
    return batches.groupBy(*_keys(keys)).agg(
        F.count("*").alias("batches"), F.sum("size").alias("requests"), F.sum("batch_ms").alias("total_ms"), F.avg("batch_ms").alias("mean_batch_ms"), F.avg("size").alias("mean_batch_size"),
        F.coalesce(F.try_divide(F.sum("size"), seconds), F.lit(0.0)).alias("throughput_rps"),
        F.try_divide(F.nullif(F.sum("generation_tokens"), F.lit(0)), seconds).alias("token_rate"),
        F.try_divide(F.sum("batch_ms"), F.sum("size")).alias("amortized_ms"),
    )


def engine_batches(requests: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Largest and mean first-token time and token sums of each batch; sums of nothing are null."""
    return requests.groupBy(*keys).agg(
        F.max("ttft_ms").alias("ttft_max"), F.avg("ttft_ms").alias("ttft_mean"),
        F.nullif(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.nullif(F.sum("generation_tokens"), F.lit(0)).alias("generation_tokens"),
    )


# The engine's own fields, the spellings of tokens served from its prefix cache, and where these may be nested.
ENGINE_FIELDS = ("first_token_latency", "e2e_latency", "num_prompt_tokens", "num_generation_tokens", "queued_ts", "scheduled_ts")
CACHED_FIELDS = ("num_cached_tokens", "num_prefix_cached_tokens", "cached_tokens", "prefix_cache_hit_tokens", "num_cached_prompt_tokens")
CACHE_GROUPS = ("kv_cache_metrics", "prefix_cache_stats", "cache_metrics")


def measured(metrics: Column, *path: str) -> Column:
    """The number at a path of a VARIANT as a double; null where there is none, or something else than a number."""
    at = "$." + ".".join(path)
    found = F.try_variant_get(metrics, at, "variant")
    number = F.regexp_like(F.schema_of_variant(found), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    return F.when(number, F.try_variant_get(metrics, at, "double"))


def engine_metrics(rows: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Adds what an engine's metrics (a VARIANT, other fields in each release) report: the engine's fields, num_cached_tokens, reported.

    Cached tokens are looked for under all spellings, on top before groups. What is not reported stays null, never 0.
    """
    m = F.col(metrics)
    found = {c: measured(m, c) for c in ENGINE_FIELDS}
    found["num_cached_tokens"] = F.coalesce(*(measured(m, c) for c in CACHED_FIELDS), *(measured(m, g, c) for g in CACHE_GROUPS for c in CACHED_FIELDS))
    rows = rows.withColumns(found)
    return rows.withColumn("reported", F.coalesce(*(F.col(c) for c in found)).isNotNull())


def metric_fields(rows: DataFrame, metrics: str = "metrics") -> DataFrame:
    """field, type, rows: which fields the engine's metrics have, with those of groups under ``group.field``; each release has its own."""
    spark = rows.sparkSession
    top = rows.select(metrics).lateralJoin(spark.tvf.variant_explode(F.col(metrics).outer())).select("key", "value")
    inner = top.where(F.col("key").isin(*CACHE_GROUPS)).select(F.col("key").alias("group"), F.col("value").alias("inner"))
    inner = inner.lateralJoin(spark.tvf.variant_explode(F.col("inner").outer())).select(F.concat_ws(".", "group", "key").alias("key"), "value")
    every = top.union(inner).select(F.col("key").alias("field"), F.regexp_replace(F.schema_of_variant("value"), "[<(].*", "").alias("type"))
    return every.groupBy("field", "type").agg(F.count("*").alias("rows"))


def prefix_hits(requests: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cached over prompt tokens of the requests that report both; null where none has prompt tokens."""
    ok = F.col("cached_tokens").isNotNull() & F.col("prompt_tokens").isNotNull()
    part = lambda c: F.sum(F.when(ok, F.col(c)))
    return requests.groupBy(*_keys(keys)).agg(F.try_divide(part("cached_tokens"), part("prompt_tokens")).alias("hit_rate"), F.count_if(ok).alias("reported"), F.count_if(~ok).alias("not_reported"))


def slowest(rows: DataFrame, value: str, tie: str, limit: int = 5) -> DataFrame:
    """The slowest requests, earlier first among equals (a report)."""
    return rows.orderBy(F.col(value).desc(), tie).limit(limit)


def memory(readings: DataFrame, keys: tuple[str, ...] = ("device",)) -> DataFrame:
    """First, last and largest use, least free memory, samples and growth of each device."""
    return readings.groupBy(*keys).agg(
        F.min_by("used_mib", "ts").alias("first_used"), F.max_by("used_mib", "ts").alias("last_used"), F.max("used_mib").alias("max_used"), F.min("free_mib").alias("min_free"),
        F.count("*").alias("samples"), (F.max_by("used_mib", "ts") - F.min_by("used_mib", "ts")).alias("growth"),
    )


def memory_table(after: DataFrame, sampled: DataFrame, peaks: DataFrame) -> DataFrame:
    """Each device's reading with its sampled and allocator peaks where there are any."""
    return after.join(sampled, "device", "left").join(peaks, "device", "left")


def run_facts(runs: DataFrame) -> DataFrame:
    """Derived columns of runs (targets, resumed, elapsed_s, load_s, backend): inference time and rates.

    Engine load is no request's time. A run that was resumed to its end executed nothing and is not
    measured, nor is one that names no backend.
    """
    spent = F.greatest(F.lit(0.0), F.coalesce("elapsed_s", F.lit(0.0)) - F.coalesce("load_s", F.lit(0.0)))
    return (
        runs.withColumn("inference_s", spent)
        .withColumn("executed", F.col("targets") - F.coalesce("resumed", F.lit(0)))
        .withColumn("measured", (F.col("executed") > 0) & (F.coalesce("backend", F.lit("")) != ""))
        .withColumn("s_per_request", F.try_divide("inference_s", "targets"))
        .withColumn("rps", F.try_divide("targets", "inference_s"))
    )


def training_steps(steps: DataFrame, keys: tuple[str, ...], samples_per_step: int, warmup: int = WARMUP) -> DataFrame:
    """Steps, steady samples a second and the data loader's share of step time where it was measured."""
    late = steady(steps, keys, ["step"], warmup).groupBy(*keys).agg(F.try_divide(F.count("*") * samples_per_step, F.sum("step_ms") / 1000.0).alias("samples_per_s"), F.count("*").alias("steady_steps"))
    every = steps.groupBy(*keys).agg(F.count("*").alias("steps"), F.try_divide(F.sum("dataloader_ms"), F.sum("step_ms")).alias("dataloader_share"))
    return every.join(late, list(keys))
