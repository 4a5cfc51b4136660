"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, arrays, hashing, paths, prompts
from ..operators import evaluation, profiling, runs, splits, suites, validation
from .carriers import PREDICTIONS_SQL, QA_SQL, REQUESTS_SQL, judged_sql, predictions, qa, requests, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _assessed(spark: SparkSession, d: str, m: int = 3) -> DataFrame:
    return evaluation.assessed(qa(spark, d), predictions(spark, d, m).select("qa_id", "prediction"))


J, J5 = judged_sql(), judged_sql(PREDICTIONS_SQL.replace("k % 3 = 0 THEN reverse", "k % 5 = 0 THEN reverse"))
R = REQUESTS_SQL
W3 = "(SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS rn, count(*) OVER (PARTITION BY {k}) AS nn FROM ({r}))"
_DESCRIBE = "count({v}) AS count, sum({v}) AS total, avg({v}) AS mean, min({v}) AS min, max({v}) AS max, stddev_pop({v}) AS stdev, " + ", ".join(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {{v}}) AS p{p}" for p in (50, 90, 95, 99))
_ROUNDED = "count, round(total, 6) AS total, round(mean, 9) AS mean, min, max, round(stdev, 9) AS stdev, p50, p90, p95, p99"


def _round(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _check_sql(rules: dict[str, tuple[str, str]]) -> str:
    """A report's rows from (observed, passed) expressions over one-row queries."""
    return "\nUNION ALL ".join(f"SELECT '{code}' AS code, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status, CAST({seen} AS VARCHAR) AS observed" for code, (seen, ok) in rules.items())


def _zero_sql(source: str, rules: dict[str, str]) -> dict[str, tuple[str, str]]:
    """Rules that count the rows of ``source`` for which a condition holds, and pass at 0."""
    found = {code: f"(SELECT count(*) FROM {source} WHERE {bad})" for code, bad in rules.items()}
    return {code: (n, f"{n} = 0") for code, n in found.items()}


# ---------------------------------------------------------------- evaluation


@query("accuracy_cube", f"""
SELECT src AS source, kind AS category, count(*) FILTER (correct) AS correct, count(*) AS total, count(*) FILTER (bad IS NOT NULL) AS invalid,
       CASE grouping(src, kind) WHEN 0 THEN 'source,category' WHEN 1 THEN 'source' WHEN 2 THEN 'category' ELSE 'all' END AS grain,
       count(*) FILTER (correct) / count(*) AS accuracy
FROM ({J}) GROUP BY CUBE (src, kind)""")
def accuracy_cube(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.accuracy_cube(_assessed(spark, d))


@query("clip_macro", f"""SELECT count(*) AS clips, round(avg(m), 9) AS accuracy FROM (SELECT path, avg(CAST(correct AS INT)) AS m FROM ({J}) GROUP BY path)""")
def clip_macro(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluation.clip_macro(_assessed(spark, d)), accuracy=9)


@query("invalid_examples", f"""SELECT qa_id, kind AS category, raw, bad AS error FROM ({J}) WHERE bad IS NOT NULL ORDER BY pos LIMIT 20""")
def invalid_examples(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.invalid_examples(_assessed(spark, d), F.col("qa_id").cast("long")).select("qa_id", "category", "raw", "error")


@query("answer_errors", f"""SELECT kind AS category, coalesce(bad, 'none') AS error, count(*) AS n FROM ({J}) GROUP BY ALL""")
def answer_errors(spark: SparkSession, d: str) -> DataFrame:
    return _assessed(spark, d).groupBy("category", F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


@query("agreement", f"""
WITH b AS (SELECT a.qa_id, a.prediction AS x, b.prediction AS y FROM ({PREDICTIONS_SQL}) a JOIN ({PREDICTIONS_SQL.replace('k % 3 = 0 THEN reverse', 'k % 5 = 0 THEN reverse')}) b USING (qa_id))
SELECT count(*) AS shared, count(*) FILTER (x = y) AS identical, count(*) FILTER (x = y) / count(*) AS agreement,
       (SELECT array_to_string(list(qa_id ORDER BY qa_id), ',') FROM (SELECT qa_id FROM b WHERE x <> y ORDER BY qa_id LIMIT 10)) AS differing FROM b""")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.agreement(predictions(spark, d), predictions(spark, d, 5)).withColumn("differing", F.array_join("differing", ","))


@query("transitions", f"""SELECT a.correct AS before, b.correct AS after, count(*) AS questions FROM ({J}) a JOIN ({J5}) b USING (qa_id) GROUP BY ALL""")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.transitions(_assessed(spark, d), _assessed(spark, d, 5))


@query("improvement_gate", f"""SELECT (SELECT avg(CAST(correct AS INT)) FROM ({J})) AS base, (SELECT avg(CAST(correct AS INT)) FROM ({J5})) AS other,
 (SELECT avg(CAST(correct AS INT)) FROM ({J5})) > (SELECT avg(CAST(correct AS INT)) FROM ({J})) AS opens""")
def improvement_gate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.improves(_assessed(spark, d), _assessed(spark, d, 5))


_BACK = "CASE WHEN n = 4 THEN CASE r WHEN 0 THEN g WHEN 1 THEN translate(g, 'ABCD', 'BCDA') WHEN 2 THEN translate(g, 'ABCD', 'CDAB') ELSE translate(g, 'ABCD', 'DABC') END ELSE CASE r WHEN 0 THEN g WHEN 1 THEN translate(g, 'ABC', 'BCA') ELSE translate(g, 'ABC', 'CAB') END END"


@query("option_order_consistency", f"""
WITH s AS (SELECT qa_id, kind, given AS g, CASE WHEN k % 7 = 0 THEN 3 ELSE 4 END AS n, k % CASE WHEN k % 7 = 0 THEN 3 ELSE 4 END AS r FROM ({J5})),
b AS (SELECT qa_id, kind, r <> 0 AS moved, CASE WHEN kind = 'multi' THEN array_to_string(list_sort(string_split({_BACK}, '')), '') ELSE {_BACK} END AS back FROM s),
x AS (SELECT b.kind AS category, moved, given IS NOT NULL AND back IS NOT NULL AS two, coalesce(given = back, false) AS same FROM b JOIN ({J}) j USING (qa_id))
SELECT category, count(*) AS questions, count(*) FILTER (moved) AS moved, count(*) FILTER (two) AS both_valid, count(*) FILTER (same) AS same, count(*) FILTER (same AND moved) AS same_moved, count(*) FILTER (same) / nullif(count(*) FILTER (two), 0) AS consistency FROM x GROUP BY category""")
def option_order_consistency(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("k") % 7 == 0, 3).otherwise(4)
    order = F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((i + F.col("k") % n) % n).cast("int"))
    return evaluation.option_order_consistency(_assessed(spark, d), _assessed(spark, d, 5), qa(spark, d).select("qa_id", order.alias("order")))


@query("id_alignment", """
WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0)
SELECT side, count(*) AS n FROM (SELECT CASE WHEN b.k IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL) GROUP BY side""")
def id_alignment(spark: SparkSession, d: str) -> DataFrame:
    rows = qa(spark, d)
    return evaluation.id_difference(rows.where("k % 4 <> 0"), rows.where("k % 3 <> 0")).groupBy("side").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- profiling


@query("latency_describe", f"SELECT event_type, {_ROUNDED} FROM (SELECT event_type, {_DESCRIBE.format(v='total_ms')} FROM ({R}) GROUP BY event_type)")
def latency_describe(spark: SparkSession, d: str) -> DataFrame:
    return _round(profiling.describe(requests(spark, d), "total_ms", ("event_type",)), total=6, mean=9, stdev=9)


@query("steady_state", f"SELECT user_id, {_ROUNDED} FROM (SELECT user_id, {_DESCRIBE.format(v='total_ms')} FROM {W3.format(k='user_id', o='ts, event_id', r=R)} WHERE rn > 3 OR nn <= 3 GROUP BY user_id)")
def steady_state(spark: SparkSession, d: str) -> DataFrame:
    rows = profiling.steady(requests(spark, d), ("user_id",), ["ts", "event_id"])
    return _round(profiling.describe(rows, "total_ms", ("user_id",)), total=6, mean=9, stdev=9)


@query("slowest5", f"SELECT event_id, total_ms, status FROM ({R}) ORDER BY total_ms DESC, event_id LIMIT 5")
def slowest5(spark: SparkSession, d: str) -> DataFrame:
    return profiling.slowest(requests(spark, d), "total_ms", "event_id").select("event_id", "total_ms", "status")


@query("phase_shares", f"""
SELECT event_type, round(t, 9) AS total_ms, round(i, 9) AS image_ms, round(g, 9) AS generate_ms, round(o, 9) AS overhead_ms, round(i / t, 9) AS image_share, round(g / t, 9) AS generate_share, round(o / t, 9) AS overhead_share
FROM (SELECT event_type, avg(total_ms) AS t, avg(image_ms) AS i, avg(generate_ms) AS g, avg(greatest(0.0, total_ms - image_ms - generate_ms)) AS o FROM ({R}) GROUP BY event_type)""")
def phase_shares(spark: SparkSession, d: str) -> DataFrame:
    out = profiling.phase_shares(profiling.with_overhead(requests(spark, d)), ("event_type",))
    return _round(out, **{c: 9 for c in out.columns if c != "event_type"})


@query("ttft_coverage", f"""
SELECT event_type, {_ROUNDED}, requests, coverage FROM (SELECT event_type, {_DESCRIBE.format(v='ttft_ms')}, count(*) AS requests, count(ttft_ms) / count(*) AS coverage FROM ({R}) GROUP BY event_type)""")
def ttft_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _round(profiling.coverage(requests(spark, d), "ttft_ms", ("event_type",)), total=6, mean=9, stdev=9)


@query("throughput", f"""
SELECT w.user_id, w.requests, round(w.rps, 9) AS run_rps, s.n AS steady_requests, round(s.rps, 9) AS steady_rps, s.valid AS steady_valid_rate, round(s.tokens, 9) AS steady_token_rate, w.requests - s.n AS warmup_skipped
FROM (SELECT user_id, count(*) AS requests, count(*) / (sum(total_ms) / 1000) AS rps FROM ({R}) GROUP BY user_id) w
JOIN (SELECT user_id, count(*) AS n, count(*) / (sum(total_ms) / 1000) AS rps, count(*) FILTER (status = 'valid') / count(*) AS valid, nullif(sum(coalesce(generation_tokens, 0)), 0) / (sum(total_ms) / 1000) AS tokens
      FROM {W3.format(k='user_id', o='ts, event_id', r=R)} WHERE rn > 3 OR nn <= 3 GROUP BY user_id) s USING (user_id)""")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    return _round(profiling.throughput(requests(spark, d), ("user_id",), ["ts", "event_id"]), run_rps=9, steady_rps=9, steady_token_rate=9)


@query("batch_view", f"""
SELECT user_id, count(*) AS batches, CAST(sum(size) AS BIGINT) AS requests, round(sum(ms), 6) AS total_ms, round(avg(ms), 9) AS mean_batch_ms, round(avg(size), 9) AS mean_batch_size,
       round(sum(size) / (sum(ms) / 1000), 9) AS throughput_rps, round(nullif(sum(tokens), 0) / (sum(ms) / 1000), 9) AS token_rate, round(sum(ms) / sum(size), 9) AS amortized_ms
FROM (SELECT user_id, (rn - 1) // 8 AS b, count(*) AS size, sum(total_ms) AS ms, sum(generation_tokens) AS tokens FROM {W3.format(k='user_id', o='ts, event_id', r=R)} GROUP BY ALL) GROUP BY user_id""")
def batch_view(spark: SparkSession, d: str) -> DataFrame:
    rows = runs.batches(requests(spark, d), ["ts", "event_id"], 8, ("user_id",))
    per = rows.groupBy("user_id", "batch").agg(F.count("*").alias("size"), F.sum("total_ms").alias("batch_ms"), F.sum("generation_tokens").alias("generation_tokens"))
    out = profiling.batch_view(per, ("user_id",))
    return _round(out, total_ms=6, mean_batch_ms=9, mean_batch_size=9, throughput_rps=9, token_rate=9, amortized_ms=9)


@query("engine_batches", f"""
SELECT event_type, user_id, max(ttft_ms) AS ttft_max, round(avg(ttft_ms), 9) AS ttft_mean, CAST(nullif(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(nullif(sum(generation_tokens), 0) AS BIGINT) AS generation_tokens FROM ({R}) GROUP BY event_type, user_id""")
def engine_batches(spark: SparkSession, d: str) -> DataFrame:
    return _round(profiling.engine_batches(requests(spark, d), ("event_type", "user_id")), ttft_mean=9)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics as engines of several releases write them."""
    i = F.col("event_id")
    seven, text = (i % 7).cast("string"), lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    raw = (
        F.when(i % 6 == 1, "{}").when(i % 6 == 2, text('{"num_cached_tokens": ', seven, ', "num_prompt_tokens": ', (i % 11).cast("string"), ', "state": "done"}'))
        .when(i % 6 == 3, text('{"cached_tokens": "many", "prefix_cache_hit_tokens": ', seven, ', "e2e_latency": 0.5}'))
        .when(i % 6 == 4, text('{"kv_cache_metrics": {"num_cached_prompt_tokens": ', seven, '}}')).when(i % 6 == 5, text('{"prefix_cache_stats": {"hits": 1}, "cache_metrics": {"cached_tokens": ', seven, '}}'))
    )
    return table(spark, d, "events").select("event_id", "event_type", F.parse_json(raw).alias("metrics"))


@query("engine_metrics", """
SELECT event_type, count(*) AS requests, count(*) FILTER (event_id % 6 > 1) AS reported, count(*) FILTER (event_id % 6 > 1) AS with_cached, CAST(sum(event_id % 7) FILTER (event_id % 6 > 1) AS DOUBLE) AS cached,
       count(*) FILTER (event_id % 6 = 2) AS with_prompt, CAST(sum(event_id % 11) FILTER (event_id % 6 = 2) AS DOUBLE) AS prompt, count(*) FILTER (event_id % 6 = 3) AS with_e2e FROM events GROUP BY event_type""")
def engine_metrics(spark: SparkSession, d: str) -> DataFrame:
    return profiling.engine_metrics(_metrics(spark, d)).groupBy("event_type").agg(
        F.count("*").alias("requests"), F.count_if("reported").alias("reported"), F.count("num_cached_tokens").alias("with_cached"), F.sum("num_cached_tokens").alias("cached"),
        F.count("num_prompt_tokens").alias("with_prompt"), F.sum("num_prompt_tokens").alias("prompt"), F.count("e2e_latency").alias("with_e2e"),
    )


@query("metric_fields", """
SELECT field, type, count(*) AS rows FROM (SELECT unnest(CASE event_id % 6 WHEN 2 THEN ['num_cached_tokens:BIGINT', 'num_prompt_tokens:BIGINT', 'state:STRING'] WHEN 3 THEN ['cached_tokens:STRING', 'prefix_cache_hit_tokens:BIGINT', 'e2e_latency:DECIMAL']
  WHEN 4 THEN ['kv_cache_metrics:OBJECT', 'kv_cache_metrics.num_cached_prompt_tokens:BIGINT'] WHEN 5 THEN ['prefix_cache_stats:OBJECT', 'prefix_cache_stats.hits:BIGINT', 'cache_metrics:OBJECT', 'cache_metrics.cached_tokens:BIGINT'] ELSE [] END) AS f, split_part(f, ':', 1) AS field, split_part(f, ':', 2) AS type FROM events) GROUP BY ALL""")
def metric_fields(spark: SparkSession, d: str) -> DataFrame:
    return profiling.metric_fields(_metrics(spark, d))


@query("prefix_hits", f"""
SELECT event_type, sum(cached_tokens) FILTER (cached_tokens IS NOT NULL) / sum(prompt_tokens) FILTER (cached_tokens IS NOT NULL) AS hit_rate, count(cached_tokens) AS reported, count(*) - count(cached_tokens) AS not_reported FROM ({R}) GROUP BY event_type""")
def prefix_hits(spark: SparkSession, d: str) -> DataFrame:
    return profiling.prefix_hits(requests(spark, d), ("event_type",))


@query("device_memory", """
SELECT user_id AS device, arg_min(value, event_id) AS first_used, arg_max(value, event_id) AS last_used, max(value) AS max_used, min(1000 - value) AS min_free, count(*) AS samples,
       arg_max(value, event_id) - arg_min(value, event_id) AS growth FROM events GROUP BY user_id""")
def device_memory(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("ts"), F.col("value").alias("used_mib"), (1000 - F.col("value")).alias("free_mib"))
    return profiling.memory(rows)


@query("run_facts", """
SELECT run, targets, resumed, elapsed_s, load_s, i AS inference_s, backend, targets - coalesce(resumed, 0) AS executed, targets - coalesce(resumed, 0) > 0 AND coalesce(backend, '') <> '' AS measured, i / targets AS s_per_request, targets / nullif(i, 0) AS rps
FROM (SELECT o_orderkey AS run, CAST(1 + o_orderkey % 9 AS BIGINT) AS targets, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 9 END AS resumed, o_totalprice AS elapsed_s, o_totalprice / (1 + o_orderkey % 3) AS load_s, CASE o_orderkey % 7 WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'engine' END AS backend,
      greatest(0.0, o_totalprice - o_totalprice / (1 + o_orderkey % 3)) AS i FROM orders)""")
def run_facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("run"), (1 + k % 9).alias("targets"), F.when(k % 4 == 0, k % 9).alias("resumed"), F.col("o_totalprice").alias("elapsed_s"), (F.col("o_totalprice") / (1 + k % 3)).alias("load_s"), F.when(k % 7 == 1, "").when(k % 7 != 2, "engine").alias("backend"))
    return profiling.run_facts(rows)


@query("training_steps", """
SELECT a.user_id, a.steps, round(a.share, 9) AS dataloader_share, round(b.rate, 9) AS samples_per_s, b.n AS steady_steps
FROM (SELECT user_id, count(*) AS steps, sum(CASE WHEN event_id % 2 = 0 THEN value / 10 END) / sum(value) AS share FROM events GROUP BY user_id) a
JOIN (SELECT user_id, count(*) * 4 / (sum(value) / 1000) AS rate, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS nn FROM events) WHERE rn > 3 OR nn <= 3 GROUP BY user_id) b USING (user_id)""")
def training_steps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("step_ms"), F.when(F.col("event_id") % 2 == 0, F.col("value") / 10).alias("dataloader_ms"))
    return _round(profiling.training_steps(rows, ("user_id",), 4), dataloader_share=9, samples_per_s=9)


# ---------------------------------------------------------------- splits


@query("split_coverage", f"""
WITH s AS (SELECT q.*, CASE WHEN fold < 3 THEN 'train' WHEN fold = 3 THEN 'dev' ELSE 'confirm' END AS split, k % 23 <> 7 OR fold = 4 AS there FROM ({QA_SQL}) q)
SELECT split, count(*) AS expected, count(*) FILTER (there) AS available, count(*) FILTER (NOT there) AS missing,
       (SELECT array_to_string(list(qa_id ORDER BY qa_id), ',') FROM (SELECT qa_id FROM s t WHERE t.split = s.split AND NOT there ORDER BY qa_id LIMIT 10)) AS examples,
       CASE WHEN count(*) FILTER (NOT there) = 0 THEN 'PASS' ELSE 'INCOMPLETE' END AS status FROM s GROUP BY split""")
def split_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = qa(spark, d).withColumn("split", splits.split_of("fold"))
    return splits.coverage(rows, rows.where("k % 23 <> 7 or fold = 4"), "qa_id").withColumn("examples", F.nullif(F.array_join("examples", ","), F.lit("")))


@query("subject_leaks", "SELECT count(*) AS leaking FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 5) > 1)")
def subject_leaks(spark: SparkSession, d: str) -> DataFrame:
    return splits.leaking_groups(qa(spark, d), "clip").agg(F.count("*").alias("leaking"))


@query("total_variation", """
SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 9) AS distance FROM (SELECT event_type, count(*) / sum(count(*)) OVER () AS p FROM events WHERE event_id % 2 = 0 GROUP BY event_type) a
FULL JOIN (SELECT event_type, count(*) / sum(count(*)) OVER () AS q FROM events WHERE event_id % 2 = 1 GROUP BY event_type) b USING (event_type)""")
def total_variation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return _round(splits.total_variation(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "event_type"), distance=9)


@query("category_distribution", f"SELECT lower(category) AS kind, trim(source) AS src, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM ({QA_SQL}) GROUP BY ALL")
def category_distribution(spark: SparkSession, d: str) -> DataFrame:
    return splits.distribution(qa(spark, d).select(F.lower("category").alias("kind"), F.trim("source").alias("src")), "kind", "src")


@query("duplicate_questions", f"""
SELECT category, question, n, splits, answers, contains(splits, ',') AS across, answers > 1 AS conflict FROM (
  SELECT lower(category) AS category, lower(question) AS question, list_sort([lower(trim(A)), lower(trim(B)), lower(trim(C)), lower(trim(D))]) AS o, count(*) AS n,
         array_to_string(list_sort(list(DISTINCT CASE WHEN fold < 3 THEN 'train' WHEN fold = 3 THEN 'dev' ELSE 'confirm' END)), ',') AS splits, count(DISTINCT answer) AS answers
  FROM ({QA_SQL}) GROUP BY ALL HAVING count(*) > 1)""")
def duplicate_questions(spark: SparkSession, d: str) -> DataFrame:
    return splits.duplicate_questions(qa(spark, d).withColumn("split", splits.split_of("fold"))).withColumn("splits", F.array_join("splits", ",")).drop("options")


@query("modality_coverage", """
SELECT o_orderstatus AS split, o_orderpriority AS source, count(*) AS clips, count(*) FILTER (o_orderkey % 2 = 0) AS IR, count(*) FILTER (o_orderkey % 3 = 0) AS Depth FROM orders GROUP BY ALL""")
def modality_coverage(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    have = F.array_compact(F.array(F.when(k % 2 == 0, "IR"), F.when(k % 3 == 0, "Depth")))
    return splits.modality_coverage(table(spark, d, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("source"), have.alias("modalities")), ["IR", "Depth"])


@query("clip_manifest", """
SELECT c_custkey AS clip_key, coalesce(n, 0) AS qa_count, ids AS qa_ids, cats AS categories, mods AS modalities FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY CAST(o_orderkey AS VARCHAR)), ',') AS ids, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS cats, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS mods FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def clip_manifest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("clip_key"), F.col("o_orderkey").cast("string").alias("qa_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("modality"))
    out = splits.clip_manifest(table(spark, d, "customer").select(F.col("c_custkey").alias("clip_key")), o, o)
    return out.withColumns({c: F.array_join(c, ",") for c in ("qa_ids", "categories", "modalities")})


@query("fold_statistics", "SELECT o_orderkey % 5 AS fold, count(*) AS questions, count(DISTINCT o_custkey) AS clips, count(DISTINCT o_custkey % 18) AS subjects, count(DISTINCT o_orderpriority) AS categories FROM orders GROUP BY ALL")
def fold_statistics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return splits.fold_statistics(o.select((F.col("o_orderkey") % 5).alias("fold"), F.col("o_custkey").alias("clip_key"), (F.col("o_custkey") % 18).alias("subject_id"), F.col("o_orderpriority").alias("category")))


@query("missing_actions", """
WITH r AS (SELECT DISTINCT p_partkey % 5 AS fold, p_size AS action FROM part WHERE p_partkey % 5 <> p_size % 5)
SELECT f.fold, a.action FROM (SELECT DISTINCT fold FROM r) f CROSS JOIN (SELECT DISTINCT action FROM r) a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.fold = f.fold AND r.action = a.action)""")
def missing_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").where("p_partkey % 5 <> p_size % 5").select((F.col("p_partkey") % 5).alias("fold"), F.col("p_size").alias("action"))
    return splits.missing_actions(rows)


_DESIGN = f"""
WITH r AS (SELECT qa_id, 'u' || clip % 18 AS subject_id, path AS clip_key, CASE WHEN k % 89 = 4 THEN NULL WHEN k % 97 = 3 THEN (clip % 18 + 1) % 5 ELSE clip % 18 % 5 END AS fold,
  CASE WHEN k % 2 = 0 THEN 'HARn' ELSE 'HAU' END AS source, lower(category) AS category, CASE WHEN k % 2 = 0 THEN 'a' || (k % 44) END AS action FROM ({QA_SQL})),
s AS (SELECT subject_id, count(DISTINCT fold) AS f FROM r GROUP BY 1), c AS (SELECT clip_key, count(DISTINCT fold) AS f, count(*) AS q FROM r GROUP BY 1), g AS (SELECT qa_id, count(fold) AS f FROM r GROUP BY 1),
d AS (SELECT fold, count(DISTINCT subject_id) AS subjects, count(DISTINCT source) AS sources, count(DISTINCT category) AS categories FROM r WHERE fold IS NOT NULL GROUP BY 1),
a AS (SELECT action, count(DISTINCT subject_id) AS subjects, count(DISTINCT fold) AS folds, min(fold) AS first FROM r WHERE action IS NOT NULL GROUP BY 1),
k AS (SELECT f.range AS fold, (SELECT count(*) FROM a) - (SELECT count(*) FROM a WHERE folds = 1 AND first = f.range) AS kept FROM range(5) f)
"""


@query("fold_gates", _DESIGN + _check_sql({
    "subjects_assigned_once": ("(SELECT CAST(sum(f) AS BIGINT) FROM s)", "(SELECT bool_and(f = 1) FROM s)"), "fold_ids": ("(SELECT string_agg(fold, ',' ORDER BY fold) FROM d)", "(SELECT count(*) FROM d) = 5"),
    "clips_assigned_once": ("(SELECT CAST(sum(f) AS BIGINT) FROM c)", "(SELECT bool_and(f = 1) FROM c)"), "questions_assigned_once": ("(SELECT CAST(sum(f) AS BIGINT) FROM g)", "(SELECT bool_and(f = 1) FROM g)"),
    "subjects_in_one_fold": ("(SELECT count(*) FROM s WHERE f = 1)", "(SELECT bool_and(f = 1) FROM s)"), "clip_questions_together": ("(SELECT CAST(coalesce(sum(q), 0) AS BIGINT) FROM c WHERE f > 1)", "(SELECT count(*) FROM c WHERE f > 1) = 0"),
    "training_keeps_actions": ("(SELECT string_agg(kept, ',' ORDER BY fold) FROM k)", "(SELECT bool_and(kept = (SELECT count(*) FROM a)) FROM k)"), "action_coverage_at_bound": ("(SELECT count(*) FROM a WHERE folds < least(subjects, 5))", "(SELECT count(*) FROM a WHERE folds < least(subjects, 5)) = 0"),
    "subject_balance": ("(SELECT string_agg(subjects, ',' ORDER BY fold) FROM d)", "(SELECT max(subjects) - min(subjects) <= 1 FROM d)"),
    "sources_in_every_fold": ("(SELECT string_agg(sources, ',' ORDER BY fold) FROM d)", "(SELECT bool_and(sources = 2) FROM d)"), "categories_in_every_fold": ("(SELECT string_agg(categories, ',' ORDER BY fold) FROM d)", "(SELECT bool_and(categories = 6) FROM d)"),
}))
def fold_gates(spark: SparkSession, d: str) -> DataFrame:
    return splits.fold_gates(_design(spark, d), ("HAU", "HARn"), answers.CATEGORIES).select("code", "status", "observed")


@query("action_coverage", _DESIGN + "SELECT action, subjects, folds, least(subjects, 5) AS bound, 5 - folds AS missing FROM a")
def action_coverage(spark: SparkSession, d: str) -> DataFrame:
    return splits.action_coverage(_design(spark, d)).select("action", "subjects", "folds", "bound", F.size("missing").alias("missing"))


def _design(spark: SparkSession, d: str) -> DataFrame:
    """Questions with folds by subject; some have another fold than their subject, some none."""
    k, subject = F.col("k"), F.col("clip") % 18
    fold = F.when(k % 89 == 4, None).when(k % 97 == 3, (subject + 1) % 5).otherwise(subject % 5)
    return qa(spark, d).select(
        "qa_id", F.concat(F.lit("u"), subject).alias("subject_id"), F.col("path").alias("clip_key"), fold.alias("fold"), F.when(k % 2 == 0, "HARn").otherwise("HAU").alias("source"),
        F.lower("category").alias("category"), F.when(k % 2 == 0, F.concat(F.lit("a"), k % 44)).alias("action"),
    )


@query("smoke_slice", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 16")
def smoke_slice(spark: SparkSession, d: str) -> DataFrame:
    return splits.first_of_each(table(spark, d, "events"), "event_type", "event_id").select("event_type", "event_id")


@query("cache_conflicts", "SELECT count(*) AS conflicts FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 = 0")
def cache_conflicts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("v"))
    other = o.where("sample_id % 3 = 0").withColumn("v", F.when(F.col("sample_id") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return splits.merged_caches(o, other)[1].agg(F.count("*").alias("conflicts"))


# ---------------------------------------------------------------- runs


def _records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").where(k % 4 != 1).select(k.cast("string").alias("qa_id"), F.when(k % 10 == 3, "invalid").when(k % 10 == 7, "failed").otherwise("valid").alias("status"), (1 + k % 3).cast("int").alias("attempts"))


_RECORDS = "SELECT CAST(o_orderkey AS VARCHAR) AS qa_id, o_orderkey AS k, CASE WHEN o_orderkey % 10 = 3 THEN 'invalid' WHEN o_orderkey % 10 = 7 THEN 'failed' ELSE 'valid' END AS status, CAST(1 + o_orderkey % 3 AS INT) AS attempts FROM orders WHERE o_orderkey % 4 <> 1"


@query("resume_pending", f"SELECT qa_id FROM ({QA_SQL}) WHERE qa_id NOT IN (SELECT qa_id FROM ({_RECORDS}) WHERE status = 'valid')")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    return runs.pending(qa(spark, d), _records(spark, d)).select("qa_id")


@query("status_counts", f"""
SELECT run, targets, valid, invalid, failed, pending, CASE WHEN targets > 0 AND valid = targets THEN 'PASS' ELSE 'INCOMPLETE' END AS result FROM (
  SELECT run, count(*) AS targets, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS NULL) AS pending
  FROM (SELECT unnest(['every', 'done']) AS run) CROSS JOIN ({QA_SQL}) q LEFT JOIN ({_RECORDS}) r USING (qa_id) WHERE run = 'every' OR (q.k % 4 <> 1 AND q.k % 10 NOT IN (3, 7)) GROUP BY run)""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    rows, records = qa(spark, d), _records(spark, d)
    done = rows.where("k % 4 <> 1 and k % 10 not in (3, 7)")
    return runs.status_counts(rows, records).withColumn("run", F.lit("every")).union(runs.status_counts(done, records).withColumn("run", F.lit("done")))


@query("upsert_attempts", f"""
SELECT status, attempts, count(*) AS n FROM (
  SELECT r.status, r.attempts FROM ({_RECORDS}) r WHERE r.k % 5 <> 0
  UNION ALL SELECT 'valid', CAST(coalesce(r.attempts, 0) + 1 AS INT) FROM (SELECT CAST(o_orderkey AS VARCHAR) AS qa_id FROM orders WHERE o_orderkey % 5 = 0) n LEFT JOIN ({_RECORDS}) r USING (qa_id)) GROUP BY ALL""")
def upsert_attempts(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("qa_id"), F.lit("valid").alias("status"), F.lit(0).alias("attempts"))
    return runs.upsert(_records(spark, d), new).groupBy("status", "attempts").agg(F.count("*").alias("n"))


@query("until_failure", f"""
SELECT user_id, count(*) AS n FROM (SELECT *, min(CASE WHEN status <> 'valid' THEN b END) OVER (PARTITION BY user_id) AS bad FROM (SELECT *, (rn - 1) // 4 AS b FROM {W3.format(k='user_id', o='ts, event_id', r=R)})) WHERE bad IS NULL OR b <= bad GROUP BY user_id""")
def until_failure(spark: SparkSession, d: str) -> DataFrame:
    rows = runs.batches(requests(spark, d), ["ts", "event_id"], 4, ("user_id",))
    return runs.until_failure(rows, ("user_id",), batch="batch").groupBy("user_id").agg(F.count("*").alias("n"))


@query("replica_blocks", f"SELECT user_id, CAST(ntile(3) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS replica, event_id FROM ({R})")
def replica_blocks(spark: SparkSession, d: str) -> DataFrame:
    return runs.replica_blocks(requests(spark, d), ["ts", "event_id"], 3, ("user_id",)).select("user_id", "replica", "event_id")


@query("round_robin", f"SELECT user_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 2 AS INT) AS replica, event_id FROM ({R})")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return runs.round_robin(requests(spark, d), ["ts", "event_id"], 2, ("user_id",)).select("user_id", "replica", "event_id")


@query("global_batches", f"""
SELECT batch, count(*) AS size, min(event_id) AS first_id, max(event_id) AS last_id
FROM (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 64 AS batch FROM ({R})) GROUP BY batch""")
def global_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = runs.batches(requests(spark, d).select("event_id", "ts"), ["ts", "event_id"], 64)
    return rows.groupBy("batch").agg(F.count("*").alias("size"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("global_blocks", f"SELECT event_id, CAST(ntile(7) OVER (ORDER BY ts, event_id) - 1 AS INT) AS replica FROM ({R})")
def global_blocks(spark: SparkSession, d: str) -> DataFrame:
    return runs.replica_blocks(requests(spark, d).select("event_id", "ts"), ["ts", "event_id"], 7).select("event_id", "replica")


@query("global_round_robin", f"SELECT event_id, CAST((row_number() OVER (ORDER BY status, event_id) - 1) % 5 AS INT) AS replica FROM (SELECT event_id, concat(status, event_type) AS status FROM ({R}))")
def global_round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = requests(spark, d).select("event_id", F.concat("status", "event_type").alias("status"))
    return runs.round_robin(rows, ["status", "event_id"], 5).select("event_id", "replica")


@query("first_mismatch", "SELECT min(o_orderkey) AS row FROM orders WHERE o_orderkey % 777 = 500")
def first_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = qa(spark, d).select("pos", "qa_id", "k")
    return runs.first_mismatch(rows.withColumn("qa_id", F.when(F.col("k") % 777 == 500, "x").otherwise(F.col("qa_id"))), rows)


@query("best_repeats", """
SELECT user_id, event_type, event_id, value, n AS repeats FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events WHERE event_id % 6 <> 0) WHERE rn = 1 AND n >= 2""")
def best_repeats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("measured", F.col("event_id") % 6 != 0)
    return runs.best_repeats(rows, ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "event_id", "value", "repeats")


@query("config_labels", """
SELECT label, count(*) AS n FROM (SELECT CASE WHEN d > 1 THEN 'DP' || d ELSE 'TP' || t END || '-B' || coalesce(nullif(b, 0), s * d) AS label FROM (SELECT 1 + p_partkey % 2 AS d, 1 + p_partkey % 3 AS t, (p_partkey % 4) * 8 AS b, 1 + p_partkey % 5 AS s FROM part)) GROUP BY label""")
def config_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select((1 + k % 2).alias("data_parallel"), (1 + k % 3).alias("tensor_parallel"), ((k % 4) * 8).alias("batch_size"), (1 + k % 5).alias("max_seqs"))
    return rows.groupBy(runs.config_label().alias("label")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- text and validation


_RAW = ["Final answer: b", r"so \boxed{ C } it is", " a ", r"answer: A or \boxed{B}", "no idea", "The answer is D", "", r"\boxed{d} answer: D"]


@query("answer_parse", f"""
WITH r AS (SELECT o_orderkey % 8 AS kind, {"CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_RAW)) + " END"} AS raw FROM orders),
f AS (SELECT kind, upper(trim(raw)) AS whole, list_distinct(list_concat(regexp_extract_all(upper(raw), '\\\\BOXED\\{{\\s*([A-D])\\s*\\}}', 1), regexp_extract_all(upper(raw), 'ANSWER\\s*(?:IS\\s*)?:?\\s*([A-D])\\b', 1))) AS found FROM r)
SELECT kind, CASE WHEN regexp_full_match(whole, '[A-D]') THEN whole WHEN len(found) = 1 THEN found[1] END AS prediction, count(*) AS n FROM f GROUP BY ALL""")
def answer_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % len(_RAW)
    raw = F.element_at(F.array(*map(F.lit, _RAW)), k.cast("int") + 1)
    rows = answers.with_parsed(table(spark, d, "orders").select(k.alias("kind"), raw.alias("raw")), "raw", F.lit("single"), F.lit("ABCD"), "own")
    return rows.groupBy("kind", F.col("own.prediction").alias("prediction")).agg(F.count("*").alias("n"))


@query("prompt_hashes", f"""
SELECT qa_id, sha256(concat_ws(chr(10), 'Prompt protocol: mcq_v2', 'The following infrared frames are in chronological order, earliest first.', 'Answer the multiple-choice question using only visual evidence from these frames.', '',
  'Question: ' || question, 'Options:', 'A. ' || A, 'B. ' || B, 'C. ' || C || CASE WHEN trim(D) <> '' THEN chr(10) || 'D. ' || D ELSE '' END, '', 'Category: ' || lower(category),
  CASE WHEN lower(category) = 'multi' THEN 'Output all selected option letters once, in alphabetical order, with no separators.'
       WHEN lower(category) = 'sequence' THEN 'This is a temporal ordering task, not a single-choice task. Output a complete permutation of ' || CASE WHEN trim(D) <> '' THEN 'ABCD' ELSE 'ABC' END || ' in the observed temporal order. Your answer must contain every available option letter exactly once, with no separators. Even if some actions are uncertain, provide the full best-estimate permutation.'
       ELSE 'Output exactly one available option letter.' END,
  'Do not provide an explanation or punctuation.', 'Final answer:')) AS digest FROM ({QA_SQL})""")
def prompt_hashes(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).select("qa_id", F.sha2(prompts.prompt(), 256).alias("digest"))


@query("prompt_leakage", """
SELECT o_orderkey % 5 AS kind, CASE o_orderkey % 5 WHEN 1 THEN 'raw_video_extension' WHEN 2 THEN 'path' WHEN 3 THEN 'subject_path_id,windows_path' WHEN 4 THEN 'test_clip_id' ELSE '' END AS labels, count(*) AS n FROM orders GROUP BY ALL""")
def prompt_leakage(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    text = F.when(k == 1, "see a.MP4 now").when(k == 2, F.concat(F.lit("look in CLIP"), F.col("o_custkey"))).when(k == 3, "C:\\x user12/").when(k == 4, "lm_TEST_12 is it").otherwise("nothing")
    rows = table(spark, d, "orders").withColumn("path", F.concat(F.lit("clip"), "o_custkey"))
    return rows.groupBy(k.alias("kind"), F.array_join(prompts.leakage(text, ("path",)), ",").alias("labels")).agg(F.count("*").alias("n"))


@query("fingerprints", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"note":null}') AS digest FROM nation""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").withColumn("note", F.lit(None).cast("string"))
    return rows.select("n_nationkey", hashing.fingerprint("n_name", "n_nationkey", "note").alias("digest"))


@query("safe_paths", r"""
WITH n AS (SELECT CASE p_partkey % 6 WHEN 1 THEN '../x' WHEN 2 THEN '/abs' WHEN 3 THEN 'a\b' WHEN 4 THEN 'a//b' WHEN 5 THEN 'a/b c.jpg' ELSE 'd/' || p_partkey END AS name FROM part)
SELECT safe, count(*) AS n FROM (SELECT name <> '' AND len(list_filter(string_split(name, '/'), lambda p: p IN ('', '.', '..'))) = 0 AND NOT contains(name, '\') AND NOT contains(name, ':') AS safe FROM n) GROUP BY safe""")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 6 == 1, "../x").when(k % 6 == 2, "/abs").when(k % 6 == 3, "a\\b").when(k % 6 == 4, "a//b").when(k % 6 == 5, "a/b c.jpg").otherwise(F.concat(F.lit("d/"), k.cast("string")))
    return table(spark, d, "part").groupBy(paths.safe_relative(name).alias("safe")).agg(F.count("*").alias("n"))


@query("clip_paths", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'root/clip' || p_partkey ELSE 'root/other' END AS clip FROM part""")
def clip_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit(" root\\clip"), k.cast("string"), F.lit("\\IR\\a.MP4 "))).otherwise("root/other//")
    return table(spark, d, "part").select("p_partkey", paths.clip_path(raw).alias("clip"))


@query("answer_space_sizes", f"""
WITH u AS (SELECT DISTINCT lower(category) AS category, CASE WHEN k % 7 = 0 THEN 'ABC' ELSE 'ABCD' END AS o FROM ({QA_SQL}))
SELECT category, CAST(length(o) AS INT) AS letters, count(*) AS option_sets, CAST(sum(CASE category WHEN 'multi' THEN (1 << length(o)) - 1 WHEN 'sequence' THEN factorial(CAST(length(o) AS INT)) ELSE length(o) END) AS BIGINT) AS outputs FROM u GROUP BY category, length(o)""")
def answer_space_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Outputs that are possible for the categories and options that the questions have."""
    seen = qa(spark, d).select(answers.category_of("category").alias("category"), answers.option_letters().alias("options")).distinct()
    space = answers.answer_space(spark).join(seen, ["category", "options"], "left_semi")
    return space.groupBy("category", F.length("options").alias("letters")).agg(F.count_distinct("options").alias("option_sets"), F.count("*").alias("outputs"))


@query("next_tokens", """
WITH o AS (SELECT unnest([[1], [1, 2], [3, 1]]) AS output), p AS (SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN [] WHEN 1 THEN [1] WHEN 2 THEN [1, 2] ELSE [9] END AS prefix FROM nation)
SELECT id, array_to_string(list_sort(list(DISTINCT output[len(prefix) + 1]) FILTER (output[len(prefix) + 1] IS NOT NULL)), ',') AS tokens, bool_or(len(output) = len(prefix)) AS "end"
FROM p JOIN o ON len(output) >= len(prefix) AND list_slice(output, 1, len(prefix)) = prefix GROUP BY id""")
def next_tokens(spark: SparkSession, d: str) -> DataFrame:
    outs = spark.createDataFrame([([1],), ([1, 2],), ([3, 1],)], "output array<int>")
    k = F.col("n_nationkey") % 4
    empty = F.array().cast("array<int>")
    prefix = F.when(k == 0, empty).when(k == 1, F.array(F.lit(1))).when(k == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(9)))
    out = answers.next_tokens(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), prefix.alias("prefix")), outs)
    return out.withColumn("tokens", F.when(F.size("tokens") > 0, F.array_join("tokens", ",")))


@query("timeline_report", """
SELECT code, CASE WHEN observed = '0' THEN 'PASS' ELSE 'FAIL' END AS status, observed FROM (
  SELECT unnest(['frame_count', 'positions', 'timestamps_sorted', 'timestamp_count', 'safe_paths']) AS code, unnest([CAST(count(*) FILTER (p_partkey % 5 = 0) AS VARCHAR), CAST(count(*) FILTER (p_partkey % 7 = 0) AS VARCHAR), CAST(count(*) FILTER (p_partkey % 11 = 0) AS VARCHAR), '0', '0']) AS observed FROM part)""")
def timeline_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    frames = table(spark, d, "part").select(
        F.transform(F.sequence(F.lit(1), F.when(k % 5 == 0, 7).otherwise(8)), lambda i: F.concat(F.lit("f/"), i.cast("string"))).alias("frame_paths"),
        F.transform(arrays.midpoints(8), lambda x: x + F.when(k % 7 == 0, 0.001).otherwise(0.0)).alias("normalized_positions"),
        F.when(k % 11 == 0, F.array(F.lit(2.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("actual_timestamps_seconds"),
        F.array(F.lit(1.0), F.lit(2.0)).alias("target_timestamps_seconds"),
    )
    return validation.timeline_report(frames, 8).select("code", "status", "observed")


@query("file_report", """
SELECT problem, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'size' WHEN 2 THEN 'sha256' WHEN 3 THEN 'unexpected' END AS problem FROM part) WHERE problem IS NOT NULL GROUP BY problem""")
def file_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k, k.cast("string").alias("path"), F.col("p_size").cast("long").alias("bytes"), F.sha2("p_name", 256).alias("sha256"))
    manifest = rows.where("p_partkey % 5 <> 3").select("path", F.when(k % 5 == 1, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(k % 5 == 2, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    return validation.file_report(manifest, rows.where("p_partkey % 5 <> 0").select("path", "bytes", "sha256")).groupBy("problem").agg(F.count("*").alias("n"))


_ENTRIES = """
WITH e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 101 = 1 THEN '../' || p_partkey WHEN p_partkey % 113 = 5 THEN 'm/A' || p_partkey // 226 WHEN p_partkey = 7 THEN 'manifest.json' ELSE 'm/' || p_partkey END AS name,
  CAST(p_size AS BIGINT) * CASE WHEN p_partkey % 211 = 8 THEN 1000000 ELSE 1 END AS size, CAST(p_size AS BIGINT) AS packed FROM part),
c AS (SELECT lower(name) FROM e GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT any_value(k) AS k, name FROM e WHERE name <> 'manifest.json' GROUP BY name HAVING count(*) = 1)
"""


@query("archive_report", _ENTRIES + _check_sql({
    "archive_bytes": ("1048576", "1048576 <= 536870912"),
    "entries": ("(SELECT count(*) FROM e)", "(SELECT count(*) FROM e) BETWEEN 1 AND 20000"),
    "expanded": ("(SELECT CAST(sum(size) AS BIGINT) FROM e)", "(SELECT sum(size) FROM e) <= 536870912"),
    "marker": ("(SELECT count(*) FROM e WHERE name = 'manifest.json')", "(SELECT count(*) FROM e WHERE name = 'manifest.json') = 1"),
    **_zero_sql("c", {"unique_names": "true"}),
    **_zero_sql("e", {"safe_names": "contains(name, '..')", "plain_entries": "k % 103 = 2 OR k % 127 = 6", "regular_files": "k % 131 = 9", "methods": "k % 107 = 3", "member_bytes": "size > 16777216", "member_ratio": "size > 50 * packed"}),
    **_zero_sql("m", {"manifest_entries": "k % 109 = 4", "manifest_digests": "k % 137 = 11"}),
}))
def archive_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 101 == 1, F.concat(F.lit("../"), k)).when(k % 113 == 5, F.concat(F.lit("m/A"), F.floor(k / 226))).when(k == 7, "manifest.json").otherwise(F.concat(F.lit("m/"), k))
    size = F.col("p_size").cast("long")
    entries = table(spark, d, "part").select(
        k.alias("k"), name.alias("name"), (size * F.when(k % 211 == 8, 1_000_000).otherwise(1)).alias("file_size"), size.alias("compress_size"), F.when(k % 107 == 3, 12).otherwise(8).alias("compress_type"),
        F.when(k % 127 == 6, 1).otherwise(0).alias("flag_bits"), F.when(k % 131 == 9, F.lit(0o120777 << 16)).otherwise(F.lit(0)).cast("long").alias("external_attr"), (k % 103 == 2).alias("is_dir"),
    )
    alone = entries.where("name <> 'manifest.json'").groupBy("name").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.first("file_size").alias("bytes")).where("n = 1")
    k = F.col("k")
    manifest = alone.select(F.col("name").alias("path"), (F.col("bytes") + F.when(k % 109 == 4, 1).otherwise(0)).alias("bytes"), F.when(k % 137 == 11, "0f").otherwise("0" * 64).alias("sha256"))
    listed = entries.join(alone.select("name"), "name", "left_semi").union(entries.where("name = 'manifest.json'").select("name", *(c for c in entries.columns if c != "name")))
    # entries that share a name are judged by that alone
    own = validation.archive_report(listed.drop("k"), manifest, "manifest.json", 1 << 20).where("code in ('manifest_entries', 'manifest_digests')")
    every = validation.archive_report(entries.drop("k"), manifest, "manifest.json", 1 << 20).where("code not in ('manifest_entries', 'manifest_digests')")
    return every.union(own).select("code", "status", "observed")


_SUBMITTED = f"""
WITH t AS (SELECT pos, k, CASE WHEN k % 61 = 4 THEN ' ' WHEN k % 67 = 5 THEN '1' ELSE qa_id END AS id, trim(source) AS source, CASE WHEN k % 97 = 8 THEN 'odd' ELSE lower(category) END AS category, CASE WHEN k % 41 = 5 THEN ' One' ELSE B END AS B, D FROM ({QA_SQL})),
i AS (SELECT trim(id) AS id, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT pos, k, qa_id AS id, prediction FROM ({PREDICTIONS_SQL}) WHERE k % 53 <> 9 UNION ALL SELECT 10000000 + k, k, 'x' || k, 'A' FROM ({QA_SQL}) WHERE k % 59 = 3),
o AS (SELECT pos, t.id AS x, s.id AS y FROM (SELECT pos, trim(id) AS id FROM t) t FULL JOIN s USING (pos)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trim(id) ORDER BY pos) AS rn FROM t) WHERE rn = 1 AND trim(id) <> ''),
j AS (SELECT s.id, f.category, g.given, g.bad, s.prediction FROM s LEFT JOIN f ON trim(f.id) = s.id LEFT JOIN ({J}) g ON g.k = f.k AND g.qa_id = s.id)
"""
_COLUMNS = "qa_id,source,path,category,question,A,B,C,D"


@query("submission_report", _SUBMITTED + _check_sql({
    "test_schema": (f"'{_COLUMNS}'", "true"), "template_columns": ("'qa_id,prediction'", "true"), "submission_columns": ("'qa_id,prediction'", "true"),
    "test_categories": ("(SELECT coalesce(string_agg(DISTINCT category, ','), '') FROM t WHERE category = 'odd')", "(SELECT count(*) FROM t WHERE category = 'odd') = 0"),
    **_zero_sql("t", {"test_option_layout": "trim(D) = '' AND NOT (source = 'HARn' AND category = 'single')", "test_unique_options": "lower(trim(B)) = 'one'", "test_nonempty_ids": "trim(id) = ''", "template_nonempty_ids": "trim(id) = ''"}),
    **_zero_sql("i", {"test_unique_ids": "n > 1 AND id <> ''", "template_unique_ids": "n > 1 AND id <> ''"}),
    **_zero_sql("s", {"submission_nonempty_ids": "trim(id) = ''"}), **_zero_sql("(SELECT id FROM s GROUP BY id HAVING count(*) > 1)", {"submission_unique_ids": "true"}),
    "template_matches_test_order": ("'exact'", "true"),
    "submission_row_count": ("(SELECT count(*) FROM s)", "(SELECT count(*) FROM s) = (SELECT count(*) FROM t)"),
    "submission_id_set": ("(SELECT count(*) FROM i WHERE id NOT IN (SELECT id FROM s)) || ',' || (SELECT count(DISTINCT id) FROM s WHERE id NOT IN (SELECT id FROM i))", "(SELECT count(*) FROM i WHERE id NOT IN (SELECT id FROM s)) + (SELECT count(*) FROM s WHERE id NOT IN (SELECT id FROM i)) = 0"),
    "submission_id_order": ("CASE WHEN (SELECT count(*) FROM o WHERE x IS DISTINCT FROM y) = 0 THEN 'exact' ELSE 'first mismatch at data row ' || coalesce(CAST((SELECT min(pos) + 1 FROM o WHERE x <> y) AS VARCHAR), 'None') END", "(SELECT count(*) FROM o WHERE x IS DISTINCT FROM y) = 0"),
    **_zero_sql("j", {"prediction_format": "category IS NULL OR category = 'odd' OR bad IS NOT NULL OR given IS NULL OR given <> prediction"}),
}))
def submission_report(spark: SparkSession, d: str) -> DataFrame:
    tests, submission = _submitted(spark, d)
    template = tests.select("pos", "qa_id", F.lit("A").alias("prediction"))
    return validation.submission_report(tests, template, submission).select("code", "status", "observed")


@query("submission_counts", _SUBMITTED + """
SELECT category, count(*) AS n, count(*) FILTER (category = 'odd' OR bad IS NOT NULL OR given IS NULL OR given <> prediction) AS invalid, count(*) FILTER (NOT (category = 'odd' OR bad IS NOT NULL OR given IS NULL OR given <> prediction)) AS canonical
FROM j WHERE category IS NOT NULL GROUP BY category""")
def submission_counts(spark: SparkSession, d: str) -> DataFrame:
    tests, submission = _submitted(spark, d)
    return validation.submission_counts(submission, tests)


@query("submission_totals", _SUBMITTED + """
SELECT count(*) AS rows, count(*) FILTER (NOT bad_) AS canonical, count(*) FILTER (bad_) AS invalid, count(*) FILTER (category IS NULL) AS unknown
FROM (SELECT *, category IS NULL OR category = 'odd' OR bad IS NOT NULL OR given IS NULL OR given <> prediction AS bad_ FROM j)""")
def submission_totals(spark: SparkSession, d: str) -> DataFrame:
    tests, submission = _submitted(spark, d)
    return validation.submission_totals(submission, tests)


def _submitted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions with blank and repeated ids, unknown categories and equal options; a submission with missing and unknown ids."""
    k = F.col("k")
    rows = qa(spark, d).withColumns({"qa_id": F.when(k % 61 == 4, " ").when(k % 67 == 5, "1").otherwise(F.col("qa_id")), "category": F.when(k % 97 == 8, "odd").otherwise(F.col("category")), "B": F.when(k % 41 == 5, " One").otherwise(F.col("B"))})
    own = predictions(spark, d).where("k % 53 <> 9").select("pos", "qa_id", "prediction")
    lone = rows.where("k % 59 = 3").select((k + 10_000_000).alias("pos"), F.concat(F.lit("x"), k).alias("qa_id"), F.lit("A").alias("prediction"))
    return rows.select("pos", *validation.QA_COLUMNS), own.union(lone)


@query("quality_gates", """
WITH m AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (c_acctbal < 0) AS DOUBLE) AS low, max(c_acctbal) AS top FROM customer)
SELECT 'customers' AS code, CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS status, 'critical' AS severity FROM m UNION ALL SELECT 'negative_balance', CASE WHEN low = 0 THEN 'PASS' ELSE 'WARN' END, 'minor' FROM m
UNION ALL SELECT 'highest', CASE WHEN top < 5000 THEN 'PASS' ELSE 'FAIL' END, 'critical' FROM m UNION ALL SELECT 'noted', 'INFO', 'info' FROM m UNION ALL SELECT 'unmeasured', CASE WHEN count(*) = 0 THEN 'MISSING' ELSE 'PASS' END, 'critical' FROM (SELECT 1 FROM m WHERE n < 0)""")
def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    m = c.agg(F.count("*").cast("double").alias("customers"), F.count_if(F.col("c_acctbal") < 0).cast("double").alias("negative_balance"), F.max("c_acctbal").cast("double").alias("highest")).withColumn("noted", F.col("customers"))
    metrics = m.select(F.explode(F.array(*(F.struct(F.lit(n).alias("code"), F.col(n).alias("value")) for n in m.columns))).alias("x")).select("x.*")
    limits = {"customers": (">", 0, "critical"), "negative_balance": ("==", 0, "minor"), "highest": ("<", 5000, "critical"), "noted": (">", 0, "info"), "unmeasured": ("<", 1, "critical")}
    return validation.gates(metrics, limits).select("code", "status", "severity")


# ---------------------------------------------------------------- suites


def _clips(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, an index of cached clips (one for each), sidecars and images, with faults by the key's remainders."""
    k = F.col("k")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    off = lambda m, r, bad, good: F.when(k % m == r, bad).otherwise(good)
    rows = qa(spark, d)
    frames = rows.where("k % 29 <> 1").select(
        k, off(83, 2, F.lit("s"), text("s", k)).alias("sample_id"), off(43, 3, text("q", k), F.col("qa_id")).alias("qa_ids"), off(47, 4, F.lit("2"), F.lit("1")).alias("qa_count"), text("train:", "path").alias("_"),
        text("train:", F.col("path")).alias("clip_key"), off(31, 5, F.lit("other"), F.col("source")).alias("source"), F.lit("train").alias("split"), off(37, 6, F.lit("failed"), F.lit("ok")).alias("status"), F.lit("IR").alias("modality"),
        F.lit("h1").alias("config_hash"), F.lit("v1").alias("protocol_version"), F.lit("0;5").alias("source_frame_indices"), F.lit("0.25;0.75").alias("normalized_positions"), F.lit("1.0;2.0").alias("target_timestamps_seconds"),
        off(71, 7, F.lit("2.0;1.0"), F.lit("1.0;2.0")).alias("actual_timestamps_seconds"), text("c", off(89, 8, F.lit(8), k), "/a;c", k, "/b").alias("frame_paths"), text("c", k, "/metadata.json").alias("metadata_path"),
    ).drop("_")
    numbers = lambda *x: F.array(*map(F.lit, x))
    sidecars = frames.where("k % 59 <> 9").select(
        "sample_id", "clip_key", "source", "split", "status", off(61, 10, F.lit("Depth"), F.lit("IR")).alias("modality"), "config_hash", "protocol_version", F.array("qa_ids").alias("qa_ids"), F.lit(1).alias("qa_count"),
        off(67, 11, F.lit(3), F.lit(2)).alias("num_frames"), F.lit(2).alias("requested_frames"), F.lit(2).alias("actual_frames"), F.lit(448).alias("image_size"), off(73, 12, F.lit("crop"), F.lit("letterbox")).alias("resize_mode"),
        numbers(0.25, 0.75).alias("normalized_positions"), off(79, 13, numbers(1.0, 2.1), numbers(1.0, 2.0)).alias("target_timestamps_seconds"), off(71, 7, numbers(2.0, 1.0), numbers(1.0, 2.0)).alias("actual_timestamps_seconds"),
        off(53, 14, numbers(0, 6), numbers(0, 5)).alias("source_frame_indices"), numbers("a", "b").alias("frame_files"), text("c", k).alias("folder"),
    )
    images = frames.select("k", F.explode(F.split("frame_paths", ";")).alias("path")).where("k % 97 <> 15").select("path", off(101, 16, F.lit(447), F.lit(448)).alias("width"), F.lit(448).alias("height"), off(103, 17, F.lit(1), F.lit(3)).alias("channels"), F.lit(True).alias("is_jpeg"))
    return rows, frames, sidecars, images.dropDuplicates(["path"])


#: Clips whose id is their own; the shared id stands for many and is judged only as such.
_CLIPS = f"""
WITH q AS (SELECT * FROM ({QA_SQL})), f AS (SELECT * FROM q WHERE k % 29 <> 1), own AS (SELECT * FROM f WHERE k % 83 <> 2), linked AS (SELECT * FROM own WHERE k % 43 <> 3)
"""
_FIXED = {"status": "ok", "modality": "IR", "config_hash": "h1", "protocol_version": "v1", "split": "train"}
_GONE = "k % 59 = 9"
_CLIP_RULES = {
    "cache_status": "k % 37 = 6", "cache_modality": "false", "cache_config_hash": "false", "cache_protocol_version": "false", "cache_split": "false", "sidecar": _GONE,
    **{f"sidecar_{c}": _GONE for c in ("clip_key", "source", "split", "status", "config_hash", "protocol_version")}, "sidecar_modality": f"{_GONE} OR k % 61 = 10", "sidecar_questions": f"{_GONE} OR k % 47 = 4",
    "frame_count": f"{_GONE} OR k % 67 = 11", "image_protocol": f"{_GONE} OR k % 73 = 12", "timeline_normalized_positions": _GONE, "timeline_target_timestamps_seconds": f"{_GONE} OR k % 79 = 13", "timeline_actual_timestamps_seconds": _GONE,
    "sampling": _GONE, "timestamps_sorted": f"{_GONE} OR k % 71 = 7", "frame_indices": f"{_GONE} OR k % 53 = 14", "frame_list": "false", "frame_files": f"{_GONE} OR (k % 89 = 8 AND k <> 8)",
}
_IMAGES = """(SELECT 'c' || k || '/b' AS path, k % 97 = 15 OR k % 101 = 16 OR k % 103 = 17 AS bad FROM linked UNION ALL SELECT 'c' || k || '/a', k % 97 = 15 OR k % 101 = 16 OR k % 103 = 17 FROM linked WHERE k % 89 <> 8)"""


def _own_clips(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows, frames, sidecars, images = _clips(spark, d)
    return rows, frames.where("k % 83 <> 2").drop("k"), sidecars.where("sample_id <> 's'"), images


@query("cached_input_report", _CLIPS + _check_sql({
    **_zero_sql("(SELECT 1 WHERE false)", {"sample_ids": "true", "qa_linked_once": "true"}),
    **_zero_sql("q", {"qa_linked": "k % 29 = 1 OR k % 43 = 3 OR k % 83 = 2"}), **_zero_sql("linked", {"qa_source": "k % 31 = 5"}), **_zero_sql("own", {"qa_count": "k % 47 = 4"}),
    **_zero_sql("linked", _CLIP_RULES),
}))
def cached_input_report(spark: SparkSession, d: str) -> DataFrame:
    rows, frames, sidecars, images = _own_clips(spark, d)
    none = spark.createDataFrame([], "path string, bytes long, sha256 string")
    report = suites.cached_input_report(rows, frames, sidecars, images, none, none, _FIXED, n=2)
    left = ("frames_of_one_clip", "images", "manifest_paths", "assets_registered", "assets")
    return report.where(~F.col("code").isin(*left)).select("code", "status", "observed")


_FOLD_RULES = {
    **_zero_sql("(SELECT 1 WHERE false)", {"unique_qa_ids": "true", "unique_fold_ids": "true", "unique_pilot_ids": "true"}),
    **_zero_sql("q", {"fold_ids": "k % 83 = 6"}), "pilot_ids": ("1", "false"),
    **_zero_sql("j", {
        "plain_ids": "false", "fold_version": "k % 31 = 2", "fold_number": "k % 37 = 3", "fold_groups": "k % 41 = 4", "fold_fields": "k % 43 = 5", "fold_clip": "k % 47 = 7", "prompts": "k % 67 = 8",
        "answers": "lower(category) IN ('single', 'combination', 'object_interaction', 'emotion') AND k % 53 = 9 OR lower(category) = 'sequence' AND k % 53 = 9 OR lower(category) = 'multi' AND k % 53 = 9",
    }),
    **_zero_sql("(SELECT s FROM (SELECT CASE WHEN k % 41 = 4 THEN '' ELSE 'u' || clip % 50 END AS s, CASE WHEN k % 37 = 3 THEN 7 ELSE f END AS f FROM j) GROUP BY s HAVING count(DISTINCT f) > 1)", {"leaks_subject_id": "true"}),
    **_zero_sql("(SELECT c FROM (SELECT CASE WHEN k % 47 = 7 THEN 'train:other' ELSE 'train:' || path END AS c, CASE WHEN k % 37 = 3 THEN 7 ELSE f END AS f FROM j) GROUP BY c HAVING count(DISTINCT f) > 1)", {"leaks_clip_key": "true"}),
    **_zero_sql("j", {"pilot_fold": "k % 101 = 10 AND (k % 37 = 3 OR f <> 4)"}),
}


@query("fold_report", f"""
WITH q AS (SELECT *, k % 5 AS f FROM ({QA_SQL})), j AS (SELECT * FROM q WHERE k % 83 <> 6)
""" + _check_sql(_FOLD_RULES))
def fold_report(spark: SparkSession, d: str) -> DataFrame:
    return suites.fold_report(*_folds(spark, d)).select("code", "status", "observed")


def _folds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, their folds and a pilot, with faults by the key's remainders."""
    k = F.col("k")
    rows = qa(spark, d)
    folds = rows.where("k % 83 <> 6").select(
        "qa_id", F.when(k % 43 == 5, "?").otherwise(F.col("source")).alias("source"), "category", F.when(k % 31 == 2, "v0").otherwise("subject_grouped_v1").alias("fold_version"), F.when(k % 37 == 3, "7").otherwise((k % 5).cast("string")).alias("fold"),
        F.when(k % 41 == 4, "").otherwise(F.concat(F.lit("u"), F.col("clip") % 50)).alias("subject_id"), F.concat(F.lit("train:"), F.when(k % 47 == 7, "other").otherwise(F.col("path"))).alias("clip_key"),
    )
    rows = rows.withColumns({"question": F.when(k % 67 == 8, "see x.mp4").otherwise(F.col("question")), "answer": F.when(k % 53 == 9, "AA").otherwise(F.col("answer"))})
    pilot = rows.where("k % 101 = 10 and k % 83 <> 6").select("qa_id").union(spark.createDataFrame([("nobody",)], "qa_id string"))
    return rows, folds, pilot


@query("training_report", f"""
WITH q AS (SELECT *, k % 5 AS f FROM ({QA_SQL})), j AS (SELECT * FROM q WHERE k % 83 <> 6), own AS (SELECT *, k % 97 = 15 OR k % 101 = 16 OR k % 103 = 17 AS bad FROM q WHERE k % 29 <> 1 AND k % 83 <> 2), joined AS (SELECT * FROM own WHERE k % 43 <> 3 AND k % 83 <> 6)
""" + _check_sql({
    **_FOLD_RULES, **_zero_sql("own", _CLIP_RULES),
    **_zero_sql("(SELECT path FROM own GROUP BY path HAVING count(*) > 1)", {"cache_clips": "true"}), **_zero_sql("(SELECT 1 WHERE false)", {"cache_links": "true"}),
    **_zero_sql("own", {"cache_questions": "k % 43 = 3 OR k % 83 = 6"}), **_zero_sql("joined", {"cache_clip": "k % 47 = 7", "cache_source": "k % 31 = 5"}),
    **_zero_sql("(SELECT 8 FROM own WHERE k % 89 = 8 HAVING count(*) > 1)", {"frames_of_one_clip": "true"}), **_zero_sql("(SELECT k, bad FROM own UNION ALL SELECT k, bad FROM own WHERE k % 89 <> 8)", {"images": "bad"}),
}))
def training_report(spark: SparkSession, d: str) -> DataFrame:
    rows, folds, pilot = _folds(spark, d)
    _, frames, sidecars, images = _own_clips(spark, d)
    # the image that many clips share is a good one
    shared = images.limit(0).union(spark.createDataFrame([("c8/a", 448, 448, 3, True)], images.schema))
    return suites.training_report(rows, folds, pilot, frames, sidecars, images.where("path <> 'c8/a'").union(shared), _FIXED, n=2).select("code", "status", "observed")


@query("receipt_report", _check_sql({
    **_zero_sql("part", {
        "receipt_schema": "p_partkey % 31 = 1", "receipt_purpose": "p_partkey % 37 = 2", "base_model": "p_partkey % 41 = 3", "base_revision": "p_partkey % 43 = 4", "base_receipt": "p_partkey % 47 = 5 OR p_partkey % 53 = 6",
        "file_set": "p_partkey % 59 = 7", "files": "p_partkey % 61 = 8 OR p_partkey % 67 = 9 OR p_partkey % 59 = 7", "adapter_type": "p_partkey % 71 = 10 OR p_partkey % 73 = 11", "other_modules": "p_partkey % 71 = 10 OR p_partkey % 79 = 12",
        "target_modules": "p_partkey % 71 = 10 OR p_partkey % 83 = 13", "adapter_sizes": "p_partkey % 71 = 10 OR p_partkey % 89 = 14", "config_base": "p_partkey % 71 = 10 OR p_partkey % 97 = 15",
    }), **_zero_sql("(SELECT 1 WHERE false)", {"receipts": "true"}),
}))
def receipt_report(spark: SparkSession, d: str) -> DataFrame:
    """Adapters with a receipt, a config (some have none) and two files, with faults by the key's remainders."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k, k.cast("string").alias("root"), F.sha2("p_name", 256).alias("sha"), F.col("p_size").cast("long").alias("bytes"))
    off = lambda m, r, bad, good: F.when(k % m == r, bad).otherwise(good)
    entry = lambda name: F.struct(F.lit(name).alias("path"), "bytes", F.col("sha").alias("sha256"))
    other = F.struct(off(59, 7, F.lit("notes.txt"), F.lit("adapter_config.json")).alias("path"), "bytes", F.col("sha").alias("sha256"))
    modules = F.array(F.lit("model.layers.0.q_proj"), F.lit("model.layers.0.v_proj"))
    receipts = rows.select(
        "root", off(31, 1, 2, 1).alias("schema_version"), off(37, 2, F.lit("test"), F.lit("sft")).alias("purpose"), off(41, 3, F.lit("other"), F.lit("base")).alias("base_model_id"), off(43, 4, F.lit("r0"), F.lit("r1")).alias("base_revision"),
        off(47, 5, F.lit("0"), off(53, 6, F.lit(None).cast("string"), F.lit("ab"))).alias("base_receipt_sha256"), F.struct(F.lit(16).alias("r"), F.lit(32).alias("alpha"), F.lit(0.05).alias("dropout")).alias("lora"),
        modules.alias("target_modules"), F.array(other, entry("adapter_model.safetensors")).alias("files"),
    )
    configs = rows.where(k % 71 != 10).select(
        "root", off(73, 11, F.lit("PREFIX"), F.lit("LORA")).alias("peft_type"), F.lit("CAUSAL_LM").alias("task_type"), F.lit("none").alias("bias"), off(79, 12, F.array(F.lit("head")), F.array().cast("array<string>")).alias("modules_to_save"), F.lit(False).alias("use_dora"),
        off(83, 13, F.array(F.lit("up_proj")), F.when(k % 2 == 0, F.array(F.lit("v_proj"), F.lit("q_proj"))).otherwise(F.reverse(modules))).alias("target_modules"), off(89, 14, 8, 16).alias("r"), F.lit(32).alias("lora_alpha"), F.lit(0.05).alias("lora_dropout"),
        F.lit("base").alias("base_model_name_or_path"), off(97, 15, F.lit("r2"), F.lit("r1")).alias("revision"),
    )
    there = rows.select("root", F.lit("adapter_config.json").alias("path"), off(61, 8, F.col("bytes") + 1, F.col("bytes")).alias("bytes"), F.col("sha").alias("sha256")).union(rows.where(k % 67 != 9).select("root", F.lit("adapter_model.safetensors").alias("path"), "bytes", "sha"))
    return suites.receipt_report(receipts, configs, there, {"model_id": "base", "revision": "r1", "receipt_sha256": "ab"}).select("code", "status", "observed")


_CACHED = f"""
WITH q AS (SELECT * FROM ({QA_SQL})), own AS (SELECT *, k % 97 = 15 OR k % 101 = 16 OR k % 103 = 17 AS bad FROM q WHERE k % 29 <> 1 AND k % 83 <> 2), linked AS (SELECT * FROM own WHERE k % 43 <> 3),
every AS (SELECT k, 'c' || k || '/b' AS path FROM own UNION ALL SELECT k, 'c' || k || '/metadata.json' FROM own UNION SELECT CASE WHEN k % 89 = 8 THEN 8 ELSE k END, 'c' || CASE WHEN k % 89 = 8 THEN 8 ELSE k END || '/a' FROM own),
needed AS (SELECT DISTINCT path FROM (SELECT 'c' || k || '/b' AS path FROM linked UNION ALL SELECT 'c' || k || '/metadata.json' FROM linked UNION ALL SELECT 'c' || CASE WHEN k % 89 = 8 THEN 8 ELSE k END || '/a' FROM linked)),
m AS (SELECT path, 5 AS bytes FROM every WHERE NOT (k % 107 = 18 AND path LIKE '%/b') UNION ALL SELECT path, 5 FROM every WHERE k % 113 = 20 AND k % 107 <> 18 AND path LIKE '%/b'),
fl AS (SELECT path, CASE WHEN k % 109 = 19 AND path LIKE '%/b' THEN 6 ELSE 5 END AS bytes FROM every),
j AS (SELECT a.bytes AS x, b.bytes AS y FROM (SELECT DISTINCT m.* FROM m JOIN needed USING (path)) a FULL JOIN (SELECT fl.* FROM fl JOIN needed USING (path)) b ON a.path = b.path),
t AS (SELECT qa_id FROM q WHERE k % 127 <> 21 UNION ALL SELECT qa_id FROM q WHERE k % 131 = 22 AND k % 127 <> 21 UNION ALL SELECT 'y' || k FROM q WHERE k % 137 = 23)
"""


@query("cached_input_files", _CACHED + _check_sql({
    **_zero_sql("(SELECT 8 FROM linked WHERE k % 89 = 8 HAVING count(*) > 1)", {"frames_of_one_clip": "true"}), **_zero_sql("(SELECT bad FROM linked UNION ALL SELECT bad FROM linked WHERE k % 89 <> 8)", {"images": "bad"}),
    **_zero_sql("(SELECT path FROM m GROUP BY path HAVING count(*) > 1)", {"manifest_paths": "true"}), **_zero_sql("needed", {"assets_registered": "path NOT IN (SELECT path FROM m)"}), **_zero_sql("j", {"assets": "x IS DISTINCT FROM y"}),
    "template_ids": ("(SELECT count(*) FROM t WHERE qa_id NOT IN (SELECT qa_id FROM q)) + (SELECT count(*) FROM q WHERE qa_id NOT IN (SELECT qa_id FROM t))", "(SELECT count(*) FROM t WHERE qa_id NOT IN (SELECT qa_id FROM q)) + (SELECT count(*) FROM q WHERE qa_id NOT IN (SELECT qa_id FROM t)) = 0"),
    **_zero_sql("(SELECT qa_id FROM t GROUP BY qa_id HAVING count(*) > 1)", {"template_unique": "true"}),
}))
def cached_input_files(spark: SparkSession, d: str) -> DataFrame:
    """The checks of images, assets and template ids that `cached_input_report` leaves to this query."""
    k, last = F.col("k"), F.col("path").endswith("/b")
    rows, frames, sidecars, images = _clips(spark, d)
    shared = images.limit(0).union(spark.createDataFrame([("c8/a", 448, 448, 3, True)], images.schema))
    images = images.where("path <> 'c8/a'").union(shared)
    own = frames.where("k % 83 <> 2")
    paths_ = own.select(k, F.explode(F.concat(F.split("frame_paths", ";"), F.array("metadata_path"))).alias("path"))
    paths_ = paths_.select(F.when(F.col("path") == "c8/a", 8).otherwise(k).alias("k"), "path").distinct()
    files = paths_.select("path", F.when((k % 109 == 19) & last, 6).otherwise(5).cast("long").alias("bytes"), F.lit("ab").alias("sha256"))
    manifest = paths_.where(~((k % 107 == 18) & last)).select("k", "path", F.lit(5).cast("long").alias("bytes"), F.lit("ab").alias("sha256"))
    manifest = manifest.union(manifest.where((k % 113 == 20) & last)).drop("k")
    template = rows.where(k % 127 != 21).select("k", "qa_id")
    template = template.select("qa_id").union(template.where(k % 131 == 22).select("qa_id")).union(rows.where(k % 137 == 23).select(F.concat(F.lit("y"), k)))
    report = suites.cached_input_report(rows, own.drop("k"), sidecars.where("sample_id <> 's'"), images, manifest, files, _FIXED, template, n=2)
    codes = ("frames_of_one_clip", "images", "manifest_paths", "assets_registered", "assets", "template_ids", "template_unique")
    return report.where(F.col("code").isin(*codes)).select("code", "status", "observed")


@query("training_coverage", f"""
WITH r AS (SELECT *, CASE WHEN k % 37 = 3 THEN NULL WHEN fold < 3 THEN 'train' WHEN fold = 3 THEN 'dev' ELSE 'confirm' END AS split, k % 29 <> 1 AND k % 43 <> 3 AND k % 83 <> 2 AS there FROM ({QA_SQL}) WHERE k % 83 <> 6 AND k % 101 <> 10)
SELECT split, count(*) AS expected, count(*) FILTER (there) AS available, count(*) FILTER (NOT there) AS missing, CASE WHEN count(*) FILTER (NOT there) = 0 THEN 'PASS' ELSE 'INCOMPLETE' END AS status FROM r WHERE split IS NOT NULL GROUP BY split""")
def training_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows, folds, pilot = _folds(spark, d)
    return suites.training_coverage(rows, folds, pilot, _own_clips(spark, d)[1]).where("split is not null").drop("examples")


@query("sidecar_differences", _CLIPS + """
SELECT "column", count(*) AS n FROM (SELECT unnest(CASE WHEN k % 59 = 9 THEN ['<missing>'] WHEN k % 61 = 10 THEN ['modality'] ELSE [] END) AS "column" FROM own) GROUP BY 1""")
def sidecar_differences(spark: SparkSession, d: str) -> DataFrame:
    _, frames, sidecars, _ = _own_clips(spark, d)
    return validation.sidecar_differences(frames, sidecars, "sample_id", ["clip_key", "source", "modality"]).groupBy("column").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- runs: checks and places


@query("run_report", f"""
WITH r AS (SELECT r.*, k % 71 = 8 AS bad FROM ({_RECORDS}) r), n AS (SELECT count(*) AS n, count(DISTINCT qa_id) AS ids FROM (SELECT qa_id FROM r UNION ALL SELECT qa_id FROM r WHERE k % 90 = 6)), t AS (SELECT qa_id FROM ({QA_SQL}) WHERE k % 17 <> 3)
""" + _check_sql({
    "unique_records": ("(SELECT n - ids FROM n)", "(SELECT n - ids FROM n) = 0"),
    **_zero_sql("(SELECT qa_id FROM r UNION ALL SELECT qa_id FROM r WHERE k % 90 = 6)", {"known_records": "qa_id NOT IN (SELECT qa_id FROM t)"}),
    **_zero_sql("(SELECT bad FROM r UNION ALL SELECT bad FROM r WHERE k % 90 = 6)", {"record_hashes": "bad"}),
    "claimed_status": ("'PASS'", "(SELECT count(*) FROM r WHERE status = 'valid') = (SELECT count(*) FROM t)"),
}))
def run_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("qa_id").cast("long")
    records = _records(spark, d).withColumns({"record_sha256": F.when(k % 71 == 8, "x").otherwise("y"), "expected_sha256": F.lit("y")})
    records = records.union(records.where(k % 90 == 6))
    return validation.run_report(records, qa(spark, d).where("k % 17 <> 3"), "PASS").select("code", "status", "observed")


@query("order_violations", """
WITH r AS (SELECT event_id AS seq, CASE WHEN event_id % 97 = 5 THEN event_id - 40 ELSE event_id END AS pos FROM events)
SELECT seq, pos, before FROM (SELECT *, max(pos) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) WHERE before >= pos""")
def order_violations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return evaluation.order_violations(table(spark, d, "events").select(i.alias("seq"), F.when(i % 97 == 5, i - 40).otherwise(i).alias("pos")), 512).select("seq", "pos", "before")


@query("latest_complete", "SELECT o_custkey AS run, max(o_orderkey) AS step, 'p' || max(o_orderkey) AS path FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey")
def latest_complete(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return runs.latest_complete(table(spark, d, "orders").select(F.col("o_custkey").alias("run"), k.alias("step"), F.concat(F.lit("p"), k).alias("path"), (k % 3 != 0).alias("verified")))


@query("memory_table", """
WITH d AS (SELECT user_id AS device, max(value) AS m FROM events GROUP BY user_id)
SELECT a.device, a.m AS used_mib, b.m AS sampled_peak, c.m / 2 AS allocator_peak FROM d a LEFT JOIN d b ON a.device = b.device AND b.device % 2 = 0 LEFT JOIN d c ON a.device = c.device AND c.device % 3 = 0""")
def memory_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("device")).agg(F.max("value").alias("m"))
    return profiling.memory_table(rows.select("device", F.col("m").alias("used_mib")), rows.where("device % 2 = 0").select("device", F.col("m").alias("sampled_peak")), rows.where("device % 3 = 0").select("device", (F.col("m") / 2).alias("allocator_peak")))


@query("completion_labels", """
WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 3 THEN [0, 1, 0, 1, 1] ELSE [0, 1, 1, 1, 1] END AS mask, [0, 5, 6, p_size, 9] AS tokens FROM part)
SELECT k, CASE WHEN k % 7 <> 3 AND tokens[4] <> 9 THEN array_to_string([-100, -100, -100, tokens[4], 9], ',') END AS labels FROM p""")
def completion_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ints = lambda *x: F.array(*(F.lit(v) if isinstance(v, int) else v for v in x))
    size = F.col("p_size").cast("int")
    rows = table(spark, d, "part").select(k.alias("k"), ints(0, 5, 6, size, 9).alias("full"), F.when(k % 7 == 3, ints(0, 1, 0, 1, 1)).otherwise(ints(0, 1, 1, 1, 1)).alias("mask"), ints(5, 6).alias("prefix"), ints(1, 1).alias("prefix_mask"), ints(size).alias("answer"))
    return rows.select("k", F.array_join(arrays.completion_labels("full", "mask", "prefix", "prefix_mask", "answer", 9), ",").alias("labels"))


@query("incomplete_layers", "SELECT 'layers.' || p_size || '.attn' AS layer, CASE WHEN count(*) FILTER (p_partkey % 2 = 0) = 0 THEN 'q_proj' ELSE 'v_proj' END AS missing FROM part WHERE p_partkey % 5 = 1 AND p_size % 4 <> 0 GROUP BY p_size HAVING count(DISTINCT p_partkey % 2) = 1")
def incomplete_layers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(F.col("p_size") % 4 == 0, "visual.").otherwise(""), F.lit("layers."), F.col("p_size"), F.lit(".attn."), F.when(k % 2 == 0, "q_proj").otherwise("v_proj"))
    return paths.incomplete_layers(table(spark, d, "part").where(k % 5 == 1).select(name.alias("name"))).withColumn("missing", F.array_join("missing", ","))


@query("attention_targets", """
WITH m AS (SELECT p_partkey // 2 AS layer, CASE WHEN p_partkey % 2 = 0 THEN 'q_proj' ELSE 'v_proj' END AS part FROM part WHERE p_partkey % 7 <> 3 AND (p_partkey // 2) % 5 <> 0)
SELECT 'model.layers.' || layer || '.attn' AS layer, CASE WHEN max(part) = 'q_proj' THEN 'v_proj' ELSE 'q_proj' END AS missing FROM m GROUP BY m.layer HAVING count(*) = 1""")
def attention_targets(spark: SparkSession, d: str) -> DataFrame:
    """Half of some layers' projections is missing at every scale; other parts of the model do not count."""
    k = F.col("p_partkey")
    layer = F.floor(k / 2)
    name = F.concat(F.when(layer % 5 == 0, "visual.").otherwise("model."), F.lit("layers."), layer, F.lit(".attn."), F.when(k % 2 == 0, "q_proj").otherwise("v_proj"))
    other = F.concat(F.lit("model.layers."), layer, F.lit(".mlp.up_proj"))
    rows = table(spark, d, "part")
    return paths.incomplete_layers(rows.where(k % 7 != 3).select(name.alias("name")).union(rows.select(other.alias("name")))).withColumn("missing", F.array_join("missing", ","))
