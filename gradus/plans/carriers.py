"""Evaluation-shaped tables derived from the standard ones by integer arithmetic, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_QA = """
SELECT CAST(k AS STRING) AS qa_id, k - 1 AS pos, k,
       CASE k % 5 WHEN 0 THEN 'HAU' WHEN 1 THEN 'HARn' WHEN 2 THEN ' HAU ' WHEN 3 THEN 'HARn' ELSE '' END AS source,
       concat('clip', CAST(c AS STRING)) AS path,
       CASE k % 6 WHEN 0 THEN 'single' WHEN 1 THEN 'multi' WHEN 2 THEN 'combination' WHEN 3 THEN 'sequence' WHEN 4 THEN 'object_interaction' ELSE 'Emotion' END AS category,
       concat('question ', CAST(k % 700 AS STRING)) AS question,
       'one' AS A, concat('two', CAST(k % 3 AS STRING)) AS B, 'three' AS C, CASE WHEN k % 7 = 0 THEN ' ' ELSE 'four' END AS D,
       CASE WHEN k % 6 = 1 THEN CASE WHEN k % 4 < 2 THEN 'AC' ELSE 'AB' END
            WHEN k % 6 = 3 THEN CASE WHEN k % 7 = 0 THEN 'BAC' ELSE 'BADC' END
            ELSE substr('ABC', CAST((k % 9 - k % 3) / 3 AS INT) + 1, 1) END AS answer,
       c AS clip, k % 5 AS fold
FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders) o
"""
_PREDICTIONS = """
SELECT qa_id, k, pos,
       CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN 'E' WHEN k % 17 = 0 THEN 'AA'
            WHEN k % 19 = 0 THEN concat(' ', lower(answer), ' ')
            WHEN k % {m} = 0 THEN reverse(answer)
            WHEN k % 6 IN (1, 3) THEN answer
            ELSE substr('ABCD', CAST(k % 4 AS INT) + 1, 1) END AS prediction
FROM ({qa}) q
"""
QA_SQL = _QA.replace("STRING", "VARCHAR").replace("reverse(", "reverse(")
PREDICTIONS_SQL = _PREDICTIONS.format(qa=QA_SQL, m=3)
OTHER_SQL = _PREDICTIONS.format(qa=QA_SQL, m=5)

#: The canonical form of a prediction, independent of the engine's expressions.
ASSESSED_SQL = f"""
SELECT q.*, p.prediction AS raw, lower(q.category) AS kind,
       CASE WHEN trim(q.source) = '' THEN '<missing>' ELSE trim(q.source) END AS src,
       upper(trim(p.prediction)) AS u, CASE WHEN q.k % 7 = 0 THEN 'ABC' ELSE 'ABCD' END AS options
FROM ({QA_SQL}) q JOIN ({{predictions}}) p ON q.qa_id = p.qa_id
"""
JUDGED_SQL = f"""
SELECT *, CASE WHEN bad IS NOT NULL THEN NULL WHEN kind = 'multi' THEN array_to_string(list_sort(string_split(u, '')), '') ELSE u END AS given,
       bad IS NULL AND (CASE WHEN kind = 'multi' THEN array_to_string(list_sort(string_split(u, '')), '') ELSE u END) = answer AS correct
FROM (SELECT *, CASE WHEN u = '' THEN 'prediction is empty' WHEN NOT regexp_full_match(u, '[A-D]+') THEN 'prediction must contain only letters A-D'
         WHEN length(array_to_string(list_distinct(string_split(u, '')), '')) <> length(u) THEN 'prediction contains duplicate option letters'
         WHEN options = 'ABC' AND contains(u, 'D') THEN 'prediction selects unavailable option(s): D'
         WHEN kind = 'multi' THEN NULL
         WHEN kind = 'sequence' THEN CASE WHEN length(u) <> length(options) THEN 'sequence requires a permutation of all options: ' || options END
         WHEN length(u) <> 1 THEN kind || ' requires exactly one option' END AS bad
      FROM ({ASSESSED_SQL}) a) b
"""


def judged_sql(predictions: str = PREDICTIONS_SQL) -> str:
    return JUDGED_SQL.replace("{predictions}", predictions)


def _views(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, _QA)


def predictions(spark: SparkSession, sf_dir: str, m: int = 3) -> DataFrame:
    return _views(spark, sf_dir, _PREDICTIONS.format(qa=_QA, m=m))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as timing samples: totals with parts that vary by id, some values missing."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        "event_id", "event_type", "user_id", "ts", F.col("value").alias("total_ms"),
        (F.col("value") * (1 + i % 3) / 8).alias("image_ms"), (F.col("value") * (1 + i % 4) / 6).alias("generate_ms"),
        F.when(i % 4 != 0, F.col("value") / 2).alias("ttft_ms"), F.when(i % 5 != 0, (i % 9)).alias("generation_tokens"),
        F.when(i % 3 != 0, i % 7).alias("cached_tokens"), (i % 11).alias("prompt_tokens"), F.when(i % 10 == 3, "invalid").when(i % 97 == 5, "failed").otherwise("valid").alias("status"),
    )


REQUESTS_SQL = """
SELECT event_id, event_type, user_id, ts, value AS total_ms, value * (1 + event_id % 3) / 8 AS image_ms, value * (1 + event_id % 4) / 6 AS generate_ms,
       CASE WHEN event_id % 4 <> 0 THEN value / 2 END AS ttft_ms, CASE WHEN event_id % 5 <> 0 THEN event_id % 9 END AS generation_tokens,
       CASE WHEN event_id % 3 <> 0 THEN event_id % 7 END AS cached_tokens, event_id % 11 AS prompt_tokens,
       CASE WHEN event_id % 10 = 3 THEN 'invalid' WHEN event_id % 97 = 5 THEN 'failed' ELSE 'valid' END AS status
FROM events
"""
