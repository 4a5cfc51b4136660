"""Streaming forms (extensions): live accuracy and latency, memory peaks, resumable ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_latency(events: DataFrame, ts: str = "ts", value: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and largest value of each window and type; events later than ``late`` are left out by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(F.col("w.start").alias("start"), "event_type", "n", "mean", "max")


def live_memory(readings: DataFrame) -> DataFrame:
    """Running first, last and largest use of each device (complete mode)."""
    return readings.groupBy("device").agg(F.min_by("used_mib", "ts").alias("first_used"), F.max_by("used_mib", "ts").alias("last_used"), F.max("used_mib").alias("max_used"), F.min("free_mib").alias("min_free"))


def resume_into(requests: DataFrame, path: str, checkpoint: str, run, id_col: str = "qa_id"):
    """Stream requests through ``run`` (DataFrame to records), each target once; returns the query.

    Each micro-batch leaves out targets that the table at ``path`` has as valid, so a restart goes on
    where it stopped even if the last batch is delivered again.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            rows = rows.join(spark.read.parquet(path).where("status = 'valid'").select(id_col), id_col, "left_anti")
        run(rows.dropDuplicates([id_col])).write.mode("append").parquet(path)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
