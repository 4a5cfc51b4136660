"""Records of CSV files, read in many tasks though quoted cells may hold line breaks.

Spark splits a file at line breaks. Whether a line begins inside quotes depends on the number of quote marks
before it: sums over each split's lines, and prefix sums over the splits, give it for every line. A
line that begins outside begins a record; lines that begin inside belong to the record before, and only these
records are put together. Positions come from prefix counts of the records of each split, and of each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SPLIT = ["file", "start"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of its split), line (in the order of the split), value, quotes (marks before the line, modulo 2)."""
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), "value"
    )
    marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    rows = rows.withColumn("marks", F.pmod(marks, F.lit(2)))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    splits = rows.groupBy(*_SPLIT).agg(F.sum("marks").alias("n")).select(*_SPLIT, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried"))
    inside = W.partitionBy(*_SPLIT).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(splits, _SPLIT)
    return rows.withColumn("quotes", F.pmod(F.col("carried") + F.coalesce(F.sum("marks").over(inside), F.lit(0)), F.lit(2))).drop("carried")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, row (in the file, from 0: its header), pos (over all files in the order of their names, without headers; -1 for a header), text.

    ``path`` is a file, a folder or a pattern. Empty lines outside of quotes are no records; a carriage return
    before the line break that ends a record is no part of it, one inside quotes is. A last record whose quotes do
    not close has an odd number of marks: `text` then has them as they are.
    """
    rows = lines(spark, path)
    begins = (F.col("quotes") == 0) & ~F.col("value").isin("", "\r")
    rows = rows.where((F.col("quotes") == 1) | begins).withColumn("begins", begins.cast("int"))
    so_far = W.partitionBy(*_SPLIT).orderBy("line")
    rows = rows.withColumn("own", F.sum("begins").over(so_far))
    per = rows.groupBy(*_SPLIT).agg(F.sum("begins").alias("n"))
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*_SPLIT, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    rows = rows.join(per, _SPLIT).withColumn("row", F.col("first") + F.col("own") - 1)
    whole = (F.col("begins") == 1) & (F.col("marks") == 0)
    single = rows.where(whole).select("file", "row", F.col("value").alias("text"))
    parts = rows.where(~whole).groupBy("file", "row").agg(F.sort_array(F.collect_list(F.struct("start", "line", "value"))).alias("v"))
    joined = parts.select("file", "row", F.array_join(F.transform("v", lambda x: x["value"]), "\n").alias("text"))
    every = single.unionByName(joined).withColumn("text", F.regexp_replace("text", "\r$", ""))
    files = rows.groupBy("file").agg(F.sum("begins").alias("n"))
    offset = F.coalesce(F.sum(F.col("n") - 1).over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a file
    files = files.select("file", offset.alias("offset"))
    return every.join(files, "file").select("file", "row", F.when(F.col("row") == 0, -1).otherwise(F.col("offset") + F.col("row") - 1).alias("pos"), "text")
