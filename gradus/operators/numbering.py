"""Positions of rows in an order, without a task that holds all rows.

Splitters from a sample cut the order into ranges; a count of each range gives the position at which
it begins, and inside a range rows are numbered by a window. Splitters are values in the plan, so a row's
range, and with it its number, is the same whenever it is computed: they decide how even the ranges
are, never what comes out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows sampled for each range.
SAMPLE = 32


def splitters(rows: DataFrame, order: list[str], ranges: int, n: int) -> Column | None:
    """An ascending array of fewer than ``ranges`` places of the order, from a sample; null if there are none."""
    key = F.struct(*order)
    few = rows.select(key.alias("k")).sample(min(1.0, 1.2 * SAMPLE * ranges / max(1, n)), 17)
    text = few.agg(F.to_json(F.sort_array(F.collect_set("k")), {"ignoreNullFields": "false"})).first()[0]
    found = json.loads(text or "[]")
    cut = [found[i] for i in sorted({len(found) * k // ranges for k in range(1, ranges)})] if len(found) > 1 else []
    if not cut:
        return None
    kind = rows.select(F.array(key)).schema[0].dataType
    # a constant of the plan: functions with lambdas, like array_sort, would be computed again for every row
    return F.sort_array(F.array_distinct(F.from_json(F.lit(json.dumps(cut)), kind)))


def _range(key: Column, cut: Column, ranges: int) -> Column:
    """How many of fewer than ``ranges`` splitters are not above a key, by halving."""
    steps = F.lit([1 << k for k in reversed(range((ranges - 1).bit_length()))] or [1])
    search = F.transform(F.array(key), lambda k: F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cut, at + step - 1) <= k, step).otherwise(0)))
    return F.get(search, F.lit(0))


def numbered(rows: DataFrame, order: list[str], name: str = "row", ranges: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with their 0-based position in ``order`` (nulls first), and how many they are.

    Rows that are equal in all of ``order`` are numbered one after the other in any order. Counts and sample
    are taken when called; ``rows`` must give the same again.
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    cut = splitters(rows, order, ranges, n) if n else None
    if cut is None:  # nothing to tell rows apart by
        return rows.withColumn(name, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).cast("long") - 1), n
    rows = rows.withColumn("_range", _range(F.struct(*order), cut, ranges))
    sizes = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}  # ``ranges`` rows at most
    before, starts = 0, []
    for k in range(ranges + 1):
        starts.append(before)
        before += sizes.get(k, 0)
    if before != n:
        raise ValueError("the rows to be numbered changed while they were counted")
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return rows.withColumn(name, F.lit(starts)[F.col("_range")] + inside - 1).drop("_range"), n
