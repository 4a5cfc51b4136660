import datetime
import random

import pytest
from pyspark.sql import functions as F

from gradus.operators import numbering, runs
from gradus.plans.catalogue import QUERIES

from .conftest import DATA, plan


def hot(spark, n=4000):
    """A third of all rows share the first column of the order; some have nulls in it."""
    r = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 101 == 0 else r.choice("abcxyz") * r.randint(0, 3), r.uniform(-1e6, 1e6), datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=r.randrange(10**12))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, name string, x double, ts timestamp").repartition(5, "id")


@pytest.mark.parametrize("order", [["name", "id"], ["x", "id"], ["ts", "id"], ["id"]])
@pytest.mark.parametrize("ranges", [2, 13, 200])
def test_numbered(spark, order, ranges):
    rows = hot(spark)
    got, n = numbering.numbered(rows, order, "row", ranges)
    at = {r["id"]: r["row"] for r in got.collect()}
    want = sorted(rows.collect(), key=lambda r: [(r[c] is not None, r[c] if r[c] is not None else 0) for c in order])
    assert n == 4000 and [at[r["id"]] for r in want] == list(range(n)) and got.columns == [*rows.columns, "row"]
    assert "SinglePartition" not in plan(got)


def test_ranges_are_even(spark):
    got, _ = numbering.numbered(hot(spark), ["name", "id"], "row", 8)
    per = got.groupBy(F.expr("row div 500")).count().collect()
    assert len(per) == 8 and all(r["count"] == 500 for r in per)
    cut = numbering.splitters(hot(spark), ["name", "id"], 8, 4000)
    sizes = [r["count"] for r in hot(spark).groupBy(numbering._range(F.struct("name", "id"), cut, 8).alias("k")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


@pytest.mark.parametrize("n", [0, 1, 2, 5, 64, 65])
def test_blocks_of_all_rows(spark, n):
    rows = spark.range(n).repartition(3)
    blocks = [r["count"] for r in runs.replica_blocks(rows, ["id"], 4).groupBy("replica").count().orderBy("replica").collect()]
    assert blocks == [x for x in (n // 4 + (k < n % 4) for k in range(4)) if x]
    assert {(r["id"], r["replica"]) for r in runs.round_robin(rows, ["id"], 3).collect()} == {(i, i % 3) for i in range(n)}
    assert {(r["id"], r["batch"]) for r in runs.batches(rows, ["id"], 8).collect()} == {(i, i // 8) for i in range(n)}


@pytest.mark.parametrize("order", [["name", "id"], ["x", "id"], ["ts", "id"]])
@pytest.mark.parametrize("ranges", [2, 3, 8, 9, 200])
def test_splitters_are_a_constant_and_ranges_are_as_counted(spark, order, ranges):
    rows = hot(spark)
    cut = numbering.splitters(rows, order, ranges, 4000)
    got = rows.select(numbering._range(F.struct(*order), cut, ranges).alias("k"), F.size(F.filter(cut, lambda x: x <= F.struct(*order))).alias("want"))
    optimized = got._jdf.queryExecution().optimizedPlan().toString()
    # nothing is parsed or sorted for every row
    assert not any(f in optimized for f in ("from_json", "array_sort", "sort_array", "array_distinct"))
    assert got.where("k <=> want").count() == 4000 and got.select("k").distinct().count() > ranges // 2


def test_rows_alike_in_the_order_are_all_numbered(spark):
    got, n = numbering.numbered(spark.range(300).select(F.lit(1).alias("k"), "id"), ["k"])
    assert n == 300 and sorted(r["row"] for r in got.collect()) == list(range(300))


@pytest.mark.parametrize("name", ["global_batches", "global_blocks", "global_round_robin"])
def test_queries_have_no_single_task(spark, name):
    assert "SinglePartition" not in plan(QUERIES[name](spark, DATA))
