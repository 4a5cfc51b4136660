import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from gradus.operators import percentiles, profiling
from gradus.plans.catalogue import QUERIES

from .conftest import DATA, plan


def rank_key(x):
    """Order by IEEE bits; zeros alike, NaN last."""
    if math.isnan(x):
        return (2047 << 52) + 1
    bits = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -bits if x < 0 else bits


def brute(values):
    v = sorted((x for x in values if x is not None), key=rank_key)
    return [v[(len(v) * p + 99) // 100 - 1] if v else None for p in percentiles.PERCENTILES]


def spread(seed, n):
    r = random.Random(seed)
    return [r.choice([1, -1]) * 10.0 ** r.uniform(-300, 300) for _ in range(n)]


CASES = {
    "from 1e-300 to 1e300": spread(1, 3000),
    "one outlier": [1.0 + k * 1e-9 for k in range(2000)] + [1e300],
    "last bits": [100.0 + k * 2.0**-46 for k in range(500)] * 3,
    "times of a day": [1.7e9 + k * 1e-3 for k in range(3000)],
    "subnormal": [k * 5e-324 for k in range(-50, 200)] + [2.0**-1022, 2.0**-1022 - 5e-324, 2.0**-1021],
    "powers of two": [2.0**k for k in range(-1074, 1024, 3)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 7)],
    "no numbers": [float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 1.5, None, None],
    "ties": [3.0] * 1000 + [2.0, 4.0],
    "one": [7.0],
    "nulls": [None] * 5,
    "integers": [float(k % 17) for k in range(999)],
}


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(k if k != "ties" else None, v) for k, values in CASES.items() for v in values], "k string, v double").repartition(6).cache()


@pytest.mark.parametrize("most", [1 << 14, 3], ids=["broadcast", "joined"])
def test_against_sorted_values(series, most):
    got = {r["k"]: r for r in percentiles.summary(series, "v", ("k",), most).collect()}
    assert len(got) == len(CASES)
    for name, values in CASES.items():
        r = got[name if name != "ties" else None]
        assert [rank_key(x) if x is not None else None for x in (r[f"p{p}"] for p in percentiles.PERCENTILES)] == [rank_key(x) if x is not None else None for x in brute(values)], name
        own = [x for x in values if x is not None]
        assert (r["requests"], r["count"]) == (len(values), len(own))
        if own and all(map(math.isfinite, own)) and max(map(abs, own)) < 1e100:
            mean = math.fsum(own) / len(own)
            assert r["mean"] == pytest.approx(mean) and r["min"] == min(own) and r["max"] == max(own)
            assert r["stdev"] == pytest.approx(math.sqrt(math.fsum((x - mean) ** 2 for x in own) / len(own)), rel=1e-6, abs=1e-15 * abs(mean))


def test_order_key_is_the_bits(spark, series):
    for r in series.select("v", percentiles.order_key(F.col("v")).alias("k")).collect():
        assert r["k"] == (None if r["v"] is None else rank_key(r["v"]))


def test_passes_stop_when_all_is_settled(spark, monkeypatch):
    calls = []
    real = percentiles.narrowed
    monkeypatch.setattr(percentiles, "narrowed", lambda *a: calls.append(a[2]) or real(*a))
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") / 7.0).alias("v"))
    percentiles.summary(rows, "v", ("k",)).collect()
    assert calls == [1]
    calls.clear()
    percentiles.summary(spark.range(50).select(F.lit(2.0).alias("v")), "v").collect()
    assert calls == []


def test_cells_are_combined_where_the_rows_are(spark):
    """What a pass moves grows with the cells, not with the rows."""
    rows = spark.range(200_000).select(F.lit(0).alias("k"), (100 + F.rand(3)).alias("v"))
    base = rows.select(F.struct("k").alias("_key"), F.col("v").alias("_v")).withColumn("_code", percentiles.order_key(F.col("_v")))
    text = percentiles.moments(base)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "partial_count" in text and text.count("Exchange hashpartitioning") + text.count("Exchange (") <= 4
    assert base.select(F.shiftright("_code", percentiles.DIGITS[0])).distinct().count() < 20


@pytest.mark.parametrize("name", ["latency_describe", "steady_state", "ttft_coverage"])
def test_bounded_work(spark, monkeypatch, name):
    """Two scans and six exchanges of the passes at most; the result itself reads nothing again."""
    plans = []
    for f in ("moments", "narrowed"):
        monkeypatch.setattr(percentiles, f, lambda *a, real=getattr(percentiles, f): plans.append(plan(df := real(*a)).split("== Initial Plan ==")[-1]) or df)
    out = QUERIES[name](spark, DATA)
    assert out.count() > 0 and "FileScan" not in plan(out)
    windows = 1 if name == "steady_state" else 0
    assert sum(p.count("FileScan") for p in plans) <= 2
    assert sum(p.count("Exchange hashpartitioning") for p in plans) - 2 * windows <= 6


def test_describe_of_nothing(spark):
    r = profiling.describe(spark.createDataFrame([], "v double"), "v").first()
    assert r["count"] == 0 and r["p50"] is None and r["mean"] is None
    assert profiling.describe(spark.createDataFrame([], "k int, v double"), "v", ("k",)).count() == 0
