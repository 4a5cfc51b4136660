"""Exact nearest-rank percentiles of groups: a radix histogram over the digits of doubles.

A double has a 64-bit key in its order; the key has three digits. A pass counts the values of each
group by one digit (counts are combined where the rows are, so what moves are cells, not values)
and running sums over the cells tell which one holds each rank. The next pass looks at
the rows of these cells alone, by the next digit. A cell whose least and greatest value are the same is
settled, and there is no pass that nothing is open for: two are usual, three are the most. No
cell table has more than 2^22 rows a group, whatever the number of rows, their spread or outliers.

Cells with a rank in them are few, four a group. They are collected and broadcast where they are ``MOST`` groups at
most; else they stay tables and the passes are joined by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PERCENTILES = (50, 90, 95, 99)
#: Bits below each digit.
DIGITS = (42, 21, 0)
MOST = 1 << 14
_INF = 2047 << 52


def order_key(v: Column) -> Column:
    """A long that orders as the double does: sign and magnitude, both zeros 0, NaN above all."""
    a = F.abs(v)
    e = F.floor(F.log2(a))
    # the logarithm may be rounded over a power of two
    e = e + F.when(F.pow(F.lit(2.0), e.cast("double")) > a, -1).when(F.pow(F.lit(2.0), (e + 1).cast("double")) <= a, 1).otherwise(0)
    normal = (e + 1023) * F.lit(1 << 52) + ((a / F.pow(F.lit(2.0), e.cast("double")) - 1) * float(1 << 52)).cast("long")
    small = (a * 2.0**537 * 2.0**537).cast("long")
    size = F.when(F.isnan(a), F.lit(_INF + 1)).when(a == float("inf"), F.lit(_INF)).when(a < 2.0**-1022, small).otherwise(normal)
    return F.when(v.isNotNull(), F.when(v < 0, -size).otherwise(size))


def _cell(digit: int) -> Column:
    return F.shiftright("_code", DIGITS[digit])


def _ranked(cells: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``to``: the values up to and with a cell's, in the order of cells."""
    return cells.withColumn("to", F.sum("n").over(W.partitionBy(*by).orderBy("cell")))


def _inside(wanted: Column) -> Column:
    """Those of (p, rank) that fall into a cell, with the cell and the rank in it."""
    before = F.col("to") - F.col("n")
    own = F.filter(wanted, lambda x: (x["rank"] > before) & (x["rank"] <= F.col("to")))
    return F.transform(own, lambda x: F.struct(x["p"].alias("p"), F.col("cell").alias("cell"), (x["rank"] - before).alias("rank"), "lo", "hi", F.col("least").alias("v")))


def _counted() -> list[Column]:
    return [F.count("_v").alias("n"), F.min("_code").alias("lo"), F.max("_code").alias("hi"), F.min("_v").alias("least")]


def _some(c: Column) -> Column:
    return F.flatten(F.collect_list(F.when(F.size(c) > 0, c)))


def moments(base: DataFrame) -> DataFrame:
    """First pass: a row for each group with its moments, and the cells that hold its percentiles."""
    cells = base.groupBy("_key", _cell(0).alias("cell")).agg(*_counted(), F.count("*").alias("rows"), F.sum("_v").alias("s"), F.max("_v").alias("most"), F.var_pop("_v").alias("var"))
    whole = W.partitionBy("_key")
    cells = _ranked(cells, ["_key"]).withColumns({"all": F.sum("n").over(whole), "mu": F.try_divide(F.sum("s").over(whole), F.sum("n").over(whole))})
    wanted = F.array(*(F.struct(F.lit(p).alias("p"), F.expr(f"(all * {p} + 99) div 100").alias("rank")) for p in PERCENTILES))
    apart = F.col("n") * (F.col("var") + (F.col("s") / F.col("n") - F.col("mu")) * (F.col("s") / F.col("n") - F.col("mu")))
    per = cells.groupBy("_key").agg(
        F.sum("rows").alias("requests"), F.sum("n").alias("count"), F.sum("s").alias("total"), F.first("mu").alias("mean"), F.min("least").alias("min"), F.max("most").alias("max"),
        F.sum(F.when(F.col("n") > 0, apart)).alias("apart"), _some(_inside(wanted)).alias("found"),
    )
    return per.withColumn("stdev", F.sqrt(F.try_divide("apart", "count"))).drop("apart")


def narrowed(base: DataFrame, groups: DataFrame, digit: int, small: bool) -> DataFrame:
    """``groups`` with the open cells of ``found`` replaced by cells of the next digit."""
    ends = groups.select("_key", F.inline("found")).where("lo < hi").groupBy("_key", F.col("cell").alias("_in")).agg(F.collect_list(F.struct("p", "rank")).alias("want"))
    ends = ends.select(F.col("_key").alias("_k"), "_in", "want")
    rows = base.join(F.broadcast(ends) if small else ends, (F.col("_key") == F.col("_k")) & (_cell(digit - 1) == F.col("_in")))
    cells = rows.groupBy("_key", "_in", "want", _cell(digit).alias("cell")).agg(*_counted())
    per = _ranked(cells, ["_key", "_in"]).groupBy(F.col("_key").alias("_k")).agg(_some(_inside(F.col("want"))).alias("fresh"))
    settled = F.filter("found", lambda x: x["lo"] == x["hi"])
    out = groups.join(F.broadcast(per) if small else per, F.col("_key") == F.col("_k"), "left")
    return out.withColumn("found", F.concat(settled, F.coalesce("fresh", F.array().cast(groups.schema["found"].dataType)))).drop("_k", "fresh")


def summary(rows: DataFrame, value: str, keys: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """requests (rows), count (values), total, mean, min, max, population deviation and percentiles of each group.

    Values are doubles; nulls do not count, NaN is above all. Without keys there is one row, also of
    nothing. Null keys are a group. Runs its passes when called.
    """
    spark = rows.sparkSession
    base = rows.select(F.struct(*keys or [F.lit(0).alias("_")]).alias("_key"), F.col(value).cast("double").alias("_v")).withColumn("_code", order_key(F.col("_v")))
    groups, small = moments(base), True
    for digit in range(1, len(DIGITS) + 1):
        if small:
            got = groups.limit(most + 1).collect()
            small = len(got) <= most
            if small:
                groups = spark.createDataFrame(got, groups.schema)
                if all(f["lo"] == f["hi"] for r in got for f in r["found"]):
                    break
        if digit < len(DIGITS):
            groups = narrowed(base, groups, digit, small)
    if not keys and not got:
        groups = spark.range(1).select(*(F.lit(0 if c in ("requests", "count") else None).cast(t).alias(c) for c, t in groups.dtypes))
    at = {p: F.expr(f"get(filter(found, x -> x.p = {p}), 0).v") for p in PERCENTILES}
    return groups.select(*(F.col("_key")[k].alias(k) for k in keys), "requests", "count", "total", "mean", "min", "max", "stdev", *(c.alias(f"p{p}") for p, c in at.items()))
