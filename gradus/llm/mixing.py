"""Mixing sources to target weights.

Sizes (words) are summed per source, targets follow from the weights, and each document is
emitted floor(rate) times plus one copy with the probability of the fraction, where rate is its source's
target over its source's size. The draws of a source are dependent: one offset, seeded by a hash, is added to the
running fractions of its documents in the order of their sizes (equal ones in the order of a hash), and a document is drawn where the
sum passes a whole number. What a source takes is then within its largest document of its target.

Places in that order come from ranges of sizes: a source's documents fall into strata of bounded length, strata are counted,
and prefix sums of the counts are added to the place inside a stratum, so a hot source is never ordered as
a whole; only the tables of sources and strata are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Scratch, text_of

WEIGHTS = (1, 2, 3)
#: A source's target, and so a document's copies, stop at this many times its size.
MOST = 3
SEED = "gradus-mix"
#: Documents of a stratum, about.
STRATUM = 1 << 20


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of a table of (source, size) rows.

    Sources in code point order, null last, take the weights in turn and share the whole size;
    a target stops at ``most`` times its source's size and the excess is shared again by weight.
    With sources in the order of size over weight, those that stop are a prefix, so running sums
    find the final share per weight at once.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("s"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    per = per.select("source", "s", w.cast("long").alias("w"))
    order = W.orderBy((F.col("s") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    per = per.withColumn("left", F.sum("s").over(every) - F.coalesce(F.sum(most * F.col("s")).over(before), F.lit(0)))
    per = per.withColumn("share", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    free = F.when(F.col("w") * F.col("share") <= float(most) * F.col("s"), F.struct((F.col("s") / F.col("w")).alias("o"), F.col("source").isNull().alias("n"), "source", "share"))
    per = per.withColumn("final", F.min(free).over(every)["share"])
    return per.select("source", F.col("s").alias("source_size"), F.least(float(most) * F.col("s"), F.coalesce(F.col("w") * F.col("final"), float(most) * F.col("s"))).alias("target"))


def _uniform(name: Column) -> Column:
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def marked(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source) with what decides about them: size, range of sizes, digests of name and text."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5(text_of())), F.lit(":"), F.coalesce(F.col("source"), F.lit("")))
    rows = docs.withColumns({"size": n_words(text_of()), "_own": F.md5(F.concat(F.lit(f"{seed}:"), name)), "_text": F.md5(text_of())})
    # eight ranges for each doubling of the size
    exponent = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")))
    part = F.greatest(F.lit(0), F.floor((F.col("size") / F.pow(F.lit(2.0), exponent.cast("double")) - 1) * 8))
    return rows.withColumn("_part", F.when(F.col("size") > 0, exponent * 8 + part + 1).otherwise(0).cast("int"))


def dealt(rows: DataFrame, rates: DataFrame, seed: str = SEED, stratum: int = STRATUM) -> DataFrame:
    """`marked` rows with source_size, target and copies: floor(rate) and one more where the draw says so."""
    kept = rows.columns
    sizes = rows.groupBy(F.col("source").alias("_source"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    slots = sizes.select("_source", "_p", F.expr(f"_n div {stratum} + 1").alias("_slots"))
    slot = F.pmod(F.conv(F.substring("_own", 14, 12), 16, 10).cast("long"), F.col("_slots")).alias("_slot")
    places = rows.select("source", "_part", "_own").join(slots, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p"))).groupBy("_source", "_p", "_slots", slot).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_source").orderBy("_p", "_slot").rowsBetween(W.unboundedPreceding, -1))  # a row a stratum
    places = places.select("_source", "_p", "_slots", "_slot", F.coalesce(before, F.lit(0)).alias("_before"))
    rates = rates.select(F.col("source").alias("_of"), "source_size", "target")
    strata = places.join(rates, F.col("_source").eqNullSafe(F.col("_of"))).groupBy("_source", "_p", "source_size", "target", "_slots").agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_before"))).alias("_places"))
    rows = rows.join(strata, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p"))).withColumn("_slot", slot)
    place = F.element_at("_places", F.col("_slot")) + F.row_number().over(W.partitionBy("source", "_part", "_slot").orderBy("size", "_own", "_text"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"_rate": rate, "_place": place.cast("double"), "_offset": _uniform(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))))})
    passed = lambda n: F.floor((F.col("_rate") - F.floor("_rate")) * n + F.col("_offset"))
    copies = F.floor("_rate") + passed(F.col("_place")) - passed(F.col("_place") - 1)
    return rows.withColumn("copies", copies.cast("long")).select(*kept, "source_size", "target", "copies")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source).

    Returns doc_id, size, source_size, target, taken (size times copies), copies. Null texts have
    size 0, null sources are a source of their own; a source of size 0 has target 0. Draws depend
    on doc_id, text and source alone, so reruns agree; rows that repeat all three are alike, so it does not
    matter which of them is drawn. What a source takes differs from its target by less than its largest document
    (by that of each stratum, where it has more than ``STRATUM`` documents of about one size). An
    empty table gives no rows. Runs its jobs when called; the result is a table in the shared folder.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.kept(marked(docs.select("doc_id", "text", "source"), seed).drop("text"))
        rates = scratch.stored(targets(rows.select("source", "size"), weights, most), "rates")
        out = dealt(rows, rates, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
        return scratch.stored(out, "mixture", stays=True)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns unchanged."""
    rows = marked(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row")), seed).drop("doc_id", "text")
    out = dealt(rows, targets(rows.select("source", "size"), weights, most), seed).where("copies > 0")
    return out.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).select("_row.*")
