"""Exact-match evaluation: accuracy over every grouping, macro accuracy, invalid examples, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.answers import category_of, category_rank, option_letters, unpermuted, with_assessment
from ..functions.text import clean, is_blank

MISSING = "<missing>"


class InputError(ValueError):
    """Inputs that cannot be aligned safely."""


def id_counts(rows: DataFrame, id_col: str = "qa_id", examples: int = 5) -> DataFrame:
    """One row: blank ids, ids that occur twice or more, the first of them in order."""
    per = rows.groupBy(clean(id_col).alias("id")).count()
    twice = (F.col("id") != "") & (F.col("count") > 1)
    first = per.where(twice).select("id").orderBy("id").limit(examples).agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("id") == "", F.col("count"))), F.lit(0)).alias("blank"), F.count_if(twice).alias("duplicates")).crossJoin(first)


def id_difference(expected: DataFrame, actual: DataFrame, id_col: str = "qa_id") -> DataFrame:
    """id and side (``missing`` or ``unexpected``) of ids that only one of the tables has."""
    a = expected.select(clean(id_col).alias("id")).distinct().withColumn("x", F.lit(1))
    b = actual.select(clean(id_col).alias("id")).distinct().withColumn("y", F.lit(1))
    both = a.join(b, "id", "full_outer")
    return both.where("x is null or y is null").select("id", F.when(F.col("y").isNull(), "missing").otherwise("unexpected").alias("side"))


def require_aligned(references: DataFrame, predictions: DataFrame, id_col: str = "qa_id") -> None:
    """Raise unless both tables have the same unique ids; rows are never silently intersected."""
    for name, rows in (("references", references), ("predictions", predictions)):
        found = id_counts(rows, id_col).first()
        if found["blank"]:
            raise InputError(f"{name}: {found['blank']} blank {id_col}")
        if found["duplicates"]:
            raise InputError(f"{name}: duplicate {id_col} {found['examples']}")
    sides = {r["side"]: r["count"] for r in id_difference(references, predictions, id_col).groupBy("side").count().collect()}
    if sides:
        raise InputError(f"ids differ: {sides}")


def assessed(references: DataFrame, predictions: DataFrame, id_col: str = "qa_id") -> DataFrame:
    """Each reference with its prediction, both in canonical form, and whether they agree."""
    p = predictions.select(clean(id_col).alias("_id"), F.col("prediction").alias("raw"))
    rows = references.withColumn("_id", clean(id_col)).join(p, "_id")
    rows = rows.withColumn("_options", option_letters())
    rows = with_assessment(with_assessment(rows, "answer", "category", "_options", "_truth"), "raw", "category", "_options", "_given")
    return rows.select(
        F.col("_id").alias(id_col),
        category_of("category").alias("category"),
        F.when(is_blank("source"), F.lit(MISSING)).otherwise(clean("source")).alias("source"),
        F.when(is_blank("path"), F.col("_id")).otherwise(clean("path")).alias("clip"),
        "raw",
        F.col("_truth.canonical").alias("truth"),
        F.col("_given.canonical").alias("given"),
        F.col("_given.error").alias("error"),
        F.coalesce(F.col("_truth.canonical") == F.col("_given.canonical"), F.lit(False)).alias("correct"),
    )


def accuracy_cube(rows: DataFrame) -> DataFrame:
    """correct, total, invalid and accuracy at each of (), (category), (source), (source, category).

    ``grain`` names the grouping; columns that a grouping leaves out are null.
    """
    grain = F.element_at(F.array(*map(F.lit, ("source,category", "source", "category", "all"))), F.grouping_id().cast("int") + 1)
    return (
        rows.cube("source", "category")
        .agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"), F.count_if(F.col("given").isNull()).alias("invalid"), grain.alias("grain"))
        .withColumn("accuracy", F.col("correct") / F.col("total"))
    )


def clip_macro(rows: DataFrame) -> DataFrame:
    """Mean over clips of the mean correctness of a clip's questions, and the number of clips."""
    per = rows.groupBy("clip").agg(F.avg(F.col("correct").cast("double")).alias("mean"))
    return per.agg(F.count("*").alias("clips"), F.coalesce(F.avg("mean"), F.lit(0.0)).alias("accuracy"))


def invalid_examples(rows: DataFrame, order: Column | str, limit: int = 20) -> DataFrame:
    """The first invalid predictions in reference order (a report)."""
    return rows.where("given is null").orderBy(order).limit(limit)


def agreement(left: DataFrame, right: DataFrame, id_col: str = "qa_id", examples: int = 10) -> DataFrame:
    """shared, identical, agreement and the first differing ids of two runs' predictions."""
    a = left.select(id_col, F.col("prediction").alias("x"))
    both = a.join(right.select(id_col, F.col("prediction").alias("y")), id_col)
    same = F.col("x").eqNullSafe(F.col("y"))
    differ = both.where(~same).select(id_col).orderBy(id_col).limit(examples).agg(F.array_sort(F.collect_list(id_col)).alias("differing"))
    return both.agg(F.count("*").alias("shared"), F.count_if(same).alias("identical")).withColumn("agreement", F.try_divide("identical", "shared")).crossJoin(differ)


def transitions(left: DataFrame, right: DataFrame, id_col: str = "qa_id") -> DataFrame:
    """How many questions went from (in)correct in one run to (in)correct in the other."""
    a = left.select(id_col, F.col("correct").alias("before"))
    return a.join(right.select(id_col, F.col("correct").alias("after")), id_col).groupBy("before", "after").agg(F.count("*").alias("questions"))


def improves(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: both accuracies and whether the other run's is higher (the gate of a further step)."""
    a = base.agg(F.avg(F.col("correct").cast("double")).alias("base"))
    return a.crossJoin(other.agg(F.avg(F.col("correct").cast("double")).alias("other"))).withColumn("opens", F.col("other") > F.col("base"))


def in_target_order(records: DataFrame, targets: DataFrame, id_col: str = "qa_id") -> DataFrame:
    """Records with the position of their target, ids that are not targets left out."""
    return records.join(targets.select(id_col, "pos"), id_col)


def order_violations(records: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Records (seq, pos) that stand after one of a later target.

    Only the greatest places of blocks of ``block`` consecutive records are ordered as a whole.
    """
    rows = records.withColumn("_block", F.floor(F.col("seq") / block))
    tops = rows.groupBy("_block").agg(F.max("pos").alias("_top"))
    tops = tops.select("_block", F.max("_top").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"))
    inside = F.max("pos").over(W.partitionBy("_block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_inside", inside).join(tops, "_block").withColumn("before", F.greatest("_inside", "_earlier")).where("before >= pos").drop("_block", "_inside", "_earlier")


def in_taxonomy_order(rows: DataFrame, category: str = "category") -> DataFrame:
    """Rows of a report with the known categories in the order of the taxonomy, then the others by name."""
    return rows.orderBy(category_rank(category).asc_nulls_last(), category)


def option_order_consistency(base: DataFrame, shown: DataFrame, orders: DataFrame) -> DataFrame:
    """How far answers hold when options are shown in another order, for each category.

    ``base`` and ``shown`` are assessed rows (`assessed`) of the same questions, ``shown`` answered over options in the order of
    ``orders`` (qa_id, order: the 0-based original place of each option shown). Answers go back to original letters
    by their place in the order, sorted again where order has no meaning; of questions that both runs answer
    validly, ``same`` counts those with the same answer. ``moved`` are shown in another order at all.
    """
    back = shown.select("qa_id", F.col("given").alias("_shown")).join(orders, "qa_id")
    rows = base.select("qa_id", "category", "given").join(back, "qa_id")
    rows = rows.withColumn("_back", unpermuted("_shown", "order", "category")).withColumn("moved", F.col("order") != F.array_sort("order"))
    both = F.col("given").isNotNull() & F.col("_back").isNotNull()
    same = both & (F.col("given") == F.col("_back"))
    return rows.groupBy("category").agg(
        F.count("*").alias("questions"), F.count_if("moved").alias("moved"), F.count_if(both).alias("both_valid"), F.count_if(same).alias("same"), F.count_if(same & F.col("moved")).alias("same_moved"),
        F.try_divide(F.count_if(same), F.count_if(both)).alias("consistency"),
    )
