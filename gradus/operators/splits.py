"""Splits: assignment, coverage, group leaks, distribution shifts, duplicate questions, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squeeze


def split_of(fold: Column | str) -> Column:
    """Folds 0 to 2 train, 3 develops, 4 confirms; others are null."""
    fold = F.col(fold) if isinstance(fold, str) else fold
    return F.when(fold.between(0, 2), "train").when(fold == 3, "dev").when(fold == 4, "confirm")


def without_pilot(rows: DataFrame, pilot: DataFrame, id_col: str = "qa_id") -> DataFrame:
    return rows.join(pilot.select(id_col), id_col, "left_anti")


def misplaced_pilot(pilot: DataFrame, folds: DataFrame, id_col: str = "qa_id", fold: int = 4) -> DataFrame:
    """Pilot ids that no fold holds, or another fold than theirs."""
    return pilot.select(id_col).join(folds.select(id_col, "fold"), id_col, "left").where(f"fold is null or fold <> {fold}")


def first_of_each(rows: DataFrame, key: str, order: str, n: int = 16) -> DataFrame:
    """The first n rows of each split, in order."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(order))).where(f"_rn <= {n}").drop("_rn")


def coverage(samples: DataFrame, cache: DataFrame, key: str, split: str = "split", examples: int = 10) -> DataFrame:
    """expected, available, missing, first missing keys and status of each split; nothing is dropped."""
    rows = samples.join(cache.select(key, F.lit(True).alias("_there")).distinct(), key, "left")
    gone = F.col("_there").isNull()
    some = rows.where(gone).withColumn("_rn", F.row_number().over(W.partitionBy(split).orderBy(key))).where(f"_rn <= {examples}")
    some = some.groupBy(split).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    counts = rows.groupBy(split).agg(F.count("*").alias("expected"), F.count("_there").alias("available"), F.count_if(gone).alias("missing"))
    return counts.join(some, split, "left").withColumn("status", F.when(F.col("missing") == 0, "PASS").otherwise("INCOMPLETE"))


def leaking_groups(rows: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups (subjects, clips) that lie in more than one fold."""
    return rows.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def total_variation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Half the sum of absolute differences of two distributions of a category."""
    def share(rows: DataFrame, name: str) -> DataFrame:
        per = rows.groupBy(key).count()
        return per.select(key, (F.col("count") / F.sum("count").over(W.partitionBy())).alias(name))

    both = share(a, "p").join(share(b, "q"), key, "full_outer")
    return both.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"))


def distribution(rows: DataFrame, *keys: str) -> DataFrame:
    """Count and share of each combination of keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def duplicate_questions(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """Groups of equal questions: same category, text and options (as a list, or as a set).

    Gives the group's size, its splits, and whether its answers conflict.
    """
    options = F.array(*(squeeze(x) for x in "ABCD"))
    key = [squeeze("category").alias("category"), squeeze("question").alias("question"), (options if ordered else F.array_sort(options)).alias("options")]
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("split")).alias("splits"), F.count_distinct("answer").alias("answers"))
    return groups.where("n > 1").withColumn("across", F.size("splits") > 1).withColumn("conflict", F.col("answers") > 1)


def modality_coverage(clips: DataFrame, modalities: list[str], keys: tuple[str, ...] = ("split", "source")) -> DataFrame:
    """How many clips of each split and source have each modality."""
    return clips.groupBy(*keys).agg(F.count("*").alias("clips"), *(F.count_if(F.array_contains("modalities", m)).alias(m) for m in modalities))


def clip_manifest(clips: DataFrame, qa: DataFrame, modalities: DataFrame) -> DataFrame:
    """Each clip with its questions' number, ids and categories and its modalities."""
    per = qa.groupBy("clip_key").agg(F.count("*").alias("qa_count"), F.array_sort(F.collect_list("qa_id")).alias("qa_ids"), F.array_sort(F.collect_set("category")).alias("categories"))
    have = modalities.groupBy("clip_key").agg(F.array_sort(F.collect_set("modality")).alias("modalities"))
    return clips.join(per, "clip_key", "left").join(have, "clip_key", "left").withColumn("qa_count", F.coalesce("qa_count", F.lit(0)))


def fold_statistics(rows: DataFrame) -> DataFrame:
    """Questions, clips, subjects and categories of each fold."""
    return rows.groupBy("fold").agg(F.count("*").alias("questions"), F.count_distinct("clip_key").alias("clips"), F.count_distinct("subject_id").alias("subjects"), F.count_distinct("category").alias("categories"))


def missing_actions(rows: DataFrame, action: str = "action") -> DataFrame:
    """Pairs of fold and action that have no row; both lists are small dimensions."""
    return rows.select("fold").distinct().crossJoin(rows.select(action).distinct()).join(rows.select("fold", action).distinct(), ["fold", action], "left_anti")


def merged_caches(first: DataFrame, second: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(rows of both by key, keys whose rows differ): overlapping caches must agree before they merge."""
    both = first.unionByName(second)
    value = F.struct(*sorted(first.columns))
    conflicts = both.groupBy(key).agg(F.count_distinct(F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)).alias("kinds")).where("kinds > 1").select(key)
    return both.dropDuplicates([key]), conflicts


def action_coverage(rows: DataFrame, n_folds: int = 5) -> DataFrame:
    """For each action of ``rows`` (action, subject_id, fold): subjects, folds that have it, the most that could, and the missing ones.

    A subject is in one fold, so an action is in no more folds than it has subjects.
    """
    every = F.sequence(F.lit(0), F.lit(n_folds - 1))
    per = rows.where("action is not null").groupBy("action").agg(F.count_distinct("subject_id").alias("subjects"), F.array_sort(F.collect_set(F.col("fold").cast("int"))).alias("present"))
    return per.select("action", "subjects", F.size("present").alias("folds"), F.least("subjects", F.lit(n_folds)).cast("int").alias("bound"), "present", F.array_except(every, "present").alias("missing"))


def fold_gates(rows: DataFrame, sources: tuple[str, ...], categories: tuple[str, ...], n_folds: int = 5) -> DataFrame:
    """The eleven gates of a fold design over questions (qa_id, subject_id, clip_key, fold, source, category, action).

    ``fold`` is null for a question that has none, ``action`` for a clip without one. Evaluated when called, in a grouping each
    of questions, subjects, clips, folds and actions.
    """
    folds = F.count_distinct("fold").alias("f")
    qa = rows.groupBy("qa_id").agg(F.count("fold").alias("f")).agg(F.count("*").alias("n"), F.coalesce(F.sum("f"), F.lit(0)).alias("given"), F.count_if(F.col("f") == 1).alias("once")).first()
    subjects, clips = (
        rows.groupBy(c).agg(folds, F.count("*").alias("q")).agg(F.count("*").alias("n"), F.coalesce(F.sum("f"), F.lit(0)).alias("given"), F.count_if(F.col("f") == 1).alias("once"), F.coalesce(F.sum(F.when(F.col("f") > 1, F.col("q"))), F.lit(0)).alias("crossing")).first()
        for c in ("subject_id", "clip_key")
    )
    known = F.col("source").isin(*sources), F.col("category").isin(*categories)
    per = rows.where("fold is not null").groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count_distinct("subject_id").alias("subjects"), F.count_distinct(F.when(known[0], F.col("source"))).alias("sources"), F.count_distinct(F.when(known[1], F.col("category"))).alias("categories"))
    per = sorted(per.limit(4 * n_folds).collect())
    actions = action_coverage(rows, n_folds)
    only = {r["fold"]: r["count"] for r in actions.where("folds = 1").groupBy(F.col("present")[0].alias("fold")).count().limit(4 * n_folds).collect()}
    total, short = actions.agg(F.count("*"), F.count_if(F.col("folds") < F.col("bound"))).first()
    kept = [total - only.get(k, 0) for k in range(n_folds)]
    sizes = [r["subjects"] for r in per]
    listed = lambda x: ",".join(map(str, x))
    found = [
        ("subjects_assigned_once", subjects["given"] == subjects["n"] == subjects["once"], subjects["given"], subjects["n"]),
        ("fold_ids", [r["fold"] for r in per] == list(range(n_folds)), listed(r["fold"] for r in per), listed(range(n_folds))),
        ("clips_assigned_once", clips["given"] == clips["n"] == clips["once"], clips["given"], clips["n"]),
        ("questions_assigned_once", qa["given"] == qa["n"] == qa["once"], qa["given"], qa["n"]),
        ("subjects_in_one_fold", subjects["once"] == subjects["n"], subjects["once"], subjects["n"]),
        ("clip_questions_together", clips["crossing"] == 0, clips["crossing"], 0),
        ("training_keeps_actions", all(k == total for k in kept), listed(kept), total),
        ("action_coverage_at_bound", short == 0, short, 0),
        ("subject_balance", bool(sizes) and max(sizes) - min(sizes) <= 1, listed(sizes), "difference <= 1"),
        ("sources_in_every_fold", all(r["sources"] == len(sources) for r in per), listed(r["sources"] for r in per), len(sources)),
        ("categories_in_every_fold", all(r["categories"] == len(categories) for r in per), listed(r["categories"] for r in per), len(categories)),
    ]
    return rows.sparkSession.createDataFrame([(c, "PASS" if ok else "FAIL", str(seen), str(want)) for c, ok, seen, want in found], "code string, status string, observed string, expected string")
