"""Exact dedup by a tree merge of sorted digest runs (DataFrame functions only).

Digests are written once; their files are read by as many tasks as there are shuffle partitions at most, and
each of them is a run in a partition of its own, sorted by digest and reduced to one row per digest with the identifier
that stays. Runs then meet in binomial rounds: in round k every run exchanges with the partners whose
numbers differ from its own in digit k alone, and keeps of all of them the digests that have that digit;
each partition sorts the runs that it gets into one, digest by digest, and retains the verified best identifier
(most code points, then smallest doc_id, then first row) and the number of rows. After one round for
each digit a run holds all of its digests and no other, and the runs together are the whole; at no level does a
partition hold more than its share, nor a text. A digest has one row in each run at most, so a group of
copies that holds a third of all rows costs no more than any other. A run has blocks for ``fan_in`` partners, so
blocks grow with the runs, not with their square, and runs do not grow with the input's files.

"Verified" means that a group's identity is SHA-256 of the normalised text together with
its length and an independent 64-bit hash: rows fall into one group only if all three agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, by_size, staying, text_of

FAN_IN = 16
_KEY = ["text_sha256", "n_norm", "check"]


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: row_id, doc_id, n_points and the digest columns; row ids hold for the table that this is written to."""
    normal = F.regexp_replace(text_of(), f"[{SPACE}]+", "")
    return (
        docs.select("doc_id", normal.alias("_n"), F.length(text_of()).alias("n_points"))
        .select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            "n_points",
            F.sha2(F.col("_n").cast("binary"), 256).alias("text_sha256"),
            F.length("_n").alias("n_norm"),
            F.xxhash64("_n").alias("check"),
        )
    )


def tree_merge(rows: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Winner and size of each digest: sorted runs, ``n_runs`` at most, merged in rounds of exchanges of ``fan_in`` partners at most."""
    rounds = 0
    while fan_in**rounds < n_runs:
        rounds += 1
    digits = next(d for d in range(1, fan_in + 1) if d**rounds >= n_runs)  # as few as make room for all runs
    best = F.struct((-F.col("n_points")).alias("short"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    runs = rows.coalesce(n_runs).withColumns({"run": F.spark_partition_id(), "best": best, "rows": F.lit(1)})
    level = _merged(runs, digits**rounds)
    for k in range(rounds):
        step = digits**k
        own, other = F.expr(f"cast(run div {step} % {digits} as int)"), F.expr(f"cast(pmod(check, {step * digits}L) div {step} as int)")
        level = _merged(level.withColumn("run", F.col("run") + (other - own) * step), digits**rounds)
    return level.select(*_KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), F.col("rows").alias("group_size"))


def _merged(runs: DataFrame, n: int) -> DataFrame:
    """Each run in the partition of its number, sorted; one row for each digest of it."""
    level = runs.repartitionById(n, "run").sortWithinPartitions("run", *_KEY)
    return level.groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Decide for each row of ``docs`` (doc_id, text) whether it stays.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; null counts as
    empty, and empty texts form one group. Of equal texts the row with the most code points,
    then the smallest doc_id stays (null ids after all others; of rows that also share the id
    one, the first read). Returns doc_id, keep_id, group_size, kept, text_sha256; a row for each
    input row, dropped ones too. Other columns of ``docs`` are not read; an empty table gives none.
    Runs its jobs when called; the result is a table in the shared folder.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.stored(digests(docs), "digests")
        total = rows.count()
        winners = scratch.kept(tree_merge(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), fan_in))
        out = by_size(rows, winners, _KEY, "group_size", total)
        out = out.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")
        return scratch.stored(out, "exact", stays=True)


def keep_one(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` without the rows that `exact_dedup` drops, row by row: null and repeated ids do not matter.

    Rows without an id are documents that stay unless they are copies; they come after all others.
    """
    return staying(docs, lambda rows: exact_dedup(rows, fan_in))
