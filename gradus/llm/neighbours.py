"""Approximate nearest neighbours by an adaptive dimension scan over probed lists.

Vectors are rotated at random; lists are the cells of centroids fitted on a bounded sample. Every
row is indexed in its cell, and each query probes the cells that are nearest to it: as many of them as
find ``RECALL`` of the neighbours that the sample's queries have within the sample, which is measured when the
index is fitted. Lists grow with the square root of the rows. Within a
probed list candidates are scanned in blocks of columns, for many queries at once: after each block
a hypothesis test on the partial distance abandons those that are beyond the query's bound with high
confidence, and rows and queries without a candidate leave the block. A query's bound is the distance
of its k-th nearest in a part of the sample, whose k nearest count as found. Survivors are scored in double precision on the original
vectors.

Largest inner products are nearest neighbours once each vector gets one more coordinate that gives
all the same length, so the distance test applies to any lengths. Lists are split by size, so a cell
that holds a third of the rows is many tasks, and every task gives at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, small_batches

K, QUERY_MOD = 20, 20
#: Most rows of the sample that centroids are fitted on; lists per square root of the rows; bytes of the sample, of the centroids and of the bounding rows at most.
SAMPLE, LISTS, BYTES = 20_000, 0.5, 64 << 20
#: Share of the sample's own neighbours that the probed lists must hold, and the sample's queries it is measured on.
RECALL, MEASURED = 0.97, 512
#: Columns of one step of the scan, and the test's width (larger: fewer wrong rejections).
STEP, WIDTH = 16, 2.1
#: Rows of the sample that queries get their bound from.
BOUNDING = 8192
#: Rows of one part of a list, queries handled together.
PART, QUERIES, ROWS = 4096, 256, 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles of the vectors that take part: finite, not zero, not null."""
    e = F.col("embedding").cast("array<double>")
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", e.alias("embedding")).where(ok)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


class Index:
    """Rotation, centroids and the common length of augmented vectors."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, longest: float, n_rows: int, lists: int | None = None, k: int = K, seed: int = 11):
        r = np.random.default_rng(seed)
        self.longest, dim = longest, sample.shape[1] + 1
        self.rotation = np.linalg.qr(r.standard_normal((dim, dim)))[0]
        lists = int(max(1, min(lists or round(LISTS * n_rows**0.5), len(sample), BYTES // (8 * dim))))
        x = self.rotated(sample)
        self.centres = x[r.choice(len(x), lists, replace=False)]
        for _ in range(5):
            at = self.cells(x)
            count = np.bincount(at, minlength=lists)
            total = np.zeros_like(self.centres)
            np.add.at(total, at, x)
            self.centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], self.centres)
        bounding = min(BOUNDING, BYTES // (16 * dim))
        self.bounding = ids[:bounding], x[:bounding], sample[:bounding]
        self.probes = self.wanted(x, sample, k)

    def wanted(self, x: np.ndarray, sample: np.ndarray, k: int) -> int:
        """How many lists hold ``RECALL`` of the neighbours of the sample's first rows within the sample.

        Neighbours within a sample are farther away than those among all rows, and so in more lists.
        """
        lists, n = len(self.centres), min(MEASURED, len(x))
        k = min(k, len(x) - 1)
        if k < 1:
            return lists
        q, cells = self.rotated(sample[:n], query=True), self.cells(x)
        near = sample[:n] @ sample.T
        near[np.arange(n), np.arange(n)] = -np.inf
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        place = np.empty((n, lists), np.int64)
        np.put_along_axis(place, self.order(q), np.arange(lists)[None, :], 1)
        found = np.sort(np.take_along_axis(place, cells[best], 1).ravel())
        return int(found[min(len(found) - 1, int(np.ceil(RECALL * len(found))) - 1)]) + 1

    def order(self, q: np.ndarray) -> np.ndarray:
        """All lists of each query, nearest first."""
        return np.argsort((self.centres**2).sum(1) / 2 - q @ self.centres.T, axis=1, kind="stable")

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Augmented by the coordinate that fills up the length (none for queries), and turned."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))
        return np.column_stack([x, more]) @ self.rotation

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        half = (self.centres**2).sum(1) / 2
        for lo in range(0, len(x), 4096):
            out[lo : lo + 4096] = (x[lo : lo + 4096] @ self.centres.T - half).argmax(1)
        return out

    def probed(self, q: np.ndarray) -> np.ndarray:
        return self.order(q)[:, : self.probes]

    def bounds(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, list, list]:
        """Squared distance of each query's k-th nearest among the bounding rows, and the ids and scores of these k.

        Infinite, and no rows, where there are fewer.
        """
        known, x, original = self.bounding
        turned = self.rotated(q, query=True)
        out, near, scores = np.full(len(q), np.inf), [[]] * len(q), [[]] * len(q)
        if len(known) <= k:
            return out, near, scores
        for lo in range(0, len(q), QUERIES):
            t = turned[lo : lo + QUERIES]
            far = ((x**2).sum(1) - 2 * t @ x.T) + (t**2).sum(1)[:, None]
            far[ids[lo : lo + QUERIES, None] == known[None, :]] = np.inf
            at = np.argpartition(far, k - 1, axis=1)[:, :k]
            out[lo : lo + QUERIES] = np.take_along_axis(far, at, 1).max(1)
            for i in range(len(t)):
                near[lo + i] = known[at[i]].tolist()
                scores[lo + i] = (original[at[i]] * q[lo + i]).sum(1).tolist()
        return out, near, scores


def scan(index: Index, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best candidates of one part of a list for each query: (query, vec_id, score), k at most of each.

    Candidates whose partial distance over d of D columns exceeds (1 + WIDTH / sqrt(d))^2 * d / D
    times the query's bound go.
    """
    turned, asked = index.rotated(x), index.rotated(q, query=True)
    dim, slack = turned.shape[1], 1e-9 * (1 + index.longest**2)
    got: list[list[np.ndarray]] = [[], []]
    for qa in range(0, len(q), QUERIES):
        for ra in range(0, len(x), ROWS):
            qs, rows = np.arange(qa, min(len(q), qa + QUERIES)), np.arange(ra, min(len(x), ra + ROWS))
            alive = query_ids[qs, None] != ids[None, rows]
            partial = np.zeros(alive.shape)
            for lo in range(0, dim, STEP):
                d = min(dim, lo + STEP)
                t, a = turned[rows, lo:d], asked[qs, lo:d]
                partial += (t**2).sum(1)[None, :]
                partial += (a**2).sum(1)[:, None]
                partial -= 2 * (a @ t.T)
                limit = bound[qs] * (d / dim) * (1 + WIDTH / np.sqrt(d)) ** 2 if d < dim else bound[qs]
                alive &= partial <= (limit + slack)[:, None]
                some = alive.any(0)
                if some.mean() < 0.5:
                    rows, partial, alive = rows[some], partial[:, some], alive[:, some]
                some = alive.any(1)
                if some.mean() < 0.5:
                    qs, partial, alive = qs[some], partial[some], alive[some]
                if not alive.size:
                    break
            i, j = np.nonzero(alive)
            got[0].append(qs[i]), got[1].append(rows[j])
    i, j = (np.concatenate(g) if g else np.zeros(0, np.int64) for g in got)
    score = np.concatenate([np.zeros(0), *((x[j[lo : lo + 65536]] * q[i[lo : lo + 65536]]).sum(1) for lo in range(0, len(i), 65536))])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i)
    best = np.arange(len(i)) - first < k
    return query_ids[i[best]], ids[j[best]], score[best]


def fit(vectors: DataFrame, dim: int, n_rows: int, longest: float, lists: int | None = None, k: int = K) -> Index:
    """Index parameters from a bounded sample of vectors of one length."""
    most = max(1, min(SAMPLE, BYTES // (8 * dim)))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
    return Index(sample.column("vec_id").to_numpy(), _matrix(sample.column("embedding")), longest, n_rows, lists, k)


def neighbours(vectors: DataFrame, k: int = K, query_mod: int = QUERY_MOD, lists: int | None = None) -> DataFrame:
    """The k nearest found of each query, nearest first, ties to the smaller vec_id.

    Queries are the rows of ``vectors`` (vec_id, embedding) whose id is divisible by ``query_mod``,
    candidates all rows but those of the query's own id; nearness is the inner product in double
    precision. Rows with a null id, or a vector that is null, empty, zero or holds null or not finite
    components take no part, nor do vectors of another length than most have (of equals, the greater).
    Of rows that repeat an id the first by component order counts. ``lists`` overrides the number of
    lists. Returns query_id, rank (from 1), vec_id, score; fewer than k rows where there are fewer
    candidates; an empty table gives none. Other columns are not read. Runs its jobs when called; the
    result is a table in the shared folder.
    """
    small_batches(vectors.sparkSession)
    with Scratch(vectors.sparkSession) as scratch:
        return scratch.stored(_searched(vectors, scratch, k, query_mod, lists), "neighbours", stays=True)


def _searched(vectors: DataFrame, scratch: Scratch, k: int, query_mod: int, lists: int | None) -> DataFrame:
    spark = vectors.sparkSession
    rows = scratch.kept(usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    schema = "query_id long, rank int, vec_id long, score double"
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))
    stats = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), F.desc("dim")).first()
    if stats is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == stats["dim"])
    held = spark.sparkContext.broadcast(fit(rows, stats["dim"], stats["n"], stats["longest"], lists, k))  # centroids and bounding rows, of BYTES each at most

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("embedding"))
            at = held.value.cells(held.value.rotated(x)) if len(x) else []
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(at, pa.int64())], names=["vec_id", "embedding", "cell"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column("embedding"))
            turned = held.value.rotated(q, query=True) if len(q) else q
            cells = held.value.probed(turned) if len(q) else np.zeros((0, held.value.probes), np.int64)
            bound, near, scores = held.value.bounds(b.column("vec_id").to_numpy(), q, k) if len(q) else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("embedding"), pa.array(bound, pa.float64()), pa.array(cells.tolist(), pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))],
                names=["vec_id", "embedding", "bound", "cells", "near", "scores"],
            )

    indexed = scratch.kept(rows.mapInArrow(listed, "vec_id long, embedding array<double>, cell long"))
    parts = indexed.groupBy("cell").agg(F.expr(f"cast(ceil(count(*) / {PART}) as int)").alias("parts"))
    queries = scratch.kept(rows.where(F.pmod("vec_id", F.lit(query_mod)) == 0).mapInArrow(probing, "vec_id long, embedding array<double>, bound double, cells array<long>, near array<long>, scores array<double>"))
    asks = queries.select("vec_id", "embedding", "bound", F.explode("cells").alias("cell")).join(parts, "cell")
    asks = asks.select("cell", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "vec_id", "embedding", "bound")
    members = indexed.join(parts, "cell").select("cell", F.expr("cast(pmod(xxhash64(vec_id), parts) as int)").alias("part"), "vec_id", "embedding")

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("embedding"))
        asked, q, bound = right.column("vec_id").to_numpy(), _matrix(right.column("embedding")), right.column("bound").to_numpy()
        got = scan(held.value, ids, x, asked, q, bound, k) if len(ids) and len(asked) else [np.zeros(0)] * 3
        return pa.table({"query_id": pa.array(got[0].astype(np.int64)), "vec_id": pa.array(got[1].astype(np.int64)), "score": pa.array(got[2].astype(np.float64))})

    keys = ["cell", "part"]
    found = members.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(searched, "query_id long, vec_id long, score double")
    known = queries.select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("near", "scores")).alias("n")).select("query_id", F.col("n.near").alias("vec_id"), F.col("n.scores").alias("score"))
    found = found.union(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # k rows at most of each query and part: one small sort per query
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
