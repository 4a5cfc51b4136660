"""MinHash near-dedup with odd sketches.

1. One pass over the texts (numpy on the Arrow buffer) gives each document the size of its
   set of five-word shingles, a digest of that set, the keys of its MinHash bands and an odd
   sketch: the parity bitmap of its (index, minimum) samples. The population count of the XOR
   of two sketches estimates how many samples differ, most precisely at high similarity.
2. Documents with the same set are one class and one node; only classes go on, so repeated rows and
   copies cost nothing further.
3. Classes that share a band are candidates. First each class is held against the least class
   of the bucket that it meets most often (a star, linear in the bucket). Classes that are not
   yet connected and share a bucket are then compared in blocks by their sketches, each pair in
   the first band that it shares only. Full sets go to the blocks where candidates are left, which
   confirm the nearest first, skip what is connected by then, and give nothing but links.
4. Every link is confirmed on full sets. Components are found by star rounds.

With 24 bands of 3 rows a pair at similarity 0.75 is missed with probability 2e-6, at 0.85 1e-10.
A sketch rules a pair out only six standard deviations of its samples below the threshold. No bucket, partner or
candidate is capped. Sets are held as 64-bit shingle hashes, and links are confirmed on these full sets
of hashes; two different shingles of one pair share a hash with probability below 1e-11 for a million shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, by_size, few, may_be, small_batches, staying
from .components import components
from .textkernel import mix, text_shingles

BANDS, ROWS = 24, 3
#: MinHash samples (the first ``BANDS * ROWS`` make the bands) and bits of the odd sketch.
SAMPLES, SKETCH_BITS = 256, 2048
NUMERATOR, DENOMINATOR = 75, 100
#: Members of one block of a bucket, and of one run of a star.
BLOCK = 1024

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)

_SIGNED = "doc_id long, mark long, size long, n_shingles long, c1 long, c2 long, keys binary, odd binary"


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum of each of the sample functions over each set; sets are not empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SAMPLES), np.uint32)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat((flat ^ _XOR[i]) * _MUL[i], at)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(mins), BANDS), np.uint64)
    grouped = mins[:, : BANDS * ROWS].astype(np.uint64).reshape(len(mins), BANDS, ROWS)
    for r in range(ROWS):
        keys = mix(keys + grouped[:, :, r])
    return keys


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, packed."""
    cells = (mix(mins.astype(np.uint64) + _SALT) >> np.uint64(32)).astype(np.int64) % SKETCH_BITS
    count = np.bincount((cells + np.arange(len(mins))[:, None] * SKETCH_BITS).ravel(), minlength=len(mins) * SKETCH_BITS)
    return np.packbits((count & 1).astype(np.uint8).reshape(len(mins), SKETCH_BITS), axis=1)


def most_xor(numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> int:
    """XOR population count above which a pair is six deviations below the threshold."""
    j = numerator / denominator
    differ = min(SAMPLES, SAMPLES * (1 - j) + 6 * np.sqrt(SAMPLES * j * (1 - j)))
    odd = SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ)) / 2
    return int(odd + 4 * (2 * differ) / np.sqrt(SKETCH_BITS))


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """What names a class: two sums of the set's hashes."""
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(77))).astype(np.int64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, keys, odds = [], [], [], []
        for _, sets in text_shingles(batch.column("text")):
            full = [s for s in sets if len(s)]
            if full:
                mins = minhash(full)
                made = iter(zip(band_keys(mins), odd_sketch(mins), strict=True))
            for s in sets:
                sizes.append(len(s))
                if not len(s):
                    digests.append((None, None)), keys.append(None), odds.append(None)
                    continue
                k, o = next(made)
                digests.append(set_digest(s))
                keys.append(k.tobytes()), odds.append(o.tobytes())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "mark", "size")), pa.array(sizes, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(keys, pa.binary()), pa.array(odds, pa.binary())],
            names=["doc_id", "mark", "size", "n_shingles", "c1", "c2", "keys", "odd"],
        )


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64)
        nodes = b.column("node").to_numpy(zero_copy_only=False)
        # the band takes part in the key, so one column tells buckets apart
        keys = mix(keys.view(np.uint64) + np.tile(np.arange(BANDS, dtype=np.uint64), len(nodes)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        band = np.tile(np.arange(BANDS, dtype=np.int32), len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(band), pa.array(np.repeat(nodes, BANDS))], names=["bucket", "band", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = [s.tobytes() for _, sets in text_shingles(b.column("text")) for s in sets]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(held, pa.binary())], names=["node", "held"])


def linked(a: np.ndarray, b: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> bool:
    """Whether two full sets (sorted) reach the threshold."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small) or denominator * len(small) < numerator * len(large):
        return False
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    both = int((large[place] == small).sum())
    return denominator * both >= numerator * (len(a) + len(b) - both)


def _confirmed(numerator: int, denominator: int):
    """Pairs of a stream ordered by (a, run): the set of ``a`` comes first, then its partners'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            left, right = [], []
            for a, r, b, held in zip(*(batch.column(c).to_pylist() for c in ("a", "run", "b", "held")), strict=True):
                s = np.frombuffer(held, np.uint64)
                if b is None:
                    at, own = (a, r), s
                elif at == (a, r) and linked(s, own, numerator, denominator):
                    left.append(a), right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _candidates(t: pa.Table, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket (of two of its blocks) that their sketches do not rule out, and the distance.

    Left out are pairs of one component, and those that share an earlier band: they meet there.
    """
    node, comp, block = (t.column(c).to_numpy() for c in ("node", "comp", "block"))
    odd = np.frombuffer(b"".join(t.column("odd").to_pylist()), np.uint64).reshape(len(node), -1)
    keys, band = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64).reshape(len(node), BANDS), t.column("band")[0].as_py()
    same, out = t.column("i")[0].as_py() == t.column("j")[0].as_py(), ([], [], [])
    for lo in range(0, len(node), 256):
        part = slice(lo, lo + 256)
        far = np.zeros((len(node[part]), len(node)), np.uint16)
        for w in range(odd.shape[1]):
            far += np.bitwise_count(odd[part, None, w] ^ odd[None, :, w])
        ok = (far <= limit) & (comp[part, None] != comp[None, :]) & (node[part, None] < node[None, :])
        if not same:
            ok &= block[part, None] != block[None, :]
        x, y = np.nonzero(ok)
        first = (keys[part][x] == keys[y]).argmax(1) == band
        x, y = x[first], y[first]
        out[0].append(x + lo), out[1].append(y), out[2].append(far[x, y])
    return tuple(np.concatenate(o) for o in out)


def _with_candidates(limit: int):
    """The rows of a group that have a candidate in it."""

    def run(t: pa.Table) -> pa.Table:
        x, y, _ = _candidates(t, limit)
        return t.take(pa.array(np.union1d(x, y)))

    return run


def _joined(limit: int, numerator: int, denominator: int):
    """Links between the components of one group, nearest candidates first; none between what is joined already."""

    def run(t: pa.Table) -> pa.Table:
        node, comp = t.column("node").to_numpy().tolist(), t.column("comp").to_pylist()
        sets = [np.frombuffer(h, np.uint64) for h in t.column("held").to_pylist()]
        root = {c: c for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        x, y, far = _candidates(t, limit)
        left, right = [], []
        order = np.argsort(far, kind="stable")
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            a, b = find(comp[i]), find(comp[j])
            if a != b and linked(sets[i], sets[j], numerator, denominator):
                root[a] = b
                left.append(node[i]), right.append(node[j])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


class NearDedup:
    """The stages of the operator over one table of documents; see `near_dedup`."""

    def __init__(self, docs: DataFrame, scratch: Scratch, numerator: int = NUMERATOR, denominator: int = DENOMINATOR):
        self.spark, self.scratch = docs.sparkSession, scratch
        # two hashes and the length tell texts apart
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") * (1 << 32) + F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
        self.docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), size.alias("size"))
        self.numerator, self.denominator = numerator, denominator
        self.limit = most_xor(numerator, denominator)
        small_batches(self.spark)

    def classes(self) -> None:
        signed = self.scratch.stored(self.docs.mapInArrow(_signed, _SIGNED), "signed")
        per = signed.where("n_shingles > 0").groupBy("c1", "c2").agg(
            F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.min(F.struct("mark", "size")).alias("text"), F.first("keys").alias("keys"), F.first("odd").alias("odd")
        )  # a class has one set, and so one sketch
        self.found = self.scratch.stored(per.withColumn("node", F.monotonically_increasing_id()), "classes")
        self.signed = self.scratch.stored(signed.select("doc_id", "n_shingles", "c1", "c2"), "rows")
        self.scratch.drop("signed")
        self.nodes = self.found.select("node", "keys", "odd")
        rows = self.nodes.select("node", "keys").mapInArrow(_exploded, "bucket long, band int, node long")
        pivots = rows.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).where("pivot < most")
        self.members = self.scratch.kept(rows.join(pivots.select("bucket", "pivot"), "bucket"))
        # full sets of all nodes that share a bucket, once, dealt by node for every join to come
        wanted = self.members.select("node").distinct().join(self.found.select("node", "text.mark", "text.size"), "node")
        wanted = self.scratch.stored(few(wanted), "wanted")
        text = self.docs.select("mark", "size", "text").join(F.broadcast(bitmap(wanted.select("mark")))).where(may_be(F.col("mark"))).groupBy("mark", "size").agg(F.first("text").alias("text"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        held = text.join(wanted.hint("shuffle_hash"), ["mark", "size"]).select("node", "text").mapInArrow(_sets, "node long, held binary")
        self.sets = self.scratch.kept(held.repartition(n, "node"))

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that reach the threshold on full sets."""
        pairs = self.scratch.kept(pairs)
        if pairs.isEmpty():
            return pairs
        sets = self.sets
        runs = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("runs"))
        partners = pairs.join(runs, "a").select("a", F.expr("cast(pmod(xxhash64(b), runs) as int)").alias("run"), "b")
        theirs = partners.join(sets, partners.b == sets.node).select("a", "run", "b", "held")
        own = runs.select("a", F.explode(F.expr("sequence(0, runs - 1)")).alias("run")).join(sets, F.col("a") == F.col("node")).select("a", "run", F.lit(None).cast("long").alias("b"), "held")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return (
            theirs.union(own).repartition(n, "a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())
            .mapInArrow(_confirmed(self.numerator, self.denominator), "a long, b long")
        )

    def star(self) -> DataFrame:
        """One candidate for each node: the least node of the bucket that it meets most often."""
        met = self.members.where("node <> pivot").groupBy("node", "pivot").count()
        pairs = met.groupBy("node").agg(F.max(F.struct("count", (-F.col("pivot")).alias("p"))).alias("m")).select(F.expr("-m.p").alias("a"), F.col("node").alias("b"))
        odd = self.nodes.select("node", "odd")
        near = pairs.join(odd.select(F.col("node").alias("a"), F.col("odd").alias("x")), "a").join(odd.select(F.col("node").alias("b"), F.col("odd").alias("y")), "b")
        return near.mapInArrow(_near(self.limit), "a long, b long")

    def rest(self, links: DataFrame) -> DataFrame:
        """All links between different components that share a bucket, but those that others imply."""
        comps = components(links, self.scratch)
        rows = self.members.select("bucket", "band", "node").join(comps, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("comp"))
        open_ = rows.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x < y")
        blocks = F.expr(f"cast(ceil(n / {BLOCK}) as int)")
        held = rows.join(open_.select("bucket", blocks.alias("k")), "bucket").join(self.nodes, "node")
        held = held.withColumn("block", F.expr("cast(pmod(xxhash64(node), k) as int)")).withColumn("o", F.explode(F.expr("sequence(0, k - 1)")))
        held = held.select("bucket", "band", "node", "comp", "keys", "odd", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
        group = ["bucket", "i", "j"]
        close = held.groupBy(*group).applyInArrow(_with_candidates(self.limit), held.schema)
        # the full sets go only to groups in which a node has a candidate
        return close.join(self.sets, "node").groupBy(*group).applyInArrow(_joined(self.limit, self.numerator, self.denominator), "a long, b long").distinct()

    def links(self) -> DataFrame:
        self.classes()
        links = self.scratch.stored(few(self.confirm(self.star())), "links")
        return self.scratch.stored(few(links.union(self.rest(links))), "links")

    def result(self) -> DataFrame:
        comps = components(self.links(), self.scratch)
        own = self.scratch.kept(self.found.join(comps, "node", "left").select("c1", "c2", "least", "rows", F.coalesce("root", "node").alias("root")))
        named = own.groupBy("root").agg(F.min("least").alias("component_id"))
        own = self.scratch.kept(own.join(named, "root").select("c1", "c2", "rows", "component_id"))
        total = self.signed.count()
        linked = by_size(self.signed.where("n_shingles > 0"), own, ["c1", "c2"], "rows", total).select("doc_id", "n_shingles", "component_id")
        lone = self.signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return linked.union(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _near(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64) for c in ("x", "y"))
            ok = pa.array(np.bitwise_count(x ^ y).sum(1) <= limit)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return run


def near_dedup(docs: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Components of documents whose sets of five-word shingles are near.

    Reads doc_id and text of ``docs``; other columns do not matter. Two documents are linked if
    ``denominator * |A and B| >= numerator * |A or B|``. Returns for each row doc_id, n_shingles,
    component_id (the smallest id reachable over links, its own included) and kept
    (doc_id = component_id). Null, empty and blank texts have no shingles and are linked with
    nothing. Rows are documents of their own, those that share an id too. Rows without an id link
    others, but are never kept and name no component (it is null where no row of it has an id).
    An empty table gives no rows. Runs its jobs when called; the result is a table in the shared
    folder, all others are deleted.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.stored(NearDedup(docs, scratch, numerator, denominator).result(), "near", stays=True)


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the least id, rows without an id after all others.

    Texts that share an id are documents of their own here; of rows that repeat id and text one stays.
    """
    return staying(docs, near_dedup)
