"""Prefix trie over conversations.

A turn is known by the digest of its role and text, a prefix of turns by the chain of these digests. Equal
conversations are one class: their ids, in blocks of a bounded range of ids, are hashed in
order by a stream over sorted rows, so a conversation that a third of all rows repeat is never gathered. Classes are
hash-partitioned by their first turn, and each group builds its tries from dictionaries of
pointers and sums them up backwards, children before parents. A subtrie of more than ``limit`` turns is
not built: the turns that all of its classes share become nodes of their own, its classes are dealt
again by the turn that follows, and its sums are taken from its parts' tops. Texts never move; what does are 20
bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, by_size, session_conf, shared_path
from .mixing import n_words

#: Turns of a group that one task builds a trie of.
LIMIT = 1 << 14
#: log2 of the range of ids in a block.
BLOCK_BITS = 12
#: `rebuilt` takes the head of one conversation in so many, and fewer turns than `HEAD`.
EVERY, HEAD = 20, 4
NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, up binary"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, path (array of turn digest and words) of each conversation, in the order of turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("d"), n_words(text).cast("int").alias("w")
    )
    base = F.col("conv_id") - F.col("conv_id") % EVERY
    # dealt by what `rebuilt` joins, so that it needs no exchange of its own
    rows = rows.withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "w"))).alias("path"))
    return rows.select("base", "conv_id", F.transform("path", lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("path"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """`turns` with each conversation's first turns, fewer than ``HEAD``, from the one whose id ends its block of ids."""
    rows = turns(conversations)
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("path", 1, HEAD - 1))).over(W.partitionBy("base"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD)).cast("int")
    rows = rows.withColumn("_head", head).withColumn("_h", h)
    taken = F.when(F.col("_head").isNotNull() & (F.col("_h") > 0), F.slice("_head", F.lit(1), F.col("_h")))
    own = F.slice("path", F.col("_h") + 1, F.size("path"))
    return rows.select("conv_id", F.when(taken.isNull(), own).otherwise(F.concat(taken, own)).alias("path"))


def classes(sequences: DataFrame) -> DataFrame:
    """One row for each distinct path: its prefixes' digests and words, members, smallest id, digest of its members' ids."""
    key = F.substring(F.unhex(F.sha2(F.array_join(F.transform("path", lambda t: F.hex(t["d"])), ""), 256)), 1, 16)
    rows = sequences.select("conv_id", key.alias("key"), F.transform("path", lambda t: t["d"]).alias("ds"), F.transform("path", lambda t: t["w"]).alias("ws"))
    # ids are distinct, so a block has 2^BLOCK_BITS of them at most
    blocks = rows.groupBy("key", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("ds").alias("ds"), F.first("ws").alias("ws"),
    )
    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_hashed, "keys array<binary>, cum array<long>, n long, conv_id long, ends string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes from their blocks in order; one class is open at a time."""
    key, held = None, None
    for b in batches:
        done = []
        cols = (b.column(c).to_pylist() for c in ("key", "ids", "n", "conv_id", "ds", "ws"))
        for k, ids, n, conv, ds, ws in zip(*cols, strict=True):
            if k == key:
                held[0].update(f",{ids}".encode())
                held[1] += n
                continue
            if held is not None:
                done.append(held)
            key, held = k, [hashlib.sha256(ids.encode()), n, conv, ds, ws]
        yield _batch(done)
    if held is not None:
        yield _batch([held])


def _batch(done: list) -> pa.RecordBatch:
    keys = []
    for h in done:
        at, own = b"", []
        for d in h[3]:
            at = hashlib.blake2b(at + d, digest_size=16).digest()
            own.append(at)
        keys.append(own)
    sums = [[*accumulate(h[4])] for h in done]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.list_(pa.binary())), pa.array(sums, pa.list_(pa.int64())), pa.array([h[1] for h in done], pa.int64()), pa.array([h[2] for h in done], pa.int64()), pa.array([h[0].hexdigest() for h in done], pa.string())],
        names=["keys", "cum", "n", "conv_id", "ends"],
    )


def build(group: pd.DataFrame) -> pd.DataFrame:
    """The subtries of a group of classes (keys, cum, n, conv_id, ends, at, up, parent): a row for each node.

    ``at`` is the depth of a subtrie's top, ``up`` its parent's digest and ``parent`` that one's smallest id.
    """
    kids: list[dict[bytes, int]] = []
    key, depth, above, conv, n, words, ends, top = [], [], [], [], [], [], [], []
    tops: dict[bytes, int] = {}
    columns = (group[c] for c in ("keys", "cum", "n", "conv_id", "ends", "at", "up", "parent"))
    for keys, cum, members, least, digest, at, up, parent in zip(*columns, strict=True):
        here, node = tops, -1
        for j in range(at - 1, len(keys)):
            before, k = node, keys[j]
            node = here.get(k, -1)
            if node < 0:
                node = here[k] = len(kids)
                kids.append({})
                key.append(k)
                depth.append(j + 1)
                above.append(before)
                conv.append(least)
                n.append(0)
                words.append(int(cum[j] - cum[j - 1]) if j else int(cum[0]))
                ends.append(NOTHING)
                top.append((up, parent) if before < 0 else None)
            n[node] += members
            if least < conv[node]:
                conv[node] = least
            here = kids[node]
        ends[node] = digest
    leaves = [0] * len(kids)
    saved = [(a - 1) * w for a, w in zip(n, words, strict=True)]
    for node in range(len(kids) - 1, -1, -1):  # nodes are made after their parents
        leaves[node] = leaves[node] or 1
        if above[node] >= 0:
            leaves[above[node]] += leaves[node]
            saved[above[node]] += saved[node]
    parents = [t[1] if t else conv[a] for t, a in zip(top, above, strict=True)]
    return pd.DataFrame({
        "conv_id": conv, "depth": depth, "parent_conv_id": parents, "n_convs": n, "n_children": [len(x) for x in kids], "n_leaves": leaves,
        "saved_tokens": saved, "ends_sha256": ends, "node": key, "up": [t[0] if t else None for t in top],
    })


def _shared(lo: Column, hi: Column) -> Column:
    """How many elements the least and the greatest of some arrays share, and so all between."""
    at = F.array_position(F.zip_with(lo, hi, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(at > 0, at - 1).otherwise(F.size(lo)).cast("int")


def prefix_trie(sequences: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every prefix of the paths of ``sequences`` (conv_id, path of turn digests and words), a row for each.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 and node (the prefix's digest; empty for the root). Ids are distinct and not null. Without
    sequences there is no node, not even a root; a sequence without turns is a member of the root alone.
    A conversation is what a task holds at least: 20 bytes a turn. Runs its jobs when called; the
    result is a table in the shared folder.
    """
    spark = sequences.sparkSession
    out = shared_path(spark, "trie")
    with Scratch(spark) as scratch, session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):
        every = scratch.stored(classes(sequences), "classes")
        total = every.agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max(F.when(F.size("keys") == 0, F.col("ends"))).alias("ends")).first()
        if not total["classes"]:
            return spark.createDataFrame([], _NODE).drop("up")
        root = F.lit(b"")
        rows = every.where(F.size("keys") > 0).withColumns({"at": F.lit(1), "up": root, "parent": F.lit(total["conv_id"])})
        uppers = []  # nodes above, round by round, without the sums of their subtries
        while True:
            rows = rows.withColumn("key", F.element_at("keys", F.col("at")))
            sizes = scratch.stored(rows.groupBy("key").agg(F.sum(F.size("keys") - F.col("at") + 1).alias("turns"), F.count("*").alias("classes"), F.sum("n").alias("members"), F.min("conv_id").alias("least")), "sizes")
            large = (F.col("turns") > limit) & (F.col("classes") > 1)
            most, small, n_rows = sizes.agg(F.max(large), F.sum(F.when(~large, F.col("turns"))), F.sum("classes")).first()
            if most:
                rows = scratch.stored(by_size(rows, sizes, ["key"], "classes", n_rows), "marked")
            groups = max(1, -(-2 * (small or 0) // limit))
            built = rows.where(~large) if most else rows
            built = built.select("keys", "cum", "n", "conv_id", "ends", "at", "up", "parent", F.expr(f"pmod(xxhash64(key), {groups})").alias("bucket"))
            built.groupBy("bucket").applyInPandas(build, _NODE).write.mode("append").parquet(out)
            if not most:
                break
            rows = rows.where(large)
            per = rows.groupBy("key").agg(
                *(F.first(c).alias(c) for c in ("up", "parent", "at", "members", "least", "classes")),
                F.min(F.struct("keys", "cum", "ends")).alias("lo"), F.max("keys").alias("hi"),
            ).withColumn("to", _shared(F.col("lo.keys"), F.col("hi")))
            per = scratch.stored(per.select(
                "key", "up", "parent", "at", "to", "members", "least", "classes", F.element_at("lo.keys", F.col("to")).alias("node"),
                # a node of the chain, and the words from its turn to the chain's end
                F.expr("transform(sequence(at, to), i -> struct(element_at(lo.keys, i) as node, element_at(lo.cum, to) - if(i > 1, element_at(lo.cum, greatest(i - 1, 1)), 0L) as words))").alias("chain"),
                F.when(F.size("lo.keys") == F.col("to"), F.col("lo.ends")).otherwise(NOTHING).alias("ends"),
            ), "upper")
            uppers.append(per)
            last = per.select("key", "to", F.col("node").alias("up"), F.col("least").alias("parent"), "classes")
            down = by_size(rows.select("key", "keys", "cum", "n", "conv_id", "ends"), last, ["key"], "classes", n_rows).where(F.size("keys") > F.col("to"))
            rows = scratch.stored(down.select("keys", "cum", "n", "conv_id", "ends", (F.col("to") + 1).alias("at"), "up", "parent"), "rest")
        parts = [spark.read.schema(_NODE).parquet(out).where("up is not null").select("up", "n_leaves", "saved_tokens")]
        sums = lambda: [F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
        for per in reversed(uppers):
            below = parts[0]
            for x in parts[1:]:
                below = below.unionByName(x)
            own = per.join(below.groupBy(F.col("up").alias("node")).agg(*sums()), "node")
            # along a chain members stay, and so do leaves; what is saved grows towards its top
            own = own.select("up", "parent", "at", "to", "members", "least", "ends", "n_children", "n_leaves", "saved_tokens", F.posexplode("chain").alias("i", "own"))
            first, last = F.col("i") == 0, F.col("i") == F.col("to") - F.col("at")
            own = scratch.stored(own.select(
                F.col("least").alias("conv_id"), (F.col("at") + F.col("i")).cast("long").alias("depth"), F.when(first, F.col("parent")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
                F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", (F.col("saved_tokens") + (F.col("members") - 1) * F.col("own.words")).alias("saved_tokens"),
                F.when(last, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"), F.col("own.node").alias("node"), F.when(first, F.col("up")).alias("up"),
            ), "sums")
            own.write.mode("append").parquet(out)
            parts.append(own.where("up is not null").select("up", "n_leaves", "saved_tokens"))
        below = spark.read.schema(_NODE).parquet(out).where(F.col("up") == root).agg(*sums()).first()
        top = (total["conv_id"], 0, None, total["n"], below["n_children"], below["n_leaves"] or 1, below["saved_tokens"] or 0, total["ends"] or NOTHING, b"", None)
        spark.createDataFrame([top], _NODE).coalesce(1).write.mode("append").parquet(out)
    return spark.read.schema(_NODE).parquet(out).drop("up")


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`prefix_trie` of the rebuilt ``conversations`` (conv_id, turn, role, text).

    Turns are in the order of ``turn``, null first, equal ones by the digest of role and text; null roles and texts
    are empty. Rows without a conv_id belong to no conversation and are left out; repeated rows are turns
    of their own; other columns are not read.
    """
    return prefix_trie(rebuilt(conversations), limit)
