import hashlib
import random
import re
import zlib

import duckdb
import pytest

from gradus.llm import queries
from gradus.llm.prefix_trie import conversation_trie

from ..conftest import DATA

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """A plain trie of tuples; rows are (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [(t[3], t[4]) for t in sorted(x)] for c, x in own.items()}
    members, ends = {}, {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = (*own.get(c - c % 20, [])[:h], *x[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[b] for b in below) or 1
        saved[p] = sum(saved[b] for b in below) + (len(members[p]) - 1) * words
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], digest))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def alike(seed, n, most, words=2):
    """Conversations of few different turns, so that they share much."""
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), " ".join(r.choices(["ab", "cd"], k=r.randint(0, words)))) for c in range(n) for t in range(r.randint(1, most))]


def test_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = c.sql(queries.OP13_SQL)
    df = queries.op13_conversation_trie(spark, DATA)
    assert set(df.columns) == set(want.columns)
    rows = c.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    found = got(df)
    assert found == sorted(want.select(*COLUMNS).fetchall(), key=str) == brute(rows)


@pytest.mark.parametrize(("limit", "n", "most"), [(1 << 14, 120, 6), (40, 120, 6), (1, 60, 5), (12, 40, 30)])
def test_oversized_subtries_are_dealt_again(spark, limit, n, most):
    rows = alike(n + most, n, most)
    # a third of all conversations are the same, and many share a long head
    rows += [(c, t, "user", "same") for c in range(1000, 1000 + n // 2) for t in range(3)]
    rows += [(c, t, "user", f"head {t}" if t < 9 else f"tail {c % 5}") for c in range(2000, 2000 + n // 4) for t in range(9 + c % 3)]
    assert got(conversation_trie(frame(spark, rows), limit).drop("node")) == brute(rows)


def test_edges(spark):
    rows = [
        (20, 0, "user", "a b"), (20, None, None, None), (20, 1, "user", ""), (21, 0, None, "x" * 50_000), (21, 0, None, "x" * 50_000), (22, 5, "user", None), (None, 0, "user", "lost"),
        (45, 0, "user", "one turn, no base"), (46, 0, "user", "one turn, no base"), (47, 0, "u", "ser"), (48, 0, "us", "er"), (49, 2, "user", "b"), (49, 2, "user", "a"), (-3, 1, "user", "below zero"),
        (1 << 40, 0, "user", "far"),
    ]
    want = brute(rows)
    df = conversation_trie(frame(spark, rows))
    assert got(df) == want and df.count() == df.select("node").distinct().count()
    assert sum(r[1] == 0 for r in want) == 1 and any(r[1] == 0 and r[-1] != hashlib.sha256(b"").hexdigest() for r in want)
    assert conversation_trie(frame(spark, [])).count() == 0 and conversation_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    alone = [(45, 0, "user", "gone")] if zlib.crc32(b"45") % 4 else [(46, 0, "user", "gone")]
    assert got(conversation_trie(frame(spark, alone))) == brute(alone)


def test_ids_of_a_hot_class_come_in_blocks(spark):
    rows = [(c, 0, "user", "hello") for c in range(0, 40_000, 20)]
    assert got(conversation_trie(frame(spark, rows).repartition(7))) == brute(rows)
