import os
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gradus.llm import queries
from gradus.llm.common import Scratch
from gradus.llm.components import components
from gradus.llm.exact_dedup import digests, exact_dedup, keep_one, tree_merge
from gradus.llm.near_dedup import NearDedup, band_keys, keep_representatives, minhash, most_xor, near_dedup, odd_sketch

from ..conftest import DATA, plan


def brute_exact(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = [None] * len(rows)
    for g in groups.values():
        best = min(g)
        for x in g:
            out[x[3]] = (rows[x[3]][0], rows[best[3]][0], len(g), x[3] == best[3])
    return out


def test_exact(spark, edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    for fan_in in (2, 16):
        got = [tuple(r)[:4] for r in exact_dedup(edge.repartition(5), fan_in).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute_exact(rows)))
    assert exact_dedup(nothing).count() == 0
    assert "Python" not in plan(exact_dedup(edge)) and "Arrow" not in plan(exact_dedup(edge))


def test_exact_against_sql(spark):
    got = exact_dedup(spark.read.parquet(f"{DATA}/documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = c.sql(queries.OP4_SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_runs_have_partitions_of_their_own_and_few_blocks(spark):
    docs = spark.createDataFrame([(i, f"text {i % 700}") for i in range(2000)], "doc_id long, text string").repartition(60)
    rows = digests(docs)
    level = tree_merge(rows, 20, 5)
    text = plan(level)
    assert text.count("shufflepartitionidpassthrough") == 3 and "Exchange hashpartitioning" not in text and "25)" in text
    assert level.count() == 700 and level.agg({"group_size": "sum"}).first()[0] == 2000
    spread = level.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(spread) == 25  # digests that have a run's digits, in that run's partition


def test_many_input_partitions_cost_about_as_few_do(spark):
    docs = spark.createDataFrame([(i, f"text {i % 700}") for i in range(2000)], "doc_id long, text string")
    took = {}
    for n in (4, 300, 4, 300):
        own = docs.repartition(n)
        began = time.perf_counter()
        assert exact_dedup(own).where("kept").count() == 700
        took[n] = time.perf_counter() - began
    # writing the digests is one task for each of the input's partitions
    assert took[300] < 2 * took[4] + 5


def test_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b", 0), (2, "ab", 1), (3, "c", 2)], "doc_id long, text string, kept int")
    assert {tuple(r) for r in keep_one(docs).collect()} == {(1, "a b", 0), (3, "c", 2)}


def test_stages_on_nulls_and_repeated_ids(spark, edge, nothing):
    extra = [(None, None), (20, "one text under an id of two texts"), (20, "quite another one, same id as that"), (None, "no id here at all today"), (None, "NO id here at all TODAY")]
    docs = edge.union(spark.createDataFrame([(i, t, "s", 1.0, "x") for i, t in extra], edge.schema)).repartition(3)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    once = keep_one(docs)
    got = sorted((str(r["doc_id"]), re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")) for r in once.collect())
    want = sorted((str(r[0]), re.sub(r"[\x20\x09-\x0D]", "", x[1] or "")) for r, x in zip(brute_exact(rows), rows, strict=True) if r[3])
    assert got == want and once.columns == docs.columns
    left = Counter(r["doc_id"] for r in keep_representatives(once.cache()).collect())
    assert left == Counter({1: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 20: 2, None: 1})
    assert Counter(r["doc_id"] for r in keep_representatives(docs).collect()) == left + Counter({3: 1, 4: 1, None: 1})
    assert keep_one(nothing).count() == 0 and keep_representatives(nothing).count() == 0


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())


def brute_near(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.random()}"
    return " ".join(words)


def test_near(spark):
    r = random.Random(5)
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([6, 40, 150]))]
        for _ in range(r.choice([1, 3, 9])):
            rows.append((i, edited(r, base, r.choice([0, 0, 1, 2, 4]))))
            i += 1
    rows += [(1000, None), (1001, ""), (1002, "two words"), (1003, "Two  WORDS"), (1004, "two words more")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x for x in near_dedup(docs).collect()}
    want = brute_near(rows)
    assert {k: v["component_id"] for k, v in got.items()} == want
    sizes = {i: len(shingle_set(t)) for i, t in rows}
    assert all(v["n_shingles"] == sizes[k] and v["kept"] == (k == want[k]) for k, v in got.items())


def test_near_chain_is_one_component(spark):
    base = [f"c{k}" for k in range(100)]
    rows = []
    for k in range(8):  # each is near the next, the ends are far
        rows.append((k, " ".join(base[3 * k : 3 * k + 60])))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows) and set(got.values()) == {0}


def test_near_edges(spark, edge, nothing):
    got = near_dedup(edge).collect()
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append(x)
    assert len(got) == edge.count() and by[3][0]["n_shingles"] == 0 and by[4][0]["component_id"] == 4
    assert {x["component_id"] for i in (1, 2, 10) for x in by[i]} == {1} and by[None][0]["kept"] is False
    assert near_dedup(nothing).count() == 0


def test_repeated_rows_are_one_node(spark):
    """200 equal rows of one id, and 200 copies under other ids, are one node, one set and no candidate."""
    text, near = " ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}" for k in range(41))
    docs = spark.createDataFrame([(7, text)] * 200 + [(100 + k, text) for k in range(200)] + [(9, near), (7, "other words under the id of seven, quite")], "doc_id long, text string").repartition(3)
    with Scratch(spark) as scratch:
        n = NearDedup(docs, scratch)
        n.classes()
        assert n.found.count() == 3 and n.sets.count() == 2 and n.members.select("node").distinct().count() == 2
        assert n.confirm(n.star()).count() == 1
    got = Counter((r["doc_id"], r["component_id"], r["n_shingles"]) for r in near_dedup(docs).collect())
    assert got == Counter({(7, 7, 36): 200, **{(100 + k, 7, 36): 1 for k in range(200)}, (9, 7, 37): 1, (7, 7, 4): 1})


def test_near_leaves_nothing_behind(spark, edge):
    from gradus.llm.common import shared_dir

    near_dedup(edge)
    before, held = set(os.listdir(shared_dir(spark).removeprefix("file://"))), len(spark.sparkContext._jsc.getPersistentRDDs())
    near_dedup(edge)
    after = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    assert {x.split("-")[1] for x in after - before} == {"near"} and len(spark.sparkContext._jsc.getPersistentRDDs()) == held


def test_sketches():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], r.integers(0, 1 << 63, 100, dtype=np.uint64)])
    far = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    mins = minhash([np.sort(a), np.sort(b), np.sort(far)])
    odd = odd_sketch(mins)
    xor = lambda i, j: int(np.bitwise_count(odd[i] ^ odd[j]).sum())
    assert xor(0, 0) == 0 and xor(0, 1) < most_xor() < xor(0, 2)
    assert (band_keys(mins)[0] == band_keys(mins)[1]).any()


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    with Scratch(spark) as scratch:
        got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {k: find(k) for k in root if any(k in e and e[0] != e[1] for e in edges)}
