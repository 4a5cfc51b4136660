import base64
import gzip
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import urllib.parse
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from gradus.llm import lm_contexts, lm_tokens, mixing_lm, queries, secrets
from gradus.llm.mixing import dealt, marked, mixed, mixture, targets
from gradus.llm.mixing_lm import language_model_scores
from gradus.llm.neighbours import Index, neighbours
from gradus.llm.sharding import shards
from gradus.llm.toxicity import Model, expected, learn, segments, toxicity, without_toxic

from ..conftest import DATA


# ---------------------------------------------------------------- sharding


def test_shards(spark, edge, nothing):
    rows = shards(edge, 4).collect()
    got = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    sizes = [r["size"] for r in got]
    total, at = sum(sizes), 0
    for r in got:
        assert r["shard"] == min(3, (2 * at + r["size"]) * 4 // (2 * total))
        at += r["size"]
    for s in range(4):
        assert [r["slot"] for r in got if r["shard"] == s] == list(range(sum(r["shard"] == s for r in got)))
    ids = [r["doc_id"] if r["doc_id"] is not None else 10**9 for r in got]
    assert ids == sorted(ids) and {r["size"] for r in got if r["doc_id"] in (3, 4)} == {1}
    assert {r["text_crc32"] for r in got if r["doc_id"] == 6} == {zlib.crc32(b"short one")}
    assert shards(nothing).count() == 0


def test_shards_are_even(spark):
    per = shards(spark.read.parquet(f"{DATA}/documents.parquet")).groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()
    mean = sum(r["b"] for r in per) / 16
    assert len(per) == 16 and all(abs(r["b"] - mean) <= 20_000 for r in per)


def test_shards_against_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = c.sql(queries.OP2_SQL)
    assert sorted(map(tuple, shards(docs).select(*want.columns).collect())) == sorted(want.fetchall())


# ---------------------------------------------------------------- mixing


def water(sizes, weights, most=3):
    target, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        share = left / sum(weights[s] for s in free)
        above = {s for s in free if share * weights[s] > most * sizes[s]}
        if not above:
            target |= {s: share * weights[s] for s in free}
            break
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= above
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, "d": 50}, {"a": 5, "b": 0, "c": 900, "d": 3, "e": 40, "f": 1}, {"a": 0}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = water(sizes, {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))})
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mixture(spark, edge, nothing):
    rows = mixture(edge).collect()
    assert len(rows) == edge.count() and all(r["taken"] == r["size"] * r["copies"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixture(edge.repartition(3)).collect()))
    assert mixture(nothing).count() == 0 and mixed(edge).columns == edge.columns
    n = Counter()
    for r in rows:
        n[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed(edge).collect()) == +n


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sources_come_near_their_targets(spark, sf):
    """What a source takes differs from its target by its largest document at most."""
    docs = spark.read.parquet(f"{DATA.replace('0.001', sf)}/documents.parquet")
    named = docs.select(F.col("doc_id").alias("_id"), "source")
    per = mixture(docs).join(named, F.col("doc_id") == F.col("_id")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"), F.max("source_size").alias("size")).collect()
    for r in per:
        assert abs(r["taken"] - r["target"]) <= r["most"] + 1e-6 or r["target"] == 3.0 * r["size"] == r["taken"]


def test_strata_of_bounded_length(spark):
    """With strata of a few documents: near the target, the same on other partitions, each draw as likely as its fraction."""
    r = random.Random(8)
    rows = [(i, " ".join("w" * r.choice([1, 2, 5, 40])), "hot" if i % 3 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for seed in ("a", "b", "c", "d"):
        own = marked(docs.repartition(3), seed)
        rates = targets(own.select("source", "size"))
        out = dealt(own, rates, seed, 16).select("doc_id", "source", "size", "target", "copies").collect()
        again = dealt(marked(docs, seed), rates, seed, 16).select("doc_id", "source", "size", "target", "copies").collect()
        assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == 900
        for s in ("hot", None):
            assert abs(sum(x["size"] * x["copies"] for x in out if x["source"] == s) - next(x["target"] for x in out if x["source"] == s)) <= 40 * 5
        for x in out:
            got.setdefault(x["source"], []).append(x["copies"])
    for x in got.values():
        assert max(x) - min(x) <= 1


def test_mixture_against_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = c.sql(queries.OP8_SQL)
    assert sorted(map(tuple, mixture(docs).select(*want.columns).collect())) == sorted(want.fetchall())


# ---------------------------------------------------------------- toxicity


def all_maximal(line, lo, hi):
    """By definition: the best stretch, then those of what lies before and after it."""
    sums = np.concatenate(([0.0], np.cumsum(line[lo:hi])))
    gain = np.triu(sums[None, :] - sums[:, None], 1)
    if hi <= lo or gain.max() <= 1e-12:
        return []
    a, b = max(np.argwhere(gain >= gain.max() - 1e-12).tolist(), key=lambda x: x[0] - x[1])
    return [*all_maximal(line, lo, lo + a), (lo + a, lo + b), *all_maximal(line, lo + b, hi)]


def test_segments_are_all_maximal_ones():
    r = random.Random(2)
    for _ in range(200):
        places = sorted(r.sample(range(30), r.randrange(1, 18)))
        scores = [r.uniform(0.1, 3) if r.random() < 0.6 else r.uniform(-2, -0.3) for _ in places]
        line = [-0.3] * 30
        for p, s in zip(places, scores, strict=True):
            line[p] = s
        found = segments(places, scores, 0.3)
        assert [(a, b) for a, b, _ in found] == all_maximal(line, 0, 30)
        assert all(sum(line[a:b]) == pytest.approx(s) for a, b, s in found)


def test_evidence_is_signed(spark):
    """Words of clean texts speak against, words of toxic ones for, words of both not at all; a clean word parts two passages."""
    rows = [(i, ("grolf " if i % 5 == 1 else "plain ") + "common", int(i % 5 == 1)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert model.evidence["grolf"] > 1 and model.evidence["plain"] < -1 and model.evidence["common"] == 0
    assert len(model.scan("grolf common common grolf")[1]) == 1 < len(model.scan("grolf plain plain plain plain grolf")[1])


def test_toxicity_query_against_a_plain_scan(spark):
    """Scores of the registered query by the model's evidence, word by word and stretch by stretch."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels)
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, DATA).collect()}
    assert len(got) == docs.count()
    some = 0
    for i, text in docs.where("length(text) < 4000").select("doc_id", "text").collect():
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        line, last = [], {}
        for k, w in enumerate(words):
            e = next((model.evidence[u] for u in (w, w[:6] + "*", w[:4] + "*") if u in model.evidence and (u == w or len(w) >= len(u))), 0.0)
            if e > 0:
                at, share = last.get(w, (-1000, 1.0))
                share = share / 2 if k - at <= 100 else 1.0
                last[w] = k, share
                line.append(share * e)
            else:
                line.append(e - model.drift)
        found = all_maximal(line, 0, len(line)) if any(x > 0 for x in line) else []
        assert got[i]["n_segments"] == len(found), i
        scores, seen = [], Counter()
        for a, b in sorted(found, key=lambda x: (-sum(line[x[0] : x[1]]), x[0])):
            toxic = [k for k in range(a, b) if line[k] > 0]
            fresh = sum(line[a:b]) - sum(line[k] * (1 - 0.5 ** seen[words[k]]) for k in toxic)
            seen.update({words[k] for k in toxic})
            scores += [fresh] if fresh > 0 else []
        want = 0.01 / (0.01 + expected(scores, len(words), model.rate))
        assert got[i]["score"] == pytest.approx(want), i
        some += bool(found)
    assert some > 3


def test_expected_falls_with_evidence():
    assert expected([], 100, 0.01) == 1.0 and expected([9.0], 100, 0.01) < expected([5.0], 100, 0.01) < 1
    assert expected([5.0, 5.0], 100, 0.001) < expected([5.0], 100, 0.001)


def test_toxicity(spark, edge, nothing):
    r = random.Random(4)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(600)]
    rows, labels = [], []
    for i in range(600):
        w = r.choices(words, k=60)
        if i % 8 == 0:
            for bad in r.sample(["grolf", "snarb", "quizzle", "blorp"], 3):
                w.insert(r.randrange(60), bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 8 == 0)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity(docs, lab).collect()}
    held = [x for x in got.values() if x["held_out"]]
    assert held and all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got.values())
    right = sum(x["predicted"] == (x["doc_id"] % 8 == 0) for x in held) / len(held)
    assert right > 0.95 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in held)
    assert without_toxic(docs, lab).columns == docs.columns and {x["doc_id"] for x in without_toxic(docs, lab).collect()} == {i for i, x in got.items() if not x["predicted"]}
    assert {x["predicted"] for x in toxicity(edge, lab).collect()} == {0} and toxicity(nothing, lab).count() == 0
    assert toxicity(edge, spark.createDataFrame([], "doc_id long, toxic int")).count() == edge.count()


def test_repeated_and_late_toxic_passages_score():
    model = Model({w: 3.0 for w in ("grolf", "snarb", "quizzle", "blorp")}, rate=5e-4)
    clean, bad = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(100)], ["grolf", "snarb", "quizzle", "blorp"]
    n, found, scores = model.scan(" ".join(clean * 5 + bad + clean * 5 + bad + clean * 5))
    assert n == 1508 and len(scores) == 2 and scores[1] == pytest.approx(scores[0] / 2, abs=0.2) and [(a, b) for a, b, _ in found] == [(500, 504), (1004, 1008)]
    text = clean * 200  # 20,000 words
    for k, w in enumerate(bad):
        text[3000 * k + 1000] = w
    early = model.score(" ".join(text))
    text[19_000:19_004] = bad
    assert early < 0.5 < model.score(" ".join(text)) and max(model.scan(" ".join(text))[1], key=lambda s: s[2])[:2] == (19_000, 19_004)
    assert sum(model.scan(" ".join(["grolf"] * 1000))[2]) <= 6.0  # one word over and over is at most twice its evidence


def test_one_word_over_and_over_is_one_find():
    """A word of a long clean text that happens to have evidence, far apart each time, is not many finds."""
    model = Model({"grolf": 3.5}, rate=5e-4)
    clean = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(100)] * 3
    once, often = model.score(" ".join([*clean, "grolf", *clean])), model.score(" ".join(([*clean, "grolf"]) * 12))
    assert once < 0.5 and often < 0.5 and len(model.scan(" ".join(([*clean, "grolf"]) * 12))[1]) == 12


def test_rare_toxicity_has_evidence(spark):
    """A word at 0.15 times the clean documents is strong where toxic ones are a hundredth."""
    rows = [(i, f"plain{'abcdefghij'[i % 10]} " + ("grolf" if i < 40 or i % 15 == 1 else "fine"), int(i < 40)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).evidence
    assert found["grolf"] > 1.0 and found.get("fine", 0.0) <= 0


# ---------------------------------------------------------------- secrets

SECRET = 'token = "abcdefgh12345678"'


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: urllib.parse.quote(s, safe=""), lambda s: urllib.parse.quote(urllib.parse.quote(s, safe=""), safe=""), lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(base64.b64encode(s.encode())).decode().rstrip("="),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(zlib.compress(s.encode())).decode(), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
        lambda s: urllib.parse.quote(base64.b64encode(gzip.compress(urllib.parse.quote(s, safe="").encode())).decode(), safe=""), lambda s: s.encode().hex(),
    ],
)
def test_layers(wrap):
    inner = wrap(SECRET)
    own, every, layers = secrets.scan(f"é {inner} end")
    assert any(k == "assign" and a == 2 and 2 < b <= 2 + len(inner) for k, a, b in every), (inner, every)
    assert layers > 1 and set(own) <= set(every)


def lines(s, width, end="\n"):
    return end.join(s[k : k + width] for k in range(0, len(s), width))


def noise(n):
    return "".join(random.Random(8).choices("abcdefghij \n", k=n))


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress, zlib.compress, lambda b: zstandard.ZstdCompressor().compress(b)])
@pytest.mark.parametrize(
    "wrap",
    [
        lambda b: lines(base64.b64encode(b).decode(), 76), lambda b: lines(base64.b64encode(b).decode(), 64, "\r\n"), lambda b: lines(b.hex(), 60), lambda b: "path/to_the-file/" + base64.b64encode(b).decode(),
        lambda b: "ab/" + lines(base64.urlsafe_b64encode(b).decode().rstrip("="), 76), lambda b: "a" + b.hex(), lambda b: base64.b64encode(b).decode().rstrip("=") + "x" * (1 + (-len(base64.b64encode(b).decode().rstrip("="))) % 4),
    ],
)
def test_layers_over_lines_and_glued(pack, wrap):
    for before in (0, 31, 47, 200):
        inner = wrap(pack((noise(before) + SECRET + noise(90)).encode()))
        _, every, layers = secrets.scan(f"é {inner} end")
        assert any(k == "assign" and a == 2 and 2 < b <= 2 + len(inner) for k, a, b in every), (before, inner, every)
        _, every, _ = secrets.scan(f"é {inner}\nwords that follow it")
        assert any(k == "assign" and a == 2 for k, a, b in every), (before, inner)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, lambda b: zstandard.ZstdCompressor().compress(b)])
def test_layers_of_several_members(pack):
    inner = base64.b64encode(pack(b"first member") + pack(b"second") + pack(SECRET.encode())).decode()
    assert any(k == "assign" for k, *_ in secrets.scan(f"é {inner} end")[1])


def test_base_rules():
    spans = lambda t: secrets.base(t)
    assert spans("token: secret: abcdefghij") == [] and spans("PassWord:abcdefgh") == [("assign", 0, 17)]
    assert spans("paſſword:abcdefgh") == [] and spans("AKIA" + "A" * 11) == [] and spans("xAKIA" + "B" * 12) == [("access", 1, 17)]
    assert spans("0" * 31) == [] and spans("g" + "a" * 40) == [("hex", 1, 41)]
    assert secrets.scan(None) == ([], [], 1) and secrets.scan("%25" * 30 + "41")[1] == []


def test_secret_scan(spark, edge, nothing):
    rows = secrets.secret_scan(edge).collect()
    assert len(rows) == edge.count() and all(r["n_assign"] == 0 for r in rows if r["doc_id"] != 9)
    assert secrets.secret_scan(nothing).count() == 0


# ---------------------------------------------------------------- neighbours


def plain_finds(text):
    """The contract's base finds, kind by kind."""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_query_against_a_plain_scan(spark):
    """Base columns of every document; its base finds are among its spans, and one layer of escapes or base64 adds what a plain scan of it has."""
    got = {r["doc_id"]: r for r in queries.op6_secret_scan(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, text in docs:
        own, text = plain_finds(text or ""), text or ""
        counts = [sum(k == kind for k, _, _ in own) for kind in ("assign", "access", "hex")]
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == counts
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
        spans = set(got[i]["spans"].split(",")) - {""}
        assert {f"{k}:{a}:{b}" for k, a, b in own} <= spans
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/]{4}){5,}={0,2}(?![A-Za-z0-9+/_=-])", text):
            try:
                inner = base64.b64decode(m[0], validate=True).decode()
            except ValueError:
                continue
            if inner.isprintable():
                assert {f"{k}:{m.start()}:{m.end()}" for k, _, _ in plain_finds(inner)} <= spans


def test_finds_across_pieces_and_glued(monkeypatch):
    """Runs across the cut between unpacked pieces, and after letters of their own alphabet."""
    inner = base64.b64encode((SECRET * 200).encode()).decode()
    for at in (1000, (1 << 22) - 3000, (1 << 22) - 100):
        text = "x " * (at // 2) + inner + " y" * 200_000
        packed = base64.b64encode(zlib.compress(text.encode())).decode()
        assert any(k == "assign" for k, _, _ in secrets.scan(f"see {packed} there")[1]), at
    for glue in ("img/", "a/b/", "x-", "q_"):
        assert any(k == "assign" for k, _, _ in secrets.scan(glue + base64.b64encode(SECRET.encode()).decode())[1]), glue


@pytest.mark.parametrize("at", [1000, (1 << 22) - 20_000, (1 << 22) - 300, (1 << 22) + 100, 2 * (1 << 22) - 9000])
@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, zstandard.ZstdCompressor().compress])
def test_nested_layers_across_the_cut(pack, at):
    """A long run that holds compressed bytes with one secret, wherever the unpacked bytes around it are cut."""
    r = random.Random(at)
    noise = "".join(r.choices("abcdefghij ", k=50_000))
    inner = base64.b64encode(pack((noise + " " + SECRET + " " + noise).encode())).decode()
    assert len(inner) > 30_000
    text = "ab " * (at // 3) + inner + " yz" * 2_000_000
    packed = base64.b64encode(pack(text.encode())).decode()
    own, every, layers = secrets.scan(f"see {packed} there")
    assert [s for s in every if s[0] == "assign"] == [("assign", 4, 4 + len(packed))] and layers >= 3


def test_compressions_that_hold_one_another():
    data = SECRET.encode()
    for k in range(60):
        data = (gzip.compress, zlib.compress, zstandard.ZstdCompressor().compress)[k % 3](data)
    packed = base64.b64encode(data).decode()
    assert any(s[0] == "assign" for s in secrets.scan(packed)[1])
    # what only looks compressed is text
    assert any(s[0] == "assign" for s in secrets.scan(base64.b64encode(zlib.compress(b"x^ " + SECRET.encode())).decode())[1])


def test_unpacked_bytes_are_not_held(tmp_path):
    """What unpacks to 128 MB needs at most 64 MB more than what unpacks to 32 MB."""
    used = {}
    for n in (32, 128):
        with gzip.open(tmp_path / f"{n}.gz", "wb", 1) as f:
            for _ in range(n):
                f.write(b"a line of words, and then some more of it.\n" * ((1 << 20) // 43))
            f.write(b" " + SECRET.encode())
        (tmp_path / f"{n}.txt").write_bytes(base64.b64encode((tmp_path / f"{n}.gz").read_bytes()))
        code = f"import resource; from gradus.llm import secrets; got = secrets.scan(open({str(tmp_path / f'{n}.txt')!r}).read())[1]; assert any(s[0] == 'assign' for s in got); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
        root = os.path.dirname(os.path.dirname(secrets.__file__)).rsplit("/", 1)[0]
        used[n] = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": root}).stdout)
    assert used[128] - used[32] <= 64


def test_neighbours(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    odd = spark.createDataFrame([(10_000, None), (10_020, [0.0] * 64), (10_040, [float("nan")] * 64), (10_060, [None] + [1.0] * 63), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours(v.select("vec_id", "embedding").union(odd)).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    rows = v.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    hit = 0
    for q in ids[ids % 20 == 0].tolist():
        s = (x * x[ids == q]).sum(1)
        want = [(int(ids[k]), s[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda t: (-t[1], t[0]))
        assert all(abs(s[ids == i][0] - z) < 1e-12 for i, z in got[q])
        hit += len({i for i, _ in want} & {i for i, _ in got[q]})
    assert hit >= 0.9 * 20 * len(got) and set(got) == set(ids[ids % 20 == 0].tolist())


def test_neighbours_over_lists(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 24))
    x[:700] = x[0]  # a hot vector
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in neighbours(v, k=10, query_mod=100, lists=120).orderBy("rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    hit = 0
    for q in range(0, 3000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        want = s[np.argsort(-s)[:10]]
        hit += sum(s[i] >= want[-1] - 1e-9 for i in got[q])
    assert hit >= 0.9 * 300
    assert neighbours(v.limit(0)).count() == 0 and neighbours(v.where("vec_id = 0")).count() == 0


def test_probes_follow_the_measured_recall():
    """Clustered rows need few lists, spread ones most of them; what the probed lists hold is near what was asked for."""
    r = np.random.default_rng(8)
    tight = np.repeat(r.standard_normal((100, 32)) * 5, 40, axis=0) + r.standard_normal((4000, 32)) * 0.3
    tight = r.permutation(tight / np.linalg.norm(tight, axis=1)[:, None])
    spread = r.standard_normal((4000, 32))
    probes = []
    for x in (tight, spread):
        index = Index(np.arange(4000), x, float(np.linalg.norm(x, axis=1).max()), 4000, 120)
        assert len(index.centres) == 120
        cells, held, every = index.cells(index.rotated(x)), 0, 0
        for i in range(0, 4000, 20):
            s = x @ x[i]
            s[i] = -np.inf
            best, seen = np.argsort(-s)[:20], set(index.probed(index.rotated(x[i : i + 1], query=True))[0].tolist())
            held, every = held + sum(c in seen for c in cells[best].tolist()), every + 20
        assert held / every > 0.94
        probes.append(index.probes)
    assert probes[0] < 20 < probes[1] <= 120


def test_neighbours_edges(spark):
    """Vectors of another length take no part, ids that repeat count once, clashing columns are not read."""
    rows = [(i, [float(i % 7), 1.0, float(i)], "x", 0.5) for i in range(60)] + [(61, [1.0, 2.0], "x", 0.5), (62, [], "x", 0.5), (20, [9.0, 9.0, 9.0], "x", 0.5)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string, score double")
    got = neighbours(v, k=5).collect()
    ids = Counter((r["query_id"], r["vec_id"]) for r in got)
    assert set(ids.values()) == {1} and not {61, 62} & {i for pair in ids for i in pair} and {r["query_id"] for r in got} == {0, 20, 40}
    assert all(r["query_id"] != r["vec_id"] for r in got) and len(got) == 15


# ---------------------------------------------------------------- language model


def test_language_model(spark, edge):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(edge.select("doc_id", "text"))
    got = language_model_scores(docs).collect()
    rows = docs.collect()
    known, own = Counter(), []
    for r in rows:
        w = [*(r["text"] or "").encode().lower().split(), b" "]
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
        own.append((r["doc_id"], held, w))
        if not held:
            known.update(w)
    n, v = sum(known.values()), len(known)
    want = sorted(((str(i), h, len(w), sum(known[x] > 0 for x in w), n, sum(math.log10((known[x] + 1) / (n + v + 1)) for x in w)) for i, h, w in own), key=str)
    have = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=str)
    assert [x[:5] for x in have] == [x[:5] for x in want] and [x[5] for x in have] == pytest.approx([x[5] for x in want])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] <= 0 and r["bits_per_byte"] >= 0 for r in got)


def test_language_model_without_rows(spark, nothing):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    assert language_model_scores(nothing).count() == 0 and spark.conf.get(rows) in (before, "512")


def test_language_model_edges(spark, edge):
    """Columns that clash with the result's are not read; an id that is not there is not held out; a second run agrees."""
    got = [sorted(map(str, language_model_scores(edge).collect())) for _ in range(2)]
    assert got[0] == got[1] and len(got[0]) == edge.count()
    alone = language_model_scores(spark.createDataFrame([(i, "only held out") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")).collect()
    assert alone and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in alone)


def lm_rows(texts, n_blocks=2, held=lambda i: i % 7 == 2):
    """Blocks of random texts with the words' counts and strings, as the jobs make them."""
    each = len(texts) // n_blocks
    rows = [lm_tokens.row_of(k, list(range(each)), held(np.arange(each)), pa.array(texts[k * each : (k + 1) * each])) for k in range(n_blocks)]
    asks = pa.Table.from_batches(list(lm_tokens.word_asks(1)(iter([pa.RecordBatch.from_pylist(rows)]))))
    answers = pa.concat_tables([lm_tokens.word_answers(1)(asks.filter(pa.compute.equal(asks["range"], r))) for r in (0, 1)]).to_pylist()
    top = sum(lm_tokens.unpack(a["counts"], np.int64) for a in answers if a["block"] == -1)
    for row in rows:
        own = sorted((a for a in answers if a["block"] == row["block"]), key=lambda a: a["range"])
        for c, kind in (("counts", np.int64), ("depth", np.uint8), ("deep", np.int8), ("share", np.float32)):
            row[c] = lm_tokens.pack(np.concatenate([lm_tokens.unpack(a[c], kind) for a in own]))
        row["spell"] = np.zeros(row["n_words"], np.float32).tobytes()
    return rows, top


def lm_answered(rows, keep, bits, monkeypatch):
    monkeypatch.setattr(lm_contexts, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    asks = pa.Table.from_batches([b for k in (1, 2) for b in lm_contexts.context_asks(keep, bits, k)(iter([pa.RecordBatch.from_pylist(rows)]))])
    answers = pa.concat_tables([lm_contexts.context_answers(asks.filter(pa.compute.equal(asks["range"], r))) for r in sorted(set(asks["range"].to_pylist()))]).to_pylist()
    for row in rows:
        row["answers"] = [a for a in answers if a["block"] == row["block"]]
    return sum(lm_tokens.unpack(a["train"], np.int64) for a in answers if a["block"] == -1)


def random_texts(n=60, seed=6):
    r = random.Random(seed)
    texts = [" ".join(r.choices([f"w{k}" for k in range(40)], [1 / (k + 1) for k in range(40)], k=r.randrange(1, 80))) for _ in range(n)]
    return [*texts[:-2], "", texts[0] + f" once{seed} " + texts[0]]


def test_strings_name_words():
    rows, _ = lm_rows(random_texts())
    seen = set()
    for row in rows:
        place, c, depth = (lm_tokens.unpack(row[f], kind).tolist() for f, kind in (("places", np.uint64), ("counts", np.int64), ("depth", np.uint8)))
        seen.update(zip(lm_tokens.class_of(np.array(c)).tolist(), place, depth, strict=True))
    known = [x for x in seen if x[0]]
    assert len(known) > 35
    # no word's string begins another's of its class
    assert all(a == b or a[0] != b[0] or a[1] >> 64 - min(a[2], b[2]) != b[1] >> 64 - min(a[2], b[2]) for a in known for b in known)


def test_contexts_are_counted_apart(monkeypatch):
    """Opinions that ranges answer against counts of every context and prefix on its own, a training token's own left out."""
    rows, _ = lm_rows(random_texts())
    stats = lm_answered(rows, 30, 2, monkeypatch)
    texts = [lm_contexts.Text(row, 30) for row in rows]
    seen, plain = Counter(), 0
    for t in texts:
        for k in (1, 2):
            ids, hashes = t.context[k]
            for i in np.flatnonzero(~t.held).tolist():
                s = int(t.strings[t.rank[i]])
                seen.update((k, int(hashes[ids[i]]), d, s >> 25 - d) for d in range(26))
        plain += t.stats()
    assert (plain == stats).all() and plain.any()
    some = 0
    for row, t in zip(rows, texts, strict=True):
        for k in (1, 2):
            ids, hashes = t.context[k]
            *_, asked, event = t.events(k)
            table = np.zeros((int((asked >> 1).sum() + (asked & 1).sum()) + 1, 26), np.int8)
            at = lm_contexts.answered(row["answers"], k, 2, asked, event, t, table[:-1])
            for i in range(len(t.number)):
                if t.hit[i]:
                    assert not table[at[i]].any()
                    continue
                s, own, want = int(t.strings[t.rank[i]]), int(not t.held[i]), []
                for d in range(25):
                    same, every = (seen[k, int(hashes[ids[i]]), x, s >> 25 - x] - own for x in (d + 1, d))
                    want.append(round(math.log((same + 0.4) / (every - same + 0.4)) * lm_tokens.SCALE))
                assert np.abs(table[at[i], 1:] - np.array(want)).max() <= 1 and table[at[i], 0] == 0
                some += any(want)
    assert some > 500


def scalar_mix(t, table, index, flags, count, used):
    """The mixer decision by decision in plain Python, updating after each one."""
    out = np.zeros(len(t.number))
    for a, n in zip(t.start.tolist(), t.sizes.tolist(), strict=True):
        w = {(g, d): [float(x) / lm_tokens.SCALE for x in mixing_lm.START[g]] for g in range(4) for d in range(26)}
        gain = dict.fromkeys(w, 1.0)
        for i in range(a, a + n):
            g = count["gate"][i]
            for d in ([0] if t.can[i] else []) + list(range(1, 1 + used[i])):
                x = [float(table[index[k][i], d]) for k in range(4)]
                if d == 0:
                    x = [float(flags[0][i]), float(flags[1][i]), 0.0, 0.0]
                dot = sum(p * q for p, q in zip(w[g, d], x, strict=True))
                sure = gain[g, d]
                p = 1 / (1 + math.exp(-dot * sure))
                out[i] += math.log10(p)
                w[g, d] = [p0 + mixing_lm.RATE / lm_tokens.SCALE**2 * (1 - p) * sure * q for p0, q in zip(w[g, d], x, strict=True)]
                gain[g, d] = max(0.3, sure + mixing_lm.REFINE_RATE * (1 - p) * dot)
    return out


def test_mixer_equals_a_scalar_one(monkeypatch):
    rows, top = lm_rows(random_texts(120, 3))
    stats = lm_answered(rows, 30, 1, monkeypatch)
    model, held = mixing_lm.Model(top, stats, 30, 1), {}
    whole = mixing_lm.mixed

    def watch(table, index, flags, can, gate, count, start, sizes):
        held.update(table=table, index=index, flags=flags, gate=gate, count=count, out=whole(table, index, flags, can, gate, count, start, sizes))
        return held["out"]

    monkeypatch.setattr(mixing_lm, "mixed", watch)
    for row in rows:
        got = model.score(row)
        t = lm_contexts.Text(row, 30)
        want = scalar_mix(t, held["table"], held["index"], held["flags"], held, (held["count"] - t.can).tolist())
        assert np.abs(held["out"] - want).max() < 1e-4 and abs(held["out"].mean() - want.mean()) < 1e-6
        assert (got["score"] < 0).all() and (got["n_tokens"] == t.sizes).all()


def test_mixer_is_a_distribution(monkeypatch):
    """After any beginning, the probabilities of all words that could follow come to one at most."""
    texts = random_texts(200, 9)
    words = sorted({w for t in texts for w in t.split()})
    begin = "w1 w0 w7 w2 w0 w1 w3 w0"
    rows, top = lm_rows([*texts, *(f"{begin} {w}" for w in words), begin + " never"], 1, lambda i: i >= len(texts))
    row = rows[0]
    stats = lm_answered(rows, 30, 1, monkeypatch)
    model, held = mixing_lm.Model(top, stats, 30, 1), {}
    whole = mixing_lm.mixed
    monkeypatch.setattr(mixing_lm, "mixed", lambda *a: held.setdefault("out", whole(*a)))
    got = model.score(row)["score"]
    assert len(got) > len(texts)
    t = lm_contexts.Text(row, 30)
    share = lm_tokens.unpack(row["share"], np.float32)
    total = sum(10.0 ** (held["out"][t.start[len(texts) + k] + 8] + share[t.number[t.start[len(texts) + k] + 8]]) for k in range(len(words)))
    assert 0.5 < total < 1.0 + 1e-3


def test_weights_are_carried_through_a_long_text():
    """A predictor that is always right gains trust to the end of a text, beside a short text that ends early."""
    n = 1000
    table = np.zeros((2, 26), np.int8)
    table[0, 1], table[1, 1] = 30, -30
    index = np.stack([np.zeros(n + 3, np.int64), *[np.ones(n + 3, np.int64)] * 3])
    none, one = np.zeros(n + 3, np.int64), np.ones(n + 3, np.int64)
    p = mixing_lm.mixed(table, index, np.zeros((2, n + 3), np.int8), none > 0, none + 1, one, np.array([0, n]), np.array([n, 3]))
    assert (np.diff(p[:n]) > -1e-4).all() and p[n - 1] > p[127] > p[0] and p[n : n + 3] == pytest.approx(p[:3])


def test_words_seen_twice_score_apart(spark):
    """A model of the whole corpus expects a text that occurs twice."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("length(text) > 200")
    got = docs.join(language_model_scores(docs), "doc_id").where("not held_out").withColumn("n", F.expr("count(*) over (partition by text)"))
    once, twice = (got.where(w).select(F.median("bits_per_byte")).first()[0] for w in ("n = 1", "n = 2"))
    assert twice < 0.7 * once


def test_all_byte_pairs_are_spelled(spark):
    pairs = [bytes([a, b]) for a in range(0x21, 0x7F) for b in range(0x21, 0x7F)]
    text = pa.array([" ".join(p.decode() for p in pairs)])
    row = lm_tokens.row_of(0, [1], np.array([False]), text)
    blocks = spark.createDataFrame([(bytearray(row["codes"]), bytearray(row["times"]))], "codes binary, times binary")
    model = mixing_lm.spelling(blocks)
    assert (model.slot >= 0).sum() == len(np.unique(lm_tokens.unpack(row["codes"], np.int32) >> 8)) > 4096


def test_pack():
    for a in (np.arange(-5, 70_000, 3), np.zeros(0, np.int64)):
        assert (lm_tokens.unpack(lm_tokens.pack(a), np.int64) == a).all()


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept.append(stage(spark, kept[-1], DATA).cache())
        assert kept[-1].columns == docs.columns and kept[-1].count() <= kept[-2].count()
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in kept]
    from .test_dedup import brute_exact, brute_near

    rows = [tuple(r) for r in kept[1].select("doc_id", "text").collect()]
    assert ids[2] == {x[0] for x in brute_exact(rows) if x[3]}
    assert ids[3] == {k for k, v in brute_near([r for r in rows if r[0] in ids[2]]).items() if k == v}
    out = corpus_pipeline.run(spark, DATA)
    mix = mixture(kept[3]).agg(F.sum("copies")).first()[0]
    assert out.count() == mix and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_edges(spark, edge, nothing):
    """Nulls, repeated rows, ties, a long text and clashing columns through all stages; the empty table too."""
    docs, sizes = edge, [edge.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == edge.columns, name
        sizes.append(docs.count())
    # nothing is toxic; of the row that repeats, its copy and near copy, and of empty texts, one stays; then copies by the mix
    assert sizes[:4] == [12, 12, 8, 7]
    left = Counter(r["doc_id"] for r in docs.collect())
    assert set(left) <= {1, 5, 6, 7, 8, 9, None} and max(left.values()) <= 3
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert Counter(r["doc_id"] for r in out.collect()) == left
    empty = nothing.select("doc_id", "text", "source", "extra")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, DATA)
        assert empty.columns == ["doc_id", "text", "source", "extra"]
    assert corpus_pipeline.STAGES[-1][1](spark, empty, DATA).count() == 0


def test_language_model_deals_answers_out_in_parts(spark, monkeypatch):
    """No more than a part of the answers is dealt out before those of the last part are gone; scores are those of one part."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 50))) for i in range(400)], "doc_id long, text string").repartition(6)
    one = sorted(map(str, language_model_scores(docs).collect()))
    steps, stored, drop = [], mixing_lm.Scratch.stored, mixing_lm.Scratch.drop_part
    monkeypatch.setattr(mixing_lm.Scratch, "stored", lambda self, df, name, **how: (steps.append(name), stored(self, df, name, **how))[1])
    monkeypatch.setattr(mixing_lm.Scratch, "drop_part", lambda self, name, *what: (steps.append(f"-{name}"), drop(self, name, *what))[1])
    monkeypatch.setattr(mixing_lm, "PARTS", 3)
    monkeypatch.setattr(mixing_lm, "LEAST_BLOCKS", 1)
    assert sorted(map(str, language_model_scores(docs).collect())) == one
    assert steps == ["blocks", "words", "coded", *(["asks", *["contexts", "-asks"] * 3] * 2), *["scores", "-contexts"] * 3]


def test_opinions_are_sent_as_far_as_they_differ():
    """Rows come back whole; what a row repeats to its end takes no room."""
    r = np.random.default_rng(5)
    rows = np.repeat(r.integers(-127, 128, (3000, 1)), 25, axis=1).astype(np.int8)
    far = r.integers(0, 26, 3000)
    far[:2] = 0, 25
    differ = np.arange(25) < far[:, None]
    rows[differ] = r.integers(-127, 128, differ.sum())
    reached = lm_contexts.reach(rows)
    assert (reached <= np.minimum(far + 1, 25)).all() and reached[0] == 1
    raw, out = lm_contexts.squeezed(rows, reached), np.zeros((3001, 26), np.int8)
    assert lm_contexts.spread(raw, out) == 3000 and (out[:-1, 1:] == rows).all() and not out[-1].any() and not out[:, 0].any()
    assert len(raw) < differ.sum() + 2 * 3000 + 200
    none = lm_contexts.squeezed(rows[:0], reached[:0])
    assert lm_contexts.spread(none, out) == 0 and lm_contexts.spread(none, out[:0]) == 0


def test_blocks_keep_short_names_of_words():
    """Names stay distinct, in order and in their cells, and take less than half of the room."""
    place = np.unique(np.append(np.random.default_rng(3).integers(0, 1 << 63, 200_000, dtype=np.uint64) * np.uint64(2), np.array([0, 1, 2, (1 << 64) - 1, (1 << 64) - 2], np.uint64)))
    names = lm_tokens.shortened(place)
    assert (names[1:] > names[:-1]).all() and (lm_tokens.cell_of(names) == lm_tokens.cell_of(place)).all()
    assert 2 * len(lm_tokens.pack(names)) < len(lm_tokens.pack(place))
    assert all((lm_tokens.cell_of(lm_tokens.shortened(place[:n])) == lm_tokens.cell_of(place[:n])).all() for n in (0, 1, 2))
    asks = pa.table({"range": pa.array([0], pa.int32()), "block": [7], "places": pa.array([lm_tokens.pack(place)], pa.binary()), "counts": pa.array([lm_tokens.pack(np.ones(len(place), np.int32))], pa.binary())})
    got = lm_tokens.word_answers(0)(asks)
    assert (lm_tokens.unpack(got["names"][0].as_py(), np.uint64) == names).all()


def test_grouped_orders_and_marks_changes():
    a, b = np.random.default_rng(1).integers(0, 9, (2, 500))
    for bits in (4, 60):
        order, new = lm_tokens.grouped((a, 4), (b, bits))
        pairs = list(zip(a[order].tolist(), b[order].tolist(), strict=True))
        assert pairs == sorted(pairs) and new.tolist() == [i == 0 or pairs[i] != pairs[i - 1] for i in range(500)]


def test_asks_of_two_words_need_no_runs():
    """What only the statistics and scores look at is made when it is read."""
    rows, _ = lm_rows(random_texts())
    text = lm_contexts.Text(rows[0], 30)
    text.events(2)
    assert not {"near", "pair", "run"} & set(vars(text))
    assert text.pair.tolist() == (text.near * lm_contexts.CLASSES + np.where(np.isin(np.arange(len(text.near)), text.start), text.end_cls, np.roll(text.near, 1))).tolist()


def test_opinions_are_made_as_far_as_keys_meet_others():
    """A key has an opinion for each bit until it is alone and one more, equal to those of all counts; nothing is made for the bits after."""
    r = np.random.default_rng(8)
    keys = np.unique(np.concatenate([r.integers(0, 1 << 40, 3000), r.integers(0, 1 << 9, 200), (5 << 25) + r.integers(0, 1 << 25, 2000)]).astype(np.uint64))
    n = r.choice([0, 1, 2, 3, 700], len(keys), p=[0.2, 0.5, 0.2, 0.09, 0.01])
    reached, *tables = lm_tokens.prefix_opinions(keys, n, 25)
    assert len(tables) == 2 and all(len(t) == reached.sum() for t in tables) and 3 * reached.sum(dtype=int) < 2 * 25 * len(keys)
    every = Counter()
    for k, c in zip(keys.tolist(), n.tolist(), strict=True):
        every.update({(d, k >> 25 - d): c for d in range(26)})
    end = np.cumsum(reached, dtype=int)
    for k, c, a, b in zip(keys.tolist(), n.tolist(), (end - reached).tolist(), end.tolist(), strict=True):
        for table, less in zip(tables, (0, min(1, c)), strict=True):
            same = np.array([every[d + 1, k >> 24 - d] for d in range(25)]) - less
            total = np.array([every[d, k >> 25 - d] for d in range(25)]) - less
            assert (lm_tokens.stretched(same, total - same) == np.append(table[a:b], np.repeat(table[b - 1], 25 - b + a))).all()
    assert [len(x) for x in lm_tokens.prefix_opinions(keys[:0], n[:0], 25)] == [0, 0, 0]
    assert (lm_tokens.prefix_opinions(keys, n, 25, less=0)[1] == tables[0]).all() and len(lm_tokens.prefix_opinions(keys, n, 25, less=0)) == 2


def test_decisions_past_a_word_teach_nothing():
    """What the table holds past a token's string neither counts nor moves weights."""
    r = np.random.default_rng(2)
    n, table = 400, r.integers(-60, 60, (9, 26)).astype(np.int8)
    index, used = r.integers(0, 8, (4, n)), r.integers(0, 26, n)
    flags, never = np.zeros((2, n), np.int8), np.zeros(n, bool)
    table[:, 0] = 0
    cut = np.concatenate([table[index[k], :] * (np.arange(26) <= used[:, None]) for k in range(4)]).astype(np.int8)
    rest = (flags, never, r.integers(0, 4, n), used, np.array([0, 300]), np.array([300, 100]))
    assert (mixing_lm.mixed(table, index, *rest) == mixing_lm.mixed(cut, np.arange(4 * n).reshape(4, n), *rest)).all()
