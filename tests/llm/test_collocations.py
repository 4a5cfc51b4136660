import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gradus.llm import collocations as co
from gradus.llm import queries
from gradus.llm.collocations import Bits, Frequent, automaton, collocations, cuts, pack, runs, summed, table_of, unpack

from ..conftest import DATA

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, longest, top):
    """rows are (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if a >= cand[lang, w[i : i + k]]:
                    dropped.add((lang, w[i : i + k]))
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in dropped:
            s, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, v in out.items() for k, x in enumerate(sorted(v)[:top]))


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_against_sql(spark):
    c = duckdb.connect()
    sf = DATA.replace("0.001", "0.01")
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(queries.OP12_SQL)
    df = queries.op12_collocations(spark, sf)
    assert set(df.columns) == set(want.columns)
    found = got(df)
    assert found == sorted(want.select(*COLUMNS).fetchall()) and len(found) > 50


@pytest.mark.parametrize(("least", "longest", "top", "block"), [(3, 5, 2000, 1 << 21), (2, 5, 7, 40), (4, 2, 2000, 1), (2, 6, 2000, 300), (1, 3, 50, 90)])
def test_against_brute_force(spark, least, longest, top, block):
    r = random.Random(least * 100 + block)
    rows = [(" ".join(r.choice(["a", "b", "Cd", "É", "x.", ";y", "中", "long phrase of words"]) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None])) for _ in range(120)]
    rows += [("A hot passage, that a third of all rows repeat.", "en")] * 60
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, score int").repartition(5)
    assert got(collocations(docs, least, longest, top, block)) == brute(rows, least, longest, top)


def test_edges(spark, edge, nothing):
    docs = edge.selectExpr("doc_id", "text", "source as lang", "node as phrase", "score")
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert got(collocations(docs, 2)) == brute(rows, 2, 5, 2000)
    assert collocations(nothing.withColumn("lang", nothing["source"])).count() == 0
    assert collocations(docs, 10**6).count() == 0
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError, match="longest"):
        collocations(docs, 2, 1)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_long_pieces_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(co, "CUT", 200)
    r = random.Random(5)
    rows = [(" ".join(r.choice(["ab", "cd", "ef", "g" * 300]) for _ in range(3000)), "en"), ("no space " * 100, "en"), ("w" * 5000, "en")]
    found = [row for row in co._blocks([_batch(rows)], 50, 5)]
    assert len(found) > 20
    whole = Counter()
    for b in found:
        x = np.frombuffer(co.zstandard.ZstdDecompressor().decompress(b.column("ids")[0].as_py()), np.int32)
        words = [None, *b.column("words")[0].as_py()]
        s = automaton(x, 5, np.arange(len(x)) >= b.column("skip")[0].as_py())
        for n, own in s.substrings(1, 5):
            for k in own:
                e = s.end[k]
                whole[tuple(words[i] for i in x[e - n + 1 : e + 1])] += int(s.endpos[k])
    want = Counter()
    for t, _ in rows:
        w = t.encode().split()
        want.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    assert whole == want
    assert b"".join(cuts(b"one two.three " * 50, 20)) == b"one two.three " * 50


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows]), pa.array([x[0].encode() for x in rows], pa.binary())], names=["lang", "text"])


def test_automaton_states_are_classes_of_ends():
    r = np.random.default_rng(3)
    for _ in range(60):
        depth = int(r.integers(1, 6))
        x = r.integers(0, 4, int(r.integers(0, 60))).astype(np.int32)
        skip = int(r.integers(0, len(x) + 1)) if len(x) else 0
        ends = {}
        for e in range(skip, len(x)):
            for n in range(1, depth + 1):
                if e - n + 1 < 0 or not x[e - n + 1 : e + 1].all():
                    break
                ends.setdefault(tuple(x[e - n + 1 : e + 1]), []).append(e)
        # substrings with the same ends are one state
        by = {}
        for w, e in ends.items():
            by.setdefault(tuple(e), []).append(w)
        s = automaton(x, depth, np.arange(len(x)) >= skip)
        word = lambda k, n: tuple(x[s.end[k] - n + 1 : s.end[k] + 1])
        seen = {tuple(ends[word(k, s.longest[k])]): k for k in range(len(s.end))}
        assert set(seen) == set(by) and len(s.end) == len(by)
        for e, k in seen.items():
            sizes = sorted(map(len, by[e]))
            assert (s.shortest[k], s.longest[k], s.endpos[k]) == (sizes[0], sizes[-1], len(e)) and sizes == [*range(sizes[0], sizes[-1] + 1)]
            short = word(k, s.shortest[k])[1:]
            assert s.link[k] == (seen[tuple(ends[short])] if short else -1)


def test_runs_and_bits(spark):
    x = np.array([1, 2, 0, 3, 4, 5, 6, 0, 7, 8], np.int32)
    ok = np.array([1, 1, 1, 1, 0, 1, 1, 1, 0], bool)
    out, skip = runs(x, ok, 4)
    assert out.tolist() == [1, 2, 0, 3, 4, 0, 5, 6, 0] and out[skip] == 4
    marks = [0, 1, 5, -1, -(1 << 63), (1 << 63) - 1, 77]
    bits = table_of(spark.createDataFrame([(m,) for m in marks], "mark long"), len(marks))
    assert bits.has(np.array(marks)).all() and not bits.has(np.array([2, 3, 78])).any()
    full = Bits(3, b"\xff")
    assert full.has(np.arange(-50, 50)).all()


def test_packed_hashes_come_back():
    r = np.random.default_rng(1)
    keys, counts = summed(r.integers(0, 1 << 32, 5000).astype(np.uint64), r.integers(1, 1 << 31, 5000))
    a, n = unpack(pack(keys.astype(np.uint32), counts))
    assert (a == keys).all() and (n == counts).all()
    k, n = summed(np.array([5, 3, 5], np.uint64), np.array([1, 2, 3]))
    assert k.tolist() == [3, 5] and n.tolist() == [2, 4]


def test_passing_never_holds_back(spark):
    """With full tables all phrases within pieces pass; with empty ones none longer than a word."""
    x, marks = np.array([1, 2, 0, 2, 1, 1], np.int32), np.array([0, -5, 9])
    ok, h = Frequent(40, (Bits(3, b"\xff"),) * 2).passing(x, marks)
    assert [o.tolist() for o in ok] == [[1, 1, 0, 1, 1, 1], [0, 1, 0, 0, 1, 1], [0, 0, 0, 0, 0, 1], [0] * 6]
    ok, _ = Frequent(40, (Bits(3, b"\0"),)).passing(x, marks)
    assert not ok[1].any() and not ok[2].any()


def test_full_tables_change_nothing(spark, monkeypatch):
    r = random.Random(11)
    rows = [(" ".join(r.choices(["ab", "cd", "ef", "gh", "ij"], k=25)), "en") for _ in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(co, "table_of", lambda marks, count: Bits(15, b"\xff" * 4096))
    assert got(collocations(docs, 4)) == brute(rows, 4, 5, 2000)


def test_joined_blocks_count_as_one(monkeypatch):
    def block(lang, words, marks, x, skip):
        held = co.zstandard.ZstdCompressor().compress(np.array(x, np.int32).tobytes())
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([words], pa.list_(pa.binary())), pa.array([marks], pa.list_(pa.int64())), pa.array([held], pa.binary()), pa.array([skip], pa.int32())], names=["lang", "words", "marks", "ids", "skip"])

    blocks = [block("en", [b"a", b"b"], [7, 8], [1, 2, 1], 1), block("de", [b"b"], [9], [1, 1], 0), block("en", [b"b", b"c"], [8, 5], [1, 2, 0, 1], 0)]
    got = {lang: ([names[int(i) - 1].as_py() if i else None for i in x], marks[x].tolist(), counted.tolist()) for lang, names, marks, x, counted in co._together(iter(blocks))}
    assert got["en"] == ([b"a", b"b", b"a", None, b"b", b"c", None, b"b", None], [7, 8, 7, 0, 8, 5, 0, 8, 0], [False, True, True, False, True, True, True, True, False])
    assert got["de"][0] == [b"b", b"b", None]
    monkeypatch.setattr(co, "BLOCK", 3)
    assert [(g[0], len(g[3])) for g in co._together(iter(blocks))] == [("en", 4), ("en", 5), ("de", 3)]
