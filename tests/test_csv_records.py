import csv
import io
import random
import time

import pytest

from gradus.sources import files
from gradus.sources.csv_records import records

from .conftest import plan


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def table(seed, n, eol="\r\n", breaks=True):
    r = random.Random(seed)
    word = lambda: "".join(r.choice('ab ,"\n\r\té中' if breaks else "ab ,é") for _ in range(r.randint(0, 12)))
    rows = [(f"q{i}", word(), word() if r.random() < 0.97 else word() * 200, word()) for i in range(n)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=eol)
    w.writerow(["qa_id", "a", "b c", "d"])
    for k, row in enumerate(rows):
        if k % 9 == 4:
            out.write(eol)  # an empty line is no row
        w.writerow(row)
    return out.getvalue(), rows


def put(folder, name, text):
    with open(folder / name, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return str(folder / name)


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_many_splits_against_the_csv_module(spark, small_splits, tmp_path, eol):
    text, rows = table(1, 200, eol)
    path = put(tmp_path, "x.csv", "﻿" + text)
    want = list(csv.reader(io.StringIO(text, newline="")))[1:]
    want = [tuple(x) for x in want if x]
    assert want == rows
    df = files.read_csv(spark, path)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    got = sorted(df.collect())
    assert [r["pos"] for r in got] == list(range(len(rows))) and [tuple(r)[1:] for r in got] == rows
    assert "multiLine" not in plan(df)


def test_several_files(spark, small_splits, tmp_path):
    every = []
    for k, name in enumerate(("b.csv", "a.csv", "c.csv")):
        text, rows = table(k + 5, 30 + k)
        put(tmp_path, name, text)
        every.append((name, rows))
    got = sorted(files.read_csv(spark, str(tmp_path)).collect())
    want = [r for _, rows in sorted(every) for r in rows]
    assert [r["pos"] for r in got] == list(range(len(want))) and [tuple(r)[1:] for r in got] == want
    put(tmp_path, "d.csv", "qa_id,other\n1,2\n")
    with pytest.raises(files.SourceError, match="differ"):
        files.read_csv(spark, str(tmp_path))


@pytest.mark.parametrize("text", ['a,b\n1,"open\n2,3\n', "a,b\n1,2,3\n", "a,b\n1\n", "a,b\n", "", 'a,b\n"1\n2",3\n4\n'])
def test_broken(spark, tmp_path, text):
    with pytest.raises(files.SourceError):
        files.read_csv(spark, put(tmp_path, "x.csv", text))


def test_records_at_the_edges(spark, tmp_path):
    path = put(tmp_path, "x.csv", 'a,b\n\n"x\n\ny","say ""no"""\n,\n\n')
    got = sorted(tuple(r)[1:] for r in records(spark, path).collect())
    assert got == [(0, -1, "a,b"), (1, 0, '"x\n\ny","say ""no"""'), (2, 1, ",")]
    assert [tuple(r) for r in sorted(files.read_csv(spark, path).collect())] == [(0, "x\n\ny", 'say "no"'), (1, "", "")]


def test_a_large_file_in_many_tasks(spark, tmp_path):
    """As the one-task reader, over 100 MB."""
    r = random.Random(2)
    chunk = [f'{r.random()},"line {k}\nnext ""{r.random()}"", and more",{"x" * 2000}\n' for k in range(1000)]
    path = tmp_path / "big.csv"
    with open(path, "w") as f:
        f.write("a,b,c\n")
        for _ in range(50):
            f.writelines(chunk)
    assert path.stat().st_size > 100_000_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() >= 13
        began = time.perf_counter()
        rows = files.read_csv(spark, str(path), strict=False)
        got = rows.selectExpr("count(*)", "count(distinct pos)", "max(pos)", "sum(xxhash64(a, b, c) >> 20)", "sum(pos * length(a))").first()
        assert time.perf_counter() - began < 120
        one = spark.read.csv(str(path), header=True, multiLine=True, escape='"')
        want = one.selectExpr("count(*)", "sum(xxhash64(a, b, c) >> 20)").first()
        assert (got[0], got[1], got[2], got[3]) == (want[0], want[0], want[0] - 1, want[1])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
