import hashlib
import json
import random
import time

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradus.llm import token_counts as tc
from gradus.llm.common import bitmap, may_be
from gradus.llm.pieces import MODEL, encode_decode, pieces

MIX = ["a", "B", " ", "  ", "\n", "é", "é", "İ", "ſ", "K", "'s", "'ll", "<|", "<|endoftext|>", "1", "２", "中", "　", "\x85", "\x1c", "!?", "ς", "ﬁ", "🤦", ".", ",", "a.", "▁", "</s>", "<0x41>", "abab", "ing"]


def mixes(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(MIX) for _ in range(r.randint(0, 25))) for _ in range(n)] + ["".join(chr(r.randrange(1, 0x3000)) for _ in range(20)) for _ in range(n // 4)]


def test_counts_equal_the_library():
    c = tc.counter(public_tokenizers.path(tc.MODEL))
    assert c.by_word
    texts = mixes(3000, 1)
    assert c.count(texts) == [len(c.lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts(spark, edge, nothing, tmp_path):
    lib = Tokenizer.from_file(public_tokenizers.path(tc.MODEL))
    lib.no_truncation()
    cache = str(tmp_path / "cache")
    got = tc.token_counts(edge, cache).collect()
    rows = edge.select("doc_id", "text").collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert {r["over_limit"] for r in got if r["doc_id"] == 7} == {True}
    assert tc.token_counts(nothing).count() == 0


def test_cache_holds_only_distinct_misses(spark, edge, tmp_path):
    cache = str(tmp_path / "cache")
    tc.token_counts(edge, cache).count()
    first = spark.read.parquet(cache)
    assert first.count() == first.select("digest").distinct().count() < edge.count()
    before = first.count()
    tc.token_counts(edge, cache).count()
    assert spark.read.parquet(cache).count() == before
    more = edge.union(spark.createDataFrame([(99, "something new", None, None, None)], edge.schema))
    assert tc.token_counts(more, cache).count() == more.count()
    assert spark.read.parquet(cache).count() == before + 1


def test_hits_send_no_text(spark, tmp_path):
    """Of texts that the cache holds, the bitmap lets almost none pass; every miss passes."""
    rows = spark.range(4000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).withColumn("mark", F.xxhash64("text")).withColumn("size", F.length("text").cast("long"))
    misses = rows.where("text like '%7'").withColumn("digest", F.md5("text"))
    through = rows.join(F.broadcast(bitmap(misses.select("mark")))).where(may_be(F.col("mark")))
    assert 400 <= through.count() < 410
    got = tc.missing(rows, misses, True).collect()
    assert sorted(r["text"] for r in got) == sorted(f"text {i}" for i in range(7, 4000, 10)) and all(hashlib.md5(r["text"].encode()).hexdigest() == r["digest"] for r in got)
    cache = str(tmp_path / "cache")
    docs = rows.select(F.lit(1).alias("doc_id"), "text")
    tc.token_counts(docs, cache).count()
    files = sorted(p.name for p in (tmp_path / "cache").rglob("*.parquet"))
    assert tc.token_counts(docs, cache).count() == 4000 and files == sorted(p.name for p in (tmp_path / "cache").rglob("*.parquet"))


def test_pieces_equal_the_library():
    path = public_tokenizers.path(MODEL)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces(path)
    for t in [*mixes(3000, 2), "", " ", "  a", "a" * 500, "ab" * 300, "\n\n"]:
        ids = [*lib.encode(t), lib.eos_id()]
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids), repr(t)


def test_long_words_equal_the_library():
    """Words without a space, as long as texts, in time that grows with them."""
    path = public_tokenizers.path(MODEL)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces(path)
    r = random.Random(5)
    english = "thequickbrownfoxjumpsoverthelazydogandthenitgoesonandonuntilsomebodystopsit"
    for n in (100, 3000, 80_000):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "aaab", "ing", "etaoinshr", "0123456789abcdef", "-=", english):
            word = "".join(r.choices(letters, k=n)) if letters is not english else (english * (n // 70 + 1))[:n]
            began = time.process_time()
            ids = own.encode(word, end=False)
            assert ids == lib.encode(word), (letters, n)
            assert time.process_time() - began < 5, (letters, n)
    for n in (17, 33, 1000, 50_000):
        for unit in ("a", "ab", "-", "=-", "haha", "\u4e2d"):
            assert own.encode(unit * n, end=False) == lib.encode(unit * n), (unit, n)


def test_encode_decode(spark, edge, nothing):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in edge.collect():
        ids = [*lib.encode(r["text"] or ""), lib.eos_id()]
        want.append((str(r["doc_id"]), len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, encode_decode(edge).collect())) == sorted(want)
    assert encode_decode(nothing).count() == 0


@pytest.mark.parametrize("pattern", [r"[^\s]+", r"[^\s.]+|[.]+", r"[^\s]{1,4}"])
def test_a_tokenizer_that_cuts_words_elsewhere_encodes_whole_texts(spark, tmp_path, pattern):
    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    spec["pre_tokenizer"] = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    lib = Tokenizer.from_file(str(path))
    texts = ["A word. And words, of some more kinds! yes?", "x", "", "end... of it; all:"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["doc_id"]: r["n_tokens"] for r in tc.token_counts(docs, model=str(path)).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert tc.counter(public_tokenizers.path("word_bpe_49k.json")).by_word
