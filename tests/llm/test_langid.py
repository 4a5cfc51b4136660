import re
import zlib

import pytest
import zstandard

from gradus.llm import langid
from gradus.llm.langid import Classifier, identify, learn

from ..conftest import DATA


def plain(model, text):
    """Sizes by a second way of setting the encoder up, one frame a chunk."""
    out = []
    for _, raw in model.texts:
        size = 0
        for a in range(0, len(text), langid.CHUNK):
            params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, min_match=langid.MIN_MATCH, dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
            found = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(text[a : a + langid.CHUNK])
            back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).decompress(found, max_output_size=langid.CHUNK)
            assert back == text[a : a + langid.CHUNK]
            size += len(found) - 4  # the magic number
        out.append(size)
    return out


def test_identify_by_brute_force_and_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = learn(docs)
    assert [len(raw) for _, raw in model.texts] and all(len(raw) <= langid.DICT_BYTES for _, raw in model.texts)
    texts = {r["doc_id"]: r for r in docs.collect()}
    got = identify(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        own = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        x = " ".join(re.findall(r"[^\W\d_]+", own["text"] or "")).lower().encode()
        if not x:
            assert (r["lang_pred"], r["score"], r["margin"], r["decided"]) == ("und", 0.0, None, False)
            continue
        sizes = plain(model, x)
        assert r["lang_pred"] == model.texts[sizes.index(min(sizes))][0] and r["margin"] == sorted(sizes)[1] - min(sizes)
        assert 0 < r["score"] <= 1 and (not r["decided"] or r["score"] >= 0.4)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)
    sure = [r for r in held if r["decided"]]
    assert sum(r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in sure) >= 0.97 * len(sure)


def test_labels_of_held_out_rows_and_of_the_row_itself_do_not_matter(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lied = docs.selectExpr("doc_id", "text", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 then 'xx' else lang end as lang")
    assert sorted(identify(docs).collect()) == sorted(identify(lied).collect())


def test_edges(spark, edge, nothing):
    docs = edge.selectExpr("doc_id", "text", "case when doc_id = 6 then null when doc_id = 8 then 'de' else 'en' end as lang", "source as margin", "node as decided")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = identify(docs).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert len(got) == edge.count()
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (3, 4, 5)} == {"und"} and all(by[i]["score"] == 0 for i in (3, 4, 5))
    assert by[None]["held_out"] is False and by[7]["lang_pred"] in ("en", "de")
    assert identify(nothing.withColumn("lang", nothing["source"])).count() == 0
    unlabelled = identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    one = {r["doc_id"]: r for r in identify(docs.selectExpr("doc_id", "text", "'en' lang")).collect()}
    assert one[1]["lang_pred"] == "en" and one[1]["score"] == 1.0 and one[1]["margin"] is None and one[4]["lang_pred"] == "und"


def test_ties_and_long_texts():
    model = Classifier([("b", b"one two three four five six"), ("a", b"one two three four five six")])
    assert model.name("one two three four five six")[0] == "b" and model.name("x")[1] == 0.5 and not model.name("x")[3]
    model = Classifier([("en", b"the house of the river and the hill " * 50), ("de", "das haus an dem fluss und der berg ".encode() * 50)])
    name, score, margin, sure = model.name("der fluss und das haus " * 5_000)
    assert name == "de" and sure and margin > 100 and score > 0.99
    assert model.name("the river and the house")[0] == "en"


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        identify(docs)
