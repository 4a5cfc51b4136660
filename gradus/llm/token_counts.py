"""Token counts through a digest cache.

Each text gets a digest of its normalised content together with a digest of the tokenizer file.
Digests that the cache holds take their stored count; of the rest one text per digest is encoded
and its count appended to the cache, a Parquet table that any number of runs share, in a folder for
each tokenizer version. Only digests and marks (other hashes of the text as it stands, cheap to
compute again) meet the cache; texts are dealt out only if a bitmap of fixed size has the mark of a
miss. Copies reduce on the map side before anything is dealt out, and the final join moves digests
only, so a group of copies of a third of all rows is one row on one side and rows of a few bytes on
the other.

The normal form changes nothing that the tokenizer sees: runs of white space become one space and
A-Z becomes a-z, and only for tokenizers whose own normaliser does that; texts that hold the first
two characters of an added token stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_BYTES, ARROW_ROWS, SPACE, Scratch, bitmap, by_size, may_be, session_conf, shared_path, text_of

MODEL = "word_bpe_49k.json"
LIMIT = 2048
#: Words whose count a worker remembers.
MEMO = 500_000
# The rules of a tokenizer whose words can be counted apart.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Texts that a tokenizer that counts by word must count as a whole like that: ends of punctuation, marks inside words, cases, white space.
PROBES = (
    "word. Word, wOrd; word: word! word? word... word?! a.b,c d.e. f", "it's Don't I'LL we've 'tis ''quoted'' (in brackets). [x], {y}; \"z\"!", "12.5, 1,000. 3:45; 7! 50%? 2+2=4. a-b. c_d, e/f",
    "one\ntwo\r\nthree\tfour\x0bfive\x0csix   seven \n\n eight. ", "É. é, ß! Über? 中文。 中文. naïve; Ωmega: ñ...", "...x x... . , ;x x; !!a b!! ?c d? end.", "http://a.b/c?d=e. me@x.org, #tag; $5.00! ~y. `z`,",
)
_CACHE = "digest string, version string, n_tokens long"


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts of one worker process; words are runs outside ASCII white space.

    White space never is part of a token of such a tokenizer, so a text's count is the sum of its
    words' counts. Others encode whole texts.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(model)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(model, encoding="utf-8") as f:
            self.by_word = normalises(json.load(f))
        self.memo: dict[bytes, int] = {}
        # a pattern that only looks alike cuts words in other places; then whole texts are encoded
        self.by_word = self.by_word and all(self.count([t]) == self.encode([t]) for t in PROBES)
        self.memo.clear()

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.encode(texts)
        memo = self.memo
        cut = [t.encode().split() for t in texts]
        new = {w for words in cut for w in words}.difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = {w for words in cut for w in words}
        parts = {w: self.parts(w) for w in new}
        lone = list({p for both in parts.values() for p in both}.difference(memo))
        for at in range(0, len(lone), 4096):
            part = lone[at : at + 4096]
            memo.update(zip(part, self.encode([w.decode() for w in part]), strict=True))
        for w, both in parts.items():
            memo[w] = sum([memo[p] for p in both])
        return [sum(map(memo.__getitem__, words)) for words in cut]

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, ...]:
        """A word in lower case, without its end of punctuation if a letter or digit stands before that.

        Both are what the tokenizer makes of it first; added tokens stay as they are.
        """
        if b"<|" in word:
            return (word,)
        word = word.lower()
        head = word.rstrip(b".,;:!?")
        return (head, word[len(head) :]) if len(head) < len(word) and head[-1:].isalnum() else (word,)


def normalises(spec: dict) -> bool:
    """Whether the tokenizer itself lower-cases, drops white space between words and cuts words as `Counter.parts` does: by exactly these rules."""
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] and t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    return added and spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER


_held: dict[str, Counter] = {}


def counter(model: str) -> Counter:
    if model not in _held:
        _held[model] = Counter(model)
    return _held[model]


def version(model: str) -> str:
    """Digest of the tokenizer file: a change of it makes every cached count a miss."""
    import hashlib

    with open(model, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def normal(text: Column, by_word: bool) -> Column:
    if not by_word:
        return text
    plain = F.translate(F.regexp_replace(text, f"[{SPACE}]+", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(text, F.lit("<|")), text).otherwise(plain)


def _counted(batches: Iterator[pa.RecordBatch], model: str, name: str) -> Iterator[pa.RecordBatch]:
    c = counter(model or _path(MODEL))
    for b in batches:
        texts = b.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([name] * len(texts), pa.string()), pa.array(c.count(texts), pa.int64())], names=["digest", "version", "n_tokens"])


def cached(spark: SparkSession, cache: str, name: str) -> DataFrame:
    """digest, n_tokens that the cache holds for a tokenizer version; empty if there is no cache yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={name}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(_CACHE).parquet(path.toString()) if there else spark.createDataFrame([], _CACHE)
    # two runs at once may append the same digest; their counts agree
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def missing(docs: DataFrame, misses: DataFrame, hits: bool) -> DataFrame:
    """digest, text of one text for each of ``misses`` (mark, size, digest); of ``docs`` (text, mark, size) only possible misses move."""
    if hits:
        docs = docs.join(F.broadcast(bitmap(misses.select("mark")))).where(may_be(F.col("mark"))).drop("_map")
    one = docs.groupBy("mark", "size").agg(F.first("text").alias("text"))
    return one.join(misses.select("mark", "size", "digest").hint("shuffle_hash"), ["mark", "size"]).select("digest", "text")


def token_counts(docs: DataFrame, cache: str | None = None, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Count the tokens of every whole text of ``docs`` (doc_id, text).

    Counts are those of the tokenizers library without added special tokens, truncation or padding.
    ``cache`` is the folder of the digest cache, new in the shared folder if not given; misses are
    appended to it before this returns. Returns doc_id, n_bytes, n_tokens, over_limit (more than
    ``limit`` tokens) and digest for each row. Null texts count as empty, of 0 tokens; null or
    repeated ids and rows do not matter; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    local = model or _path(MODEL)
    name = version(local)
    by_word = counter(local).by_word
    cache = cache or shared_path(spark, "token-cache")
    # two hashes and the length tell texts apart where the digest tells normal forms apart
    size = F.octet_length("text").cast("long") * (1 << 32) + F.crc32(F.col("text").cast("binary"))
    seen = docs.select("doc_id", text_of().alias("text"))
    digest = F.sha2(normal(F.col("text"), by_word).cast("binary"), 256)
    with Scratch(spark) as scratch, session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}):
        rows = scratch.kept(seen.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest"), F.xxhash64("text").alias("mark"), size.alias("size")))
        known = cached(spark, cache, name)
        one = scratch.kept(rows.groupBy("digest").agg(F.min(F.struct("mark", "size")).alias("m"), F.count("*").alias("rows")).select("digest", "m.mark", "m.size", "rows"))
        misses = scratch.kept(one.join(known, "digest", "left_anti"))
        if not misses.isEmpty():
            texts = seen.select("text", F.xxhash64("text").alias("mark"), size.alias("size"))
            missing(texts, misses, not known.isEmpty()).mapInArrow(lambda it: _counted(it, model, name), _CACHE).write.mode("append").parquet(f"{cache}/version={name}")
        counts = scratch.kept(one.select("digest", "rows").join(cached(spark, cache, name), "digest"))
        total = rows.count()
        out = by_size(rows, counts, ["digest"], "rows", total).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
        return scratch.stored(out, "token-counts", stays=True)
