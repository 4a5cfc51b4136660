"""Language identification by compression.

Each language has a raw-content dictionary for zstandard: slices of a bounded sample of its labelled texts.
A text is encoded with each dictionary in turn, chunk by chunk, so that the dictionary counts for all of a
long text; the language whose dictionary gives the fewest bytes is the one named. A margin between the
best and the second best that is narrow, in bytes or as a share, is no decision: the row says so.

Texts are reduced to lower-case letters with their marks, and single spaces, first: digits, signs and
addresses have no language. The sample is of the texts with the least hashes, found by a threshold
from the languages' counts, so that nothing but it is ever ordered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ARROW_BYTES, ARROW_ROWS, Scratch, crc32_mod, session_conf, text_of

#: One in this many documents, by the CRC-32 of its id, is held out.
HELD_OUT_MOD = 5
#: Bytes of a dictionary, characters that a text gives to it at most, texts of a language that are looked at.
DICT_BYTES, SLICE, SAMPLE = 1 << 16, 512, 1024
#: More languages than this are refused: their dictionaries go to all workers.
MAX_LANGUAGES = 256
#: Bytes that are encoded at a time.
CHUNK = 1 << 14
LEVEL, MIN_MATCH = 5, 3
#: Bytes that make one language e times as likely as another.
SCALE = 2.0
#: A decision has a margin of so many bytes, and of this share of the best size.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.005
UNKNOWN = "und"


def letters(c: Column) -> Column:
    """Lower-case words of letters and marks, joined by single spaces."""
    return F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{M}]+", " ")))


class Classifier:
    """Dictionaries by language, the language with the most learned documents first."""

    def __init__(self, texts: list[tuple[str, bytes]], chunk: int = CHUNK):
        self.texts, self.chunk = texts, chunk
        self._encoders: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return {"texts": self.texts, "chunk": self.chunk, "_encoders": None}

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        if self._encoders is None:
            self._encoders = [
                zstandard.ZstdCompressor(
                    dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                    compression_params=zstandard.ZstdCompressionParameters.from_level(
                        LEVEL, min_match=MIN_MATCH, dict_size=len(raw), format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                        write_content_size=0, write_checksum=0, write_dict_id=0,
                    ),
                )
                for _, raw in self.texts
            ]
        return self._encoders

    def sizes(self, text: bytes) -> list[int]:
        """Bytes that the text takes with each dictionary."""
        cuts = [text[a : a + self.chunk] for a in range(0, len(text), self.chunk)]
        return [sum(len(e.compress(x)) for x in cuts) for e in self.encoders()]

    def name(self, text: str | None) -> tuple[str, float, int | None, bool]:
        """Language, score, margin in bytes (null where there is no other language) and whether it is a decision."""
        if not text or not self.texts:
            return UNKNOWN, 0.0, None, False
        sizes = self.sizes(text.encode())
        least = min(sizes)
        rest = sorted(sizes)[1:]
        score = 1.0 / sum(math.exp((least - s) / SCALE) for s in sizes)
        margin = rest[0] - least if rest else None
        sure = margin is None or (margin >= MARGIN_BYTES and margin >= MARGIN_SHARE * least)
        return self.texts[sizes.index(least)][0], score, margin, sure


def sampled(docs: DataFrame) -> DataFrame:
    """lang, n (labelled documents of the language), h, piece: what dictionaries are made of."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_mod("doc_id", HELD_OUT_MOD) != 0))
    counts = docs.where(F.col("lang").isNotNull() & (crc32_mod("doc_id", HELD_OUT_MOD) != 0)).groupBy("lang").agg(F.count("*").alias("n"))
    found = counts.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = docs.sparkSession.createDataFrame([tuple(r) for r in found], counts.schema)  # MAX_LANGUAGES rows at most
    h = F.xxhash64("text")
    rows = rows.select("lang", "text", h.alias("h")).join(F.broadcast(counts), "lang")
    # four times as many as wanted are expected below the threshold; repeated texts count once
    rows = rows.where(F.shiftrightunsigned("h", 1) / float(1 << 63) * F.col("n") < 4.0 * SAMPLE).dropDuplicates(["lang", "h"])
    rows = rows.withColumn("_t", letters(F.col("text"))).where(F.length("_t") > 0)
    start = F.pmod("h", F.greatest(F.lit(1), F.length("_t") - SLICE + 1)).cast("int") + 1
    rows = rows.select("lang", "n", "h", F.substring("_t", start, F.lit(SLICE)).alias("piece"))
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy("lang").orderBy("h", "piece"))).where(F.col("_rn") <= SAMPLE).drop("_rn")


def learn(docs: DataFrame) -> Classifier:
    """Dictionaries from the sample: ``DICT_BYTES`` a language, ``MAX_LANGUAGES`` languages at most."""
    made: dict[str, tuple[int, bytearray]] = {}
    for r in sorted(sampled(docs).collect(), key=lambda r: (r["lang"], r["h"], r["piece"])):
        raw = made.setdefault(r["lang"], (r["n"], bytearray()))[1]
        if len(raw) < DICT_BYTES:
            raw += r["piece"].encode()[: DICT_BYTES - len(raw) - 1] + b" "
    return Classifier([(lang, bytes(raw)) for lang, (n, raw) in sorted(made.items(), key=lambda x: (-x[1][0], x[0]))])


def identify(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Name the language of every whole text of ``docs`` (doc_id, text, lang); learns from ``lang`` where no model is given.

    Learned is from rows with a text, a lang and an id whose crc32 mod 5 is not 0, never from others, and
    a row's own lang, source and id are no input of its answer. Returns doc_id, held_out, lang_pred, score
    (0 to 1: the best language's share of exp(-bytes / SCALE)), margin (bytes to the second best), decided
    (false where the margin is narrow). Null and letterless texts, and all texts where nothing could be
    learned from, have ``und``, score 0, no margin and no decision. Ties go to the language with more
    learned documents, then to the smaller name. Rows stand for themselves, so null or repeated ids do not
    matter (null ids are not held out); other columns are not read; an empty table gives no rows. Runs its jobs
    when called; the result is a table in the shared folder.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch, session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}):
        made = spark.sparkContext.broadcast(model or learn(docs))

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = made.value
            for b in batches:
                got = [own.name(t) for t in b.column("_t").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.bool_())],
                    names=["doc_id", "held_out", "lang_pred", "score", "margin", "decided"],
                )

        held = F.coalesce(crc32_mod("doc_id", HELD_OUT_MOD) == 0, F.lit(False))
        has = text_of().rlike(r"\p{L}")
        rows = docs.select("doc_id", held.alias("held_out"), F.when(has, letters(F.col("text"))).alias("_t"))
        out = rows.mapInArrow(named, "doc_id long, held_out boolean, lang_pred string, score double, margin long, decided boolean")
        return scratch.stored(out, "language", stays=True)
