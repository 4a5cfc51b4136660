"""Phrase collocations by suffix automata.

Texts are cut into pieces and words once and kept as coded blocks, shards of one language with a
vocabulary of their own. A shard's generalised suffix automaton, bounded in depth, is made by sorting: the places
of a shard in the order of their words read backwards are the leaves of its tree of suffix links, so the
substrings that end at the same places (a state) are a run of that order, and the run's length is
their count. States enumerate their substrings with these counts.

A phrase occurs no more often than its parts. So lengths are taken in turn: of each, shards send the hashes and
counts of the phrases whose parts are frequent, sorted and packed, to ranges of hashes that add them up;
hashes that reach the threshold go into a bit table of bounded size, by which the next length is chosen. Phrases
with a colliding hash, or with a full table all, are let through, none is held back. Only phrases that pass are counted as
words, exactly, by Spark over all shards.

Along a suffix link, and likewise along a prefix, counts only grow: a candidate lies in a longer
one that is as frequent if and only if it does in one that is longer by a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ARROW_BYTES, ARROW_ROWS, Scratch, session_conf

#: Least count of a candidate, words of the longest, rows returned for each language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of a block, bytes of text that are cut into words at a time.
BLOCK, CUT = 1 << 20, 1 << 20
#: log2 of the bits of a table: 16 bits an entry, within these.
FEW_BITS, MOST_BITS = 15, 27
#: Phrases whose hashes a task packs together; log2 of the words for each range of hashes.
TOGETHER, RANGE_BITS = 1 << 21, 21
#: Phrases whose counts a task adds up before they move.
HELD = 1 << 20
SALTS = 64
#: Totals of so many languages are broadcast at most.
MOST_LANGUAGES = 4096
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(ord(".") if c in _ENDS else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
_BLOCK = "lang string, n long, words array<binary>, counts array<long>, ids binary, skip int"


class Shard:
    """Coded words of one language; 0 ends a piece."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {b".": 0}
        self.ids: list[np.ndarray] = []
        self.n = self.skip = 0

    def add(self, words: list[bytes]) -> None:
        codes = self.codes
        for w in set(words).difference(codes):
            codes[w] = len(codes)
        self.ids.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
        self.n += len(words)

    def row(self, lang: str) -> pa.RecordBatch:
        x = np.concatenate(self.ids)
        counts = np.bincount(x[self.skip :], minlength=len(self.codes))[1:]
        held = zstandard.ZstdCompressor(level=1).compress(x.tobytes())
        words = [*self.codes][1:]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([held], pa.binary()), pa.array([self.skip], pa.int32())],
            names=["lang", "n", "words", "counts", "ids", "skip"],
        )

    def rest(self, keep: int) -> Shard:
        """A new shard that begins with the last words of the open piece, which it does not count."""
        new, x = Shard(), np.concatenate(self.ids)[-keep:] if keep else np.zeros(0, np.int32)
        x = x[np.flatnonzero(x == 0)[-1] + 1 :] if (x == 0).any() else x
        if len(x):
            names = [*self.codes]
            new.add([names[i] for i in x])
            new.skip = len(x)
        return new


def cuts(text: bytes, size: int) -> Iterator[bytes]:
    """A folded text in parts of about ``size`` bytes that end where a word ends."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            places = [p for p in (text.find(b" ", end), text.find(b".", end)) if p >= 0]
            end = min(places) if places else len(text)
        yield text[at:end]
        at = end


def _blocks(batches: Iterator[pa.RecordBatch], block: int, longest: int) -> Iterator[pa.RecordBatch]:
    shards: dict[str, Shard] = {}
    total = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            raw = text.as_buffer()
            if raw is None or not raw.size:
                continue
            own = shards.get(lang) or shards.setdefault(lang, Shard())
            for part in cuts(raw.to_pybytes().translate(_FOLD), CUT):
                before = own.n
                own.add([w for w in part.replace(b".", b" . ").split(b" ") if w])
                total += own.n - before
                while total > block:
                    most = max(shards, key=lambda k: shards[k].n)
                    if shards[most].n <= longest:
                        break
                    yield shards[most].row(most)
                    total -= shards[most].n
                    if most == lang:
                        own = shards[lang] = own.rest(longest - 1)
                        total += own.n
                    else:
                        del shards[most]
            own.add([b"."])
            total += 1
    for lang, s in shards.items():
        yield s.row(lang)


class States(NamedTuple):
    """States of an automaton: an end of each, lengths of its longest and shortest substring, ends in all, suffix link (-1: none)."""

    end: np.ndarray
    longest: np.ndarray
    shortest: np.ndarray
    endpos: np.ndarray
    link: np.ndarray

    def substrings(self, least: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each length the states that have a substring of it."""
        for n in range(least, most + 1):
            yield n, np.flatnonzero((self.shortest <= n) & (self.longest >= n))


def automaton(x: np.ndarray, depth: int, counted: np.ndarray | None = None) -> States:
    """The generalised suffix automaton of the sequences in ``x`` (0 ends one), substrings of up to ``depth``.

    Places that are not ``counted`` are context alone: nothing that ends there counts.
    """
    at = np.flatnonzero(x if counted is None else (x > 0) & counted)
    bits = max(1, int(x.max(initial=0)).bit_length())
    cols = [x[at].astype(np.uint64)]
    for d in range(1, depth):
        there = (at >= d) & (cols[-1] > 0)
        cols.append(np.where(there, x[np.maximum(at - d, 0)], 0).astype(np.uint64))
    per = 64 // bits
    keys = []
    for a in range(0, depth, per):
        key = np.zeros(len(at), np.uint64)
        for c in cols[a : a + per]:
            key = (key << np.uint64(bits)) | c
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    new[:1] = True
    starts, sizes = [], []
    for c in cols:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(at))
        real = c[first] > 0
        starts.append(first[real])
        sizes.append(size[real])
    # from the longest on: a substring whose ends are those of the longer one shares its state
    state: list[np.ndarray] = [np.zeros(0, int)] * depth
    begin, longest, shortest, endpos, n = [], [], [], [], 0
    for d in range(depth, 0, -1):
        s, size = starts[d - 1], sizes[d - 1]
        own = np.full(len(s), -1)
        if d < depth and len(starts[d]):
            k = np.minimum(np.searchsorted(starts[d], s), len(starts[d]) - 1)
            same = (starts[d][k] == s) & (sizes[d][k] == size)
            own[same] = state[d][k[same]]
        fresh = own < 0
        own[fresh] = np.arange(n, n + fresh.sum())
        n += int(fresh.sum())
        state[d - 1] = own
        begin.append(s[fresh])
        endpos.append(size[fresh])
        longest.append(np.full(fresh.sum(), d))
    begin, longest, endpos = (np.concatenate(a).astype(np.int64) for a in (begin, longest, endpos))
    shortest = longest.copy()
    for d in range(depth, 0, -1):
        shortest[state[d - 1]] = d
    link = np.full(n, -1)
    for d in range(2, depth + 1):
        own = np.flatnonzero(shortest == d)
        link[own] = state[d - 2][np.searchsorted(starts[d - 2], begin[own], "right") - 1]
    return States(at[order][begin] if n else begin, longest, shortest, endpos, link)


class Bits(NamedTuple):
    """A table of bits: a mark that was set is found, one that was not is mostly not."""

    bits: int
    table: bytes

    def has(self, marks: np.ndarray) -> np.ndarray:
        at = marks.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (np.frombuffer(self.table, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def table_of(marks: DataFrame, count: int) -> Bits:
    """The bit table of ``marks`` (mark: long), 2^MOST_BITS bits at most however many there are."""
    bits = min(MOST_BITS, max(FEW_BITS, (16 * max(1, count) - 1).bit_length()))
    at = F.pmod("mark", F.lit(1 << bits)) + 1  # numbers from 1 on fill pieces of 32,768 bits in order
    rows = marks.select(F.bitmap_bucket_number(at).alias("piece"), F.bitmap_bit_position(at).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(1 << (bits - 3))
    for r in rows.toLocalIterator():
        out[(r["piece"] - 1) * 4096 : r["piece"] * 4096] = r["bits"]
    return Bits(bits, bytes(out))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase and the word that follows it from theirs."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Frequent(NamedTuple):
    """What is known of phrases so far: bits of their hashes that count, and a table for each length from 2 on."""

    bits: int
    tables: tuple[Bits, ...]

    def mark(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def passing(self, x: np.ndarray, marks: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each length from 1 on, one more than there are tables, whether the phrase that ends at a place may be frequent; hashes of the longest."""
        own = marks.astype(np.uint64)[x]
        ok, h, every = x > 0, own, []
        for t in self.tables:
            every.append(ok)
            more = ok.copy()
            more[:1] = False
            more[1:] &= ok[:-1]
            h = np.concatenate([h[:1], pair(h[:-1], own[1:])])
            more[more] = t.has(self.mark(h[more]))
            ok = more
        every.append(ok)
        last = ok.copy()
        last[:1] = False
        last[1:] &= ok[:-1]
        every.append(last)
        return every, np.concatenate([h[:1], pair(h[:-1], own[1:])])


def _read(b: pa.RecordBatch, i: int) -> tuple[str, pa.Array, np.ndarray, np.ndarray, int]:
    """Language, words, their hashes (with one for 0), ids and context of a block."""
    marks = np.concatenate([[0], b.column("marks")[i].values.to_numpy(zero_copy_only=False)]).astype(np.int64)
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column("ids")[i].as_py()), np.int32)
    return b.column("lang")[i].as_py(), b.column("words")[i].values, marks, x, b.column("skip")[i].as_py()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Language, words, hashes, ids and the places that count of each block."""
    for b in batches:
        for i in range(b.num_rows):
            lang, names, marks, x, skip = _read(b, i)
            yield lang, names, marks, x, np.arange(len(x)) >= skip


class Joined:
    """Blocks of a language put together, so that a phrase is counted once for all of them."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.marks: list[int] = [0]
        self.x: list[np.ndarray] = []
        self.counted: list[np.ndarray] = []
        self.n = 0

    def add(self, names: pa.Array, marks: np.ndarray, x: np.ndarray, counted: np.ndarray) -> None:
        code = [0]
        for w, m in zip(names.to_pylist(), marks[1:].tolist(), strict=True):
            if w not in self.codes:
                self.codes[w] = len(self.marks)
                self.marks.append(m)
            code.append(self.codes[w])
        self.x += [np.array(code, np.int32)[x], np.zeros(1, np.int32)]
        self.counted += [counted, np.zeros(1, bool)]
        self.n += len(x) + 1

    def whole(self, lang: str) -> tuple[str, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        return lang, pa.array([*self.codes], pa.binary()), np.array(self.marks, np.int64), np.concatenate(self.x), np.concatenate(self.counted)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """`_each`, blocks of a language joined to about ``BLOCK`` words."""
    held: dict[str, Joined] = {}
    for lang, *block in _each(batches):
        held.setdefault(lang, Joined()).add(*block)
        while sum(j.n for j in held.values()) > BLOCK:
            most = max(held, key=lambda k: held[k].n)
            yield held.pop(most).whole(most)
    for lang, j in held.items():
        yield j.whole(lang)


def _known(x: np.ndarray, marks: np.ndarray, words: Bits | None) -> np.ndarray:
    if words is None:
        return x
    ok = words.has(marks)
    ok[0] = False
    return np.where(ok[x], x, 0)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit keys as differences, and counts, in planes of bytes."""
    both = np.concatenate([np.diff(keys, prepend=np.uint32(0)), counts]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(both.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    n = len(both) // 2
    return np.cumsum(both[:n], dtype=np.uint64), both[n:].astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _sketched(batches: Iterator[pa.RecordBatch], words: Bits | None, known: Frequent) -> Iterator[pa.RecordBatch]:
    """Packed hashes and counts of the phrases of the next length, by ranges of hashes; several blocks together."""
    keys, counts = [], []

    def out() -> Iterator[pa.RecordBatch]:
        k, n = summed(np.concatenate(keys), np.concatenate(counts))
        keys.clear(), counts.clear()
        if not len(k):
            return
        part = (k >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, e in zip(at, [*at[1:], len(part)], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int64()), pa.array([pack((k[a:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32), n[a:e])], pa.binary())], names=["part", "data"])

    length = len(known.tables) + 2
    for _, _, marks, x, counted in _together(batches) if words is None else _each(batches):
        x = _known(x, marks, words)
        ok, h = known.passing(x, marks)
        s = automaton(x, length, counted)
        end, n = next((s.end[own], s.endpos[own]) for _, own in s.substrings(length, length))
        new = ok[-1][end]
        keys.append(known.mark(h[end[new]]))
        counts.append(n[new])
        if sum(map(len, keys)) > TOGETHER:
            yield from out()
    if keys:
        yield from out()


def _reached(least: int):
    def run(group: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in group.column("data").to_pylist()]
        keys, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        part = group.column("part")[0].as_py() << 32
        return pa.table({"mark": pa.array((keys[counts >= least].astype(np.int64) | part), pa.int64())})

    return run


def _cut(batches: Iterator[pa.RecordBatch], words: Bits, known: Frequent) -> Iterator[pa.RecordBatch]:
    """Blocks of nothing but runs of frequent pairs, with the words that are in them."""
    for b in batches:
        for i in range(b.num_rows):
            lang, names, marks, x, skip = _read(b, i)
            x = _known(x, marks, words)
            x, skip = runs(x, known.passing(x, marks)[0][1][1:], skip)
            used = np.unique(x[x > 0])
            if len(used):
                code = np.zeros(len(marks), np.int32)
                code[used] = np.arange(1, len(used) + 1)
                held = zstandard.ZstdCompressor(level=1).compress(code[x].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([names.take(pa.array(used - 1)).to_pylist()], pa.list_(pa.binary())), pa.array([marks[used]], pa.list_(pa.int64())), pa.array([held], pa.binary()), pa.array([skip], pa.int32())],
                    names=["lang", "words", "marks", "ids", "skip"],
                )


def _exact(batches: Iterator[pa.RecordBatch], known: Frequent, longest: int) -> Iterator[pa.RecordBatch]:
    """Phrases that may be frequent with their counts, added up over the blocks of a task as far as they fit."""
    held: list[pa.RecordBatch] = []
    for batch in _found(batches, known, longest):
        held.append(batch)
        if sum(map(len, held)) > HELD:
            held = pa.Table.from_batches(held).group_by(["lang", "phrase", "words"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "words", "n"]).combine_chunks().to_batches()
            if sum(map(len, held)) > HELD // 2:
                yield from held
                held = []
    if held:
        yield from pa.Table.from_batches(held).group_by(["lang", "phrase", "words"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "words", "n"]).to_batches()


def _found(batches: Iterator[pa.RecordBatch], known: Frequent, longest: int) -> Iterator[pa.RecordBatch]:
    """Phrases that may be frequent with their counts in each block."""
    for lang, names, marks, x, counted in _together(batches):
        ok, _ = known.passing(x, marks)
        s = automaton(x, longest, counted)
        for n, own in s.substrings(2, longest):
            own = own[ok[n - 1][s.end[own]]] if n <= len(ok) else own[:0]
            for a in range(0, len(own), 1 << 16):
                part = own[a : a + (1 << 16)]
                said = pc.binary_join_element_wise(*(names.take(pa.array(x[s.end[part] - k] - 1)) for k in range(n - 1, -1, -1)), b" ")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), said.cast(pa.binary()), pa.array(np.full(len(part), n, np.int32)), pa.array(s.endpos[part], pa.int64())], names=["lang", "phrase", "words", "n"])


def runs(x: np.ndarray, ok: np.ndarray, skip: int) -> tuple[np.ndarray, int]:
    """``x`` cut where two neighbours are not ``ok``, without places that have no neighbour left; context stays context."""
    ok = ok & (x[:-1] > 0) & (x[1:] > 0)
    left, right = np.concatenate([[False], ok]), np.concatenate([ok, [False]])
    keep = left | right
    ends = keep & ~right  # a break follows where a run ends
    takes = keep.astype(np.int64) + ends
    place = np.cumsum(takes) - takes
    out = np.zeros(int(takes.sum()), np.int32)
    out[place[keep]] = x[keep]
    return out, int(place[skip]) if skip < len(x) else len(out)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language of ``docs`` (doc_id, text, lang), by their weakest cut.

    Returns lang, rank, phrase, a, l, r, n, score: counts of the phrase, of the two parts of its lowest-scoring
    cut and of all words of the language, and floor(1000 a n / (l r)). Phrases that occur less than ``least`` times, or
    lie in a longer candidate that is as frequent, are left out. A null lang is ``und``, a null text
    empty; repeated rows count each time; ids and other columns are not read. Equal scores go by count, then by
    the phrase's bytes. An empty table, or one without frequent phrases, gives no rows. Runs its
    jobs when called; the result is a table in the shared folder.
    """
    if least < 1 or longest < 2:
        raise ValueError("least must be 1 or more, longest 2 or more")
    spark = docs.sparkSession
    arrow = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}
    with Scratch(spark) as scratch, session_conf(spark, arrow):
        texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
        coded = scratch.stored(texts.mapInArrow(lambda it: _blocks(it, block, longest), _BLOCK), "blocks")
        of_word = F.xxhash64("lang", "phrase")
        each = coded.select("lang", F.inline(F.arrays_zip("words", "counts")).alias("phrase", "n")).select("lang", F.col("phrase").cast("string").alias("phrase"), "n")
        words = scratch.stored(_frequent(each, least).withColumn("words", F.lit(1)), "words")
        marked = coded.select("lang", "words", F.transform("words", lambda w: F.xxhash64("lang", w.cast("string"))).alias("marks"), "ids", "skip")
        first = spark.sparkContext.broadcast(table_of(words.select(of_word.alias("mark")), words.count()))
        total = coded.agg(F.sum("n")).first()[0] or 0
        known = Frequent(32 + min(24, max(6, (total >> RANGE_BITS).bit_length())), ())
        every = words
        for length in range(2, max(3, longest)):
            source, table = (marked, first.value) if length == 2 else (short, None)
            reached = scratch.stored(_of_length(source, table, known, least), "reached")
            count = reached.count()
            if not count:
                break
            known = Frequent(known.bits, (*known.tables, table_of(reached, count)))
            if length == 2:
                held = spark.sparkContext.broadcast(known)
                short = scratch.stored(marked.mapInArrow(lambda it: _cut(it, first.value, held.value), "lang string, words array<binary>, marks array<long>, ids binary, skip int"), "runs")
        if known.tables:
            found = spark.sparkContext.broadcast(known)
            exact = short.mapInArrow(lambda it: _exact(it, found.value, longest), "lang string, phrase binary, words int, n long")
            exact = exact.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
            every = words.unionByName(scratch.stored(exact.select("lang", F.col("phrase").cast("string").alias("phrase"), "f", "words"), "phrases"))
        sizes = coded.groupBy("lang").agg(F.sum("n").alias("n"))
        few = sizes.limit(MOST_LANGUAGES + 1).collect()
        if len(few) <= MOST_LANGUAGES:  # else joined as it is
            sizes = F.broadcast(spark.createDataFrame([tuple(r) for r in few], "lang string, n long"))
        return scratch.stored(_ranked(every, sizes, top), "collocations", stays=True)


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _of_length(blocks: DataFrame, words: Bits | None, known: Frequent, least: int) -> DataFrame:
    """mark: hashes of the next length that reach ``least`` in all blocks together."""
    sent = blocks.sparkSession.sparkContext.broadcast((words, known))  # tables of 2^MOST_BITS bits at most
    return blocks.mapInArrow(lambda it: _sketched(it, *sent.value), "part long, data binary").groupBy("part").applyInArrow(_reached(least), "mark long")


def _ranked(every: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """Candidates of all frequent phrases (lang, phrase, f, words), scored, without the subsumed ones, best first."""
    long = F.col("words") > 1
    # parts that lack a word at one end: as frequent as the whole, they are no candidates
    ends = F.array(F.expr("substr(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', words - 1)"))
    inside = every.where("words > 2").select("lang", F.explode(ends).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    open_ = every.where(long).join(inside, ["lang", "phrase", "f"], "left_anti")
    cut = open_.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substr(phrase, length(left) + 2)"))
    parts = every.select("lang", "phrase", "f")
    cut = cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cut = cut.join(sizes, "lang")
    exact = lambda c: c.cast("decimal(19,0)")
    score = F.call_function("div", exact(F.col("a") * 1000) * exact(F.col("n")), exact(F.col("l")) * exact(F.col("r")))
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each salt first, so that no task holds all candidates of a language
    few = best.withColumn("_rn", F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order))).where(F.col("_rn") <= top).drop("_rn")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
