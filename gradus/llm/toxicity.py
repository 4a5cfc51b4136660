"""Toxicity by maximum-scoring segments of token log-odds.

A word's evidence is the log-odds of toxic to other labelled documents that hold it, with a
Dirichlet prior whose mean is the evidence of the word's own prefix (and a prefix's prior that of
all documents), drawn towards zero by ``Z`` standard deviations: above it for toxic words, below it
for words of clean texts; a word that was never seen has its longest known prefix's evidence. Every
word without evidence for toxicity costs a small drift besides. A linear-time scan over these signed
scores finds all maximal-scoring segments of a text. The sum statistics of extreme-value theory turn the segments
into an expected number of equally good finds in clean text of that length, with the rate of
chance segments measured on labelled clean documents that took no part in the weights.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, small_batches

HELD_OUT_MOD = 5
#: Most labelled rows that the weights are learned from, by hash order of their ids.
MAX_LABELLED = 50_000
PREFIXES = (4, 6)
PRIOR, Z, LEAST_COUNT, LEAST_CLEAN, PURE, WEAK = 2.0, 1.0, 3, 10, 0.5, 1.0
#: Least drift, and drift over the mean evidence of a word of clean text: chance finds must not chain.
DRIFT, DRIFT_TIMES = 0.05, 4.0
#: Expected chance finds at which the score is one half; least chance finds a text is credited with.
LEVEL, FLOOR = 0.01, 0.5
MEMO = 500_000
#: Words over which a repeat of a word is damped: each one nearer than this before it halves its evidence.
NEAR = 100
_WORD = re.compile(r"[^\W\d_]+")


def units(word: str) -> list[str]:
    """A word's units from the coarsest: its prefixes that are shorter than it, marked, and itself."""
    return [f"{word[:k]}*" for k in PREFIXES if len(word) > k] + [word]


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, after last, score): ``scores`` at ``places``, -drift elsewhere.

    Each candidate keeps the next one to its left with a smaller left sum, so the search is linear.
    """
    total, last, found = 0.0, -1, []
    for p, s in zip(places, scores, strict=True):
        total -= drift * (p - last - 1)
        start, left = p, total
        total += s
        last = p
        while s > 0:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, p + 1, left, total, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def expected(scores: list[float], n: int, rate: float) -> float:
    """Expected number of equally good groups of segments in a clean text of ``n`` words; 1 at most."""
    if not scores:
        return 1.0
    chance = math.log(max(rate * n, FLOOR))
    best, total = 1.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        x = s - chance
        if r > 1 and x <= 0:
            break
        total += x
        # e^-T T^(r-1) / (r! (r-1)!), halved confidence for each further segment
        logp = -total + (r - 1) * math.log(max(total, 1.0)) - math.lgamma(r + 1) - math.lgamma(r) + (r - 1) * math.log(2)
        best = min(best, math.exp(min(0.0, logp)))
    return best


def damped(words: list[str], places: list[int], evidence: list[float]) -> list[float]:
    """Scores of ``places``: evidence is learned from documents that hold a word, so near repeats tell less.

    A word's evidence is halved for each occurrence in the chain of repeats, each at most ``NEAR`` words
    after the one before, that leads to it; further on it counts in full again.
    """
    last: dict[str, tuple[int, float]] = {}
    out = []
    for i in places:
        w = words[i]
        at, share = last.get(w, (-NEAR - 1, 1.0))
        share = share / 2 if i - at <= NEAR else 1.0
        last[w] = i, share
        out.append(share * evidence[i])
    return out


def apart(words: list[str], own: dict[int, float], found: list[tuple[int, int, float]]) -> list[float]:
    """Scores of segments as evidence beside each other, best first.

    Segments of the same words are not independent finds: what a word adds to a segment is halved
    for every better segment that has it.
    """
    best = sorted(found, key=lambda x: (-x[2], x[0]))
    if len(best) < 2:
        return [s for *_, s in best]
    seen: Counter[str] = Counter()
    out, at = [], sorted(own)
    for a, b, score in best:
        inside = at[bisect_left(at, a) : bisect_left(at, b)]
        fresh = score - sum(own[i] * (1 - 0.5 ** seen[words[i]]) for i in inside)
        seen.update({words[i] for i in inside})
        if fresh > 0:
            out.append(fresh)
    return out


class Model:
    """Evidence of units (bounded by the labelled sample) and the rate of chance segments."""

    def __init__(self, evidence: dict[str, float], rate: float = 0.0, drift: float = DRIFT):
        self.evidence, self.rate, self.drift, self.memo = evidence, rate, drift, {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def weight(self, word: str) -> float:
        for u in reversed(units(word)):
            if (e := self.evidence.get(u)) is not None:
                return e
        return 0.0

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]], list[float]]:
        """Number of words, the segments, and their scores as `apart` counts them."""
        words = _WORD.findall(text.lower()) if text else []
        memo = self.memo
        got = list(map(memo.get, words))
        if None in got:
            if len(memo) > MEMO:
                memo.clear()
            for w in set(words).difference(memo):
                memo[w] = self.weight(w)
            got = list(map(memo.__getitem__, words))
        toxic = [i for i, s in enumerate(got) if s > 0]
        if not toxic:
            return len(words), [], []
        own = dict(zip(toxic, damped(words, toxic, got), strict=True))
        places = [i for i, s in enumerate(got) if s]
        found = segments(places, [own[i] if i in own else got[i] - self.drift for i in places], self.drift)
        return len(words), found, apart(words, own, found)

    def score(self, text: str | None) -> float:
        n, _, scores = self.scan(text)
        return LEVEL / (LEVEL + expected(scores, n, self.rate))


def evidence(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Signed log-odds of units, drawn towards zero, from (unit, toxic documents, clean documents with it).

    Toxic ones count from ``WEAK`` on, of prefixes only those that toxic documents have for the most part.
    """
    base = (toxic + 0.5) / (toxic + clean + 1)
    prior = math.log(base / (1 - base))
    rates, out = {}, {}
    for unit, n1, n0 in sorted(counts, key=lambda c: (not c[0].endswith("*"), len(c[0]))):
        word = unit.rstrip("*")
        mean = next((rates[f"{word[:k]}*"] for k in reversed(PREFIXES) if len(word) > k and f"{word[:k]}*" in rates), base)
        mean = min(0.9, mean)
        y1, y0 = n1 + PRIOR * mean, n0 + PRIOR * (1 - mean)
        rates[unit] = y1 / (y1 + y0)
        odds, wide = math.log(y1 / y0) - prior, Z * math.sqrt(1 / y1 + 1 / y0)
        if not unit.endswith("*"):
            out[unit] = odds - wide if odds - wide >= WEAK else min(0.0, odds + wide)
        elif odds - wide >= WEAK and rates[unit] >= PURE:
            out[unit] = odds - wide
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of units by class and part, summed over the partition so far."""
    held: dict[tuple[int, int], Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (part, toxic), counter in held.items():
            n = len(counter)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counter), pa.string()), pa.array([part] * n, pa.int32()), pa.array([toxic] * n, pa.int32()), pa.array(list(counter.values()), pa.int64())],
                names=["unit", "part", "toxic", "n"],
            )
        held.clear()

    for b in batches:
        for text, part, toxic in zip(b.column("text").to_pylist(), b.column("part").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            own = {u for w in set(_WORD.findall(text.lower())) for u in units(w)} if text else set()
            own.add("")  # counts the documents
            held.setdefault((part, toxic), Counter()).update(own)
        if sum(map(len, held.values())) > MEMO:
            yield from out()
    yield from out()


def _chance(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Words, words with evidence and their evidence."""
    words, found, total = 0, 0, 0.0
    for b in batches:
        for text in b.column("text").to_pylist():
            every = _WORD.findall(text.lower()) if text else []
            got = list(map(model.weight, every))
            own = damped(every, [i for i, s in enumerate(got) if s > 0], got)
            words, found, total = words + len(every), found + len(own), total + sum(own)
    yield pa.RecordBatch.from_arrays([pa.array([words]), pa.array([found]), pa.array([total])], names=["words", "found", "total"])


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """text, toxic, part of the labelled documents to learn from: a bounded sample of labels, all their texts."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    own = own.where(crc32_mod("doc_id", HELD_OUT_MOD) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most ``limit`` rows of three numbers
    own = F.broadcast(own.withColumn("part", F.expr("cast(pmod(xxhash64(doc_id, 1), 4) = 0 as int)")))
    return docs.select("doc_id", "text").join(own, "doc_id").select("text", "toxic", "part")


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Weights from the labelled sample; the chance rate from the quarter of it that is kept apart first."""
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels, limit)
    c = sample.mapInArrow(_counted, "unit string, part int, toxic int, n long").groupBy("unit").agg(
        *(F.sum(F.when((F.col("part") == p) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{p}{t}") for p in (0, 1) for t in (0, 1))
    )
    # units with little for "toxic" never count; the words below a pure prefix are kept through it.
    # With LEAST_COUNT documents or more, evidence of WEAK asks for more than twice the base odds
    size = {(r["part"], r["toxic"]): r["count"] for r in sample.groupBy("part", "toxic").count().collect()}
    both = {t: size.get((0, t), 0) + size.get((1, t), 0) for t in (0, 1)}
    odds = min((both[1] + 0.5) / (both[0] + 0.5), (size.get((0, 1), 0) + 0.5) / (size.get((0, 0), 0) + 0.5))
    # what is in some clean documents may have evidence against
    some = c.where(f"unit = '' or (unit not like '%*' and n00 + n10 >= {LEAST_CLEAN}) or (n01 + n11 >= {LEAST_COUNT} and n01 + n11 > {min(0.2, 2 * odds)!r}D * (n00 + n10))")
    rows = [(r[0], r["n00"], r["n01"], r["n10"], r["n11"]) for r in some.toLocalIterator()]
    docs_of = next((r for r in rows if not r[0]), ("", 0, 0, 0, 0))
    rows = [r for r in rows if r[0]]
    first = Model(evidence([(u, b, a) for u, a, b, _, _ in rows if b >= LEAST_COUNT or a >= LEAST_CLEAN], docs_of[2], docs_of[1]))
    apart = docs.sparkSession.sparkContext.broadcast(first)
    chance = sample.where("part = 1 and toxic = 0").select("text").mapInArrow(lambda it: _chance(it, apart.value), "words long, found long, total double").agg(F.sum("words"), F.sum("found"), F.sum("total")).first()
    rate = ((chance[1] or 0) + 1) / ((chance[0] or 0) + 1)
    drift = max(DRIFT, DRIFT_TIMES * (chance[2] or 0.0) / ((chance[0] or 0) + 1))
    return Model(evidence([(u, b + d, a + c) for u, a, b, c, d in rows], docs_of[2] + docs_of[4], docs_of[1] + docs_of[3]), rate, drift)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text); learns from ``labels`` (doc_id, toxic).

    Only labels of ids with crc32(id as text) mod 5 other than 0 are learned from. Returns doc_id,
    held_out, score (0 to 1), predicted (score >= 0.5), n_segments and the best segment's word
    range. Null and empty texts have no segment and the least score; null ids are not held out.
    Labels repeated for an id count as toxic if one says so; null labels do not count. Without
    labels every text has the least score. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, limit))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            found = [m.scan(t) for t in b.column("text").to_pylist()]
            best = [max(s, key=lambda x: x[2], default=(None, None, 0)) for _, s, _ in found]
            scores = [LEVEL / (LEVEL + expected(s, n, m.rate)) for n, _, s in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([len(s) for _, s, _ in found], pa.int32()), pa.array([x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_segments", "best_from", "best_to"],
            )

    held = F.coalesce(crc32_mod("doc_id", HELD_OUT_MOD) == 0, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int, n_segments int, best_from long, best_to long")


def without_toxic(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, limit))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.value.score(t) < 0.5 for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
