"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words, then one end. Each token is a string of binary decisions: whether
it repeats what followed the same two words earlier in the text, else the class of its count, then
bits of its hash until it is one word of its class. Words that training lacks are one class of their
own, as in the unigram base; for the bits per byte their spelling is added. Each decision is predicted
by several contexts: none, the classes of the two words before, the word before, the two words before.
Their counts come from all training texts (a training text is scored by what the others hold: its own
event, and words that only it has once, are left out). The predictions meet in the logistic domain by weights that a
gate selects and that learn from every decision; a gain that learns too refines the result. The sum of
all is the log probability, per byte the bits per byte.

A gate is a place in a token's string together with what its contexts know, so no two decisions of a
token share weights: updating them after each decision, and after each token, are the same. That lets
all texts of a block go through one numpy loop, a lane each, from the first token of a text to its
last. A score depends on its text and the model alone.

Texts are cut into blocks, one row each; words (lm_tokens) and contexts (lm_contexts) are added up by
ranges of hashes and sent back to the blocks that asked. Only tables of fixed size are sent to all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lm_contexts as contexts
from . import lm_tokens as tokens
from .common import ARROW_ROWS, Scratch, crc32_mod, session_conf, small_batches
from .lm_contexts import CLASSES, ORDERS, PAIRS, RUNS, SHORT, Text
from .lm_tokens import CELL_BITS, CLASS_BITS, DEPTH, SCALE, STRING_BITS, TOP, stretched, unpack

HELD_MOD, HELD_REST = 7, 2
#: Predictors: none, classes before, word before, two words before.
INPUTS = 2 + len(ORDERS)
#: Gates besides the place in the string: nothing known, the word before, two words before, a repeat is possible.
GATES = 4
RATE, REFINE_RATE = 0.03, 0.02
#: First weights of each gate's inputs.
START = np.array([[0.7, 0.5, 0.0, 0.0], [0.55, 0.3, 0.5, 0.0], [0.35, 0.15, 0.5, 0.8], [0.4, 0.2, 0.4, 0.5]], np.float32)
#: Bytes from which texts are put into blocks by their length.
LONG = 12 << 10
#: Tokens whose predictions are held at once.
CHUNK = 1 << 15
#: Parts in which contexts are answered and blocks are scored, so that of what is dealt out only one part is on the disks twice;
#: blocks that a part has at least.
PARTS, LEAST_BLOCKS = 8, 16
#: Parts in which contexts are answered: what they ask takes less room than what is answered.
ASK_PARTS = 4


class Spelling:
    """Byte probabilities after two bytes for pairs of training, else after one; a space ends a word."""

    def __init__(self, pairs: np.ndarray, after: np.ndarray, one: np.ndarray):
        p1 = (one + 0.5) / (one.sum(1, keepdims=True) + 128)
        self.slot = np.full(1 << 16, -1)
        self.slot[pairs] = np.arange(len(pairs))
        p2 = (after + 4 * p1[pairs & 255]) / (after.sum(1, keepdims=True) + 4)
        self.log1, self.log2 = np.log10(p1).astype(np.float32), np.log10(p2).astype(np.float32)

    def score(self, spelled: np.ndarray, length: np.ndarray) -> np.ndarray:
        code = tokens.trigrams(spelled, length)
        slot = self.slot[code >> 8]
        value = np.where(slot >= 0, self.log2[slot, code & 255] if len(self.log2) else 0, self.log1[code >> 8 & 255, code & 255])
        return np.add.reduceat(value.astype(np.float64), np.cumsum(length + 1) - length - 1) if len(length) else np.zeros(0)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for codes, times in zip(b.column("codes").to_pylist(), b.column("times").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(codes, np.int32)), pa.array(unpack(times, np.int64))], names=["code", "n"])


def spelling(blocks: DataFrame) -> Spelling:
    """From the byte triples of training words, a table of fixed size (2^24 at most)."""
    counts = blocks.select("codes", "times").mapInArrow(_codes, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = counts.column("code").to_numpy(), counts.column("n").to_numpy()
    pairs = np.unique(code >> 8)
    one, after = np.zeros((256, 256)), np.zeros((len(pairs), 256), np.float32)
    np.add.at(one, (code >> 8 & 255, code & 255), n)
    after[np.searchsorted(pairs, code >> 8), code & 255] = n
    return Spelling(pairs, after, one)


# ---------------------------------------------------------------- mixing


def mixed(table: np.ndarray, index: np.ndarray, flags: np.ndarray, can: np.ndarray, gate: np.ndarray, count: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the probability that the mixer gives each token's decisions, of which there are ``count``.

    Texts are the runs of ``sizes`` (falling) tokens from ``start``. ``index`` (inputs, tokens) names the rows of
    ``table`` that hold the inputs' opinions of what each decision turned out to be, 0 where there is
    none; ``flags`` (inputs, tokens) are those of the first decision of tokens that ``can`` repeat.
    With that orientation a decision's error is one less its probability. Weights and gains climb
    its logarithm. Weights count steps of opinions, so they are ``SCALE`` times smaller than those of whole units.
    """
    lanes = len(sizes)
    sets = lanes * GATES
    weights = np.empty((sets, INPUTS, DEPTH), np.float32)
    used = count - can  # decisions after the first
    exists = (np.arange(DEPTH)[None, :] <= np.arange(DEPTH)[:, None]).astype(np.float32)
    for g in range(GATES):
        weights[g::GATES] = START[g][:, None] / SCALE
    gains = np.ones((sets, DEPTH), np.float32)
    # rows move as one item
    item, small = np.dtype((np.void, 4 * DEPTH)), np.dtype((np.void, DEPTH))
    w_rows, g_rows, source = weights.view(item).reshape(-1), gains.view(item).reshape(-1), table.view(small).reshape(-1)
    out = np.empty(int(sizes.sum()))
    active = lanes - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if lanes else 0), "right")
    ends = np.cumsum(active)
    one, rate, refine, least = np.float32(1), np.float32(RATE / SCALE**2), np.float32(REFINE_RATE / RATE * SCALE**2), np.float32(0.3)
    room, told, s0 = np.empty((INPUTS * min(max(CHUNK, lanes), len(out)), DEPTH), np.float32), [], 0
    while s0 < len(active):
        base = int(ends[s0] - active[s0])
        s1 = max(s0 + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        wide = active[s0:s1]
        total = int(wide.sum())
        cuts = np.cumsum(wide) - wide
        lane = np.arange(total) - np.repeat(cuts, wide)
        i = start[lane] + np.repeat(np.arange(s0, s1), wide)
        own = lane * GATES + gate[i]
        # step by step, input by input, lane by lane
        place = np.repeat((INPUTS - 1) * cuts, wide) + np.arange(total)
        step = np.repeat(wide, wide)
        pick, rows = np.empty(INPUTS * total, np.int64), np.empty(INPUTS * total, np.int64)
        some = np.flatnonzero(can[i])
        for k in range(INPUTS):
            pick[place] = index[k, i]
            rows[place] = own * INPUTS + k
            if k < len(flags):
                told.append((place[some], flags[k, i[some]]))
            place += step
        x = room[: INPUTS * total]
        x[:] = source.take(pick).view(np.int8).reshape(-1, DEPTH)
        while told:
            at, said = told.pop()
            x[at, 0] = said
        q, there = np.empty((total, DEPTH), np.float32), (exists * rate)[used[i]]
        for lo, n in zip(cuts.tolist(), wide.tolist(), strict=True):
            hi = lo + n
            at, xs, gain = rows[INPUTS * lo : INPUTS * hi], x[INPUTS * lo : INPUTS * hi].reshape(INPUTS, n, DEPTH), own[lo:hi]
            w = w_rows.take(at).view(np.float32).reshape(INPUTS, n, DEPTH)
            dot = np.add.reduce(w * xs, axis=0)
            sure = g_rows.take(gain).view(np.float32).reshape(n, DEPTH)
            e = np.exp(np.multiply(dot, sure, out=q[lo:hi]))
            e += one
            np.divide(there[lo:hi], e, out=e)
            np.multiply(xs, e * sure, out=xs)
            w += xs
            w_rows[at] = w.reshape(-1).view(item)
            e *= dot
            e *= refine
            sure += e
            np.maximum(sure, least, out=sure)
            g_rows[gain] = sure.reshape(-1).view(item)
        # decisions that are not there come out as one half
        q *= (-exists)[used[i]]
        np.exp(q, out=q)
        q += one
        p = np.divide(np.float32(2), q, out=q)
        out[i] = np.log10(np.multiply.reduce(p, axis=1, dtype=np.float64)) - count[i] * np.log10(2)
        s0 = s1
    return out


class Model:
    """The tables of fixed size: opinions without context, by the classes before, about repeats."""

    def __init__(self, top: np.ndarray, stats: np.ndarray, keep: int, range_bits: int):
        self.distinct, top = int(top[0]), top[1:].reshape(CLASSES, 1 << TOP)
        self.total, self.keep, self.range_bits = int(top.sum()), keep, range_bits
        short, flags = stats[: PAIRS << SHORT].reshape(PAIRS, 1 << SHORT), stats[PAIRS << SHORT :].reshape(RUNS, CLASSES, 2)
        self.short, self.top = _tree(short), _tree(top)
        self.classes = _tree(short.sum(0).reshape(1, CLASSES, -1).sum(2))[0]
        self.flag_pair = stretched(flags, flags[..., ::-1])
        run = flags.sum(1)
        self.flag = stretched(run, run[..., ::-1])

    def wide(self, out: np.ndarray) -> None:
        """Opinions by the classes before as rows of all decisions."""
        out[:, 1 : 1 + SHORT] = self.short.reshape(-1, SHORT)
        out.reshape(PAIRS, 1 << SHORT, DEPTH)[:, : 1 << SHORT - CLASS_BITS, 1 + CLASS_BITS :] = 0  # unknown words have no cells

    def words(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Opinions without context of each word's string, and how many decisions it has; last two for unknown words and repeats."""
        place, c = unpack(row["places"], np.uint64), unpack(row["counts"], np.int64)
        cls, depth = tokens.class_of(c), unpack(row["depth"], np.uint8).astype(np.int64)
        plain = np.zeros((len(c) + 2, DEPTH), np.int8)
        plain[:-2, 1 : 1 + CLASS_BITS] = self.classes[cls]
        plain[-2, 1 : 1 + CLASS_BITS] = self.classes[0]
        plain[:-2, 1 + CLASS_BITS : 1 + CLASS_BITS + TOP] = self.top[cls, tokens.cell_of(place) >> CELL_BITS - TOP]
        plain[:-2, 1 + CLASS_BITS + TOP :] = unpack(row["deep"], np.int8).reshape(len(c), -1)
        used = np.concatenate((CLASS_BITS + np.where(cls > 0, depth, 0), [CLASS_BITS, 0]))
        return plain, used

    def score(self, row: dict) -> dict[str, np.ndarray]:
        """Per text of a block: tokens, known tokens, base score, model score, log10 of spelling, bytes."""
        t = Text(row, self.keep)
        n = len(t.sizes)
        plain, used = self.words(row)
        none = len(used) - 1
        word = np.where(t.hit, none, t.word)
        short = t.pair << SHORT | t.strings[t.rank] >> STRING_BITS - SHORT
        of = [t.asked(k)[2:] for k in ORDERS]
        ends = np.cumsum([len(plain), PAIRS << SHORT, *(int((asked >> 1).sum() + (asked & 1).sum()) for asked, _ in of)])
        table, index = np.zeros((ends[-1], DEPTH), np.int8), np.empty((INPUTS, len(word)), np.int32)
        table[: ends[0]] = plain
        self.wide(table[ends[0] : ends[1]])
        index[0], index[1] = word, np.where(t.hit, none, ends[0] + short)
        knows = []
        for k, (asked, event) in zip(ORDERS, of, strict=True):
            rows = table[ends[k] : ends[k + 1]]
            at = contexts.answered(row["answers"], k, self.range_bits, asked, event, t, rows)
            knows.append(np.append(rows[:, 1] != 0, False)[at])
            index[1 + k] = np.where(t.hit, none, at + ends[k])
        gate = np.where(t.can, 3, np.where(knows[1], 2, np.where(knows[0], 1, 0))).astype(np.int8)
        del of, rows
        some = np.flatnonzero(t.can)
        run, hit = t.run[some], t.hit[some].astype(np.int8)
        flags = np.zeros((2, len(word)), np.int8)
        flags[:, some] = self.flag[run, hit], self.flag_pair[run, t.near[some], hit]
        longest = np.argsort(-t.sizes, kind="stable")
        score = mixed(table, index, flags, t.can, gate, t.can + used[word], t.start[longest], t.sizes[longest])
        # what each word adds, then the sums of each text
        length, spell, share = unpack(row["lengths"], np.int32), np.frombuffer(row["spell"], np.float32), unpack(row["share"], np.float32)
        score += np.append(share, np.zeros(2, np.float32))[word]  # none of unknown words and repeats
        base = np.log10((t.count + 1) / (self.total + self.distinct + 1))
        values = {
            "n_known": (t.count > 0)[t.number], "base_score": base[t.number], "score": score,
            "spelled": np.where(word == len(t.count), spell[t.number], np.float32(0)), "n_bytes": (length + 1.0)[t.number],
        }
        return {"n_tokens": t.sizes, **{k: np.bincount(t.doc, weights=v, minlength=n) for k, v in values.items()}}


def _tree(counts: np.ndarray) -> np.ndarray:
    """Opinions of each leaf's path: counts (contexts, leaves) to (contexts, leaves, bits)."""
    bits = counts.shape[1].bit_length() - 1
    out = np.zeros((*counts.shape, bits), np.int8)
    for d in range(bits):
        same = counts.reshape(len(counts), 2 << d, -1).sum(2)
        other = same.reshape(len(counts), -1, 2)[:, :, ::-1].reshape(same.shape)
        seen = same + other > 0
        out[:, :, d] = np.repeat(np.where(seen, stretched(same, other), 0), counts.shape[1] >> d + 1, axis=1)
    return out


def _coded(blocks: DataFrame, own: DataFrame, spell) -> DataFrame:
    """Blocks with the counts, strings and spelling of their words; places are the shorter ones."""
    names = ["block", "doc_ids", "held", "sizes", "tokens", "lengths"]
    made = ["places", "counts", "depth", "deep", "share", "spell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in made}
            for row in b.to_pylist():
                got = sorted(row["answers"], key=lambda a: a["range"])
                for c, come, kind in (("places", "names", np.uint64), ("counts", "counts", np.int64), ("depth", "depth", np.uint8), ("deep", "deep", np.int8), ("share", "share", np.float32)):
                    out[c].append(tokens.pack(np.concatenate([unpack(a[come], kind) for a in got])))
                c, length = unpack(out["counts"][-1], np.int64), unpack(row["lengths"], np.int32).astype(np.int64)
                # words that some text does not know are spelled
                rare, begin = np.flatnonzero(c < 2), np.cumsum(length) - length
                value = np.zeros(len(c), np.float32)
                value[rare] = spell.value.score(unpack(row["spelled"], np.uint8)[tokens.inner(length[rare], begin[rare])], length[rare])
                out["spell"].append(tokens.pack(value))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(out[c], pa.binary()) for c in made)], names=[*names, *made])

    schema = "block long, doc_ids array<long>, held array<boolean>, " + ", ".join(f"{c} binary" for c in [*names[3:], *made])
    return blocks.select(*names, "spelled").join(own, "block").mapInArrow(run, schema)


_COLUMNS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for row in b.to_pylist():
                s, k = m.score(row | {"spell": unpack(row["spell"], np.float32).tobytes()}), len(row["held"])
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), *(pa.array(s[c].astype(np.int64)) for c in ("n_tokens", "n_known")), pa.array([m.total] * k, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(s["base_score"]), pa.array(s["score"]), pa.array(-(s["score"] + s["spelled"]) / np.log10(2) / s["n_bytes"])], names=[c.split()[0] for c in _COLUMNS.split(", ")])

    return run


def _total(df: DataFrame, column: str) -> np.ndarray:
    """Sum of packed arrays of fixed size; at most 64 of them reach the driver."""
    return np.sum([unpack(r[0], np.int64) for r in df.select(F.col(column).alias("counts")).coalesce(64).mapInArrow(tokens.summed, "counts binary").collect()], axis=0)


def _lists(answers: DataFrame, *columns: str) -> DataFrame:
    """What ranges answered each block: bounded by the words, or events, of the block."""
    return answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("range", *columns)).alias("answers"))


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Score all whole texts of ``docs`` (doc_id, text) by a model of those that are not held out.

    Held out are texts whose crc32(doc_id as text) modulo 7 is 2; rows without an id are not. Returns
    doc_id, held_out, n_tokens (words and the end), n_known (tokens seen in training), train_tokens,
    base_score (add-one unigram log10 probability), score (the model's log10 probability; as in the
    base all unknown words are one event) and bits_per_byte (with the spelling of unknown words, over the
    bytes of words and ends). Null and empty texts are the end alone. Repeated rows are texts of their own. Other
    columns are not read. An empty table gives no rows; without training texts every word is unknown.
    Runs its jobs when called; the result is a table in the shared folder, other tables of it are deleted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(crc32_mod("doc_id", HELD_MOD) == HELD_REST, F.lit(False))
    with Scratch(spark) as scratch:
        rows = docs.select("doc_id", "text", held.alias("held_out"))
        # a block takes as many steps as its longest text has tokens, so long texts meet others of their length
        size = F.coalesce(F.octet_length("text"), F.lit(0))
        long = rows.where(size >= LONG).repartitionByRange(size)
        blocks = rows.where(size < LONG).mapInArrow(tokens.blocked(0), tokens.BLOCKS).union(long.mapInArrow(tokens.blocked(1), tokens.BLOCKS))
        # in buckets, so that only what words are answered is dealt out
        blocks = scratch.stored(blocks, "blocks", by="block")
        with session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):  # rows are blocks from here on
            entries, n, n_blocks = blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.count("*")).first()
            if not entries:
                return spark.createDataFrame([], _COLUMNS)
            parts = max(1, min(PARTS, n_blocks // LEAST_BLOCKS))
            word_bits = min(CELL_BITS, (-(-entries // tokens.RANGE) - 1).bit_length())
            asks = blocks.select("block", "places", "own").mapInArrow(tokens.word_asks(word_bits), tokens.WORD_ASKS)
            answers = scratch.stored(asks.groupBy("range").applyInArrow(tokens.word_answers(word_bits), tokens.WORD_ANSWERS), "words")
            top = _total(answers.where("block = -1"), "counts")
            spell = spark.sparkContext.broadcast(spelling(blocks))  # of fixed size
            # dealt by block, so that what the contexts answer comes to it
            coded = _coded(blocks, _lists(answers, "counts", "depth", "deep", "share", "names"), spell).withColumn("part", _part("block", parts))
            coded = scratch.stored(coded, "coded", by="block", apart="part")
            scratch.drop("blocks", "words")
            range_bits = (-(-n // contexts.EVENTS) - 1).bit_length()
            keep = min(64 - STRING_BITS + range_bits, 64, n.bit_length() + contexts.SPARE)
            seen = coded.select("block", "held", "sizes", "tokens", "places", "counts", "depth")
            answers, ask_parts = [], min(parts, ASK_PARTS)
            for k in reversed(ORDERS):  # one after the other, so that only one's events are on the disks; first the one with more events and smaller answers
                asks = scratch.stored(seen.mapInArrow(contexts.context_asks(keep, range_bits, k), contexts.ASKS).withColumn("part", _part("range", ask_parts)), "asks", apart="part")
                with session_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS)}):  # rows are what a block asks one range: small
                    for part in range(ask_parts):
                        own = asks.where(F.col("part") == part).drop("part").groupBy("range").applyInArrow(contexts.context_answers, contexts.ANSWERS)
                        answers.append(scratch.stored(own.withColumn("part", _part("block", parts)), "contexts", apart="part"))
                        scratch.drop_part("asks", "part", part)
                scratch.drop("asks")
            answers = functools.reduce(DataFrame.union, answers)
            model = Model(top, _total(answers.where("block = -1"), "train"), keep, range_bits)
            shared = spark.sparkContext.broadcast(model)  # of fixed size
            scores = []
            for part in range(parts):
                own = coded.where(F.col("part") == part).drop("part").join(_lists(answers.where(F.col("part") == part), "train", "held"), "block")
                scores.append(scratch.stored(own.mapInArrow(_scored(shared), _COLUMNS), "scores", stays=True))
                scratch.drop_part("contexts", "part", part)
            return functools.reduce(DataFrame.union, scores)
