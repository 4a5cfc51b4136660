"""Hashed contexts: what followed each word, and each two words, over all training texts.

An event is a context (a hash, of more bits the more tokens there are) and the string of the word
that followed. A block sends its distinct events, sorted, to ranges of context hashes; a range adds
them up and answers each block with the opinion that every asked event's context has of each bit of
its string. A training text is answered by what the others hold: its own event is left out once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from .lm_tokens import CELL_BITS, CLASS_BITS, CLASSES, LEAST, STRING_BITS, cell_of, changes, class_of, grouped, inner, pack, prefix_opinions, slices, unpack
from .textkernel import mix

#: Tokens of one range of contexts; bits of a context beyond those of the number of tokens.
EVENTS, SPARE = 3 << 20, 6
#: Orders of context that are counted so: the word before, two words before.
ORDERS = (1, 2)
#: Leading bits of a string that the classes of the two words before tell about, and the number of such contexts.
SHORT = CLASS_BITS + LEAST
PAIRS = CLASSES * CLASSES
RUNS = 16
_G1, _G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Text:
    """The tokens of a block with all that predictors look at.

    Texts are runs of ``size`` tokens from ``start``; ``first`` tells what each begins at. A training
    text's words that no other token shares are unknown to it (``word`` is then the number after the last).
    """

    def __init__(self, row: dict, keep: int):
        self.keep = keep
        places, c = unpack(row["places"], np.uint64), unpack(row["counts"], np.int64)
        number = unpack(row["tokens"], np.int32)
        self.number, self.count = number, c
        self.sizes = unpack(row["sizes"], np.int32).astype(np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        held = np.array(row["held"], bool)
        n, unknown = len(number), len(places)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.held = held[self.doc]
        # every text follows an end, which is number 0
        before, second = np.zeros(n, np.int32), np.zeros(n, np.int32)
        before[1:] = number[:-1]
        before[self.start] = 0
        second[1:] = before[:-1]
        second[self.start] = 0
        cls, past = class_of(c), CELL_BITS - unpack(row["depth"], np.uint8).astype(np.int64)
        # bits past those that name a word are zeros
        strings = np.append(np.where(cls > 0, cls << CELL_BITS | cell_of(places) >> past << past, 0), 0)
        order, new = grouped((strings, STRING_BITS))
        self.strings, rank = strings[order[new]], np.empty(len(strings), np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32) - 1
        # 2: no training text has the word, 1: one has, once
        self.word = np.where(np.where(c > 1, 0, 2 - c).astype(np.int8)[number] > self.held, unknown, number)
        self.rank = rank[self.word]
        self._cls = np.append(cls, 0)
        self.end_cls = cls[0]
        # contexts as (number, hash) of the order's distinct ones, in the order of the hash
        drop = np.uint64(64 - keep)
        one = places >> drop
        new = changes(one)
        two = mix((places * _G1)[before] + mix(places * _G2)[second]) >> drop
        order, same = grouped((two, keep))
        ids = np.empty(n, np.int32)
        ids[order] = np.cumsum(same, dtype=np.int32) - 1
        self.context = {1: ((np.cumsum(new, dtype=np.int32) - 1)[before], one[new]), 2: (ids, two[order[same]])}
        # what followed the same two words when they last occurred in this text
        doc = self.doc[order]
        again = np.flatnonzero(~same[1:] & (doc[1:] == doc[:-1]))
        at, last = order[again + 1], order[again]
        self.can, self.hit = np.zeros(n, bool), np.zeros(n, bool)
        self.can[at] = True
        self.hit[at] = number[last] == number[at]

    @functools.cached_property
    def cls(self) -> np.ndarray:
        """The class of each token's word."""
        return self._cls[self.word]

    @functools.cached_property
    def near(self) -> np.ndarray:
        """The class of the word before each token."""
        return self._before(self.cls)

    @functools.cached_property
    def pair(self) -> np.ndarray:
        """The classes of the two words before each token."""
        return self.near * CLASSES + self._before(self.near)

    def _before(self, cls: np.ndarray) -> np.ndarray:
        out = np.empty_like(cls)
        out[1:] = cls[:-1]
        out[self.start] = self.end_cls
        return out

    @functools.cached_property
    def run(self) -> np.ndarray:
        """How many tokens before each have repeated what followed before."""
        n = len(self.hit)
        fresh = np.zeros(n, bool)
        fresh[self.start] = True
        miss = np.maximum.accumulate(np.where(~self.hit | fresh, np.arange(n), -1))
        run = np.zeros(n, np.int64)
        run[1:] = np.arange(n - 1) - miss[:-1]
        run[fresh] = 0
        return np.minimum(RUNS - 1, run)

    def events(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct events of an order, sorted: context hash, string, number in training, who asks (1: held out, 2: training texts); then each token's event."""
        ids, hashes = self.context[k]
        first, n, asked, event = self.asked(k)
        return hashes[ids[first]], self.strings[self.rank[first]].astype(np.uint64), n, asked, event

    def asked(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct events of an order: a token that has it, number in training, who asks; then each token's event."""
        ids, hashes = self.context[k]
        order, new = grouped((ids, len(hashes).bit_length()), (self.rank, len(self.strings).bit_length()))
        event = np.empty(len(order), np.int32)
        event[order] = np.cumsum(new, dtype=np.int32) - 1
        begin = np.flatnonzero(new)
        if not len(begin):
            return order, order, order, event
        who = np.where(self.hit, 0, np.where(self.held, 1, 2)).astype(np.int8)[order]
        n = np.add.reduceat(~self.held[order], begin, dtype=np.int32)
        return order[begin], n.astype(np.int64), np.bitwise_or.reduceat(who, begin).astype(np.int64), event

    def stats(self) -> np.ndarray:
        """Training counts of fixed size: short strings by the classes before, then repeats by run and class before."""
        own = ~self.held
        t = own & ~self.hit
        short = np.bincount(self.pair[t] << SHORT | self.strings[self.rank[t]] >> STRING_BITS - SHORT, minlength=PAIRS << SHORT)
        t = own & self.can
        flags = np.bincount((self.run[t] * CLASSES + self.near[t]) * 2 + self.hit[t], minlength=RUNS * CLASSES * 2)
        return np.concatenate((short, flags)).astype(np.int64)


ASKS = "range int, block long, keys binary, counts binary"
_ASKS = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def context_asks(keep: int, range_bits: int, k: int):
    """Events of order ``k`` of each block by range: keys, and four times their number in training and who asks.

    With the first order a task also sends its `Text.stats`, to a range below zero; there are as many of these as of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, stats = np.uint64((1 << keep - range_bits) - 1), None
        for b in batches:
            for row in b.to_pylist():
                t, rows = Text(row, keep), []
                if k == ORDERS[0]:
                    stats = t.stats() if stats is None else stats + t.stats()
                hashes, strings, n, asked, _ = t.events(k)
                keys, value = (hashes & inner) << np.uint64(STRING_BITS) | strings, (n << 2 | asked).astype(np.int32)
                for r, at in slices(hashes, keep - range_bits, 1 << range_bits):
                    rows.append({"range": (k - 1 << range_bits) + r, "block": row["block"], "keys": pack(keys[at]), "counts": pack(value[at])})
                yield pa.RecordBatch.from_pylist(rows, _ASKS)
        if stats is not None:
            to = -1 - TaskContext.get().partitionId() % (1 << range_bits)
            yield pa.RecordBatch.from_pylist([{"range": to, "block": -1, "keys": b"", "counts": pack(stats)}], _ASKS)

    return run


ANSWERS = "block long, range int, train binary, held binary"


_PLACES = np.arange(STRING_BITS, dtype=np.uint8)


def reach(rows: np.ndarray) -> np.ndarray:
    """How many opinions of each row there are up to the one that all later ones equal: a word alone in its context has but one."""
    new = np.empty(rows.shape, bool)
    new[:, :1] = True
    np.not_equal(rows[:, 1:], rows[:, :-1], out=new[:, 1:])
    return (STRING_BITS - np.argmax(new[:, ::-1], axis=1)).astype(np.uint8)


def squeezed(rows: np.ndarray, reached: np.ndarray) -> bytes:
    """Rows of opinions about strings, each as far as it is ``reached``, compressed."""
    return joined(reached, rows[_PLACES < reached[:, None]])


def joined(reached: np.ndarray, opinions: np.ndarray) -> bytes:
    """Rows of ``reached`` opinions, one after the other, compressed."""
    lengths, values = (pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True) for x in (reached, opinions))
    return len(reached).to_bytes(8, "little") + len(lengths).to_bytes(8, "little") + lengths + values


def spread(raw: bytes, out: np.ndarray) -> int:
    """Put rows into the columns of ``out`` after its first; how many there are."""
    n, cut = int.from_bytes(raw[:8], "little"), 16 + int.from_bytes(raw[8:16], "little")
    if n:
        reached = np.frombuffer(pa.decompress(raw[16:cut], n, codec="zstd", asbytes=True), np.uint8)
        ends = np.cumsum(reached, dtype=np.int64)
        values = np.frombuffer(pa.decompress(raw[cut:], int(ends[-1]), codec="zstd", asbytes=True), np.int8)
        last = values[ends - 1]
        out[:n, 1:] = last[:, None]
        more = np.flatnonzero(reached > 1)
        rows = np.repeat(last[more], STRING_BITS).reshape(-1, STRING_BITS)
        rows[_PLACES < reached[more][:, None]] = values[np.repeat(reached > 1, reached)]
        out[more, 1:] = rows
    return n


def context_answers(t: pa.Table) -> pa.Table:
    """The opinions that each block asked one range for, for its training and its held-out texts."""
    r = t.column("range")[0].as_py()
    if r < 0:
        total = sum(unpack(x, np.int64) for x in t.column("counts").to_pylist())
        return pa.table({"block": pa.array([-1], pa.int64()), "range": pa.array([r], pa.int32()), "train": pa.array([pack(total)], pa.binary()), "held": pa.array([b""], pa.binary())})
    keys = [unpack(x, np.uint64) for x in t.column("keys").to_pylist()]
    value = np.concatenate([unpack(x, np.int32) for x in t.column("counts").to_pylist()]).astype(np.int64)
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    new = changes(flat)
    back = np.empty(len(order), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    n = np.add.reduceat(value[order] >> 2, np.flatnonzero(new))
    reached, every, others = prefix_opinions(flat[new], n, STRING_BITS)
    begin, train, held, at = np.cumsum(reached, dtype=np.int64) - reached, [], [], 0
    for k in keys:
        own, asked = back[at : at + len(k)], value[at : at + len(k)]
        for out, opinions, who in ((train, others, 2), (held, every, 1)):
            i = own[asked & who > 0]
            far = reached[i]
            out.append(joined(far, opinions[inner(far, begin[i])]))
        at += len(k)
    return pa.table({"block": t.column("block"), "range": pa.array([r] * len(keys), pa.int32()), "train": pa.array(train, pa.binary()), "held": pa.array(held, pa.binary())})


def answered(answers: list[dict], k: int, range_bits: int, asked: np.ndarray, event: np.ndarray, text: Text, table: np.ndarray) -> np.ndarray:
    """Puts all rows of opinions of one order (about every decision) into ``table``; the row of each token, the one after the last where it asked nothing."""
    own, at = sorted((a for a in answers if a["range"] >> range_bits == k - 1), key=lambda a: a["range"]), 0
    for who in ("train", "held"):
        for a in own:
            at += spread(a[who], table[at:])
    # a row for each event and who asks it
    place = np.stack([np.cumsum(asked >> 1) - 1, (asked >> 1).sum() - 1 + np.cumsum(asked & 1)], axis=1).astype(np.int32).ravel()
    return np.where(text.hit, np.int32(at), place[2 * event.astype(np.int64) + text.held])
