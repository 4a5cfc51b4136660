"""Blocks of tokens, word counts, and the binary strings that words are coded by.

A block is a few megabytes of whole texts: its distinct words, in the order of a mixed hash, and the
texts as numbers of these words, each text ended by one token of its own. Counts of all training words
are added up by ranges of that hash; a range answers each block that asked, so no task holds the
vocabulary. A range also codes its words: a class by the power of two of the count, then bits of the
mixed hash until the word is alone in its class, so that a string of bits names one word (words that
agree in all ``CELL_BITS`` share the last cell by their counts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from .textkernel import chunks, mix, word_hashes, words

#: Bytes of text of a block; entries of one range of word hashes.
BLOCK, RANGE = 4 << 20, 2_000_000
CLASS_BITS, CELL_BITS = 5, 20
CLASSES, STRING_BITS = 1 << CLASS_BITS, CLASS_BITS + CELL_BITS
#: Bits of a cell that one table of all words covers (the rest is known within a range of words).
TOP = 10
#: Bits of a cell that are coded always.
LEAST = 3
#: Decisions of a token: whether it repeats what followed before, class, cell.
DEPTH = 1 + STRING_BITS
#: Steps of a prediction in the logistic domain, and its smoothing.
SCALE, SMOOTH = 8, 0.4


def pack(a: np.ndarray) -> bytes:
    """An integer array with its bytes dealt by place and compressed, after its length."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.zeros(0, np.uint8)
    return len(a).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n) if n else np.zeros(0, kind)


def order_of(*fields: tuple[np.ndarray, int]) -> np.ndarray:
    """Indices that sort by ``fields`` (values, bits of a value), equal rows in their order."""
    n = len(fields[0][0])
    low = max(1, n.bit_length())
    if sum(b for _, b in fields) + low > 64:
        return np.lexsort(tuple(v for v, _ in reversed(fields)))
    packed = _packed(fields, low)
    packed.sort()
    return (packed & np.uint64((1 << low) - 1)).astype(np.int64)


def grouped(*fields: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """`order_of` the fields, and where in that order some field differs from the row before."""
    n = len(fields[0][0])
    low = max(1, n.bit_length())
    if sum(b for _, b in fields) + low > 64:
        order = order_of(*fields)
        return order, np.logical_or.reduce([changes(v[order]) for v, _ in fields])
    packed = _packed(fields, low)
    packed.sort()
    return (packed & np.uint64((1 << low) - 1)).astype(np.int64), changes(packed >> np.uint64(low))


def _packed(fields: tuple[tuple[np.ndarray, int], ...], low: int) -> np.ndarray:
    n = len(fields[0][0])
    packed = fields[0][0].astype(np.uint64)
    for v, b in fields[1:]:
        packed <<= np.uint64(b)
        packed |= v.astype(np.uint64, copy=False)
    packed <<= np.uint64(low)
    packed |= np.arange(n, dtype=np.uint64)
    return packed


def changes(a: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; the first does."""
    out = np.empty(len(a), bool)
    out[:1] = True
    np.not_equal(a[1:], a[:-1], out=out[1:])
    return out


def _stretched(same: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log((same + SMOOTH) / (other + SMOOTH)) * SCALE), -127, 127).astype(np.int8)


#: Counts below this are looked up.
_FEW = 256
_LOOK = _stretched(np.arange(_FEW)[:, None], np.arange(_FEW)[None, :]).ravel()


def stretched(same: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The opinion that counts have of the way that ``same`` of them went, in steps of the logistic domain."""
    many = (same | other) >= _FEW
    if not many.any():
        return _LOOK.take(same * _FEW + other)
    out = _LOOK.take(np.where(many, 0, same * _FEW + other))
    out[many] = _stretched(same[many], other[many])
    return out


# ---------------------------------------------------------------- blocks

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

FIELDS = ("sizes", "tokens", "places", "own", "lengths", "spelled", "codes", "times")
BLOCKS = f"block long, doc_ids array<long>, held array<boolean>, {', '.join(f'{f} binary' for f in FIELDS)}, n_words long, n_tokens long"
_SCHEMA = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((f, pa.binary()) for f in FIELDS), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def row_of(block: int, ids: list, held: np.ndarray, column: pa.Array) -> dict:
    """One block of texts."""
    places, starts, ends, counts, data, base = [], [], [], [], [], 0
    for _, _, raw, offsets in chunks(column):
        s, e, firsts = words(raw, offsets)
        places.append(mix(word_hashes(raw, s, e)))
        starts.append(s + base), ends.append(e + base), counts.append(np.diff(firsts)), data.append(raw)
        base += len(raw)
    place, s, e, n, raw = (np.concatenate(x) for x in (places, starts, ends, counts, data))
    bits = 64 - max(1, len(place).bit_length())
    order = order_of((place >> np.uint64(64 - bits), bits)) if len(place) else np.zeros(0, np.int64)
    new = changes(place[order])
    # number 0 is the end of a text, which has place 0
    number = np.empty(len(place), np.int32)
    number[order] = np.cumsum(new)
    first = order[new]
    tokens = np.zeros(len(place) + len(n), np.int32)
    tokens[np.arange(len(place)) + np.repeat(np.arange(len(n)), n)] = number
    distinct = np.concatenate(([np.uint64(0)], place[first]))
    length = np.concatenate(([0], e[first] - s[first]))
    spelled = _LOWER.take(raw[inner(length, np.concatenate(([0], s[first])))])
    own = np.bincount(tokens[np.repeat(~held, n + 1)], minlength=len(distinct)).astype(np.int64)
    codes, times = np.unique(trigrams(spelled, length, own > 0), return_counts=True)
    made = {"sizes": (n + 1).astype(np.int32), "tokens": tokens, "places": distinct, "own": own.astype(np.int32), "lengths": length.astype(np.int32), "spelled": spelled, "codes": codes, "times": times.astype(np.int64)}
    return {"block": block, "doc_ids": ids, "held": held.tolist(), **{f: pack(a) for f, a in made.items()}, "n_words": len(distinct), "n_tokens": len(tokens)}


def trigrams(spelled: np.ndarray, length: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """Codes (two bytes before, byte) of words, a space before and after each."""
    begin = np.cumsum(length + 3) - length - 3
    letter = np.ones(len(spelled) + 3 * len(length), bool)
    letter[begin] = letter[begin + 1] = letter[begin + 2 + length] = False
    padded = np.full(len(letter), 32, np.int32)
    padded[letter] = spelled
    code = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    # but for those that reach into the next word
    within = np.ones(len(letter), bool) if which is None else np.repeat(which, length + 3)
    within[begin + length + 1] = within[begin + length + 2] = False
    return code[within[:-2]]


def blocked(kind: int):
    """Blocks of (doc_id, text, held_out); tables of another ``kind`` give blocks of other numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            row = row_of(((part << 24 | k) << 1) | kind, t.column("doc_id").to_pylist(), t.column("held_out").to_numpy().astype(bool), pa.concat_arrays(t.column("text").chunks))
            return pa.RecordBatch.from_pylist([row], _SCHEMA)

        for b in batches:
            for at in range(0, b.num_rows, 64):
                piece = b.slice(at, 64)
                held.append(piece)
                size += piece.column("text").nbytes
                if size >= BLOCK:
                    yield out()
                    k, held, size = k + 1, [], 0
        if held:
            yield out()

    return run


# ---------------------------------------------------------------- word counts and strings


def class_of(c: np.ndarray) -> np.ndarray:
    """0 for unknown words, 1 for counts below four, else the power of two of the count."""
    return np.where(c > 0, np.clip(np.log2(np.maximum(c, 1)).astype(np.int64), 1, CLASSES - 1), 0)


def cell_of(place: np.ndarray) -> np.ndarray:
    return (place >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def slices(keys: np.ndarray, shift: int, ranges: int) -> Iterator[tuple[int, slice]]:
    """The ranges that sorted keys fall into, by the bits from ``shift`` on, with their slices."""
    cuts = np.searchsorted(keys >> np.uint64(shift) if shift < 64 else np.zeros(len(keys), np.uint64), np.arange(ranges + 1, dtype=np.uint64))
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        yield r, slice(cuts[r], cuts[r + 1])


WORD_ASKS = "range int, block long, places binary, counts binary"


def word_asks(range_bits: int):
    """A row for each range that a block has words in: their places and their counts in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, places, own in zip(*(b.column(c).to_pylist() for c in ("block", "places", "own")), strict=True):
                p, n = unpack(places, np.uint64), unpack(own, np.int32)
                rows = [(r, block, pack(p[at]), pack(n[at])) for r, at in slices(p, 64 - range_bits, 1 << range_bits)]
                yield pa.RecordBatch.from_pylist([dict(zip(("range", "block", "places", "counts"), x, strict=True)) for x in rows], pa.schema([("range", pa.int32()), ("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())]))

    return run


def resolved(place: np.ndarray, c: np.ndarray, range_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of one range: bits of their cells that are coded, opinions beyond ``TOP`` bits, log10 of the share of their last cell."""
    cls, cell = class_of(c), cell_of(place)
    order = np.argsort(cls << CELL_BITS | cell, kind="stable")
    string, n = (cls << CELL_BITS | cell)[order].astype(np.uint64), c[order]
    apart = np.frexp((string[1:] ^ string[:-1]).astype(np.float64))[1]  # bits from the first that differs on
    near = np.where(apart > CELL_BITS, -1, CELL_BITS - apart)
    depth = np.minimum(CELL_BITS, np.maximum(np.concatenate(([-1], near)), np.concatenate((near, [-1]))) + 1)
    depth = np.where(n > 0, np.maximum(depth, max(range_bits, LEAST)), 0)
    reached, every = prefix_opinions(string, n, STRING_BITS, less=0)
    deep, begin = np.zeros((len(c), CELL_BITS - TOP), np.int8), np.cumsum(reached, dtype=np.int64) - reached
    for d in range(max(TOP, range_bits), CELL_BITS):
        some = np.flatnonzero(depth > d)
        deep[some, d - TOP] = every[begin[some] + np.minimum(CLASS_BITS + d, reached[some] - 1)]
    group = np.cumsum(changes(string)) - 1 if len(string) else string.astype(np.int64)
    share = np.log10(np.maximum(n, 1) / np.maximum(np.bincount(group, n), 1)[group]) if len(string) else np.zeros(0)
    out = np.empty(len(c), np.uint8), np.empty((len(c), CELL_BITS - TOP), np.int8), np.empty(len(c), np.float32)
    for o, v in zip(out, (depth, deep, np.where((n > 0) & (depth == CELL_BITS), share, 0.0)), strict=True):
        o[order] = v
    return out


def prefix_opinions(keys: np.ndarray, n: np.ndarray, bits: int, less: int = 1) -> list[np.ndarray]:
    """Opinions about the last ``bits`` bits of sorted keys, by the counts ``n`` of all keys with the same bits before.

    For each key as many as there are until it is alone, and one more that holds for all later bits: how many these
    are, then what the counts have said about the way that the key goes, key after key. The first such array counts all,
    the second, if any is asked for, leaves ``less`` of the key's own out (if it has so many).
    """
    leave = (0, less)[: 1 + (less > 0)]
    if not len(keys):
        return [np.zeros(0, np.uint8), *(np.zeros(0, np.int8) for _ in leave)]
    n = n.astype(np.int32 if int(n.sum()) < 1 << 30 else np.int64)
    apart = np.frexp((keys[1:] ^ keys[:-1]).astype(np.float64))[1]  # bits from the first that differs on
    far = np.concatenate(([bits + 1], apart, [bits + 1]))
    levels = np.clip(bits + 1 - np.minimum(far[1:], far[:-1]), 0, bits).astype(np.uint8)  # at which a key shares the bits before with another
    reached = np.minimum(levels + 1, bits).astype(np.uint8)
    ends = np.cumsum(reached, dtype=np.int64)
    out, own = [np.empty(int(ends[-1]), np.int8) for _ in leave], np.minimum(n, less)
    # what holds for later bits; keys that are never alone write over it
    for o, k in zip(out, leave, strict=True):
        o[ends - 1] = stretched(n - own if k else n, np.zeros_like(n))
    at = np.flatnonzero(levels)
    new, place = changes(keys[at] >> np.uint64(bits)) if bits < 64 else np.arange(len(at)) == 0, (ends - reached)[at]
    low, levels, n, own = (keys[at] & np.uint64((1 << bits) - 1)).astype(np.uint64 if bits > 32 else np.uint32), levels[at], n[at], own[at]
    total = _added(n, new)
    for d in range(bits):
        if not len(place):
            break
        bit = low >> low.dtype.type(bits - 1 - d)
        new[1:] |= bit[1:] != bit[:-1]
        same = _added(n, new)
        if int(total.max()) < _FEW:
            look = same * (_FEW - 1) + total
            for o, k in zip(out, leave, strict=True):
                o[place] = _LOOK.take(look - own * _FEW if k else look)
        else:
            for o, k in zip(out, leave, strict=True):
                o[place] = stretched(same - own if k else same, total - same)
        stay = np.flatnonzero(levels > d + 1)
        if len(stay) == len(place):
            place, total = place + 1, same
        else:
            low, levels, n, own, new, place, total = low[stay], levels[stay], n[stay], own[stay], new[stay], place[stay] + 1, same[stay]
    return [reached, *out]


def _added(n: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row the sum over its group; groups begin where ``new`` is set."""
    return np.add.reduceat(n, np.flatnonzero(new), dtype=n.dtype)[np.cumsum(new, dtype=np.int32) - 1] if len(n) else n


def inner(lengths: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The places of runs of ``lengths`` from ``begin``, run after run."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + lengths, lengths)


def shortened(place: np.ndarray) -> np.ndarray:
    """Sorted distinct places without the bits that are not needed to tell each from its neighbours, but for those of a cell.

    They stay distinct and in their order, and take a third of the room.
    """
    apart = place[1:] ^ place[:-1]
    apart &= ~(apart >> np.uint64(1))  # the first bit stays first, and no rounding reaches the next one
    past = np.frexp(apart.astype(np.float64))[1] - 1
    past = np.minimum(np.minimum(np.append(past, 64), np.append(64, past)), 64 - CELL_BITS) if len(place) else past
    return place >> past.astype(np.uint64) << past.astype(np.uint64)


WORD_ANSWERS = "block long, range int, counts binary, depth binary, deep binary, share binary, names binary"


def word_answers(range_bits: int):
    """One row for each block that asked a range, in which ``names`` are its places made shorter; one more, of block -1, with the counts of all its words by class and top bits."""

    def run(t: pa.Table) -> pa.Table:
        places = [unpack(x, np.uint64) for x in t.column("places").to_pylist()]
        own = np.concatenate([unpack(x, np.int32) for x in t.column("counts").to_pylist()])
        uniq, back = np.unique(np.concatenate(places), return_inverse=True)
        c = np.bincount(back, weights=own, minlength=len(uniq)).astype(np.int64)
        depth, deep, share = resolved(uniq, c, range_bits)
        top = np.bincount(class_of(c) << TOP | cell_of(uniq) >> CELL_BITS - TOP, weights=c, minlength=CLASSES << TOP).astype(np.int64)
        names = shortened(uniq)
        out, at = [], 0
        for block, p in zip(t.column("block").to_pylist(), places, strict=True):
            i = back[at : at + len(p)]
            out.append((block, pack(c[i]), pack(depth[i]), pack(deep[i].ravel()), pack(share[i]), pack(names[i])))
            at += len(p)
        out.append((-1, pack(np.concatenate(([(c > 0).sum()], top)).astype(np.int64)), b"", b"", b"", b""))
        block, *rest = zip(*out, strict=True)
        r = t.column("range")[0].as_py()
        return pa.table({"block": pa.array(block, pa.int64()), "range": pa.array([r] * len(out), pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in zip(("counts", "depth", "deep", "share", "names"), rest, strict=True)}})

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of packed arrays of one length."""
    total = None
    for b in batches:
        for x in b.column("counts").to_pylist():
            v = unpack(x, np.int64)
            total = v if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pack(total)], pa.binary())], names=["counts"])
