"""Secret scans over texts and every layer that can be unwrapped from them.

A worklist holds layers: the text itself, then what percent escapes, Unicode and hexadecimal
escapes, base64 runs and compressed bytes in it unwrap to. Each layer is scanned, and unwrapped
again, depth first, until nothing new appears; a digest of every layer seen stops cycles. A find in a layer is
mapped to the span of the original text that the layer came from: character by character where
escapes were unwrapped in place, the whole encoded run for base64 and compressed bytes. Runs may be
broken over lines, and may begin anywhere in a stretch of their alphabet: every alignment is tried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

_ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex")

_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#[xX]?[0-9A-Fa-f]{1,7};")
_BREAK = r"[\x20\t]*\r?\n[\x20\t]*"
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_HEXRUN = re.compile(rf"[0-9A-Fa-f]{{16,}}(?:{_BREAK}[0-9A-Fa-f]+)*")
_LINE = re.compile(r"[^\s=]+=*")
#: Text inside other bytes; shorter stretches hold no find. Where compressed bytes may begin.
_STRETCH = re.compile("[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]{14,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
#: Compressed bytes are unwrapped piece by piece; pieces of this size overlap by ``OVERLAP``. Compressions that directly hold one another.
PIECE, OVERLAP, DEEP = 1 << 22, 1 << 12, 200
#: Bytes that encoded runs consist of, line breaks and escapes with them; a gap inside a line ends a run.
_GOES_ON = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\&#;{}\x20\t\r\n"
_GAP = re.compile(rb"[^\s][\x20\t]+(?=[^\s])")

Span = tuple[str, int, int]


def base(text: str) -> list[Span]:
    """Finds of one layer by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _character(code: int, raw: str) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else raw


def _unescaped(run: str) -> str:
    if run[0] == "%":
        return urllib.parse.unquote(run, errors="replace")
    if run[0] == "&":
        digits = run[2:-1]
        try:
            return _character(int(digits[1:], 16) if digits[0] in "xX" else int(digits), run)
        except ValueError:
            return run
    if run.startswith("\\u{"):
        return _character(int(run[3:-1], 16), run)
    if run[1] == "u":
        units = b"".join(int(run[i + 2 : i + 6], 16).to_bytes(2, "little") for i in range(0, len(run), 6))
        return units.decode("utf-16-le", "replace")
    return bytes(int(run[i + 2 : i + 4], 16) for i in range(0, len(run), 4)).decode("utf-8", "replace")


class Layer:
    """A text with, for each stretch of it, where it stands in the original."""

    __slots__ = ("text", "marks")

    def __init__(self, text: str, marks: list[tuple[int, int, int, bool]]):
        # (first character, original start, original end, whether characters map one to one)
        self.text, self.marks = text, marks

    def original(self, start: int, end: int) -> tuple[int, int]:
        lo, hi = self.marks[self.stretch(start)], self.marks[self.stretch(end - 1)]
        first = lo[1] + (start - lo[0]) if lo[3] else lo[1]
        last = hi[1] + (end - hi[0]) if hi[3] else hi[2]
        return first, last

    def stretch(self, at: int) -> int:
        lo, hi = 0, len(self.marks)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.marks[mid][0] <= at else (lo, mid)
        return lo


def _escapes(layer: Layer) -> Iterator[Layer]:
    """The layer with all its escapes unwrapped once, in place."""
    if not any(c in layer.text for c in ("%", "\\u", "\\x", "&#")):
        return
    parts, marks, at, size, changed = [], [], 0, 0, False

    def keep(end: int) -> None:
        nonlocal size
        now, i = at, layer.stretch(at)
        while now < end:  # stretches of the layer that the kept part covers
            s = layer.marks[i]
            stop = min(end, layer.marks[i + 1][0] if i + 1 < len(layer.marks) else end)
            marks.append((size, s[1] + (now - s[0]) if s[3] else s[1], s[2], s[3]))
            size += stop - now
            now, i = stop, i + 1

    for m in _ESCAPE.finditer(layer.text):
        new = _unescaped(m[0])
        if new == m[0] or not new:
            continue
        keep(m.start())
        parts += [layer.text[at : m.start()], new]
        marks.append((size, *layer.original(m.start(), m.end()), False))
        size += len(new)
        at, changed = m.end(), True
    if changed:
        keep(len(layer.text))
        parts.append(layer.text[at:])
        yield Layer("".join(parts), marks)


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or raw[:4] == b"\x28\xb5\x2f\xfd" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0)


def _members(left: bytes, more: Iterator[bytes]) -> Iterator[bytes]:
    """What all members and frames from the start of some bytes hold, in parts of bounded size; what follows them is left."""
    while True:
        while len(left) < 4 and (new := next(more, None)) is not None:
            left += new
        if not _packed(left):
            return
        if left[0] == 0x28:
            import zstandard

            way, at = zstandard.ZstdDecompressor().decompressobj(), 0
            try:
                while not way.eof:  # few bytes at a time, as they may hold much
                    if at >= len(left):
                        left, at = next(more, b""), 0
                        if not left:
                            return
                    out = way.decompress(left[at : at + 128])
                    at += 128
                    if out:
                        yield out
            except zstandard.ZstdError:
                return
            left = way.unused_data + left[at:]
        else:
            way = zlib.decompressobj(wbits=47)
            try:
                while not way.eof:
                    out = way.decompress(left, PIECE)
                    left = way.unconsumed_tail
                    if out:
                        yield out
                    elif not left and not way.eof and not (left := next(more, b"")):
                        return
            except zlib.error:
                return
            left = way.unused_data


def _unpacked(raw: bytes) -> Iterator[bytes] | None:
    """Parts of what compressed bytes hold, through all compressions that directly hold one another; null if they are none."""
    parts, depth = iter([raw]), 0
    while True:
        head = next((p for p in parts if p), b"")
        while len(head) < 4 and (new := next(parts, None)) is not None:
            head += new
        if depth < DEEP and _packed(head):
            inner = _members(head, parts)
            first = next((p for p in inner if p), None)
            if first is not None:
                parts, depth = chain([first], inner), depth + 1
                continue
            if depth:  # it only looked so; its parts are gone but for the head
                return iter([head])
        return chain([head], parts) if depth else None


def _open(held: bytearray) -> int:
    """Bytes at the end that may belong to an encoded run that goes on."""
    tail = held[len(held.rstrip(_GOES_ON)) :]
    last = None
    for last in _GAP.finditer(tail):
        pass
    return len(tail) - (last.end() - 1 if last else 0)


def _pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Parts put together to pieces that no find and no encoded run is cut by: a run that is open at the end of a piece is carried over whole."""
    held, done, looked = bytearray(), 0, 0  # the first ``done`` bytes were in the piece before
    for part in parts:
        held += part
        if len(held) >= max(PIECE, 2 * looked):
            end = len(held) - _open(held)
            looked = len(held) - end  # a long run is looked at again when it is twice as long
            if end > max(done, OVERLAP):
                yield bytes(held[:end])
                keep = max(0, end - OVERLAP)
                del held[:keep]
                done = end - keep
    if len(held) > done:
        yield bytes(held)


def _texts(raw: bytes) -> Iterator[str]:
    """What decoded bytes say as text: themselves, or what they unpack to."""
    parts = _unpacked(raw)
    if parts is not None:
        for piece in _pieces(parts):
            yield piece.decode("utf-8", "replace")
        return
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return
    if text and sum(c.isprintable() or c in "\t\n\r" for c in text) >= 0.9 * len(text):
        yield text


def _inner(raw: bytes) -> Iterator[str]:
    """Text and compressed bytes that begin somewhere in decoded bytes."""
    for m in _STRETCH.finditer(raw.decode("utf-8", "replace")):
        yield m[0]
    for m in _MAGIC.finditer(raw):
        for piece in _pieces(_unpacked(raw[m.start() :]) or iter(())):
            for x in _STRETCH.finditer(piece.decode("utf-8", "replace")):
                yield x[0]


def _base64(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _spans(m: re.Match) -> Iterator[tuple[int, int, str]]:
    """A run and the parts of it that may be one: from any line to the end of an even block, or a line of its own."""
    lines = [(m.start() + x.start(), m.start() + x.end(), x[0]) for x in _LINE.finditer(m[0])]
    yield m.start(), m.end(), "".join(x for *_, x in lines)
    if len(lines) > 1:
        yield from lines
        at = 0
        while at < len(lines) - 1:  # a block: a first line of any length, lines of one length, one that is not longer
            width, end = len(lines[at + 1][2]), at + 1
            while end < len(lines) and len(lines[end][2]) == width:
                end += 1
            ends = [end] + [end + 1] * (end < len(lines) and len(lines[end][2]) < width)
            for first in (at, at + 1):
                for last in ends:
                    if last - first > 1 and (first, last) != (0, len(lines)):
                        yield lines[first][0], lines[last - 1][1], "".join(x for *_, x in lines[first:last])
            at = end


def _runs(layer: Layer) -> Iterator[Layer]:
    """A layer for each run of base64 or hexadecimal digits that decodes to text or unpacks."""
    for kind, pattern in ((4, _BASE64), (2, _HEXRUN)):
        for m in pattern.finditer(layer.text):
            for a, b, run in _spans(m):
                run = run.rstrip("=").replace("-", "+").replace("_", "/")
                if len(run) < (16 if kind == 4 else 32):
                    continue
                for skip in range(kind):
                    part = run[skip:]
                    raw = _base64(part) if kind == 4 else bytes.fromhex(part[: len(part) // 2 * 2])
                    texts = _texts(raw) if not skip else iter(())
                    first = next(texts, None)
                    found = first is not None
                    for text in chain([first], texts) if found else _inner(raw):
                        yield Layer(text, [(0, *layer.original(a, b), False)])
                    if found:
                        break
                if found and (a, b) == m.span():
                    break  # the whole run is one


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    yield from _escapes(layer)
    yield from _runs(layer)


def scan(text: str | None) -> tuple[list[Span], list[Span], int]:
    """(base finds, all finds over every layer, number of layers) of a text."""
    text = text or ""
    own = base(text)
    every = set(own)
    seen = {hashlib.sha256(text.encode("utf-8", "replace")).digest()}
    work = [_unwrapped(Layer(text, [(0, 0, len(text), True)]))]
    layers = 1
    while work:  # depth first: a layer is scanned when it is unwrapped, and gone before the next one beside it is
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        # a layer is known by its text and the place it came from
        key = hashlib.sha256(f"{new.marks[0][1:3]}{len(new.marks)}\0{new.text}".encode("utf-8", "replace")).digest()
        if key not in seen:
            seen.add(key)
            layers += 1
            every.update((k, *new.original(a, b)) for k, a, b in base(new.text))
            work.append(_unwrapped(new))
    return own, ordered(every), layers


def secret_scan(docs: DataFrame) -> DataFrame:
    """Find secrets in every whole text of ``docs`` (doc_id, text).

    Returns for each row doc_id, n_assign, n_access, n_hex and base_sha256 of the finds in the text
    itself, spans (these and the finds of unwrapped layers, in places of the text) and n_layers.
    Null and empty texts have no finds and the digest of nothing. Rows stand for themselves: null
    and repeated ids do not matter, other columns are not read, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t) for t in b.column("text").to_pylist()]
            counts = [[sum(s[0] == k for s in own) for own, _, _ in found] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own, _, _ in found], pa.string()), pa.array([joined(every) for _, every, _ in found], pa.string()), pa.array([n for _, _, n in found], pa.int32())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers int")
