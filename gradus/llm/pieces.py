"""SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds.

The symbols of all words of a batch lie in one flat numpy array. A round looks up the rank of
every neighbouring pair, takes the minimum per segment, merges its leftmost occurrences in all
segments at once and compacts the array; words without a pair leave. It ends when no pair remains.
Equal pairs merge together only if no pair that their product can form outranks them; otherwise a
segment merges its leftmost one, so the result is that of merging one pair at a time.

A short word is one segment. In a long one every pair has its own: the symbols that a longest piece
can reach on either side. What changes a pair's symbols before its turn is a chain of merges that
begins at a pair of no worse rank within that reach, so a pair that is the minimum there is safe to
merge, however long the word is; rounds do not grow with it.

Words are cut where no piece of the model can reach across (before a space mark, at characters
that no longer piece holds), which the vocabulary itself tells; each worker keeps a bounded memo of
words. The library only reads the model file here; it neither encodes nor decodes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words whose encoding a worker remembers, and symbols of one pass of merge rounds.
MEMO, PASS = 300_000, 1 << 20
#: Rank of what is no pair.
NONE = np.int64(1 << 40)


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A model's pieces, its table of pairs, and the memo of words."""

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        self.n, self.end = n, lib.eos_id()
        self.special = special
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        score = {p: lib.get_score(i) for p, i in ids.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}

        def symbol(part: str) -> int | None:
            return ids.get(part, n + ord(part) if len(part) == 1 else None)

        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = symbol(p[:cut]), symbol(p[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (order[score[p]], i)
        self.width = np.int64(n + 0x110000)
        keys = np.array([a * int(self.width) + b for a, b in pairs], np.int64)
        sort = np.argsort(keys)
        values = list(pairs.values())
        self.keys = keys[sort]
        self.ranks = np.array([v[0] for v in values], np.int64)[sort]
        self.made = np.array([v[1] for v in values], np.int64)[sort]
        # products that can at once take part in a pair of better rank
        best: dict[int, int] = {}
        for (a, b), (r, _) in pairs.items():
            best[a], best[b] = min(best.get(a, r), r), min(best.get(b, r), r)
        own = {i: order[score[p]] for p, i in ids.items()}
        risky = np.zeros(n, bool)
        risky[[i for i in own if best.get(i, own[i] + 1) <= own[i]]] = True
        self.risky = risky[self.made]
        self.reach = max(map(len, ids))
        self.char = np.arange(0x110000, dtype=np.int64) + n
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        # where words can be cut: a mark after anything else, and round lone characters
        inner = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        lone = [c for c in "\n\t\r\x0b\x0c" if not any(c in x for x in inner)]
        stop = "".join(map(re.escape, lone))
        marks_ok = not any(x[1] == MARK and x[0] != MARK for x in inner)
        self.cut = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + (f"|[{stop}]" if stop else "") if marks_ok else r"(?s).+")
        self.memo: dict[str, tuple[int, str, str]] = {}
        probe = " A\u00c5\uff21  e\u0301\tx \n\u3000"
        if lib.normalize(probe) != self.marked(probe):
            raise ValueError("models that normalise texts, beyond a mark for each space and one before the text, are not supported")

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK)

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """The symbols that remain of each word after all merges."""
        out: list[np.ndarray] = [None] * len(words)
        for long in (False, True):
            which = [i for i, w in enumerate(words) if (len(w) > self.reach) == long]
            for i, syms in zip(which, self.rounds([words[i] for i in which], long), strict=True):
                out[i] = syms
        return out

    def least(self, rank: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least rank within reach before each pair of its word, and from it on."""
        after = rank.copy()
        before = np.full_like(rank, NONE)
        before[1:][word[1:] == word[:-1]] = rank[:-1][word[1:] == word[:-1]]
        step, width = 1, 1
        while width < self.reach + 1:
            step = min(width, self.reach + 1 - width)
            same = word[step:] == word[:-step] if step < len(word) else np.zeros(0, bool)
            if len(same):
                np.minimum(after[:-step], after[step:].copy(), out=after[:-step], where=same)
                np.minimum(before[step:], before[:-step].copy(), out=before[step:], where=same)
            width += step
        return before, after

    def rounds(self, words: list[str], long: bool) -> list[np.ndarray]:
        """Merge rounds over words that are all longer than the reach, or all not."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), sizes)
        out: list[np.ndarray] = [None] * len(words)
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            ok = (self.keys[at] == key) & (word[1:] == word[:-1])
            rank = np.full(len(sym), NONE)
            rank[:-1][ok] = self.ranks[at[ok]]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            done = least == NONE
            if done.any():
                for f, s in zip(first[done].tolist(), size[done].tolist(), strict=True):
                    out[word[f]] = sym[f : f + s]
            if long:
                before, after = self.least(rank, word)
                hit = np.flatnonzero((rank == np.minimum(before, after)) & (rank != NONE))
                lead = before[hit] > rank[hit]
            else:
                hit = np.flatnonzero((rank == np.repeat(least, size)) & (rank != NONE))
                lead = np.concatenate(([True], word[hit][1:] != word[hit][:-1])) if len(hit) else hit
            if not len(hit):
                break
            # of overlapping hits every second stays; a risky product merges once a segment
            run = np.concatenate(([True], np.diff(hit) != 1))
            place = np.arange(len(hit))
            start = np.maximum.accumulate(np.where(run, place, 0))
            even = (place - start) & 1 == 0
            if long:  # a run waits until its first pair is settled
                held = (hit > 0) & (rank[hit - 1] == rank[hit]) & (word[hit - 1] == word[hit])
                even &= ~held[start]
            hit = hit[(even & ~self.risky[at[hit]]) | lead]
            sym[hit] = self.made[at[hit]]
            stay = ~np.repeat(done, size)
            stay[hit + 1] = False
            sym, word = sym[stay], word[stay]
        return out

    def learn(self, words: list[str]) -> None:
        """Put (number of ids, ids as text, decoded text) of new words into the memo."""
        at = 0
        while at < len(words):
            end, total = at, 0
            while end < len(words) and (end == at or total + len(words[end]) <= PASS):
                total += len(words[end])
                end += 1
            for w, syms in zip(words[at:end], self.merged(words[at:end]), strict=True):
                ids: list[int] = []
                for s in syms.tolist():
                    if s < self.n:
                        ids.append(s)
                    else:
                        ids.extend(self.bytes[b] for b in chr(s - self.n).encode())
                self.memo[w] = (len(ids), " ".join(map(str, ids)), self.decode_part(ids))
            at = end

    def decode_part(self, ids: list[int]) -> str:
        """Text of ids, bytes joined to characters; marks become spaces."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append("" if self.special[i] else self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def cut_words(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.cut.findall(self.marked(text))

    def encode_words(self, cut: list[list[str]]) -> list[list[tuple[int, str, str]]]:
        """The memo's entries of the words of each text, new words encoded together."""
        memo = self.memo
        new = {w for words in cut for w in words if w not in memo}
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = {w for words in cut for w in words}
        self.learn(list(new))
        return [list(map(memo.__getitem__, words)) for words in cut]

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        ids = [int(i) for e in self.encode_words([self.cut_words(text)])[0] for i in e[1].split()]
        return [*ids, self.end] if end else ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding puts before a text goes."""
        out = self.decode_part(ids)
        lead = next((i for i in ids if not self.special[i] or i in self.byte_of), None)
        return out[1:] if lead is not None and self.pieces[lead].startswith(MARK) else out


_held: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """The model of this worker process."""
    if model not in _held:
        _held[model] = Pieces(model)
    return _held[model]


#: Characters of text whose words are encoded together.
TOGETHER = 1 << 20


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text) with an end id, and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256.
    Null texts count as empty: the end id alone, decoded to nothing. Each row stands for itself, so
    null or repeated ids and rows do not matter; no column but those two is read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model or _path(MODEL))
        for b in batches:
            texts = b.column("text").to_pylist()
            counts, ids, decoded = [], [], []
            at = 0
            while at < len(texts):
                end, total = at, 0
                while end < len(texts) and (end == at or total + len(texts[end] or "") <= TOGETHER):
                    total += len(texts[end] or "")
                    end += 1
                for entries in p.encode_words([p.cut_words(t) for t in texts[at:end]]):
                    counts.append(sum([e[0] for e in entries]) + 1)
                    ids.append(hashlib.sha256(" ".join([*[e[1] for e in entries], str(p.end)]).encode()).hexdigest())
                    decoded.append(hashlib.sha256("".join([e[2] for e in entries])[1:].encode()).hexdigest())
                at = end
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
