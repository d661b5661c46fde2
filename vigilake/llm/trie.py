"""An n-gram trie in Elias-Fano levels, laid out in one block of bytes.

Each level holds the words of all contexts one after the other. A context's words
rise; adding to them the last value of the context before makes the whole level
rise, so it can be stored as an Elias-Fano sequence, and so can the pointers to
the next level. A word of a context is searched relative to that base value: its
successor in the level is either the word itself or proves it absent.
"""

from __future__ import annotations

import mmap
import struct
import numpy as np

STEPS, ABSENT = 24, 0  # steps of a power of ten, and the code of what is not there
BATCH = 1 << 16  # searches that share one decoded range of a level


def quantised(chances: np.ndarray) -> np.ndarray:
    """One byte for each probability; below 10 ** -10.5 all are the same."""
    return (np.clip(np.rint(-STEPS * np.log10(chances)), 0, 254) + 1).astype(np.uint8)


# What each code stands for, 0 for absence.
CHANCES = np.concatenate(([0.0], 10.0 ** (-np.arange(255) / STEPS)))


def _bits(positions: np.ndarray, bits: np.ndarray, n_words: int) -> np.ndarray:
    """Words with some bits, given by rising word positions, set."""
    out = np.zeros(n_words, dtype=np.uint64)
    if len(positions):
        first = np.flatnonzero(np.diff(positions, prepend=-1))
        out[positions[first]] = np.bitwise_or.reduceat(bits, first)
    return out


class Rising:
    """A non-decreasing sequence: low bits packed, high bits in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.width, self.low, self.high, self.before = n, width, low, high, before

    @staticmethod
    def parts(values: np.ndarray) -> list[np.ndarray]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max((top // n).bit_length() - 1, 0) if n else 0
        at = np.arange(n, dtype=np.int64)
        low = (values & ((1 << width) - 1)).astype(np.uint64)
        bit = at * width
        off = (bit & 63).astype(np.uint64)
        n_low = (n * width + 63) // 64 + 1
        packed = _bits(bit >> 6, low << off, n_low)
        over = np.flatnonzero((off + np.uint64(width) > 64) & (width > 0))
        packed |= _bits((bit[over] >> 6) + 1, low[over] >> (np.uint64(64) - off[over]), n_low)
        place = (values >> width) + at
        high = _bits(place >> 6, np.uint64(1) << (place & 63).astype(np.uint64), (int(place[-1]) >> 6) + 1 if n else 1)
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64))).astype(np.uint32 if n < 1 << 32 else np.int64)
        return [np.array([n, width], dtype=np.int64), packed, high, before]

    def __getitem__(self, span: slice) -> np.ndarray:
        """Values at places from ``start`` to before ``stop``."""
        start, stop = span.start, min(span.stop, self.n)
        if stop <= start:
            return np.zeros(0, dtype=np.int64)
        first = int(np.searchsorted(self.before, start, "right")) - 1
        last = int(np.searchsorted(self.before, stop, "left"))
        ones = np.flatnonzero(np.unpackbits(self.high[first:last].view(np.uint8), bitorder="little"))
        skip = start - int(self.before[first])
        at = np.arange(start, stop, dtype=np.int64)
        high = ones[skip:skip + stop - start] + first * 64 - at
        if not self.width:
            return high
        bit = at * self.width
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        # A shift by 64 is two shifts.
        low = (self.low[word] >> off) | ((self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - off))
        return high << self.width | (low & np.uint64((1 << self.width) - 1)).astype(np.int64)


def chained(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words that rise within groups of given sizes, made to rise throughout:
    each group starts from the last value of the one before."""
    last = np.cumsum(sizes) - 1
    top = np.where(sizes > 0, words[np.maximum(last, 0)] + 1 if len(words) else 0, 0)
    return words + np.repeat(np.cumsum(top) - top, sizes)


class Trie:
    """Words, then contexts of one word with their successors, then contexts of
    two words with theirs. Reads any buffer: a memory map of a file or of memory."""

    NAMES = ("words", "roots", "to_pairs", "pairs", "to_triples", "triples")

    def __init__(self, buffer: mmap.mmap | bytes):
        n, at = struct.unpack_from("<Q", buffer, 0)[0], 8
        arrays, body = [], at + 16 * n
        for i in range(n):
            kind, size = struct.unpack_from("<8sQ", buffer, at + 16 * i)
            dtype = np.dtype(kind.rstrip(b"\0").decode())
            arrays.append(np.frombuffer(buffer, dtype, size, body))
            body += -(-size * dtype.itemsize // 8) * 8
        levels = [Rising(int(a[0][0]), int(a[0][1]), *a[1:]) for a in (arrays[4 * i:4 * i + 4] for i in range(len(self.NAMES)))]
        self.words, self.roots, self.to_pairs, self.pairs, self.to_triples, self.triples = levels
        self.pair_code, self.pair_weight, self.triple_code = arrays[-3:]

    @staticmethod
    def laid_out(root: np.ndarray, pair_of: np.ndarray, pair: np.ndarray, pair_code: np.ndarray, pair_weight: np.ndarray, triple_of: np.ndarray, triple: np.ndarray, triple_code: np.ndarray) -> mmap.mmap:
        """The trie of sorted distinct n-grams in a memory map: words that have
        successors; pairs by place of their first word and second word; triples
        by place of their pair and third word; and their codes."""
        words = np.unique(np.concatenate((root, pair, triple)))
        n2, n3 = np.bincount(pair_of, minlength=len(root)), np.bincount(triple_of, minlength=len(pair))
        sequences = (
            words, np.searchsorted(words, root), np.concatenate(([0], np.cumsum(n2))), chained(np.searchsorted(words, pair), n2),
            np.concatenate(([0], np.cumsum(n3))), chained(np.searchsorted(words, triple), n3),
        )
        arrays = [a for s in sequences for a in Rising.parts(s.astype(np.int64))] + [pair_code, pair_weight, triple_code]
        head = struct.pack("<Q", len(arrays)) + b"".join(struct.pack("<8sQ", a.dtype.str.encode(), len(a)) for a in arrays)
        out = mmap.mmap(-1, len(head) + sum(-(-a.nbytes // 8) * 8 for a in arrays))
        out.write(head)
        for a in arrays:
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
        return out

    @staticmethod
    def _successors(level: Rising, pointers: Rising, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place in a level of each word after each context, -1 where it is not
        there; contexts must not fall."""
        out = np.full(len(context), -1, dtype=np.int64)
        for begin in range(0, len(context), BATCH):
            part = slice(begin, begin + BATCH)
            c, w = context[part], word[part]
            first = int(c[0])
            reach = pointers[first:int(c[-1]) + 2]
            lo, hi = reach[c - first], reach[c - first + 1]
            start = int(reach[0])
            values = level[max(start - 1, 0):int(reach[-1])]
            shift = start - max(start - 1, 0)
            # The base of a context is one more than the value before it, 0 at the start.
            base = np.where(lo > 0, values[np.maximum(lo - start + shift - 1, 0)] + 1, 0) if len(values) else lo * 0
            at = np.searchsorted(values[shift:], base + w) + start
            inside = at < hi
            inside[inside] = values[at[inside] - start + shift] == (base + w)[inside]
            out[part] = np.where(inside, at, -1)
        return out

    @staticmethod
    def _places(level: Rising, values: np.ndarray) -> np.ndarray:
        """Place of each value in a rising sequence, -1 where it is not there."""
        held = level[0:level.n]
        at = np.searchsorted(held, values)
        return np.where((at < len(held)) & (held[np.minimum(at, max(len(held) - 1, 0))] == values), at, -1) if len(held) else np.full(len(values), -1)

    def search(self, first: np.ndarray, second: np.ndarray, pair_of: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of sorted pairs (first, second), the weights of the pairs as
        contexts, and codes of triples (place of their pair in the question,
        third), sorted too."""
        known, w2, w3 = (self._places(self.words, x) for x in (first, second, third))
        root = self._places(self.roots, known)
        ask = np.flatnonzero((root >= 0) & (w2 >= 0))
        pair = np.full(len(first), -1, dtype=np.int64)
        pair[ask] = self._successors(self.pairs, self.to_pairs, root[ask], w2[ask])
        above = pair[pair_of]
        ask = np.flatnonzero((above >= 0) & (w3 >= 0))
        triple = np.full(len(third), -1, dtype=np.int64)
        triple[ask] = self._successors(self.triples, self.to_triples, above[ask], w3[ask])

        def codes(table: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(at >= 0, table[np.maximum(at, 0)], ABSENT).astype(np.uint8) if len(table) else np.zeros(len(at), np.uint8)

        return codes(self.pair_code, pair), codes(self.pair_weight, pair), codes(self.triple_code, triple)

