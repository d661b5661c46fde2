"""Words and shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

# Bytes worked on at once; bounds the memory of a task whatever the batch is.
CHUNK = 1 << 20
BLOCK = 1 << 16  # bytes hashed at once, or one word; small enough for the processor's cache
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BYTE[_SPACE] = 0


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def chunks(texts: Sequence[str | None], most: int = CHUNK) -> Iterator[slice]:
    """Slices of a batch of at most ``most`` characters, or of one text."""
    begin = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > begin and size + n > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if len(texts) > begin:
        yield slice(begin, len(texts))


def _turned(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step, and of its inverse, for ``n`` places."""
    back = np.full(n, pow(int(_STEP), -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    return powers(n), np.cumprod(back, dtype=np.uint64)


@lru_cache(maxsize=1)
def _turned_block() -> tuple[np.ndarray, np.ndarray]:
    """The same for all but blocks that end in a very long word."""
    return _turned(2 * BLOCK)


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of some bytes: the sum of its bytes'
    numbers, each times a power by its place in the word. Powers go by the place
    in the data and are turned back by where a word begins; spaces count nothing."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), begin
    power, back = _turned_block() if len(data) <= 2 * BLOCK else _turned(len(data))
    sums = np.add.reduceat(_BYTE[data] * power[:len(data)], begin) * back[begin]
    return mixed(sums + (end - begin).astype(np.uint64)), begin


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts in order, and the
    number of words of each text. Long inputs are cut at spaces."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    hashes, begins, at = [], [], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        h, b = _hash_words(data[at:stop])
        hashes.append(h)
        begins.append(b + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    b = np.concatenate(begins) if begins else np.zeros(0, dtype=np.int64)
    ends = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(b, ends)
    return h, np.diff(np.concatenate(([0], upto)))


def shingle_sets(texts: Sequence[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: runs of ``size`` words, or the
    whole sequence where there are fewer; none without words."""
    h, counts = word_hashes(texts)
    power = powers(size)
    runs = np.zeros(max(len(h) - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        runs += mixed(h[j:j + len(runs)]) * power[j]
    runs = mixed(runs)
    out, at = [], 0
    for n in map(int, counts):
        if n >= size:
            out.append(np.unique(runs[at:at + n - size + 1]))
        elif n:
            whole = (mixed(h[at:at + n]) * power[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mixed(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out
