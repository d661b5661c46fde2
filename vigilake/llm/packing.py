"""Lists of integers as compact bytes, to travel between tasks.

A list goes in the smaller of two forms, compressed. One has all first bytes of
the values, then all second ones, and so on. The other has each value's number of
bits, as a byte, and then the bits below the first one, of all values of a length
side by side; it suits long lists whose small values are frequent, and is only
tried on those.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

LONG = 1 << 16


def _lengths(values: np.ndarray) -> np.ndarray:
    """Number of bits of each value, 0 for 0."""
    rest, out = values.copy(), np.zeros(len(values), dtype=np.uint8)
    for step in (32, 16, 8, 4, 2, 1):
        more = rest >= np.uint64(1) << np.uint64(step)
        out[more] += step
        rest[more] >>= np.uint64(step)
    return out + (values > 0).astype(np.uint8)


def _low_bits(values: np.ndarray, n: int) -> bytes:
    bits = np.empty((len(values), n), dtype=np.uint8)
    for j in range(n):
        bits[:, j] = (values >> np.uint64(j)) & np.uint64(1)
    return np.packbits(bits, bitorder="little").tobytes()


def _planes(values: np.ndarray) -> bytes:
    width = max(-(-int(values.max()).bit_length() // 8), 1) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<BQ", width, len(values)) + planes.tobytes()


def _by_length(values: np.ndarray) -> bytes:
    lengths = _lengths(values)
    low = (_low_bits(values[lengths == n], n - 1) for n in range(2, int(lengths.max()) + 1))
    return struct.pack("<BQ", 0, len(values)) + lengths.tobytes() + b"".join(low)


def pack(*lists: np.ndarray) -> bytes:
    """Some lists of non-negative integers below 2 ** 64."""
    small = zstandard.ZstdCompressor(level=1).compress
    parts = []
    for values in lists:
        values = values.astype(np.uint64)
        form = small(_planes(values))
        if len(values) >= LONG and 255 < values.max() < 1 << 32:
            form = min(form, small(_by_length(values)), key=len)
        parts.append(struct.pack("<Q", len(form)) + form)
    return b"".join(parts)


def _unpacked(raw: bytes) -> np.ndarray:
    width, size = struct.unpack_from("<BQ", raw)
    at = struct.calcsize("<BQ")
    if width:
        values = np.zeros((size, 8), dtype=np.uint8)
        values[:, :width] = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size).T
        values = values.view("<u8").reshape(-1).astype(np.uint64)
        return values if width == 8 else values.astype(np.int64)
    lengths = np.frombuffer(raw, np.uint8, size, at)
    at += size
    values = (lengths > 0).astype(np.uint64)
    for n in range(2, int(lengths.max()) + 1):
        own = np.flatnonzero(lengths == n)
        many = -(-len(own) * (n - 1) // 8)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, many, at), count=len(own) * (n - 1), bitorder="little").reshape(len(own), n - 1)
        at += many
        low = np.zeros(len(own), dtype=np.uint64)
        for j in range(n - 1):
            low |= bits[:, j].astype(np.uint64) << np.uint64(j)
        values[own] = low | np.uint64(1) << np.uint64(n - 1)
    return values if lengths.max() > 56 else values.astype(np.int64)


def unpack(stored: bytes) -> list[np.ndarray]:
    """The lists again, as uint64 where values may need it, else as int64."""
    at, out = 0, []
    while at < len(stored):
        size = struct.unpack_from("<Q", stored, at)[0]
        out.append(_unpacked(zstandard.ZstdDecompressor().decompress(stored[at + 8:at + 8 + size])))
        at += 8 + size
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of a rising list, the first value first."""
    return np.diff(values, prepend=values[:1] * 0)
