"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a few tokens in a row that ignores some of them, so
a substituted word at an ignored place leaves the hash alone. The masked hashes
of the corpus are looked up among those of the benchmark; around every hit the
two texts are aligned without gaps, and the longest stretch with enough equal
tokens is taken. Items shorter than a mask are hashed whole, by length, and
looked up among the windows of that length.

The words of many texts are hashed and looked up at once; only texts that a seed
hits are looked at one by one. The benchmark's hashes go to the tasks in slices of a fixed size, one pass over
the corpus for each, so their number is not limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilake.llm.common import staged
from vigilake.llm.tokens import chunks, mixed, powers, word_hashes

# Nine tokens of which six count.
MASKS = ("110101011", "101100111", "111010011")
LEAST_EQUAL, LEAST_SHARE = 10, 0.75  # equal tokens of a stretch, and their share
SLICE_TOKENS = 1 << 20  # of the benchmark per pass: 8 MB of hashes, and their seeds


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked tokens at every place where the mask fits."""
    n = max(len(words) - len(mask) + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j, power in zip((j for j, c in enumerate(mask) if c == "1"), powers(len(mask)), strict=False):
        out += words[j:j + n] * power
    return mixed(out + np.uint64(int(mask, 2)))


def longest(same: np.ndarray) -> tuple[int, int]:
    """(begin, end) of the longest stretch of which LEAST_SHARE are equal, the
    first of several, without the unequal places at its ends.

    Equal places score 1 and others -3, so a stretch has the share when its sum
    is not negative. No stretch with the share has more equal places: one of n
    goes on over n // 3 others, or over everything, before its share is lost.
    """
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -round(LEAST_SHARE / (1 - LEAST_SHARE))))))
    # The earliest start with a sum not above the end's.
    least = np.minimum.accumulate(sums)
    first = np.searchsorted(-least, -sums, "left")
    stop = int(np.argmax(np.arange(len(sums)) - first))
    own = np.flatnonzero(same[first[stop]:stop])
    return (int(first[stop] + own[0]), int(first[stop] + own[-1]) + 1) if len(own) else (0, 0)


class Places:
    """An index of hashes, and all places of each."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray):
        by = np.argsort(hashes, kind="stable")
        distinct, self._first, self._times = np.unique(hashes[by], return_index=True, return_counts=True)
        self._index, self._places = pd.Index(distinct), places[by]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their entries in the index."""
        entry = self._index.get_indexer(hashes)
        hit = np.flatnonzero(entry >= 0)
        return hit, entry[hit]

    def of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of some entries in a row, and how many each has."""
        times = self._times[entries]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return self._places[np.repeat(self._first[entries], times) + nth], times


class Benchmark:
    """Tokens of some items, and where each seed occurs."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.words, counts = word_hashes(texts)
        self.start = np.concatenate(([0], np.cumsum(counts)))
        self.owner = owner = np.repeat(np.arange(len(ids)), counts)
        self.seeded = {}
        for mask in MASKS:
            h = seeds(self.words, mask)
            inside = owner[:len(h)] == owner[len(mask) - 1:] if len(h) else np.zeros(0, dtype=bool)
            at = np.flatnonzero(inside)
            self.seeded[mask] = Places(h[at], at)
        self.short = {}
        for n in map(int, np.unique(counts[(counts > 0) & (counts < len(MASKS[0]))])):
            items = np.flatnonzero(counts == n)
            self.short["1" * n] = Places(seeds(self.words, "1" * n)[self.start[items]], items)

    def overlaps(self, words: np.ndarray, counts: np.ndarray) -> Iterator[list[tuple[int, int, int, int, int]]]:
        """For each of the texts whose words these are, in order: (item, begin,
        end, equal tokens, begin in the item) of the best stretch of each item
        that reaches the limits."""
        ends = np.cumsum(counts)
        begins = ends - counts
        some = np.zeros(len(counts), dtype=bool)
        found = []
        for mask, places in (*self.seeded.items(), *self.short.items()):
            hit, entry = places.lookup(seeds(words, mask))
            # Those of a text: the mask fits into it.
            lo = np.searchsorted(hit, begins)
            hi = np.maximum(np.searchsorted(hit, ends - len(mask), "right"), lo)
            some |= hi > lo
            found.append((mask, places, hit, entry, lo, hi))
        for i, any_hit in enumerate(some.tolist()):
            if not any_hit:
                yield []
                continue
            own = [(mask, places, hit[lo[i]:hi[i]] - begins[i], entry[lo[i]:hi[i]]) for mask, places, hit, entry, lo, hi in found if hi[i] > lo[i]]
            yield self._best(words[begins[i]:ends[i]], own)

    def _best(self, words: np.ndarray, found: list[tuple[str, Places, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
        """The best stretches in one text, by the hits of each mask in it."""
        best: dict[int, tuple] = {}
        for item, shift in self._diagonals([f for f in found if f[0] in self.seeded]):
            lo, hi = self.start[item], self.start[item + 1]
            begin, end = max(shift, 0), min(shift + hi - lo, len(words))
            same = words[begin:end] == self.words[lo + begin - shift:lo + end - shift]
            first, stop = longest(same)
            equal = int(same[first:stop].sum())
            enough = min(LEAST_EQUAL, int(hi - lo))
            if equal >= enough:
                stretch = (equal, -(begin + first), stop - first, begin + first - shift)
                if item not in best or stretch > best[item]:
                    best[item] = stretch
        # The first copy of each item shorter than a mask.
        for mask, places, hit, entry in found:
            if mask in self.short:
                said, first = np.unique(entry, return_index=True)
                items, times = places.of(said)
                for item, begin in zip(items.tolist(), np.repeat(hit[first], times).tolist(), strict=True):
                    best[item] = len(mask), -begin, len(mask), 0
        return [(item, -at, -at + size, equal, place) for item, (equal, at, size, place) in sorted(best.items())]

    def _diagonals(self, found: list[tuple[str, Places, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
        """(item, place of its first token in the text) of every hit, once."""
        keys = []
        for _, places, hit, entry in found:
            where, times = places.of(entry)
            item = self.owner[where]
            keys.append(np.stack((item, np.repeat(hit, times) - (where - self.start[item])), axis=1))
        if keys:
            yield from map(tuple, np.unique(np.concatenate(keys), axis=0).tolist())


def _slices(items: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in slices of at most SLICE_TOKENS tokens, or one item."""
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        n = len(row["text"].split())
        if ids and size + n > SLICE_TOKENS:
            yield Benchmark(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item"])
        texts.append(row["text"])
        size += n
    if ids:
        yield Benchmark(ids, texts)


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns."""
    at = docs.columns.index(text_col)

    def without(part: Benchmark) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                texts, keep = batch.column(at).to_pylist(), []
                for cut in chunks(texts):
                    keep += [not found for found in known.overlaps(*word_hashes(texts[cut]))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    for part in _slices(_items(benchmark, item_col, item_text)):
        docs = without(part)
    return docs


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs`` and benchmark item that overlap: id, item,
    the stretch of words (begin, end) in the document, begin in the item, equal
    tokens, share of equal tokens, and share of the item they cover.

    A stretch needs 10 equal tokens (an item with fewer: all of its own) and
    three quarters equal; of those that a seed hits, the one with the most equal
    tokens is told, without the unequal ones at its ends; of items shorter than
    a mask, the first copy. NULL and empty texts match nothing. Repeated rows
    give repeated results, NULL ids rows with NULL ids. Other columns are not
    read, whatever their names.
    """
    items = _items(benchmark, item_col, item_text)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item long, begin long, end long, item_begin long, equal long, share double, covered double"

    def passed(part: Benchmark) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                ids, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = []
                for cut in chunks(own):
                    for doc, found in zip(ids[cut], known.overlaps(*word_hashes(own[cut])), strict=True):
                        for item, begin, end, equal, place in found:
                            size = int(known.start[item + 1] - known.start[item])
                            rows.append((doc, known.ids[item], begin, end, place, equal, equal / (end - begin), equal / size))
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = [pa.int64()] * 6 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

        return texts.mapInArrow(run, schema)

    found = None
    for part in _slices(items):
        rows = staged(passed(part), "overlaps")
        found = rows if found is None else found.union(rows)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})
