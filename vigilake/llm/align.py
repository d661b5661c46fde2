"""Alignment of two tokenizers' tokens over the same bytes.

Texts are parted where neither tokenizer can join what lies on both sides, so
each distinct part is tokenized once per task and all else is counted in arrays.
In a part, the character offsets of the one tokenizer and the spans of the other
are coarse cuts; tokens whose span is not as long as their own bytes (shares of a
multibyte character, bytes that stand for unknown characters, the added space)
are placed by their decoded bytes.

A task turns some documents at a time into one row: their figures, their linked
id pairs, packed, and the distinct pairs with the number of documents that hold
them. The distinct pairs are summed over the corpus and joined back by pair, so
no table of pairs is held whole anywhere.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vigilake.llm.common import staged
from vigilake.llm.packing import pack, unpack

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 4 << 20  # characters of documents that one row is made of, or one document
UNIT = 256  # parts tokenized in one go
BLOCK = 1 << 16  # parts of a text worked on at once
KNOWN, KNOWN_TOKENS = 600_000, 8 << 20  # parts a worker remembers, and their tokens


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself where
    it is printable, else the next of those from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ends(begin: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte at which each token ends: its span's end where the span is as long
    as the token's bytes, else where the bytes so far end."""
    at = np.cumsum(sizes)
    return np.where((end - begin == sizes) & (begin == at - sizes), end, at)


def linked(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping pairs as ``a << 32 | b``, in order, the ends of either kind,
    where one token of each lies before each, and the ends both have."""
    every = np.union1d(a_ends, b_ends)
    i, j = np.searchsorted(a_ends, every), np.searchsorted(b_ends, every)
    return a[i].astype(np.int64) << 32 | b[j], every, every[(a_ends[i] == every) & (b_ends[j] == every)]


def _parts(pieces: Iterable[str]) -> tuple[str, str]:
    """White space before which a text may be cut, and the pattern of the parts of a text that are tokenized alone.

    The byte-level pattern never joins white space to what is before it, nor a
    letter or digit to punctuation after it. The other tokenizer only joins
    characters that some piece has side by side. A part ends where both hold:
    before a blank or line break, and before ASCII punctuation after a letter.
    """
    beside = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
    cuts = " " * all(b[0] == "▁" for b in beside if b[1] == "▁") + "\n" * (not any(b[1] == "\n" for b in beside))
    marks = "".join(c for c in string.punctuation if c != "_" and not any(b[1] == c and b[0].isalnum() for b in beside))
    if not cuts or not marks:
        return "", r"(?s).+"
    word, other, stay = r"[^\W_]", r"(?:[^\s\w]|_)", rf"(?:(?![{re.escape(marks)}])[^\s\w]|_)"
    body = rf"{other}*+(?:{word}++(?:{stay}{other}*+)?+)*+"
    return cuts, rf"\s*+{body}(?:[^\S{cuts}]\s*+{body})*+"


class Aligner:
    """Both tokenizers and the parts of texts a worker has seen."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        # The space that the tokenizer adds is part of what it is given here.
        model = sentencepiece_model_pb2.ModelProto.FromString(pieces)
        model.normalizer_spec.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.a_size = np.zeros(max(self.a_bytes) + 1, dtype=np.int64)
        for i, t in self.a_bytes.items():
            self.a_size[i] = len(t)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.cuts, pattern = _parts(n for i, n in enumerate(names) if not self.b.is_byte(i))
        self.part = re.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pair_ids: dict[int, int] = {}
        self.pair_keys = array("q")
        self.n_a, self.n_b, self.n_groups, self.good = array("q"), array("q"), array("q"), array("b")
        self.pairs, self.upto, self.groups = array("q"), array("q", [0]), []

    def learn(self, parts: Sequence[str]) -> None:
        """Tokenize and align parts of texts. Parts are joined where a text may
        be cut, since one long call costs far less than many short ones."""
        joined = [p for p in parts if p[0] in self.cuts and not p[-1].isspace()]
        alone = set(parts).difference(joined)
        self._learn([joined[i:i + UNIT] for i in range(0, len(joined), UNIT)] + [[p] for p in sorted(alone)])

    def _learn(self, units: list[list[str]]) -> None:
        texts = ["".join(u) for u in units]
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        found = self.a.encode_batch(texts, add_special_tokens=False)
        told = self.b.encode(texts, return_type="offset_mapping", return_bytes=True, num_threads=1)

        def flat(lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
            many = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), np.int64, int(many.sum())), many

        def spans(lists: list[list]) -> np.ndarray:
            return np.fromiter(chain.from_iterable(chain.from_iterable(lists)), np.int64).reshape(-1, 2)

        a, n_a = flat([x.ids for x in found])
        b, n_b = flat([x["ids"] for x in told])
        # Characters to bytes, in the texts written one after the other.
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        byte_of = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)))
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum(size) - size
        a_spans = byte_of[spans([x.offsets for x in found]) + np.repeat(np.cumsum(chars) - chars, n_a)[:, None]]
        b_spans = spans([x["offsets"] for x in told]) + np.repeat(base, n_b)[:, None]
        a_size, b_size = self.a_size[a], self.b_size[b]

        def total(values: np.ndarray, many: np.ndarray) -> np.ndarray:
            upto, stop = np.concatenate(([0], np.cumsum(values))), np.cumsum(many)
            return upto[stop] - upto[stop - many]

        good = (total(a_size, n_a) == size) & (total(b_size, n_b) == size)
        for ids, many, table in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            if b"".join(map(table.__getitem__, ids[np.repeat(good, many)].tolist())) != b"".join(compress(raws, good.tolist())):
                upto = np.cumsum(many)
                for k in np.flatnonzero(good).tolist():
                    good[k] = b"".join(map(table.__getitem__, ids[upto[k] - many[k]:upto[k]].tolist())) == raws[k]
        bad = [u for u, g in zip(units, good.tolist(), strict=True) if not g]
        self._keep([u for u, g in zip(units, good.tolist(), strict=True) if g], *(
            (ids[own], spans_[own] - np.repeat(base - (np.cumsum(size * good) - size * good), many)[own][:, None], sizes[own])
            for ids, spans_, sizes, many in ((a, a_spans, a_size, n_a), (b, b_spans, b_size, n_b)) for own in (np.repeat(good, many),)))
        # Bytes that differ are those of one part; a part alone has no tokens then.
        if again := [[p] for u in bad if len(u) > 1 for p in u]:
            self._learn(again)
        for part in (u[0] for u in bad if len(u) == 1):
            self._add([part], np.zeros((4, 1), dtype=np.int64), [""], False)

    def _keep(self, units: list[list[str]], first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...]) -> None:
        """Align the tokens (ids, spans, sizes) of texts whose bytes they are."""
        parts = list(chain.from_iterable(units))
        if not parts:
            return
        (a, a_spans, a_size), (b, b_spans, b_size) = first, second
        a_ends, b_ends = ends(a_spans[:, 0], a_spans[:, 1], a_size), ends(b_spans[:, 0], b_spans[:, 1], b_size)
        keys, every, common = linked(a, a_ends, b, b_ends)
        stop = np.cumsum(np.fromiter((len(p.encode("utf-8", "surrogatepass")) for p in parts), np.int64, len(parts)))
        if not np.isin(stop, common).all():
            raise AssertionError("a token crosses the end of a part")
        # Groups as text: the tokens of either side up to each common end.
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip(np.searchsorted(a_ends, common, "right").tolist(), np.searchsorted(b_ends, common, "right").tolist(), strict=True):
            groups.append((a_text[i] if x == i + 1 else ",".join(a_text[i:x])) + "|" + (b_text[j] if y == j + 1 else ",".join(b_text[j:y])))
            i, j = x, y
        known, inverse = np.unique(keys, return_inverse=True)
        numbers = np.empty(len(known), dtype=np.int64)
        for n, key in enumerate(known.tolist()):
            numbers[n] = i = self.pair_ids.setdefault(key, len(self.pair_keys))
            if i == len(self.pair_keys):
                self.pair_keys.append(key)
        counts = np.stack([np.diff(np.searchsorted(x, stop, "right"), prepend=0) for x in (a_ends, b_ends, common, every)])
        self.pairs.frombytes(numbers[inverse].tobytes())
        upto = np.cumsum(counts[2]).tolist()
        self._add(parts, counts, [";".join(groups[x:y]) for x, y in zip([0, *upto], upto, strict=False)], True)

    def _add(self, parts: list[str], counts: np.ndarray, groups: list[str], good: bool) -> None:
        self.known.update(zip(parts, range(len(self.good), len(self.good) + len(parts)), strict=True))
        self.good.frombytes(np.full(len(parts), good, dtype=np.int8).tobytes())
        for kept, values in zip((self.n_a, self.n_b, self.n_groups), counts, strict=False):
            kept.frombytes(values.tobytes())
        self.upto.frombytes((np.cumsum(counts[3]) + self.upto[-1]).tobytes())
        self.groups += groups

    def split(self, text: str) -> Iterator[list[str]]:
        """The parts of a text, in blocks."""
        if len(text) <= BLOCK:
            yield [p for p in self.part.findall(text) if p]  # the last match is empty
            return
        found = self.part.finditer(text)
        while parts := [m[0] for m in islice(found, BLOCK) if m[0]]:
            yield parts

    def indexed(self, text: str | None) -> tuple[np.ndarray, str]:
        """Known part at each place of the text, and the digest of its groups;
        nothing where the tokens' bytes are not those of the text."""
        if not text:
            return np.zeros(0, dtype=np.int64), ""
        out, digest, started = [], hashlib.sha256(), False
        for parts in self.split(" " + text):
            new = sorted(p for p in set(parts) if p not in self.known)
            if new:
                self.learn(new)
            at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
            if not np.frombuffer(self.good, np.int8)[at].all():
                return np.zeros(0, dtype=np.int64), ""
            digest.update(((";" if started else "") + ";".join(map(self.groups.__getitem__, at.tolist()))).encode())
            started = True
            out.append(at)
        return np.concatenate(out), digest.hexdigest()

    def chunk(self, texts: Sequence[str | None]) -> dict:
        """Figures of some documents and the pairs they hold."""
        if len(self.known) > KNOWN or len(self.pairs) > KNOWN_TOKENS:
            self.forget()
        read = [self.indexed(t) for t in texts]
        at = np.concatenate([r[0] for r in read]) if read else np.zeros(0, dtype=np.int64)
        sizes = np.array([len(r[0]) for r in read], dtype=np.int64)

        def summed(values: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(values)))
            stop = np.cumsum(sizes)
            return total[stop] - total[stop - sizes]

        upto = np.frombuffer(self.upto, np.int64)
        n_pairs, n = np.diff(upto), max(len(self.good), 1)
        # Distinct parts of each document, then all their pairs.
        key, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + at, return_counts=True)
        doc, part = key // n, key % n
        many = n_pairs[part] if len(part) else part
        place = np.repeat(upto[part] - (np.cumsum(many) - many), many) + np.arange(many.sum()) if len(part) else part
        pair = np.frombuffer(self.pairs, np.int64)[place] if len(place) else place
        held, local = np.unique(pair, return_inverse=True)
        keys = np.frombuffer(self.pair_keys, np.int64)[held] if len(held) else held
        order = np.argsort(keys)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        key = np.repeat(doc, many) * max(len(held), 1) + rank[local]
        by = np.argsort(key, kind="stable")
        key, weight = key[by], np.repeat(times, many)[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        totals = np.add.reduceat(weight, first) if len(first) else weight
        key = key[first]
        doc, pair = key // max(len(held), 1), key % max(len(held), 1)
        return {
            "n_a": summed(np.frombuffer(self.n_a, np.int64)[at]), "n_b": summed(np.frombuffer(self.n_b, np.int64)[at]),
            "n_groups": summed(np.frombuffer(self.n_groups, np.int64)[at]), "n_links": summed(n_pairs[at]), "groups_sha256": [r[1] for r in read],
            "links": pack(np.bincount(doc, minlength=len(sizes)), np.where(np.diff(doc, prepend=-1) != 0, pair, np.diff(pair, prepend=0)), totals),
            "pairs": keys[order], "held_by": np.bincount(pair, minlength=len(held)),
        }


@lru_cache(maxsize=1)
def _aligner(byte_level: bytes, pieces: bytes) -> Aligner:
    return Aligner(byte_level, pieces)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def chunked(docs: DataFrame, folder: str = FOLDER, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for some documents: chunk, ids, their figures and digests, links
    (packed pair places and counts), pairs (sorted) and held_by."""
    with open(f"{folder}/{BYTE_LEVEL}", "rb") as file:
        byte_level = file.read()
    with open(f"{folder}/{PIECES}", "rb") as file:
        pieces = file.read()
    kind = docs.schema[id_col].dataType.simpleString()

    def row(ids: list, texts: list, name: str) -> pa.RecordBatch:
        told = _aligner(byte_level, pieces).chunk(texts)
        one = [pa.array([name]), pa.array([pa.concat_arrays(ids)], pa.list_(ids[0].type))]
        one += [pa.array([told[c]], pa.list_(pa.int64())) for c in FIGURES]
        one += [pa.array([told["groups_sha256"]], pa.list_(pa.string())), pa.array([told["links"]], pa.binary())]
        one += [pa.array([told[c]], pa.list_(pa.int64())) for c in ("pairs", "held_by")]
        return pa.RecordBatch.from_arrays(one, names=["chunk", "ids", *FIGURES, "groups_sha256", "links", "pairs", "held_by"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n, made = [], [], 0, 0
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                ids.append(batch.column(0).slice(i, 1))
                texts.append(text.as_py())
                n += len(texts[-1] or "")
                if n >= size:
                    yield row(ids, texts, f"{TaskContext.get().partitionId()}-{made}")
                    ids, texts, n, made = [], [], 0, made + 1
        if ids:
            yield row(ids, texts, f"{TaskContext.get().partitionId()}-{made}")

    shape = f"chunk string, ids array<{kind}>, " + ", ".join(f"{c} array<long>" for c in FIGURES)
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return pairs.mapInArrow(run, shape + ", groups_sha256 array<string>, links binary, pairs array<long>, held_by array<long>")


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, count, best) of rows (pair, held_by): how many documents hold the
    pair, and whether no other pair of its first id is held by more."""
    counts = held.groupBy("pair").agg(F.sum("held_by").alias("count")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, folder: str = FOLDER, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    NULL and empty texts and those whose tokens have other bytes have no tokens.
    NULL ids and repeated rows are documents like others; empty tables give no
    rows. Other columns are not read. A document is held whole by one task; the
    work on it is done in blocks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = staged(chunked(docs, folder, size, id_col, text_col), "aligned")
    held = rows.select("chunk", F.posexplode(F.arrays_zip("pairs", "held_by")).alias("place", "one")).select("chunk", "place", F.col("one.pairs").alias("pair"), F.col("one.held_by").alias("held_by"))
    # One row per chunk, whose pairs are bounded by its size.
    told = held.join(pair_counts(held), "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "count", "best"))).alias("told"))
    told = told.select("chunk", F.col("told.count").alias("count"), F.col("told.best").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i] for c in batch.schema.names}
                many, pair, times = unpack(one["links"].as_py())
                stop = np.cumsum(many)
                total = np.concatenate(([0], np.cumsum(pair)))
                # Places are differences within a document.
                pair = total[1:] - np.repeat(total[stop - many], many)
                count, best = (np.asarray(one[c].values.to_numpy(zero_copy_only=False)) if one[c].is_valid else np.zeros(0, np.int64) for c in ("count", "best"))

                def summed(values: np.ndarray, stop=stop, many=many) -> pa.Array:
                    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
                    return pa.array(total[stop] - total[stop - many])

                yield pa.RecordBatch.from_arrays([
                    one["ids"].values, *(one[c].values for c in FIGURES), summed(times * best[pair].astype(np.int64)), summed(times * count[pair].astype(np.int64)), one["groups_sha256"].values,
                ], names=["id", *FIGURES, "n_best", "count_sum", "groups_sha256"])

    shape = f"id {kind}, " + ", ".join(f"{c} long" for c in (*FIGURES, "n_best", "count_sum")) + ", groups_sha256 string"
    joined = rows.drop("pairs", "held_by").join(told, "chunk", "left")
    return joined.mapInArrow(run, shape).withColumnRenamed("id", id_col)
