"""URL filters by a bit-parallel wildcard automaton.

All rules are globs over one canonical form of a URL, ``.`` + host + path. Their
states are packed side by side into words of 64 bits; a character moves all
states of all rules at once by a shift, two masks and a carry between words
(Shift-And, with wildcards as states that stay). A batch of URLs moves together.

Globs: ``**`` is any run, ``*`` any run without ``/``, ``?`` one character but
``/``; everything else stands for itself. A glob fits the whole URL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """A host suffix and a path prefix with their verdict."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        # No host holds a slash, so the first one of the URL ends the host.
        return f"*.{self.host}{self.path}**"


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)
# Hosts that carry a listed word, and kinds of files that hold no text.
WORDS = ("casino", "adult", "pills", "spam", "ads-track")
GLOBS = tuple(("block", glob) for w in WORDS for glob in (f"*{w}*", f"*{w}*/**")) + tuple(("block", f"**/**.{e}") for e in ("exe", "zip", "iso"))
DEFAULT = "allow"


class Automaton:
    """Masks of many globs: one class of characters for each that a glob names,
    and one for all others."""

    def __init__(self, globs: Sequence[str]):
        parsed = [self._parse(g) for g in globs]
        self.letters = np.array(sorted({ord(c) for lit, _ in parsed for c in lit if c != "?"} | {ord("/")}), dtype=np.uint32)
        classes, bits = len(self.letters) + 1, sum(len(lit) + 1 for lit, _ in parsed)
        self.words = -(-bits // 64)
        step, stay = np.zeros((classes, bits), dtype=bool), np.zeros((classes, bits), dtype=bool)
        start, self.ends = np.zeros((1, bits), dtype=bool), []
        slash, at = int(np.searchsorted(self.letters, ord("/"))), 0
        for lit, loops in parsed:
            start[0, at] = True
            for k, c in enumerate(lit, 1):
                if c == "?":
                    step[:, at + k] = True
                    step[slash, at + k] = False
                else:
                    step[int(np.searchsorted(self.letters, ord(c))), at + k] = True
            for k, loop in enumerate(loops):
                stay[:, at + k] = loop != ""
                if loop == "*":
                    stay[slash, at + k] = False
            self.ends.append(at + len(lit))
            at += len(lit) + 1
        self.step, self.stay, self.start = self._packed(step), self._packed(stay), self._packed(start)

    @staticmethod
    def _parse(glob: str) -> tuple[str, list[str]]:
        """Literals, and the wildcard before each and after the last."""
        literals, loops, i = [], [""], 0
        while i < len(glob):
            if glob[i] == "*":
                n = 2 if glob[i:i + 2] == "**" else 1
                loops[-1] = max(loops[-1], "*" * n)
                i += n
            else:
                literals.append(glob[i])
                loops.append("")
                i += 1
        return "".join(literals), loops

    def _packed(self, grid: np.ndarray) -> np.ndarray:
        full = np.zeros((len(grid), self.words * 64), dtype=bool)
        full[:, :grid.shape[1]] = grid
        return np.packbits(full, axis=1, bitorder="little").view(np.uint64)

    def run(self, urls: Sequence[str]) -> np.ndarray:
        """urls x globs: which fit. Long URLs go on when short ones are done."""
        codes = [np.frombuffer(u.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for u in urls]
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([codes[i] for i in order]) if len(urls) else np.zeros(0, dtype=np.uint32)
        place = np.minimum(np.searchsorted(self.letters, flat), len(self.letters) - 1)
        kind = np.where(self.letters[place] == flat, place, len(self.letters))
        down = sizes[order]
        begin = np.cumsum(down) - down
        state = np.repeat(self.start, len(urls), axis=0)
        for t in range(int(down[0]) if len(urls) else 0):
            n = int(np.searchsorted(-down, -t, side="left"))  # URLs longer than t
            c, now = kind[begin[:n] + t], state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[c]) | (now & self.stay[c])
        bits = np.unpackbits(state.view(np.uint8), axis=1, bitorder="little")[:, self.ends].astype(bool)
        out = np.empty_like(bits)
        out[order] = bits
        return out


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.position(F.lit("://"), url) + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.position(F.lit("://"), url) + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[tuple[str, str]] = GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, the longest rule that fits,
    verdict (the rule's, else that of the fitting glob with the most literals,
    blocking on a tie, else allow), and that glob.

    A NULL URL or one without ``://`` has an empty host and path, which no rule
    fits. NULL ids, repeated rows and empty tables need no care. Only the two
    named columns are read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    by_length = sorted(rules, key=lambda r: -len(r.name))
    by_weight = sorted(globs, key=lambda g: (-sum(c not in "*?" for c in g[1]), g[0] != "block"))
    automaton = Automaton([r.glob for r in by_length] + [g for _, g in by_weight])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            names, verdicts, chosen = [], [], []
            for at in range(0, len(hosts), 2048):
                fits = automaton.run([f".{h}{p}" for h, p in zip(hosts[at:at + 2048], paths[at:at + 2048], strict=True)])
                for row in fits:
                    hit = np.flatnonzero(row)
                    rule = by_length[hit[0]] if len(hit) and hit[0] < len(by_length) else None
                    glob = next((by_weight[i - len(by_length)] for i in hit if i >= len(by_length)), None)
                    names.append(rule.name if rule else None)
                    verdicts.append(rule.verdict if rule else glob[0] if glob else DEFAULT)
                    chosen.append(glob[1] if glob else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(x, pa.string()) for x in (names, verdicts, chosen))],
                                             names=["id", "host", "path", "rule", "verdict", "glob"])

    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return parsed.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, glob string").withColumnRenamed("id", id_col)
