"""Which of many keywords a text holds, in one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

# Characters of all keywords that an automaton may hold; some 50 bytes each.
MOST = 2_000_000
# So few keywords are looked for one by one, without rows going to Python.
FEW = 16


@lru_cache(maxsize=2)
def _automaton(keywords: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k in keywords:
        found.add_word(k, k)
    found.make_automaton()
    return found


def with_keywords(texts: DataFrame, column: str, keywords: DataFrame, out: str = "keywords", most: int = MOST) -> DataFrame:
    """The rows that hold a keyword, with the distinct keywords each holds.

    ``keywords`` has one text column, blank ones match nothing. All keywords are
    looked for at once, a character of a text is read once whatever their number.
    They are dealt to slices of at most ``most`` characters, one pass each; a
    concern table fits one, so more passes are for tables of another size.
    """
    words = keywords.select(F.col(keywords.columns[0]).alias("k")).where("k <> ''").distinct()
    size = words.agg(F.sum(F.length("k"))).first()[0] or 0
    few = [r["k"] for r in words.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        held = [F.when(F.contains(F.col(column), F.lit(k)), F.lit(k)) for k in sorted(few)]
        found = F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")
        return texts.withColumn(out, found).where(F.size(out) > 0)
    slices = -(-size // most)
    if slices > 1:
        # Twice as many, as a hash does not deal evenly.
        words = words.withColumn("s", F.pmod(F.xxhash64("k"), F.lit(2 * slices)))
    at, kept = texts.columns.index(column), list(texts.columns)
    schema = StructType([*texts.schema.fields]).add(out, ArrayType(StringType()))

    def one_pass(part: DataFrame) -> DataFrame:
        held = tuple(sorted(r["k"] for r in part.select("k").collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(held)
            for batch in batches:
                said = [sorted({k for _, k in automaton.iter(t)}) if t else [] for t in batch.column(at).to_pylist()] if held else [[]] * batch.num_rows
                hit = pa.array([bool(s) for s in said], pa.bool_())
                rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.list_(pa.string()))], names=[*kept, out])
                yield rows.filter(hit)

        return texts.mapInArrow(run, schema)

    if slices <= 1:
        return one_pass(words)
    out_rows = None
    for s in range(2 * slices):
        part = one_pass(words.where(F.col("s") == s))
        out_rows = part if out_rows is None else out_rows.unionByName(part)
    return out_rows
