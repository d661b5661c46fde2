"""Importance resampling of a corpus towards a target distribution.

Words are hashed to buckets; the bucket counts of corpus and target give each
bucket a gain, a document's weight is the sum of the gains of its words, held in
one array. A seeded Gumbel draw on top makes the highest scores a sample without
replacement. The cutoff of the draw comes from a quantile sketch: two quantiles
bracket it, exact counts above and inside tell whether it lies between them or
the bracket must widen, and only the rows inside are sorted to find it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilake.llm.common import staged

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
ACCURACY = 10_000  # of the sketch: a quantile is off by a share of 1/ACCURACY at most
# A-Z lower-cased, every other ASCII character that is no letter or digit a blank.
WORDS = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, none for NULL."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def buckets_of(words: Sequence[bytes], longest: int, buckets: int) -> np.ndarray:
    """Bucket of every run of 1 to ``longest`` words, by the CRC-32 of its bytes."""
    parts = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
    for n in range(2, longest + 1):
        runs = map(b" ".join, zip(*(islice(words, j, None) for j in range(n)), strict=False))
        parts.append(np.fromiter(map(zlib.crc32, runs), np.uint32))
    return (np.concatenate(parts) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts each bucket holds. A task
    sends one row per bucket, whatever it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(buckets_of(words_of(text.as_py()), longest, buckets), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket in thousandths, from the counts of both sides.
    One row per bucket comes to the driver: ``buckets`` bounds them."""
    s, t = ([0] * buckets, [0] * buckets)
    for held, counts in ((s, corpus), (t, target)):
        for row in counts.collect():
            held[row["bucket"]] = row["n"]
    below, above = sum(s) + buckets, sum(t) + buckets
    return np.array([
        math.floor(1000 * math.log(float((b + 1) * below) / float((a + 1) * above))) for a, b in zip(s, t, strict=True)
    ], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features and weight."""
    kind, buckets = docs.schema[id_col].dataType, len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = buckets_of(words, longest, buckets)
                rows.append((len(words), len(found), int(gain[found].sum())))
            columns = np.array(rows, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[:, j]) for j in range(3))], names=["id", "n_words", "n_features", "weight"])

    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return pairs.mapInArrow(run, f"id {kind.simpleString()}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id; NULL ids hash as
    the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """All rows with their place, from 1, in an order: ranges of it are sorted in
    a task each, and the sizes of the ranges before are added."""
    own = rows.columns
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(
        sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").select(*own, (F.col("_before") + F.col("_place") + 1).alias(name))


def bracket(rows: DataFrame, score: str, n: int, k: int, accuracy: int = ACCURACY, margin: float | None = None) -> tuple[int, int, int]:
    """(low, high, above): scores between which the ``k``-th highest of ``n``
    lies, and how many rows score above them. The sketch's quantiles are not
    trusted: the rows outside are counted, and a bracket that misses is widened
    until it holds the cutoff; it ends with all scores."""
    reach = 2.0 / accuracy if margin is None else margin
    while True:
        at = 1 - k / n
        ends = rows.agg(F.percentile_approx(score, [max(at - reach, 0.0), min(at + reach, 1.0)], accuracy).alias("q"), F.min(score).alias("least"), F.max(score).alias("most")).first()
        low = ends["least"] if reach >= 1 or at - reach <= 0 else ends["q"][0]
        high = ends["most"] if reach >= 1 or at + reach >= 1 else ends["q"][1]
        told = rows.agg(F.count_if(F.col(score) > high).alias("above"), F.count_if(F.col(score) >= low).alias("upto")).first()
        if told["above"] < k <= told["upto"]:
            return low, high, told["above"]
        reach = max(4 * reach, 4.0 / accuracy)


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST_RUN, buckets: int = BUCKETS,
    seed: int = SEED, accuracy: int = ACCURACY, margin: float | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank.

    Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn, those
    with the highest scores, ties to the smaller id; they get ranks from 1, the
    others none. NULL texts have no features and weight 0; NULL ids come after all
    others in a tie; repeated rows score alike and are drawn one by one. Empty
    tables, also an empty target, need no care. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, longest, buckets, text_col), bucket_counts(target, longest, buckets, text_col), buckets)
    scores = weighted(docs, gain, longest, id_col, text_col).withColumn("score", F.col("weight") + noise(id_col, seed))
    rows = staged(scores, "scores")
    may = F.col("n_words") >= least_words
    n = rows.where(may).count()
    k = percent * n // 100
    shown = [id_col, "n_features", "weight", "score"]
    if k == 0:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last()]
    low, high, above = bracket(rows.where(may), "score", n, k, accuracy, margin)
    inside = may & F.col("score").between(low, high)
    found = ranked(rows.where(inside), order, "place")
    drawn = rows.where(may & (F.col("score") > high)).select(*shown).union(found.where(F.col("place") <= k - above).select(*shown))
    rest = rows.where(~may | (F.col("score") < low)).select(*shown).union(found.where(F.col("place") > k - above).select(*shown))
    return ranked(drawn, order).union(rest.withColumn("rank", F.lit(None).cast("long")))
