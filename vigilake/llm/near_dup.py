"""Near-duplicate documents by circulant MinHash.

A document's shingles are put into a circle by one permutation; a second
permutation, shifted around the circle by 0, 1, 2, ... places, gives all
coordinates of the signature as minima. Coordinates are banded. Documents with
equal shingle sets form a class of which one stands for all. A class is first
compared with one hub of its bands' buckets, and links join it to a component.
Only buckets that still hold several components are looked at again, with other
hubs and in the end as a whole: the sets of an open bucket, or of two parts of a
large one, meet in a task that counts their intersections as a matrix product
and returns links between components only, never the pairs. Every link is
confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilake.llm.common import staged
from vigilake.llm.graph import components
from vigilake.llm.tokens import chunks, mixed, shingle_sets

CIRCLE = 1 << 20  # places of the circle
BANDS, ROWS = 32, 4  # a pair of similarity 0.75 shares no band with a chance of 5e-6
SHINGLE, SIMILAR = 5, 75  # words; percent
HUB_ROUNDS = 2
PART = 200_000  # shingles of a part of an open bucket, about


@lru_cache(maxsize=2)
def _circle(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation; the second with all its shifts, as a view."""
    rng = np.random.default_rng(41)
    first, second = rng.permutation(CIRCLE), rng.permutation(CIRCLE).astype(np.uint32)
    turned = np.concatenate((second, second[:coordinates - 1]))
    return first, np.lib.stride_tricks.sliding_window_view(turned, coordinates)


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the least of the second permutation, shifted by k, over
    the places of the shingles; blocks bound the memory of very long texts."""
    first, shifts = _circle(coordinates)
    places = first[(shingles >> np.uint64(44)).astype(np.int64)]
    least = np.full(coordinates, CIRCLE, dtype=np.uint32)
    for at in range(0, len(places), 4096):
        np.minimum(least, shifts[places[at:at + 4096]].min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The keys of all bands of each signature (a row)."""
    grid = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), grid.shape[:2])
    for i in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, i])
    return key


def prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell sets apart: a sum and an exclusive or of the
    shingles' hashes; 0 for an empty set."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    p, q = np.zeros((2, len(sets)), dtype=np.uint64)
    if size.any():
        every, some = np.concatenate(sets), size > 0
        first = (np.cumsum(size) - size)[some]
        p[some] = np.add.reduceat(mixed(every), first)
        q[some] = np.bitwise_xor.reduceat(mixed(every + np.uint64(1)), first)
    return p.view(np.int64), q.view(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in chunks(texts):
            yield ids[part], shingle_sets(texts[part], SHINGLE)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, prints and band keys of each set; one without shingles has no bands."""
    for ids, sets in _rows(batches):
        p, q = prints(sets)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        signed = [signature(s) for s in sets if len(s)]
        keys = band_keys(np.stack(signed)).view(np.int64).ravel() if signed else np.zeros(0, dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(size > 0) * BANDS))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(size), pa.array(p), pa.array(q), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys))],
            names=["id", "n", "p", "q", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _rows(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles"]
        )


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Units (key, x, y) of sorted rows with their ids, labels and sets."""
    unit, ids, labels, sets = None, [], [], []
    for batch in batches:
        column = batch.column(5)
        values, cut = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for i, (key, doc, label) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            if key != unit:
                if len(ids) > 1:
                    yield unit, np.array(ids), np.array(labels), sets
                unit, ids, labels, sets = key, [], [], []
            ids.append(doc)
            labels.append(label)
            sets.append(values[cut[i]:cut[i + 1]].copy())
    if len(ids) > 1:
        yield unit, np.array(ids), np.array(labels), sets


def crossing(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all components which similar sets of the rows join."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    owner, token = owner[shared], (np.cumsum(times > 1) - 1)[token[shared]]
    by = np.argsort(token, kind="stable")
    owner, token = owner[by], token[by]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
        lo, hi = np.searchsorted(token, (at, at + 4096))
        grid = np.zeros((len(sets), 4096), dtype=np.float32)
        grid[owner[lo:hi], token[lo:hi] - at] = 1
        both += grid @ grid.T
    either = size[:, None] + size[None, :] - both
    x, y = np.nonzero((100 * both >= SIMILAR * either) & (labels[:, None] < labels[None, :]))
    root = {int(label): int(label) for label in labels}

    def top(label: int) -> int:
        while root[label] != label:
            root[label] = root[root[label]]
            label = root[label]
        return label

    links = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = top(int(labels[i])), top(int(labels[j]))
        if p != q:
            root[max(p, q)] = min(p, q)
            links.append((int(ids[i]), int(ids[j])))
    return links


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, ids, labels, sets in _sets_of(batches):
        if links := crossing(ids, labels, sets):
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either"))
        .where(F.lit(100) * F.col("both") >= F.lit(SIMILAR) * F.col("either")).select("a", "b").distinct()
    )


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _close(x: str, y: str):
    """Sets whose sizes alone do not rule out a link."""
    return F.lit(100) * F.least(x, y) >= F.lit(SIMILAR) * F.greatest(x, y)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest
    id that is reachable by links), kept (the id is its component's).

    NULL, empty and blank texts have no shingles and link with nothing; so do
    rows without an id, whose component is NULL and which are kept. Repeated
    rows are one document and get equal rows. Rows of one id with several texts
    are told apart by text. Other columns are not read, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = staged(texts.mapInArrow(_sketch, "id long, n long, p long, q long, bands array<long>"), "sketch")
    classes = staged(
        sketch.where("n > 0 and id is not null").groupBy("n", "p", "q").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")),
        "classes",
    )
    labels = _labels(texts, classes)
    found = classes.join(labels, classes["rep"] == labels["node"], "left").select("n", "p", "q", F.coalesce("label", "rep").alias("component"))
    return (
        sketch.select("id", "n", "p", "q").join(found, ["n", "p", "q"], "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def _labels(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, label) of the classes that link with another."""
    spread = classes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key")
    members = staged(spread.join(shared, "key"), "members")
    sets = staged(
        texts.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(_sets, "id long, shingles array<long>"), "sets"
    )
    labels = None  # (node, label); a node without a row is alone
    for turn in range(HUB_ROUNDS + 1):
        now = members.withColumn("label", F.col("id"))
        if labels is not None:
            now = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        hub = F.min_by(F.struct("id", "n", "label"), F.struct(F.xxhash64(F.col("id"), F.lit(turn)), "id"))
        open_keys = now.groupBy("key").agg(hub.alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        if turn == HUB_ROUNDS:
            return _merged(labels, _open_links(staged(now.join(open_keys.select("key"), "key"), "open"), sets))
        # One hub per document and round: the one it shares most buckets with.
        meets = (
            now.join(open_keys.select("key", "hub"), "key").where((F.col("label") != F.col("hub.label")) & _close("n", "hub.n"))
            .groupBy("id", F.col("hub.id").alias("hub")).agg(F.count(F.lit(1)).alias("times"))
            .groupBy("id").agg(F.max_by("hub", F.struct("times", -F.col("hub"))).alias("hub"))
        )
        pairs = staged(meets.select(*_pair("id", "hub")).distinct(), "pairs")
        labels = _merged(labels, _verified(pairs, sets))


def _open_links(some: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components that an open bucket still holds. A large
    bucket is cut into parts of bounded size, and every two of them meet."""
    spark = some.sparkSession
    parts = some.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(PART)).cast("int").alias("parts"))
    dealt = some.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: (o != F.col("part")) | (F.col("parts") == 1))
    meet = F.transform(other, lambda o: F.struct(F.least(o, F.col("part")).alias("x"), F.greatest(o, F.col("part")).alias("y")))
    units = dealt.select("id", "key", "label", F.explode(meet).alias("m")).select("key", "m.x", "m.y", "id", "label")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = units.join(sets, "id").select("key", "x", "y", "id", "label", "shingles")
    return rows.repartition(tasks, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_crossing, "a long, b long").distinct()


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the links between labels, then
    the old labels carried over."""
    if labels is None:
        return components(links)
    old = labels.select(F.col("node"), F.col("label"))
    ends = links
    for end in ("a", "b"):
        ends = ends.join(old.select(F.col("node").alias(end), F.col("label").alias("l" + end)), end, "left")
    ends = staged(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct(), "ends")
    if ends.isEmpty():
        return labels
    new = components(ends).select(F.col("node").alias("label"), F.col("label").alias("next"))
    carried = old.join(new, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    # Nodes that had no label yet stand for themselves in ``new``.
    fresh = new.join(old.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("next").alias("label"))
    return staged(carried.union(fresh), "labels")
