"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is rotated at random and kept as its signs, with the correction
factor f, its inner product with its own normalised code. For a rotated unit
query q the product of q and code, g, gives the unbiased estimate g / f of the
cosine, and the bound f g + sqrt(1 - f^2) sqrt(1 - g^2), which no cosine exceeds.
Pairs whose bound stays below the limit are settled by the code; all others are
recomputed exactly in double precision.

Equal vectors form a class. Classes are dealt to blocks by hash, and a pair of
blocks is one unit of work of fixed size that returns sums of links and one row
per linked class, never the pairs. Every pair of classes is looked at, so no
link is lost; the codes' work grows with the square of the number of classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vigilake.llm.common import staged
from vigilake.llm.graph import components

LIMIT = 0.9
BLOCK = 8192  # classes of a block, about
SEED = 9


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, packed signs, and the correction factors."""
    rotated = unit @ turn
    signs = rotated >= 0
    factor = np.abs(rotated).sum(axis=1) / np.sqrt(unit.shape[1])
    return rotated, np.packbits(signs, axis=1), factor


def _norms(raw: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", raw, raw))


def links_between(a: np.ndarray, b: np.ndarray, limit: float = LIMIT, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b`` with a cosine of at least ``limit``; with
    ``same`` each pair of one block once."""
    d = a.shape[1]
    turn = rotation(d)
    na, nb = _norms(a), _norms(b)
    query = ((a / na[:, None]) @ turn).astype(np.float32)
    _, packed, factor = encode(b / nb[:, None], turn)
    code = ((np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1) / np.sqrt(d)).astype(np.float32)
    f = np.clip(factor, 0, 1)
    # The bound is the cosine of the difference of the two angles, so it reaches
    # the limit where g reaches the cosine of the sum of the code's angle and the limit's.
    least = np.cos(np.minimum(np.arccos(f) + np.arccos(limit), np.pi)) - 1e-4
    for at in range(0, len(a), 512):
        g = query[at:at + 512] @ code.T
        i, j = np.nonzero(g >= least.astype(np.float32))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), 1 << 16):
            x, y = i[cut:cut + (1 << 16)], j[cut:cut + (1 << 16)]
            exact = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
            yield x[exact >= limit], y[exact >= limit]


def _pair(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
    """Of one pair of blocks: for every row with a link the sum of its links'
    members, and one row that names its component here."""
    columns = ["node", "links", "to"]
    if not len(left) or not len(right):
        return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in columns})
    a = np.stack(left["v"].to_numpy()).astype(np.float64)
    b = a if same else np.stack(right["v"].to_numpy()).astype(np.float64)
    ids = np.concatenate((left["rep"], right["rep"])) if not same else left["rep"].to_numpy()
    many = np.concatenate((left["many"], right["many"])) if not same else left["many"].to_numpy()
    offset = 0 if same else len(left)
    total, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    for x, y in links_between(a, b, same=same):
        y = y + offset
        np.add.at(total, x, many[y])
        np.add.at(total, y, many[x])
        # Roots fall until both ends of every link have the same.
        while True:
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, before[x], low)
            np.minimum.at(root, before[y], low)
            root = root[root]
            if np.array_equal(root, before):
                break
    some = np.flatnonzero(total)
    return pd.DataFrame({"node": ids[some], "links": total[some], "to": ids[root[some]]}, columns=columns)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors that are NULL, empty, zero or hold NULL, NaN or infinite components
    link with nothing, nor do vectors of different lengths with one another.
    Rows without an id have no component and are kept. Repeated rows are
    vectors of their own that link. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)
    rows = staged(rows.select("id", F.when(F.coalesce(good, F.lit(False)), F.col("v")).alias("v")), "vectors")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many"))
    classes = staged(classes.select("rep", "many", "v", F.size("v").alias("d")), "classes")
    count = classes.count()
    blocks = max(1, -(-count // BLOCK))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(blocks)).cast("int"))
    # Every block meets itself and, once, every other of its length.
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    meets = F.transform(others, lambda o: F.struct(F.least(o.cast("int"), F.col("block")).alias("x"), F.greatest(o.cast("int"), F.col("block")).alias("y")))
    sent = dealt.withColumn("meet", F.explode(meets)).select("d", "meet.x", "meet.y", "block", "rep", "many", "v")

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        return _pair(part[part["block"] == x], part[part["block"] == y], x == y)

    found = staged(sent.groupBy("d", "x", "y").applyInPandas(work, "node long, links long, to long"), "links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    told = (
        classes.join(degree, classes["rep"] == degree["node"], "left").drop("node").join(labels, F.col("rep") == F.col("node"), "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component"))
    )
    return rows.join(told, "v", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
