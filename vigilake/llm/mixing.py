"""Mixing sources to target weights.

The words of a source are one stream, packed into blocks of fixed length. A
source gets as many slots as its target asks for, and every slot draws its
output shard, so the counts of the sources in a shard are multinomial while the
total of a source is fixed. Slot j of a source takes block p(j mod n) of its n
blocks, where p is a pseudorandom permutation of the indices that changes with
each pass over the source; the last slot is cut where the target is reached.
Slots and blocks meet in an equi-join on the block's index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilake.llm.common import SPACE_CHARS, SPACES, staged, word_count

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
MOST_COPIES = 3
ROUNDS = 16  # of the permutation
BUCKETS = 1024  # parts in which the words of a source are counted up
CHUNK = 8192  # slots made from one row
SEED = 17


def _permuted(x: str, n: str, key: str, back: bool = False) -> Column:
    """Swap-or-not: each round either keeps an index or swaps it with its mirror
    image about a hashed centre; one bit per pair decides, so a round is its own
    inverse and all rounds are a permutation of 0 .. n-1 for any n."""
    mirror = f"pmod(pmod(xxhash64({SEED}, {key}, r), {n}) - x, {n})"
    order = f"sequence({ROUNDS - 1}, 0)" if back else f"sequence(0, {ROUNDS - 1})"
    bit = f"xxhash64({SEED + 1}, {key}, r, greatest(x, {mirror})) & 1L"
    return F.expr(f"aggregate({order}, {x}, (x, r) -> if({bit} = 1L, {mirror}, x))")


def plan(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: its place, size, target, words to take, and slots.

    Sources in code point order, NULL last, weigh 1, 2, 3, repeating. A target
    above three times the source's size stops there, and what is left is shared
    again by weight. The table has one row per source name, and is one array
    while targets are found.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    listed = total.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "size"))).alias("all"))
    weighed = F.expr("transform(all, (s, i) -> named_struct('source', s.source, 'size', s.size, 'w', CAST(i % 3 + 1 AS DOUBLE), 'full', false))")
    rest = f"aggregate(a, 0D, (t, s) -> t + if(s.full, s.size - {MOST_COPIES}D * s.size, s.size))"
    weight = "aggregate(a, 0D, (t, s) -> t + if(s.full, 0D, s.w))"
    fair = f"s.w * ({rest}) / ({weight})"
    filled = (
        f"aggregate(sequence(1, greatest(size(all), 1)), all, (a, i) -> if(exists(a, s -> NOT s.full AND {fair} > {MOST_COPIES}D * s.size), "
        f"transform(a, s -> named_struct('source', s.source, 'size', s.size, 'w', s.w, 'full', s.full OR {fair} > {MOST_COPIES}D * s.size)), a))"
    )
    aimed = F.expr(f"transform(a, (s, i) -> named_struct('src', i, 'source', s.source, 'source_size', s.size, 'target', if(s.full, {MOST_COPIES}D * s.size, {fair})))")
    rows = (
        listed.where("size(all) > 0").withColumn("all", weighed).withColumn("a", F.expr(filled)).select(F.explode(aimed).alias("s")).select("s.*")
        .withColumn("want", F.round("target").cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
        .withColumn("passes", F.coalesce(F.try_divide("want", "source_size"), F.lit(0.0)).cast("long"))
        .withColumn("part", F.col("want") - F.col("passes") * F.col("source_size"))
        .withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block_words)
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.least("blocks", F.when(F.col("part") > 0, F.ceil(F.col("part") / F.lit(block_words)).cast("long") + 1).otherwise(F.lit(0).cast("long"))))
        .withColumn("short_at", F.when(F.col("blocks") > 0, _permuted("blocks - 1L", "blocks", "src, passes", back=True)))
    )
    return rows


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot: src, slot, shard, block and the words it takes."""
    shards = sources.agg(F.greatest(F.ceil(F.sum("slots") / F.lit(shard_slots)), F.lit(1)).cast("long").alias("shards")).scalar()
    # Few rows become many: the number of partitions is given, as Spark would
    # size them by the rows before, and the join below is told not to broadcast.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = (
        sources.where("slots > 0").select("src", "blocks", "passes", "part", "short", "short_at", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1L) div {CHUNK})")).alias("chunk"))
        .repartition(tasks, "src", "chunk")
    )
    upto = f"least(slots, (chunk + 1L) * {CHUNK}) - 1L"
    every = chunked.select("src", "blocks", "passes", "part", "short", "short_at", F.explode(F.expr(f"sequence(chunk * {CHUNK}, {upto})")).alias("slot"))
    lap = every.withColumn("pass", F.expr("slot div blocks")).withColumn("k", F.expr("slot % blocks"))
    begin = F.col("k") * block_words - F.when(F.col("k") > F.col("short_at"), F.lit(block_words) - F.col("short")).otherwise(F.lit(0))
    return (
        lap.withColumn("block", _permuted("k", "blocks", "src, pass"))
        .withColumn("length", F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(block_words).cast("long")))
        .withColumn("take", F.when(F.col("pass") < F.col("passes"), F.col("length")).otherwise(F.least("length", F.col("part") - begin)))
        .where("take > 0")
        .select("src", "slot", F.pmod(F.xxhash64(F.lit(SEED + 2), "src", "slot"), shards).alias("shard"), "block", "take")
    )


def placed(docs: DataFrame, sources: DataFrame, *more: str) -> DataFrame:
    """``docs`` with ``src`` and the ``offset`` of their first word in the
    stream of their source. A source is counted up in hashed parts, so that no
    task orders a whole one."""
    rows = docs.withColumnRenamed("source", "_source").join(sources.select("src", "source"), F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(SEED + 3), "id"), F.lit(BUCKETS)))
    inside = Window.partitionBy("src", "part").orderBy("id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = rows.groupBy("src", "part").agg(F.sum("size").alias("all"))
    ahead = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("src", "part", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("carried"))
    return local.join(carried, ["src", "part"]).withColumn("offset", F.col("before") + F.col("carried")).drop("part", "before", "carried")


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS, texts: bool = False) -> DataFrame:
    """The part of every block that a document fills: (src, block, offset of the
    document, id, first word in the document, lo, hi in the block), with ``texts``
    also its words joined by single spaces: a string goes through the join at
    less than half the size of an array."""
    spread = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(offset div {block_words}, (offset + size - 1) div {block_words})"))) if not texts else None
    if spread is not None:
        base = F.col("block") * block_words
        return spread.select(
            "src", "block", "offset", "id", F.greatest(base - F.col("offset"), F.lit(0)).alias("first"),
            F.greatest(F.col("offset") - base, F.lit(0)).alias("lo"), F.least(F.col("offset") + F.col("size") - base, F.lit(block_words)).alias("hi"),
        )
    words = rows.where("size > 0").withColumn("words", F.split(F.btrim("text", F.lit(SPACE_CHARS)), SPACES, -1)).drop("text")
    cut = F.expr(
        f"transform(sequence(offset div {block_words}, (offset + size - 1) div {block_words}), b -> named_struct('block', b, "
        f"'first', greatest(b * {block_words} - offset, 0L), 'lo', greatest(offset - b * {block_words}, 0L), 'hi', least(offset + size - b * {block_words}, {block_words}L), "
        f"'words', array_join(slice(words, CAST(greatest(b * {block_words} - offset, 0L) + 1 AS INT), CAST(least(offset + size - b * {block_words}, {block_words}L) - greatest(offset - b * {block_words}, 0L) AS INT)), ' ')))"
    )
    return words.select("src", "offset", "id", F.explode(cut).alias("p")).select("src", "offset", "id", "p.*")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        F.col(text_col).cast("string").alias("text"),
    )


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, and
    taken, the words of it that the mix takes, repeats counted.

    NULL and blank texts have no words and are never taken; a NULL source is one
    of its own, after all others; rows with a NULL id and repeated rows are
    documents like any. An empty table gives no rows. Other columns are not
    read, whatever their names.
    """
    rows = staged(_sized(docs, id_col, text_col, source_col).drop("text"), "sizes")
    sources = staged(plan(rows, block_words), "sources")
    where = staged(placed(rows, sources), "placed")
    met = slots(sources, block_words).hint("merge").join(pieces(where, block_words), ["src", "block"])
    words = F.least("hi", "take") - F.col("lo")
    counted = met.where(words > 0).groupBy("src", "offset").agg(F.sum(words).alias("taken"))
    some = F.when(F.col("size") > 0, F.col("offset"))  # empty documents share an offset with the next
    return (
        where.withColumn("at", some).join(counted.withColumnRenamed("offset", "at"), ["src", "at"], "left")
        .join(sources.select("src", "source_size", "target"), "src")
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, one row per piece of a document in a block: shard, source,
    slot, block, place in the block (``lo``), id, first word in the document,
    n_words, and the words joined by single spaces. Slots of a shard are ordered
    by ``turn``. The same cases as for ``taken``."""
    sized = _sized(docs, id_col, text_col, source_col)
    sources = staged(plan(sized.select("source", "size"), block_words), "sources")
    parts = pieces(placed(sized, sources, "text"), block_words, texts=True)
    met = slots(sources, block_words).hint("merge").join(parts, ["src", "block"]).withColumn("n_words", F.least("hi", "take") - F.col("lo")).where("n_words > 0")
    return met.join(sources.select("src", "source"), "src").select(
        "shard", F.xxhash64(F.lit(SEED + 4), "src", "slot").alias("turn"), F.col("source").alias(source_col), "slot", "block", "lo", F.col("id").alias(id_col),
        "first", "n_words", F.when(F.col("n_words") == F.col("hi") - F.col("lo"), F.col("words")).otherwise(
            F.expr("substring_index(words, ' ', CAST(n_words AS INT))")).alias(text_col),
    )
