"""Change capture and folder watching as Structured Streaming jobs.

Tables grow by batches: versions, actions and scanned files are only appended,
under the number of their micro-batch. The change table lies in buckets of drugs;
a manifest of the last batch says which files hold each bucket, so a batch reads
and writes the buckets of its own drugs and nothing else, whatever the size of
the tables. A bucket that has grown beyond its limit is written as two, so the
work on a touched bucket stays bounded too. Files that the manifest no longer
names are old states, readable until they are dropped. A batch reads what batches
before it wrote, so one that is run again after a failure overwrites its own
output and nothing is applied twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilake.operators import changes as ops
from vigilake.operators.skew import cut_lineage, pick
from vigilake.sources import feeds

FIRST_BITS = 3  # the table starts with 2 ** 3 buckets
BUCKET_ROWS = 1_000_000  # rows beyond which a bucket is written as two
# A bucket is the rows whose hash ends with ``bits`` bits of the number
# ``bucket``; they lie under the batch that wrote them last.
MANIFEST = "bits INT, bucket LONG, written LONG, rows LONG"


def _part(root: str, name: str, batch_id: int) -> str:
    return f"{root}/{name}/batch={batch_id}"


def _rows(spark: SparkSession, root: str, name: str, batch_id: int, schema: str) -> DataFrame:
    """All rows of the batches up to one, with the columns of their folders."""
    return spark.read.schema(f"{schema}, batch LONG").parquet(f"{root}/{name}").where(F.col("batch") <= batch_id)


def manifest(spark: SparkSession, root: str, batch_id: int) -> list[tuple[int, int, int, int]]:
    """(bits, bucket, written, rows) of every bucket after a batch. One row per
    bucket comes to the driver, some thousands for a table of any size."""
    if batch_id < 0:
        return [(FIRST_BITS, b, -1, 0) for b in range(1 << FIRST_BITS)]
    stored = spark.read.schema(MANIFEST).parquet(_part(root, "manifest", batch_id))
    return sorted((r["bits"], r["bucket"], r["written"], r["rows"]) for r in stored.collect())


def _bucket(key: str, bits: list[int]) -> Column:
    """The places (bits, bucket) where a key may lie, one for each length in use."""
    h = F.xxhash64(key)
    return F.array(*(F.struct(F.lit(b).alias("bits"), h.bitwiseAND(F.lit((1 << b) - 1)).alias("bucket")) for b in bits))


def _stored(spark: SparkSession, root: str, buckets: list[tuple[int, int, int, int]], schema: str) -> DataFrame:
    """The rows of some buckets, read from their folders alone."""
    paths = [f"{_part(root, 'changes', written)}/bits={bits}/bucket={bucket}" for bits, bucket, written, rows in buckets if rows]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, root: str, name: str, batch_id: int, schema: str) -> DataFrame:
    """A table as it was after a batch; empty before the first one."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    if name == "changes":
        last = spark.read.schema(f"{MANIFEST}, batch LONG").parquet(f"{root}/manifest").where(F.col("batch") <= batch_id).agg(F.max("batch")).first()[0]
        return _stored(spark, root, manifest(spark, root, last), schema)
    if name == "files":
        return pick(_rows(spark, root, name, batch_id, schema), ["filename"], F.col("batch")).drop("batch")
    return _rows(spark, root, name, batch_id, schema).drop("batch")


ACTIONS_SCHEMA = (
    "drug_id LONG, section STRING, source_record_id STRING, seq LONG, content_hash STRING, action STRING"
)
# A stored change knows how many versions of it were archived, so the archive is
# never read again.
STORED_SCHEMA = ops.CHANGES_SCHEMA + ", versions LONG"


def change_sink(root: str, whitelist: bool = True, bucket_rows: int = BUCKET_ROWS) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that feeds crawled rows to the change tables."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prepared = cut_lineage(ops.prepare_changes(batch, whitelist))
        known = manifest(spark, root, batch_id - 1)
        entries = spark.createDataFrame([k[:2] for k in known], "bits INT, bucket LONG")
        lengths = sorted({k[0] for k in known})
        places = prepared.select(F.explode(_bucket("drug_id", lengths)).alias("p")).select("p.*").distinct()
        touched = {(r["bits"], r["bucket"]) for r in places.join(entries, ["bits", "bucket"]).collect()}
        own = [k for k in known if k[:2] in touched]
        before = _stored(spark, root, own, STORED_SCHEMA)
        counts = before.where("versions > 0").select(*ops.CHANGE_KEY, F.col("versions").alias("version_number"))
        current, versions, actions = ops.changed_tables(before.drop("versions"), counts, prepared)
        added = versions.groupBy(*ops.CHANGE_KEY).agg(F.max("version_number").alias("added"))
        numbered = current.join(counts, ops.CHANGE_KEY, "left").join(added, ops.CHANGE_KEY, "left").withColumn(
            "versions", F.coalesce("added", "version_number", F.lit(0))).drop("added", "version_number")
        place = ["bits", "bucket"]
        rows = cut_lineage(numbered.withColumn("_at", F.explode(_bucket("drug_id", lengths))).select("*", "_at.*").drop("_at").join(
            spark.createDataFrame([k[:2] for k in own], entries.schema), place))
        sizes = {(r["bits"], r["bucket"]): r["n"] for r in rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).collect()}
        # A touched bucket with too many rows goes one bit further.
        split = [k for k, n in sizes.items() if n > bucket_rows]
        written = rows
        if split:
            full = spark.createDataFrame(split, entries.schema).withColumn("_full", F.lit(1))
            further = F.col("bits") + F.coalesce("_full", F.lit(0))
            written = rows.join(full, place, "left").withColumn("bits", further).withColumn(
                "bucket", F.expr("xxhash64(drug_id) & (shiftleft(1L, bits) - 1)")).drop("_full")
            sizes |= {(r["bits"], r["bucket"]): r["n"] for r in written.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).collect()}
        written.repartition(*place).write.mode("overwrite").partitionBy(*place).parquet(_part(root, "changes", batch_id))
        versions.write.mode("overwrite").parquet(_part(root, "versions", batch_id))
        actions.select("drug_id", "section", "source_record_id", "seq", "content_hash", "action").write.mode(
            "overwrite").parquet(_part(root, "actions", batch_id))
        halves = {(b + 1, k | half << b) for b, k in split for half in (0, 1)}
        new = [(b, k, batch_id, sizes.get((b, k), 0)) for b, k in halves | (touched - set(split))]
        kept = [k for k in known if k[:2] not in touched]
        spark.createDataFrame(kept + new, MANIFEST).coalesce(1).write.mode("overwrite").parquet(_part(root, "manifest", batch_id))

    return write


def stream_changes(source: DataFrame, root: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Crawled rows → versioned change tables; everything available once, or
    every ``interval``."""
    writer = source.writeStream.foreachBatch(change_sink(root)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
SCAN_SCHEMA = (
    "path STRING, filename STRING, mtime TIMESTAMP, size LONG, file_hash STRING, outcome STRING"
)


def folder_sink(root: str, extract: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that records new and changed files once.

    ``extract`` turns the processed files (path, filename, content) into the
    rows of the section index.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = read_version(spark, root, "files", batch_id - 1, SCAN_SCHEMA)
        state = known.select("filename", "mtime", "size", "file_hash").withColumn("status", F.lit("success"))
        named = batch.select(
            "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("modificationTime").alias("mtime"),
            F.col("length").alias("size"), F.sha2("content", 256).alias("file_hash"), "content")
        outcome = feeds.scan_outcome(named.drop("file_hash", "content"), named, state)
        processed = outcome.where("outcome = 'processed'").select("path")
        if extract is not None:
            extract(named.join(processed, "path", "left_semi")).write.mode("overwrite").parquet(
                _part(root, "sections", batch_id))
        outcome.write.mode("overwrite").parquet(_part(root, "files", batch_id))

    return write


def watch_folder(spark: SparkSession, folder: str, root: str, checkpoint: str, pattern: str = "*.pdf",
                 interval: str | None = None) -> StreamingQuery:
    """New and changed files of a folder, each processed once."""
    source = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(folder)
    )
    writer = source.writeStream.foreachBatch(folder_sink(root)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
