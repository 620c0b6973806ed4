"""Incremental ingest with Structured Streaming.

New document files landing in a folder are cleaned and chunked (S14, X7),
then merged into the chunk index by the keep-latest upsert (S16) inside
``foreachBatch``.  The index is dealt into buckets by document.  A batch
writes only the buckets it touches, as new files, and then publishes a
manifest that names the files of every bucket; nothing published is written
again.  A batch that failed before its manifest is run anew from the manifest
of the batch before it, so a restarted job neither duplicates nor loses chunks,
and readers see one batch or the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..sources import sinks

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
INDEX_SCHEMA = "chunk_id string, doc_id bigint, section string, text string, version bigint"
BUCKETS = 64


def chunk_batch(docs: DataFrame, version: int) -> DataFrame:
    pages = chunking.clean_pages(docs.select("doc_id", "source", "text"))
    c = chunking.chunk_text(pages, extra=["source"])
    return c.select("chunk_id", "doc_id", "section", "text", F.lit(version).cast("long").alias("version"))


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names inside a folder; none if there is no such folder.  Any other failure is raised."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def manifest(spark: SparkSession, index_root: str, before: int | None = None) -> dict[int, str]:
    """Bucket -> batch folder, from the newest complete manifest (of a batch before ``before``); empty if there is none."""
    root = f"{index_root}/manifest"
    done = [n for n in _names(spark, root) if (before is None or int(n) < before) and "_SUCCESS" in _names(spark, f"{root}/{n}")]
    if not done:
        return {}
    return {r["bucket"]: r["batch"] for r in spark.read.schema("bucket int, batch string").parquet(f"{root}/{done[-1]}").collect()}


def _read(spark: SparkSession, index_root: str, files: dict[int, str]) -> DataFrame | None:
    paths = [f"{index_root}/data/{batch}/bucket={b}" for b, batch in sorted(files.items())]
    return spark.read.schema(INDEX_SCHEMA).parquet(*paths) if paths else None


def latest_index(spark: SparkSession, index_root: str) -> DataFrame | None:
    """The published index, or None before the first batch."""
    return _read(spark, index_root, manifest(spark, index_root))


def publish(spark: SparkSession, index_root: str, batch: str, files: dict[int, str]) -> None:
    rows = spark.createDataFrame(sorted(files.items()), "bucket int, batch string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{index_root}/manifest/{batch}")


def merge_batch(docs: DataFrame, batch_id: int, index_root: str, buckets: int = BUCKETS) -> None:
    """Upsert the chunks of ``docs`` and publish the result; running it again gives the same index."""
    spark, name = docs.sparkSession, f"{batch_id:012d}"
    files = manifest(spark, index_root, before=batch_id)
    # at most ``buckets`` rows
    touched = {r[0] for r in docs.select(bucket_of(buckets)).distinct().collect()}
    if not touched:
        return
    new = chunk_batch(docs, batch_id)
    old = _read(spark, index_root, {b: f for b, f in files.items() if b in touched})
    merged = (new if old is None else sinks.upsert(old, new)).withColumn("bucket", bucket_of(buckets))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{index_root}/data/{name}")
    written = {int(n.removeprefix("bucket=")): name for n in _names(spark, f"{index_root}/data/{name}") if n.startswith("bucket=")}
    publish(spark, index_root, name, files | written)


def start(spark: SparkSession, input_dir: str, index_root: str, checkpoint: str, available_now: bool = True,
          buckets: int = BUCKETS):
    """Start the ingest stream; returns the StreamingQuery.  ``buckets`` stays the same for the life of an index."""
    stream = spark.readStream.schema(DOC_SCHEMA).parquet(input_dir)
    w = stream.writeStream.foreachBatch(lambda docs, batch_id: merge_batch(docs, batch_id, index_root, buckets))
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
