"""Structured Streaming ingest: document batches land in a folder; the index
ends up with every chunk once, also after a batch that failed before it was
published, and only touched buckets are written."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import chunking
from ledgerlens.streaming import ingest


def _run(spark, root):
    q = ingest.start(spark, f"{root}/in/*", f"{root}/index", f"{root}/ckpt", buckets=8)
    q.awaitTermination()


def _chunk_ids(df):
    return sorted(r[0] for r in df.select("chunk_id").collect())


def test_stream_ingest_survives_a_failed_batch(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = _chunk_ids(chunking.chunk_text(chunking.clean_pages(docs.select("doc_id", "text"))))
    assert ingest.latest_index(spark, f"{root}/index") is None
    docs.where(F.col("doc_id") < 100).write.parquet(f"{root}/in/b1")
    _run(spark, root)
    before = _chunk_ids(ingest.latest_index(spark, f"{root}/index"))
    assert before and set(before) < set(want)

    docs.where(F.col("doc_id") >= 100).write.parquet(f"{root}/in/b2")
    real = ingest.publish

    def fail(*_):
        raise OSError("lost before publishing")

    monkeypatch.setattr(ingest, "publish", fail)
    with pytest.raises(Exception, match="lost before publishing"):
        _run(spark, root)
    assert _chunk_ids(ingest.latest_index(spark, f"{root}/index")) == before

    monkeypatch.setattr(ingest, "publish", real)
    _run(spark, root)
    assert _chunk_ids(ingest.latest_index(spark, f"{root}/index")) == want
    _run(spark, root)
    assert _chunk_ids(ingest.latest_index(spark, f"{root}/index")) == want


def test_merge_replaces_chunks_and_writes_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ingest.merge_batch(docs, 0, root, buckets=8)
    first = ingest.manifest(spark, root)
    one = docs.where(F.col("doc_id") == 3)
    ingest.merge_batch(one, 1, root, buckets=8)
    ingest.merge_batch(one, 1, root, buckets=8)
    second = ingest.manifest(spark, root)
    assert sum(first[b] != second[b] for b in first) == 1
    index = ingest.latest_index(spark, root)
    assert {r["version"] for r in index.where("doc_id = 3").select("version").collect()} == {1}
    assert {r["version"] for r in index.where("doc_id <> 3").select("version").distinct().collect()} == {0}
    assert len(_chunk_ids(index)) == len(set(_chunk_ids(index)))


def test_an_unreadable_index_is_not_taken_for_none(spark, tmp_path):
    root = str(tmp_path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(5)
    ingest.publish(spark, root, "000000000000", {b: "missing" for b in range(8)})
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ingest.merge_batch(docs, 1, root, buckets=8)
