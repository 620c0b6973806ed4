"""Sinks and the vector-index table: parquet/CSV writes with round trips
(S12, S6) and the idempotent keep-latest upsert of index rows (S16).

Output locations default to a subfolder of the shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local temporary folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-out/{name}-{uuid.uuid4().hex[:12]}"


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read back with the writer's schema: partition values are not
    re-inferred (a 'yyyy-MM' period stays a string)."""
    return spark.read.schema(schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A pre-exported CSV read with an explicit schema (no inference)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def parquet_roundtrip(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write (partitioned) parquet, read it back."""
    path = write_parquet(df, scratch_path(df.sparkSession, name), partition_by)
    return read_parquet(df.sparkSession, path, df.schema).select(*df.columns)


def csv_roundtrip(df: DataFrame, name: str) -> DataFrame:
    """S12 + S6: write CSV with a header, read it back with the schema."""
    path = write_csv(df, scratch_path(df.sparkSession, name))
    return read_csv(df.sparkSession, path, df.schema)


def upsert(existing: DataFrame, updates: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """Idempotent upsert by id — the row with the highest version wins
    (an update replaces the stored row; re-applying it changes nothing).  Of
    rows with one id and version the one whose columns hash lowest wins, so a
    rerun keeps the same row.  Each id's group holds one row per ingest, so the window stays small."""
    both = existing.unionByName(updates, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), F.xxhash64(*sorted(both.columns)), F.xxhash64(F.lit(1), *sorted(both.columns)))
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def ingest(index: DataFrame | None, chunks: DataFrame, force: bool = False, key: str = "chunk_id",
           version: str = "version") -> tuple[str, DataFrame]:
    """Reset (force), skip when already indexed, else upsert."""
    if index is None or force:
        return "success", chunks
    if index.limit(1).count() > 0:
        return "skipped", index
    return "success", upsert(index, chunks, key, version)
