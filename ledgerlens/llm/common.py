"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import ensure_checkpoint_dir

TEXT = "__text"
SLICE_BYTES = 4 << 20


def _give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``max_bytes`` of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // max_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            yield b.slice(int(lo), int(hi - lo))


def map_text(df: DataFrame, make: Callable[[], Callable[[list], list[pa.Array]]], new: list[tuple[str, T.DataType]],
             text_col: str = "text", keep: list[str] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Append columns that a Python function derives from whole texts, batch by batch.

    ``make()`` runs once per task and returns a function from a list of texts
    (``None`` where null) to one Arrow array per column of ``new``.  ``keep``
    names the input columns that pass through (all by default); an input
    column with the name of a new one gives way to it.  No shuffle.  The
    session's Arrow batches are limited to twice ``SLICE_BYTES``, as texts may be long.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))
    names = {n for n, _ in new}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    fields = [f for f in df.schema.fields if f.name in keep]
    src = df.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{text_col}`").cast("string").alias(TEXT))
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in new]])
    out = [f.name for f in schema.fields]

    def run(batches):
        work = make()
        for b in text_slices(batches, TEXT, slice_bytes):
            new_columns = work(b.column(TEXT).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(fields))] + new_columns, names=out)
        del work
        _give_back()

    return src.mapInArrow(run, schema)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_ranges(df: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending bounds that cut the ids into even ranges.

    One pass over the id column alone; only the bounds reach the driver.
    """
    if parts < 2:
        return []
    row = df.agg(F.percentile_approx(F.col(f"`{id_col}`").cast("long"), [i / parts for i in range(1, parts)],
                                     max(10_000, 20 * parts)).alias("b")).first()
    return sorted(set(row.b or []))


def range_of(id_col: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the id (null ids go last), in two levels of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[::step]])
    fine = F.array(*[F.lit(b).cast("long") for b in bounds])
    at = F.size(F.filter(coarse, lambda b: b <= id_col)) - 1
    inside = F.size(F.filter(F.slice(fine, at * step + 1, F.lit(step)), lambda b: b <= id_col))
    return F.when(id_col.isNull(), F.lit(len(bounds))).when(at < 0, F.lit(0)).otherwise(at * step + inside).cast("int")


@functools.cache
def word_tokenizer(path: str):
    """The tokenizers library on one core; each worker process loads a file once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class Recent:
    """Memo of what was met lately, in two generations of at most about ``limit`` entries each.

    What is met again moves to the young generation; the old one goes when the
    young one is full, so frequent keys stay and memory stays bounded.
    """

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def fill(self, keys: Iterable, make: Callable[[list], Iterable]) -> Callable:
        """Make sure that all keys are known, and return their lookup; ``make`` gives the values of new keys."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        missing = set(keys).difference(self.young)
        if missing:
            old = self.old
            again = {k: old[k] for k in missing if k in old}
            self.young.update(again)
            new = [k for k in missing if k not in again]
            if new:
                self.young.update(zip(new, make(new)))
        return self.young.__getitem__

