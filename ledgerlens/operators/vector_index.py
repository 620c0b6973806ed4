"""J4 at size: an inverted-list index over all vectors, searched by probing.

Lists are the cells of a spherical k-means fitted on a bounded sample; every
vector is stored in its nearest list, long lists in blocks of bounded size.  A
question probes its nearest lists and scores their vectors exactly, so the work
of a question is ``probes / lists`` of the full scan.  ``calibrate`` finds how
many probes reach a wanted recall from where the true neighbours of a bounded
number of questions lie; ``retrieval.best_units`` stays as the exact scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import retrieval as rt

SAMPLE, MAX_LISTS, LIST_ROWS = 100_000, 4096, 64
CALIBRATION, TARGET_RECALL = 200, 0.97


@dataclass(frozen=True)
class VectorIndex:
    """Stored vectors (list, block, unit, vec, vec_norm), the list centres (a bounded number), blocks a list, and rows."""

    rows: DataFrame
    centres: list[list[float]]
    blocks: dict[int, int]
    size: int


def _sample(df: DataFrame, id_col: str, n: int, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows by a hash of the id; the bound is on their expected number."""
    return df if n <= rows else df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * rows / n))


def _nearest_lists(batches: Iterator, centres, many: int, key: str) -> Iterator:
    """(key, list, place) of the ``many`` nearest centres by cosine; equal ones by number."""
    import numpy as np
    import pyarrow as pa

    c = np.array(centres)
    c = (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)).T
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
        order = np.argsort(-np.round(v @ c, 12), axis=1, kind="stable")[:, :many]
        n = order.shape[1]
        ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows))], names=[key, "list", "place"])


def nearest_lists(vectors: DataFrame, key: str, centres: list[list[float]], many: int) -> DataFrame:
    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "vec").mapInArrow(lambda bs: _nearest_lists(bs, centres, many, key), f"`{key}` {kind}, list int, place int")


def _per_list(spark: SparkSession, numbers: dict[int, int], name: str) -> DataFrame:
    """(list, number) rows for a broadcast join: ``MAX_LISTS`` rows at most, unless more lists were asked for."""
    return F.broadcast(spark.createDataFrame(list(numbers.items()), f"list int, {name} int"))


def fit_centres(vectors: DataFrame, size: int, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> list[list[float]]:
    """Centres of the lists from a sample of about ``sample`` rows, whatever the size of the table.

    By default one list for ``LIST_ROWS`` rows and root-many in a large table, ``MAX_LISTS`` at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    wanted = lists or max(1, min(MAX_LISTS, size // LIST_ROWS, int(4 * size ** 0.5)))
    rows = _sample(vectors, "unit", size, sample, seed).select(array_to_vector("vec").alias("features"))
    if wanted == 1 or size == 0:
        return [[float(x) for x in r.vec] for r in vectors.orderBy("unit").limit(1).select("vec").collect()]
    model = KMeans(k=wanted, distanceMeasure="cosine", initMode="random", maxIter=10, seed=seed).fit(rows)
    return [c.tolist() for c in model.clusterCenters()]


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, block: int = rt.UNIT_BLOCK) -> VectorIndex:
    """Index every row of ``vectors`` (unit, vec, vec_norm) at ``path`` in the shared folder.

    Rows whose norm is null, zero or not finite are not indexed, as cosine is not defined
    for them; repeated units are stored as often as they occur.  All vectors must have one length."""
    spark: SparkSession = vectors.sparkSession
    usable = vectors.where((F.col("vec_norm") > 0) & (F.col("vec_norm") < float("inf")) & F.col("unit").isNotNull())
    size = usable.count()
    centres = fit_centres(usable, size, lists, sample)
    if not centres:
        usable.select(F.lit(0).alias("list"), F.lit(0).alias("block"), "unit", "vec", "vec_norm").write.parquet(path)
        return VectorIndex(spark.read.parquet(path), [], {}, 0)

    def assign(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                found = next(_nearest_lists([b.select(["unit", "vec"])], centres, 1, "unit"))
                yield pa.RecordBatch.from_arrays([found.column(1), *b.columns], names=["list", "unit", "vec", "vec_norm"])

    staged = path + "-assigned"
    usable.select("unit", "vec", "vec_norm").mapInArrow(assign, "list int, unit string, vec array<double>, vec_norm double").write.parquet(staged)
    rows = spark.read.parquet(staged)
    blocks = {r.list: max(1, -(-r.n // block)) for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    rows.join(_per_list(spark, blocks, "blocks"), "list").withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")).drop("blocks").write.parquet(path)
    return VectorIndex(spark.read.parquet(path), centres, blocks, size)


def search(index: VectorIndex, questions: DataFrame, limit: int, probes: int, question_block: int = rt.QUESTION_BLOCK) -> DataFrame:
    """(question_id, unit, similarity): the ``limit`` best units of each question in its ``probes`` nearest lists.

    ``questions`` has question_id, vec, vec_norm.  Questions meet the blocks of
    the lists that they probe, in blocks of their own, so a list that most
    questions probe, or that holds most vectors, is many tasks.  Similarities
    are those of the exact scan; with all lists probed so is the result."""
    q = questions.where(F.col("vec_norm") > 0).select("question_id", "vec", "vec_norm")
    if not index.centres:
        return q.limit(0).select("question_id", F.lit("").alias("unit"), F.lit(0.0).alias("similarity"))
    probed = nearest_lists(q, "question_id", index.centres, probes).drop("place")
    groups = {r.list: max(1, -(-r.n // question_block)) for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    if not groups:
        return q.limit(0).select("question_id", F.lit("").alias("unit"), F.lit(0.0).alias("similarity"))
    spark = questions.sparkSession
    asking, held = _per_list(spark, groups, "groups"), _per_list(spark, index.blocks, "blocks")
    asks = probed.join(held, "list").join(asking, "list").withColumn("qb", F.pmod(F.xxhash64("question_id"), F.col("groups")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "groups").join(q, "question_id")
    units = index.rows.join(asking, "list").withColumn("first_chunk", F.col("unit")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def score(left, right):
        import pandas as pd
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"question_id": [], "unit": [], "first_chunk": [], "similarity": []})
        return rt.best_of_block(left, right, limit)

    by = ["list", "block", "qb"]
    found = asks.groupBy(*by).cogroup(units.groupBy(*by)).applyInPandas(score, rt.BLOCK_SCHEMA)
    found = found.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(64)))
    for group in (["question_id", "part"], ["question_id"]):
        w = Window.partitionBy(*group).orderBy(F.col("similarity").desc(), F.col("unit"))
        found = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return found.select("question_id", "unit", "similarity")


def calibrate(index: VectorIndex, questions: DataFrame, n_questions: int, limit: int, target: float = TARGET_RECALL, sample: int = CALIBRATION) -> int:
    """The least number of probes that holds a ``target`` share of the true neighbours of about ``sample`` questions.

    Their neighbours come from the exact scan; a neighbour is found if its list
    is among the probed ones, so one ranking of the lists serves all counts."""
    if not index.centres:
        return 1
    some = _sample(questions, "question_id", n_questions, sample, 19).where("vec_norm > 0")
    true = rt.best_units(index.rows.select("unit", "vec", "vec_norm", F.col("unit").alias("first_chunk")), some, limit)
    places = nearest_lists(some, "question_id", index.centres, len(index.centres))
    at = true.join(index.rows.select("unit", "list").distinct(), "unit").join(places, ["question_id", "list"]).groupBy("place").agg(F.count("*").alias("n")).collect()
    total, seen = sum(r.n for r in at), 0
    for r in sorted(at, key=lambda r: r.place):  # a row a list at most
        seen += r.n
        if seen >= target * total:
            return r.place + 1
    return len(index.centres)
