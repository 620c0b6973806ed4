"""Centroid clustering with Orchard's search for the nearest centroid.

Each round is one pass over the vectors: the tasks assign their vectors and
send on sums and counts per centroid and component, which Spark adds up; only
the centroids (k rows, whatever the size of the table) pass through the driver.

A vector's nearest centroid is found by walking along its present centroid's
neighbours in order of their distance.  A closer one, when met, takes over and
its own list is walked from the start; centroids met before are not measured
again.  The walk ends where a neighbour is strictly farther from the present
centroid than twice the vector's distance: by the triangle inequality none
behind it can be closer, and strictness lets equally near ones be met.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024.0, 3
SMALL = 1 << 25  # below this, squared distances and four times them fit a long for up to 1,024 components
WIDEST = 1 << 53
LONG_MAX = (1 << 63) - 1
COUNT, DISTANCE = -1, -2


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Orchard:
    """Sorted neighbour lists of the centroids; ``measured`` counts the distances that the searches took."""

    def __init__(self, centroids: list[list[int]]):
        self.k = len(centroids)
        self.wide = any(abs(x) >= SMALL for c in centroids for x in c) or (self.k and len(centroids[0]) > 1024)
        self.c = np.array(centroids, object if self.wide else np.int64).reshape(self.k, -1)
        gap = np.array([squared(self.c, c) for c in self.c]).reshape(self.k, self.k)
        ranked = []
        for i in range(self.k):
            by = sorted((j for j in range(self.k) if j != i), key=lambda j: (gap[i, j], j))
            ranked.append(by)
        self.order = np.array(ranked, np.int64).reshape(self.k, -1)
        self.gap = np.take_along_axis(gap, self.order, axis=1) if self.k else gap
        self.start = min(range(self.k), key=lambda i: (gap[i].sum(), i)) if self.k else 0
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of every row of ``x``, the smaller number among equally near ones."""
        if not self.wide and x.size and np.abs(x).max() >= SMALL:
            self.wide, self.c, self.gap = True, self.c.astype(object), self.gap.astype(object)
        if self.wide:
            x = x.astype(object)
        n = len(x)
        now = np.full(n, self.start)
        dist = squared(x, self.c[self.start])
        met = np.zeros((n, self.k), bool)
        met[:, self.start] = True
        place, live = np.zeros(n, np.int64), np.arange(n)
        self.measured += n
        while live.size:
            live = live[place[live] < self.k - 1]
            live = live[(self.gap[now[live], place[live]] <= 4 * dist[live]).astype(bool)]
            j = self.order[now[live], place[live]]
            place[live] += 1
            new = ~met[live, j]
            at, j = live[new], j[new]
            met[at, j] = True
            d = squared(x[at], self.c[j])
            self.measured += len(at)
            closer = ((d < dist[at]) | ((d == dist[at]) & (j < now[at]))).astype(bool)
            at, j = at[closer], j[closer]
            now[at], dist[at], place[at] = j, d[closer], 0
        return now, dist


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of the vectors with exactly ``dim`` components, none null or non-finite."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x * F.lit(scale), F.lit(float(WIDEST))), F.lit(-float(WIDEST))))
    return vectors.where(v.isNotNull() & (F.size(v) == dim) & F.coalesce(good, F.lit(False))).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, whole).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest hashes (null ids take no part; equal ids by components)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in rows.where("id is not null").orderBy(h, "v").limit(k).select("v").collect()]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(rows: DataFrame, centroids: list[list[int]], dim: int) -> dict[tuple[int, int], int]:
    """Per centroid: the sum of each component, the number of its vectors and their distances; k * (dim + 2) rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            x = _matrix(b.column(0), dim)
            now, dist = search.nearest(x)
            for c in np.unique(now).tolist():
                own = now == c
                part = x[own].astype(object).sum(axis=0) if search.wide else x[own].sum(axis=0)
                for i, s in [*enumerate(part.tolist()), (COUNT, int(own.sum())), (DISTANCE, sum(dist[own].tolist()))]:
                    total[c, i] = total.get((c, i), 0) + s
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in total], pa.int32()), pa.array([i for _, i in total], pa.int32()),
                                          pa.array(list(total.values()), pa.decimal128(38, 0))], names=["cluster", "part", "s"])

    partial = rows.select("v").mapInArrow(run, "cluster int, part int, s decimal(38,0)")
    return {(r.cluster, r.part): int(r.s) for r in partial.groupBy("cluster", "part").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}


def components_sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding",
            dim: int = DIM, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """Lloyd's rounds from hashed first centroids: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Vectors with exactly ``dim`` components, none null or non-finite, take part
    with floor(scale * x), held at 2^53 either way; others have no row.  Rows of
    one id are vectors of their own, and rows with a null id are clustered but
    never a first centroid.  Every round assigns each vector to its nearest
    centroid (squared Euclidean distance, ties to the smaller number) and moves
    non-empty centroids to floor(sum / count); then all are assigned once more.
    With fewer than ``k`` vectors there are fewer centroids; without any id there
    is none, and no row.  Distances beyond a long are held at its end.

    The whole-number vectors are written once to the shared folder and read once
    a round.  Driver and tasks hold ``k * dim`` numbers, and ``k * k`` neighbours.
    """
    spark = vectors.sparkSession
    path = shared_path(spark, "vectors")
    integer_vectors(vectors, id_col, vec_col, dim, scale).write.parquet(path)
    rows = spark.read.parquet(path)
    centroids = first_centroids(rows, k, seed)
    schema = "id long, cluster int, distance long"
    if not centroids:
        empty = spark.createDataFrame([], schema)
        return empty.select(F.col("id").alias(id_col), "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"),
                            F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        total = _sums(rows, centroids, dim)
        centroids = [[total[c, i] // total[c, COUNT] for i in range(dim)] if (c, COUNT) in total else old for c, old in enumerate(centroids)]
    final = _sums(rows, centroids, dim)
    hold = lambda n: min(n, LONG_MAX)
    inertia = hold(sum(s for (_, i), s in final.items() if i == DISTANCE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for b in batches:
            now, dist = search.nearest(_matrix(b.column(1), dim))
            near = [hold(d) for d in dist.tolist()] if search.wide else dist
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(now, pa.int32()), pa.array(near, pa.int64())], names=["id", "cluster", "distance"])

    per = spark.createDataFrame([(c, hold(final.get((c, DISTANCE), 0)), components_sha256(x)) for c, x in enumerate(centroids)],
                                "cluster int, cluster_inertia long, centroid_sha256 string")
    found = rows.mapInArrow(run, schema).join(F.broadcast(per), "cluster")  # k rows
    return found.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")


def plain_sql(table: str = "embeddings", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = int(SCALE), seed: int = SEED) -> str:
    """The same clustering as DuckDB SQL: every round compares every vector with every centroid."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
             FROM {table} WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS MATERIALIZED (SELECT c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c FROM v WHERE vec_id IS NOT NULL) WHERE c < {k})"]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, min((d, c)) AS b FROM (
             SELECT v.r, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i} c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT c, list(m ORDER BY i) AS v FROM (
             SELECT c, i, floor((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) / count(*))::BIGINT AS m FROM (
             SELECT b[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i} JOIN v USING (r)) GROUP BY c, i) GROUP BY c)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c0.c, coalesce(s.v, o.v) AS v FROM c0 JOIN c{i} o USING (c) LEFT JOIN s{i} s USING (c))")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(steps) + f"""
        SELECT v.vec_id, b[2]::INTEGER AS cluster, b[1]::BIGINT AS distance, sum(b[1]) OVER (PARTITION BY b[2])::BIGINT AS cluster_inertia,
               sum(b[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM {last} JOIN v USING (r) JOIN c{rounds} c ON c.c = b[2]"""
