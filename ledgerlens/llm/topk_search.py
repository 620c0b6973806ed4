"""Exact top-k inner products by pivot-table elimination.

Pivots are vectors of the table, each the farthest from those before it within a
bounded sample.  Every vector's distances to them are computed once and travel
with it.  For a query q, a candidate c and any pivot p, |d(q, p) - d(c, p)| is a
lower bound of d(q, c); the maximum over the pivots nearest to q, which give the
largest bounds, bounds the inner product
(|q|^2 + |c|^2 - d^2) / 2 from above.  Candidates are evaluated in the order of
that bound until it falls below the k-th best score found, so nothing that could
matter is skipped.  That score starts at the query's k-th best within the
sample, for all blocks alike.

Queries meet candidates in blocks of bounded size: a task holds one block of
each, and the best k of each pair of blocks are merged afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, NEAR, SAMPLE, BLOCK, QUERIES = 128, 32, 2048, 4096, 1024
EXACT = float(1 << 53)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def pivots_of(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it; the first is the longest vector."""
    if not len(sample):
        return sample
    at = [int((sample * sample).sum(axis=1).argmax())]
    near = ((sample - sample[at[0]]) ** 2).sum(axis=1)
    while len(at) < n and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    return sample[at]


def _exact_ints(x: np.ndarray) -> bool:
    return bool(x.size == 0 or np.abs(x).max() ** 2 * max(1, x.shape[1]) < EXACT)


def pivot_table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, in single precision; ``search_block`` allows for its rounding."""
    d2 = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0)).astype(np.float32)


def kth_in_sample(queries: np.ndarray, q_ids: np.ndarray, sample: np.ndarray, s_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the sample's other ids; minus infinity where it has fewer, or beyond exact doubles."""
    if len(sample) < k or not len(queries) or not _exact_ints(queries) or not _exact_ints(sample):
        return np.full(len(queries), -np.inf)
    score = np.where(q_ids[:, None] == s_ids[None, :], -np.inf, queries @ sample.T)
    return np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k]


def search_block(queries: np.ndarray, q_ids: np.ndarray, cands: np.ndarray, c_ids: np.ndarray, k: int, q_table: np.ndarray | None = None,
                 c_table: np.ndarray | None = None, least: np.ndarray | None = None, counted: list | None = None) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of the k best candidates of each query in this block, none below ``least``.

    ``q_table`` and ``c_table`` hold the distances to the pivots (found in the block if not given); ``counted`` takes the candidates evaluated."""
    if not _exact_ints(queries) or not _exact_ints(cands):  # integers beyond what doubles hold: exact, without bounds
        out = []
        exact = [[int(v) for v in c] for c in cands.tolist()]
        for q, i in zip(queries.tolist(), q_ids.tolist()):
            q = [int(v) for v in q]
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for c, j in zip(exact, c_ids.tolist()) if j != i)[:k]
            out += [(i, j, min(max(-s, LONG_MIN), LONG_MAX)) for s, j in found]
        return out
    by_id = np.argsort(c_ids, kind="stable")  # equal scores then rank by smaller id
    if q_table is None or c_table is None:
        pivots = pivots_of(cands[:SAMPLE])
        q_table, c_table = pivot_table(queries, pivots), pivot_table(cands, pivots)
    cands, c_ids, c_table = cands[by_id], c_ids[by_id], c_table[by_id]
    qn, cn = (queries * queries).sum(axis=1), (cands * cands).sum(axis=1)
    out = []
    for i, q in enumerate(queries):
        p = np.argpartition(q_table[i], NEAR - 1)[:NEAR] if c_table.shape[1] > NEAR else slice(None)
        lower = np.abs(c_table[:, p] - q_table[i, p]).max(axis=1, initial=0).astype(np.float64)
        slack = 1e-6 * (1 + qn[i] + cn)  # rounding in the table never hides a candidate
        upper = (qn[i] + cn - lower * lower) / 2 + slack
        open_ = np.flatnonzero((c_ids != q_ids[i]) & (upper >= (-np.inf if least is None else least[i])))
        order = open_[np.argsort(-upper[open_], kind="stable")]
        score, place, at, step = np.zeros(0), np.zeros(0, np.int64), 0, max(64, 4 * k)
        while at < len(order) and (len(score) < k or upper[order[at]] >= score[-1]):
            part = order[at:at + step]
            score, place = np.concatenate([score, cands[part] @ q]), np.concatenate([place, part])
            best = np.lexsort((place, -score))[:k]
            score, place, at, step = score[best], place[best], at + step, step * 2
        if counted is not None:
            counted.append(min(at, len(order)))
        out += zip([int(q_ids[i])] * len(place), c_ids[place].tolist(), score.astype(np.int64).tolist())
    return out


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def top_k(vectors: DataFrame, k: int = 5, is_query: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 256.0, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """The ``k`` candidates with the highest integer inner product for each query: (query_id, rank, vec_id, score).

    Components become floor(scale * x); queries are the rows where ``is_query``
    holds (ids divisible by 50 if not given), candidates all rows with another
    id.  Ties go to the smaller id; a query with fewer candidates gets all.  Rows
    with a null id and vectors that are null, empty or hold null or non-finite
    components take no part; only vectors of equal length are compared; scores
    beyond the range of a long are held at its ends.  Repeated rows of an id are
    one candidate each, and a repeated query is asked once.  An empty table
    gives an empty result.
    """
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    asked = (F.col("id") % 50 == 0) if is_query is None else is_query
    rows = src.where(F.col("id").isNotNull() & usable(F.col("v"))).select(
        "id", F.transform("v", lambda x: _floor(x * F.lit(float(scale)))).alias("v"),
        F.size("v").alias("dim"))
    # the sample that pivots and first thresholds come from: at most SAMPLE rows, the first by hash
    some = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
    samples = {d: (np.array([r.v for r in some if r.dim == d], np.float64), np.array([r.id for r in some if r.dim == d], np.int64)) for d in {r.dim for r in some}}
    pivots = {d: pivots_of(v) if _exact_ints(v) else v[:0] for d, (v, _) in samples.items()}

    def tabled(batches):
        for b in batches:
            dims, ids, at = b.column(2).to_numpy(), b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy()
            flat, start = b.column(1).flatten().to_numpy(), np.cumsum(at) - at
            table, least = [None] * len(ids), np.full(len(ids), -np.inf)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                x = flat[start[own][:, None] + np.arange(d)]
                if d in pivots and _exact_ints(x):
                    for j, t in zip(own.tolist(), pivot_table(x, pivots[d])):
                        table[j] = t
                if d in samples and b.column(3).to_numpy(zero_copy_only=False)[own].any():
                    asks_here = own[b.column(3).to_numpy(zero_copy_only=False)[own]]
                    least[asks_here] = kth_in_sample(flat[start[asks_here][:, None] + np.arange(d)], ids[asks_here], *samples[d], k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(table, pa.list_(pa.float32())), pa.array(least)], names=["id", "v", "dim", "asked", "t", "least"])

    rows = rows.select("id", "v", "dim", F.coalesce(asked, F.lit(False)).alias("asked")).mapInArrow(
        tabled, "id long, v array<double>, dim int, asked boolean, t array<float>, least double")
    queries = rows.where("asked").dropDuplicates(["id", "v"])
    n = rows.agg(F.count(F.lit(1)).alias("c"), F.count_if("asked").alias("q")).first()
    c_blocks, q_blocks = max(1, -(-n.c // block)), max(1, -(-n.q // query_block))
    # every block of queries meets every block of candidates: the work asked for, in tasks of bounded size
    cands = rows.withColumn("cb", F.pmod(F.xxhash64("id", "v"), F.lit(c_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asks = queries.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(q_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            q, c = (np.asarray(t["v"].combine_chunks().flatten(), np.float64).reshape(-1, dim) for t in (left, right))
            tables = (None, None)
            if left["t"].null_count + right["t"].null_count == 0:
                tables = tuple(np.asarray(t["t"].combine_chunks().flatten(), np.float32).reshape(t.num_rows, -1) for t in (left, right))
            found = search_block(q, left["id"].to_numpy(), c, right["id"].to_numpy(), k, *tables, left["least"].to_numpy())
        cols = list(zip(*found)) if found else [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols)})

    by = ["dim", "cb", "qb"]
    best = asks.groupBy(*by).cogroup(cands.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floor(x: Column) -> Column:
    """Floor that stays a double, also beyond the range of a long."""
    return F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x)
