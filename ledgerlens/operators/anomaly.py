"""D3: isolation-forest anomalies on daily sales, per entity.

MLlib has no isolation forest.  Trees grow from a bounded pool of an entity's
rows, chosen by hash; a tree is a small table of nodes.  An entity with few rows
grows and scores in one group; the forest of a longer one travels to blocks of
its rows, so no entity becomes one task.  The cut is an exact quantile from counts
of scores.  Randomness is seeded from (entity, tree) and rows are chosen by their
values, so the result does not depend on partitioning, task order or block size."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Tasks get these functions by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The reference's settings.
FEATURES = ["total_sales", "cash", "online", "credit"]
N_TREES = 100
MAX_SAMPLES = 256
CONTAMINATION = 0.12
MIN_ROWS = 10
SEED = 42
# An entity's trees draw from about POOL of its different rows; a group holds at most about BLOCK rows.
POOL, BLOCK = 4096, 65_536
BUCKETS = 4096

ROW = "entity bigint, date date, total_sales double, cash double, online double, credit double, copies bigint"
FOREST = "entity bigint, blk int, psi int, root array<int>, feature array<int>, split array<double>, left array<int>, path array<double>"


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow(pool: np.ndarray, entity: int, n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES, seed: int = SEED) -> dict:
    """A forest as one table of nodes: the feature (-1: leaf), where it splits, the left child (the right one follows), and a leaf's path length."""
    psi = min(max_samples, len(pool))
    limit = int(math.ceil(math.log2(max(psi, 2))))
    root, feature, split, left, path = [], [], [], [], []

    def node():
        for column, value in ((feature, -1), (split, 0.0), (left, -1), (path, 0.0)):
            column.append(value)
        return len(feature) - 1

    for t in range(n_trees):
        rng = np.random.default_rng([seed, entity & 0x7FFFFFFF, t])
        root.append(node())
        stack = [(root[-1], pool[rng.choice(len(pool), size=psi, replace=False)], 0)]
        while stack:
            at, pts, depth = stack.pop()
            usable = []
            if depth < limit and len(pts) > 1:
                lo, hi = pts.min(axis=0), pts.max(axis=0)
                usable = np.nonzero(hi > lo)[0]
            if len(usable) == 0:
                path[at] = depth + _c(len(pts))
                continue
            f = int(rng.choice(usable))
            feature[at], split[at] = f, float(rng.uniform(lo[f], hi[f]))
            below = pts[:, f] < split[at]
            left[at] = node()
            stack += [(left[at], pts[below], depth + 1), (node(), pts[~below], depth + 1)]
    return {"psi": psi, "root": root, "feature": feature, "split": split, "left": left, "path": path}


def score(forest: dict, x: np.ndarray) -> np.ndarray:
    """Isolation scores of the rows of ``x``."""
    feature, split, left, path = (np.asarray(forest[k]) for k in ("feature", "split", "left", "path"))
    rows, depth = np.arange(len(x)), np.zeros(len(x))
    for root in forest["root"]:
        at = np.full(len(x), root)
        while (inner := feature[at] >= 0).any():
            here = at[inner]
            at[inner] = left[here] + (x[rows[inner], feature[here]] >= split[here])
        depth += path[at]
    mean = depth / max(1, len(forest["root"]))
    return 2.0 ** (-mean / _c(forest["psi"])) if forest["psi"] > 1 else np.full(len(x), 0.5)


def _numbers(rows: pd.DataFrame) -> np.ndarray:
    return rows[FEATURES].fillna(0.0).to_numpy(dtype=float)


def _pool(rows: pd.DataFrame) -> np.ndarray:
    return _numbers(rows[rows["in_pool"]].sort_values(["date", *FEATURES]))


def _cuts(scored: DataFrame, share: float) -> DataFrame:
    """(entity, cut): the interpolated quantile of each entity's scores, exactly.

    Scores are counted by value and by bucket; the buckets that hold the two ranks
    in question are found from the counts, and only their values are put in order."""
    by_value = scored.groupBy("entity", "anomaly_score").agg(F.sum("copies").alias("c")).withColumn("bucket", F.floor(F.col("anomaly_score") * BUCKETS))
    w = Window.partitionBy("entity").orderBy("bucket")
    whole = Window.partitionBy("entity")
    buckets = by_value.groupBy("entity", "bucket").agg(F.sum("c").alias("c")).select(
        "entity", "bucket", "c", (F.sum("c").over(w) - F.col("c")).alias("before"), ((F.sum("c").over(whole) - 1) * F.lit(share)).alias("pos"))
    ranks = buckets.select("entity", "bucket", "c", "before", "pos", F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("rank"))
    wanted = ranks.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c"))).select("entity", "bucket", "before", "pos", "rank").distinct()
    inside = Window.partitionBy("entity", "bucket", "rank").orderBy("anomaly_score")
    at = by_value.join(wanted, ["entity", "bucket"]).withColumn("upto", F.col("before") + F.sum("c").over(inside)).where(F.col("upto") > F.col("rank"))
    ends = at.groupBy("entity", "pos", "rank").agg(F.min("anomaly_score").alias("v")).groupBy("entity", "pos").agg(
        F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    t = F.col("pos") - F.floor("pos")
    step = F.col("b") - F.col("a")
    return ends.select("entity", F.when(t >= 0.5, F.col("b") - step * (F.lit(1.0) - t)).otherwise(F.col("a") + step * t).alias("cut"))


def anomaly_iforest(daily: DataFrame, n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES, contamination: float = CONTAMINATION,
                    min_rows: int = MIN_ROWS, seed: int = SEED, pool: int = POOL, block: int = BLOCK) -> DataFrame:
    """Per entity with at least ``min_rows`` days: isolation score and the
    Normal/Anomaly flag (the top ``contamination`` share of scores).

    Null amounts count 0; rows without an entity are left out.  Equal rows of an
    entity get one score, count once in the pool and each in the cut."""
    ensure_checkpoint_dir(daily.sparkSession)
    rows = daily.where("entity is not null").groupBy(F.col("entity").cast("long").alias("entity"), "date", *FEATURES).agg(F.count(F.lit(1)).alias("copies"))
    counts = rows.groupBy("entity").agg(F.sum("copies").alias("days"), F.count(F.lit(1)).alias("n")).where(F.col("days") >= min_rows).drop("days")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    by_hash = F.pmod(F.xxhash64(F.lit(seed), "entity", "date", *FEATURES), F.lit(1 << 30))
    rows = rows.join(counts, "entity").select(
        "entity", "date", *FEATURES, "copies", (by_hash < F.lit(float(1 << 30)) * F.lit(pool) / F.col("n")).alias("in_pool"), blocks.alias("blocks"),
        F.pmod(F.xxhash64("date", *FEATURES, F.lit(seed + 1)), blocks).cast("int").alias("blk"))
    columns = ["entity", "date", *FEATURES, "copies"]

    def scored_rows(rows: pd.DataFrame, forest: dict) -> pd.DataFrame:
        return rows[columns].assign(anomaly_score=score(forest, _numbers(rows)))

    def few(rows: pd.DataFrame) -> pd.DataFrame:
        return scored_rows(rows, grow(_pool(rows), int(rows["entity"].iloc[0]), n_trees, max_samples, seed))

    def forest_of(rows: pd.DataFrame) -> pd.DataFrame:
        entity = int(rows["entity"].iloc[0])
        forest = grow(_pool(rows), entity, n_trees, max_samples, seed)
        return pd.DataFrame([{"entity": entity, "blk": int(rows["blocks"].iloc[0]), **forest}])

    def many(rows: pd.DataFrame, forests: pd.DataFrame) -> pd.DataFrame:
        return scored_rows(rows, forests.iloc[0].to_dict()) if len(rows) else pd.DataFrame(columns=[*columns, "anomaly_score"])

    short = rows.where("blocks = 1").groupBy("entity").applyInPandas(few, ROW + ", anomaly_score double")
    long = rows.where("blocks > 1")
    forests = long.where("in_pool").groupBy("entity").applyInPandas(forest_of, FOREST).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blk") - 1)))
    by_block = long.groupBy("entity", "blk").cogroup(forests.groupBy("entity", "blk")).applyInPandas(many, ROW + ", anomaly_score double")
    scored = short.unionByName(by_block).checkpoint()
    odd = F.col("anomaly_score") > F.col("cut")
    out = scored.join(_cuts(scored, 1.0 - contamination), "entity").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("entity", "date", *FEATURES, "anomaly_score", F.when(odd, -1).otherwise(1).alias("anomaly"),
                      F.when(odd, "Anomaly").otherwise("Normal").alias("anomaly_flag"))
