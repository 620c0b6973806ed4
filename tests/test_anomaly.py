"""Isolation-forest invariants: ~12 % flagged per entity, layout independent,
an injected outlier is flagged."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import anomaly


def _daily(spark):
    rows = []
    for e in range(3):
        for d in range(30):
            v = 1000.0 + (d * 37 % 11) * 10 + e
            if d == 17:
                v = 50000.0
            rows.append((e, dt.date(2024, 1, 1) + dt.timedelta(days=d), v, v / 2, v / 4, v / 4))
    return spark.createDataFrame(rows, "entity bigint, date date, total_sales double, cash double, online double, "
                                       "credit double")


def test_rate_and_outlier(spark):
    out = anomaly.anomaly_iforest(_daily(spark)).collect()
    by_e = {}
    for r in out:
        by_e.setdefault(r["entity"], []).append(r)
    for e, rows in by_e.items():
        flagged = [r for r in rows if r["anomaly"] == -1]
        assert 1 <= len(flagged) <= 4  # 30 rows: scores strictly above the 88th percentile (ties stay normal)
        assert any(r["date"] == dt.date(2024, 1, 18) for r in flagged)


def test_layout_independent(spark):
    d = _daily(spark)
    a = sorted(map(tuple, anomaly.anomaly_iforest(d.repartition(1)).collect()))
    b = sorted(map(tuple, anomaly.anomaly_iforest(d.repartition(7, "date")).collect()))
    assert a == b


def test_short_entities_skipped(spark):
    d = _daily(spark).where(F.col("date") < dt.date(2024, 1, 6))
    assert anomaly.anomaly_iforest(d).count() == 0


def _long(spark, n=900):
    rng = np.random.default_rng(2)
    rows = [(e, dt.date(2000, 1, 1) + dt.timedelta(days=d), *map(float, np.round(rng.normal(1000, 50, 4), 2))) for e, days in ((1, n), (2, 40), (3, 10)) for d in range(days)]
    rows[17] = (1, rows[17][1], 9000.0, 9000.0, 0.0, 0.0)
    return spark.createDataFrame(rows, "entity bigint, date date, total_sales double, cash double, online double, credit double")


def test_blocks_change_nothing(spark):
    d = _long(spark)
    whole = sorted(map(tuple, anomaly.anomaly_iforest(d, n_trees=20).collect()))
    assert whole == sorted(map(tuple, anomaly.anomaly_iforest(d, n_trees=20, block=64).collect())) and len(whole) == 950
    pooled = [sorted(map(tuple, anomaly.anomaly_iforest(d, n_trees=20, pool=300, block=b).collect())) for b in (64, 10_000)]
    assert pooled[0] == pooled[1] != whole
    assert [r for r in pooled[0] if r[2] == 9000.0][0][-1] == "Anomaly"


def test_cut_is_the_quantile(spark):
    out = anomaly.anomaly_iforest(_long(spark), n_trees=20, block=64).toPandas()
    for _, g in out.groupby("entity"):
        want = g["anomaly_score"] > np.percentile(g["anomaly_score"], 88)
        assert ((g["anomaly"] == -1) == want).all()


def test_trees_against_a_plain_walk():
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(200, 4)), 1)
    forest = anomaly.grow(x, 5, n_trees=7, max_samples=64)
    for i in range(0, 200, 17):
        depth = 0.0
        for at in forest["root"]:
            while forest["feature"][at] >= 0:
                at = forest["left"][at] + int(x[i, forest["feature"][at]] >= forest["split"][at])
            depth += forest["path"][at]
        assert anomaly.score(forest, x)[i] == pytest.approx(2.0 ** (-depth / 7 / anomaly._c(64)), abs=1e-12)
    assert max(forest["path"]) <= 6 + anomaly._c(64) and len(forest["root"]) == 7


def test_repeated_null_and_constant_rows(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, day, 5.0, None, 1.0, 2.0)] * 30 + [(1, day + dt.timedelta(days=d), 5.0 + d, 1.0, 1.0, 2.0) for d in range(9)] + [(2, day, 1.0, 1.0, 1.0, 1.0)] * 12 + [(None, day, 1.0, 1.0, 1.0, 1.0)] * 12
    d = spark.createDataFrame(rows, "entity bigint, date date, total_sales double, cash double, online double, credit double")
    for block in (4, 1000):
        out = anomaly.anomaly_iforest(d.withColumn("copies", F.lit("x")).withColumn("blk", F.lit(1)), n_trees=10, block=block).collect()
        assert sum(r.entity == 1 for r in out) == 39 and len({r.anomaly_score for r in out if r.cash is None}) == 1
        assert [(r.anomaly_score, r.anomaly) for r in out if r.entity == 2] == [(0.5, 1)] * 12 and len(out) == 51
    assert anomaly.anomaly_iforest(d.limit(0)).count() == 0
