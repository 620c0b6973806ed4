"""The inverted-list index: recall against the exact scan, every row indexed, bounded blocks and edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import retrieval as rt
from ledgerlens.operators import vector_index as vi
from ledgerlens.plans.registry import QUERIES
from ledgerlens.sources import sinks


def vectors_of(spark, rows):
    return rt.as_vectors(spark.createDataFrame(rows, "unit string, embedding array<double>")).drop("embedding")


@pytest.fixture(scope="module")
def clustered(spark):
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(f"u{i:04d}", [x + rnd.gauss(0, 0.3) for x in centres[min(11, int(rnd.expovariate(0.6)))]]) for i in range(1500)]
    return rows + [("zero", [0.0] * 8), ("null", None), (None, [1.0] * 8), ("u0001", rows[1][1]), ("same", rows[1][1])]


def found(df):
    return sorted(map(tuple, df.select("question_id", "unit", "similarity").collect()))


def test_all_lists_probed_is_the_exact_scan(spark, clustered):
    vectors = vectors_of(spark, clustered)
    index = vi.build(vectors, sinks.scratch_path(spark, "index"), lists=9, block=50)
    assert index.size == 1502 and index.rows.count() == 1502  # every usable row, repeated ones too
    questions = vectors_of(spark, clustered).where("unit like 'u00%' and unit <> 'u0001'").select(F.substring("unit", 2, 4).cast("long").alias("question_id"), "vec", "vec_norm")
    exact = rt.best_units(vectors.where("vec_norm > 0 and unit is not null").withColumn("first_chunk", F.col("unit")), questions, 6)
    assert found(vi.search(index, questions, 6, len(index.centres), question_block=7)) == found(exact)
    assert max(index.blocks.values()) > 1
    probes = vi.calibrate(index, questions, 99, 6, target=0.95)
    some = found(vi.search(index, questions, 6, probes))
    assert probes < len(index.centres)
    assert len({x[:2] for x in some} & {x[:2] for x in found(exact)}) >= 0.9 * exact.count()


def test_a_sample_fits_but_every_row_is_indexed(spark, clustered):
    index = vi.build(vectors_of(spark, clustered), sinks.scratch_path(spark, "index"), lists=5, sample=100)
    assert index.size == 1502 == index.rows.count() and len(index.centres) <= 5
    assert sorted(r.unit for r in index.rows.collect())[:2] == ["same", "u0000"]


def test_index_of_little(spark, clustered):
    vectors = vectors_of(spark, clustered)
    questions = vectors_of(spark, clustered).where("unit = 'u0007'").select(F.lit(7).cast("long").alias("question_id"), "vec", "vec_norm")
    for few, n in ((vectors.limit(0), 0), (vectors.where("unit in ('zero', 'null')"), 0), (vectors.where("unit in ('u0003')"), 1)):
        index = vi.build(few, sinks.scratch_path(spark, "index"))
        assert vi.search(index, questions, 3, vi.calibrate(index, questions, 1, 3)).count() == n
    index = vi.build(vectors, sinks.scratch_path(spark, "index"), lists=4)
    assert vi.search(index, questions.limit(0), 3, 2).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_all_rows(spark, sf):
    r = QUERIES["knn_index_recall"](spark, f"/root/testdata/{sf}").agg(F.sum("found"), F.sum("n")).first()
    assert r[1] > 0 and r[0] / r[1] >= 0.9
