"""Every SQL-expressible query equals its DuckDB oracle at sf0.001, and the
driver contract (entry / queries / oracle_sql) holds."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import rows_of  # noqa: E402

from ledgerlens.sources.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "stress" in df.columns and "entity" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = rows_of([r.asDict(recursive=True) for r in sdf.collect()], cols)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    drows = rows_of([dict(zip(rel.columns, r)) for r in rel.fetchall()], cols)
    assert srows == drows


def test_packed_lines_equal_sql_at_small_sizes(spark, con):
    """Sheets of the test data fit one chunk, so both packers also run at sizes that cut them."""
    from pyspark.sql import functions as F

    from ledgerlens.operators.chunking import chunk_lines
    from ledgerlens.plans.oracle_sql import pack_sql

    md = [(r["file"], r["sheet"], r["markdown"]) for r in E.queries()["grid_markdown"](spark, SF).limit(300).collect()]
    md.append(("f", "long", "| a | b |\n| --- | --- |\n" + "\n".join("| " + "x" * (7 * i % 150) + " | y |" for i in range(60))))
    df = spark.createDataFrame(md, "file string, sheet string, text string")
    for size in (60, 150):
        got = df.select("file", "sheet", F.posexplode(chunk_lines(F.col("text"), size)).alias("pos", "chunk")).collect()
        rows = df.toPandas()  # noqa: F841 (read by the SQL)
        want = duckdb.sql(pack_sql("SELECT * FROM rows", size)).fetchall()
        assert sorted(map(tuple, got)) == sorted(want)
        assert len(got) > len(md)
