"""Plans of steps whose shuffled bytes grew beyond their input."""

from pyspark.sql import functions as F

from ledgerlens.operators import grid as gr
from ledgerlens.operators import lab
from ledgerlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
CELLS = "file string, sheet string, sheet_idx int, row_idx int, col_idx int, str_value string, num_value double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _cells(spark):
    rows = [("f", "PL", 0, 2, 0, "Particulars", None), ("f", "PL", 0, 2, 1, "March", None), ("f", "PL", 0, 3, 0, "Net Profit", None),
            ("f", "PL", 0, 3, 1, None, 7.5), ("f", "PL", 0, 5, 0, "net profit", None), ("f", "PL", 0, 5, 1, None, 9.0),
            ("g", "PL", 0, 0, 0, " ", None), ("g", "PL", 0, 6, 0, "Net Profit", None), ("g", "PL", 0, 6, 1, "n/a", None),
            (None, "PL", 0, 1, 0, "Net Profit", None), (None, "PL", 0, 1, 1, None, 4.0)]
    return spark.createDataFrame(rows, CELLS)


def test_feature_matrix_moves_lines_once_by_entity(spark):
    plan = _plan(QUERIES["feature_matrix"](spark, SF))
    assert "Expand" not in plan  # no row of the widest kind for every grain
    grouped = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "entity" in x]
    assert len(grouped) == 1, plan


def test_grid_header_and_label_lookup_read_cells_once(spark):
    c = _cells(spark).repartition(3)
    for df in (gr.grid_header(c), gr.label_lookup(c, ["Net Profit"], 1)):
        assert "Join" not in _plan(df)


def test_grid_header_rows(spark):
    got = {tuple(r) for r in gr.grid_header(_cells(spark)).collect()}
    assert got == {("f", "PL", 2, 2), ("g", "PL", 2, None), (None, "PL", 2, None)}


def test_label_lookup_rows(spark):
    got = {tuple(r) for r in gr.label_lookup(_cells(spark), ["Net Profit"], 1).collect()}
    assert got == {("f", "PL", "net profit", 7.5), ("g", "PL", "net profit", None), (None, "PL", "net profit", None)}


def test_lab_table_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    cols = lab.FEATURE_COLS
    fm = spark.range(60).select((F.col("id") % 6).alias("entity"), F.col("id").cast("string").alias("period"),
                                *[(F.col("id") * i % 7).cast("double").alias(c) for i, c in enumerate(cols, 1)],
                                (F.col("id") % 2).cast("int").alias("stress"))
    table = lab.lab_table(fm.mapInPandas(count, fm.schema))
    assert table.count() == 60 and "features" in table.columns and "label" in table.columns
    assert seen.value == 60


def test_report_cells_move_by_file_before_they_are_cells(spark):
    import re
    for name in ("row_to_line", "grid_markdown", "kpi_summary", "kpi_summary_full", "report_probes", "parties_from_grid", "detect_period"):
        plan = _plan(QUERIES[name](spark, SF))
        assert "Generate" in plan
        assert not re.search(r"Exchange hashpartitioning\((file|sheet)#\d+, (file|sheet|row_idx|rule)#", plan), name


def test_cells_equal_their_sheets_built_apart(spark, tmp_path):
    from ledgerlens.sources import domain
    from ledgerlens.sources import grid as src
    from ledgerlens.sources.tables import Tables

    lines = [(1, 1, 1, 1, 2.0, 10.5, 0.1, 0.05, "F", "R", "1998-03-04"), (1, 2, 1, 7, 1.0, 20.0, 0.0, 0.0, "O", "N", "1998-03-09"), (2, 1, 1, 2, 3.0, 7.25, 0.0, 0.1, "F", "R", "1998-04-01"),
             (2, 3, 2, 1, 1.0, 5.0, 0.0, 0.0, "O", "N", "1998-04-01"), (9, 1, 2, 1, 1.0, 5.0, 0.0, 0.0, "O", "N", "1998-05-01"), (1, 9, 3, 1, 1.0, 5.0, 0.0, 0.0, "O", "N", "1998-05-01"),
             (1, 1, None, 1, 1.0, 4.0, 0.0, 0.0, "F", "N", "1998-05-01"), (1, 1, 1, 1, None, None, None, None, None, "R", "1998-06-01"), (1, 4, 1, 1, 1.0, 3.0, 0.0, 0.0, "F", "R", None)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_returnflag string, d string"
    spark.createDataFrame(lines + lines[:1], names).withColumn("l_shipdate", F.to_timestamp_ntz("d")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, " Brand#1", 3.5, "STEEL"), (2, "Brand#2", 4.0, "pizza"), (3, None, 1.0, None), (4, "Grand Total", 1.0, "TIN"), (4, "Brand#2", 2.0, "TIN")],
                          "p_partkey long, p_brand string, p_retailprice double, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 12, "1-URGENT"), (2, None, "5-LOW"), (2, 7, None)], "o_orderkey long, o_custkey long, o_orderpriority string").withColumn(
        "o_orderdate", F.lit("1998-02-03").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    apart = src.pl_cells(domain.monthly_pl(t)).unionByName(src.party_cells(domain.party_balances(t))).select(*src.CELL_SCHEMA)
    for cells in (src.cells(t), src.cells(t, stored=True)):
        assert sorted(map(str, cells.collect())) == sorted(map(str, apart.collect()))


def test_lines_of_stored_blocks_are_not_moved_again(spark):
    from ledgerlens.operators import line_packing
    lines = spark.createDataFrame([("f", i, "x" * (i % 7)) for i in range(200)] + [("g", 0, "y"), (None, 0, "z")], "k string, line_no long, line string")
    got = line_packing.pack_lines(lines, ["k"], 40, 41)
    assert "LeftAnti" not in _plan(got) and "LeftSemi" not in _plan(got)
    assert {r.k for r in got.collect()} == {"f", "g", None}


def test_manifest_reads_chunks_once(spark):
    rows = [("a", "Audit Data Overview", "audit_data", "May", "x\nlast"), ("a", "PL", "audit_data", "May", "y"), ("b", "PL", "audit_data", None, "y"), ("c", "PL", "proposal", None, "y")]
    got = gr.ingest_manifest(spark.createDataFrame(rows, "file_name string, section string, source_type string, report_period string, text string"))
    assert "Join" not in _plan(got)
    assert {tuple(r) for r in got.collect()} == {("a", 2, "May", "last"), ("b", 1, None, None)}
