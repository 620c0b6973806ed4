"""Sheets as text from arrays of cells: rows by hand, odd cells, and what their plans read."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import grid, line_packing
from ledgerlens.plans.registry import QUERIES
from ledgerlens.sources import domain, routing, sheets
from ledgerlens.sources import grid as src
from ledgerlens.sources.tables import Tables

SF = "/root/testdata/sf0.001"
CELLS = "file string, sheet string, sheet_idx int, row_idx int, col_idx int, str_value string, num_value double"
FILE = "Supplier 7 Monthly Report - March 1998.xlsx"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, rows):
    return spark.createDataFrame(rows, CELLS).repartition(3)


def test_like_lookup_rows(spark):
    rows = [(FILE, "PL", 0, 3, 0, "Total Sales Value", None), (FILE, "PL", 0, 3, 2, "7%", None), (FILE, "PL", 0, 5, 0, "sales value", None), (FILE, "PL", 0, 5, 2, None, 5.0),
            (FILE, "PL", 0, 5, 1, "text", None), (FILE, "PL", 0, 7, 0, "Sales Value", None), (FILE, "PL", 0, 7, 1, None, 1234.5), (None, "PL", 0, 1, 0, "Sales Value", None),
            (None, "PL", 0, 1, 1, None, 4.0), (FILE, "Other", 0, 1, 0, "Total", None), (FILE, "Other", 0, 1, 1, None, 2.0), (FILE, "PL", 0, None, 0, "Total", None), (FILE, "PL", 0, None, 1, None, 3.0)]
    c = frame(spark, rows)
    assert {tuple(r) for r in grid.label_lookup_like(c, ["Sales Value", "Total"], [1, 2]).collect()} == {(FILE, "PL", "Sales Value", "text"), (FILE, "Other", "Total", "2")}
    assert {tuple(r) for r in grid.label_lookup_like(c, ["Sales Value"], [2, 1], sheet="PL").collect()} == {(FILE, "PL", "Sales Value", "5")}
    # the cells are made once and nothing is joined to them
    assert "Join" not in plan(grid.label_lookup_like(c, ["Total"], [1, 2]))


def test_sheets_are_read_once_and_not_row_by_row(spark):
    c = frame(spark, [(FILE, "PL", 0, 0, 0, "a", None)])
    for df in (grid.sheet_lines(c), grid.grid_markdown(c), grid.kpi_summary(c)):
        assert "Join" not in plan(df) and not re.search(r"Aggregate\(keys=\[[^\]]*row_idx", plan(df))


def test_odd_cells(spark):
    nan = float("nan")
    rows = [(FILE, "A", 0, 2, 0, "Name", None), (FILE, "A", 1, 2, 3, "Sum", None), (FILE, "A", 0, 2, 7, None, nan), (FILE, "A", 0, 3, 0, " x ", None), (FILE, "A", 0, 3, 3, None, 1234.5),
            (FILE, "A", 0, 4, 5, None, 2.25), (FILE, "A", 0, 5, 0, "nan", None), (FILE, "A", 0, 9, 0, "", None), (FILE, "B", 2, 6, 1, "b", None), (FILE, "B", 2, 6, 0, None, 0.125),
            (FILE, "C", None, 0, 0, None, nan), (FILE, None, 0, 0, 0, "lost", None), (None, "A", 0, 0, 0, "lost", None), (FILE, "D", None, 1, 0, "d", None)]
    c = frame(spark, rows)
    md = {r.sheet: r.markdown for r in grid.grid_markdown(c).collect()}
    assert md == {"A": "| Name | Sum |\n| --- | --- |\n| x | 1,234 |", "B": "0.125 | b", "D": "d"}
    lines = {(r.sheet, r.sheet_idx, r.line_no): r.line for r in grid.sheet_lines(c, F.concat(F.lit("of "), F.col("sheet"))).collect()}
    table = {0: "of A", 1: "| Name | Sum |", 2: "| --- | --- |", 6: "| x | 1,234 |"}
    assert lines == {**{("A", i, k): v for i in (0, 1) for k, v in table.items()}, ("B", 2, 0): "of B", ("B", 2, 9): "0.125 | b", ("D", None, 0): "of D", ("D", None, 4): "d"}
    with pytest.raises(Exception, match="one place"):
        grid.grid_markdown(frame(spark, [*rows, (FILE, "A", 0, 3, 3, "twice", None)])).collect()


def test_blocks_of_a_sheet_share_its_header(spark, monkeypatch):
    rows = [(FILE, "A", 0, 1, 0, "h0", None), (FILE, "A", 0, 1, 9, "h9", None)] + [(FILE, "A", 0, r, r % 4 * 3, f"v{r}", None) for r in range(2, 90)] + [(FILE, "B", 0, 40 * r, 0, f"b{r}", None) for r in range(3)]
    whole = sorted(map(tuple, grid.sheet_lines(frame(spark, rows)).collect()))
    packed = sorted(map(tuple, line_packing.pack_lines(grid.sheet_lines(frame(spark, rows)), grid.KEY, 60).collect()))
    monkeypatch.setattr(line_packing, "BLOCK", 7)
    blocks = grid.sheet_lines(frame(spark, rows), blocks=True)
    assert blocks.where("many").count() == 16 and sorted(map(tuple, grid.sheet_lines(frame(spark, rows)).collect())) == whole
    assert sorted(map(tuple, line_packing.pack_lines(blocks, grid.KEY, 60).collect())) == packed


def test_summary_of_repeated_and_empty_cells(spark):
    cred, deb = "Creditors Analysis", "Debtors Analysis"
    rows = [(FILE, "PL", 0, 2, 1, " Mar ", None), (FILE, "PL", 0, 3, 0, "Sales Value", None), (FILE, "PL", 0, 3, 2, None, 9.0), (FILE, "PL", 0, 4, 0, "net sales value", None), (FILE, "PL", 0, 4, 1, None, 1500.0),
            (FILE, "PL", 0, 5, 0, "Net Profit", None), (FILE, "PL", 0, 5, 1, "7%", None), (FILE, "PL", 0, 6, 0, "Gross Profit", None), (FILE, "PL", 0, 6, 1, None, float("nan")),
            (FILE, cred, 1, 3, 0, "A", None), (FILE, cred, 1, 3, 0, "B", None), (FILE, cred, 1, 3, 4, None, 5.0), (FILE, cred, 1, 3, 4, None, 7.5), (FILE, cred, 1, 4, 0, "Grand Total", None),
            (FILE, cred, 1, 4, 4, None, 99.0), (FILE, cred, 1, 5, 0, "no closing", None), (FILE, cred, 1, 2, 0, "early", None), (FILE, cred, 1, 2, 4, None, 1.0),
            (FILE, deb, 2, 3, 0, "C", None), (FILE, deb, 2, 3, 4, None, -2.25), ("empty - May 1999.xlsx", "PL", 0, 0, 0, "title", None), (None, cred, 0, 3, 0, "A", None), (None, cred, 0, 3, 4, None, 1.0)]
    got = {r.file: r.text.split("\n") for r in grid.kpi_summary(frame(spark, rows)).collect()}
    assert set(got) == {FILE} and got[FILE][4:] == ["Profit & Loss highlights:", "- Sales Value: 1,500.00", "Top creditors:", "- B: closing balance 7.50",
                                                    "- Total creditor closing balance (top entries): 7.50", "- Total debtor closing balance: -2.25 across 1 customers"]
    more = spark.createDataFrame([(FILE, ["- more"]), ("empty - May 1999.xlsx", ["- only this"])], "file string, lines array<string>")
    got = {r.file: r.text.split("\n") for r in grid.kpi_summary(frame(spark, rows), more_lines=more).collect()}
    assert got[FILE][6] == "- more" and got["empty - May 1999.xlsx"][4:] == ["- only this"]


def odd_tables(spark, tmp_path):
    lines = [(1, 1, 1, 1, 2.0, 10.5, 0.1, 0.05, "F", "R", "1998-03-04"), (1, 2, 1, 7, 1.0, 20.0, 0.0, 0.0, "O", "R", "1998-03-09"), (2, 1, 1, 2, 3.0, 7.25, 0.0, 0.1, "F", "R", "1998-04-01"),
             (2, 3, 2, 1, 1.0, 5.0, 0.0, 0.0, "O", None, "1998-04-01"), (9, 1, 2, 1, 1.0, 5.0, 0.0, 0.0, "O", "R", "1998-05-01"), (1, 9, 3, 1, 1.0, 5.0, 0.0, 0.0, "O", "R", "1998-05-01"),
             (1, 1, None, 1, 1.0, 4.0, 0.0, 0.0, "F", "R", "1998-05-01"), (1, 1, None, 1, 1.0, 4.0, 0.0, 0.0, "F", "R", "1998-06-01"), (1, 1, 1, 1, None, None, None, None, None, "R", "1998-06-01"),
             (1, 4, 1, 1, 1.0, 3.0, 0.0, 0.0, "F", "R", None)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_returnflag string, d string"
    spark.createDataFrame(lines + lines[:1], names).withColumn("l_shipdate", F.to_timestamp_ntz("d")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, " Brand#1", 3.5, "STEEL"), (2, "Brand#2", 4.0, "pizza"), (3, None, 1.0, None), (4, "Grand Total", 1.0, "TIN"), (4, "Brand#2", 2.0, "TIN")],
                          "p_partkey long, p_brand string, p_retailprice double, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 12, "1-URGENT", "1998-02-03"), (2, None, "5-LOW", "1998-03-03"), (2, 7, None, None)], "o_orderkey long, o_custkey long, o_orderpriority string, d string").withColumn(
        "o_orderdate", F.to_timestamp_ntz("d")).drop("d").write.parquet(f"{tmp_path}/orders.parquet")
    return Tables(spark, str(tmp_path))


def test_full_cells_equal_their_rows_built_apart(spark, tmp_path):
    t = odd_tables(spark, tmp_path)
    pl, ledger = src.ledger_rows(t, 3)
    other, layouts = sheets.other_rows(t, 3)
    apart = src.laid_out(pl.unionByName(other), {**ledger, src.PL_KIND: F.concat(ledger[src.PL_KIND], sheets._ledger_layout()), **layouts}, 3)
    got, want = Counter(map(str, sheets.all_cells(t).collect())), Counter(map(str, apart.collect()))
    assert (got - want, want - got) == (Counter(), Counter())
    assert len(re.findall(r"Join \[l_orderkey", plan(sheets.all_cells(Tables(spark, SF))))) == 1


def test_annual_and_monthly_cells_are_the_same_however_they_move(spark, tmp_path):
    t = odd_tables(spark, tmp_path)
    pl = domain.monthly_pl(t)
    assert sorted(map(str, pl.collect())) == sorted(map(str, domain.monthly_pl(t, 3).collect()))
    assert sorted(map(str, src.pl_cells(pl, 3).collect())) == sorted(map(str, src.pl_cells(pl).collect()))
    annual = src.legacy_pl_cells(pl).collect()
    want = {}
    for r in pl.collect():
        file = None if r.entity is None or r.period is None else f"Supplier {r.entity} Annual Report {r.period[:4]}.xlsx"
        want.setdefault(file, []).append(r)
    for file, rs in want.items():
        cells = [c for c in annual if c.file == file]
        assert sorted(c.str_value for c in cells if c.str_value) == sorted(["Particulars", *[label for label, _ in src.PL_LABELS]])
        assert sorted((c.row_idx, c.num_value) for c in cells if c.num_value is not None) == sorted((3 + i, r[col]) for r in rs for i, (_, col) in enumerate(src.PL_LABELS) if r[col] is not None)


def test_routed_cells_do_not_move(spark):
    text = plan(QUERIES["routed_pl"](spark, SF))
    assert not re.search(r"Exchange hashpartitioning\(file#\d+, (file|sheet|PL|row_idx|label|key|col_idx)#", text) and "Generate" in text


def test_coverage_of_odd_rows(spark):
    schema = "entity long, period string, x int"
    monthly = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "z", 3), (2, "a", 4), (2, "a", 5), (None, "a", 6), (None, "b", 7), (4, None, 8)], schema)
    annual = spark.createDataFrame([(1, "a", 10), (2, "a", 11), (2, "b", 12), (3, "b", 13), (3, "z", 14), (None, "a", 15)], schema)
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "period string")
    got = routing.by_coverage(routing.Source("monthly", monthly), routing.Source("annual", annual), "entity", "period", wanted, 2)
    assert sorted((r.x, r.route) for r in got.collect()) == [(1, "monthly"), (2, "monthly"), (11, "annual"), (12, "annual"), (13, "annual"), (15, "annual")]
    assert set(got.columns) == {"entity", "period", "x", "route"}


def test_number_and_text_of_cells(spark):
    from ledgerlens.functions.scalar import clean_cell, plain_number
    values = [0.1, 123.45, -123.45, 1234567.891234, 0.000123, 0.0000004, 9999999.123456, 0.1234567, 12345678.25, 1e15, -0.0, 2.5e-7, 1 / 3, float("nan"), None, 999.999999, 1e-3]
    d = spark.createDataFrame([(v,) for v in values], "x double")
    old = F.when(F.col("x").isNull() | F.isnan("x"), None).when((F.col("x") == F.floor("x")) & (F.abs("x") < 1e15), F.col("x").cast("bigint").cast("string")) \
           .otherwise(F.rtrim(F.col("x").cast("decimal(38,6)").cast("string"), F.lit("0")))
    assert all(r.a == r.b for r in d.select(plain_number(F.col("x")).alias("a"), old.alias("b")).collect())
    texts = [" nan ", "NaN", "nane", "na", "", "  ", "Ｎan", "x", None, "ñan"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(clean_cell(F.col("t"))).collect()]
    assert got == [None, None, "nane", "na", None, None, "Ｎan", "x", None, "ñan"]
