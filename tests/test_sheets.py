"""Positional sheet readers, hand-written dates and source routing on small cases."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.scalar import lenient_date
from ledgerlens.operators import sheet_readers as sr
from ledgerlens.plans.registry import QUERIES
from ledgerlens.sources import routing, sheets

CELLS = "file string, sheet string, sheet_idx int, row_idx int, col_idx int, str_value string, num_value double"


def cells_of(spark, sheet, rows, file="Supplier 7 Monthly Report - March 1998.xlsx"):
    """Cells from rows of values: text, number or None."""
    out = [(file, sheet, 0, r, c, v if isinstance(v, str) else None, float(v) if isinstance(v, (int, float)) else None)
           for r, values in rows.items() for c, v in values.items() if v is not None]
    return spark.createDataFrame(out, CELLS)


def test_rows_by_position(spark):
    cells = cells_of(spark, "S", {0: {0: "above"}, 2: {0: "a", 1: 1, 2: "2.5", 9: "outside"}, 3: {0: 12, 1: "nan", 2: "x"}, 4: {0: " ", 1: float("nan")}, 9: {0: "below", 1: 1}})
    got = sr.read_rows(cells.unionByName(cells), sr.SheetLayout("S", 1, {"file_name": 0, "sheet": 1, "c": 2}, ("file_name",), 8))
    assert sorted(map(tuple, got.select("row_idx", "file_name", "sheet", "c").collect())) == [(2, "a", 1.0, 2.5), (3, None, None, None), (4, None, None, None)]
    assert sr.read_rows(cells.limit(0), sr.SheetLayout("S", 1, {"a": 0})).count() == 0
    assert sr.read_rows(cells, sr.SheetLayout("other", 1, {"a": 0})).count() == 0


def test_sales_reader_takes_months_only(spark):
    cells = cells_of(spark, sheets.SALES_SHEET, {1: {0: "Month"}, 2: {0: "Jan", 3: 10, 7: "9"}, 3: {0: "February", 3: 1}, 4: {0: " Mar ", 3: "n/a"}, 14: {0: "Dec", 3: 3}}, "Supplier 7 Sales Report 1998.xlsx")
    got = {r.period: r for r in sr.read_monthly_sales(cells).collect()}
    assert sorted(got) == ["1998-01", "1998-03"] and got["1998-01"].entity == 7 and got["1998-01"].net_sales == 9.0
    assert got["1998-03"].total_sales is None and got["1998-01"].credit_pct is None


def test_party_wastage_and_category_rules(spark):
    party = cells_of(spark, "Debtors Analysis", {2: {0: "Party", 4: 1}, 3: {0: " Ann ", 1: 1.1, 4: 3.3}, 4: {0: "GRAND TOTAL x", 4: 9}, 5: {0: "total", 4: 9}, 6: {0: 5, 4: 9}, 7: {0: "Bo"}, 8: {0: "Cy", 4: "4"}})
    assert sorted(map(tuple, sr.read_parties(party).collect())) == [(7, "1998-03", "debtor", "Ann", 1.1, 3.3, 2.2), (7, "1998-03", "debtor", "Cy", None, 4.0, None)]
    waste = cells_of(spark, sheets.WASTE_SHEET, {2: {0: "Item", 1: 1}, 3: {0: "Bread", 1: 2, 2: 3, 3: 0}, 4: {0: "Oil", 3: 8}, 5: {0: "Pizza", 1: 1}, 6: {0: "total pizza", 1: 1}, 7: {0: 4, 1: 1}, 8: {0: "Salt"}})
    assert sorted((r["item"], r.ktm, r.pkr, r.total) for r in sr.read_wastage(waste).collect()) == [("Bread", 2.0, 3.0, 5.0), ("Oil", 0.0, 0.0, 8.0), ("Salt", 0.0, 0.0, 0.0)]
    cats = cells_of(spark, sheets.CATEGORY_SHEET, {1: {0: "Category", 46: 1}, 2: {0: "Soups", 46: 5}, 3: {0: "Drinks", 45: 5}, 4: {45: 1, 46: 2}}, "Supplier 7 Category Report.xlsx")
    assert [tuple(r) for r in sr.read_categories(cats).collect()] == [(7, "Soups", None, 5.0)]


@pytest.mark.parametrize(("text", "date"), [
    ("2024-01-31", (2024, 1, 31)), ("2024/1/5", (2024, 1, 5)), (" 2024-01-31 10:20:30 ", (2024, 1, 31)), ("2024-01-31T10:20", (2024, 1, 31)), ("2024-02-30", None),
    ("01/02/2024", (2024, 1, 2)), ("31/01/2024", (2024, 1, 31)), ("31/31/2024", None), ("13/13/2024", None), ("5 May 2024", (2024, 5, 5)), ("05-Sep-2024", (2024, 9, 5)),
    ("5 Sept 2024", (2024, 9, 5)), ("5 Mayor 2024", None), ("June 5, 2024", (2024, 6, 5)), ("Jun 5 2024", (2024, 6, 5)), ("Jun. 5, 2024", (2024, 6, 5)), ("29 February 2023", None),
    ("29 February 2024", (2024, 2, 29)), ("Total", None), ("", None), (None, None), ("2024", None), ("20240131", None), ("1/2/3/2024", None), ("0 May 2024", None), ("x" * 5000, None)])
def test_hand_written_dates(spark, text, date):
    got = spark.createDataFrame([(text,)], "t string").select(lenient_date("t").alias("d")).first().d
    assert got == (dt.date(*date) if date else None)


def test_daily_reader_rejects_with_reasons(spark):
    rows = {4 + i: {0: d, 5: total, 1: 1} for i, (d, total, _) in enumerate(sheets.DAILY_PLANTED)}
    rows[40] = {0: "Jan 5, 2024", 5: 7, 8: 2, 9: 3}
    rows[41] = {0: "5 Jan 2024", 5: 500000, 8: 0, 9: 3}
    rows[3] = {0: "2024-01-01", 5: 1}
    cells = cells_of(spark, sheets.DAILY_SHEET, rows, "Outlet 3 Daily Sales.xlsx")
    kept = sorted((r.date.isoformat(), r.total_sales, r.cash, r.avg_ticket, r.day_of_week, r.dow, r.entity) for r in sr.read_daily_sales(cells).collect())
    assert kept == [("2024-01-05", 7.0, 0.0, 1.5, "Friday", 4, 3), ("2024-01-05", 500000.0, 0.0, None, "Friday", 4, 3)]
    rejected = sr.rejected_days(cells).collect()
    assert Counter(r.reason for r in rejected) == Counter(reason for *_, reason in sheets.DAILY_PLANTED)
    assert {r.written for r in rejected if r.reason == "old_date"} == {"1999-12-31", "45000.0"}
    assert sr.read_daily_sales(cells.limit(0)).count() == 0 == sr.rejected_days(cells.limit(0)).count()


def test_first_present_takes_one_source_for_a_key(spark):
    a = spark.createDataFrame([(1, "a1"), (1, "a2"), (2, "a3"), (None, "a4")], "k int, v string")
    b = spark.createDataFrame([(2, "b1"), (3, "b2"), (3, "b2"), (4, "b3")], "k int, v string")
    sources = [routing.Source("A", a), routing.Source("B", b)]
    found = [(1, "a1", "A"), (1, "a2", "A"), (2, "a3", "A"), (3, "b2", "B"), (3, "b2", "B")]
    assert sorted(map(tuple, routing.first_present(sources, ["k"]).collect())) == [*found, (4, "b3", "B")]
    wanted = spark.createDataFrame([(1,), (2,), (3,), (9,), (9,)], "k int")
    assert sorted(map(tuple, routing.first_present(sources, ["k"], wanted).collect()), key=repr) == sorted([*found, (9, None, None)], key=repr)
    assert routing.first_present([routing.Source("A", a.limit(0)), routing.Source("B", b)], ["k"]).where("route = 'A'").count() == 0
    assert routing.first_present([routing.Source("A", a.limit(0))], ["k"]).count() == 0


def test_coverage_decides_the_route_of_an_entity(spark):
    rows = lambda *e: spark.createDataFrame([(x, p, f"{x}{p}") for x, ps in e for p in ps], "entity int, period string, v string")
    primary, fallback = rows((1, "abcz"), (2, "abz")), rows((1, "abcd"), (2, "abcdz"), (3, "a"))
    wanted = spark.createDataFrame([(p,) for p in "abcda"], "period string")
    got = routing.by_coverage(routing.Source("m", primary), routing.Source("l", fallback), "entity", "period", wanted, 3)
    assert sorted((r.entity, r.period, r.route) for r in got.collect()) == [(1, p, "m") for p in "abc"] + [(2, p, "l") for p in "abcd"] + [(3, "a", "l")]


def test_both_routes_are_taken(spark):
    for name, routes in (("routed_pl_complete", {"monthly", "legacy"}), ("routed_daily", {"workbook", "csv"})):
        assert {r.route for r in QUERIES[name](spark, "/root/testdata/sf0.01").select("route").distinct().collect()} == routes


def test_upsert_of_equal_versions_keeps_the_same_row(spark):
    from ledgerlens.sources import sinks
    rows = [("a", 1, f"text {i}") for i in range(20)] + [("a", 0, "old"), ("b", 2, "only")]
    kept = set()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "chunk_id string, version int, text string").repartition(4)
        got = sorted(map(tuple, sinks.upsert(df, df.limit(0)).collect()))
        assert [r[:2] for r in got] == [("a", 1), ("b", 2)]
        kept.add(tuple(got))
    assert len(kept) == 1
