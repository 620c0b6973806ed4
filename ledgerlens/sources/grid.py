"""The long cell table of monthly report workbooks.

Reports are derived from the P&L (T3) and party balances (T5): one workbook
per (entity, period) with a 'PL' sheet (header row 2, ten labelled lines,
value in column 1 and percent of sales in column 2) and the two party
sheets (header row 2, one row per party with opening in column 1 and
closing in column 4, then a 'Grand Total' row).  Schema:
(file, sheet, sheet_idx, row_idx, col_idx, str_value, num_value)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import domain, sinks
from .tables import Tables

# P&L line labels and the P&L column each one reports.
PL_LABELS = [
    ("Sales Value", "sales_value"),
    ("Total Incomes", "total_incomes"),
    ("Cost of Goods Sold", "cogs"),
    ("Gross Profit", "gross_profit"),
    ("Operational Expenses", "operational_expenses"),
    ("Staff Salary & Wages", "staff_salary"),
    ("Foodmandu Charges", "foodmandu_charges"),
    ("Total Expenses", "total_expenses"),
    ("Net Profit", "profit"),
    ("Bread Income", "bread_income"),
]
PARTY_SHEETS = [("creditor", "Creditors Analysis", 1), ("debtor", "Debtors Analysis", 2)]
PARTY_HEADER = ["Party", "Opening", "Debit", "Credit", "Closing"]
CELL_SCHEMA = ["file", "sheet", "sheet_idx", "row_idx", "col_idx", "str_value", "num_value"]


def report_file(entity, period):
    """'Supplier 7 Monthly Report - March 1998.xlsx'."""
    month = F.date_format(F.to_date(F.concat(period, F.lit("-01"))), "MMMM yyyy")
    return F.concat(F.lit("Supplier "), entity.cast("string"), F.lit(" Monthly Report - "), month, F.lit(".xlsx"))


def _cell(r, c, s=None, n=None):
    return F.struct(F.lit(r).alias("row_idx"), (F.lit(c) if isinstance(c, int) else c).alias("col_idx"),
                    (s if s is not None else F.lit(None)).cast("string").alias("str_value"),
                    (n if n is not None else F.lit(None)).cast("double").alias("num_value"))


def pl_cells(pl: DataFrame, parts: int | None = None) -> DataFrame:
    """The P&L sheets; with ``parts`` their rows are dealt by file before they become cells (see ``laid_out``)."""
    if parts is not None:
        month = F.array(F.struct(F.col("month").alias("name"), *[F.lit(None).alias(x) for x in "abc"]))
        name = F.concat(F.lit("Supplier "), F.col("entity").cast("string"))
        return laid_out(report_row(pl, PL_KIND, name, F.lit(None), [F.col(c) for _, c in PL_LABELS], month), {PL_KIND: pl_layout()}, parts)
    cells = [_cell(0, 0, F.concat(F.lit("Supplier "), F.col("entity").cast("string"))),
             _cell(2, 0, F.lit("Particulars")), _cell(2, 1, F.col("month")), _cell(2, 2, F.lit("%"))]
    for i, (label, col) in enumerate(PL_LABELS):
        pct = F.when(F.col("sales_value") != 0,
                     F.concat(F.format_string("%.1f", F.col(col) / F.col("sales_value") * F.lit(100.0)), F.lit("%")))
        cells += [_cell(3 + i, 0, F.lit(label)), _cell(3 + i, 1, n=F.col(col)), _cell(3 + i, 2, pct)]
    out = pl.select(report_file(F.col("entity"), F.col("period")).alias("file"), F.lit("PL").alias("sheet"),
                    F.lit(0).alias("sheet_idx"), F.explode(F.array(*cells)).alias("c"))
    return out.select("file", "sheet", "sheet_idx", "c.*").where(
        F.col("str_value").isNotNull() | F.col("num_value").isNotNull())


def party_cells(parties: DataFrame) -> DataFrame:
    parts = []
    for ptype, sheet, idx in PARTY_SHEETS:
        p = parties.where(F.col("type") == ptype)
        w = Window.partitionBy("entity", "period").orderBy("party")
        rows = p.withColumn("row_idx", F.row_number().over(w) + 2)
        body = rows.select("entity", "period", F.explode(F.array(
            F.struct(F.col("row_idx"), F.lit(0).alias("col_idx"), F.col("party").alias("str_value"),
                     F.lit(None).cast("double").alias("num_value")),
            F.struct(F.col("row_idx"), F.lit(1).alias("col_idx"), F.lit(None).cast("string").alias("str_value"),
                     F.col("opening").alias("num_value")),
            F.struct(F.col("row_idx"), F.lit(4).alias("col_idx"), F.lit(None).cast("string").alias("str_value"),
                     F.col("closing").alias("num_value")))).alias("c")).select("entity", "period", "c.*")
        tot = rows.groupBy("entity", "period").agg(
            (F.max("row_idx") + 1).alias("row_idx"), domain.to_double(F.sum(domain.cents("closing")), 2).alias("t"))
        total = tot.select("entity", "period", F.explode(F.array(
            F.struct(F.col("row_idx"), F.lit(0).alias("col_idx"), F.lit("Grand Total").alias("str_value"),
                     F.lit(None).cast("double").alias("num_value")),
            F.struct(F.col("row_idx"), F.lit(4).alias("col_idx"), F.lit(None).cast("string").alias("str_value"),
                     F.col("t").alias("num_value")))).alias("c")).select("entity", "period", "c.*")
        files = p.select("entity", "period").distinct()
        head = files.select("entity", "period", F.explode(F.array(
            _cell(0, 0, F.lit(sheet)), *[_cell(2, j, F.lit(h)) for j, h in enumerate(PARTY_HEADER)])).alias("c")) \
            .select("entity", "period", "c.*")
        allc = head.unionByName(body).unionByName(total)
        parts.append(allc.select(report_file(F.col("entity"), F.col("period")).alias("file"),
                                 F.lit(sheet).alias("sheet"), F.lit(idx).alias("sheet_idx"),
                                 "row_idx", "col_idx", "str_value", "num_value"))
    return parts[0].unionByName(parts[1])


# Kinds of report rows, see ``domain.REPORT_ROW``; ``sheets`` has the others.
PL_KIND, PARTY_KINDS = "pl", {kind: (sheet, idx) for kind, sheet, idx in PARTY_SHEETS}
# A task lays out the cells of so many lines; they stay in memory, about 30 cells a line.
LINES_A_PART = 65_536


def parts_for(t: Tables) -> int:
    """Partitions for the lines and the reports: by the number of lines, and one for each core at least."""
    return max(t.spark.sparkContext.defaultParallelism, math.ceil(t.lineitem.count() / LINES_A_PART))


def at(sheet: str, sheet_idx: int, row, col, s=None, n=None) -> Column:
    """A cell with its sheet, as ``laid_out`` takes them."""
    row = F.lit(row) if isinstance(row, int) else row
    return F.struct(F.lit(sheet).alias("sheet"), F.lit(sheet_idx).alias("sheet_idx"), row.cast("int").alias("row_idx"), F.lit(col).alias("col_idx"),
                    (s if s is not None else F.lit(None)).cast("string").alias("str_value"), (n if n is not None else F.lit(None)).cast("double").alias("num_value"))


def report_row(df: DataFrame, kind: str, label: Column, place: Column, v: list[Column], items: Column) -> DataFrame:
    """Rows of ``domain.REPORT_ROW`` from (entity, period) rows."""
    items = items.cast("array<struct<name:string,a:double,b:double,c:double>>")
    return df.select(report_file(F.col("entity"), F.col("period")).alias("file"), F.lit(kind).alias("kind"), label.cast("string").alias("label"),
                     place.cast("int").alias("place"), F.array(*[x.cast("double") for x in v]).cast("array<double>").alias("v"), items.alias("items"))


def laid_out(rows: DataFrame, layouts: dict[str, Column], parts: int, unpacked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The cells of report rows.  ``layouts`` gives the array of cells (see ``at``) of each kind; ``unpacked`` makes report rows of others with a file, once these have moved.

    Rows are dealt by file before they become cells, so whatever is grouped by file,
    or by more, needs no further exchange of the cells.  The generator counts as
    not repeatable, which keeps filters above the exchange: all readers of one query
    share it.  Empty cells are left out, but for the lines of parties."""
    every = F.lit(None)
    for kind, cs in layouts.items():
        every = F.when(F.col("kind") == kind, cs).otherwise(every)
    dealt = rows.repartition(parts, "file")
    dealt = (dealt if unpacked is None else unpacked(dealt)).select("file", F.explode(F.when(F.spark_partition_id() >= 0, every)).alias("c")).select("file", "c.*")
    party = F.col("sheet").isin(*[sheet for _, sheet, _ in PARTY_SHEETS])
    return dealt.where(party | F.col("str_value").isNotNull() | F.col("num_value").isNotNull()).select(*CELL_SCHEMA)


def pl_layout() -> Column:
    """``pl_cells`` of a report row: ``label`` is the entity's name, the only item's name the month, ``v`` the values of ``PL_LABELS``."""
    month = F.col("items")[0]["name"]
    cs = [at("PL", 0, 0, 0, F.col("label")), at("PL", 0, 2, 0, F.lit("Particulars")), at("PL", 0, 2, 1, month), at("PL", 0, 2, 2, F.lit("%"))]
    sales = F.col("v")[0]
    for i, (label, _) in enumerate(PL_LABELS):
        value = F.col("v")[i]
        pct = F.when(sales != 0, F.concat(F.format_string("%.1f", value / sales * F.lit(100.0)), F.lit("%")))
        cs += [at("PL", 0, 3 + i, 0, F.lit(label)), at("PL", 0, 3 + i, 1, n=value), at("PL", 0, 3 + i, 2, pct)]
    return F.array(*cs)


def party_layout(sheet: str, idx: int) -> Column:
    """``party_cells`` of a report row: ``items`` are the parties, ``v`` their total; none without parties."""
    head = F.array(at(sheet, idx, 0, 0, F.lit(sheet)), *[at(sheet, idx, 2, j, F.lit(h)) for j, h in enumerate(PARTY_HEADER)])
    body = F.flatten(F.transform("items", lambda x, i: F.array(at(sheet, idx, i + 3, 0, x["name"]), at(sheet, idx, i + 3, 1, n=x["a"]), at(sheet, idx, i + 3, 4, n=x["b"]))))
    last = F.size("items") + 3
    return F.when(F.size("items") > 0, F.concat(head, body, F.array(at(sheet, idx, last, 0, F.lit("Grand Total")), at(sheet, idx, last, 4, n=F.col("v")[0]))))


def ledger_rows(t: Tables, parts: int, parties: bool = True) -> tuple[DataFrame, dict[str, Column]]:
    """Report rows of the P&L and, with ``parties``, of both party sheets, and their layouts."""
    pl = domain.pl_with_creditors(t, parts)
    # P&L and creditors leave one row as two, so that the lines are joined and summed once
    items = pl.schema["items"].dataType
    month = F.array(F.struct(F.col("month").alias("name"), *[F.lit(None).cast("double").alias(x) for x in "abc"])).cast(items)
    each = [F.struct(F.lit(PL_KIND).alias("kind"), F.array(*[F.col(c) for _, c in PL_LABELS]).alias("v"), month.alias("items"))]
    if parties:
        each.append(F.struct(F.lit("creditor").alias("kind"), F.array(domain.to_double(F.col("total2"), 2)).alias("v"), F.col("items").alias("items")))
    rows = pl.select("entity", "period", "month", F.explode(F.array(*each)).alias("r")).select(
        report_file(F.col("entity"), F.col("period")).alias("file"), "r.kind", F.concat(F.lit("Supplier "), F.col("entity").cast("string")).alias("label"),
        F.lit(None).cast("int").alias("place"), "r.v", "r.items")
    layouts = {PL_KIND: pl_layout()}
    if parties:
        deb = domain.debtors_by_report(t, parts)
        rows = rows.unionByName(report_row(deb, "debtor", F.lit(None), F.lit(None), [domain.to_double(F.col("total2"), 2)], F.col("items")))
        layouts |= {kind: party_layout(*where) for kind, where in PARTY_KINDS.items()}
    return rows, layouts


def cells(t: Tables, stored: bool = False) -> DataFrame:
    """T1 for every (entity, period) report, dealt by file.

    With ``stored`` the report rows are written once to the shared folder, for
    operators that run more than one job over the cells; a report's row is far
    smaller than its cells."""
    parts = parts_for(t)
    rows, layouts = ledger_rows(t, parts)
    return laid_out(sinks.parquet_roundtrip(rows, "report-rows") if stored else rows, layouts, parts)


def legacy_pl_cells(pl: DataFrame) -> DataFrame:
    """The legacy layout: one annual workbook per entity whose 'PL' sheet
    holds every month side by side — month m in column 2m-1 (column 2m,
    the percent column, is left empty), the ten labelled lines in rows 3-12."""
    year = F.substring("period", 1, 4)
    m = F.substring("period", 6, 2).cast("int")
    file = F.concat(F.lit("Supplier "), F.col("entity").cast("string"), F.lit(" Annual Report "), year,
                    F.lit(".xlsx"))
    # a workbook's months meet in one row before they become cells, so cells need not move to meet by workbook
    books = pl.select(file.alias("file"), F.struct(m.alias("m"), F.array(*[F.col(c).cast("double") for _, c in PL_LABELS]).alias("v")).alias("month")) \
              .groupBy("file").agg(F.collect_list("month").alias("months"))
    labels = [_cell(2, 0, F.lit("Particulars")), *[_cell(3 + i, 0, F.lit(label)) for i, (label, _) in enumerate(PL_LABELS)]]
    values = F.flatten(F.transform("months", lambda x: F.array(*[_cell(3 + i, x["m"] * 2 - 1, n=x["v"][i]) for i in range(len(PL_LABELS))])))
    # the generator counts as not repeatable, which keeps filters above it and the aggregation one and the same for all readers
    out = books.select("file", F.explode(F.when(F.spark_partition_id() >= 0, F.concat(F.array(*labels), values))).alias("c")).select("file", "c.*")
    return out.select("file", F.lit("PL").alias("sheet"), F.lit(0).alias("sheet_idx"), "row_idx", "col_idx",
                      "str_value", "num_value").where(F.col("str_value").isNotNull() | F.col("num_value").isNotNull())
