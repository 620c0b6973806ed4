"""Cells of the workbook sheets beside the P&L: monthly sales, wastage,
categories and daily sales (T1 layout, see ``grid``).

The sheets carry what real ones carry besides their data: titles, headers,
total lines, headings without values, dates in several notations, and rows
that a reader has to reject.  ``operators/sheet_readers`` reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import to_double
from . import domain
from .grid import CELL_SCHEMA, PARTY_KINDS, PL_KIND, PL_LABELS, at, laid_out, ledger_rows, party_layout, parts_for, pl_layout, report_file, report_row
from .tables import Tables

# Sheet names, and where each sheet keeps its columns.
SALES_SHEET, WASTE_SHEET, CATEGORY_SHEET, DAILY_SHEET = (
    "Emilio's Monthly Sales", "Sample Gift waste", "Product Sales - Category wise", "Sales Summary ")
MARGIN_SHEET, CASH_SHEET, PURCHASE_SHEET, SALARY_SHEET = "Food Margin analysis", "Cash Flow", "Purchase Analysis", "Salary Details"
SALES_CELLS = {"sales_two_years_ago": 1, "sales_last_year": 2, "total_sales": 3, "discount": 4, "discount_pct": 5, "vat": 6, "net_sales": 7,
               "cash_sales": 8, "cash_pct": 9, "foodmandu_sales": 10, "foodmandu_pct": 11, "pokhara_sales": 14, "pokhara_pct": 15,
               "credit_sales": 16, "credit_pct": 17}
WASTE_CELLS = {"ktm": 1, "pkr": 2, "total": 3}
CATEGORY_CELLS = {"qty": 45, "value": 46}
DAILY_CELLS = {"cash": 1, "online": 2, "credit": 4, "total_sales": 5, "customers": 8, "dine_in_sales": 9}


def _laid(df: DataFrame, file: Column, sheet: str, row: Column, texts: dict[int, Column], numbers: dict[int, Column]) -> DataFrame:
    """One cell for every non-null value of a row."""
    def cell(col, s, n):
        return F.struct(F.lit(col).alias("col_idx"), s.cast("string").alias("str_value"), n.cast("double").alias("num_value"))

    cs = [cell(i, c, F.lit(None)) for i, c in texts.items()] + [cell(i, F.lit(None), c) for i, c in numbers.items()]
    out = df.select(file.alias("file"), F.lit(sheet).alias("sheet"), F.lit(0).alias("sheet_idx"), row.cast("int").alias("row_idx"), F.explode(F.array(*cs)).alias("c"))
    return out.select("file", "sheet", "sheet_idx", "row_idx", "c.*").where("str_value is not null or num_value is not null").select(*CELL_SCHEMA)


def _fixed(files: DataFrame, sheet: str, rows: list[tuple[int, int, str | float]]) -> DataFrame:
    """The same cells in every file: (row, column, text or number)."""
    out = None
    for row, col, value in rows:
        text, number = ({col: F.lit(value)}, {}) if isinstance(value, str) else ({}, {col: F.lit(value)})
        part = _laid(files, F.col("file"), sheet, F.lit(row), text, number)
        out = part if out is None else out.unionByName(part)
    return out


def sales_with_earlier_years(t: Tables) -> DataFrame:
    """T2 with the same month's total sales one and two years before."""
    ms = domain.monthly_sales(t)
    for years, name in ((1, "sales_last_year"), (2, "sales_two_years_ago")):
        before = ms.select("entity", F.date_format(F.add_months(F.to_date(F.concat("period", F.lit("-01"))), 12 * years), "yyyy-MM").alias("period"),
                           F.col("total_sales").alias(name))
        ms = ms.join(before, ["entity", "period"], "left")
    return ms


def sales_cells(t: Tables) -> DataFrame:
    """One sheet for each entity and year: month m in row m + 1 below a title and a header, then a total line."""
    ms = sales_with_earlier_years(t)
    file = F.concat(F.lit("Supplier "), F.col("entity").cast("string"), F.lit(" Sales Report "), F.substring("period", 1, 4), F.lit(".xlsx"))
    body = _laid(ms, file, SALES_SHEET, F.col("month_num") + 1, {0: F.col("month")}, {i: F.col(c) for c, i in SALES_CELLS.items()})
    files = ms.select(file.alias("file")).distinct()
    return body.unionByName(_fixed(files, SALES_SHEET, [(0, 0, "Monthly Sales"), (1, 0, "Month"), (1, 3, "Total Sales"), (14, 0, "Total"), (14, 3, 1.0), (15, 0, "Jan"), (15, 3, 2.0)]))


def wastage_cells(t: Tables) -> DataFrame:
    """One sheet for each entity and period: items from row 3 in name order, after two headings, and a total line."""
    from pyspark.sql import Window
    w = Window.partitionBy("entity", "period").orderBy("item")
    rows = domain.wastage(t).withColumn("row", F.row_number().over(w) + 4)
    file = report_file(F.col("entity"), F.col("period"))
    body = _laid(rows, file, WASTE_SHEET, F.col("row"), {0: F.concat(F.lit(" "), F.col("item"), F.lit(" "))}, {i: F.col(c) for c, i in WASTE_CELLS.items()})
    files = rows.groupBy(file.alias("file")).agg(F.max("row").alias("last"), *[F.sum(c).alias(c) for c in WASTE_CELLS])
    total = _laid(files, F.col("file"), WASTE_SHEET, F.col("last") + 1, {0: F.lit("Total ")}, {i: F.col(c) for c, i in WASTE_CELLS.items()})
    return body.unionByName(total).unionByName(_fixed(files.select("file"), WASTE_SHEET, [(0, 0, "Sample, Gift and Waste"), (2, 0, "Item"), (2, 1, "KTM"), (3, 0, "Bansbari"), (3, 1, 9.0), (4, 0, "PIZZA"), (4, 3, 9.0)]))


def category_cells(t: Tables) -> DataFrame:
    """One sheet for each entity: categories from row 2 in name order, and a heading without values."""
    from pyspark.sql import Window
    rows = domain.category_sales(t).withColumn("row", F.row_number().over(Window.partitionBy("entity").orderBy("category")) + 2)
    file = F.concat(F.lit("Supplier "), F.col("entity").cast("string"), F.lit(" Category Report.xlsx"))
    body = _laid(rows, file, CATEGORY_SHEET, F.col("row"), {0: F.col("category")}, {i: F.col(c) for c, i in CATEGORY_CELLS.items()})
    files = rows.select(file.alias("file")).distinct()
    return body.unionByName(_fixed(files, CATEGORY_SHEET, [(0, 0, "Category"), (1, 45, "Qty"), (1, 46, "Value"), (2, 0, "All categories"), (2, 45, 3.0)]))


def date_notation(date: Column) -> Column:
    """A date in the notation of its weekday: five that people write by hand."""
    named = F.date_format(date, "MMMM")
    day, year = F.dayofmonth(date).cast("string"), F.year(date).cast("string")
    by = [F.date_format(date, "yyyy-MM-dd"), F.date_format(date, "MM/dd/yyyy"), F.concat_ws(" ", day, named, year),
          F.concat(F.date_format(date, "MMM"), F.lit(" "), day, F.lit(", "), year), F.date_format(date, "yyyy-MM-dd HH:mm:ss")]
    return F.element_at(F.array(*by), (F.weekday(date) % 5 + 1).cast("int"))


# Rows that a reader of daily sales has to reject, as (date text or number, total, reason).
DAILY_PLANTED = [("Total", 1234.5, "bad_date"), ("2024-02-30", 10.0, "bad_date"), ("31/31/2024", 10.0, "bad_date"), ("n/a", 10.0, "bad_date"),
                 ("1999-12-31", 10.0, "old_date"), (45000.0, 10.0, "old_date"), (None, 10.0, "no_date"), ("2024-01-15", None, "no_total"),
                 ("2024-01-16", 500000.01, "large_total")]


def outlet_file(entity: Column) -> Column:
    return F.concat(F.lit("Outlet "), entity.cast("string"), F.lit(" Daily Sales.xlsx"))


def daily_cells(t: Tables, outlets: DataFrame | None = None) -> DataFrame:
    """One sheet for each outlet (of those in ``outlets``, if given): days from row 4, then the planted rows."""
    from pyspark.sql import Window
    days = domain.daily_sales(t) if outlets is None else domain.daily_sales(t).join(outlets, "entity", "left_semi")
    rows = days.withColumn("row", F.row_number().over(Window.partitionBy("entity").orderBy("date")) + 3)
    file = outlet_file(F.col("entity"))
    body = _laid(rows, file, DAILY_SHEET, F.col("row"), {0: date_notation(F.col("date"))}, {i: F.col(c) for c, i in DAILY_CELLS.items()})
    ends = rows.groupBy(file.alias("file")).agg(F.max("row").alias("last"))
    for i, (date, total, _) in enumerate(DAILY_PLANTED):
        texts = {0: F.lit(date)} if isinstance(date, str) else {6: F.lit("see note")}
        numbers = {5: F.lit(total)} | ({0: F.lit(date)} if isinstance(date, float) else {})
        body = body.unionByName(_laid(ends, F.col("file"), DAILY_SHEET, F.col("last") + 1 + i, texts, numbers))
    return body.unionByName(_fixed(ends.select("file"), DAILY_SHEET, [(0, 0, "Sales Summary"), (3, 0, "Date"), (3, 5, "Total")]))


def _sales_layout() -> Column:
    """What a monthly report takes from the sales: the month's line of the sales sheet, and the cash flow.  ``v`` holds the values of ``REPORT_SALES``."""
    v = {c: F.col("v")[i] for i, c in enumerate(REPORT_SALES)}
    cs = [at(SALES_SHEET, 0, F.col("place") + 1, 0, F.col("label"))] + [at(SALES_SHEET, 0, F.col("place") + 1, SALES_CELLS[c], n=v[c]) for c in REPORT_SALES]
    cash = [(1, "Cash Balance", v["cash_sales"]), (2, " Bank Balance", v["credit_sales"]), (3, "Total Opening", v["net_sales"]),
            (9, "Sales", F.lit(None)), (10, "Total Inflows", v["total_sales"]), (12, "Cash Balance", F.lit(0.0))]
    for row, label, value in cash:
        cs += [at(CASH_SHEET, 0, row, 0, F.lit(label)), at(CASH_SHEET, 0, row, 1, n=value)]
    cs += [at(SALES_SHEET, 0, 1, 0, F.lit("Month")), at(SALES_SHEET, 0, 1, 7, F.lit("Net Sales")), at(SALES_SHEET, 0, 14, 0, F.lit("Total")), at(SALES_SHEET, 0, 14, 7, n=F.lit(1.0))]
    return F.array(*cs)


def _ledger_layout() -> Column:
    """What a monthly report takes from the P&L: food margin, purchases and salaries.  ``v`` holds the values of ``PL_LABELS``."""
    v = {c: F.col("v")[i] for i, (_, c) in enumerate(PL_LABELS)}
    rows = [(MARGIN_SHEET, 2, "Sales Value", {}, {2: v["sales_value"]}), (MARGIN_SHEET, 3, "Sales Value %", {1: F.lit("100%")}, {}),
            (MARGIN_SHEET, 4, "Total Sales Value", {}, {1: v["sales_value"]}), (MARGIN_SHEET, 5, "Cost of Goods Sold (COGS)", {}, {1: v["cogs"]}),
            (PURCHASE_SHEET, 3, "Material Purchase", {}, {1: v["cogs"], 2: v["operational_expenses"]}),
            (SALARY_SHEET, 2, "Staff", {}, {3: F.lit(1.0)}), (SALARY_SHEET, 3, "Total Salary", {}, {3: v["staff_salary"]})]
    cs = []
    for sheet, row, label, texts, numbers in rows:
        cs += [at(sheet, 0, row, 0, F.lit(label)), *[at(sheet, 0, row, i, s) for i, s in texts.items()], *[at(sheet, 0, row, i, n=n) for i, n in numbers.items()]]
    return F.array(*cs)


def _waste_lines_layout() -> Column:
    """``wastage_cells`` without headings and total: ``items`` are the wasted items."""
    return F.flatten(F.transform("items", lambda x, i: F.array(
        at(WASTE_SHEET, 0, i + 5, 0, F.concat(F.lit(" "), x["name"], F.lit(" "))), *[at(WASTE_SHEET, 0, i + 5, col, n=x[f]) for col, f in zip(WASTE_CELLS.values(), "abc")])))


def _waste_ends_layout() -> Column:
    """Headings and total of ``wastage_cells``: ``place`` is the row of the last item, ``v`` the totals."""
    last = F.col("place") + 1
    total = [at(WASTE_SHEET, 0, last, 0, F.lit("Total "))] + [at(WASTE_SHEET, 0, last, col, n=F.col("v")[i]) for i, col in enumerate(WASTE_CELLS.values())]
    fixed = [at(WASTE_SHEET, 0, 0, 0, F.lit("Sample, Gift and Waste")), at(WASTE_SHEET, 0, 2, 0, F.lit("Item")), at(WASTE_SHEET, 0, 2, 1, F.lit("KTM")),
             at(WASTE_SHEET, 0, 3, 0, F.lit("Bansbari")), at(WASTE_SHEET, 0, 3, 1, n=F.lit(9.0)), at(WASTE_SHEET, 0, 4, 0, F.lit("PIZZA")), at(WASTE_SHEET, 0, 4, 3, n=F.lit(9.0))]
    return F.array(*total, *fixed)


# The values of the sales sheet that the month itself has.
REPORT_SALES = [c for c in SALES_CELLS if c in domain.MS_COLUMNS]


def other_rows(t: Tables, parts: int) -> tuple[DataFrame, dict[str, Column]]:
    """Report rows of the sales and of wastage, and their layouts; each source is made once."""
    ms = domain.monthly_sales(t, parts)
    month = F.when(F.col("month_num") % 2 == 0, F.col("month")).otherwise(F.upper(F.date_format(F.to_date(F.concat("period", F.lit("-01"))), "MMMM")))
    sales = report_row(ms, "sales", month, F.col("month_num"), [F.col(c) for c in REPORT_SALES], F.lit(None))
    item = F.struct(F.col("item").alias("name"), F.col("ktm").alias("a"), F.col("pkr").alias("b"), F.col("total").alias("c"))
    waste = domain.wastage(t, parts).groupBy("entity", "period").agg(F.array_sort(F.collect_list(item)).alias("items"), *[F.sum(c).alias(c) for c in WASTE_CELLS])
    lines = report_row(waste, "waste", F.lit(None), F.lit(None), [F.col(c) for c in WASTE_CELLS], F.col("items"))
    # headings and totals are the file's, and reports without a name are one file
    ends = lines.groupBy("file").agg((F.max(F.size("items")) + 4).alias("last"), *[F.sum(F.col("v")[i]).alias(c) for i, c in enumerate(WASTE_CELLS)])
    ends = ends.select("file", F.lit("waste_ends").alias("kind"), F.lit(None).cast("string").alias("label"), F.col("last").cast("int").alias("place"),
                       F.array(*WASTE_CELLS).alias("v"), F.lit(None).cast(lines.schema["items"].dataType).alias("items"))
    return sales.unionByName(lines).unionByName(ends), {"sales": _sales_layout(), "waste": _waste_lines_layout(), "waste_ends": _waste_ends_layout()}


def report_cells(t: Tables) -> DataFrame:
    """All sheets of the monthly reports that probes read, dealt by file."""
    parts = parts_for(t)
    pl, _ = ledger_rows(t, parts, parties=False)
    other, layouts = other_rows(t, parts)
    return laid_out(pl.unionByName(other), {PL_KIND: _ledger_layout(), **layouts}, parts)


# What the whole numbers of ``packed_rows`` are, by side.
PART_UNITS = ["sales4", "other4", "cogs4", "opex4", "salary4", "fee4", "total2", *WASTE_CELLS]
ORDER_UNITS = ["n_debtors", "n_sales", "total2", "gross4", "disc4", "vat4", "net4", *[f"{n}4" for n in domain.CHANNELS]]
PART_SIDE, ORDER_SIDE, UNNAMED = 0, 1, 2


def packed_rows(t: Tables, parts: int) -> DataFrame:
    """What ``ledger_rows`` and ``other_rows`` give, in two rows for each report and as whole numbers.

    Lines are joined with part once and with orders once; ``unpacked`` makes report rows of these after they have moved by file."""
    file, none = report_file(F.col("entity"), F.col("period")).alias("file"), F.lit(None)
    items, waste = "array<struct<name:string,a:bigint,b:bigint>>", "array<struct<name:string,a:bigint,b:bigint,c:bigint>>"

    def row(df: DataFrame, side: int, units: list[Column], items_: Column, waste_: Column) -> DataFrame:
        return df.select(file, F.lit(side).alias("side"), "entity", "period", F.array(*units).cast("array<bigint>").alias("v"),
                         items_.cast(items).alias("items"), waste_.cast(waste).alias("waste"))

    part = row(domain.reports_by_part(t, parts), PART_SIDE, [F.col(c) for c in PART_UNITS], F.col("items"), F.col("waste"))
    order = row(domain.reports_by_order(t, parts), ORDER_SIDE, [F.col(c) for c in ORDER_UNITS], F.col("items"), none)
    # headings and totals of wastage are the file's, and reports without a name are one file; the first number is that of the lines
    lost = domain.wastage(t).where("entity is null or period is null").groupBy("entity", "period").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in WASTE_CELLS])
    lost = lost.agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in WASTE_CELLS]).where("n is not null").select(none.cast("long").alias("entity"), none.cast("string").alias("period"), "*")
    unnamed = row(lost, UNNAMED, [F.col("n"), *[none] * (len(PART_UNITS) - len(WASTE_CELLS) - 1), *[F.col(c) for c in WASTE_CELLS]], none, none)
    return part.unionByName(order).unionByName(unnamed)


def unpacked(packed: DataFrame) -> DataFrame:
    """Report rows of ``packed_rows``."""
    kinds = "array<struct<kind:string,label:string,place:int,v:array<double>,items:array<struct<name:string,a:double,b:double,c:double>>>>"
    none, number = F.lit(None), lambda units, c, scale=4: to_double(F.col("v")[units.index(c)], scale)

    def row(kind: str, label, place, v: list[Column], items) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.cast("string").alias("label"), place.cast("int").alias("place"),
                        F.array(*[x.cast("double") for x in v]).alias("v"), items.alias("items"))

    blank = none.cast("array<struct<name:string,a:double,b:double,c:double>>")
    packed = packed.withColumn("month", domain.month_of_period(F.col("period")))
    month_num, month = F.substring("period", 6, 2).cast("int"), F.col("month")
    u = {c: F.col("v")[i] for i, c in enumerate(PART_UNITS)}
    incomes, spent = u["sales4"] + u["other4"], u["opex4"] + u["salary4"] + u["fee4"]
    ledger = {"sales_value": u["sales4"], "total_incomes": incomes, "cogs": u["cogs4"], "gross_profit": incomes - u["cogs4"], "operational_expenses": u["opex4"],
              "staff_salary": u["salary4"], "foodmandu_charges": u["fee4"], "total_expenses": spent, "profit": incomes - u["cogs4"] - spent, "bread_income": u["other4"]}
    pl = row(PL_KIND, F.concat(F.lit("Supplier "), F.col("entity").cast("string")), none, [to_double(ledger[c], 4) for _, c in PL_LABELS],
             F.array(F.struct(month.alias("name"), *[none.cast("double").alias(x) for x in "abc"])))
    parties = F.transform("items", lambda x: F.struct(x["name"].alias("name"), to_double(x["a"], 2).alias("a"), to_double(x["b"], 2).alias("b"), none.cast("double").alias("c")))
    wasted = F.transform("waste", lambda x: F.struct(x["name"].alias("name"), *[x[c].cast("double").alias(c) for c in "abc"]))
    lost, n = [number(PART_UNITS, c, 0) for c in WASTE_CELLS], F.coalesce(F.size("waste"), F.lit(0))
    ends = F.when(F.col("side") == UNNAMED, F.col("v")[0]).otherwise(n).cast("int") + 4
    part = F.array(pl, row("creditor", none, none, [number(PART_UNITS, "total2", 2)], parties), F.when(n > 0, row("waste", none, none, lost, wasted)),
                   F.when((n > 0) & F.col("file").isNotNull(), row("waste_ends", none, ends, lost, blank)))
    sales = {"total_sales": number(ORDER_UNITS, "gross4"), "discount": number(ORDER_UNITS, "disc4"), "vat": number(ORDER_UNITS, "vat4"), "net_sales": number(ORDER_UNITS, "net4"),
             **{f"{c}_sales": number(ORDER_UNITS, f"{c}4") for c in domain.CHANNELS}}
    sales |= {"discount_pct": domain.ratio(sales["discount"], sales["total_sales"]), **{f"{c}_pct": domain.ratio(sales[f"{c}_sales"], sales["net_sales"]) for c in domain.CHANNELS}}
    named = F.when(month_num % 2 == 0, month).otherwise(F.upper(F.date_format(F.to_date(F.concat("period", F.lit("-01"))), "MMMM")))
    order = F.array(F.when(F.col("v")[0] > 0, row("debtor", none, none, [number(ORDER_UNITS, "total2", 2)], parties)),
                    F.when(F.col("v")[1] > 0, row("sales", named, month_num, [sales[c] for c in REPORT_SALES], blank)))
    side = F.col("side")
    each = F.when(side == PART_SIDE, part.cast(kinds)).when(side == ORDER_SIDE, order.cast(kinds)).otherwise(F.array(row("waste_ends", none, ends, lost, blank)).cast(kinds))
    return packed.select("file", F.inline(F.array_compact(each))).select(*domain.REPORT_ROW)


def all_cells(t: Tables) -> DataFrame:
    """The cells of the monthly reports with those of ``report_cells``, dealt by file."""
    parts = parts_for(t)
    layouts = {PL_KIND: F.concat(pl_layout(), _ledger_layout()), **{kind: party_layout(*where) for kind, where in PARTY_KINDS.items()},
               "sales": _sales_layout(), "waste": _waste_lines_layout(), "waste_ends": _waste_ends_layout()}
    return laid_out(packed_rows(t, parts), layouts, parts, unpacked)
