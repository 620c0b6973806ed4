"""Typed reading of the long cell table by position.

``read_rows`` turns the cells of one sheet into rows by a row range and a
column map; the readers add the rules of their sheet.  A row is an aggregation
keyed by (file, row), so sheets of any length are spread over the tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import cents, to_double
from ..functions.scalar import MONTH_ORDER, clean_cell, day_name, lenient_date, lenient_number, monday0
from ..sources import domain, sheets
from ..sources.domain import MAX_DAY_TOTAL, MIN_YEAR, keep_party_row, keep_wastage_item
from ..sources.grid import PARTY_SHEETS


@dataclass(frozen=True)
class SheetLayout:
    """Where a sheet keeps its rows: ``columns`` maps a name to its column, which is a number, or text if in ``texts``."""

    sheet: str
    first_row: int
    columns: dict[str, int]
    texts: tuple[str, ...] = ()
    last_row: int | None = None


def read_rows(cells: DataFrame, layout: SheetLayout, sheets_alike: list[str] | None = None) -> DataFrame:
    """(file, row_idx, columns): one row for each row of the range that holds any cell.

    With ``sheets_alike`` the rows of all these sheets, which share the layout, and their ``sheet``.

    A number column takes the cell's number, or its text if that reads as one
    (else null); a text column takes the cell's text, and null where it holds a
    number, as only text counts as a name.  Cells outside the map are not read;
    of two cells in one place the larger value counts."""
    named = F.col("sheet") == layout.sheet if sheets_alike is None else F.col("sheet").isin(*sheets_alike)
    c = cells.where(named & (F.col("row_idx") >= layout.first_row))
    if layout.last_row is not None:
        c = c.where(F.col("row_idx") <= layout.last_row)
    number = F.coalesce(F.when(~F.isnan("num_value"), F.col("num_value")), lenient_number(F.col("str_value")))
    text = F.when(F.col("num_value").isNull(), clean_cell(F.col("str_value")))
    keys = ["file", "row_idx"] if sheets_alike is None else ["file", "sheet", "row_idx"]
    return c.groupBy(*keys).agg(*[
        F.max(F.when(F.col("col_idx") == i, text if name in layout.texts else number)).alias(name) for name, i in layout.columns.items()])


def file_entity(file: Column) -> Column:
    """The number after the first word of a file name."""
    return F.regexp_extract(file, r"^\w+ (\d+) ", 1).try_cast("bigint")


def file_period(file: Column) -> Column:
    """'... - March 1998.xlsx' -> '1998-03'."""
    month = F.array_position(F.array(*[F.lit(m) for m in MONTH_ORDER]), F.substring(F.regexp_extract(file, r"- (\w+) \d{4}\.xlsx$", 1), 1, 3))
    return F.when(month > 0, F.concat(F.regexp_extract(file, r"(\d{4})\.xlsx$", 1), F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def read_monthly_sales(cells: DataFrame) -> DataFrame:
    """Rows 2 to 13 whose first cell is a month's name; the year comes from the file name."""
    rows = read_rows(cells, SheetLayout(sheets.SALES_SHEET, 2, {"month": 0, **sheets.SALES_CELLS}, ("month",), 13))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTH_ORDER]), F.col("month")).cast("int")
    period = F.concat(F.regexp_extract("file", r"(\d{4})\.xlsx$", 1), F.lit("-"), F.lpad(number.cast("string"), 2, "0"))
    return rows.where(F.col("month").isin(*MONTH_ORDER)).select(
        file_entity(F.col("file")).alias("entity"), period.alias("period"), "month", number.alias("month_num"), *sheets.SALES_CELLS)


def read_parties(cells: DataFrame) -> DataFrame:
    """Both party sheets from row 3; named parties with a closing balance that are no total line."""
    layout = SheetLayout("", 3, {"party": 0, "opening": 1, "closing": 4}, ("party",))
    kinds = F.create_map(*[F.lit(x) for kind, sheet, _ in PARTY_SHEETS for x in (sheet, kind)])
    # both sheets in one aggregation, so the cells are made and grouped once
    rows = read_rows(cells, layout, [sheet for _, sheet, _ in PARTY_SHEETS]).withColumn("type", kinds[F.col("sheet")])
    return rows.where(keep_party_row(F.col("party"), F.col("closing"))).select(
        file_entity(F.col("file")).alias("entity"), file_period(F.col("file")).alias("period"), "type", F.trim("party").alias("party"), "opening", "closing",
        to_double(cents("closing") - cents("opening"), 2).alias("movement"))


def read_wastage(cells: DataFrame) -> DataFrame:
    """Items from row 3 without headings and totals; a branch without a number counts 0, a total without one is the branches' sum."""
    rows = read_rows(cells, SheetLayout(sheets.WASTE_SHEET, 3, {"item": 0, **sheets.WASTE_CELLS}, ("item",)))
    ktm, pkr = F.coalesce("ktm", F.lit(0.0)), F.coalesce("pkr", F.lit(0.0))
    return rows.where(keep_wastage_item(F.col("item"))).select(
        file_entity(F.col("file")).alias("entity"), file_period(F.col("file")).alias("period"), F.trim("item").alias("item"), ktm.alias("ktm"), pkr.alias("pkr"),
        F.coalesce(F.nullif("total", F.lit(0.0)), ktm + pkr).alias("total"))


def read_categories(cells: DataFrame) -> DataFrame:
    """Categories from row 2 that have a value in the snapshot's columns."""
    rows = read_rows(cells, SheetLayout(sheets.CATEGORY_SHEET, 2, {"category": 0, **sheets.CATEGORY_CELLS}, ("category",)))
    return rows.where("category is not null and value is not null").select(file_entity(F.col("file")).alias("entity"), F.trim("category").alias("category"), "qty", "value")


def _daily_rows(cells: DataFrame, min_year: int, max_total: float) -> DataFrame:
    layout = SheetLayout(sheets.DAILY_SHEET, 4, {"written": 0, "serial": 0, **sheets.DAILY_CELLS}, ("written",))
    rows = read_rows(cells, layout).withColumn("date", lenient_date(F.col("written")))
    reason = (F.when(F.col("total_sales").isNull(), "no_total")
              .when(F.col("written").isNull() & F.col("serial").isNull(), "no_date")
              .when(F.col("written").isNull(), "old_date")  # a bare number counts from 1970 in nanoseconds
              .when(F.col("date").isNull(), "bad_date")
              .when(F.year("date") < min_year, "old_date")
              .when(F.col("total_sales") > max_total, "large_total"))
    return rows.withColumn("reason", reason).withColumn("entity", file_entity(F.col("file")))


def read_daily_sales(cells: DataFrame, min_year: int = MIN_YEAR, max_total: float = MAX_DAY_TOTAL) -> DataFrame:
    """Days from row 4 whose date reads in any notation of ``lenient_date`` and whose total is in bounds.

    Missing channel amounts count 0; avg_ticket = dine-in / customers when both
    are there and not 0.  Rows left out are in ``rejected_days`` with a reason."""
    d = _daily_rows(cells, min_year, max_total).where("reason is null")
    d = d.select("entity", "date", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("cash", "online", "credit")], "total_sales",
                 F.col("customers").cast("bigint").alias("customers"), "dine_in_sales",
                 F.when((F.col("customers") != 0) & (F.col("dine_in_sales") != 0), F.col("dine_in_sales") / F.col("customers")).alias("avg_ticket"),
                 day_name("date").alias("day_of_week"), monday0("date").cast("int").alias("dow"))
    return d.select(*domain.DAILY_COLUMNS)


def rejected_days(cells: DataFrame, min_year: int = MIN_YEAR, max_total: float = MAX_DAY_TOTAL) -> DataFrame:
    """The rows that ``read_daily_sales`` leaves out: (entity, row_idx, written, total_sales, reason)."""
    d = _daily_rows(cells, min_year, max_total).where("reason is not null")
    return d.select("entity", "row_idx", F.coalesce("written", F.col("serial").cast("string")).alias("written"), "total_sales", "reason")
