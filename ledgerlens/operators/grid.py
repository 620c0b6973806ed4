"""Grid extraction over the long cell table (G1-G8), inventories (S10, S11),
raw cell probes (S17) and audit chunks with their manifest (X9, S13).

A grid is never pivoted wide: each operator is an aggregation keyed by
(file, sheet) or (file, sheet, row), so work spreads over workbooks and
every group is bounded by one sheet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents, to_double
from ..functions.scalar import clean_cell, detect_period, format_long, format_short, plain_number
from ..sources.domain import keep_party_row
from . import chunking, line_packing, sheet_text

# Sheet name -> retrieval section.
SECTION_MAP = {
    "Emilio's Monthly Sales": "Sales Analysis",
    "Emilio's PL": "Profit and Loss",
    "Pokhara PL": "Pokhara Profit and Loss",
    "Food Margin analysis": "Food Margin Analysis",
    "Product Sales - Category wise": "Product Sales by Category",
    "Purchase Analysis": "Purchase Analysis",
    "Cash Flow": "Cash Flow",
    "Creditors Analysis": "Creditors Analysis",
    "Debtors Analysis": "Debtors Analysis",
    "Sample Gift waste": "Wastage and Sample/Gift",
    "Closing Stock ": "Closing Stock",
    "Cash Collection Report": "Cash Collection",
    "Sales Summary ": "Daily Sales Summary",
    "Bread Sales": "Bread Sales",
}
# Our report sheets map the same way: 'PL' is the profit-and-loss sheet.
SECTION_MAP_EXTRA = {"PL": "Profit and Loss"}
INVENTORY_SHOWN = 8
# The reference's display limits.
MAX_COLS, MAX_ROWS, LARGE_SHEET, TOP_CREDITORS = 10, 45, 60, 10
KEY = ["file", "sheet"]
# The header is looked for in the first rows.
HEADER_ROWS = 5


def cell_text(num: Column, txt: Column, short: bool = True) -> Column:
    """Display text of a cell: numbers formatted, text cleaned, else NULL."""
    fmt = format_short(num) if short else format_long(num)
    return F.when(num.isNotNull(), fmt).otherwise(clean_cell(txt))


def raw_text(num: Column, txt: Column) -> Column:
    """Text of a cell as it stands: numbers with all digits, text cleaned, else NULL."""
    return F.when(num.isNotNull(), plain_number(num)).otherwise(clean_cell(txt))


def label_lookup(cells: DataFrame, labels: list[str], col: int, sheet: str | None = None) -> DataFrame:
    """G1: for each label, the value at column ``col`` of the *first* row
    whose trimmed, lower-cased column 0 equals it (non-numeric -> NULL)."""
    c = cells if sheet is None else cells.where(F.col("sheet") == sheet)
    lows = [l.lower() for l in labels]
    # a row's cells meet in one aggregation, so the cells are made and moved once; cells without a place have no value
    placed = F.col("file").isNotNull() & F.col("sheet").isNotNull() & F.col("row_idx").isNotNull()
    at_value = (F.col("col_idx") == col) & placed
    cleaned = F.coalesce(clean_cell(F.col("str_value")), F.col("num_value").cast("string"))
    rows = c.where(F.col("col_idx").isin(0, col)).groupBy(*KEY, "row_idx").agg(
        F.max(F.when(F.col("col_idx") == 0, F.lower(cleaned))).alias("key"),
        F.max(F.when(at_value, F.col("num_value"))).alias("num_value"))
    return rows.where(F.col("key").isin(*lows)).groupBy(*KEY, F.col("key").alias("label")).agg(
        F.min_by("num_value", "row_idx").alias("value"))


def label_lookup_like(cells: DataFrame, labels: list[str], cols: list[int], sheet: str | None = None) -> DataFrame:
    """First row (by row, then listed column) whose lower-cased column 0
    contains the label and whose cell in one of ``cols`` is a number, or text
    not ending in '%'; numbers are formatted in the long form."""
    c = cells if sheet is None else cells.where(F.col("sheet") == sheet)
    labels = list(dict.fromkeys(labels))
    # a row's cells meet in one aggregation, so the cells are made and moved once; cells without a place count for nothing
    text = clean_cell(F.col("str_value"))
    c = c.where(F.col("file").isNotNull() & F.col("sheet").isNotNull() & F.col("row_idx").isNotNull()).select(
        F.xxhash64(*KEY).alias("h"), *KEY, "row_idx", "col_idx", "num_value", text.alias("t"),
        F.when(F.col("col_idx") == 0, F.lower(F.coalesce(text, F.col("num_value").cast("string")))).alias("key"))
    wanted = reduce(lambda a, b: a | b, [F.col("key").contains(x.lower()) for x in labels])
    usable = F.col("col_idx").isin(*cols) & (F.col("num_value").isNotNull() | (F.col("t").isNotNull() & ~F.col("t").endswith("%")))
    value = F.when(F.col("num_value").isNotNull(), format_long(F.col("num_value"))).otherwise(F.col("t"))
    order = F.coalesce(*[F.when(F.col("col_idx") == x, F.lit(i)) for i, x in reversed(list(enumerate(cols)))])
    c = c.withColumn("usable", F.coalesce(usable, F.lit(False))).where(wanted | F.col("usable"))
    c = c.select("h", *KEY, "row_idx", "key", F.when(F.col("usable"), order).alias("place"), F.when(F.col("usable"), value).alias("value"))
    rows = c.groupBy("h", *KEY, "row_idx").agg(*[F.bool_or(F.col("key").contains(x.lower())).alias(f"is{i}") for i, x in enumerate(labels)],
                                               F.min_by("value", "place").alias("value"), F.min("place").alias("place")).where("place is not null")
    of = rows.select("h", *KEY, "row_idx", "value", F.explode(F.array_compact(F.array(*[F.when(F.col(f"is{i}"), F.lit(x)) for i, x in enumerate(labels)]))).alias("label"))
    return of.groupBy("h", *KEY, "label").agg(F.min_by("value", "row_idx").alias("value")).drop("h")


def month_columns(cells: DataFrame, month: Column) -> DataFrame:
    """First cell among the first 8 rows (row-major) equal to the month
    or starting with '<month>,' -> (column, column + 1).  ``month`` is a
    column of the cells frame (e.g. derived from the file)."""
    t = F.lower(F.coalesce(clean_cell(F.col("str_value")), F.col("num_value").cast("string")))
    m = F.lower(month)
    hit = cells.where((F.col("row_idx") < 8) & ((t == m) | t.startswith(F.concat(m, F.lit(",")))))
    g = hit.groupBy(*KEY).agg(F.min(F.struct("row_idx", "col_idx")).alias("p"))
    return g.select(*KEY, F.col("p.col_idx").alias("month_col"), (F.col("p.col_idx") + 1).alias("pct_col"))


def grid_header(cells: DataFrame) -> DataFrame:
    """Columns that hold any value are kept; the header is the first of
    the first five rows with at least two non-empty cells (NULL when none)."""
    nonnull = cells.where(F.col("num_value").isNotNull() | clean_cell(F.col("str_value")).isNotNull())
    # one aggregation: the cells are made once, and a sheet's partial counts are a row for each column
    g = nonnull.groupBy(*KEY).agg(F.count_distinct("col_idx").alias("n_cols"),
                                  *[F.count_if(F.col("row_idx") == r).alias(f"n{r}") for r in range(HEADER_ROWS)])
    first = F.coalesce(*[F.when(F.col(f"n{r}") >= 2, F.lit(r)) for r in range(HEADER_ROWS)])
    return g.select(*KEY, "n_cols", F.when(F.col("file").isNotNull() & F.col("sheet").isNotNull(), first).alias("header_row"))


def row_lines(cells: DataFrame) -> DataFrame:
    """Each row as its non-empty cells joined by ' | ' in column order;
    numbers keep all their digits."""
    t = raw_text(F.col("num_value"), F.col("str_value"))
    r = (cells.select(*KEY, "row_idx", "col_idx", t.alias("t")).where(F.col("t").isNotNull())
              .groupBy(*KEY, "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "t"))).alias("cs")))
    return r.select(*KEY, "row_idx", F.array_join(F.transform("cs", lambda x: x["t"]), " | ").alias("line"))


def section_of(sheet: Column) -> Column:
    """Mapped section, else the trimmed sheet name."""
    m = {**SECTION_MAP, **SECTION_MAP_EXTRA}
    mp = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(mp, sheet), F.trim(sheet))


def sheets(cells: DataFrame) -> DataFrame:
    """(file, sheet, sheet_idx) in workbook order."""
    return cells.select("file", "sheet", "sheet_idx").distinct()


def file_inventory(cells: DataFrame) -> DataFrame:
    """Sheet count and the first 8 sheet names ('...' when more)."""
    g = sheets(cells).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("sheet_idx", "sheet"))).alias("s"))
    names = F.transform("s", lambda x: x["sheet"])
    shown = F.array_join(F.slice(names, 1, INVENTORY_SHOWN), ", ")
    return g.select("file", F.size("s").alias("sheets"),
                    F.concat(shown, F.when(F.size("s") > INVENTORY_SHOWN, F.lit("...")).otherwise(F.lit("")))
                    .alias("sheet_names"))


def audit_inventory(cells: DataFrame) -> DataFrame:
    """File, detected report period (X4), all sheet names, count."""
    g = sheets(cells).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("sheet_idx", "sheet"))).alias("s"))
    year = F.regexp_extract("file", r"(\d{4})\.xlsx$", 1)
    return g.select("file", detect_period(F.col("file"), year=year).alias("period"),
                    F.array_join(F.transform("s", lambda x: x["sheet"]), ", ").alias("sheets"),
                    F.size("s").cast("string").alias("sheet_count"))


def cell_probe(cells: DataFrame, probes: list[tuple[str, str, int, int]]) -> DataFrame:
    """Raw values at fixed (sheet, row, column) coordinates, one column
    per probe name, one row per file."""
    conds = [((F.col("sheet") == s) & (F.col("row_idx") == r) & (F.col("col_idx") == c), name)
             for name, s, r, c in probes]
    hit = None
    for cond, _ in conds:
        hit = cond if hit is None else (hit | cond)
    sel = cells.where(hit)
    return sel.groupBy("file").agg(*[F.max(F.when(cond, F.col("num_value"))).alias(name) for cond, name in conds])


# ------------------------------------------------------------------ markdown and audit chunks
def grid_markdown(cells: DataFrame, max_rows: int | None = None, max_cols: int | None = None, large: int = LARGE_SHEET) -> DataFrame:
    """A sheet as a markdown table.  All-empty columns are dropped and
    the rest renumbered; the header row comes from G4 (blank header cells
    become 'col<i>', trailing 'col...' headers are removed); then the data
    rows, blank ones skipped.  Without a header row: the rows as G6 lines.

    For display, ``max_cols`` columns at most and, of a sheet with more than
    ``large`` rows, the first ``max_rows`` (the reference shows MAX_COLS and
    MAX_ROWS); trailers count the rows and name the columns left out.  A table is
    one text here; ``sheet_lines`` gives its lines as rows, for sheets of any
    length."""
    sheets_ = _shown_cells(cells).groupBy("h", *KEY).agg(F.collect_list("cell").alias("cs"), (F.max("row_idx") + 1).alias("n_rows"), *_header_counts())
    return sheets_.select(*KEY, _header_row().alias("header_row"), "n_rows", "cs").mapInArrow(
        sheet_text.tables(max_rows, max_cols, large), "file string, sheet string, markdown string")


def _shown_cells(cells: DataFrame) -> DataFrame:
    """Cells with their sheet's hash ``h`` (what is sorted by it first is compared by number) and ``cell``, null for those without a text.

    ``t`` is the text that a table shows and ``raw`` that of a number with all its digits."""
    num = F.col("num_value")
    t = cells.where(F.col("file").isNotNull() & F.col("sheet").isNotNull()).select(
        *KEY, "sheet_idx", "row_idx", "col_idx", cell_text(num, F.col("str_value")).alias("t"), F.when(num.isNotNull(), plain_number(num)).alias("raw"), num.isNotNull().alias("number"))
    shown = F.col("t").isNotNull()
    return t.select(F.xxhash64(*KEY).alias("h"), *KEY, "sheet_idx", "row_idx", shown.alias("shown"), (shown | F.col("number")).alias("any"),
                    F.when(shown & F.col("col_idx").isNotNull(), F.struct("row_idx", "col_idx", "t", "raw")).alias("cell"))


def _header_counts() -> list[Column]:
    return [F.count_if(F.col("any") & (F.col("row_idx") == r)).alias(f"n{r}") for r in range(HEADER_ROWS)]


def _header_row() -> Column:
    return F.coalesce(*[F.when(F.col(f"n{r}") >= 2, F.lit(r)) for r in range(HEADER_ROWS)])


def sheet_lines(cells: DataFrame, record: Column | None = None, blocks: bool = False) -> DataFrame:
    """G5 line by line: (file, sheet, line_no, line) of every sheet's whole table.

    Line 1 is the header and line 2 the separator, a data row is line 3 + its row
    number; a sheet without a header row, or whose headers are all unnamed, has
    its rows as G6 lines.  Blank rows have no line.  A sheet comes in blocks of
    rows, of which only columns and header meet, so sheets may have any number of
    rows.  With ``record``, a text of file and sheet, it is line 0 of each sheet
    that has lines, and ``sheet_idx`` is given.  With ``blocks`` the lines are left
    in their blocks, as ``line_packing.pack_lines`` takes them."""
    parts = _shown_cells(cells).groupBy("h", *KEY, F.expr(f"row_idx div {line_packing.BLOCK}").alias("part")).agg(
        F.collect_list("cell").alias("cs"), F.collect_set("sheet_idx").alias("idxs"), F.min(F.when(F.col("shown"), F.col("row_idx"))).alias("first_row"), *_header_counts())
    whole = Window.partitionBy("h", *KEY)
    here = F.array_distinct(F.col("cs")["col_idx"])
    parts = parts.select(*KEY, "h", "part", "cs", F.max(_header_row()).over(whole).alias("header_row"), F.min("first_row").over(whole).alias("first_row"),
                         F.array_distinct(F.flatten(F.collect_list("idxs").over(whole))).alias("idxs"), (F.min("part").over(whole) < F.max("part").over(whole)).alias("many"))
    parts = parts.withColumn("cols", F.collect_list(F.when(F.col("many"), here)).over(whole)) \
                 .withColumn("tops", F.collect_list(F.when(F.col("many") & (F.col("part") == 0), F.filter("cs", lambda x: x["row_idx"] < HEADER_ROWS))).over(whole))
    parts = parts.select(*KEY, "idxs", "part", F.coalesce("many", F.lit(False)).alias("many"), "cs", "header_row", "first_row", "cols", "tops",
                         (F.lit(None).cast("string") if record is None else record).alias("record"))
    made = parts.mapInArrow(sheet_text.line_blocks(record is not None),
                            "file string, sheet string, sheet_idx int, part long, many boolean, ls array<struct<line_no:bigint,line:string>>")
    names = [*KEY, "sheet_idx"] if record is not None else KEY
    return made.select(*names, "part", "many", F.col("ls")["line"].alias("ls")) if blocks else made.select(*names, F.inline("ls"))


def kpi_summary(cells: DataFrame, business: Column | None = None, creditors: int | None = None, more_lines: DataFrame | None = None) -> DataFrame:
    """G7 (+ A10): per report, P&L highlights found by substring label
    lookup in the month column, the creditors' closing balances with their
    total (the first ``creditors`` rows, if given, and how many are left out; the
    reference shows TOP_CREDITORS), and the debtor total and count.  Lines of
    other sheets come from ``more_lines`` (file, lines; see ``probes``), after the
    highlights.  Reports where nothing was found give no row."""
    labels = ["Sales Value", "Cost of Goods Sold", "Gross Profit", "Net Profit", "Staff Salary"]
    num, text = F.col("num_value"), F.col("text")
    is_pl, is_cred = F.col("sheet") == "PL", F.col("sheet") == "Creditors Analysis"
    at_party = (is_cred | (F.col("sheet") == "Debtors Analysis")) & (F.col("row_idx") >= 3) & F.col("col_idx").isin(0, 4)
    c = cells.where(is_pl | at_party).select(F.xxhash64("file").alias("h"), "file", "row_idx", "col_idx", "num_value", is_pl.alias("is_pl"), is_cred.alias("creditor"),
                                             clean_cell(F.col("str_value")).alias("text"))
    is_pl = F.col("is_pl")
    # what is used more than once is a column of its own, so that it is made once
    c = c.select("*", F.when(is_pl & ((F.col("row_idx") < 8) | (F.col("col_idx") == 0)), F.lower(F.coalesce(text, num.cast("string")))).alias("key"),
                 (is_pl & F.coalesce((F.col("col_idx") != 0) & (num.isNotNull() | (text.isNotNull() & ~text.endswith("%"))), F.lit(False))).alias("valued"))
    value = F.when(F.col("valued"), F.when(num.isNotNull(), format_long(num)).otherwise(text))
    pl = F.struct("row_idx", "col_idx", "key", "valued", value.alias("value"))
    named, closing = (F.col("col_idx") == 0) & text.isNotNull(), (F.col("col_idx") == 4) & num.isNotNull()
    party = F.struct("creditor", "row_idx", F.when(named, text).alias("name"), F.coalesce(F.when(named, keep_party_row(text, F.lit(0.0))), F.lit(False)).alias("kept"),
                     closing.alias("closing"), F.coalesce(F.when(closing, num), F.lit(0.0)).alias("num"), F.when(closing, F.format_number(num, 2)).alias("line"),
                     F.when(closing, cents(num).cast("string")).alias("cents"))
    found = c.select("h", "file", F.when(F.col("key").isNotNull() | F.col("valued"), pl).alias("pl"), F.when(~is_pl & (named | closing), party).alias("party"))
    # a report's cells that tell something meet once; what they say is put together in Python
    j = found.groupBy("h", "file").agg(F.collect_list("pl").alias("pl"), F.collect_list("party").alias("party"))
    if more_lines is None:
        j = j.withColumn("other", F.lit(None).cast("array<string>"))
    else:
        j = j.join(more_lines.select("file", F.col("lines").alias("other")), "file", "full")
    month = F.lower(F.substring(F.regexp_extract("file", r"- (\w+) \d{4}", 1), 1, 3))
    j = j.select("file", month.alias("month"), "pl", "party", "other").mapInArrow(
        sheet_text.report_parts(labels, creditors),
        "file string, other array<string>, hl array<string>, cr array<string>, cr_cents long, unseen long, db_cents long, db_n long")
    j = j.withColumn("cr_total", to_double(F.col("cr_cents"), 2)).withColumn("db_total", to_double(F.col("db_cents"), 2))
    more = F.lit(None).cast("string")
    if creditors is not None:
        more = F.when(F.col("unseen") > 0, F.concat(F.lit("- ...and "), F.col("unseen").cast("string"), F.lit(" more creditors")))

    who = business if business is not None else F.regexp_extract("file", r"^(Supplier \d+)", 1)
    period = detect_period(F.col("file"), year=F.regexp_extract("file", r"(\d{4})\.xlsx$", 1))
    head = F.array(F.concat(F.lit("Audit KPI Summary for "), who), F.concat(F.lit("Source file: "), F.col("file")),
                   F.concat(F.lit("Report period: "), period), F.concat(F.lit("Business: "), who))
    hl_part = F.when(F.size("hl") > 0, F.concat(
        F.array(F.lit("Profit & Loss highlights:")), F.col("hl"))).otherwise(
        F.array().cast("array<string>"))
    cr_part = F.when(F.size("cr") > 0, F.concat(
        F.array(F.lit("Top creditors:")), F.col("cr"),
        F.array(F.concat(F.lit("- Total creditor closing balance (top entries): "),
                         F.format_number("cr_total", 2))), F.array_compact(F.array(more)))).otherwise(F.array().cast("array<string>"))
    db_part = F.when(F.col("db_n") > 0, F.array(F.concat(
        F.lit("- Total debtor closing balance: "), F.format_number("db_total", 2), F.lit(" across "),
        F.col("db_n").cast("string"), F.lit(" customers")))).otherwise(F.array().cast("array<string>"))
    other = F.coalesce("other", F.array().cast("array<string>"))
    lines = F.concat(head, hl_part, other, cr_part, db_part)
    return j.select("file", period.alias("report_period"), F.when(F.col("file").isNotNull(), lines).alias("lines")).where(F.size("lines") > 4) \
            .select("file", "report_period", F.array_join("lines", "\n").alias("text"))


def audit_chunks(cells: DataFrame, chunk_size: int = chunking.SHEET_CHUNK_SIZE,
                 dataset: str = "Supplier Audit Dataset") -> DataFrame:
    """Per report an overview chunk, a KPI chunk (G7) and the sheet
    chunks (the whole sheet's G5 lines below a record header, packed by X8),
    with metadata."""
    inv = audit_inventory(cells)
    overview = inv.select(
        "file", F.col("period").alias("report_period"), F.lit(0).alias("part"), F.lit(0).alias("sub"),
        F.lit("Audit Data Overview").alias("section"), F.lit("Overview").alias("sheet_name"),
        F.concat_ws("\n", F.lit(dataset), F.concat(F.lit("File: "), F.col("file")),
                    F.concat(F.lit("Period: "), F.col("period")), F.concat(F.lit("Sheets: "), F.col("sheets")),
                    F.lit("Data categories: sales, P&L, food margin, purchases, cash flow, creditors, debtors, "
                          "wastage, inventory.")).alias("text"))
    kpi = kpi_summary(cells).select("file", "report_period", F.lit(1).alias("part"), F.lit(0).alias("sub"),
                                    F.lit("Audit KPI Summary").alias("section"),
                                    F.lit("KPI Summary").alias("sheet_name"), "text")
    period = detect_period(F.col("file"), year=F.regexp_extract("file", r"(\d{4})\.xlsx$", 1))
    header = F.concat(F.lit("Audit Record | Period: "), period, F.lit(" | File: "), F.col("file"),
                      F.lit(" | Sheet: "), F.col("sheet"))
    packed = line_packing.pack_lines(sheet_lines(cells, header, blocks=True), [*KEY, "sheet_idx"], chunk_size)
    sheet_chunks = packed.select(
        "file", period.alias("report_period"), (F.col("sheet_idx") + 2).alias("part"), F.col("pos").alias("sub"),
        section_of(F.col("sheet")).alias("section"), F.col("sheet").alias("sheet_name"), F.col("chunk").alias("text"))
    allc = overview.unionByName(kpi).unionByName(sheet_chunks.select(
        "file", "report_period", "part", "sub", "section", "sheet_name", "text"))
    return allc.select(
        F.concat(F.lit("audit_"), F.sha2("file", 256), F.lit("_"), F.format_string("%02d", "part"),
                 F.lit("_"), F.format_string("%03d", "sub")).alias("chunk_id"),
        F.lit(0).alias("page"), "section", F.lit("audit_data").alias("source_type"), F.col("file").alias("file_name"),
        "sheet_name", "report_period", "text")


def ingest_manifest(chunks: DataFrame) -> DataFrame:
    """Per audit file, its chunk count, period and the last line of its
    overview chunk."""
    a = chunks.where(F.col("source_type") == "audit_data")
    is_overview = (F.col("section") == "Audit Data Overview") & F.col("file_name").isNotNull()
    overview = F.struct("report_period", F.element_at(F.split("text", "\n"), -1).alias("last_line"))
    g = a.groupBy("file_name").agg(F.count("*").alias("chunks"), F.collect_list(F.when(is_overview, overview)).alias("ov"))
    return g.select("file_name", "chunks", F.explode_outer("ov").alias("ov")).select("file_name", "chunks", "ov.report_period", "ov.last_line")


def pl_from_cells(cells: DataFrame, labels: list[tuple[str, str]], col: int = 1) -> DataFrame:
    """S3: a P&L per report from the cell table — G1 lookups of every label
    in the month column, pivoted to one column per line (explicit pivot
    values: no extra pass), ratios by safe division."""
    from ..sources.domain import PL_COLUMNS, ratio
    lk = label_lookup(cells, [l for l, _ in labels], col, sheet="PL")
    names = {l.lower(): c for l, c in labels}
    wide = lk.groupBy("file").pivot("label", list(names)).agg(F.first("value"))
    for low, c in names.items():
        wide = wide.withColumnRenamed(low, c)
    m = F.regexp_extract("file", r"^Supplier (\d+) Monthly Report - (\w+) (\d{4})\.xlsx$", 0)
    ent = F.regexp_extract("file", r"^Supplier (\d+) ", 1).cast("bigint")
    per = F.date_format(F.to_date(F.regexp_extract("file", r"- (\w+ \d{4})\.xlsx$", 1), "MMMM yyyy"), "yyyy-MM")
    d = wide.where(m != "").withColumn("entity", ent).withColumn("period", per)
    from ..sources.domain import month_of_period
    d = (d.withColumn("month", month_of_period(F.col("period")))
          .withColumn("gross_margin", ratio(F.col("gross_profit"), F.col("total_incomes")))
          .withColumn("cogs_ratio", ratio(F.col("cogs"), F.col("total_incomes")))
          .withColumn("profit_margin", ratio(F.col("profit"), F.col("total_incomes")))
          .withColumn("salary_to_sales", ratio(F.col("staff_salary"), F.col("sales_value"))))
    return d.select(*PL_COLUMNS)


def pl_from_cells_legacy(cells: DataFrame, labels: list[tuple[str, str]], month_cols: dict[int, int]) -> DataFrame:
    """Many months from one workbook's columns.  ``month_cols`` maps a
    value column to its month; the year comes from the file name.  Each
    (file, month) with any value becomes a P&L row (G1 per column)."""
    from ..sources.domain import PL_COLUMNS, month_of_period, ratio
    c = cells.where(F.col("sheet") == "PL")
    names = {l.lower(): col for l, col in labels}
    cmap = F.create_map(*[x for col, mon in month_cols.items() for x in (F.lit(col), F.lit(mon))])
    # a row's cells meet in one aggregation, so the cells are made and moved once; cells without a place count for nothing
    c = c.where(F.col("file").isNotNull() & F.col("row_idx").isNotNull()).select(
        F.xxhash64("file").alias("h"), *KEY, "row_idx",
        F.when(F.col("col_idx") == 0, F.lower(F.coalesce(clean_cell(F.col("str_value")), F.col("num_value").cast("string")))).alias("key"),
        F.when(F.col("col_idx").isin(*month_cols), F.struct("col_idx", "num_value")).alias("cell"))
    rows = c.groupBy("h", *KEY, "row_idx").agg(F.collect_set("key").alias("keys"), F.collect_list("cell").alias("cs"))
    j = rows.select("h", "file", "row_idx", F.explode("keys").alias("key"), "cs").where(F.col("key").isin(*names)).select("h", "file", "row_idx", "key", F.inline("cs"))
    first = j.groupBy("h", "file", "col_idx", "key").agg(F.min_by("num_value", "row_idx").alias("v"))
    wide = first.groupBy("file", "col_idx").pivot("key", list(names)).agg(F.first("v"))
    for low, col in names.items():
        wide = wide.withColumnRenamed(low, col)
    year = F.regexp_extract("file", r"(\d{4})\.xlsx$", 1)
    period = F.concat(year, F.lit("-"), F.lpad(F.try_element_at(cmap, F.col("col_idx")).cast("string"), 2, "0"))
    ent = F.regexp_extract("file", r"^Supplier (\d+) ", 1).cast("bigint")
    d = (wide.withColumn("entity", ent).withColumn("period", period)
             .withColumn("month", month_of_period(F.col("period")))
             .withColumn("gross_margin", ratio(F.col("gross_profit"), F.col("total_incomes")))
             .withColumn("cogs_ratio", ratio(F.col("cogs"), F.col("total_incomes")))
             .withColumn("profit_margin", ratio(F.col("profit"), F.col("total_incomes")))
             .withColumn("salary_to_sales", ratio(F.col("staff_salary"), F.col("sales_value"))))
    present = None
    for col in names.values():
        present = F.col(col).isNotNull() if present is None else (present | F.col(col).isNotNull())
    return d.where(present).select(*PL_COLUMNS)
