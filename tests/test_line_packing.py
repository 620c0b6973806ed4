"""Packing by prefix scan equals packing one text, and sheets of any size are indexed whole."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import chunking, grid, line_packing

CELLS = "file string, sheet string, sheet_idx int, row_idx int, col_idx int, str_value string, num_value double"


def greedy(lines, size):
    """X8 as written down: one chunk if the text fits, else whole lines, the table header repeated, blank chunks left out."""
    if len("\n".join(lines)) <= size:
        return ["\n".join(lines)]
    header = line_packing.table_header(lines)
    done, cur, used = [], [], 0
    for x in lines:
        if used + len(x) + 1 > size and cur:
            done.append(cur)
            cur, used = list(header), sum(len(h) + 1 for h in header)
        cur, used = [*cur, x], used + len(x) + 1
    return [c for c in ("\n".join(x) for x in [*done, cur]) if c.strip(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")]


def test_maps_compose_to_the_walk():
    rnd = random.Random(3)
    for _ in range(200):
        size, header = rnd.randrange(3, 40), rnd.choice([0, 0, 5, 50])
        lens = [rnd.choice([1, 2, 5, 9, 60]) for _ in range(rnd.randrange(2, 40))]
        state, closed, k = 0, 0, 0
        starts = []
        while k < len(lens):
            n = rnd.randrange(1, 9)
            part = lens[k:k + n]
            starts += [k + j for j in line_packing.cut_block(part, header, size, state, k > 0)]
            to, count = line_packing.block_map(part, header, size)
            state, closed, k = int(to[state]), closed + int(count[state]), k + n
        used, expected = 0, []
        for j, x in enumerate(lens):
            if used + x > size and j > 0:
                expected.append(j)
                used = header
            used += x
        assert starts == expected
        assert closed == len(expected) + (lens[0] > size)  # the first line never closes an empty chunk


TEXTS = {
    "table": ["record", "| a | b |", "| --- | --- |", *[f"| {i} | {'x' * (i * 7 % 23)} |" for i in range(90)]],
    "long first": ["y" * 300, *["z" * (i % 5) for i in range(70)]],
    "blank": ["", " ", *[""] * 150, "end"],
    "no separator": ["| only | pipes |", *["| r |"] * 60],
    "short": ["one", "two"],
    "single": ["w" * 500],
    "sparse": ["line " + str(i) for i in range(30)],
}


def test_scan_equals_one_text(spark):
    rows = [(k, i * (40 if k == "sparse" else 1) + (100 if k == "no separator" else 0), x, "c", 1) for k, ls in TEXTS.items() for i, x in enumerate(ls)]
    rows.append(("null", 3, None, "c", 1))
    lines = spark.createDataFrame(rows, "k string, line_no long, line string, chunk string, part int").repartition(5)
    for block in (41, 64, 4096):
        got = {}
        for r in line_packing.pack_lines(lines, ["k"], 40, block).collect():
            got.setdefault(r.k, []).append((r.pos, r.chunk))
        for k, ls in {**TEXTS, "null": [""]}.items():
            assert [c for _, c in sorted(got.get(k, []))] == greedy(ls, 40), (k, block)
            assert sorted(p for p, _ in got.get(k, [])) == list(range(len(greedy(ls, 40))))
    assert line_packing.pack_lines(lines.limit(0), ["k"], 40, 41).count() == 0
    with pytest.raises(ValueError):
        line_packing.pack_lines(lines, ["k"], 40, 40)


def sheet(spark, rows, file="Supplier 7 Monthly Report - March 1998.xlsx", name="PL"):
    out = [(file, name, 0, r, c, v if isinstance(v, str) else None, float(v) if not isinstance(v, str) else None) for r, cs in rows.items() for c, v in cs.items()]
    return spark.createDataFrame(out, CELLS)


def test_lines_of_a_wide_and_long_sheet_equal_its_table(spark):
    wide = {0: {0: "title"}, 2: {c: f"h{c}" for c in range(0, 30, 2)} | {31: "col x"}, **{r: {c: r * 100 + c for c in range(r % 3, 32, 3)} for r in range(3, 200)}, 210: {1: "  "}}
    plain = {5: {0: "a", 3: 2}, 7: {0: "b"}}
    cells = sheet(spark, wide).unionByName(sheet(spark, plain, name="Notes")).unionByName(sheet(spark, {0: {0: "col1", 1: "col2"}, 1: {0: "v"}}, name="Cols"))
    lines = {}
    for r in grid.sheet_lines(cells).orderBy("line_no").collect():
        lines.setdefault(r.sheet, []).append(r.line)
    whole = {r.sheet: r.markdown for r in grid.grid_markdown(cells.where("sheet <> 'Cols'")).collect()}
    assert "\n".join(lines["PL"]) == whole["PL"] and len(lines["PL"]) == 199 and "h28" in lines["PL"][0]
    assert "\n".join(lines["Notes"]) == whole["Notes"] == "a | 2\nb"
    assert lines["Cols"] == ["col1 | col2", "v"]
    shown = {r.sheet: r.markdown for r in grid.grid_markdown(cells.where("sheet = 'PL'"), grid.MAX_ROWS, grid.MAX_COLS).collect()}["PL"]
    assert "additional rows not shown" in shown and shown.endswith("*columns not shown: " + ", ".join(lines["PL"][0].strip("| ").split(" | ")[10:]) + "*")


def test_every_row_of_a_long_sheet_is_indexed(spark):
    n = 10_000
    cells = spark.range(n).select(F.lit("Supplier 7 Monthly Report - March 1998.xlsx").alias("file"), F.lit("PL").alias("sheet"), F.lit(0).alias("sheet_idx"), (F.col("id") + 1).cast("int").alias("row_idx"),
                                  F.explode(F.array(F.struct(F.lit(0).alias("col_idx"), F.concat(F.lit("row "), "id").alias("str_value"), F.lit(None).cast("double").alias("num_value")),
                                                    F.struct(F.lit(11).alias("col_idx"), F.lit(None).cast("string").alias("str_value"), F.col("id").cast("double").alias("num_value")))).alias("c")).select("file", "sheet", "sheet_idx", "row_idx", "c.*")
    cells = cells.unionByName(sheet(spark, {0: {0: "name", 11: "amount"}}))
    chunks = [r.text for r in grid.audit_chunks(cells).where("sheet_name = 'PL'").orderBy("chunk_id").collect()]
    found = [x for c in chunks for x in c.split("\n") if x.startswith("| row ")]
    assert len(found) == n and len(set(found)) == n
    assert all(len(c) <= chunking.SHEET_CHUNK_SIZE and "| name | amount |" in c for c in chunks)


def test_creditors_left_out_are_counted(spark):
    file = "Supplier 7 Monthly Report - March 1998.xlsx"
    cells = sheet(spark, {3 + i: {0: f"c{i}", 4: i + 1} for i in range(25)}, file, "Creditors Analysis")
    every, ten = grid.kpi_summary(cells).first().text, grid.kpi_summary(cells, creditors=grid.TOP_CREDITORS).first().text
    assert every.count("closing balance") == 26 and "325.00" in every and "more creditors" not in every
    assert ten.count("closing balance") == 11 and "55.00" in ten and ten.endswith("- ...and 15 more creditors")
