"""Text sources and chunkers: cleaned pages (S14), overlapping character
chunks (X7), markdown summary sections (S15) and line-packing chunks for
tables (X8).

Overlapping windows are cut in Arrow batches, in time proportional to the
text; line packing runs inside one row as a Spark ``aggregate`` function.
Chunk ids are (document, position) based: a global counter would force the
whole corpus through one partition."""

from __future__ import annotations

import bisect
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import detect_section, low_quality_chunk, low_quality_page, normalize_text, strip_ws

# The reference's chunking defaults.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 150
SHEET_CHUNK_SIZE = 900

# Tasks get the functions of this module by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PIECES = "array<struct<s:int,e:int,piece:string>>"


def cut_points(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    """X7 windows of one text, from an index of its sentence ends: a window of
    ``size`` characters that does not reach the end of the text is cut back to
    its last sentence end, if that lies past its middle; the next one begins
    ``overlap`` characters before.  The work grows with the text's length."""
    stops = [m.start() + 1 for m in re.finditer(r"\.(?= )", text)]
    spans, s = [], 0
    while s + size < len(text):
        at = bisect.bisect_left(stops, s + size) - 1
        e = stops[at] if at >= 0 and stops[at] > s + size // 2 + 1 else s + size
        spans.append((s, e))
        s = max(e - overlap, s + 1)
    return [*spans, (s, len(text))]


def chunk_pieces(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of every text with their pieces, array<struct<s, e, piece>>
    (0-based code points, end exclusive), in Arrow batches; null for null.

    A built-in loop was measured to take quadratic time: each ``substr`` walks
    the text from its start."""

    @F.arrow_udf(_PIECES)
    def pieces(texts: pa.Array) -> pa.Array:
        offsets, starts, ends, parts, null = [0], [], [], [], []
        for t in texts.to_pylist():
            null.append(t is None)
            for s, e in cut_points(t, size, overlap) if t is not None else ():
                starts.append(s)
                ends.append(e)
                parts.append(t[s:e])
            offsets.append(len(starts))
        flat = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(parts, pa.string())], ["s", "e", "piece"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array(null, pa.bool_()))

    return pieces(text)


def chunk_spans(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """X7 windows as positions only, array<struct<s, e>>."""
    return F.transform(chunk_pieces(text, size, overlap), lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e")))


def clean_pages(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Normalised text per page; empty and low-quality pages dropped."""
    # The one-row inline is a barrier: the filter below cannot be pushed under
    # it, so the (costly) normalisation runs once, not once per reference.
    d = docs.select("*", F.inline(F.array(F.struct(normalize_text(F.col(text_col)).alias("clean")))))
    return d.where((F.col("clean") != "") & ~low_quality_page(F.col("clean")))


def chunk_text(pages: DataFrame, id_col: str = "doc_id", text_col: str = "clean",
               size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, extra=()) -> DataFrame:
    """X7 + P6 + X6: overlapping chunks of each page, low-quality chunks
    dropped, section detected per chunk.  One projection and an explode:
    no shuffle."""
    cut = pages.select(F.col(id_col).alias("doc_id"), *extra, chunk_pieces(F.col(text_col), size, overlap).alias("_pieces"))
    pieces = F.transform("_pieces", lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.trim(p["piece"]).alias("piece")))
    kept = F.filter(pieces, lambda p: (p["piece"] != "") & ~low_quality_chunk(p["piece"]))
    out = cut.select("doc_id", *extra, F.posexplode(kept).alias("pos", "c"))
    return out.select(*extra,
        F.concat(F.lit("chunk_"), F.col("doc_id").cast("string"), F.lit("_"),
                 F.format_string("%04d", F.col("pos"))).alias("chunk_id"),
        "doc_id", F.col("pos").cast("int").alias("pos"),
        F.col("c.s").alias("start"), F.col("c.e").alias("end"), F.col("c.piece").alias("text"),
        detect_section(F.col("c.piece")).alias("section"))


def markdown_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole summary text as one chunk, plus one chunk per
    ``\\n## `` section (headed with '## ' when missing); section name = first
    line without '#'."""
    raw = F.col(text_col)
    whole = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("pos"),
                        F.concat(F.lit("summary_"), F.col(id_col).cast("string"), F.lit("_0001")).alias("chunk_id"),
                        raw.alias("text"), F.lit("Research Summary").alias("section"))
    parts = F.filter(F.transform(F.split(raw, "\n## "), lambda p: strip_ws(p)), lambda p: p != "")
    headed = F.transform(parts, lambda p: F.when(p.startswith("#"), p).otherwise(F.concat(F.lit("## "), p)))
    secs = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(headed).alias("i", "text"))
    secs = secs.select(
        "doc_id", (F.col("i") + 1).cast("int").alias("pos"),
        F.concat(F.lit("summary_"), F.col("doc_id").cast("string"), F.lit("_"),
                 F.format_string("%04d", F.col("i") + 2)).alias("chunk_id"),
        "text",
        strip_ws(F.regexp_replace(F.split(F.col("text"), "\n").getItem(0), "#", "")).alias("section"))
    return whole.unionByName(secs)


def chunk_lines(text: Column, size: int = SHEET_CHUNK_SIZE) -> Column:
    """Pack whole lines greedily into chunks of at most ``size`` chars
    (a line longer than ``size`` stays whole); after the first chunk each
    chunk restarts with the table header lines (the first '|' lines up to
    and including the '---' separator, looked for in the first 3 lines).
    Texts no longer than ``size`` are one chunk.  Returns array<string>."""
    lines = F.split(text, "\n")
    first3 = F.slice(lines, 1, 3)
    sep_at = F.array_position(F.transform(first3, lambda l: l.startswith("|") & l.contains("---")), True)
    pipe_prefix = F.transform(first3, lambda l: l.startswith("|"))
    # header = leading '|' lines of the first three, cut after the separator if one is there
    upto = F.when(sep_at > 0, sep_at).otherwise(F.lit(3))
    cand = F.slice(first3, 1, upto)
    flags = F.slice(pipe_prefix, 1, upto)
    header = F.filter(F.arrays_zip(cand.alias("l"), flags.alias("f")), lambda z: z["f"])
    header = F.transform(header, lambda z: z["l"])
    header_len = F.aggregate(header, F.lit(0), lambda a, l: a + F.length(l) + F.lit(1))
    init = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"),
                    F.lit(0).alias("cur_len"))

    def step(acc, line):
        ln = F.length(line) + F.lit(1)
        flush = (acc["cur_len"] + ln > F.lit(size)) & (F.size(acc["cur"]) > 0)
        done = F.when(flush, F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n")))).otherwise(acc["done"])
        cur = F.when(flush, F.concat(header, F.array(line))).otherwise(F.concat(acc["cur"], F.array(line)))
        cur_len = F.when(flush, header_len + ln).otherwise(acc["cur_len"] + ln)
        return F.struct(done.alias("done"), cur.alias("cur"), cur_len.alias("cur_len"))

    def finish(acc):
        allc = F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n")))) \
            .otherwise(acc["done"])
        return F.filter(allc, lambda c: strip_ws(c) != "")

    packed = F.aggregate(lines, init, step, finish)
    return F.when(F.length(text) <= F.lit(size), F.array(text)).otherwise(packed)
