"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to the
vector of its segments' bit counts.  The Manhattan distance of two vectors
never exceeds the Hamming distance of the fingerprints, so pairs within
``max_bits`` = 3 bits are found by a grid range-join of the vectors and then
verified bit by bit.

The vector is kept as one long: each count 0, 1, 2 written in unary as 00, 01,
11, so the Manhattan distance is the bit count of an XOR.  Two vectors at
distance 3 or less are at distance 1 or less in one half of the coordinates:
the grid has one cell per half vector, and a row visits its own cell and, if
the sum of its half is even, the cells one step away (two vectors one step
apart have sums of different parity, so the even one always visits the other).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_text

MAX_BITS = 3
BLOCK = 2048
LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles (repeats included); zero for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    whole, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65536):
        h = np.array([digest(whole[a:b], seed) for a, b in zip(starts[at:at + 65536], stops[at:at + 65536])], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """Append ``simhash`` (the 64 bits as a signed long)."""
    def make():
        def work(texts):
            f = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64)
            return [pa.array(f.view(np.int64), pa.int64())]
        return work

    return map_text(docs, make, [("simhash", T.LongType())], text_col, keep)


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def embedded(fp: Column) -> Column:
    """Counts of set bits per two-bit segment, in unary."""
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(F.lit(LOW)), 1))


def _steps(cell: Column) -> Column:
    """The half vectors one step away: 00 to 01, 01 to 00 or 11, 11 to 01, in any segment."""
    moves = []
    for i in range(16):
        low, high = F.lit(1 << 2 * i), F.lit(2 << 2 * i)
        has_low, has_high = cell.bitwiseAND(low) != 0, cell.bitwiseAND(high) != 0
        moves += [F.when(~has_high, cell.bitwiseXOR(low)), F.when(has_low, cell.bitwiseXOR(high))]
    return F.array_compact(F.array(*moves))


def _visits(fps: DataFrame) -> DataFrame:
    """Rows (half, cell, own, fp): the grid cells each fingerprint visits."""
    t = fps.select("fp", embedded(F.col("fp")).alias("t"))
    halves = t.select("fp", F.explode(F.array(
        F.struct(F.lit(0).cast("byte").alias("half"), F.shiftrightunsigned("t", 32).alias("cell")),
        F.struct(F.lit(1).cast("byte").alias("half"), F.col("t").bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")))).alias("h")
    ).select("fp", "h.half", "h.cell")
    own = F.struct(F.col("cell").alias("cell"), F.lit(True).alias("own"))
    near = F.transform(_steps(F.col("cell")), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own")))
    cells = F.when(F.bit_count("cell") % 2 == 0, F.concat(F.array(own), near)).otherwise(F.array(own))
    return halves.select("fp", "half", F.explode(cells).alias("c")).select("half", "c.cell", "c.own", "fp")


def _unary(x: np.ndarray) -> np.ndarray:
    up, low = x >> np.uint64(1), np.uint64(LOW)
    return ((x | up) & low) | ((x & up & low) << np.uint64(1))


def spanning_links(own: np.ndarray, near: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that join what the pairs own x own and own x near join: one per member that is not the least of its class.

    Fingerprints that all lie within the distance of one another share a class
    after the first row, so what is sent on grows with the members, not the pairs.
    """
    members = np.unique(np.concatenate([own, near])).astype(np.int64)
    label = np.arange(len(members))
    bits = members.view(np.uint64)
    low = _unary(bits)
    probe = np.searchsorted(members, np.unique(own))
    for i in probe:
        maybe = np.flatnonzero(np.bitwise_count(low ^ low[i]) <= max_bits)
        hit = maybe[np.bitwise_count(bits[maybe] ^ bits[i]) <= max_bits]
        met = np.unique(label[hit])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    first = np.full(len(members), len(members))
    np.minimum.at(first, label, np.arange(len(members)))
    root = first[label]
    moved = np.flatnonzero(root != np.arange(len(members)))
    return list(zip(members[moved].tolist(), members[root[moved]].tolist()))


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose classes are those of all pairs within ``max_bits``.

    A cell with more than ``block`` visits is cut into blocks by hash, and every
    pair of blocks is a task of its own of about twice that size, so no cell is
    gathered whole however many fingerprints it holds, and none is left out.
    """
    visits = _visits(fps)
    sizes = visits.groupBy("half", "cell").agg(F.count_if("own").alias("n_own"), F.count(F.lit(1)).alias("n"))
    sizes = sizes.where((F.col("n_own") > 0) & (F.col("n") > 1)).select(
        "half", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = visits.join(sizes, ["half", "cell"]).withColumn("at", F.pmod(F.xxhash64("fp", F.lit(7)), "blocks").cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least("at", x).alias("i"), F.greatest("at", x).alias("j")))
    groups = placed.select("half", "cell", "own", "fp", F.explode(tasks).alias("task")).groupBy("half", "cell", "task").agg(
        F.collect_list(F.when(F.col("own"), F.col("fp"))).alias("own"), F.collect_list(F.when(~F.col("own"), F.col("fp"))).alias("near"))

    def run(batches):
        for b in batches:
            found = []
            for own, near in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if own and len(own) + len(near) > 1:
                    found += spanning_links(np.array(own, np.int64), np.array(near, np.int64), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return groups.select("own", "near").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that is not the least of its component.

    Alternates large-star and small-star steps; each round is checkpointed, so
    lineage stays short and no table of links reaches the driver.
    """
    def stars(e):
        return e.where("u <> v").distinct()

    edges = checkpoint(stars(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stars(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(stars(small.unionByName(least.select("u", F.col("m").alias("v")))))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None,
                    shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """Append ``simhash`` and ``component_id``, the least id reachable by links of at most ``max_bits`` bits.

    Null and empty texts have fingerprint zero and link like any other; equal
    fingerprints are merged before the search, so copies cost one row; rows with
    a null id take part in links but never name a component (it is null if all
    its ids are).  One row out for each row in; an empty table gives none.
    ``max_bits`` may be 0 to 3, the reach of the grid.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid reaches 3 bits")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("simhash", "component_id")]
    marked = checkpoint(fingerprints(docs, text_col, list(dict.fromkeys([*keep, id_col])), shingle))
    fps = checkpoint(marked.groupBy(F.col("simhash").alias("fp")).agg(F.min(id_col).alias("rep")))
    roots = components(links(fps.select("fp"), max_bits))
    classes = fps.join(roots, fps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = classes.join(least, "root").select(F.col("fp").alias("simhash"), "component_id")
    return marked.join(named, "simhash").select(*[F.col(f"`{c}`") for c in keep], "simhash", "component_id")
