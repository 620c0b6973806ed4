"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight; in the
order of the keys this is sampling without replacement in proportion to the
weights.  A source that is to give more than it has is taken whole as often as
its target holds it (complete epochs); the rest is a prefix of its documents in
key order whose sizes add up to what is missing.

DataFrame functions only.  The order within a source is never one task's: keys
fall into bands, band totals tell which band the budget ends in, and only that
band's documents are ordered.  The last document taken then decides for all
others, so whole documents are not dealt out for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

WEIGHTS, SHARE, CAP, BANDS, SEED = (5, 2, 1), 1.5, 2, 4096, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A draw in (0, 1) that depends on the seed and the id alone: 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes; no target exceeds ``cap`` times its source's size, and
    what is over is shared anew by weight.  That settles at min(cap, level *
    weight): in the order of cap / weight the full sources come first, and the
    level is what they leave divided by the weights of the others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", w).withColumn(
        "cap", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the first source, in order of ratio, that the level does not fill sets the level for it and all after it
    filled = ranked.withColumn("level", level).withColumn("settled", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    settled = F.first("settled", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("level", settled).select("source", "source_size", F.when(
        F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("cap")), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _sent(table: DataFrame, most: int = 10_000) -> DataFrame:
    """A small table ready to be sent to every task; one with more rows than ``most`` is left to a shuffled join."""
    rows = table.limit(most + 1).collect()
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema)) if len(rows) <= most else table


def cuts(small: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per source: size, target, complete epochs, and the last document that the fraction takes (band and place).

    ``small`` has (source, size, band, place), ``place`` a struct that orders the documents.
    """
    totals = small.groupBy("source", "band").agg(F.sum("size").alias("band_size"))
    sizes = totals.groupBy("source").agg(F.sum("band_size").alias("source_size"))
    goal = targets(sizes, weights, share, cap).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s")
    upto = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("before", F.coalesce(F.sum("band_size").over(upto), F.lit(0)))
    over = before.join(goal, F.col("source").eqNullSafe(F.col("s"))).where(F.col("before") + F.col("band_size") > F.col("rest"))
    ends = over.groupBy("s").agg(F.min("band").alias("end_band"), F.min_by("before", "band").alias("before"), F.first("rest").alias("rest"))
    inside = Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = small.join(_sent(ends), F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("end_band"))).withColumn(
        "inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).where(
        F.col("before") + F.col("inside") + F.col("size") / 2 <= F.col("rest")).groupBy("s").agg(F.max("place").alias("last"))
    ends, last = ends.select(F.col("s").alias("e"), "end_band"), last.withColumnRenamed("s", "l")
    return goal.join(ends, F.col("s").eqNullSafe(F.col("e")), "left").join(last, F.col("s").eqNullSafe(F.col("l")), "left").select(
        "s", "source_size", "target", "epochs", "end_band", "last")


def mix(docs: DataFrame, quality: DataFrame | None = None, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
        keep: list[str] | None = None, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, bands: int = BANDS,
        seed: str = SEED) -> DataFrame:
    """Append ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies * size) to every document.

    ``quality`` (id, quality) scales a document's chance to come early: its
    weight is ``quality`` where positive, 1 where missing or null (the largest, if
    an id has several).  Null texts have size 0.  Rows with equal ids draw equal
    keys and are ordered by a hash of the text; rows that agree in that too are
    taken together.  A document whose middle lies within the missing words is
    taken, so a source misses its target by half a document at most.  A source
    without words gives nothing.  An empty table gives an empty result.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    # what the caller keeps travels as one column, so no name can clash
    kept = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(None).alias("k0"))
    doc = docs.select(kept.alias("kept"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                      word_count(F.col(f"`{text_col}`")).alias("size"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"))
    if quality is not None:
        q = quality.where("id is not null").groupBy(F.col("id").alias("q_id")).agg(F.max("quality").cast("double").alias("quality"))
        # both tables grow with the corpus: dealt out by id at every size
        doc = doc.join(q.hint("merge"), F.col("id") == F.col("q_id"), "left").drop("q_id")
    else:
        doc = doc.withColumn("quality", F.lit(1.0))
    weight = F.when(F.col("quality") > 0, F.col("quality")).otherwise(F.lit(1.0))
    doc = doc.withColumn("key", -F.ln(uniform(F.col("id"), seed)) / weight).select(
        "kept", "source", "size", F.floor((1 - F.exp(-F.col("key"))) * bands).cast("int").alias("band"),
        F.struct("key", "id", "tie").alias("place"))
    small = checkpoint(doc.drop("kept"))
    cut = _sent(cuts(small, weights, share, cap))
    known = (small.withColumn("kept", F.struct(F.col("place.id").alias("k0"))) if keep == [id_col] else doc).join(
        cut, F.col("source").eqNullSafe(F.col("s")))
    chosen = (F.col("band") < F.col("end_band")) | ((F.col("band") == F.col("end_band")) & (F.col("place") <= F.col("last")))
    copies = (F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("long")).cast("long")
    return known.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target",
                        copies.alias("copies"), (copies * F.col("size")).alias("taken"))
