"""Routing between sources of the same rows.

A key's rows come from the first source that has the key.  Presence is one
aggregation over the keys, so neither keys nor rows pass through the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    name: str
    rows: DataFrame


def first_present(sources: list[Source], key: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """The rows of every key from the first listed source that has it, with the source's name as ``route``.

    With ``wanted`` (distinct on ``key``), only its keys count, and a wanted key
    that no source has gives one row with a null route.  Null keys take no part."""
    tagged = None
    for i, s in enumerate(sources):
        rows = s.rows.withColumns({"route": F.lit(s.name), "__at": F.lit(i)})
        tagged = rows if tagged is None else tagged.unionByName(rows)
    names = [f.name for f in tagged.schema.fields if f.name not in (*key, "__at", "route")]
    present = tagged.groupBy(*key).agg(F.min("__at").alias("__first"))
    if wanted is not None:
        present = wanted.select(*key).distinct().join(present, key, "left")
    chosen = present.withColumnRenamed("__first", "__at").join(tagged, [*key, "__at"], "left")
    kept = chosen if wanted is not None else chosen.where(F.col("route").isNotNull())
    return kept.select(*key, *names, "route")


def by_coverage(primary: Source, fallback: Source, entity: str, unit: str, wanted: DataFrame, least: int) -> DataFrame:
    """Rows of the wanted units (distinct values of ``unit``), for every entity from one source alone.

    An entity that has at least ``least`` of the wanted units in the primary
    source takes all its rows from there; any other takes the fallback's rows.
    An entity below ``least`` that the fallback lacks gives no row."""
    units = wanted.select(unit).distinct()
    both = None
    for i, source in enumerate((primary, fallback)):
        rows = source.rows.join(units, unit, "left_semi").withColumns({"route": F.lit(source.name), "__at": F.lit(i)})
        both = rows if both is None else both.unionByName(rows)
    # an entity's wanted rows meet once, and each source is read once
    whole = Window.partitionBy(entity)
    here = F.size(F.collect_set(F.when(F.col("__at") == 0, F.col(unit))).over(whole))
    full = (here >= least) & F.col(entity).isNotNull()
    return both.withColumn("__full", full).where((F.col("__at") == 0) == F.col("__full")).drop("__at", "__full")
