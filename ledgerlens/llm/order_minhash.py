"""Document fingerprints by order MinHash.

The k-mers of a text are numbered by occurrence, so each is distinct.  For
every hash function the ``width`` k-mers with the least hashes are selected,
put back in text order and hashed together.  Two texts agree in such a tuple
only if they share the k-mers and their order, which follows the edit distance
rather than the shared vocabulary alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT, id_ranges, map_text, range_of, shuffle_partitions, text_slices

K, WIDTH, HASHES = 12, 2, 32
ODD = 0x9E3779B97F4A7C15
BLOCK = 2048
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class OrderMinHash:
    """``hashes`` tuples of ``width`` k-mers of ``k`` code points.

    A text shorter than ``k`` counts as one k-mer; with fewer k-mers than
    ``width`` the tuples hold what there is; an empty text has the empty
    fingerprint, which is like itself only.
    """

    k: int = K
    width: int = WIDTH
    hashes: int = HASHES

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        s = _mix(np.arange(1, self.hashes + 1, dtype=np.uint64) * np.uint64(ODD))
        return s[:, None], (_mix(s) | np.uint64(1))[:, None]

    def kmers(self, codes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the k-mers, built by doubling."""
        base, k = ODD, min(self.k, len(codes))
        power = _mix(codes.astype(np.uint64) * np.uint64(ODD) + np.uint64(1))
        have, out, used = 1, None, 0
        while True:
            if k & have:
                if out is None:
                    out, used = power, have
                else:
                    n = len(codes) - used - have + 1
                    out = out[:n] * np.uint64(pow(base, have, 1 << 64)) + power[used:used + n]
                    used += have
            if used == k:
                return _mix(out)
            power = power[:len(power) - have] * np.uint64(pow(base, have, 1 << 64)) + power[have:]
            have *= 2

    @staticmethod
    def occurrences(kmers: np.ndarray) -> np.ndarray:
        """How often each k-mer has come before, from one sort of (k-mer, position) packed in 64 bits."""
        bits = np.uint64(max(1, int(len(kmers)).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        packed = np.sort((kmers & ~low) | np.arange(len(kmers), dtype=np.uint64))
        at, same = (packed & low).astype(np.int64), packed >> bits
        new = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        out = np.empty(len(kmers), np.uint64)
        out[at] = np.arange(len(kmers)) - np.repeat(new, np.diff(np.append(new, len(kmers))))
        return out

    def of(self, text: str | None) -> np.ndarray:
        """The fingerprint: one 32-bit hash for each hash function."""
        if not text:
            return np.zeros(0, np.uint32)
        kmers = self.kmers(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        x = _mix(kmers + self.occurrences(kmers) * np.uint64(0xD6E8FEB86659FD93))
        xor, times = self.seeds()
        rows, values, places = np.arange(self.hashes), [], []
        for at in range(0, len(x), BLOCK):
            h = (x[None, at:at + BLOCK] ^ xor) * times
            for _ in range(min(self.width, h.shape[1])):
                i = h.argmin(axis=1)
                values.append(h[rows, i])
                places.append(i + at)
                h[rows, i] = MAX
        value, place = np.array(values).T, np.array(places).T
        least = np.argsort(value, axis=1, kind="stable")[:, :self.width]
        place = np.sort(np.take_along_axis(place, least, axis=1), axis=1)
        out = np.full(self.hashes, len(place[0]), np.uint64)
        for column in place.T:
            out = _mix(out * np.uint64(ODD) + kmers[column])
        return (out >> np.uint64(32)).astype(np.uint32)


def hexed(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuples; two empty fingerprints are alike, an empty and another are not."""
    return float((a == b).mean()) if len(a) and len(a) == len(b) else float(len(a) == len(b))


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, method: OrderMinHash = OrderMinHash()) -> DataFrame:
    """Append ``fingerprint`` (hex) of whole texts.

    Null and empty texts have the empty string; equal texts have equal
    fingerprints; rows are independent; an empty table gives an empty result.
    """
    def make():
        return lambda texts: [pa.array([hexed(method.of(t)) for t in texts], pa.string())]

    return map_text(docs, make, [("fingerprint", T.StringType())], text_col, keep)


def with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (part, again, id, text) laid out so that each row's successor in ascending id follows it in its partition.

    Ids are dealt out by ranges; the first row of a range is sent to the end of
    the range before it as well (``again``), and the first of all to the last
    range.  Null ids come last, equal ids by text.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias(TEXT))
    bounds = id_ranges(src, "id", shuffle_partitions(docs.sparkSession))
    part = range_of(F.col("id"), bounds)
    ids = src.select("id", part.alias("part"))
    heads = sorted((r.part, r.head) for r in ids.groupBy("part").agg(F.min("id").alias("head")).collect())
    to = docs.sparkSession.createDataFrame([(heads[i][0], heads[i][1], heads[i - 1][0]) for i in range(len(heads))], "part int, head long, to int")
    both = src.withColumn("part", part).join(F.broadcast(to), "part", "left")  # a row for each range
    at = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("again")))
    first = F.array(F.struct(F.col("to").alias("part"), F.lit(True).alias("again")))
    dealt = both.select("id", TEXT, F.explode(F.when(F.col("id").eqNullSafe(F.col("head")), F.concat(at, first)).otherwise(at)).alias("p"))
    return dealt.select("p.part", "p.again", "id", TEXT).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(
        "part", "again", F.col("id").asc_nulls_last(), F.col(TEXT).asc_nulls_first())


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text (or all it has)."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def compare_edited(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", method: OrderMinHash = OrderMinHash()) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next text.

    A null text counts as empty.  One row out for each row in; a single row is
    its own successor; an empty table gives an empty result.
    """
    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows_of(batches) -> Iterator[tuple[bool, int, str, np.ndarray]]:
        for b in batches:
            for part_, again, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                yield part_, again, doc, text or ""

    def run(batches):
        out, held, end = [], None, None
        names = [x.split(" ")[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

        def flush():
            columns = list(zip(*out)) if out else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for part, again, doc, text in rows_of(x for b in batches for x in text_slices([b], TEXT)):
            if again and end == part:
                continue  # rows that share the first id come more than once
            own = method.of(text)
            if held is not None:
                before_doc, before, before_own = held
                edited = edit(before, text)
                other = before_own if edited == before else method.of(edited)
                out.append((before_doc, len(before), hashlib.sha256(edited.encode()).hexdigest(), hexed(before_own), hexed(other),
                            likeness(before_own, other), likeness(before_own, own)))
            held, end = (None, part) if again else ((doc, text, own), None)
            if len(out) >= 1000:
                yield flush()
                out.clear()
        yield flush()

    return with_next(docs, text_col, id_col).mapInArrow(run, schema)
