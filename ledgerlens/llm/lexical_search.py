"""Ranked lexical search over a length-stratified index.

A document's length enters its score through a whole-number normaliser m, so
documents of one m form a stratum in which a term's contribution depends on its
frequency tf alone.  The index holds, per document, its stratum's length and the
frequencies of the terms asked for; a task groups its share of the documents
into strata and keeps each stratum's postings by tf.  Per stratum

* the impact (1e9 tf) div (1000 tf + 20 m) is computed once per tf,
* the sum of the weighted impacts of each term's highest tf bounds the score
  of every document in it, and

strata are visited in the order of their bounds, for the items whose k-th best
score so far the bound reaches.  Thresholds start at the k-th best of a bounded
number of documents, searched first; these only save work, as every document of
a stratum that could enter a result is scored.

Items come in blocks of bounded size; every block meets all documents.  The
shares are Spark's partitions, so a stratum with a large part of all rows is
split like any other, and each share sends on its k best per item.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _give_back, shared_path, text_slices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MAX_ITEMS, MAX_PAIRS = 256, 50_000  # an item block; one item with more terms is a block of its own
SEED_DOCS = 4096
SHARE_POSTINGS = 4_000_000
CELLS, COLUMNS = 4_000_000, 4096  # of the dense matrix of a stratum


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.translate(LOWER)) if text else []


def impact(tf: int, m: int) -> int:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Block:
    """Items of one block: their ids, the terms of all of them, and which item has which term."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = [i for i, _ in items]
        self.at = {t: j for j, t in enumerate(sorted({t for _, ts in items for t in ts}))}
        self.has = np.zeros((len(self.at), len(items)), bool)
        for q, (_, ts) in enumerate(items):
            self.has[[self.at[t] for t in ts], q] = True


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """Blocks of at most ``MAX_ITEMS`` items and ``MAX_PAIRS`` (item, term) pairs, one block at a time on the driver."""

    def run(batches):
        for b in batches:
            ts = [sorted(set(terms_of(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ts, pa.list_(pa.string()))], names=["item", "terms"])

    cut = items.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, "item long, terms array<string>")
    merged = cut.where(F.size("terms") > 0).groupBy("item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    found, pairs = [], 0
    for r in merged.toLocalIterator():
        if found and (len(found) >= MAX_ITEMS or pairs + len(r.terms) > MAX_PAIRS):
            yield Block(found)
            found, pairs = [], 0
        found.append((r.item, r.terms))
        pairs += len(r.terms)
    if found:
        yield Block(found)


def index_documents(docs: DataFrame, block: Block, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tfs): length and the frequencies of the block's terms of every document with a term."""
    at = block.at

    def run(batches):
        for b in (s for x in batches for s in text_slices([x], "t")):
            ids, ns, terms, tfs = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = terms_of(text)
                if not found:
                    continue
                counts = Counter(found)
                own = counts.keys() & at.keys() if len(counts) < 4 * len(at) else [t for t in at if t in counts]
                ids.append(i)
                ns.append(len(found))
                terms.append([at[t] for t in own])
                tfs.append([counts[t] for t in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int64()))], names=["id", "n", "terms", "tfs"])
        _give_back()

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return src.mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>")


def document_frequencies(index: DataFrame, block: Block) -> np.ndarray:
    """Documents per term; as many rows come back as the block has terms."""
    size = len(block.at)

    def run(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in index.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Stratum:
    """Documents of one normaliser: postings (document, term, tf) and the distinct tfs with their impacts."""

    def __init__(self, m: int, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.ids, self.doc, self.term = ids, doc, term
        tfs, which = np.unique(tf, return_inverse=True)  # postings by tf: one impact for each
        self.impact = np.array([impact(int(t), m) for t in tfs.tolist()], np.int64)[which]

    def bounds(self, weight: np.ndarray, has: np.ndarray) -> np.ndarray:
        top = np.zeros(len(weight), np.int64)
        np.maximum.at(top, self.term, self.impact)
        held = np.flatnonzero(top)
        out = np.zeros(has.shape[1], np.int64)
        for lo in range(0, len(held), COLUMNS):
            part = held[lo:lo + COLUMNS]
            out += ((top[part] * weight[part]).astype(np.float64) @ has[part]).astype(np.int64)  # whole numbers below 2^53
        return out

    def scores(self, weight: np.ndarray, has: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, documents x items) exact scores, some documents at a time."""
        wanted = has[:, items]
        use = wanted.any(axis=1)[self.term]
        doc, term, value = self.doc[use], self.term[use], (self.impact * weight[self.term])[use]
        cols, col = np.unique(term, return_inverse=True)
        step = max(1, CELLS // max(1, min(len(cols), COLUMNS)))
        for first in range(0, len(self.ids), step):
            n = min(step, len(self.ids) - first)
            own = (doc >= first) & (doc < first + n) if n < len(self.ids) else slice(None)
            d, c, v = doc[own] - first, col[own], value[own]
            out = np.zeros((n, len(items)), np.int64)
            for lo in range(0, len(cols), COLUMNS):
                part = cols[lo:lo + COLUMNS]
                cells = np.zeros((n, len(part)))
                here = (c >= lo) & (c < lo + len(part))
                cells[d[here], c[here] - lo] = v[here]
                out += (cells @ wanted[part].astype(np.float64)).astype(np.int64)
            yield first, out


def strata(b: pa.RecordBatch, normaliser) -> list[Stratum]:
    """The documents of a share by normaliser; their columns are (id, n, terms, tfs)."""
    ids = b.column(0)
    n = b.column(1).to_numpy()
    lengths, which = np.unique(n, return_inverse=True)
    m = np.array([normaliser(x) for x in lengths.tolist()], object)[which]
    levels, level = np.unique(m, return_inverse=True)
    count = np.array(b.column(2).value_lengths().to_numpy(), np.int64)
    doc = np.repeat(np.arange(len(n)), count)
    term, tf = b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy()
    by_level = np.argsort(level, kind="stable")
    place = np.empty(len(n), np.int64)
    first = np.searchsorted(level[by_level], np.arange(len(levels)))
    place[by_level] = np.arange(len(n)) - first[level[by_level]]
    of = level[doc]
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(levels) + 1))
    sizes = [*first.tolist(), len(n)]
    numbers = np.array(ids.to_pylist(), object)
    return [Stratum(int(levels[s]), numbers[by_level[sizes[s]:sizes[s + 1]]], place[doc[at]], term[at], tf[at])
            for s in range(len(levels)) for at in [order[cuts[s]:cuts[s + 1]]]]


class Search:
    """The k best (score, document) of each item over the strata seen so far; ``scored`` and ``met`` count (document, item) pairs."""

    def __init__(self, block: Block, weight: np.ndarray, k: int, least: np.ndarray):
        self.has, self.weight, self.k = block.has, weight, k
        self.least = np.maximum(least, 1).astype(np.int64)  # scores below it are of no use
        self.best: list[list[tuple[int, tuple[bool, int]]]] = [[] for _ in block.items]
        self.met = self.scored = 0

    def add(self, found: list[Stratum]) -> None:
        bounds = np.array([s.bounds(self.weight, self.has) for s in found]).reshape(len(found), -1)
        for at in np.argsort(-bounds.max(axis=1, initial=0), kind="stable").tolist():
            s = found[at]
            items = np.flatnonzero(bounds[at] >= self.least)
            self.met += len(s.ids) * len(self.best)
            if not items.size:
                continue
            self.scored += len(s.ids) * len(items)
            for first, score in s.scores(self.weight, self.has, items):
                good = score >= self.least[items]
                for j in np.flatnonzero(good.any(axis=0)).tolist():
                    self.put(int(items[j]), score[:, j], np.flatnonzero(good[:, j]), s.ids[first:first + len(score)])

    def put(self, q: int, score: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        if len(rows) > 4 * self.k:  # those below the k-th score of these alone cannot stay
            kth = np.partition(score[rows], len(rows) - self.k)[len(rows) - self.k]
            rows = rows[score[rows] >= kth]
        new = [(-s, (i is None, i or 0)) for s, i in zip(score[rows].tolist(), ids[rows].tolist())]
        best = sorted(self.best[q] + new)[:self.k]
        self.best[q] = best
        if len(best) == self.k:
            self.least[q] = max(self.least[q], -best[-1][0])

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for q, best in enumerate(self.best):
            for s, (null, i) in best:
                yield q, None if null else i, -s


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join Arrow batches up to a bounded number of postings: larger strata have fewer, shared impacts."""
    held, size = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            lengths = np.cumsum(b.column(2).slice(at).value_lengths().to_numpy())
            n = max(1, int(np.searchsorted(lengths, SHARE_POSTINGS - size, "right")))
            n = min(n, b.num_rows - at)
            held.append(b.slice(at, n))
            size += int(lengths[n - 1])
            at += n
            if size >= SHARE_POSTINGS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield table.to_batches()[0]


def search_index(index: DataFrame, block: Block, weight: np.ndarray, stats: tuple[int, int], k: int, least: np.ndarray) -> DataFrame:
    """(q, id, score): the k best of each share for the items of the block, at least ``least`` in score."""
    docs, total = stats
    normaliser = lambda n: 100 - 50 + (50 * n * docs) // total

    def run(batches):
        search = Search(block, weight, k, least)
        for share in _shares(batches):
            search.add(strata(share, normaliser))
        out = list(search.rows())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["q", "id", "score"])
        _give_back()

    return index.mapInArrow(run, "q long, id long, score long")


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("q", *by).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", seed_docs: int = SEED_DOCS) -> DataFrame:
    """The ``k`` highest-scoring documents for every item: (item_col, rank, id_col, score).

    Terms are maximal runs of digits, ASCII letters and other characters beyond
    ASCII in the whole text, A-Z lower-cased.  An item's distinct terms count
    once; rows of one item id (null too) form one item.  Documents score the sum
    of w * impact(tf, m); those with a score above 0 rank, equal scores by
    ascending id, null ids last.  A document row counts as a document of its
    own, so a repeated row ranks twice.  Null and empty texts have no terms;
    without documents or items with terms there is no row.
    """
    spark = docs.sparkSession
    parts = []
    for block in item_blocks(items, item_col, item_text_col):
        path = shared_path(spark, "lexical-index")
        index_documents(docs, block, id_col, text_col).write.parquet(path)
        index = spark.read.parquet(path)
        r = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n").cast("decimal(38,0)")).alias("l")).first()
        if not r.n:
            break
        df = document_frequencies(index, block)
        weight = np.array([math.floor(1000 * math.log((2 * r.n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        stats = (r.n, int(r.l))
        least = np.zeros(len(block.items), np.int64)
        if r.n > seed_docs:
            seed = search_index(index.limit(seed_docs), block, weight, stats, k, least)
            for s in _best(seed, k).where(F.col("rank") == k).collect():  # one row an item
                least[s.q] = s.score
        found = search_index(index, block, weight, stats, k, least)
        bucket = F.pmod(F.xxhash64("id", "score"), F.lit(64))
        best = _best(_best(found.withColumn("bucket", bucket), k, "bucket"), k)
        names = spark.createDataFrame(list(enumerate(block.items)), "q long, item long")
        parts.append(best.join(F.broadcast(names), "q").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
    if not parts:
        return spark.createDataFrame([], f"`{item_col}` long, rank int, `{id_col}` long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PLAIN_SQL = r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
             d AS (SELECT r, doc_id, len(ts)::BIGINT AS n, ts FROM t WHERE len(ts) > 0),
             g AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM d),
             p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
             w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term),
             i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
             s AS (SELECT i.item_id, p.r, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * d.n * g.nd) // g.nl))))::BIGINT AS score
                   FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), g GROUP BY i.item_id, p.r),
             o AS (SELECT item_id, d.doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
                   FROM s JOIN d USING (r) WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 50"""
