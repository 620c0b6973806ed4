"""Language-model scores by Katz backoff over word pairs.

Texts are cut into segments of bounded size, each with a vocabulary of its own.
Segments send what they hold, packed, to buckets, which add up the training
counts, keep them and answer every segment in the order it asked:

1. words: counts of the training tokens (``words`` table, one row a word);
2. pairs: counts of the training pairs (``pairs`` table, one packed row a
   bucket).  A frequent context is spread over the buckets by the word that
   follows, so no bucket gathers all that follows it;
3. contexts: per context the number of its pairs by count, and the unigram
   mass of the words seen after it, which give its backoff weight
   (``contexts`` table).  Those of the frequent contexts, a bounded number, are
   added up over the buckets and given to all tasks.

Counts up to five are discounted after Good and Turing, so that with r* for
a discounted count

    P(w | v) = r*(v, w) / c(v)                      if the pair was learned
             = bow(v) P(w)                          otherwise
    P(w)     = r*(w) / N, what is left over going to the unknown word

and bow(v) = (1 - sum of P(w | v)) / (1 - sum of P(w)), both over the words
seen after v, so that every context's probabilities add up to one.  Where no
count of a context is discounted its denominator grows by one, which leaves
something for unseen words.  Discounted counts are whole multiples of 2^-16, so
all sums are exact and do not depend on how the rows are laid out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import SLICE_BYTES, _give_back, shared_path, shuffle_partitions, text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
END, START = "\tend", "\tstart"  # no word holds white space
SEGMENT_BYTES = 12 << 20
HOT, MAX_HOT = 1 << 16, 100_000  # a context is spread over the buckets if met more often than HOT, and N / MAX_HOT
BUCKET_PAIRS = 4_000_000
SCALE = 1 << 16
R = 5  # counts up to this are discounted


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


class Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def pack(a: np.ndarray) -> bytes:
    """Whole numbers, byte by byte and compressed."""
    raw = np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(b: bytes) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(b[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


def pack_bytes(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack_bytes(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def discounted(n: list[int]) -> list[int]:
    """Good-Turing counts of 1..5 in units of 2^-16; ``n[r]`` things were counted r times, r = 1..6.

    A count whose discount the numbers do not give, or put outside (0, 1), loses a
    constant n1 / (n1 + 2 n2) instead, 0.75 at most.
    """
    constant = min(0.75, n[1] / (n[1] + 2 * n[2])) if n[1] and n[2] else 0.5
    out = [0]
    for r in range(1, R + 1):
        d = 0.0
        if all(n[1:]):
            common = (R + 1) * n[R + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if common < 1 else 0.0
        if not 0 < d < 1:
            d = 1 - constant / r
        out.append(min(r * SCALE - 1, max(1, round(d * r * SCALE))))
    return out


def starred(counts: np.ndarray, table: list[int]) -> np.ndarray:
    """r* of every count, in units of 2^-16."""
    few = np.array(table, np.int64)
    return np.where(counts <= R, few[np.minimum(counts, R)], counts * SCALE)


@dataclass(frozen=True)
class Unigrams:
    """Totals of the training tokens: their number, distinct ones, r* by count, and the denominator (units of 2^-16)."""

    tokens: int
    distinct: int
    table: list[int]
    whole: int
    kept: int

    @classmethod
    def of(cls, n: list[int], tokens: int, distinct: int) -> Unigrams:
        table = discounted(n)
        kept = tokens * SCALE + sum(n[r] * (table[r] - r * SCALE) for r in range(1, R + 1))
        return cls(tokens, distinct, table, tokens * SCALE if kept < tokens * SCALE else (tokens + 1) * SCALE, kept)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, starred(counts, self.table), self.whole - self.kept) / self.whole


def segments(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """Rows of about ``SEGMENT_BYTES`` of text: documents' ids, training marks and lengths, token numbers, and the words they number.

    Every text has an end; ``bound`` holds the numbers of the end and the start.  Words are numbered in the order of their hash.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("seg", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *[T.StructField(n, T.BinaryType()) for n in
                           ("train", "lens", "tokens", "bound", "words")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def fresh():
            v = Vocabulary()
            _ = v[END], v[START]
            return v, [], [], [], [], 0

        def row():
            words = list(vocabulary)
            hashes = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
            order = np.argsort(hashes, kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            whole = pa.concat_arrays(ids)
            packed = [np.concatenate(marks), np.array(lens), number[np.concatenate(tokens)], number[:2]]
            text = "\n".join([words[i] for i in order.tolist()]).encode()
            cells = [pa.array([(part << 32) + made], pa.int64()), pa.ListArray.from_arrays([0, len(whole)], whole),
                     *[pa.array([x], pa.binary()) for x in [*map(pack, packed), pack_bytes(text)]]]
            return pa.RecordBatch.from_arrays(cells, names=schema.fieldNames())

        vocabulary, ids, marks, lens, tokens, size = fresh()
        for b in (s for x in batches for s in text_slices([x], "t", 1 << 20)):
            number = vocabulary.__getitem__
            for text in b.column(2).to_pylist():
                found = words_of(text)
                tokens.append(np.fromiter(map(number, found), np.int64, len(found)))
                tokens.append(np.zeros(1, np.int64))
                lens.append(len(found) + 1)
                size += len(text or "") + 16
            ids.append(b.column(0))
            marks.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            tokens = [np.concatenate(tokens)]
            if size >= SEGMENT_BYTES:
                yield row()
                made += 1
                vocabulary, ids, marks, lens, tokens, size = fresh()
        if ids:
            yield row()
        _give_back()

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, schema)


class Segment:
    """One segment's tokens, and the token before each."""

    def __init__(self, train: bytes, lens: bytes, tokens: bytes, bound: bytes):
        self.marks, self.lens, self.tokens = unpack(train), unpack(lens), unpack(tokens)
        self.end, self.start = unpack(bound).tolist()
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[np.cumsum(self.lens) - self.lens] = self.start

    @classmethod
    def of(cls, t: pa.Table) -> Segment:
        return cls(*[t[c][0].as_py() for c in ("train", "lens", "tokens", "bound")])

    def learned(self) -> np.ndarray:
        return np.repeat(self.marks, self.lens)

    def word_counts(self, size: int) -> np.ndarray:
        """Training tokens by number; the start counts once a training document."""
        out = np.bincount(self.tokens[self.learned() > 0], minlength=size)
        out[self.start] = int(self.marks.sum())
        return out


class Pairs:
    """A segment's distinct pairs in the order of their words' ids, with ``gid`` and ``count`` of each word; unknown words have -1 and 0."""

    def __init__(self, s: Segment, gid: np.ndarray, count: np.ndarray):
        order = np.argsort(gid, kind="stable")
        rank = np.empty(len(gid), np.int64)
        rank[order] = np.arange(len(gid))
        self.gid, self.count = gid[order], count[order]
        code, self.which = np.unique(rank[s.before] * len(gid) + rank[s.tokens], return_inverse=True)
        self.v, self.w = code // max(1, len(gid)), code % max(1, len(gid))
        self.token_count = count[s.tokens]

    def asks(self, buckets: int, hot: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, places of its pairs in ascending order), for the pairs of known contexts."""
        known = np.flatnonzero(self.count[self.v] > 0)
        v, w = self.v[known], self.w[known]
        x = self.gid[v].astype(np.uint64)
        spread = np.where(self.count[v] > hot, self.gid[w] + 2, 0).astype(np.uint64)
        h = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (spread * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            yield k, known[order[cuts[k]:cuts[k + 1]]]


def heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)])


def add_words(texts: list[list[str]], counts: list[np.ndarray], bucket: int) -> tuple[list[str], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(learned words, their counts, (ids, counts) for each text's words)."""
    total: dict[str, int] = {}
    for words, c in zip(texts, counts):
        for w, n in zip(words, c.tolist()):
            total[w] = total.get(w, 0) + n
    learned = sorted(w for w, n in total.items() if n)
    at = {w: i for i, w in enumerate(learned)}
    n = np.array([total[w] for w in learned] + [0], np.int64)
    answers = []
    for words in texts:
        i = np.array([at.get(w, -1) for w in words], np.int64)
        answers.append((np.where(i < 0, -1, i + (bucket << 40)), n[i]))
    return learned, n[:-1], answers


def add_pairs(v: list[np.ndarray], w: list[np.ndarray], cw: list[np.ndarray], c: list[np.ndarray], hot: list[np.ndarray], unigrams: Unigrams):
    """((v, w, count) of the learned pairs, (v, n1..n6, unigram mass) per context, (counts, contexts' numbers) for each ask)."""
    sizes = np.cumsum([len(x) for x in v])[:-1]
    av, aw, acw, ac = (np.concatenate(x) for x in (v, w, cw, c))
    order = np.lexsort((aw, av))
    sv, sw = av[order], aw[order]
    head = heads(sv, sw)
    total = np.add.reduceat(ac[order], head)
    answer = np.empty(len(av), np.int64)
    answer[order] = np.repeat(total, np.diff(np.r_[head, len(av)]))
    learned = total > 0
    pv, pw, pc_ = sv[head][learned], sw[head][learned], total[learned]
    first = heads(pv)
    per = lambda x: np.add.reduceat(x, first) if len(first) else first
    numbers = [*[per((pc_ == r).astype(np.int64)) for r in range(1, R + 2)], per(starred(acw[order][head][learned], unigrams.table))]
    table = np.array(numbers, np.int64).reshape(R + 2, -1)
    answers = []
    for own_v, own_hot, counts in zip(v, hot, np.split(answer, sizes)):
        cold = own_v[heads(own_v)]
        cold = cold[~np.isin(cold, own_hot)]
        answers.append((counts, table[:, np.searchsorted(pv[first], cold)]))
    return (pv, pw, pc_), (pv[first], *numbers), answers


@dataclass(frozen=True)
class Model:
    """The learned tables, all in the shared folder, and their totals."""

    unigrams: Unigrams
    pair_table: list[int]  # r* of the pairs' counts
    words: DataFrame  # word, gid, c
    pairs: DataFrame  # bucket, v, w, c: packed, sorted by v and w
    contexts: DataFrame  # gid, n1..n6, mass


def backoff(count: np.ndarray, numbers: np.ndarray, pair_table: list[int], unigrams: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, backoff weight) of contexts from their count and (n1..n6, unigram mass)."""
    kept = count * SCALE + sum(numbers[r - 1] * (pair_table[r] - r * SCALE) for r in range(1, R + 1))
    whole = np.where(kept < count * SCALE, count, count + 1) * SCALE
    return whole, (whole - kept) / whole / ((unigrams.whole - numbers[R + 1]) / unigrams.whole)


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where ``train`` holds, and score all: see ``learn_and_score``."""
    return learn_and_score(docs, train, id_col, text_col)[0]


def learn_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """(id_col, trained, n_tokens, n_known, train_tokens, base_score, score) of every row, and the model.

    Tokens are the words (runs without ASCII white space, A-Z lower-cased) and one
    end.  ``n_known`` counts tokens met in training; ``base_score`` sums
    log10((c + 1) / (N + V + 1)); ``score`` is the model's log10 probability of
    the text.  A null text is an empty one, a null mark means not trained on;
    repeated rows are documents of their own.  Without training rows every token
    is unknown and scores 0.  An empty table gives no row.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "segments")
    segments(docs, train, id_col, text_col).write.parquet(path)
    segs = spark.read.parquet(path)
    buckets = max(shuffle_partitions(spark), segs.count())

    # words
    def ask_words(batches):
        for b in batches:
            for i in range(b.num_rows):
                seg, text, *packed = (b.column(j)[i].as_py() for j in range(b.num_columns))
                words = unpack_bytes(text).decode().split("\n")
                counts = Segment(*packed).word_counts(len(words))
                bucket = np.array([zlib.crc32(w.encode()) for w in words], np.int64) * buckets >> 32  # ascending
                cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
                held = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([seg] * len(held), pa.int64()),
                                                  pa.array([pack_bytes("\n".join(words[cuts[k]:cuts[k + 1]]).encode()) for k in held], pa.binary()),
                                                  pa.array([pack(counts[cuts[k]:cuts[k + 1]]) for k in held], pa.binary())], names=["bucket", "seg", "a", "b"])

    layout = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("seg", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("word", pa.string()), ("gid", pa.int64()), ("c", pa.int64())])

    def answer_words(key, t):
        bucket, n = key[0].as_py(), t.num_rows
        learned, counts, answers = add_words([unpack_bytes(x).decode().split("\n") for x in t["a"].to_pylist()], [unpack(x) for x in t["b"].to_pylist()], bucket)
        m = len(learned)
        back = [["answer"] * n, [bucket] * n, t["seg"].to_pylist(), [pack(g) for g, _ in answers], [pack(c) for _, c in answers], [None] * n, [None] * n, [None] * n]
        kept = [["word"] * m, [bucket] * m, [None] * m, [None] * m, [None] * m, learned, np.arange(m) + (bucket << 40), counts]
        return pa.concat_tables([pa.table([pa.array(x, f.type) for x, f in zip(cells, layout)], schema=layout) for cells in (back, kept)])

    schema = "kind string, bucket int, seg long, a binary, b binary, word string, gid long, c long"
    path = shared_path(spark, "words")
    segs.select("seg", "words", "train", "lens", "tokens", "bound").mapInArrow(ask_words, "bucket int, seg long, a binary, b binary").groupBy("bucket").applyInArrow(
        answer_words, schema).write.partitionBy("kind").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    known = table.where("kind = 'answer'").select("seg", F.lit("word").alias("kind"), "bucket", "a", "b")
    words = table.where("kind = 'word'").select("word", "gid", "c")
    tokens = words.where(F.col("word") != START)
    r = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, R + 2)]).first()
    unigrams = Unigrams.of([0, *r[2:]], r.n, r.v)
    buckets = max(shuffle_partitions(spark), -(-r.n // BUCKET_PAIRS))
    hot = max(HOT, r.n // MAX_HOT)  # so MAX_HOT contexts at most are above it

    def words_known(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = t.filter(pc.equal(t["kind"], "word")).sort_by("bucket")
        return tuple(np.concatenate([unpack(x) for x in own[c].to_pylist()]) for c in ("a", "b"))

    # pairs
    def ask_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            s = Segment.of(left)
            p = Pairs(s, *words_known(right))
            times = np.bincount(p.which, weights=s.learned(), minlength=len(p.v)).astype(np.int64)
            for bucket, at in p.asks(buckets, hot):
                v, w = p.v[at], p.w[at]
                gv = p.gid[v]
                rows.append((bucket, left["seg"][0].as_py(), pack(np.diff(gv, prepend=0)), pack(p.gid[w]), pack(p.count[w]), pack(times[at]), pack(np.unique(gv[p.count[v] > hot]))))
            del s, p, times
            _give_back()
        cells = list(zip(*rows)) if rows else [[]] * 7
        return pa.table([pa.array(x, t) for x, t in zip(cells, (pa.int32(), pa.int64(), *[pa.binary()] * 5))], names=["bucket", "seg", "v", "w", "cw", "c", "hot"])

    plain = segs.select("seg", "ids", "train", "lens", "tokens", "bound")
    asked = plain.drop("ids").groupBy("seg").cogroup(known.groupBy("seg")).applyInArrow(ask_pairs, "bucket int, seg long, v binary, w binary, cw binary, c binary, hot binary")
    names = [*[f"n{i}" for i in range(1, R + 2)], "mass"]
    pair_layout = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("seg", pa.int64()), *[(x, pa.binary()) for x in "abc"], ("gid", pa.int64()), *[(n, pa.int64()) for n in names]])

    def answer_pairs(key, t):
        v, w, cw, c, often = ([unpack(x) for x in t[n].to_pylist()] for n in ("v", "w", "cw", "c", "hot"))
        pairs, contexts, answers = add_pairs([np.cumsum(x) for x in v], w, cw, c, often, unigrams)
        bucket, n, m = key[0].as_py(), len(answers), len(contexts[0])
        back = [["answer"] * n, [bucket] * n, t["seg"].to_pylist(), [pack(x) for x, _ in answers], [pack(x.ravel()) for _, x in answers], [None] * n, *[[None] * n] * len(contexts)]
        kept = [["pairs"], [bucket], [None], *[[pack(x)] for x in pairs], *[[None]] * len(contexts)]
        sums = [["context"] * m, [bucket] * m, *[[None] * m] * 4, *contexts]
        del v, w, cw, c, often, answers
        _give_back()
        return pa.concat_tables([pa.table([pa.array(x, f.type) for x, f in zip(cells, pair_layout)], schema=pair_layout) for cells in (back, kept, sums)])

    schema = "kind string, bucket int, seg long, a binary, b binary, c binary, gid long, " + ", ".join(f"{n} long" for n in names)
    path = shared_path(spark, "pairs")
    asked.groupBy("bucket").applyInArrow(answer_pairs, schema).write.partitionBy("kind").parquet(path)
    table = spark.read.schema(schema).parquet(path)

    # contexts
    parts = table.where("kind = 'context'")
    contexts = parts.groupBy("gid").agg(*[F.sum(n).alias(n) for n in names])
    of = parts.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in names[:-1]]).first()
    pair_table = discounted([0, *of])
    often = words.where(F.col("c") > hot).select("gid").join(contexts, "gid").collect()  # MAX_HOT rows at most
    hot_numbers = {r.gid: tuple(r[1:]) for r in often}
    model = Model(unigrams, pair_table, words, table.where("kind = 'pairs'").select("bucket", F.col("a").alias("v"), F.col("b").alias("w"), "c"), contexts)

    id_type = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("trained", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    result = pa.schema([(id_col, to_arrow_type(id_type)), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.nulls(0, f.type) for f in result], schema=result)
        s = Segment.of(left)
        p = Pairs(s, *words_known(right))
        given = right.filter(pc.equal(right["kind"], "pair"))
        answer = {k: (a, b) for k, a, b in zip(given["bucket"].to_pylist(), given["a"].to_pylist(), given["b"].to_pylist())}
        times, numbers = np.zeros(len(p.v), np.int64), np.zeros((R + 2, len(p.gid)), np.int64)
        for bucket, at in p.asks(buckets, hot):
            a, b = answer[bucket]
            times[at] = unpack(a)
            v = p.v[at]
            v = v[heads(v)]
            numbers[:, v[p.count[v] <= hot]] = unpack(b).reshape(R + 2, -1)
        for i in np.flatnonzero(p.count > hot).tolist():
            numbers[:, i] = hot_numbers.get(int(p.gid[i]), 0)
        seen = p.count > 0
        whole, bow = np.ones(len(seen), np.int64), np.ones(len(seen))
        whole[seen], bow[seen] = backoff(p.count[seen], numbers[:, seen], pair_table, unigrams)
        prob = np.where(times > 0, starred(times, pair_table) / whole[p.v], bow[p.v] * unigrams.p(p.count[p.w]))
        n, c = len(s.lens), p.token_count
        doc = np.repeat(np.arange(n), s.lens)
        sums = lambda x: np.bincount(doc, weights=x, minlength=n)
        base = np.log10((c + 1) / (unigrams.tokens + 1 * (unigrams.distinct + 1)))
        found = pa.table([left["ids"].combine_chunks().flatten(), pa.array(s.marks > 0), pa.array(s.lens), pa.array(sums(c > 0).astype(np.int64)), pa.array(np.full(n, unigrams.tokens)),
                          pa.array(sums(base)), pa.array(sums(np.log10(prob)[p.which]))], schema=result)
        del s, p, times, numbers, prob, doc, c, base, answer
        _give_back()
        return found

    back = known.unionByName(table.where("kind = 'answer'").select("seg", F.lit("pair").alias("kind"), "bucket", "a", "b"))
    return plain.groupBy("seg").cogroup(back.groupBy("seg")).applyInArrow(judge, out), model
