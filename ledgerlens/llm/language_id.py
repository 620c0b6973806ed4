"""Language identification by word-first backoff.

A known word scores its log frequency in each language; an unseen word falls
back to the longest character n-grams of which the model knows at least one,
then to shorter ones.  The scores of all words add up, and the best language
wins.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, map_text, text_slices

ORDERS = (5, 4, 3, 2, 1)
PARTIAL = 100_000
LETTERS = regex.compile(r"\p{L}+")
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Languages in code-point order; log frequencies of words (at index 0) and of n-grams (at index n).

    A gram holds (language, log frequency) for the languages that have it, so the
    model grows with what each language keeps; ``unseen`` has those of a gram
    that a language has not.
    """

    langs: list[str]
    grams: list[dict[str, tuple[tuple[int, float], ...]]]
    unseen: list[list[float]]

    def by_language(self, n: int, found: tuple[tuple[int, float], ...]) -> list[float]:
        scores = self.unseen[n].copy()
        for i, s in found:
            scores[i] = s
        return scores

    def word_score(self, word: str) -> tuple[float, ...] | None:
        """Log frequencies of one word by language; None if the model knows neither the word nor any n-gram of it."""
        known = self.grams[0].get(word)
        if known is not None:
            return tuple(self.by_language(0, known))
        marked = f"^{word}$"
        for n in ORDERS:
            table = self.grams[n]
            found = [s for i in range(len(marked) - n + 1) if (s := table.get(marked[i:i + n])) is not None]
            if found:
                return tuple(sum(x) / len(found) for x in zip(*[self.by_language(n, f) for f in found]))
        return None


def grams_of(word: str) -> list[tuple[int, str]]:
    marked = f"^{word}$"
    return [(n, marked[i:i + n]) for n in ORDERS for i in range(len(marked) - n + 1) if marked[i:i + n] not in ("^", "$")]


def _counts(sample: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, n, gram, c): words have n = 0.  Counted in each task first, then summed."""
    def run(batches):
        words: Counter = Counter()

        def flush():
            rows: Counter = Counter()
            for (lang, w), c in words.items():
                rows[lang, 0, w] += c
                for n, g in grams_of(w):
                    rows[lang, n, g] += c
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int32()),
                                               pa.array([k[2] for k in rows], pa.string()), pa.array(list(rows.values()), pa.int64())],
                                              names=["lang", "n", "gram", "c"])

        for b in (s for x in batches for s in text_slices([x], text_col)):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.update((lang, w) for w in LETTERS.findall(text.lower()))
            if len(words) > PARTIAL:
                yield flush()
        yield flush()

    partial = sample.select(F.col(lang_col), F.col(text_col)).mapInArrow(run, "lang string, n int, gram string, c long")
    return partial.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        docs_per_lang: int = 3000, max_words: int = 20_000, max_grams: int = 8_000) -> LanguageModel:
    """Learn from a bounded sample of the rows with text and language.

    The sample takes about ``docs_per_lang`` documents of each language (all, if
    fewer), chosen by a hash of the id.  The model knows every language and keeps,
    per language, the most frequent ``max_words`` words and ``max_grams`` n-grams
    of each order (ties in code-point order), so what reaches the driver and the
    tasks grows with the number of languages alone.  Without labelled rows the
    model has no language.
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"),
                           F.xxhash64(F.col(f"`{id_col}`"), F.lit(11)).alias("h")).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = sorted(r.lang for r in sizes.select("lang").collect())
    if not langs:
        return LanguageModel([], [{} for _ in range(max(ORDERS) + 1)], [[] for _ in range(max(ORDERS) + 1)])
    part = F.pmod("h", F.lit(1_000_003)) / 1_000_003.0
    chosen = rows.join(F.broadcast(sizes), "lang").where(part < docs_per_lang / F.col("n"))
    counts = _counts(chosen, "text", "lang")
    totals = Window.partitionBy("lang", "n")
    top = counts.withColumn("total", F.sum("c").over(totals)).withColumn(
        "rank", F.row_number().over(totals.orderBy(F.desc("c"), "gram"))).where(
        F.col("rank") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams))
    at = {x: i for i, x in enumerate(langs)}
    seen: list[dict[str, list[tuple[int, int]]]] = [{} for _ in range(max(ORDERS) + 1)]
    total = [[1] * len(langs) for _ in seen]
    for r in top.toLocalIterator():
        seen[r.n].setdefault(r.gram, []).append((at[r.lang], r.c))
        total[r.n][at[r.lang]] = r.total
    grams, unseen = [], []
    for n, table in enumerate(seen):
        size = len(table) + 1
        log = lambda i, c: math.log((c + 0.5) / (total[n][i] + 0.5 * size))
        grams.append({g: tuple((i, log(i, c)) for i, c in cs) for g, cs in table.items()})
        unseen.append([log(i, 0) for i in range(len(langs))])
    return LanguageModel(langs, grams, unseen)


def scorer(model: LanguageModel):
    """A function from texts to (language, score, words with evidence, words) of each."""
    k = len(model.langs)
    memo = Recent(min(100_000, 3_200_000 // max(k, 1)))  # as much memory for many languages
    nothing = np.zeros(k + 2).tobytes()
    plain = struct.Struct(f"{k + 2}d")

    def learn(token: str) -> bytes:
        """Scores of a token's words, how many the model has evidence for, and how many there are, as packed doubles."""
        words = [token] if token.isascii() and token.isalpha() else LETTERS.findall(token)
        if not words:
            return nothing
        found = [s for s in map(model.word_score, words) if s is not None]
        return plain.pack(*(map(sum, zip(*found)) if found else [0.0] * k), len(found), len(words))

    def score(text: str | None) -> tuple[str, float, int, int]:
        tokens = text.lower().split() if text else []
        if not tokens or not k:
            return UNKNOWN, 0.0, 0, 0
        seen = Counter(tokens)  # in order of first occurrence, so sums do not depend on the batch
        rows = b"".join(map(memo.fill(seen, lambda new: map(learn, new)), seen))
        total = np.fromiter(seen.values(), float, len(seen)) @ np.frombuffer(rows).reshape(-1, k + 2)
        words, known = int(total[k + 1]), int(total[k])
        if not words:
            return UNKNOWN, 0.0, 0, 0
        mean = total[:k] / words
        best = int(np.argmax(mean))
        return model.langs[best], float(1 / np.exp(mean - mean[best]).sum()), known, words

    return score


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred``, ``score`` (the winner's share of the mean word likelihoods) and ``known_share``.

    Only the text is used.  Null and empty texts and texts without a letter get
    ``und``, score 0 and known share 0, as does every text if the model has no
    language.  Equal scores go to the first language in code-point order; a text
    of which the model knows no n-gram scores the same for all.  Rows are
    independent: repeated rows agree, and an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(sent.value)

        def work(texts):
            rows = [score(t) for t in texts]
            return [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] / r[3] if r[3] else 0.0 for r in rows], pa.float64())]
        return work

    return map_text(docs, make, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("known_share", T.DoubleType())], text_col, keep)


def held_out(id_col: Column) -> Column:
    """The held-out quarter of the documents."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2
