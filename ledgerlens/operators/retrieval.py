"""Retrieval: exact cosine top-k for a batch of questions (J4/V1), the
over-fetch (V2), rule-based re-ranking (V3), the ask wrapper (V4), context
blocks (X13) and extractive answers (V5).

One plan answers every question.  Questions and corpus vectors are dealt into
blocks of bounded size, each pair of blocks is scored by one task, and the best
units are merged before any chunk text is read: only ids and vectors go to
Python, and only the chunks of units that can be hits are built."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantize
from ..functions.text import (audit_query, keyword_overlap, keyword_terms, query_terms, split_sentences,
                              strip_ws, useful_sentence)
from ..sources.sinks import parquet_roundtrip

DEFAULT_K = 5
AUDIT_MIN_K = 8

# Re-ranking rules, applied in this order.  Each rule is
# (query condition, hit conditions, boost): the query condition is a
# substring of the lower-cased question, "@audit" (an audit question) or
# None (always); hit conditions are (field, op, value) and must all hold.
RERANK_RULES = [
    (None, [("section", "not_in", ["General", "Introduction"])], 0.03),
    ("@overlap", [], 0.02),
    ("@audit", [("source_type", "eq", "audit_data")], 0.12),
    ("@audit", [("section", "eq", "Audit KPI Summary")], 0.10),
    ("creditor", [("sheet_lower", "eq", "creditors analysis")], 0.30),
    ("debtor", [("sheet_lower", "eq", "debtors analysis")], 0.30),
    ("creditor", [("section_lower", "eq", "audit kpi summary")], 0.20),
    ("creditor", [("doc_lower", "contains_any", ["creditors analysis", "top creditors"])], 0.25),
    ("debtor", [("doc_lower", "contains_any", ["debtors analysis"])], 0.25),
    ("creditor", [("doc_lower", "contains_any", ["credit sales"])], -0.15),
    ("margin", [("section_lower", "contains_any", ["margin"])], 0.15),
    ("sales", [("section", "in", ["Sales Analysis", "Audit KPI Summary"])], 0.10),
    ("may", [("period_lower", "startswith", "may")], 0.08),
    ("april", [("period_lower", "startswith", "april")], 0.08),
    ("objective", [("doc_lower", "contains_any", ["research objectives"])], 0.15),
    ("objective", [("section_lower", "startswith", "research objectives")], 0.20),
    ("tool", [("doc_lower", "contains_any", ["tool/technology"])], 0.10),
    (None, [("page", "eq", 0), ("source_type", "eq", "proposal")], 0.05),
]
OVERLAP_CAP = 0.12

# Extractive-answer texts and limits.
PRIORITY_SECTIONS = ["Audit KPI Summary", "Creditors Analysis", "Debtors Analysis"]
PRIORITY_SHEETS = ["Creditors Analysis", "Debtors Analysis", "KPI Summary"]
NO_HITS = "No relevant content found in the research proposal or audit data index."
INTRO = ("Based on retrieved sections of the research proposal and audit data, "
         "here is a synthesized answer (extractive mode — no external LLM used):")
MAX_SENTENCES = 6
DEDUP_PREFIX = 80
PRIORITY_CHARS = 2200
FALLBACK_CHARS = 900

HIT_COLS = ["chunk_id", "doc_id", "page", "section", "source_type", "file_name", "sheet_name",
            "report_period", "text"]


def vec_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))


def dot(a: Column, b: Column) -> Column:
    """V1 building block: sequential dot product of two DOUBLE arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def as_vectors(df: DataFrame, col: str = "embedding", out: str = "vec") -> DataFrame:
    """FLOAT[] -> DOUBLE[] plus its norm (cosine needs both)."""
    v = F.transform(F.col(col), lambda x: x.cast("double"))
    return df.withColumn(out, v).withColumn(f"{out}_norm", vec_norm(F.col(out)))


def question_frame(questions: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Question-side columns: lower text, audit flag (P8), terms (X10),
    effective k (V4) and the over-fetch size before the corpus cap (V2)."""
    audit = audit_query(F.col("question"))
    eff_k = F.when(audit, F.greatest(F.lit(k), F.lit(AUDIT_MIN_K))).otherwise(F.lit(k))
    return (questions.withColumn("q_lower", F.lower("question")).withColumn("audit", audit)
            .withColumn("terms", query_terms(F.col("question")))
            .withColumn("kw", keyword_terms(F.col("question")))
            .withColumn("k", F.lit(k)).withColumn("eff_k", eff_k)
            .withColumn("fetch_k", F.when(audit, F.greatest(F.col("eff_k") * 8, F.lit(24)))
                        .otherwise(F.greatest(F.col("eff_k") * 3, F.col("eff_k")))))


def _max_fetch(k: int) -> int:
    ek = max(k, AUDIT_MIN_K)
    return max(ek * 8, 24, k * 3)


@dataclass(frozen=True)
class Corpus:
    """What is searched: ``vectors`` (unit, vec, vec_norm), one row per unit,
    and ``chunks``, which gives the chunk rows (unit and HIT_COLS) of the units
    in its argument, or of all units if that is None.  All chunks of a unit
    share its vector.  ``firsts`` are the vectors with the first chunk of each
    unit that has one, where that is known without a look at all chunks."""

    vectors: DataFrame
    chunks: Callable[[DataFrame | None], DataFrame]
    firsts: DataFrame | None = None

    def with_first_chunk(self) -> DataFrame:
        return with_first_chunk(self.vectors, self.chunks(None)) if self.firsts is None else self.firsts


def with_first_chunk(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks.groupBy("unit").agg(F.min("chunk_id").alias("first_chunk")), "unit")


def corpus_of(chunks: DataFrame) -> Corpus:
    """A corpus from chunk rows that carry their own vector: every chunk is a unit."""
    rows = chunks.withColumn("unit", F.col("chunk_id"))

    def of(units: DataFrame | None) -> DataFrame:
        hits = rows.select("unit", *HIT_COLS)
        return hits if units is None else hits.join(units, "unit", "left_semi")

    return Corpus(rows.select("unit", "vec", "vec_norm"), of)


def _blocks(df: DataFrame, size: int) -> int:
    return max(1, math.ceil(df.count() / size))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


QUESTION_COLS = ["question_id", "question", "q_lower", "audit", "terms", "kw", "k", "eff_k", "fetch_k"]
BLOCK_SCHEMA = "question_id bigint, unit string, first_chunk string, similarity double"
# Questions and units of one block pair; their score matrix has 64 MB.  A block
# sends on its best units for each question, so larger ones shuffle less.
QUESTION_BLOCK, UNIT_BLOCK = 512, 16_384
# So many blocks of questions go to a task, one after the other, so that vectors move once for all of them.
BLOCKS_TOGETHER = 16
# Matrix products differ from sums in index order by far less than this.
MARGIN = 1e-9


def best_of_block(questions, units, limit: int):
    """The best units of a block for every question of a block: at most ``limit``
    (question_id, unit, first_chunk, similarity) rows a question, by similarity,
    then first chunk.  A matrix product finds all units that can be among them;
    these are scored anew in index order, as the built-in path does."""
    import numpy as np
    import pandas as pd

    q, c = np.stack(questions["vec"].to_numpy()), np.stack(units["vec"].to_numpy())
    qn, cn = questions["vec_norm"].to_numpy(), units["vec_norm"].to_numpy()
    rough = (q @ c.T) / np.outer(qn, cn)
    place = max(0, rough.shape[1] - limit)
    cut = np.partition(rough, place, axis=1)[:, place]
    r, u = np.nonzero(rough >= cut[:, None] - MARGIN)
    total = np.zeros(len(r))
    for d in range(q.shape[1]):
        total += q[r, d] * c[u, d]
    out = pd.DataFrame({"question_id": questions["question_id"].to_numpy()[r], "unit": units["unit"].to_numpy()[u],
                        "first_chunk": units["first_chunk"].to_numpy()[u], "similarity": total / (qn[r] * cn[u])})
    out = out.sort_values(["question_id", "similarity", "first_chunk"], ascending=[True, False, True])
    return out.groupby("question_id", sort=False).head(limit)


def best_units(vectors: DataFrame, qf: DataFrame, limit: int, question_block: int = QUESTION_BLOCK,
               unit_block: int = UNIT_BLOCK, counted: DataFrame | None = None) -> DataFrame:
    """(question_id, unit, similarity): the ``limit`` best units of each
    question.  Questions and units are dealt into blocks by hash; a block of units
    is scored against ``BLOCKS_TOGETHER`` blocks of questions by one task, so nothing
    is collected or broadcast and a task holds no more at any size.  The best of
    the block pairs are merged in two levels.  The number of blocks comes from ``counted`` (rows about as
    many as the units, and cheaper to count) or from the units."""
    q = qf.select("question_id", "vec", "vec_norm")
    nq, nu = _blocks(q, question_block * BLOCKS_TOGETHER), _blocks(vectors if counted is None else counted, unit_block)
    qb = q.withColumn("qb", F.pmod(F.xxhash64("question_id"), F.lit(nq))).withColumn("ub", F.explode(_numbers(nu)))
    ub = vectors.withColumn("ub", F.pmod(F.xxhash64("unit"), F.lit(nu))).withColumn("qb", F.explode(_numbers(nq)))

    def score(questions, units):
        import pandas as pd
        if len(questions) == 0 or len(units) == 0:
            import numpy as np
            text = np.zeros(0, object)
            return pd.DataFrame({"question_id": np.zeros(0, np.int64), "unit": text, "first_chunk": text, "similarity": np.zeros(0)})
        return pd.concat([best_of_block(questions.iloc[at:at + question_block], units, limit) for at in range(0, len(questions), question_block)])

    found = qb.groupBy("qb", "ub").cogroup(ub.groupBy("qb", "ub")).applyInPandas(score, BLOCK_SCHEMA)
    found = found.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(64)))
    order = [F.col("similarity").desc(), F.col("first_chunk")]
    for group in (["question_id", "part"], ["question_id"]):
        found = found.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("n") <= limit)
    return found.select("question_id", "unit", "similarity")


def _candidates_builtin(corpus: Corpus, qf: DataFrame, k: int) -> DataFrame:
    """V1 + V2 with built-in functions only, every chunk against every question; for tests."""
    scored = corpus.chunks(None).join(corpus.vectors, "unit").crossJoin(
        qf.withColumnRenamed("vec", "q_vec").withColumnRenamed("vec_norm", "q_norm"))
    scored = scored.withColumn("similarity", dot(F.col("q_vec"), F.col("vec")) / (F.col("q_norm") * F.col("vec_norm")))
    return _top_fetch(scored.drop("vec", "vec_norm", "q_vec", "q_norm"), k)


def _top_fetch(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.col("similarity").desc(), F.col("chunk_id"))
    ranked = scored.withColumn("fetch_rank", F.row_number().over(w)).where(F.col("fetch_rank") <= _max_fetch(k))
    # The reference also caps fetch_k at the corpus size; ranks never exceed
    # it, so the cap needs no extra pass.
    return ranked.where(F.col("fetch_rank") <= F.col("fetch_k"))


def candidates(corpus: Corpus, qf: DataFrame, k: int = DEFAULT_K, method: str = "blocks",
               question_block: int = QUESTION_BLOCK, unit_block: int = UNIT_BLOCK) -> DataFrame:
    """V1 + V2: the first ``fetch_k`` chunks per question by similarity (ties by
    chunk id).

    Vectors are scored, not chunks.  A chunk among a question's first n has a
    unit among its first n units in the order (similarity, first chunk), so only
    the chunks of those units are built with their text, at most n of each unit.
    These units are stored, so that the search runs once and their number is
    known where chunks are looked up.  Vectors of norm zero are not searched."""
    if method == "builtin":
        return _candidates_builtin(corpus, qf, k)
    most = _max_fetch(k)
    found = best_units(corpus.with_first_chunk().where(F.col("vec_norm") > 0), qf.where(F.col("vec_norm") > 0), most,
                       question_block, unit_block, corpus.vectors.where(F.col("vec_norm") > 0))
    best = parquet_roundtrip(found, "best_units")
    w = Window.partitionBy("unit").orderBy("chunk_id")
    chunks = corpus.chunks(best.select("unit").distinct())
    chunks = chunks.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")
    scored = best.join(chunks, "unit").join(qf.select(*QUESTION_COLS), "question_id")
    return _top_fetch(scored, k)


def _hit_field(name: str) -> Column:
    return {
        "section": F.col("section"), "source_type": F.col("source_type"), "page": F.col("page"),
        "sheet_lower": F.lower(F.coalesce(F.col("sheet_name"), F.lit(""))),
        "section_lower": F.lower(F.col("section")),
        "doc_lower": F.lower(F.col("text")),
        "period_lower": F.lower(F.coalesce(F.col("report_period"), F.lit(""))),
    }[name]


def _hit_cond(field: str, op: str, value) -> Column:
    f = _hit_field(field)
    if op == "eq":
        return f == F.lit(value)
    if op == "in":
        return f.isin(*value)
    if op == "not_in":
        return ~f.isin(*value)
    if op == "startswith":
        return f.startswith(value)
    if op == "contains_any":
        return reduce(lambda a, b: a | b, [f.contains(v) for v in value])
    raise ValueError(op)


def boost_columns(rules=RERANK_RULES) -> list[Column]:
    """V3: one DOUBLE column per rule, in rule order."""
    out = []
    for qcond, hconds, boost in rules:
        if qcond == "@overlap":
            ov = keyword_overlap(F.col("terms"), F.col("text"))
            out.append(F.least(ov.cast("double") * F.lit(boost), F.lit(OVERLAP_CAP)))
            continue
        cond = reduce(lambda a, b: a & b, [_hit_cond(*h) for h in hconds]) if hconds else F.lit(True)
        if qcond == "@audit":
            cond = F.col("audit") & cond
        elif qcond is not None:
            cond = F.col("q_lower").contains(qcond) & cond
        out.append(F.when(cond, F.lit(boost)).otherwise(F.lit(0.0)))
    return out


def rerank(cands: DataFrame, rules=RERANK_RULES) -> DataFrame:
    """V3: similarity plus the rule boosts (added in rule order), rounded
    to 4 decimals; the first ``eff_k`` per question by score (ties: higher
    similarity, then chunk id)."""
    score = F.col("similarity")
    for b in boost_columns(rules):
        score = score + b
    s = cands.withColumn("score", quantize(score, 4))
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("similarity").desc(),
                                                  F.col("chunk_id"))
    limit = max(DEFAULT_K, AUDIT_MIN_K)
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.greatest(F.lit(limit), F.col("eff_k")))
             .where(F.col("rank") <= F.col("eff_k")))


def search(corpus: Corpus, questions: DataFrame, k: int = DEFAULT_K, rules=RERANK_RULES,
           question_block: int = QUESTION_BLOCK, unit_block: int = UNIT_BLOCK) -> DataFrame:
    """Hits per question: ``eff_k`` re-ranked chunks (V1-V4)."""
    return rerank(candidates(corpus, question_frame(questions, k), k, question_block=question_block, unit_block=unit_block), rules)


def source_label(prefix: str = "") -> Column:
    """X13: 'Audit Data | period | file | sheet-or-section' for audit chunks,
    else 'Proposal p.<page> | <section>'."""
    def c(n):
        return F.col(f"{prefix}{n}")
    period = F.coalesce(F.nullif(c("report_period"), F.lit("")), F.lit("Unknown period"))
    sheet = F.coalesce(F.nullif(c("sheet_name"), F.lit("")), F.nullif(c("section"), F.lit("")))
    audit = F.concat_ws(" | ", F.lit("Audit Data"), period, F.nullif(c("file_name"), F.lit("")), sheet)
    prop = F.concat(F.lit("Proposal p."), c("page").cast("string"), F.lit(" | "),
                    F.coalesce(c("section"), F.lit("General")))
    return F.when(c("source_type") == "audit_data", audit).otherwise(prop)


def context_blocks(hits: DataFrame) -> DataFrame:
    """X13: '[Source i | label | Relevance: score]\\ntext' blocks joined by a
    blank line, over the first k hits of each question."""
    h = hits.where(F.col("rank") <= F.col("k")).withColumn("label", source_label())
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(" | "), F.col("label"),
                     F.lit(" | Relevance: "), F.col("score").cast("string"), F.lit("]\n"), F.col("text"))
    g = h.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return g.select("question_id", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("context"))


def _cut(text: Column, n: int) -> Column:
    return F.concat(F.substr(text, F.lit(1), F.lit(n)), F.when(F.length(text) > n, F.lit("...")).otherwise(F.lit("")))


def extractive_answer(questions: DataFrame, hits: DataFrame, max_sentences: int = MAX_SENTENCES, dedup_prefix: int = DEDUP_PREFIX,
                      priority_chars: int = PRIORITY_CHARS, fallback_chars: int = FALLBACK_CHARS) -> DataFrame:
    """V5 per question: (a) no hits -> fixed text; (b) the first priority hit,
    when it is audit data -> its text; (c) else the best ``max_sentences`` useful sentences
    (score = keyword overlap + hit score; ties by hit rank then sentence
    order), de-duplicated on their first ``dedup_prefix`` chars, each with its
    source label; (d) none -> the top hit's text.  Texts of (b) and (d) are cut
    after ``priority_chars`` and ``fallback_chars``, marked by '...'.

    One shuffle: the hits are exploded into sentences (keeping hits without
    any) and every step is a window over ``question_id``; the few
    chosen lines are de-duplicated as a bounded array in the final aggregate."""
    h = hits.withColumn("label", source_label())
    e = h.select("question_id", "rank", "kw", "score", "label", "section", "page", "text", "source_type",
                 "sheet_name", F.posexplode_outer(split_sentences(F.col("text"))).alias("spos", "raw"))
    is_pri = F.col("section").isin(*PRIORITY_SECTIONS) | F.col("sheet_name").isin(*PRIORITY_SHEETS)
    wq = Window.partitionBy("question_id")
    e = (e.withColumn("pri", F.min_by(F.struct("source_type", "label", "text"), F.when(is_pri, F.col("rank"))).over(wq))
          .withColumn("top", F.min_by(F.struct("section", "page", "text"), F.col("rank")).over(wq))
          .withColumn("sentence", strip_ws(F.col("raw"))))
    useful = F.col("raw").isNotNull() & useful_sentence(F.col("sentence"))
    e = e.withColumn("sscore", F.when(useful, keyword_overlap(F.col("kw"), F.col("sentence")).cast("double")
                                      + F.col("score")))
    w = Window.partitionBy("question_id").orderBy(F.col("sscore").desc_nulls_last(), F.col("rank"), F.col("spos"))
    e = e.withColumn("srank", F.row_number().over(w))
    chosen = F.col("sscore").isNotNull() & (F.col("srank") <= max_sentences)
    line = F.concat(F.lit("- "), F.col("sentence"), F.lit(" ("), F.col("label"), F.lit(")"))
    g = e.groupBy("question_id").agg(
        F.first("pri", ignorenulls=True).alias("pri"), F.first("top", ignorenulls=True).alias("top"),
        F.array_sort(F.collect_list(F.when(chosen, F.struct(
            "srank", F.substr(F.col("sentence"), F.lit(1), F.lit(dedup_prefix)).alias("key"), line.alias("l")))))
        .alias("cand"))
    # keep the first line of every 80-char prefix, in rank order
    kept = F.aggregate("cand", F.array().cast("array<struct<srank:int,key:string,l:string>>"),
                       lambda acc, x: F.when(F.exists(acc, lambda y: y["key"] == x["key"]), acc)
                       .otherwise(F.concat(acc, F.array(x))))
    g = g.withColumn("ls", F.when(F.size("cand") > 0, kept))
    j = questions.select("question_id").join(g, "question_id", "left")
    pri_audit = F.col("pri").isNotNull() & (F.col("pri.source_type") == "audit_data")
    answer = (F.when(F.col("top").isNull(), F.lit(NO_HITS))
              .when(pri_audit, F.concat(F.lit("Based on audit data ("), F.col("pri.label"), F.lit("):\n\n"),
                                        _cut(F.col("pri.text"), priority_chars)))
              .when(F.col("ls").isNotNull(),
                    F.concat(F.lit(INTRO + "\n\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n\n")))
              .otherwise(F.concat(F.lit("Based on the most relevant section ("), F.col("top.section"),
                                  F.lit(", p. "), F.col("top.page").cast("string"), F.lit("):\n\n"),
                                  _cut(F.col("top.text"), fallback_chars))))
    return j.select("question_id", answer.alias("answer"), F.lit("extractive").alias("backend"))


def answer_sources(hits: DataFrame) -> DataFrame:
    """V5 sources per question: its first k hits in rank order as an array of
    (rank, chunk_id, label, score)."""
    h = hits.where(F.col("rank") <= F.col("k")).withColumn("label", source_label())
    return h.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "label", "score"))).alias("sources"))
