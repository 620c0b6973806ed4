"""Retrieval paths agree: blocks of any size equal one block, and the blocked
scorer equals the built-in one, which scores every chunk."""

from pyspark.sql import functions as F

from ledgerlens.functions.numbering import dense_numbers
from ledgerlens.operators import retrieval as rt
from ledgerlens.plans.registry import audit_index, audit_questions, question_batch, vector_corpus, whole_corpus
from ledgerlens.sources.tables import Tables

SF = "/root/testdata/sf0.001"
HITS = ["question_id", "rank", "chunk_id", "similarity", "score"]
CANDIDATES = ["question_id", "fetch_rank", "chunk_id", "similarity"]


def _rows(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_blocks_of_any_size_agree(spark):
    t = Tables(spark, SF)
    one = rt.search(vector_corpus(t), question_batch(t))
    split = rt.search(vector_corpus(t), question_batch(t), question_block=7, unit_block=60)
    assert _rows(one, HITS) == _rows(split, HITS)


def test_blocks_equal_builtin(spark):
    t = Tables(spark, SF)
    qf = rt.question_frame(question_batch(t))
    a = rt.candidates(vector_corpus(t), qf)
    b = rt.candidates(vector_corpus(t), qf, method="builtin")
    assert _rows(a, CANDIDATES) == _rows(b, CANDIDATES)


def _chunks(spark, n, same=False):
    rows = [(f"c{i:03d}", i, 1, "General", "proposal", "f", "", "", f"text {i}", [1.0, 0.0 if same else float(i % 7)]) for i in range(n)]
    schema = ("chunk_id string, doc_id long, page int, section string, source_type string, file_name string, sheet_name string, "
              "report_period string, text string, vec array<double>")
    return spark.createDataFrame(rows, schema).withColumn("vec_norm", rt.vec_norm(F.col("vec")))


def _questions(spark, n):
    q = spark.createDataFrame([(i, "stock of cash" if i % 2 else "plain words", [1.0, float(i)]) for i in range(n)],
                              "question_id long, question string, vec array<double>")
    return q.withColumn("vec_norm", rt.vec_norm(F.col("vec")))


def test_ties_go_to_the_smaller_chunk_id(spark):
    got = rt.search(rt.corpus_of(_chunks(spark, 200, same=True)), _questions(spark, 2), unit_block=16)
    by = {}
    for r in got.orderBy("question_id", "rank").collect():
        by.setdefault(r["question_id"], []).append(r["chunk_id"])
    assert by == {0: [f"c{i:03d}" for i in range(5)], 1: [f"c{i:03d}" for i in range(8)]}


def test_vectors_move_once_for_many_blocks_of_questions(spark, monkeypatch):
    units = rt.corpus_of(_chunks(spark, 50)).with_first_chunk()
    asked, numbers = [], rt._numbers
    monkeypatch.setattr(rt, "_numbers", lambda n: asked.append(n) or numbers(n))
    together = rt.best_units(units, _questions(spark, 20), 5, question_block=2, unit_block=16)
    assert asked == [4, 1]  # four blocks of units, and their vectors are not copied for each of ten blocks of questions
    monkeypatch.setattr(rt, "BLOCKS_TOGETHER", 1)
    apart = rt.best_units(units, _questions(spark, 20), 5, question_block=2, unit_block=16)
    assert asked[2:] == [4, 10] and sorted(map(tuple, together.collect())) == sorted(map(tuple, apart.collect()))


def test_no_questions_or_no_corpus_gives_no_hits(spark):
    chunks, questions = _chunks(spark, 3), _questions(spark, 3)
    assert rt.search(rt.corpus_of(chunks.limit(0)), questions).count() == 0
    assert rt.search(rt.corpus_of(chunks), questions.limit(0)).count() == 0
    assert rt.search(rt.corpus_of(chunks), questions).groupBy("question_id").count().count() == 3


def test_whole_corpus_equals_builtin(spark):
    t = Tables(spark, SF)
    audit = audit_index(t)
    corpus = whole_corpus(t, audit)
    # every question about creditors, and every benchmark item
    questions = question_batch(t).unionByName(audit_questions(audit).where("question like '%Creditors%'"))
    qf = rt.question_frame(questions)
    kinds = {r[0] for r in corpus.chunks(None).select(F.split("chunk_id", "_")[0]).distinct().collect()}
    assert kinds == {"chunk", "summary", "audit"}
    assert qf.where("audit").count() > 0
    a, b = rt.candidates(corpus, qf), rt.candidates(corpus, qf, method="builtin")
    assert _rows(a, CANDIDATES) == _rows(b, CANDIDATES)


def test_every_answer_branch_and_its_sources(spark):
    sentence = "The owner of the shop keeps a short record of the stock in a drawer."
    kinds = [("Creditors Analysis", "audit_data", "Audit text."), ("General", "proposal", sentence), ("General", "proposal", "Too short.")]
    rows = [(f"c{k}{i}", i, 1, sec, src, "f.xlsx", "", "April 1995", text, [float(k == d) for d in range(3)])
            for k, (sec, src, text) in enumerate(kinds) for i in range(9)]
    schema = ("chunk_id string, doc_id long, page int, section string, source_type string, file_name string, sheet_name string, "
              "report_period string, text string, vec array<double>")
    chunks = spark.createDataFrame(rows, schema).withColumn("vec_norm", rt.vec_norm(F.col("vec")))
    q = spark.createDataFrame([(k, "plain words", [float(k == d) for d in range(3)]) for k in range(4)],
                              "question_id long, question string, vec array<double>")
    q = q.withColumn("vec_norm", rt.vec_norm(F.col("vec")))
    hits = rt.search(rt.corpus_of(chunks), q)
    said = {r["question_id"]: r["answer"] for r in rt.extractive_answer(q, hits).collect()}
    assert said[0].startswith("Based on audit data (Audit Data | April 1995 | f.xlsx | Creditors Analysis):") and "Audit text." in said[0]
    assert said[1].startswith(rt.INTRO) and said[1].count(sentence) == 1
    assert said[2].startswith("Based on the most relevant section (General, p. 1):") and said[2].endswith("Too short.")
    assert said[3] == rt.NO_HITS
    sources = {r["question_id"]: [s["chunk_id"] for s in r["sources"]] for r in rt.answer_sources(hits).collect()}
    assert sources == {k: [f"c{k}{i}" for i in range(5)] for k in range(3)}


def test_dense_numbers_have_no_gaps(spark):
    ids = [5, 1, 1, 70, 71, 1000, -3, None]
    rows = spark.createDataFrame([(i, "n") for i in ids], "id long, n string").repartition(3)
    got = sorted((r.place, r.id) for r in dense_numbers(rows, "id", "place", width=10).collect())
    assert got == list(enumerate(sorted(i for i in ids if i is not None)))
    assert dense_numbers(rows.limit(0), "id", "place").count() == 0


class GappedTables(Tables):
    """The given tables with gaps, nulls and empty vectors among the embeddings."""

    @property
    def embeddings(self):
        e = Tables(self.spark, self.sf_dir).embeddings
        gone = F.when(F.col("vec_id") % 4 == 0, F.lit(None)).when(F.col("vec_id") % 4 == 1, F.array().cast("array<float>")).otherwise(F.col("embedding"))
        return e.where("vec_id % 7 <> 0").withColumn("embedding", gone).withColumn("vec_id", F.when(F.col("vec_id") % 11 != 0, F.col("vec_id") * 3))


def test_gaps_and_nulls_lose_no_audit_chunk(spark):
    whole = {r.chunk_id for r in audit_index(Tables(spark, SF)).select("chunk_id").collect()}
    gapped = audit_index(GappedTables(spark, SF))
    assert {r.chunk_id for r in gapped.select("chunk_id").collect()} == whole and gapped.where("vec_norm > 0").count() == len(whole)


def test_units_are_scored_once_and_hits_read_the_stored_best(spark):
    corpus, questions = rt.corpus_of(_chunks(spark, 90)), _questions(spark, 4)
    plan = rt.search(corpus, questions)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" not in plan


def test_known_first_chunks_give_the_same_hits(spark):
    chunks, questions = _chunks(spark, 90), _questions(spark, 4)
    corpus = rt.corpus_of(chunks)
    firsts = chunks.select(F.col("chunk_id").alias("unit"), "vec", "vec_norm", F.col("chunk_id").alias("first_chunk"))
    known = rt.Corpus(corpus.vectors, corpus.chunks, firsts)
    assert _rows(rt.search(known, questions, unit_block=16), HITS) == _rows(rt.search(corpus, questions), HITS)
    assert _rows(corpus.with_first_chunk(), ["unit", "first_chunk"]) == _rows(firsts, ["unit", "first_chunk"])
