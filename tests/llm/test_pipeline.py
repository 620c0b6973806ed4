"""The pipeline's stages on planted rows, and the whole of it against a plain version."""

import re

import pytest

import corpus_pipeline
from ledgerlens.llm import secret_scan
from tests.llm.test_operators import plain_components, plain_simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The table after each stage, the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame([(900001, None, "en", "src0", 0), (900002, "", "en", None, 0), (900003, "123 456 ...", None, "src1", 11),
                                     (900004, "Жш щюя", None, "src1", 6), (None, "the ninthing of the hand", "en", "src1", 24)], docs.schema)
    docs, out = docs.unionByName(planted).unionByName(docs.limit(3)), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return out


def test_language_stage_keeps_what_has_a_language(stages):
    before, after = stages[0], stages[1]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {900001, 900002, 900003, 900004} <= gone
    assert all(not re.search(r"[a-zA-Zà-ÿ]{3}", r.text or "") for r in before if r.doc_id in gone)


def test_one_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    fp = {r.text: plain_simhash(r.text) for r in before}
    roots = plain_components(set(fp.values()))
    least = {}
    for r in before:
        if r.doc_id is not None:
            least[roots[fp[r.text]]] = min(r.doc_id, least.get(roots[fp[r.text]], r.doc_id))
    want = set(least.values()) | ({None} if any(r.doc_id is None and roots[fp[r.text]] not in least for r in before) else set())
    assert sorted(str(r.doc_id) for r in after) == sorted(map(str, want))


def test_secrets_are_gone(stages):
    before = {r.doc_id: r for r in stages[2]}
    assert len(before) == len(stages[3])
    for r in stages[3]:
        spans = secret_scan.spans_of(before[r.doc_id].text)
        assert r.text == secret_scan.redact(before[r.doc_id].text, spans) and r.n_chars == len(r.text)


def test_mix_and_encoding(stages):
    before, mixed, last = stages[3], stages[4], stages[5]
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    assert abs(words(mixed) / words(before) - 1.5) < 0.05
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in before}
    assert len(last) == len(mixed) and all(r.round_trip and r.n_tokens == len(r.piece_ids) > 0 for r in last)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run_reads_its_own_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
