"""The registered queries: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import table

from . import (katz_lm, language_id, lexical_search, orchard_kmeans, order_minhash, secret_scan, sentencepiece_codec, simhash_dedup, source_mix,
               token_counts, token_file, topk_search, url_filter)

# The listed rules of the URL query.
LISTED_RULES = [url_filter.ListedRule("allow", "com", "/"), url_filter.ListedRule("block", "example.com", "/en/"),
                url_filter.ListedRule("allow", "www.example.com", "/en/"), url_filter.ListedRule("block", "net", "/es/"),
                url_filter.ListedRule("block", "net", "/fr/")]
END_ID = 2


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edited(_documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_documents(spark, sf_dir), keep=["doc_id"])

    def run(batches):
        for b in batches:
            spans = [[(x["kind"], x["start"], x["end"]) for x in s] for s in b.column(1).to_pylist()]
            counts = [pa.array([sum(x[0] == k for x in s) for s in spans], pa.int64()) for k in secret_scan.BASE_KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([secret_scan.base_digest(s) for s in spans]),
                                              pa.array([secret_scan.joined(s) for s in spans])],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~F.coalesce(held, F.lit(False))))
    return language_id.predict(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), labels, LISTED_RULES, keep=["page_id"]).select(
        "page_id", "host", "path", "rule", "verdict")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_documents(spark, sf_dir), keep=["doc_id"])
    return found.select("doc_id", simhash_dedup.hex16(F.col("simhash")).alias("fingerprint"), "component_id")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_index(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights from the labels: 2 for good documents, 0.5 for others and for toxic ones."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return table(spark, sf_dir, "labels").where("quality is not null").select(
        F.col("doc_id").alias("id"), F.when(good, 2.0).otherwise(0.5).alias("quality"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_documents(spark, sf_dir), label_quality(spark, sf_dir), keep=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken")


def op11_orchard_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard_kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    return katz_lm.score_texts(_documents(spark, sf_dir), ~held).select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_order_minhash, op2_secret_scan, op3_language_id, op4_url_filter, op5_sentencepiece, op6_token_counts,
    op7_simhash, op8_topk_search, op9_token_file, op10_source_mix, op11_orchard_kmeans, op12_lexical_search, op13_katz_lm)}

ORACLE: dict[str, str] = {
    "op11_orchard_kmeans": orchard_kmeans.plain_sql(),
    "op12_lexical_search": lexical_search.PLAIN_SQL,
    "op8_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
                   FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_source_mix": r"""
        WITH q AS (SELECT doc_id, max(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 2.0 ELSE 0.5 END) AS quality
                   FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
             d AS (SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                          -ln((('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
                          / coalesce(q.quality, 1.0)::DOUBLE AS key
                   FROM documents d LEFT JOIN q USING (doc_id)),
             s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
             w AS (SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight FROM s),
             o AS (SELECT *, 2.0 * source_size / weight AS ratio FROM w),
             l AS (SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                          / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
             lv AS (SELECT min_by(level, (ratio, place)) AS level FROM l WHERE level <= ratio),
             t AS (SELECT o.source, o.source_size, least(2.0 * source_size, coalesce((SELECT level FROM lv) * weight, 2.0 * source_size))::DOUBLE AS target FROM o),
             p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target / nullif(t.source_size, 0)) AS epochs,
                          coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (coalesce(epochs, 0) + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM p""",
}
