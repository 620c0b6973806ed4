"""A training-data pipeline over ``documents``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next stage's documents.  All but the last return
the columns of ``documents``; extra columns of the input pass through.

1. Language identification: documents without a letter, and those of which the
   model knows no word or n-gram, go.
2. SimHash near-duplicates: of each group the document with the least id stays.
3. Secret scan: secrets are replaced by a mark, and ``n_chars`` follows.
4. Source mix: documents come as often as the mix takes them.
5. SentencePiece: ids of every text, and whether they decode to it.

Null and empty texts go in stage 1.  Rows without an id are kept apart by their
text; empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import language_id, secret_scan, sentencepiece_codec, simhash_dedup, source_mix
from ledgerlens.llm.common import shared_path
from ledgerlens.llm.queries import label_quality
from ledgerlens.sources.tables import table

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~F.coalesce(held, F.lit(False))))
    found = language_id.predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, keep=["row"])
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("known_share") > 0)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row's key is its id and text: never null, so one shuffle serves the join and the removal of repeated rows
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text")))
    keyed = docs.withColumn("__key", key)
    found = simhash_dedup.near_duplicates(keyed, keep=["doc_id", "__key"])
    # one row stays for each component; groups without any id have a null component and are told apart by fingerprint
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("simhash"))]
    first = found.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__key")).alias("s"))
    return keyed.join(first.select("s.__key"), "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(docs.select(F.struct(*docs.columns).alias("row"), "text"), keep=["row"], redacted_col="clean")
    out = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return found.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = source_mix.mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text"), label_quality(spark, sf_dir), keep=["row"])
    return found.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sentencepiece_codec.encode_pieces(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids",
                        (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("secret_scan", redact_secrets),
          ("source_mix", mix_sources), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{name}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
