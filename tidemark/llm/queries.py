"""The operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe_codec, fingerprints, jaccard, langid, negatives, packing, quality, secret_scan, sharding, token_counts, token_files
from .common import small_batches

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    languages, matrix = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, languages, matrix).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip_digests(documents(spark, sf_dir), WORD_BPE)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(documents(spark, sf_dir), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("cell").alias("curve_index")
    )


def op4_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.sensitivity(documents(spark, sf_dir))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), BYTE_BPE, limit=512)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir), WORD_BPE, end_id=1)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), BYTE_BPE, end_id=0, width=1024)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), words=5, percent=75)


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, quality.fit(docs, ratings), min_tail=0.8)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE).withColumnRenamed("groups", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secret_scan.find_secrets(docs, secret_scan.fit(docs))
    rules = [k for k in secret_scan.KINDS if k != secret_scan.NAMED]
    base = F.filter("found", lambda x: x["kind"].isin(rules))
    n = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in rules]
    return found.select("doc_id", *n, F.sha2(secret_scan.spelled(base), 256).alias("base_sha256"), secret_scan.spelled(F.col("found")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_language_id, op2_bpe_round_trip, op3_hilbert_shards, op4_canonical_digest, op5_hnsw, op6_token_counts, op7_token_files, op8_packing, op9_jaccard_join,
        op10_ordinal_quality, op11_alignment, op12_hard_negatives, op13_secret_scan,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
