"""From raw documents to packed training sequences: four stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, packing, quality
from tidemark.llm.common import saved, small_batches
from tidemark.llm.queries import BYTE_BPE

#: Removed ids of at most so many rows (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose language is not recognised: null or without letters, or of low score. Without any
    labelled row all texts with a letter stay. Repeated rows are judged alike; an empty table gives no rows."""
    small_batches(spark)
    return langid.accepted(docs, min_score=0.5)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that are probably not of the top grade (low quality or toxic), and texts without words; without
    any rating all stay. Repeated rows are judged alike; an empty table gives no rows."""
    small_batches(spark)
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.selected(docs, quality.fit(docs, ratings), min_tail=0.8)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document of smallest doc_id.

    Of rows that repeat one doc_id and text a single one stays. Rows of one doc_id with different texts
    go only if each of these texts is a near duplicate of a smaller doc_id, so that no text is left without a
    representative. Rows without doc_id stay; an empty table gives no rows.
    """
    small_batches(spark)
    groups = jaccard.near_duplicates(docs).groupBy("doc_id").agg(F.max("component_id").alias("last"), F.count("*").alias("rows"))
    groups = saved(groups.where("doc_id is not null and (last < doc_id or rows > 1)"))
    gone = groups.where("last < doc_id").select("doc_id")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = groups.where("last = doc_id").select("doc_id")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1,024; a null or empty text has its end token alone."""
    small_batches(spark)
    return packing.pack_documents(docs, BYTE_BPE, end_id=0, width=1024)


STAGES = [("language_id", language_id), ("quality", quality_filter), ("near_duplicates", near_duplicates), ("packing", pack)]

#: SQL can express neither the tokenizer nor the classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    saved(spark.range(1))  # makes sure that a shared folder is set
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
