import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from tidemark.llm.common import saved

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for _, stage in C.STAGES:
        docs = stage(spark, docs, DIR).cache()
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{DIR}/documents.parquet").columns
    assert all(x.columns == columns for x in stages[:-1])
    counts = [x.count() for x in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_clean_documents_stay(spark, stages):
    good = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    left = {r.doc_id for r in stages[1].collect()}
    assert len(good & left) >= 0.95 * len(good)


def test_last_stage_packs_each_kept_document_once(stages):
    kept = Counter(r.doc_id for r in stages[2].collect())
    assert Counter(r.doc_id for r in stages[3].collect() if r.start == 0) == kept and max(kept.values()) == 1


def test_run_equals_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(C.run(spark, DIR)) == key(stages[3])


def test_repeated_rows_and_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    twice = docs.unionByName(docs)
    once = C.near_duplicates(spark, twice, DIR)
    assert once.count() == C.near_duplicates(spark, docs, DIR).count() == once.select("doc_id").distinct().count()
    assert C.near_duplicates(spark, docs.limit(0), DIR).count() == 0 and C.language_id(spark, docs.limit(0), DIR).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(k.startswith(f"op{i}_") for k in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_saved_steps_leave_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        got = files.getAllFiles()
        names = (got.apply(i).getName() for i in range(got.size()))
        return {n for n in names if n.startswith("shuffle_")}

    rows = spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    before = shuffles()
    out = saved(rows.join(spark.range(100).repartition(5, "id").withColumnRenamed("id", "k"), "k"))
    end = time.time() + 20  # files go beside the job
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert out.count() == 100 and out.agg(F.sum("n")).first()[0] == 20_000
