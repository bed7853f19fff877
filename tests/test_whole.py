"""That queries do the whole job: production settings, unbounded draws, all views."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import columns as C
from tidemark.operators import diary as D
from tidemark.operators import summaries as S
from tidemark.plans import tables as T

DIR = "/root/testdata/sf0.01"


def test_studies_of_every_size_and_definition(spark):
    out = entry.queries()["study_mc"](spark, DIR)
    cohorts = {r.cohort: r.n for r in T.pool(spark, DIR).groupBy("cohort").agg(F.countDistinct("participant_id").alias("n")).collect()}
    got = {(r.cohort, r.n_participants, r.definition): r for r in out.groupBy("cohort", "n_participants", "definition").agg(F.count("*").alias("n"), F.max("n_classifiable").alias("most"), F.max("positives").alias("positives")).collect()}
    assert set(got) == {(c, n, d) for c, total in cohorts.items() for n in (30, 50, 100) if n <= total for d in S.DEFINITIONS}
    for (_, n, d), r in got.items():
        assert r.n == 10_000 and r.positives <= r.most <= n
        assert d != "A_windowed_any" or r.most > 0
        assert not d.startswith("D_") or r.most == 0  # not evaluated on three months


def test_bootstrap_of_1000(spark):
    few, many = (entry.queries()[k](spark, DIR) for k in ("bootstrap", "bootstrap_1000"))
    assert many.count() == 1000 and few.exceptAll(many).count() == 0


@pytest.mark.parametrize("mean", [0.5, 60, 3000])
def test_injected_events_have_no_cap(spark, mean):
    days = spark.range(1, 401).select(F.lit(1).alias("participant_id"), F.col("id").cast("int").alias("calendar_day_index"), F.lit("M").alias("phase"), F.lit(int(2 * mean)).cast("long").alias("seizure_count"))
    u = (C.stable_hash(1, "participant_id", "calendar_day_index") + 0.5) / F.lit(2.0**32)
    got = D.inject_enrichment(days).select((F.col("seizure_count") - int(2 * mean)).alias("n"), u.alias("u")).collect()
    for r in got:  # the n at which the distribution function reaches u
        c, k = math.exp(-mean), 0
        while c < r.u:
            k += 1
            c += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        assert r.n == k
    assert abs(sum(r.n for r in got) / 400 - mean) < 5 * math.sqrt(mean / 400)
