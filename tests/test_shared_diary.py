"""The shared diary: whole participants in buckets, so that nothing of a day is shuffled again, and runs of cycles without reading days twice."""

import gzip
import json
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import definitions as X
from tidemark.operators import diary as D
from tidemark.operators import glm as G
from tidemark.operators import resample as R
from tidemark.operators import windows as W
from tidemark.plans import diary as P
from tidemark.plans import queries as Q
from tidemark.plans import tables as T
from tidemark.sources import io

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_and_joins_by_participant_do_not_shuffle_days(spark):
    daily = T.daily(spark, DIR)
    assert "Exchange" not in plan(daily.groupBy("participant_id", "cycle_id").agg(F.sum("seizure_count")))
    assert plan(W.subset_window(daily, T.windows(spark, DIR))).count("Exchange") == 1  # the windows


def test_flags_of_the_inadequate_luteal_phase_are_those_of_the_days(spark):
    days = P.base_diary(spark, DIR)
    own = days.groupBy("participant_id", "cycle_id").agg(F.max("mid_luteal_progesterone").alias("mid_luteal_progesterone"), F.max("ilp_flag").alias("ilp_flag"))
    want = D.ilp_cycles(days)
    assert own.exceptAll(want.select(own.columns)).count() == 0 == want.select(own.columns).exceptAll(own).count()


def test_runs_of_ids_that_come_again_interleave_or_repeat(spark):
    rng, rows = random.Random(4), []
    for p in range(40):
        day = 1
        for _ in range(8):
            cid, n = rng.choice([1, 2, 3, None]), rng.randint(1, 4)
            rows += [(p, day + i, cid, i + 1, n) for i in range(n)]
            day += n + rng.choice([0, 0, 2])
    df = spark.createDataFrame(rows, "participant_id int, calendar_day_index int, cycle_id int, cycle_day int, cycle_length int")
    got = D.complete_cycles(df)
    runs = D.cycle_runs(df).groupBy("participant_id", "cycle_id", "cycle_run").agg(F.count("*").alias("n_days"), F.min("calendar_day_index").alias("first_day"), F.max("calendar_day_index").alias("last_day"))
    assert sorted(map(str, got.select(runs.columns).collect())) == sorted(map(str, runs.collect()))


def test_nested_documents_shuffle_no_days_and_are_compressed(spark, tmp_path):
    days = T.daily(spark, DIR).select("participant_id", F.col("calendar_day_index").alias("day_index"), "seizure_count")
    people = days.select("participant_id").distinct()
    assert "Exchange hashpartitioning" not in plan(io.nested(people, days, "participant_id"))
    io.write_nested_json(people, days, str(tmp_path), "participant_id")
    files = [f for f in tmp_path.iterdir() if f.name.startswith("part-")]
    assert all(f.name.endswith(".json.gz") for f in files)
    got = [json.loads(line) for f in files for line in gzip.open(f, "rt")]
    rows = sorted((int(g["patient_id"]), d["day_index"], d["seizure_count"]) for g in got for d in g["diary"])
    assert len(got) == people.count() and rows == sorted(map(tuple, days.collect()))
    assert all([d["day_index"] for d in g["diary"]] == list(range(1, len(g["diary"]) + 1)) for g in got)


def test_labels_of_cycles_and_spans_are_made_once_for_windows_and_study_pool(spark):
    before = {k: spark.conf.get(k) for k in T.WRITING}
    T.forget()
    T.classified(spark, DIR), T.pool(spark, DIR)
    names = [k[3] for k in T._written]
    assert names.count("cycle_labels") == names.count("spans") == 1
    assert {k: spark.conf.get(k) for k in T.WRITING} == before
    strict = X.cycle_labels(D.fan_out_phase_modes(T.daily(spark, DIR), ("strict_herzog",)))
    own = T.cycle_labels(spark, DIR).where("phase_mode = 'strict_herzog'").select(strict.columns)
    assert own.count() > 0 and own.exceptAll(strict).isEmpty() and strict.exceptAll(own).isEmpty()


def test_modes_of_a_cohort_are_constants(spark):
    days = T.daily(spark, DIR)
    assert "transform" not in plan(D.fan_out_phase_modes(days))
    rows = spark.createDataFrame([("population",), ("healthy_ovulatory",), (None,)], "cohort string")
    got = {(r.cohort, r.phase_mode) for r in D.cohort_modes(rows, ("strict_herzog", "modified_short_cycle")).collect()}
    assert got == {("population", "strict_herzog"), ("population", "modified_short_cycle"), ("healthy_ovulatory", "strict_herzog"), (None, "strict_herzog"), (None, "modified_short_cycle")}


def told(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*sorted(df.columns)).collect())


def test_definition_d_of_two_kinds_of_windows_classifies_no_others(spark, monkeypatch):
    monkeypatch.setattr(T, "_written", {})
    got = told(entry.queries()["label_D_window_alpha"](spark, DIR))
    assert not {"classified", "windows", "cycles", "cycle_labels"} & {k[-1] for k in T._written}
    some = T.windows(spark, DIR).where("window_type = 'full' or (window_type = 'calendar' and window_value = '12')")
    assert got == told(G.label_d(T.labelled(spark, DIR), some, T.classified(spark, DIR), T.alphas(spark, DIR), both=True))


def test_ratios_of_pooled_windows_need_no_labels_of_cycles_or_definitions(spark, monkeypatch):
    got = entry.queries()["finite_or_null"]
    monkeypatch.setattr(T, "_written", {})
    rows = got(spark, DIR).count()
    assert not {"classified", "cycle_labels", "participants"} & {k[-1] for k in T._written}
    assert rows == T.windows(spark, DIR).join(D.cohort_modes(T.windows(spark, DIR)), "cohort").count()


def test_labels_of_cycles_are_made_before_days_are_copied_for_the_modes(spark):
    days = T.daily(spark, DIR)
    got = X.cycle_labels_by_mode(days)
    assert plan(got).index("explode") < plan(got).index("HashAggregate", plan(got).index("explode"))  # from the top: copies come after a sum of days
    assert told(got) == told(X.cycle_labels(D.fan_out_phase_modes(days)))


def test_cycles_are_neither_broadcast_to_the_days_nor_shuffled(spark):
    text = plan(D.enrich_daily(T.daily(spark, DIR), P.cycles(spark, DIR, P.partitions(spark, DIR))))
    assert "Broadcast" not in text.replace("Subquery", "").split("ShuffledHashJoin")[0] and "ShuffledHashJoin" in text
    assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in text  # the participants


def test_bootstrap_neither_broadcasts_nor_sorts_its_draws(spark):
    parts = {"e": F.col("seizure_count"), "d": F.lit(1)}
    text = plan(R.bootstrap_by_participant(T.daily(spark, DIR), parts, F.col("e") / F.col("d"), n=1000))
    join = next(line for line in text.splitlines() if "Join" in line and "rank" in line)
    assert "ShuffledHashJoin" in join and "BuildRight" in join


def test_days_of_whole_cycles_are_neither_shuffled_nor_joined_by_a_broadcast_or_hashed_for_each_share(spark):
    for share in (None, 0.25):
        text = plan(Q._whole_ovulatory(spark, DIR, share))
        assert "Broadcast" not in text and "ShuffledHashJoin" in text and text.count("Exchange hashpartitioning") == 1 and "sha2" not in text
    want = T.cycle_table(spark, DIR).where("complete_cycle_flag").select("participant_id", "cycle_id")
    days = T.daily(spark, DIR).where("ovulatory_flag").join(want, ["participant_id", "cycle_id"], "left_semi")
    for share in (None, 0.25, 1.0):
        few = days if share is None else days.where(T.at() < share)
        assert told(Q._whole_ovulatory(spark, DIR, share).select(days.columns)) == told(few)
