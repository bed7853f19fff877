"""Summaries, validation and comparison against plain recomputations, with definition D, which SQL cannot fit."""

import json
import math

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import compare as K
from tidemark.operators import cyclestats as Y
from tidemark.operators import diagnostics as Z
from tidemark.operators import resample as R
from tidemark.operators import summaries as S
from tidemark.plans import queries as Q
from tidemark.plans import tables as T

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    return T.results(spark, DIR)


@pytest.fixture(scope="module")
def rows(results):
    return [r.asDict() for r in results.collect()]


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[g] for g in S.GROUP), []).append(r)
    return out


def test_participants_by_window_with_d(results, rows):
    got = {(r.cohort, r.phase_mode, r.window_type, r.window_value, r.definition): r for r in S.summarize_participants(results).collect()}
    n = 0
    for key, own in grouped(rows).items():
        for definition, label in S.DEFINITIONS.items():
            people = {}
            for r in own:
                people.setdefault(r["participant_id"], []).append(r[label])
            known = [any(x is not None for x in v) for v in people.values()]
            yes = [any(x is True for x in v) for v in people.values()]
            g = got[(*key, definition)]
            assert (g.n_windows, g.n_participants, g.n_classifiable, g.positives) == (len(own), len(people), sum(known), sum(yes))
            assert g.false_positive_rate == (sum(yes) / sum(known) if any(known) else None)
            n += 1
    assert n == len(got)


def test_reasons_with_d(results, rows):
    got = {(r.cohort, r.phase_mode, r.window_type, r.window_value, r.definition, r.indeterminate_reason): r for r in S.summarize_reasons(results).collect()}
    want = {}
    for key, own in grouped(rows).items():
        for definition, reason in S.REASONS.items():
            missing = [r for r in own if r[S.DEFINITIONS[definition]] is None]
            for r in missing:
                name = (*key, definition, r[reason] or "unknown")
                want[name] = (want.get(name, (0,))[0] + 1, len(own), len(missing))
    assert {k: (r.positives, r.n_windows, r.n_indeterminate) for k, r in got.items()} == want
    assert any(k[4] == "D_nb_regression_any" for k in want)


def test_headline_and_views_with_d(spark, results):
    head = S.headline(S.summarize_windows(results, strata=False)).collect()
    assert {r.definition for r in head} == set(S.HEADLINE) and len(head) == 12
    views = S.report_slices(Q.unified_summary_with_d(spark, DIR))
    assert set(views) == {"primary", "by_window", "phase_mode", "study", "subsets", "patterns", "alpha", "strata", "historical"}
    assert {r.definition for r in views["alpha"].collect()} == {"D_nb_regression_C1_or_C2", "D_nb_regression_window_alpha_C1_or_C2"}


def test_unstable_denominator(spark):
    base = {"participant_id": 1, "cohort": "c", "phase_mode": "m", "window_type": "full", "window_value": "full_diary", "seizure_days_per_month": 1.0, "seizures_per_month": 1.0, "seizure_days_total": 5, "strict_herzog_eligible_flag": True}
    kinds = ", ".join(f"{k} {'long' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in base.items())
    df = spark.createDataFrame([(*base.values(), True if i == 0 else None) for i in range(10)], kinds + ", label_B_any boolean")
    r = S.summarize_windows(df, strata=False).where("subset = 'all'").first()
    assert (r.n_windows, r.n_classifiable, r.positives, r.unstable_denominator, r.interpretation_note) == (10, 1, 1, True, S.UNSTABLE)
    assert math.isclose(r.indeterminate_rate, 0.9) and math.isclose(r.positive_rate_all_attempted, 0.1)


def test_texts(spark):
    df = spark.createDataFrame([(None, None), (0.5, 1.0), (1.0, 2.0), (4.0, 4.0), (10.0, 9.0)], "x double, y double")
    got = [tuple(r) for r in df.select(C.seizure_frequency_stratum("x"), C.cycle_regularity_stratum("y")).collect()]
    assert got == [
        ("unknown", "unknown"), ("<1 seizure-day/month", "SD cycle length <2 days"), ("1 to <4 seizure-days/month", "SD cycle length 2 to <4 days"), ("4 to <10 seizure-days/month", "SD cycle length >=4 days"),
        (">=10 seizure-days/month", "SD cycle length >=4 days"),
    ]
    df = spark.createDataFrame([(0.1234, 0.1, 0.15), (None, None, None), (0.3125, 0.0, 1.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(C.rate_ci_text("a", "b", "c")).collect()] == ["12.3% (10.0, 15.0)", "NA", "31.2% (0.0, 100.0)"]
    df = spark.createDataFrame([("calendar", "1"), ("calendar", "3"), ("cycle", "1"), ("cycle", "6"), ("full", "full_diary"), ("other", "x")], "a string, b string")
    assert [r[0] for r in df.select(C.window_label("a", "b")).collect()] == ["1 month", "3 months", "1 cycle", "6 cycles", "36 months", "other x"]


def test_minimum_data_needs_duration(spark):
    kinds = "cohort string, phase_mode string, window_type string, window_value string, seizure_days_total long, label_A_windowed_C1_or_C2 boolean"
    rows = [("c", "strict_herzog", t, v, 5, True) for t, v in (("calendar", "3"), ("calendar", "4"), ("cycle", "3"), ("cycle", "6"), ("full", "full_diary"))]
    got = {(r.window_type, r.window_value, r.min_seizure_days): r.n_meeting_minimum for r in Z.minimum_data_sensitivity(spark.createDataFrame(rows, kinds)).collect()}
    assert {k[:2] for k, n in got.items() if n and k[2] == 4} == {("calendar", "4"), ("cycle", "6"), ("full", "full_diary")}
    assert not any(n for k, n in got.items() if k[2] == 6)


def test_c3_fits_summary(spark):
    fits = spark.createDataFrame([(1, "population", True, None), (2, "population", False, None), (3, "population", None, "too few"), (4, "healthy_ovulatory", None, "x")], "participant_id long, cohort string, label_D_C3_exploratory boolean, d_c3_reason string")
    windows = spark.createDataFrame([(i, "population", "strict_herzog", "full", i < 3) for i in (1, 2, 3)], "participant_id long, cohort string, phase_mode string, window_type string, c3_applicable_flag boolean")
    r = Z.c3_nb_summary(fits, windows).first()
    assert (r.n_attempted_audit_participants, r.n_ratio_c3_applicable, r.n_nb_classifiable, r.positives) == (3, 2, 2, 1)
    assert json.loads(r.reason_counts) == {"classifiable": 2, "too few": 1}


def test_asserts(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (2, 1, 7)], "g int, o int, v int")
    for same in (Z.assert_unique_key(df, "g", "o"), Z.assert_monotone(df, ["g"], "o", "v"), Z.assert_reconciled(df, df, ["g", "o"], "v")):
        assert sorted(same.select("g", "o", "v").collect()) == sorted(df.collect())
    for call in (lambda: Z.assert_unique_key(df, "g"), lambda: Z.assert_monotone(df, ["g"], "o", "o"), lambda: Z.assert_reconciled(df, df.withColumn("v", F.lit(5)), ["g", "o"], "v")):
        with pytest.raises(SparkRuntimeException):  # by the job that reads the table
            call().collect()


def test_published_bounds(spark):
    """A population that meets the targets passes, one that is off by more than the margin does not."""
    rows = [(p, k, 32.0, 29 - (k % 2), True, 16, 4) for p in range(30) for k in range(1, 9)] + [(99, k, 32.0, 60, True, 16, 4) for k in (1, 2)]
    cycles = spark.createDataFrame(rows, "participant_id long, cycle_id int, age double, cycle_length int, ovulatory_flag boolean, ovulation_day int, bleeding_days int")
    got = {r.name: r for r in Y.age_band_metrics(spark, cycles).collect()}
    assert (got["cycle_mean_30-34"].observed, got["cycle_mean_30-34"].lower_bound, got["cycle_mean_30-34"].upper_bound, got["cycle_mean_30-34"].passed) == (28.5, 28.2, 29.3, True)
    assert not got["cycle_within_person_sd_30-34"].passed and got["cycle_short_lt24_30-34"].lower_bound == 0.0371  # participants with 2 cycles do not count
    assert {r.passed for r in Y.external_metrics(spark, cycles).where("name like '%mean_31%'").collect()} == {True}
    assert {r.name: r.passed for r in Y.overall_metrics(spark, cycles).collect()}["bleeding_mean_days"] is True


def test_nineteen_rules():
    assert len(Y.RULES) == 19 and {r[0] for r in Y.RULES} == set(Y.SCENARIOS)


def test_runs_with_absent_keys_align(spark):
    a = spark.createDataFrame([("x", "1", 1.0), ("x", None, 2.0)], "definition string, window_value string, positives double")
    b = a.where("window_value is null").withColumn("positives", F.lit(2.5))
    r = K.diff_runs(a, b).first()
    assert (r.metric, r.n_aligned, r.n_old_only, r.n_new_only, r.n_changed, r.max_abs_delta) == ("positives", 1, 1, 0, 1, 0.5)


def test_hash_ranks_are_ranks(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("null_group"))
    for group in (["g"], ["null_group"], []):
        h = C.stable_hash(1, "id")
        got = R.hash_ranked(df, group, h, "id").withColumn("h", h).collect()
        assert len(got) == 5000
        parts = {}
        for r in got:
            parts.setdefault(tuple(r[x] for x in group), []).append((r.h, r.id, r._rank))
        assert all([x[2] for x in sorted(v)] == list(range(len(v))) for v in parts.values())
        few = R.hash_ranked(df, group, h, "id", F.lit(3)).collect()
        assert sorted((r.id, r._rank) for r in few) == sorted((x[1], x[2]) for v in parts.values() for x in v if x[2] < 3)


def test_studies_draw_without_replacement(spark):
    """With small draws some studies need more of them; each still has n different participants."""
    rows = [(c, "m", i, s, bool(i % 2)) for c, total in (("a", 41), ("b", 12)) for i in range(total) for s in (1, 2)]
    pool = spark.createDataFrame(rows, "cohort string, phase_mode string, participant_id long, window_seq int, label boolean")
    out = R.study_mc(pool, {"d": "label"}, n_studies=50, sizes=(10, 12, 40)).collect()
    assert {(r.cohort, r.n_participants) for r in out} == {("a", 10), ("a", 12), ("a", 40), ("b", 10), ("b", 12)} and len(out) == 250
    assert all(r.n_classifiable == r.n_participants for r in out)
    mean = sum(r.positives for r in out if r.cohort == "a" and r.n_participants == 10) / 500
    assert abs(mean - 20 / 41) < 0.06
