import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tidemark.operators import definitions as X
from tidemark.operators import diary as D
from tidemark.operators import windows as W

SCHEMA = "participant_id long, cohort string, calendar_day_index int, cycle_id int, cycle_day int, cycle_length int, seizure_count int, seizure_day int, ovulatory_flag boolean, ilp_flag boolean"


def diary(spark, events, cycles, length=28, cohort="healthy_ovulatory"):
    """``events``: for each cycle the days with an event."""
    rows = []
    for c in range(cycles):
        for d in range(1, length + 1):
            n = events[c].count(d)
            rows.append((1, cohort, c * length + d, c + 1, d, length, n, int(n > 0), True, False))
    return spark.createDataFrame(rows, SCHEMA)


def classify(spark, daily, kind, value, end):
    window = spark.createDataFrame([(1, daily.first().cohort, kind, value, 1, True, 1, end, None)], "participant_id long, cohort string, window_type string, window_value string, window_seq int, valid boolean, start_day long, end_day long, invalid_reason string")
    return X.classify_windows(D.fan_out_phase_modes(daily), window).where("phase_mode = 'strict_herzog'").first()


def test_single_cycle_infinite_ratio(spark):
    r = classify(spark, diary(spark, [[1]], 1), "calendar", "1", 28)
    assert r.rr_C1 == float("inf") and r.label_A_windowed_C1 and r.label_A_windowed_any
    assert r.label_A_windowed_pattern_category == "C1 only" and r.label_A_windowed_C2 is None


@pytest.mark.parametrize(("positive", "expected"), [(2, True), (1, False)])
def test_exact_two_of_three(spark, positive, expected):
    r = classify(spark, diary(spark, [[1] if c < positive else [4] for c in range(3)], 3), "cycle", "3", 84)
    assert r.label_A_exact_C1 is expected


@pytest.mark.parametrize(("positive", "expected"), [(4, True), (3, False)])
def test_reproducible_two_thirds(spark, positive, expected):
    r = classify(spark, diary(spark, [[1, 1, 2] if c < positive else [4] for c in range(6)], 6), "cycle", "6", 168)
    assert r.label_C_C1 is expected and r.n_complete_cycles == 6


def test_invalid_window_has_a_reason_and_no_labels(spark):
    daily = diary(spark, [[1]], 1)
    w = W.windows_calendar(W.spans(daily), (1,))
    r = X.classify_windows(D.fan_out_phase_modes(daily), w).first()
    assert not r.valid and r.n_days == 0 and r.label_A_windowed_any is None and r.a_windowed_reason is None
    assert r.indeterminate_reason == "calendar_window_longer_than_diary"


def test_no_double_is_nan(spark):
    out = X.classify_windows(D.fan_out_phase_modes(diary(spark, [[], [], []], 3, cohort="population")), W.primary_windows(diary(spark, [[], [], []], 3, cohort="population"), D.complete_cycles(diary(spark, [[], [], []], 3, cohort="population"))))
    doubles = [c for c, t in out.dtypes if t == "double"]
    assert out.where(" or ".join(f"isnan({c})" for c in doubles)).isEmpty()


def test_alignment(spark):
    a = spark.createDataFrame([(1, d, d % 2) for d in range(1, 5)], "participant_id long, calendar_day_index int, seizure_count int")
    b = a.select("participant_id", "calendar_day_index", F.lit(1).alias("cycle_id"))
    assert D.align_diaries(a, b).count() == 4
    with pytest.raises(SparkRuntimeException, match="same calendar-day index"):  # by the job that reads the days
        D.align_diaries(a, b.withColumn("calendar_day_index", F.col("calendar_day_index") + 1)).collect()


def test_enrichment_adds_the_wanted_mean(spark):
    daily = spark.range(4000).select(F.lit(1).alias("participant_id"), (F.col("id") + 1).cast("int").alias("calendar_day_index"), F.lit("M").alias("phase"), F.lit(1).alias("seizure_count"))
    mean = D.inject_enrichment(daily, "M", 2.0).agg(F.avg("seizure_count").alias("m")).first().m
    assert 1.9 < mean < 2.1
    assert D.inject_enrichment(daily, "M", 1.0) is daily


def recurring(spark):
    """Cycles 1, 2 and again 1 and 2, the last cut short: each run of an id is a cycle of its own."""
    rows, day = [], 0
    for cycle, length, days in ((1, 28, 28), (2, 30, 30), (1, 28, 28), (2, 30, 12)):
        for d in range(1, days + 1):
            day += 1
            rows.append((1, "healthy_ovulatory", day, cycle, d, length, int(d == 2), int(d == 2), True, False))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_an_id_that_comes_again_is_another_cycle(spark):
    daily = recurring(spark)
    got = sorted((r.cycle_run, r.cycle_id, r.first_day, r.last_day, r.complete_cycle_flag) for r in D.complete_cycles(daily).collect())
    assert got == [(1, 1, 1, 28, True), (2, 2, 29, 58, True), (3, 1, 59, 86, True), (4, 2, 87, 98, False)]
    marked = D.mark_complete_cycles(daily).collect()
    assert len(marked) == 98 and all(r.complete_cycle_flag == (r.calendar_day_index <= 86) for r in marked)
    labels = X.cycle_labels(D.fan_out_phase_modes(daily)).where("phase_mode = 'strict_herzog'").collect()
    assert sorted((r.cycle_id, r.first_day, r.last_day, r.c1) for r in labels) == [(1, 1, 28, True), (1, 59, 86, True), (2, 29, 58, True)]
    assert classify(spark, daily, "calendar", "3", 90).n_complete_cycles == 3


def test_runs_of_cycles_take_an_id_once(spark):
    daily = recurring(spark)
    w = W.windows_cycle_runs(W.spans(daily), D.complete_cycles(daily), (1, 2, 3)).collect()
    assert {r.window_value: r.valid for r in w} == {"1": True, "2": True, "3": False}
    assert [(r.start_day, r.end_day) for r in w if r.window_value == "2"] == [(1, 98)]


def test_missing_ids_are_runs_too(spark):
    rows = [(1, "population", d, None if 3 <= d <= 5 else 1, d, 7, 0, 0, True, False) for d in range(1, 8)]
    got = D.complete_cycles(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.cycle_run, r.n_days, r.complete_cycle_flag) for r in got) == [(1, 2, False), (2, 3, False), (3, 2, False)]
