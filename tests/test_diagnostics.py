"""Diagnostics, the result schema and files against plain recomputations."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import diagnostics as Z
from tidemark.operators import results as V
from tidemark.sources import io

INF = float("inf")


def test_ratio_audit(spark):
    base = ("strict_herzog", "cycle", "3")
    rows = [
        ("population", *base, 1.69, 1.82, 1.62, True), ("population", *base, INF, None, INF, True), ("population", *base, None, INF, INF, False), ("population", *base, 0.5, 2.0, None, True),
        ("healthy_ovulatory", *base, INF, 0.0, 5.0, True), ("population", "strict_herzog", "cycle", "6", INF, INF, INF, True), ("population", "modified_short_cycle", "cycle", "3", INF, INF, INF, True),
        ("population", "strict_herzog", "full", "full_diary", INF, INF, INF, True), ("population", *base, 1.0, 1.83, 9.0, None),
    ]
    df = spark.createDataFrame(rows, "cohort string, phase_mode string, window_type string, window_value string, rr_C1 double, rr_C2 double, rr_C3 double, c3_applicable_flag boolean")
    got = {(r.pattern, r.cohort): (r.n_finite, r.n_infinite, r.n_undefined, r.n_at_least, r.infinite_percent) for r in Z.ratio_audit(df).collect()}
    assert got == {
        ("C1", "population"): (3, 1, 1, 2, 50.0), ("C2", "population"): (3, 1, 1, 3, pytest.approx(100 / 3)), ("C3", "population"): (1, 1, 1, 2, 50.0),
        ("C1", "healthy_ovulatory"): (0, 1, 0, 1, 100.0), ("C2", "healthy_ovulatory"): (1, 0, 0, 0, None),
    }


def test_ratio_audit_of_every_window(spark):
    rows = [("population", "strict_herzog", "cycle", "3", 1.69, 1.0, 2.0, True), ("population", "modified_short_cycle", "full", "full_diary", INF, None, 2.0, False), ("healthy_ovulatory", "strict_herzog", "calendar", "6", 1.0, INF, None, False)]
    df = spark.createDataFrame(rows, "cohort string, phase_mode string, window_type string, window_value string, rr_C1 double, rr_C2 double, rr_C3 double, c3_applicable_flag boolean")
    got = {(r.phase_mode, r.window_type, r.cohort, r.pattern): (r.n_finite, r.n_infinite, r.n_undefined, r.n_not_applicable) for r in Z.ratio_audit(df, every=True).collect()}
    assert len(got) == 9 and all(sum(v) == 1 for v in got.values())
    assert got["modified_short_cycle", "full", "population", "C1"] == (0, 1, 0, 0) and got["modified_short_cycle", "full", "population", "C3"] == (0, 0, 0, 1) and got["strict_herzog", "cycle", "population", "C3"] == (1, 0, 0, 0)


def test_stacked_composition(spark):
    rows = [("a", "strict_herzog", "full", "C1 only", None), ("a", "strict_herzog", "full", None, None), ("a", "strict_herzog", "full", "none", "none"), ("a", "strict_herzog", "calendar", "none", "none"), ("a", "modified_short_cycle", "full", "none", "none")]
    df = spark.createDataFrame(rows, "cohort string, phase_mode string, window_type string, label_A_windowed_pattern_category string, label_B_pattern_category string")
    got = {(r.definition, r.category): (r.n, round(r.share, 6)) for r in Z.stacked_composition(df).collect()}
    assert len(got) == 14 and sum(n for n, _ in got.values()) == 6
    assert {k: v for k, v in got.items() if v[0]} == {
        ("A_windowed", "C1 only"): (1, 0.333333), ("A_windowed", "indeterminate"): (1, 0.333333), ("A_windowed", "none"): (1, 0.333333), ("B_minimum_data", "indeterminate"): (2, 0.666667), ("B_minimum_data", "none"): (1, 0.333333),
    }


def test_winsorized_histogram_equals_numpy(spark):
    rng = random.Random(2)
    rows = [("population" if i % 3 else "healthy_ovulatory", rng.expovariate(1), 7.0, rng.random(), None if i % 5 else INF) for i in range(900)]
    df = spark.createDataFrame(rows, "cohort string, seizures_per_month double, mean_cycle_length double, audit_ilp_fraction double, sd_cycle_length double")
    out = Z.winsorized_histogram(df).collect()
    assert {(r.field, r.cohort) for r in out} == {(f, c) for f in ("seizures_per_month", "mean_cycle_length") for c in ("population", "healthy_ovulatory")} | {("audit_ilp_fraction", "population")}
    for k, field in ((1, "seizures_per_month"), (2, "mean_cycle_length"), (3, "audit_ilp_fraction")):
        for cohort in ("population", "healthy_ovulatory"):
            mine = {r.bin: r for r in out if r.field == field and r.cohort == cohort}
            if not mine:
                continue
            v = np.round([r[k] for r in rows if r[0] == cohort], 9)
            low, high = np.quantile(v, [0.005, 0.995])
            n, edges = np.histogram(np.clip(v, low, high), bins=35)
            density, _ = np.histogram(np.clip(v, low, high), bins=35, density=True)
            assert [mine[b].n if b in mine else 0 for b in range(35)] == n.tolist()
            for b, r in mine.items():
                assert (r.density, r.lower) == pytest.approx((density[b], edges[b]), rel=1e-6)


def test_dominant_period_equals_a_transform_of_each_diary(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for p in range(40):
        n = rng.choice([1, 2, 3, 30, 365, 400, 800])
        y = [int(rng.random() < 0.2 + 0.15 * math.sin(2 * math.pi * t / 28)) * rng.randint(1, 3) for t in range(n)]
        if p == 7:
            y = [0] * n
        rows += [(p, t + 1, v) for t, v in enumerate(y)]
        power = np.round(2 * np.abs(np.fft.rfft(np.array(y) - np.mean(y))) / n, 9)
        ok = [k for k in range(1, n // 2 + 1) if n / k <= 365]
        if ok and any(y):
            k = max(ok, key=lambda k: (power[k], -k))
            want[p] = (n / k, power[k])
    df = spark.createDataFrame(rows, "participant_id int, calendar_day_index int, seizure_count int").repartition(7)
    got = {r.participant_id: (r.period_days, r.amplitude) for r in Z.dominant_period(df).collect()}
    assert got.keys() == want.keys()
    for p, x in want.items():
        assert got[p] == pytest.approx(x, abs=1e-8)


def test_ties_of_periods_go_to_the_longer_one(spark):
    one = spark.createDataFrame([(1, d, int(d == 5)) for d in range(1, 41)], "participant_id int, calendar_day_index int, seizure_count int")  # one event: all amplitudes agree
    assert Z.dominant_period(one).first().period_days == 40.0


def test_ordered_row(spark):
    df = spark.createDataFrame([("p", "x", 3, 9, float("nan"), 2.5, "true", 1)], "participant_id string, extra string, start_day int, end_day int, rr_C1 double, rr_C2 float, label_D_any string, window_seq int")
    out = V.ordered_row(df)
    assert len(V.SCHEMA) == 62 and out.columns == [*V.SCHEMA, "extra", "window_seq"]
    assert [t for _, t in out.dtypes][1:62] == [{"long": "bigint"}.get(t, t) for t in V.SCHEMA.values()][1:]
    r = out.first()
    assert (r.participant_id, r.window_start, r.window_end, r.rr_C1, r.rr_C2, r.label_D_any, r.cohort, r.label_D_C3, r.extra) == ("p", 3, 9, None, 2.5, True, None, None, "x")
    assert V.ordered_row(out).columns == out.columns


def test_outputs_hold_the_ordered_columns_and_d(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", True, 1), (2, "b", None, 2)], "participant_id long, cohort string, label_D_any boolean, start_day long")
    io.write_outputs({"window_results": V.ordered_row(rows)}, rows, str(tmp_path))
    back = io.read_result_tables(spark, str(tmp_path), "window_results")["window_results"]
    assert set(back.columns) == set(V.SCHEMA)
    assert {(r.participant_id, r.cohort, r.label_D_any, r.window_start) for r in back.collect()} == {(1, "a", True, 1), (2, "b", None, 2)}


DAYS = [{"patient_id": "p1", "day_index": 1, "age_years": 31.5, "cycle_index": 1, "cycle_day": 4, "cycle_length": 28, "estradiol_pg_ml": 40.0, "progesterone_ng_ml": 0.4, "ovulation": False, "uterine_bleeding": 1, "note": "more"},
        {"patient_id": "p1", "day_index": 2, "age_years": "old", "cycle_index": 1, "cycle_day": 5, "cycle_length": None, "estradiol_pg_ml": 41, "progesterone_ng_ml": 0.5, "ovulation": True, "uterine_bleeding": 0}]


@pytest.mark.parametrize("kind", ["nested", "rows", "lines"])
def test_diaries_from_json(spark, tmp_path, kind):
    text = {"nested": json.dumps({"profile": {"seed": 1}, "diary": DAYS}, indent=1), "rows": json.dumps(DAYS, indent=1), "lines": "\n".join(map(json.dumps, DAYS))}[kind]
    (tmp_path / "d.json").write_text(text)
    if kind == "lines":  # one object a file where it is spread over lines: single rows are files of their own
        for i, d in enumerate(DAYS):
            (tmp_path / "each").mkdir(exist_ok=True)
            (tmp_path / "each" / f"{i}.json").write_text(json.dumps(d))
    df = io.read_diary(spark, str(tmp_path / "each") if kind == "lines" else str(tmp_path / "d.json"))
    assert df.dtypes == [tuple("int" if t == "int" else t for t in x.split()) for x in io.DIARY.split(", ")]
    a, b = df.orderBy("day_index").collect()
    assert tuple(a) == ("p1", 1, 31.5, 1, 4, 28, 40.0, 0.4, False, 1)
    assert tuple(b) == ("p1", 2, None, 1, 5, None, 41.0, 0.5, True, 0)
