"""The registered queries of the analysis, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import compare as K
from ..operators import cyclestats as Y
from ..operators import definitions as X
from ..operators import diagnostics as Z
from ..operators import diary as D
from ..operators import glm as G
from ..operators import resample as R
from ..operators import results as V
from ..operators import summaries as S
from ..operators import windows as W
from ..sources import io
from . import diary as P
from . import sql as Q
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WKEY = ["participant_id", "phase_mode", "window_type", "window_value"]


def _counted(sql: str) -> str:
    """``count_if(x)`` as a filtered count, which is 0 where x is null throughout."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}(count(*) FILTER (WHERE {sql[at + len('count_if('):end - 1]})){sql[end:]}"
    return sql


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = _counted(sql)
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded, so that engines that add in another order agree."""
    return F.round(C.col(c).cast("double"), 6).alias(name or c)


def n(c: str | Column, name: str | None = None) -> Column:
    return C.col(c).cast("long").alias(name or c)


DAY = f"WITH {Q.DAYS}"
LAB = f"WITH {Q.LABELLED}"
CLS = f"WITH {Q.CLASSIFIED}"
WIN = f"WITH {Q.DAYS}, {Q.WINDOWS}"
WK = "participant_id, phase_mode, window_type, window_value"

# --- diaries


@query(DAY + " SELECT participant_id, calendar_day_index, cycle_id, cycle_day, seizure_count::BIGINT AS seizure_count, seizure_day FROM day")
def align_diaries(spark, sf):
    days = P.cycle_days(spark, sf)
    return D.align_diaries(P.event_diary(spark, sf), days).select(*D.DAY, "cycle_id", "cycle_day", n("seizure_count"), "seizure_day")


@query(DAY + " SELECT participant_id, calendar_day_index, ovulatory_flag, ovulation_day, cycle_stage, menses_onset_flag FROM day")
def enrich_daily(spark, sf):
    return D.enrich_daily(T.daily(spark, sf), P.cycles(spark, sf, P.partitions(spark, sf))).select(*D.DAY, "ovulatory_flag", "ovulation_day", "cycle_stage", "menses_onset_flag")


@query(
    DAY
    + """, a AS (SELECT participant_id, calendar_day_index, sum(menses_onset_flag) OVER (PARTITION BY participant_id ORDER BY calendar_day_index) AS k FROM day),
b AS (SELECT *, row_number() OVER (PARTITION BY participant_id, k ORDER BY calendar_day_index) AS d, count(*) OVER (PARTITION BY participant_id, k) AS l, max(k) OVER (PARTITION BY participant_id) AS m FROM a)
SELECT participant_id, calendar_day_index, k::BIGINT AS derived_cycle_id, d::INT AS derived_cycle_day, CASE WHEN k > 0 AND k < m THEN l END AS derived_cycle_length FROM b"""
)
def derive_cycles(spark, sf):
    return D.derive_cycles(T.daily(spark, sf)).select(*D.DAY, "derived_cycle_id", "derived_cycle_day", "derived_cycle_length")


@query(DAY + " SELECT participant_id, cycle_id, round(mid_luteal_progesterone, 6) AS mid_luteal_progesterone, ilp_flag FROM ilp")
def ilp_flag(spark, sf):
    return D.ilp_cycles(T.daily(spark, sf)).select("participant_id", "cycle_id", r6("mid_luteal_progesterone"), "ilp_flag")


_PHASE = "SELECT participant_id, calendar_day_index, {0} AS label FROM bday"


@query(LAB + " SELECT participant_id, calendar_day_index, bd AS backward_day FROM bday")
def backward_day(spark, sf):
    return T.daily(spark, sf).select(*D.DAY, C.backward_day("cycle_day", "cycle_length").alias("backward_day"))


def _phase(name: str, function, sql: str) -> None:
    query(LAB + " " + _PHASE.format(sql), name)(lambda spark, sf: T.daily(spark, sf).select(*D.DAY, function("cycle_day", "cycle_length").alias("label")))


_phase("phase_strict", C.phase_strict, Q.STRICT)
_phase("phase_modified_short", C.phase_modified_short, Q.SHORT)
_phase("phase_luteal_anchored", C.phase_luteal_anchored, Q.ANCHORED)
_phase("phase_reddy", C.phase_reddy, Q.REDDY)


@query(LAB + f" SELECT participant_id, calendar_day_index, bd AS backward_day, {Q.ANCHORED} AS phase, {Q.REDDY} AS phase_reddy, cycle_length BETWEEN 23 AND 35 AS strict_herzog_cycle_eligible, true AS luteal_anchored_ovulatory_flag FROM bday")
def add_phase_labels(spark, sf):
    return D.add_phase_labels(T.daily(spark, sf), "luteal_anchored_ovulatory").select(*D.DAY, "backward_day", "phase", "phase_reddy", "strict_herzog_cycle_eligible", "luteal_anchored_ovulatory_flag")


@query(LAB + " SELECT participant_id, calendar_day_index, phase_mode, phase, phase_reddy FROM lab")
def fan_out_phase_modes(spark, sf):
    return T.labelled(spark, sf).select(*D.DAY, "phase_mode", "phase", "phase_reddy")


_ALL = f"WITH {Q.DAYS}, {Q.COMPLETE}"


@query(_ALL + " SELECT participant_id, calendar_day_index, cycle_id, complete_cycle_flag FROM cyn JOIN cycall USING (participant_id, cycle_id, cycle_run)")
def mark_complete_cycles(spark, sf):
    return D.mark_complete_cycles(T.daily(spark, sf)).select(*D.DAY, "cycle_id", "complete_cycle_flag")


@query(_ALL + " SELECT participant_id, cycle_id, first_day, last_day FROM cycall WHERE complete_cycle_flag AND strict_cycle_flag")
def complete_cycle_ids(spark, sf):
    return T.cycle_table(spark, sf).where("complete_cycle_flag and strict_cycle_flag").select("participant_id", "cycle_id", "first_day", "last_day")


@query(_ALL + " SELECT participant_id, count_if(complete_cycle_flag)::BIGINT AS n_complete_cycles FROM cycall GROUP BY 1")
def count_complete_cycles(spark, sf):
    return T.cycle_table(spark, sf).groupBy("participant_id").agg(F.count_if("complete_cycle_flag").alias("n_complete_cycles"))


@query()
def inject_enrichment(spark, sf):
    more = D.inject_enrichment(D.add_phase_labels(T.daily(spark, sf), "strict_herzog"))
    return more.select(*D.DAY, "phase", "seizure_count", "seizure_day")


_PART = (
    DAY
    + """, pc AS (SELECT participant_id, cycle_id, max(cycle_length) AS len, max(ovulatory_flag::INT) AS ov FROM day GROUP BY 1, 2),
bc AS (SELECT participant_id, avg(len) AS mean_cycle_length, coalesce(stddev_samp(len), 0) AS sd_cycle_length, avg(ov) AS ovulatory_fraction, count(*) AS n_cycles FROM pc GROUP BY 1),
tot AS (SELECT participant_id, max(cohort) AS cohort, max(age) AS age, count(*) AS n_days, sum(seizure_count)::BIGINT AS seizure_count_total, sum(seizure_day)::BIGINT AS seizure_days_total, arg_min(cycle_day, calendar_day_index) AS start_cycle_day, arg_min(cycle_length, calendar_day_index) AS start_cycle_length FROM day GROUP BY 1),
part AS (SELECT *, seizure_count_total / (n_days / 30.0::DOUBLE) AS seizures_per_month, seizure_days_total / (n_days / 30.0::DOUBLE) AS seizure_days_per_month FROM tot JOIN bc USING (participant_id)),
people AS (SELECT *, CASE WHEN seizure_days_per_month < 1 THEN '<1 seizure-day/month' WHEN seizure_days_per_month < 4 THEN '1 to <4 seizure-days/month' WHEN seizure_days_per_month < 10 THEN '4 to <10 seizure-days/month' ELSE '>=10 seizure-days/month' END AS seizure_frequency_stratum,
CASE WHEN sd_cycle_length < 2 THEN 'SD cycle length <2 days' WHEN sd_cycle_length < 4 THEN 'SD cycle length 2 to <4 days' ELSE 'SD cycle length >=4 days' END AS cycle_regularity_stratum FROM part)"""
)


@query(_PART + f""", s AS (SELECT participant_id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY {Q.sha('participant_id')}, participant_id) AS r, count(*) OVER (PARTITION BY cohort) AS c FROM people)
SELECT participant_id, cohort FROM s WHERE r <= greatest(1, round_even(c * 0.1, 0))""")
def audit_sample(spark, sf):
    return D.audit_sample(T.participants(spark, sf), 0.1).select("participant_id", "cohort")


@query(_PART + " SELECT participant_id, cohort, round(age, 6) AS age, n_days, n_cycles, seizure_count_total, seizure_days_total, start_cycle_day, start_cycle_length, round(mean_cycle_length, 6) AS mean_cycle_length, round(sd_cycle_length, 6) AS sd_cycle_length, round(ovulatory_fraction, 6) AS ovulatory_fraction, round(seizures_per_month, 6) AS seizures_per_month, round(seizure_days_per_month, 6) AS seizure_days_per_month FROM people")
def participant_summary(spark, sf):
    return T.participants(spark, sf).select(
        "participant_id", "cohort", r6("age"), "n_days", "n_cycles", n("seizure_count_total"), n("seizure_days_total"), "start_cycle_day", "start_cycle_length", r6("mean_cycle_length"), r6("sd_cycle_length"), r6("ovulatory_fraction"), r6("seizures_per_month"), r6("seizure_days_per_month"))


@query(_PART + " SELECT participant_id, seizure_frequency_stratum FROM people")
def seizure_frequency_stratum(spark, sf):
    return T.participants(spark, sf).select("participant_id", "seizure_frequency_stratum")


@query(_PART + " SELECT participant_id, cycle_regularity_stratum FROM people")
def cycle_regularity_stratum(spark, sf):
    return T.participants(spark, sf).select("participant_id", "cycle_regularity_stratum")


@query(_PART + ", " + Q.WINDOWS + " SELECT participant_id, window_type, window_value, seizure_frequency_stratum, cycle_regularity_stratum FROM win JOIN people USING (participant_id)")
def attach_strata(spark, sf):
    return D.attach_strata(T.windows(spark, sf), T.participants(spark, sf)).select("participant_id", "window_type", "window_value", "seizure_frequency_stratum", "cycle_regularity_stratum")


@query(DAY + " SELECT participant_id, ((calendar_day_index - 1) // 7)::BIGINT AS block, sum(seizure_count)::BIGINT AS seizure_count, count(*) AS n_days FROM day GROUP BY 1, 2")
def resample_diary(spark, sf):
    return D.resample_diary(T.daily(spark, sf), 7).select("participant_id", n("block"), n("seizure_count"), "n_days")


@query(DAY + " SELECT participant_id, calendar_day_index, least(seizure_count, 1)::BIGINT AS seizure_count, (seizure_count > 0)::INT AS seizure_day FROM day")
def clip_counts(spark, sf):
    return D.clip_counts(T.daily(spark, sf), 1).select(*D.DAY, n("seizure_count"), "seizure_day")


# --- windows

_WCOLS = "participant_id, cohort, window_type, window_value, window_seq, valid, start_day::BIGINT AS start_day, end_day::BIGINT AS end_day, invalid_reason"


def _wcols(df: DataFrame) -> DataFrame:
    return df.withColumn("start_day", n("start_day")).withColumn("end_day", n("end_day"))


@query(f"WITH {Q.DAYS}, {Q.SPANS}, {Q.calendar('wc', '1, 3, 4, 6, 9, 12, 18, 24, 36, 48')} SELECT {_WCOLS} FROM wc")
def windows_calendar(spark, sf):
    return _wcols(W.windows_calendar(T.spans(spark, sf), (*W.MONTHS, 48)))


@query(WIN + f" SELECT {_WCOLS} FROM wfull")
def windows_full(spark, sf):
    return _wcols(W.windows_full(T.spans(spark, sf)))


@query(WIN + f" SELECT {_WCOLS} FROM wcyc")
def windows_cycle_runs(spark, sf):
    return _wcols(W.windows_cycle_runs(T.spans(spark, sf), T.cycle_table(spark, sf)))


_POOL = Q.calendar("wp", "3", "study", 5)


@query(f"WITH {Q.DAYS}, {Q.SPANS}, {_POOL} SELECT {_WCOLS} FROM wp")
def windows_study_pool(spark, sf):
    return _wcols(W.windows_study_pool(T.spans(spark, sf)))


@query(WIN + " SELECT participant_id, window_type, window_value, count(*) AS n_days, sum(seizure_count)::BIGINT AS events, min(calendar_day_index) AS first_day, max(calendar_day_index) AS last_day FROM win JOIN day USING (participant_id) WHERE valid AND calendar_day_index BETWEEN start_day AND end_day GROUP BY 1, 2, 3")
def subset_window(spark, sf):
    rows = W.subset_window(T.daily(spark, sf), T.windows(spark, sf))
    return rows.groupBy("participant_id", "window_type", "window_value").agg(F.count("*").alias("n_days"), F.sum("seizure_count").alias("events"), F.min("calendar_day_index").alias("first_day"), F.max("calendar_day_index").alias("last_day"))


@query(CLS + f" SELECT {WK}, n_days, seizure_count_total::BIGINT AS seizure_count_total, seizure_days_total::BIGINT AS seizure_days_total, n_complete_cycles, strict_herzog_eligible_flag, short_cycle_modified_flag, c3_applicable_flag, round(seizure_days_per_month, 6) AS seizure_days_per_month, round(seizures_per_month, 6) AS seizures_per_month FROM w")
def window_base_fields(spark, sf):
    return T.classified(spark, sf).select(*WKEY, "n_days", n("seizure_count_total"), n("seizure_days_total"), "n_complete_cycles", "strict_herzog_eligible_flag", "short_cycle_modified_flag", "c3_applicable_flag", r6("seizure_days_per_month"), r6("seizures_per_month"))


@query(CLS + f" SELECT {WK}, analyzable_flag FROM w")
def analyzable_flag(spark, sf):
    return T.pooled(spark, sf).select(*WKEY, "analyzable_flag")


@query(WIN + " SELECT participant_id, window_type, window_value FROM win WHERE window_type = 'full' OR (window_type = 'calendar' AND window_value = '3')")
def window_selector(spark, sf):
    return W.window_selector(T.windows(spark, sf), [{"window_type": "full"}, {"window_type": "calendar", "window_value": 3}]).select("participant_id", "window_type", "window_value")


# --- ratios

_PHASES = ", ".join(f"coalesce(sum(CASE WHEN phase = '{p}' THEN 1 END), 0)::BIGINT AS days_{p}, coalesce(sum(CASE WHEN phase = '{p}' THEN seizure_count END), 0)::BIGINT AS events_{p}" for p in "MOFL")


@query(LAB + f" SELECT participant_id, phase_mode, {_PHASES} FROM lab GROUP BY 1, 2")
def phase_counts(spark, sf):
    return X.phase_counts(T.labelled(spark, sf), "participant_id", "phase_mode")


@query(LAB + f" SELECT participant_id, phase_mode, cycle_id, {_PHASES} FROM lab GROUP BY 1, 2, 3")
def phase_counts_by_cycle(spark, sf):
    return X.phase_counts(T.labelled(spark, sf), "participant_id", "phase_mode", "cycle_id")


_ADSF = ", ".join(f"round(CASE WHEN days_{p} > 0 THEN events_{p}::DOUBLE / days_{p} END, 6) AS adsf_{p}" for p in "MOFL")
_ADSF += ", round(CASE WHEN days_F + days_L > 0 THEN (events_F + events_L)::DOUBLE / (days_F + days_L) END, 6) AS adsf_FL, round(CASE WHEN days_O + days_L + days_M > 0 THEN (events_O + events_L + events_M)::DOUBLE / (days_O + days_L + days_M) END, 6) AS adsf_OLM"


@query(CLS + f" SELECT {WK}, {_ADSF} FROM w")
def observed_phase_adsf(spark, sf):
    return T.pooled(spark, sf).select(*WKEY, *[r6(f"adsf_{p}") for p in ("M", "O", "F", "L", "FL", "OLM")])


_MF = ("events_M", "days_M", "events_F", "days_F")


@query(CLS + f" SELECT {WK}, round({Q.rr(*_MF)}, 6) AS ratio, {Q.why(*_MF)} AS reason FROM w")
def adsf_ratio(spark, sf):
    x = C.adsf_ratio(*_MF)
    return T.pooled(spark, sf).select(*WKEY, r6(x["ratio"], "ratio"), x["reason"].alias("reason"))


@query(CLS + f" SELECT {WK}, {Q.rr(*_MF)} >= 2 AS positive FROM w")
def ratio_positive(spark, sf):
    return T.pooled(spark, sf).select(*WKEY, C.ratio_positive(C.adsf_ratio(*_MF)["ratio"], 2.0).alias("positive"))


@query(CLS + f" SELECT {WK}, coalesce(nullif(invalid_reason, ''), b_reason) AS reason FROM w")
def first_reason(spark, sf):
    return T.classified(spark, sf).select(*WKEY, C.first_reason("invalid_reason", "b_reason").alias("reason"))


@query(CLS + f" SELECT {WK}, round(CASE WHEN n_days > 0 THEN n_days / 30.0::DOUBLE END, 6) AS months FROM w")
def month_denominator(spark, sf):
    return T.pooled(spark, sf).select(*WKEY, r6(C.month_denominator("n_days"), "months"))


@query(CLS + f" SELECT {WK}, round(rr_C1, 6) AS rr_C1, round(rr_C2, 6) AS rr_C2, round(rr_C3, 6) AS rr_C3, reason_C1, reason_C2, reason_C3 FROM w")
def pooled_adsf_and_ratios(spark, sf):
    return T.pooled(spark, sf).select(*WKEY, r6("rr_C1"), r6("rr_C2"), r6("rr_C3"), "reason_C1", "reason_C2", "reason_C3")


# --- definitions


def _labels(name: str, columns: list[str]) -> None:
    query(CLS + f" SELECT {WK}, {', '.join(columns)} FROM w", name)(lambda spark, sf: T.classified(spark, sf).select(*WKEY, *columns))


def _family(name: str) -> list[str]:
    return [f"label_{name}_{p}" for p in ("any", "C1_or_C2", "excluding_C3", "C1", "C2", "C3", "pattern_category")]


_labels("label_A_windowed", [*_family("A_windowed"), "a_windowed_reason"])
_labels("pattern_category", ["label_A_windowed_pattern_category", "label_B_pattern_category"])
_labels("label_B", [*_family("B"), "b_reason"])
_labels("label_C", [*_family("C"), "c_reason"])
_labels("label_C12", [*_family("C12"), "c12_reason"])
_labels("label_A_exact", [*[f"label_A_exact_{p}" for p in ("any", "C1", "C2", "C3")], "a_exact_reason"])
_labels("label_H1", ["label_H1_any", "label_H1_sensitivity_any"])
_labels("label_H2", ["label_H2_any"])
_labels("label_H3", [f"label_H3_{p}" for p in ("any", "C1", "C2", "C3")])
_labels("label_H4", ["label_H4_any", "label_H4_phase"])
_labels("historical_all", ["label_H1_any", "label_H1_sensitivity_any", "label_H2_any", "label_H3_any", "label_H4_any"])
_labels("classify_window", ["indeterminate_reason", "analyzable_flag", "label_A_windowed_any", "label_B_any", "label_C_any", "label_A_exact_any", "label_H4_any"])


_ROW_SQL = ", ".join(
    f"NULL::{'VARCHAR' if t == 'string' else 'BIGINT' if t == 'long' else t.upper()} AS {c}" if c.startswith("label_D")
    else f"phase_mode = 'luteal_anchored_ovulatory' AS {c}" if c.startswith("luteal") else f"round({c}, 6) AS {c}" if t == "double" else f"{V.OTHER_NAMES.get(c, c)}::BIGINT AS {c}" if t == "long" else c
    for c, t in V.SCHEMA.items()
)


_ROW_SQL += f" FROM (SELECT *, {_ADSF} FROM w)"


@query(CLS + " SELECT " + _ROW_SQL)
def ordered_row(spark, sf):
    """The 62 columns of a window result; definition D, which was not evaluated here, as typed nulls."""
    return V.ordered_row(T.classified(spark, sf)).select(*[r6(c) if t == "double" else c for c, t in V.SCHEMA.items()])


@query(CLS + f" SELECT {WK}, data_reason IS NULL AS enough, data_reason FROM w")
def passes_minimum_data(spark, sf):
    why = X.minimum_data_reason()
    return T.classified(spark, sf).select(*WKEY, why.isNull().alias("enough"), why.alias("data_reason"))


@query(LAB + ", " + Q.WINDOWS + "," + Q.CYCLE_LABELS + " SELECT participant_id, phase_mode, cycle_id, first_day, last_day, c1, c2, c3 FROM cl")
def cycle_labels(spark, sf):
    return T.cycle_labels(spark, sf).select("participant_id", "phase_mode", "cycle_id", "first_day", "last_day", "c1", "c2", "c3")


_ALPHA = "CASE WHEN m > 0 AND v > m THEN greatest(1e-6, least(50.0, (v - m) / (m * m))) ELSE 1.0 END"


@query(DAY + f" SELECT participant_id, round({_ALPHA}, 6) AS alpha FROM (SELECT participant_id, avg(seizure_count) AS m, var_samp(seizure_count) AS v FROM day GROUP BY 1)")
def nb_alpha(spark, sf):
    return T.alphas(spark, sf).select("participant_id", r6("alpha"))


_P1, _P2 = "(1.0::DOUBLE / (1 + events_M))", "(1.0::DOUBLE / (1 + events_O))"


@query(CLS + f""" SELECT {WK}, round(CASE WHEN p1 <= p2 THEN least(1, 2*p1) ELSE greatest(least(1, 2*p2), p1) END, 6) AS p1_adjusted, round(CASE WHEN p1 <= p2 THEN greatest(least(1, 2*p1), p2) ELSE least(1, 2*p2) END, 6) AS p2_adjusted
FROM (SELECT *, {_P1} AS p1, {_P2} AS p2 FROM w)""")
def holm_two(spark, sf):
    a, b = C.holm_two(1.0 / (1 + F.col("events_M")), 1.0 / (1 + F.col("events_O")))
    return T.pooled(spark, sf).select(*WKEY, r6(a, "p1_adjusted"), r6(b, "p2_adjusted"))


@query()
def label_D(spark, sf):
    return T.regression(spark, sf)


@query()
def label_D_window_alpha(spark, sf):
    return T.yearly_regression(spark, sf)


def _tail(z: str) -> str:
    """One-sided p of a Wald statistic, by the five-term approximation of the normal distribution."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"CASE WHEN {z} IS NULL THEN 0.5 WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END"


_E0, _D0 = "(events_F + events_L)", "(days_F + days_L)::DOUBLE"


def _closed(k: int, p: str) -> str:
    ok, e, d = f"events_{p} > 0 AND {_E0} > 0", f"events_{p}", f"days_{p}::DOUBLE"
    return f"""CASE WHEN {ok} THEN ln({e} / {d}) - ln({_E0} / {_D0}) END AS beta_{k},
    CASE WHEN {ok} THEN sqrt((1 + alpha * ({e} / {d})) / {e} + (1 + alpha * ({_E0} / {_D0})) / {_E0}) END AS se_{k}"""


_CLOSED = f""", al AS (SELECT participant_id, {_ALPHA} AS alpha FROM (SELECT participant_id, avg(seizure_count) AS m, var_samp(seizure_count) AS v FROM day GROUP BY 1)),
d1 AS (SELECT *, {_closed(1, 'M')}, {_closed(2, 'O')} FROM w JOIN al USING (participant_id) WHERE phase_mode = 'strict_herzog' AND n_complete_cycles < 4),
d2 AS (SELECT *, CASE WHEN n_days = 0 THEN coalesce(invalid_reason, 'invalid_window') WHEN data_reason IS NOT NULL THEN data_reason WHEN events_M + events_O + events_F + events_L <= 0 THEN 'no_labeled_seizure_data'
    WHEN days_M = 0 OR days_O = 0 THEN 'missing_m_or_o_phase' END AS why, {_tail('(beta_1 / se_1)')} AS p1, {_tail('(beta_2 / se_2)')} AS p2 FROM d1),
d3 AS (SELECT *, CASE WHEN p1 <= p2 THEN least(1, 2*p1) ELSE greatest(least(1, 2*p2), p1) END AS a1, CASE WHEN p1 <= p2 THEN greatest(least(1, 2*p1), p2) ELSE least(1, 2*p2) END AS a2 FROM d2),
d4 AS (SELECT *, CASE WHEN why IS NULL THEN coalesce(exp(beta_1) >= 1.69 AND a1 < 0.05, false) END AS c1, CASE WHEN why IS NULL THEN coalesce(exp(beta_2) >= 1.83 AND a2 < 0.05, false) END AS c2 FROM d3)
SELECT participant_id, window_type, window_value, window_seq, round(alpha, 6) AS d_alpha, CASE WHEN why IS NULL THEN round(beta_1, 6) END AS "d_beta_M", CASE WHEN why IS NULL THEN round(beta_2, 6) END AS "d_beta_O",
    CASE WHEN why IS NULL THEN round(a1, 6) END AS "d_p_adj_M", CASE WHEN why IS NULL THEN round(a2, 6) END AS "d_p_adj_O", c1 AS "label_D_C1", c2 AS "label_D_C2", c1 OR c2 AS "label_D_any",
    CASE WHEN why IS NULL AND (beta_1 IS NULL OR beta_2 IS NULL) THEN 'separated' ELSE why END AS d_reason FROM d4"""


@query(CLS + _CLOSED)
def label_D_closed_form(spark, sf):
    """Definition D of all windows with fewer than four complete cycles."""
    few = T.classified(spark, sf).where(f"phase_mode = 'strict_herzog' and n_complete_cycles < {G.CYCLE_EFFECTS}")
    out = G.label_d(T.labelled(spark, sf), T.windows(spark, sf).join(few.select(*W.KEYS), W.KEYS, "left_semi"), few, T.alphas(spark, sf))
    return out.select(*W.KEYS, r6("d_alpha"), r6("d_beta_M"), r6("d_beta_O"), r6("d_p_adj_M"), r6("d_p_adj_O"), "label_D_C1", "label_D_C2", "label_D_any", "d_reason")


@query()
def label_D_C3(spark, sf):
    return G.label_d_c3(T.labelled(spark, sf), T.cycle_table(spark, sf), T.alphas(spark, sf))


# --- resampling


@query("SELECT s_suppkey AS participant_id, ('0x' || substr(sha256(concat_ws('|', '7', s_suppkey, 'x')), 1, 8))::BIGINT AS hash FROM supplier")
def stable_hash(spark, sf):
    return P.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("participant_id"), C.stable_hash(7, "s_suppkey", F.lit("x")).alias("hash"))


_POOLED = [(k, v) for k, v in S.DEFINITIONS.items()]
#: Studies in SQL: participants in order of hash; a study takes those of smallest hash of (study, rank) where it is over a quarter of
#: the cohort, else the first distinct of 2 n + 20 hashed ranks.
_MC = f"""pp AS (SELECT cohort, phase_mode, participant_id, count(*) AS k, row_number() OVER (PARTITION BY cohort, phase_mode ORDER BY {Q.sha("'rank'", 'participant_id')}, participant_id) - 1 AS rank FROM pool GROUP BY 1, 2, 3),
co AS (SELECT cohort, phase_mode, total, n FROM (SELECT cohort, phase_mode, count(*) AS total FROM pp GROUP BY 1, 2), (SELECT unnest([30, 50, 100]) AS n) WHERE n <= total), st AS (SELECT *, s AS study_id FROM co, generate_series(1, 10000) g(s)),
dr AS (SELECT cohort, phase_mode, n, study_id, {Q.sha("'draw'", 'cohort', 'phase_mode', 'n', 'study_id', 'slot')} % total AS rank, min(slot) AS o FROM st, generate_series(1, 2 * n + 20) g(slot) WHERE n * 4 <= total GROUP BY ALL
    UNION ALL SELECT cohort, phase_mode, n, study_id, rank, {Q.sha("'draw'", 'cohort', 'phase_mode', 'n', 'study_id', 'rank')} FROM st JOIN (SELECT cohort, phase_mode, rank FROM pp) USING (cohort, phase_mode) WHERE n * 4 > total),
ch AS (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY cohort, phase_mode, n, study_id ORDER BY o, rank) <= n),
cx AS (SELECT ch.*, participant_id, 1 + {Q.sha("'window'", 'cohort', 'phase_mode', 'n', 'study_id', 'participant_id')} % k AS seq FROM ch JOIN pp USING (cohort, phase_mode, rank)),
nm AS (SELECT *, row_number() OVER (PARTITION BY cohort, phase_mode, participant_id ORDER BY window_seq) AS seq FROM pool),
wide AS (SELECT cohort, phase_mode, n, study_id, {", ".join(f"{'count(' + v + ')' if 'label_D' not in v else '0::BIGINT'} AS n{i}, {'count_if(' + v + ')::BIGINT' if 'label_D' not in v else '0::BIGINT'} AS p{i}" for i, (_, v) in enumerate(_POOLED))} FROM cx JOIN nm USING (cohort, phase_mode, participant_id, seq) GROUP BY 1, 2, 3, 4),
studies AS (SELECT *, positives::DOUBLE / n_participants AS prevalence_all, positives::DOUBLE / nullif(n_classifiable, 0) AS prevalence_classifiable FROM (""" + " UNION ALL ".join(f"SELECT cohort, phase_mode, n::INT AS n_participants, study_id::INT AS study_id, '{k}' AS definition, n{i} AS n_classifiable, p{i} AS positives FROM wide" for i, (k, _) in enumerate(_POOLED)) + "))"
STUDIES = "WITH " + Q.CLASSIFIED.replace(Q.WINDOWS, Q.SPANS + "," + Q.calendar("win", "3", "study", 5)) + ", pool AS (SELECT * FROM w WHERE phase_mode = 'strict_herzog'), " + _MC
STUDIES_ALL = f"{CLS}, studies AS ({STUDIES} SELECT * FROM studies)"


@query(STUDIES + " SELECT cohort, phase_mode, n_participants, study_id, definition, n_classifiable, positives, round(prevalence_all, 6) AS prevalence_all, round(prevalence_classifiable, 6) AS prevalence_classifiable FROM studies")
def study_mc(spark, sf):
    return T.studies(spark, sf).select("cohort", "phase_mode", "n_participants", "study_id", "definition", "n_classifiable", "positives", r6("prevalence_all"), r6("prevalence_classifiable"))


_BOOT = f"""
bp AS (SELECT participant_id, sum(seizure_count)::BIGINT AS e, count(*) AS d, row_number() OVER (ORDER BY {Q.sha('participant_id')}, participant_id) - 1 AS rank FROM day GROUP BY participant_id),
bt AS (SELECT count(*) AS total FROM bp),
bs AS (SELECT q AS replicate, {Q.sha("'boot'", 'q', 's')} % total AS rank FROM bt, generate_series(1, 100) g(q), generate_series(1, total) h(s))"""


@query(DAY + "," + _BOOT + " SELECT replicate::INT AS replicate, round(sum(e)::DOUBLE / sum(d), 6) AS statistic FROM bs JOIN bp USING (rank) GROUP BY 1")
def bootstrap(spark, sf):
    parts = {"e": F.col("seizure_count"), "d": F.lit(1)}
    return R.bootstrap_by_participant(T.daily(spark, sf), parts, F.col("e") / F.col("d")).select("replicate", r6("statistic"))


@query(DAY + "," + _BOOT.replace("generate_series(1, 100)", "generate_series(1, 1000)") + " SELECT replicate::INT AS replicate, round(sum(e)::DOUBLE / sum(d), 6) AS statistic FROM bs JOIN bp USING (rank) GROUP BY 1")
def bootstrap_1000(spark, sf):
    parts = {"e": F.col("seizure_count"), "d": F.lit(1)}
    return R.bootstrap_by_participant(T.daily(spark, sf), parts, F.col("e") / F.col("d"), n=1000).select("replicate", r6("statistic"))


@query(_PART + f""", s AS (SELECT participant_id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY {Q.sha('participant_id')}, participant_id) AS r FROM people)
SELECT participant_id, cohort FROM s WHERE r <= CASE cohort WHEN 'healthy_ovulatory' THEN 4 ELSE 3 END""")
def quota_sample(spark, sf):
    return R.quota_sample(T.participants(spark, sf), "cohort", "participant_id", 7, ["healthy_ovulatory", "population"]).select("participant_id", "cohort")


# --- summaries

SQL_DEFS = {k: v for k, v in S.DEFINITIONS.items() if "label_D" not in v}
SQL_REASONS = {k: v for k, v in S.REASONS.items() if k in SQL_DEFS}
_KIND = "cohort, phase_mode, window_type, window_value"
_STRATA = _PART.replace("WITH ", "", 1).removeprefix(Q.DAYS).lstrip(", ")
SUM = CLS + ", " + _STRATA
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT participant_id, {_KIND}, '{k}' AS definition, {v} AS label FROM w" for k, v in SQL_DEFS.items()) + ")"
_SUB = """sub AS (SELECT w.*, unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN seizure_days_per_month >= 1 THEN 'ge_1_seizure_day_per_month' END, CASE WHEN seizures_per_month >= 2 THEN 'ge_2_seizures_per_month' END,
CASE WHEN strict_herzog_eligible_flag THEN 'strict_23_35_day_cycles_only' END, CASE WHEN label_A_windowed_any IS NOT NULL AND label_B_any IS NOT NULL AND label_C_any IS NOT NULL THEN 'common_classifiable_subset' END,
CASE WHEN seizure_days_total <= 3 THEN 'window_seizure_days_0_to_3' END, CASE WHEN seizure_days_total BETWEEN 4 AND 7 THEN 'window_seizure_days_4_to_7' END,
CASE WHEN seizure_days_total BETWEEN 8 AND 15 THEN 'window_seizure_days_8_to_15' END, CASE WHEN seizure_days_total >= 16 THEN 'window_seizure_days_ge_16' END, 'seizure_frequency:' || seizure_frequency_stratum, 'cycle_regularity:' || cycle_regularity_stratum], lambda x: x IS NOT NULL)) AS subset
FROM w JOIN (SELECT participant_id, seizure_frequency_stratum, cycle_regularity_stratum FROM people) USING (participant_id))"""
_LONGSUB = "longsub AS (" + " UNION ALL ".join(f"SELECT subset, {_KIND}, '{k}' AS definition, {v} AS label FROM sub" for k, v in SQL_DEFS.items()) + ")"
_CATS = [(k, v) for k, v in S.CATEGORY_COLUMNS.items() if "label_D" not in v]
_CAT = "cat AS (" + " UNION ALL ".join(f"SELECT {_KIND}, '{k}' AS definition, {v} AS category FROM w" for k, v in _CATS) + f"), names AS (SELECT unnest({S.CATEGORIES!r}) AS name)"
_WHY = "why AS (" + " UNION ALL ".join(f"SELECT {_KIND}, '{k}' AS definition, {SQL_DEFS[k]} AS label, {v} AS reason FROM w" for k, v in SQL_REASONS.items()) + ")"
_W = "(p + 1.959963984540054^2 / (2*n)) / (1 + 1.959963984540054^2 / n)"
_HALF = "1.959963984540054 * sqrt((p * (1 - p) + 1.959963984540054^2 / (4*n)) / n) / (1 + 1.959963984540054^2 / n)"
_BOUNDS = f"round(CASE WHEN n > 0 THEN greatest(0, {_W} - {_HALF}) END, 6) AS wilson95_low, round(CASE WHEN n > 0 THEN least(1, {_W} + {_HALF}) END, 6) AS wilson95_high"
_LABELLED = "count(label) AS n_classifiable, count_if(label)::BIGINT AS positives"


def _np(inner: str) -> str:
    """Rows with the denominator as ``n`` (null for 0) and the rate as ``p``."""
    return f"(SELECT *, nullif(n_classifiable, 0)::DOUBLE AS n, positives::DOUBLE / nullif(n_classifiable, 0) AS p FROM ({inner}))"


def _rates_sql(inner: str, keys: str, attempted: str = "n_windows", interval: bool = True) -> str:
    """Counts, rates, bounds and marks over rows with ``keys``, n_windows, n_classifiable and positives."""
    return f"""SELECT {keys}, n_windows, {'' if attempted == 'n_windows' else attempted + ', '}n_classifiable, positives, round(p, 6) AS false_positive_rate, {_BOUNDS + ',' if interval else ''} round(1 - n_classifiable::DOUBLE / {attempted}, 6) AS indeterminate_rate,
    round(positives::DOUBLE / {attempted}, 6) AS positive_rate_all_attempted, n_classifiable > 0 AND n_classifiable < 1000 AS unstable_denominator, CASE WHEN n_classifiable > 0 AND n_classifiable < 1000 THEN 'unstable; not interpreted' ELSE '' END AS interpretation_note FROM {_np(inner)}"""


def _rates(df: DataFrame, *keys: str) -> DataFrame:
    """All columns of a summary: keys and counts as they are, rates rounded."""
    rates = ["false_positive_rate", "wilson95_low", "wilson95_high", "indeterminate_rate", "positive_rate_all_attempted", "p_prevalence_ge_39_1", "p_prevalence_ge_44_2"]
    return df.select(*keys, *[r6(c) if c in rates else c for c in df.columns if c not in keys])


_SUMKEY = f"subset, {_KIND}, definition"
_WINDOWS_SQL = f"SELECT 'window_false_positive' AS table_type, definition LIKE 'H%' AS assumption_based_historical, * FROM ({_rates_sql(f'SELECT {_SUMKEY}, count(*) AS n_windows, {_LABELLED} FROM longsub GROUP BY ALL', _SUMKEY)})"
_ANY = f"SELECT {_KIND}, definition, sum(k)::BIGINT AS n_windows, count(*) AS n_participants, {_LABELLED} FROM (SELECT {_KIND}, definition, participant_id, count(*) AS k, bool_or(label) AS label FROM long GROUP BY ALL) GROUP BY ALL"
_PARTICIPANTS_SQL = f"SELECT 'participant_false_positive' AS table_type, 'any_window_per_participant' AS subset, definition LIKE 'H%' AS assumption_based_historical, * FROM ({_rates_sql(_ANY, f'{_KIND}, definition', 'n_participants')})"
_PATTERN = f"SELECT {_KIND}, definition, name AS pattern_category, count(*) AS n_windows, count(category) AS n_classifiable, count_if(category = name)::BIGINT AS positives FROM cat, names GROUP BY ALL"
_PATTERNS_SQL = f"SELECT 'pattern_decomposition' AS table_type, 'mutually_exclusive_patterns' AS subset, * FROM ({_rates_sql(_PATTERN, f'{_KIND}, definition, pattern_category', interval=False)})"
_REASONS_SQL = f"""SELECT 'indeterminate_reasons' AS table_type, 'all' AS subset, {_KIND}, definition, reason AS indeterminate_reason, n_windows, n_indeterminate, k AS positives, round(k::DOUBLE / n_windows, 6) AS positive_rate_all_attempted FROM (
SELECT {_KIND}, definition, coalesce(reason, 'unknown') AS reason, count(*) AS k FROM why WHERE label IS NULL GROUP BY ALL) JOIN (SELECT {_KIND}, definition, count(*) AS n_windows, count_if(label IS NULL)::BIGINT AS n_indeterminate FROM why GROUP BY ALL) USING ({_KIND}, definition)"""
ALL_SUM = SUM + ", " + ", ".join((_LONG, _SUB, _LONGSUB, _CAT, _WHY))


@query(SUM + ", " + _LONG + f" SELECT {_KIND}, definition, n_classifiable, positives, {_BOUNDS} FROM {_np(f'SELECT {_KIND}, definition, {_LABELLED} FROM long GROUP BY ALL')}")
def wilson_ci(spark, sf):
    out = S.summarize_windows(T.classified(spark, sf), strata=False).where("subset = 'all'")
    return out.select(*S.GROUP, "definition", "n_classifiable", "positives", r6("wilson95_low"), r6("wilson95_high"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN true WHEN quality = 0 THEN false END AS label FROM labels")
def tri_bool(spark, sf):
    return P.table(spark, sf, "labels").select("doc_id", C.tri_bool(F.col("quality").cast("string")).alias("label"))


@query(SUM + ", " + _SUB + f" SELECT {WK}, subset FROM sub WHERE subset NOT LIKE '%:%'")
def subset_mask(spark, sf):
    df = T.classified(spark, sf)
    return df.select(*WKEY, F.explode(S.subset_names(df.columns)).alias("subset"))


@query(SUM + " SELECT w.participant_id, phase_mode, window_type, window_value, unnest(['seizure_frequency:' || seizure_frequency_stratum, 'cycle_regularity:' || cycle_regularity_stratum]) AS subset FROM w JOIN people USING (participant_id)")
def stratum_subsets(spark, sf):
    return T.classified(spark, sf).select(*WKEY, F.explode(S.stratum_names()).alias("subset"))


@query(ALL_SUM + " " + _WINDOWS_SQL)
def summarize_windows(spark, sf):
    return _rates(S.summarize_windows(T.classified(spark, sf)))


@query(ALL_SUM + " " + _PARTICIPANTS_SQL)
def summarize_participants(spark, sf):
    return _rates(S.summarize_participants(T.classified(spark, sf)))


@query(ALL_SUM + " " + _PATTERNS_SQL)
def summarize_patterns(spark, sf):
    return _rates(S.summarize_patterns(T.classified(spark, sf)))


@query(ALL_SUM + " " + _REASONS_SQL)
def summarize_reasons(spark, sf):
    return _rates(S.summarize_reasons(T.classified(spark, sf)))


_STUDY_STATS = """SELECT 'study_level_3month' AS table_type, subset, cohort, 'study_mc_calendar' AS window_type, '3' AS window_value, definition, phase_mode, n_participants, definition LIKE 'H%' AS assumption_based_historical, count(v) AS n_windows, count(v) AS n_classifiable,
round(avg(v), 6) AS false_positive_rate, round(avg(v), 6) AS positive_rate_all_attempted, round(quantile_cont(v, 0.025), 6) AS wilson95_low, round(quantile_cont(v, 0.975), 6) AS wilson95_high, false AS unstable_denominator, '' AS interpretation_note, round(avg((v >= 0.391)::INT), 6) AS p_prevalence_ge_39_1, round(avg((v >= 0.442)::INT), 6) AS p_prevalence_ge_44_2
FROM (SELECT *, 'apparent_prevalence_all' AS subset, prevalence_all AS v FROM studies UNION ALL SELECT *, 'apparent_prevalence_classifiable', prevalence_classifiable FROM studies) GROUP BY ALL"""


@query(STUDIES + " " + _STUDY_STATS)
def summarize_studies(spark, sf):
    return _rates(S.summarize_studies(T.studies(spark, sf)))


_HEAD = ", ".join(f"'{d}'" for d in S.HEADLINE)


@query(ALL_SUM + f" SELECT cohort, definition, n_classifiable, false_positive_rate, wilson95_low, wilson95_high FROM ({_WINDOWS_SQL}) WHERE subset = 'all' AND phase_mode = 'strict_herzog' AND window_type = 'full' AND definition IN ({_HEAD})")
def headline(spark, sf):
    """Without definition D, which SQL cannot fit."""
    out = S.headline(S.summarize_windows(T.classified(spark, sf), strata=False))
    return out.select("cohort", "definition", "n_classifiable", *[r6(c) for c in out.columns[3:]])


@query()
def headline_with_d(spark, sf):
    return S.headline(S.summarize_windows(T.results(spark, sf), strata=False))


def _unified(df: DataFrame, studies: DataFrame) -> DataFrame:
    return S.unified_summary(S.summarize_windows(df), S.summarize_participants(df), S.summarize_patterns(df), S.summarize_reasons(df), S.summarize_studies(studies))


@query(STUDIES_ALL + f", {_STRATA}, " + ", ".join((_LONG, _SUB, _LONGSUB, _CAT, _WHY)) + " " + " UNION ALL BY NAME ".join((_WINDOWS_SQL, _PARTICIPANTS_SQL, _PATTERNS_SQL, _REASONS_SQL, _STUDY_STATS)))
def unified_summary(spark, sf):
    """Without definition D, which SQL cannot fit; ``unified_summary_with_d`` has it."""
    return _rates(_unified(T.classified(spark, sf), T.studies(spark, sf)))


@query()
def unified_summary_with_d(spark, sf):
    return _unified(T.results(spark, sf), T.studies(spark, sf))


_MEANS = ["mean_cycle_length", "sd_cycle_length", "ovulatory_fraction", "seizure_days_per_month", "seizures_per_month"]


@query(_PART + " SELECT cohort, count(DISTINCT participant_id) AS participants, round(avg(age), 6) AS age_mean, round(stddev_samp(age), 6) AS age_sd, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _MEANS) + " FROM people GROUP BY 1")
def cohort_table(spark, sf):
    out = S.cohort_table(T.participants(spark, sf))
    return out.select("cohort", "participants", *[r6(c) for c in out.columns[2:]])


_VIEW = ["cohort", "phase_mode", "window", "definition", "subset", "stratum_type", "stratum", "pattern_category", "n_participants", "n_windows", "n_classifiable", "positives", "false_positive_rate", "positive_rate_all_attempted", "indeterminate_rate", "wilson95_low", "wilson95_high", "p_prevalence_ge_39_1", "p_prevalence_ge_44_2", "rate_ci", "assumption_based_historical"]
_A2 = "'A_windowed_any', 'A_windowed_C1_or_C2'"
_VIEWS_SQL = {
    "primary": (f"table_type = 'window_false_positive' AND phase_mode = 'strict_herzog' AND subset = 'all' AND window_type = 'full' AND definition IN ({_HEAD})", "cohort, definition, n_windows, n_classifiable, positives, rate_ci, indeterminate_rate"),
    "by_window": (f"table_type = 'window_false_positive' AND phase_mode = 'strict_herzog' AND subset = 'all' AND definition IN ('A_exact_any', {_A2}, 'B_minimum_data_C1_or_C2', 'C_reproducibility_C1_or_C2', 'D_nb_regression_C1_or_C2')", "cohort, win_text AS window, definition, n_classifiable, positives, false_positive_rate, indeterminate_rate"),
    "phase_mode": (f"table_type = 'window_false_positive' AND subset = 'all' AND (window_type = 'full' OR (window_type = 'calendar' AND window_value = '3')) AND definition IN ({_A2}, 'A_windowed_C3_only')", "cohort, phase_mode, win_text AS window, definition, n_classifiable, positives, rate_ci, indeterminate_rate"),
    "study": ("table_type = 'study_level_3month' AND phase_mode = 'strict_herzog' AND definition IN ('A_windowed_any', 'B_minimum_data_C1_or_C2', 'C_reproducibility_C1_or_C2', 'D_nb_regression_C1_or_C2')", "cohort, definition, n_participants, subset, n_windows, false_positive_rate, wilson95_low, wilson95_high, p_prevalence_ge_39_1, p_prevalence_ge_44_2"),
    "subsets": (f"table_type = 'window_false_positive' AND phase_mode = 'strict_herzog' AND window_type = 'full' AND subset IN ('ge_1_seizure_day_per_month', 'ge_2_seizures_per_month', 'strict_23_35_day_cycles_only', 'common_classifiable_subset') AND definition IN ({_A2}, 'B_minimum_data_C1_or_C2', 'C_reproducibility_C1_or_C2', 'D_nb_regression_C1_or_C2')", "cohort, subset, definition, n_classifiable, positives, rate_ci, indeterminate_rate"),
    "patterns": ("table_type = 'pattern_decomposition' AND phase_mode = 'strict_herzog' AND window_type = 'full' AND definition IN ('A_windowed', 'B_minimum_data', 'D_nb_regression')", "cohort, definition, pattern_category, n_classifiable, positives, false_positive_rate, positive_rate_all_attempted, indeterminate_rate"),
    "alpha": ("table_type = 'window_false_positive' AND phase_mode = 'strict_herzog' AND subset = 'all' AND window_type = 'full' AND definition IN ('D_nb_regression_C1_or_C2', 'D_nb_regression_window_alpha_C1_or_C2')", "cohort, win_text AS window, definition, n_classifiable, positives, rate_ci, indeterminate_rate"),
    "strata": (f"table_type = 'window_false_positive' AND phase_mode = 'strict_herzog' AND definition IN ({_A2}, 'B_minimum_data_C1_or_C2', 'D_nb_regression_C1_or_C2') AND (subset LIKE 'seizure_frequency:%' OR subset LIKE 'cycle_regularity:%' OR subset LIKE 'window_seizure_days_%')", "cohort, CASE WHEN subset LIKE 'window%' THEN 'window seizure days' ELSE replace(split_part(subset, ':', 1), '_', ' ') END AS stratum_type, CASE WHEN subset LIKE '%:%' THEN split_part(subset, ':', 2) ELSE replace(subset[21:], '_', ' ') END AS stratum, definition, n_classifiable, positives, false_positive_rate, indeterminate_rate"),
    "historical": ("table_type = 'window_false_positive' AND phase_mode = 'strict_herzog' AND subset = 'all' AND definition LIKE 'H%' AND (window_type = 'full' OR (window_type = 'calendar' AND window_value = '3'))", "cohort, win_text AS window, definition, n_classifiable, positives, rate_ci, indeterminate_rate, assumption_based_historical"),
}
_WIN_TEXT = "CASE WHEN window_type = 'full' THEN '36 months' WHEN window_type = 'calendar' THEN window_value || CASE WHEN window_value = '1' THEN ' month' ELSE ' months' END WHEN window_type = 'cycle' THEN window_value || CASE WHEN window_value = '1' THEN ' cycle' ELSE ' cycles' END ELSE window_type || ' ' || window_value END"
_CI = "CASE WHEN false_positive_rate IS NULL THEN 'NA' ELSE printf('%.1f', round_even(round(false_positive_rate * 100, 6), 1)) || '% (' || printf('%.1f', round_even(round(wilson95_low * 100, 6), 1)) || ', ' || printf('%.1f', round_even(round(wilson95_high * 100, 6), 1)) || ')' END"


@query(STUDIES_ALL + f", {_STRATA}, " + ", ".join((_LONG, _SUB, _LONGSUB, _CAT, _WHY)) + f", u AS ({' UNION ALL BY NAME '.join((_WINDOWS_SQL, _PARTICIPANTS_SQL, _PATTERNS_SQL, _STUDY_STATS))}), v AS (SELECT *, {_WIN_TEXT} AS win_text, {_CI} AS rate_ci FROM u) "
       + " UNION ALL BY NAME ".join(f"SELECT '{k}' AS slice, {c} FROM v WHERE {w}" for k, (w, c) in _VIEWS_SQL.items()))
def report_slices(spark, sf):
    """The nine views in one table; those on definition D alone are empty here."""
    views = S.report_slices(T.written(spark, sf, "unified", unified_summary))
    out = None
    for k, v in views.items():
        part = v.select(F.lit(k).alias("slice"), *v.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select("slice", *_VIEW)


@query(WIN + f" SELECT DISTINCT window_type, window_value, {_WIN_TEXT} AS label, CASE WHEN window_type = 'calendar' THEN window_value::INT WHEN window_type = 'full' THEN 1000 ELSE 2000 + TRY_CAST(window_value AS INT) END AS sort_key FROM win")
def window_label(spark, sf):
    return T.windows(spark, sf).select("window_type", "window_value").distinct().select("window_type", "window_value", C.window_label("window_type", "window_value").alias("label"), C.window_order("window_type", "window_value").alias("sort_key"))


@query(ALL_SUM + f" SELECT {_SUMKEY}, {_CI} AS rate_ci FROM ({_WINDOWS_SQL})")
def rate_ci_text(spark, sf):
    out = summarize_windows(spark, sf)
    return out.select("subset", *S.GROUP, "definition", C.rate_ci_text("false_positive_rate", "wilson95_low", "wilson95_high").alias("rate_ci"))


# --- sensitivity and diagnostics

_PAT3 = "pat AS (SELECT cohort, phase_mode, window_type, window_value, 'C1' AS pattern, rr_C1 AS r, true AS a, label_A_windowed_C1 AS l FROM w UNION ALL SELECT cohort, phase_mode, window_type, window_value, 'C2', rr_C2, true, label_A_windowed_C2 FROM w UNION ALL SELECT cohort, phase_mode, window_type, window_value, 'C3', rr_C3, c3_applicable_flag, label_A_windowed_C3 FROM w)"


@query(CLS + f""", {_PAT3} SELECT *, round(n_at_least * 100.0::DOUBLE / nullif(n_defined, 0), 6) AS percent FROM (
SELECT pattern, cohort, t AS threshold, count(*) AS n_attempted, count_if(a)::BIGINT AS n_applicable, count_if(a AND r IS NOT NULL)::BIGINT AS n_defined, count_if(a AND r IS NULL)::BIGINT AS n_undefined, count_if(a AND r >= t)::BIGINT AS n_at_least
FROM pat, (SELECT unnest([1.0, 1.25, 1.5, 1.62, 1.69, 1.83, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0])::DOUBLE AS t) WHERE phase_mode = 'strict_herzog' AND window_type = 'cycle' AND window_value = '3' GROUP BY ALL)""")
def cumulative_ratio(spark, sf):
    out = Z.cumulative_ratio(Z.assert_unique_key(T.classified(spark, sf), *WKEY))
    return Z.assert_monotone(out, ["pattern", "cohort"], "threshold", "n_at_least").withColumn("percent", r6("percent"))


@query(CLS + f""", {_PAT3}, rule AS (SELECT * FROM (VALUES ('C1', 1.69), ('C2', 1.83), ('C3', 1.62)) v(pattern, t))
SELECT pattern, cohort, count_if(a AND r >= t::DOUBLE)::BIGINT AS n_at_least FROM pat JOIN rule USING (pattern) WHERE phase_mode = 'strict_herzog' AND window_type = 'cycle' AND window_value = '3' GROUP BY ALL""")
def assert_reconciled(spark, sf):
    """Labels against ratios at the labels' own thresholds; an error if they differ."""
    rows = T.classified(spark, sf)
    ratios = Z.cumulative_ratio(rows, tuple(sorted(C.THRESHOLDS.values())))
    own = ratios.where(F.col("threshold") == F.create_map(*[F.lit(x) for kv in C.THRESHOLDS.items() for x in kv])[F.col("pattern")]).select("pattern", "cohort", "n_at_least")
    marks = "stack(3, " + ", ".join(f"'{p}', label_A_windowed_{p}" for p in C.THRESHOLDS) + ") as (pattern, label)"
    labels = rows.where("phase_mode = 'strict_herzog' and window_type = 'cycle' and window_value = '3'").select("cohort", F.expr(marks))
    return Z.assert_reconciled(own, labels.groupBy("pattern", "cohort").agg(F.count_if(F.coalesce("label", F.lit(False))).alias("n_at_least")), ["pattern", "cohort"], "n_at_least")


@query(CLS + f" SELECT {WK} FROM w")
def assert_unique_key(spark, sf):
    return Z.assert_unique_key(T.classified(spark, sf).select(*WKEY), *WKEY)


@query(CLS + f""", {_PAT3}, c AS (SELECT pattern, cohort, t AS threshold, count_if(a AND r >= t)::BIGINT AS n FROM pat, (SELECT unnest([1.0, 1.25, 1.5, 1.62, 1.69, 1.83, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0])::DOUBLE AS t) WHERE phase_mode = 'strict_herzog' AND window_type = 'cycle' AND window_value = '3' GROUP BY ALL)
SELECT pattern, cohort, threshold, n - lag(n) OVER (PARTITION BY pattern, cohort ORDER BY threshold) AS step FROM c""")
def assert_monotone(spark, sf):
    """Steps of the counts along the thresholds; an error if one rises."""
    out = Z.assert_monotone(Z.cumulative_ratio(T.classified(spark, sf)), ["pattern", "cohort"], "threshold", "n_at_least")
    return out.select("pattern", "cohort", "threshold", (F.col("n_at_least") - F.lag("n_at_least").over(Window.partitionBy("pattern", "cohort").orderBy("threshold"))).alias("step"))


def _sensitivity_sql(keys: str, counts: str, inner: str, rate: str = "false_positive_rate_classifiable") -> str:
    return f"SELECT {keys}, {counts}, n_classifiable, positives, round(p, 6) AS {rate}, {_BOUNDS}, round(positives::DOUBLE / n_attempted, 6) AS positive_rate_all_attempted FROM {_np(inner)}"


def _sensitivity(df: DataFrame) -> DataFrame:
    rates = ["false_positive_rate_classifiable", "wilson95_low", "wilson95_high", "positive_rate_all_attempted", "rate", "lower", "upper"]
    return df.select(*[r6(c) if c in rates else c for c in df.columns])


_C3 = "c3w AS (SELECT window_type, window_value, coalesce(c3_applicable_flag, false) AS a, CASE WHEN c3_applicable_flag THEN label_A_windowed_C3 END AS l, a_windowed_reason AS r FROM w WHERE cohort = 'population' AND phase_mode = 'strict_herzog')"


@query(CLS + f""", {_C3}, c3r AS (SELECT window_type, window_value, '{{' || string_agg('"' || r || '":' || k, ',' ORDER BY r) || '}}' AS j FROM (SELECT window_type, window_value, coalesce(r, 'unspecified') AS r, count(*) AS k FROM c3w WHERE a AND l IS NULL GROUP BY ALL) GROUP BY ALL)
SELECT s.*, 'population' AS cohort, coalesce(j, '{{}}') AS indeterminate_reasons FROM ({_sensitivity_sql('window_type, window_value', 'n_attempted, n_applicable', 'SELECT window_type, window_value, count(*) AS n_attempted, count_if(a)::BIGINT AS n_applicable, count(l) AS n_classifiable, count_if(l)::BIGINT AS positives FROM c3w GROUP BY ALL')}) s LEFT JOIN c3r USING (window_type, window_value)""")
def c3_window_sensitivity(spark, sf):
    return _sensitivity(Z.c3_window_sensitivity(T.classified(spark, sf)))


_MIN = """SELECT t AS min_seizure_days, cohort, window_type, window_value, count(*) AS n_attempted, count_if(ok)::BIGINT AS n_meeting_minimum, count(CASE WHEN ok THEN label_A_windowed_C1_or_C2 END) AS n_classifiable, count_if(ok AND label_A_windowed_C1_or_C2)::BIGINT AS positives
FROM (SELECT *, coalesce(seizure_days_total >= t, false) AND ((window_type = 'calendar' AND TRY_CAST(window_value AS INT) >= 4) OR (window_type = 'cycle' AND TRY_CAST(window_value AS INT) >= 6) OR window_type = 'full') AS ok FROM w, (SELECT unnest([2, 3, 4, 6]) AS t) WHERE phase_mode = 'strict_herzog') GROUP BY ALL"""


@query(CLS + " " + _sensitivity_sql("min_seizure_days, cohort, window_type, window_value", "n_attempted, n_meeting_minimum", _MIN))
def minimum_data_sensitivity(spark, sf):
    return _sensitivity(Z.minimum_data_sensitivity(T.classified(spark, sf)))


@query()
def c3_nb_summary(spark, sf):
    return _sensitivity(Z.c3_nb_summary(label_D_C3(spark, sf), T.classified(spark, sf)))


def _people(spark, sf) -> DataFrame:
    """Participants with modifiers derived from their keys and ages."""
    people = T.participants(spark, sf)
    return people.withColumn("pcos", F.col("participant_id") % 7 == 0).withColumn("peri_menarche", F.col("age") < 16).withColumn("perimenopause", F.col("age") >= 45)


_MODS = "mods AS (SELECT *, participant_id % 7 = 0 AS pcos, age < 16 AS peri_menarche, age >= 45 AS perimenopause FROM people)"
_DFT = """ft AS (SELECT participant_id, k, round(2 * sqrt(sum(c * cos(x))^2 + sum(c * sin(x))^2) / n, 9) AS amp, n FROM (SELECT d.participant_id, k, d.seizure_count AS c, k * (d.calendar_day_index - 1) * 6.283185307179586::DOUBLE / n AS x, n FROM day d JOIN (SELECT participant_id, count(*) AS n FROM day GROUP BY 1) USING (participant_id), generate_series(1, 540) g(k)
WHERE d.seizure_count > 0 AND k >= ceil(n / 365.0) AND k <= n // 2) GROUP BY participant_id, k, n),
dom AS (SELECT participant_id, n::DOUBLE / k AS period_days, amp AS amplitude FROM ft QUALIFY row_number() OVER (PARTITION BY participant_id ORDER BY amp DESC, k) = 1)"""
_AUDIT_RAW = """ax AS (SELECT *, lead(seizure_day) OVER (PARTITION BY participant_id ORDER BY calendar_day_index) AS nd FROM day),
as0 AS (SELECT participant_id, var_samp(seizure_count) / nullif(avg(seizure_count), 0) AS daily_count_overdispersion, avg(CASE WHEN seizure_day = 1 THEN nd END) - avg(seizure_day) AS next_day_cluster_propensity FROM ax GROUP BY 1),
acy AS (SELECT participant_id, cycle_id, max(ilp_flag::INT) AS ilp FROM day GROUP BY 1, 2), acs AS (SELECT participant_id, avg(ilp) AS audit_ilp_fraction FROM acy GROUP BY 1),
au AS (SELECT as0.*, audit_ilp_fraction FROM as0 JOIN acs USING (participant_id))"""
_OUT = {o: o.removeprefix("label_A_windowed_").lower() for o in Z.OUTCOMES}


@query(SUM + f", {_MODS}, {_DFT}, pp AS (SELECT mods.*, dom.period_days AS dominant_seizure_cycle_days, x.* EXCLUDE (participant_id) FROM mods LEFT JOIN dom USING (participant_id) JOIN (SELECT participant_id, {', '.join(Z.OUTCOMES)} FROM w WHERE phase_mode = 'strict_herzog' AND window_type = 'full') x ON x.participant_id = mods.participant_id), f AS ("
       + " UNION ALL ".join(f"SELECT cohort, '{f}' AS feature, round({f}::DOUBLE, 9) AS value, {', '.join(Z.OUTCOMES)} FROM pp WHERE {f} IS NOT NULL" for f in Z.CONTINUOUS)
       + f"""), e AS (SELECT cohort, feature, list_sort(list_distinct([round(quantile_cont(value, 0.0), 9), round(quantile_cont(value, 0.2), 9), round(quantile_cont(value, 0.4), 9), round(quantile_cont(value, 0.6), 9), round(quantile_cont(value, 0.8), 9), round(quantile_cont(value, 1.0), 9)])) AS q FROM f GROUP BY 1, 2 HAVING count(*) >= 10 AND count(DISTINCT value) >= 2),
g AS (SELECT cohort, feature, bin::VARCHAR AS level, q[bin] AS lower, q[bin + 1] AS upper, {', '.join(Z.OUTCOMES)} FROM (SELECT f.*, q, greatest(1, len(list_filter(q, lambda x: x < value))) AS bin FROM f JOIN e USING (cohort, feature)) UNION ALL """
       + " UNION ALL ".join(f"SELECT cohort, '{b}', {b}::VARCHAR, NULL, NULL, {', '.join(Z.OUTCOMES)} FROM pp" for b in Z.BINARY) + "), o AS ("
       + " UNION ALL ".join(f"SELECT cohort, feature, level, lower, upper, '{o}' AS outcome, count(*) AS n_group, count({o}) AS n_classifiable, count_if({o})::BIGINT AS positives FROM g GROUP BY ALL" for o in Z.OUTCOMES)
       + f") SELECT cohort, feature, level, round(lower, 6) AS lower, round(upper, 6) AS upper, outcome, n_group, n_classifiable, positives, round(p, 6) AS rate, {_BOUNDS} FROM {_np('SELECT * FROM o')} WHERE outcome <> 'label_A_windowed_C3' OR cohort = 'population'")
def driver_analysis(spark, sf):
    full = T.classified(spark, sf).where("phase_mode = 'strict_herzog' and window_type = 'full'").select("participant_id", *Z.OUTCOMES)
    period = Z.dominant_period(T.daily(spark, sf)).select("participant_id", F.col("period_days").alias("dominant_seizure_cycle_days"))
    people = _people(spark, sf).join(Z.assert_unique_key(full, "participant_id"), "participant_id").join(period, "participant_id", "left")
    return _sensitivity(Z.driver_analysis(people))


@query(DAY + f""", {_DFT}, x AS (SELECT *, lead(seizure_day) OVER (PARTITION BY participant_id ORDER BY calendar_day_index) AS nd FROM day),
s AS (SELECT participant_id, max(cohort) AS cohort, round(var_samp(seizure_count) / nullif(avg(seizure_count), 0), 6) AS daily_count_overdispersion, round(avg(CASE WHEN seizure_day = 1 THEN nd END) - avg(seizure_day), 6) AS next_day_cluster_propensity FROM x GROUP BY 1),
cy AS (SELECT participant_id, cycle_id, arg_min(cycle_length, calendar_day_index) AS len, arg_min(ovulatory_flag, calendar_day_index)::INT AS ov, max(ilp_flag::INT) AS ilp FROM day GROUP BY 1, 2),
cs AS (SELECT participant_id, round(avg(len), 6) AS audit_mean_cycle_length, round(stddev_samp(len), 6) AS audit_sd_cycle_length, round(avg(ov), 6) AS audit_ovulatory_fraction, round(avg(ilp), 6) AS audit_ilp_fraction, count(*) AS n_audit_cycles FROM cy GROUP BY 1)
SELECT s.*, round(period_days, 6) AS spectral_dominant_period_days, round(amplitude, 6) AS spectral_amplitude_seizures_per_day, cs.* EXCLUDE (participant_id) FROM s JOIN cs USING (participant_id) LEFT JOIN dom USING (participant_id)""")
def audit_features(spark, sf):
    out = Z.audit_features(T.daily(spark, sf))
    return out.select(*[c if c in ("participant_id", "cohort", "n_audit_cycles") else r6(c) for c in out.columns])


@query(DAY + f", {_DFT} SELECT participant_id, round(period_days, 6) AS period_days, round(amplitude, 6) AS amplitude FROM dom")
def dominant_period(spark, sf):
    return Z.dominant_period(T.daily(spark, sf)).select("participant_id", r6("period_days"), r6("amplitude"))


@query(CLS + """, pv AS (SELECT 'C1' AS pattern, cohort, phase_mode, window_type, window_value, 1.69::DOUBLE AS threshold, rr_C1 AS r, true AS u FROM w UNION ALL SELECT 'C2', cohort, phase_mode, window_type, window_value, 1.83, rr_C2, true FROM w
UNION ALL SELECT 'C3', cohort, phase_mode, window_type, window_value, 1.62, rr_C3, coalesce(cohort = 'population' AND c3_applicable_flag, false) FROM w)
SELECT *, round(n_infinite * 100.0::DOUBLE / nullif(n_at_least, 0), 6) AS infinite_percent FROM (SELECT phase_mode, window_type, window_value, pattern, cohort, threshold, count_if(u AND r IS NOT NULL AND NOT isinf(r))::BIGINT AS n_finite, count_if(u AND isinf(r))::BIGINT AS n_infinite,
count_if(u AND r IS NULL)::BIGINT AS n_undefined, count_if(u AND r >= threshold)::BIGINT AS n_at_least, count_if(NOT u)::BIGINT AS n_not_applicable FROM pv GROUP BY ALL)""")
def ratio_audit(spark, sf):
    """Of all windows; those of strict three-cycle windows are the published audit."""
    return Z.ratio_audit(T.classified(spark, sf), every=True).withColumn("infinite_percent", r6("infinite_percent"))


@query(DAY + " SELECT cohort, cycle_day, count(*) AS days, sum(seizure_count)::BIGINT AS events, round(sum(seizure_count)::DOUBLE / count(*), 6) AS rate, round(sqrt(greatest(sum(seizure_count), 1)) / count(*), 6) AS error FROM day WHERE cycle_day BETWEEN 1 AND 35 GROUP BY 1, 2")
def cycle_day_profile(spark, sf):
    return Z.cycle_day_profile(T.daily(spark, sf)).select("cohort", "cycle_day", "days", n("events"), r6("rate"), r6("error"))


@query(STUDIES + """ SELECT cohort, n_participants, bin, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY cohort, n_participants), 6) AS share FROM (
SELECT cohort, n_participants, least(floor(prevalence_all / (1.0::DOUBLE / 30)), 29)::INT AS bin, count(*) AS n FROM studies WHERE definition = 'A_windowed_any' AND phase_mode = 'strict_herzog' GROUP BY ALL)""")
def prevalence_histogram(spark, sf):
    return Z.prevalence_histogram(T.studies(spark, sf)).withColumn("share", r6("share"))


def _features(spark, sf) -> DataFrame:
    """Participants with their audit features; the dominant period of the counts stands for the period they were made with, their rate for the latent one."""
    audit = Z.audit_features(T.daily(spark, sf)).drop("cohort")
    own = T.participants(spark, sf).withColumn("mean_seizure_frequency_month", F.col("seizures_per_month"))
    return own.join(audit, "participant_id", "left").withColumn("dominant_seizure_cycle_days", F.col("spectral_dominant_period_days"))


_FEATURES = [(p, f) for p, fields in Z.PANELS.items() for f in fields]


@query(_PART + ", " + _DFT + ", " + _AUDIT_RAW + """, feat AS (SELECT people.*, seizures_per_month AS mean_seizure_frequency_month, au.* EXCLUDE (participant_id), period_days AS spectral_dominant_period_days, period_days AS dominant_seizure_cycle_days, amplitude AS spectral_amplitude_seizures_per_day
FROM people LEFT JOIN au USING (participant_id) LEFT JOIN dom USING (participant_id)), v AS (""" + " UNION ALL ".join(f"SELECT '{p}' AS panel, '{f}' AS field, cohort, round({f}::DOUBLE, 9) AS v FROM feat WHERE {f} IS NOT NULL AND NOT isinf({f}::DOUBLE)" + (" AND cohort = 'population'" if f in Z.POPULATION_ONLY else "") for p, f in _FEATURES) + """),
e0 AS (SELECT panel, field, cohort, round(quantile_cont(v, 0.005), 9) AS lo, round(quantile_cont(v, 0.995), 9) AS hi, count(*) AS total FROM v GROUP BY ALL), e AS (SELECT * REPLACE (CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi) FROM e0)
SELECT panel, field, cohort, bin, round(lo + bin * ((hi - lo) / 35), 6) AS lower, n, round(n / (total * ((hi - lo) / 35)), 6) AS density FROM (SELECT panel, field, cohort, least(floor((least(greatest(v, lo), hi) - lo) / ((hi - lo) / 35)), 34)::INT AS bin, count(*) AS n, lo, hi, total FROM v JOIN e USING (panel, field, cohort) GROUP BY ALL)""")
def winsorized_histogram(spark, sf):
    return Z.winsorized_histogram(_features(spark, sf)).select("panel", "field", "cohort", "bin", r6("lower"), "n", r6("density"))


@query(_PART + f", {_MODS} SELECT cohort, count(*) AS n, round(avg(pcos::INT), 6) AS pcos, round(avg(peri_menarche::INT), 6) AS peri_menarche, round(avg(perimenopause::INT), 6) AS perimenopause FROM mods GROUP BY 1")
def modifier_prevalence(spark, sf):
    return Z.modifier_prevalence(_people(spark, sf)).select("cohort", "n", *[r6(c) for c in Z.BINARY])


@query(_PART + """, e AS (SELECT cohort, min(age) AS lo, max(age) AS hi, count(*) AS total FROM people GROUP BY 1)
SELECT cohort, bin, round(lo + bin * (hi - lo) / 30, 6) AS lower, n, round(n / (total * (hi - lo) / 30), 6) AS density FROM (SELECT cohort, least(floor((age - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS n, lo, hi, total FROM people JOIN e USING (cohort) GROUP BY ALL)""")
def age_histogram(spark, sf):
    return Z.age_histogram(T.participants(spark, sf)).select("cohort", "bin", r6("lower"), "n", r6("density"))


@query(CLS + f""", ab AS (SELECT cohort, 'A_windowed' AS definition, coalesce(label_A_windowed_pattern_category, 'indeterminate') AS c FROM w WHERE phase_mode = 'strict_herzog' AND window_type = 'full'
UNION ALL SELECT cohort, 'B_minimum_data', coalesce(label_B_pattern_category, 'indeterminate') FROM w WHERE phase_mode = 'strict_herzog' AND window_type = 'full')
SELECT cohort, definition, category, count_if(c = category)::BIGINT AS n, round(count_if(c = category)::DOUBLE / count(*), 6) AS share FROM ab, (SELECT unnest({Z.CATEGORIES!r}) AS category) GROUP BY ALL""")
def stacked_composition(spark, sf):
    return Z.stacked_composition(T.classified(spark, sf)).withColumn("share", r6("share"))


_SHOWN = f"shown AS (SELECT * FROM ({_WINDOWS_SQL}) WHERE subset = 'all' AND false_positive_rate IS NOT NULL AND definition IN ({', '.join(repr(d) for d in Z.SHOWN)}))"


@query(ALL_SUM + f", {_SHOWN} SELECT definition, {_KIND}, indeterminate_rate, false_positive_rate FROM shown")
def frontier(spark, sf):
    return Z.frontier(summarize_windows(spark, sf))


@query(ALL_SUM + f", {_SHOWN} SELECT cohort, definition, assumption_based_historical, round(avg(false_positive_rate), 5) AS false_positive_rate FROM shown WHERE window_type = 'calendar' AND window_value = '3' GROUP BY ALL")
def core_vs_historical(spark, sf):
    out = Z.core_vs_historical(summarize_windows(spark, sf))
    return out.withColumn("false_positive_rate", F.round("false_positive_rate", 5))


# --- comparison: the run against one whose one-month windows are missing and whose counts of any pattern are one higher


def _two_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    run = T.written(spark, sf, "run", _summary)
    new = run.where("not (window_type = 'calendar' and window_value = '1')").withColumn("positives", F.col("positives") + (F.col("definition") == "A_windowed_any").cast("int"))
    return run.where("window_type <> 'full' or definition = 'A_windowed_any'"), new


_METRICS = K.METRICS[:9]  # the runs compared here have no studies
_OLDNEW = ALL_SUM + f""", run AS ({' UNION ALL BY NAME '.join((_WINDOWS_SQL, _PARTICIPANTS_SQL, _PATTERNS_SQL, _REASONS_SQL))}), o AS (SELECT *, true AS here FROM run WHERE window_type <> 'full' OR definition = 'A_windowed_any'),
nw AS (SELECT * REPLACE (positives + (definition = 'A_windowed_any')::INT AS positives), true AS here FROM run WHERE NOT (window_type = 'calendar' AND window_value = '1')),
ab AS (SELECT {', '.join(f'coalesce(o.{k}, nw.{k}) AS {k}' for k in K.KEYS)}, o.here AS ino, nw.here AS inn, {', '.join(f'o.{m}::DOUBLE AS a_{m}, nw.{m}::DOUBLE AS b_{m}' for m in _METRICS)} FROM o FULL OUTER JOIN nw ON {' AND '.join(f'o.{k} IS NOT DISTINCT FROM nw.{k}' for k in K.KEYS)})"""


@query(_OLDNEW + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count_if(ino AND inn)::BIGINT AS n_aligned, count_if(inn IS NULL)::BIGINT AS n_old_only, count_if(ino IS NULL)::BIGINT AS n_new_only, count(b_{m} - a_{m}) AS n_comparable, count_if(abs(b_{m} - a_{m}) > 1e-12)::BIGINT AS n_changed, max(abs(b_{m} - a_{m}))::DOUBLE AS max_abs_delta, round(avg(abs(b_{m} - a_{m})), 6) AS mean_abs_delta FROM ab" for m in _METRICS))
def diff_runs(spark, sf):
    out = K.diff_runs(*_two_runs(spark, sf))
    return out.withColumn("mean_abs_delta", r6("mean_abs_delta"))


_SELECTED = """table_type = 'window_false_positive' AND subset = 'all' AND phase_mode = 'strict_herzog' AND ((window_type = 'full' AND definition IN ('A_windowed_any', 'A_windowed_C1_or_C2', 'A_windowed_C3_only', 'D_nb_regression_C1_or_C2'))
OR (window_type = 'calendar' AND window_value = '3' AND definition = 'A_windowed_any') OR (window_type = 'cycle' AND window_value = '3' AND definition = 'A_exact_any'))"""


_SELKEYS, _SELMETRICS = ", ".join(K.SELECTED_KEYS), ", ".join(f"{m}::DOUBLE AS {m}" for m in K.SELECTED_METRICS)


@query(ALL_SUM + f""", sel AS MATERIALIZED (SELECT * FROM ({_WINDOWS_SQL}) WHERE {_SELECTED}), so AS (SELECT {_SELKEYS}, {_SELMETRICS}, true AS here FROM sel WHERE window_type <> 'full' OR definition = 'A_windowed_any'),
sn AS (SELECT {_SELKEYS}, {_SELMETRICS}, true AS here FROM (SELECT * REPLACE (positives + (definition = 'A_windowed_any')::INT AS positives) FROM sel WHERE NOT (window_type = 'calendar' AND window_value = '1')))
SELECT {_SELKEYS}, CASE WHEN sn.here IS NULL THEN 'left_only' WHEN so.here IS NULL THEN 'right_only' ELSE 'both' END AS alignment, """ + ", ".join(f"so.{m} AS {m}_old, sn.{m} AS {m}_new, round(sn.{m} - so.{m}, 6) AS {m}_delta" for m in K.SELECTED_METRICS) + " FROM so FULL OUTER JOIN sn USING (" + _SELKEYS + ")")
def diff_selected(spark, sf):
    old, new = (K.selected_endpoints(x) for x in _two_runs(spark, sf))
    out = K.diff_selected(old, new)
    return out.select(*[r6(c) if c.endswith("_delta") else c for c in out.columns])


@query(ALL_SUM + f" SELECT * FROM ({_WINDOWS_SQL}) WHERE {_SELECTED}")
def selected_endpoints(spark, sf):
    return K.selected_endpoints(summarize_windows(spark, sf))


_RUNSUM = "count(*) AS n_participants, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ["age", *_MEANS]) + ", " + ", ".join(f"round(avg({c}::INT), 6) AS prevalence_{c}" for c in Z.BINARY)


@query(_PART + f", {_MODS} SELECT cohort, {_RUNSUM} FROM mods GROUP BY 1")
def run_cohort_summary(spark, sf):
    out = K.run_cohort_summary(_people(spark, sf))
    return out.select("cohort", "n_participants", *[r6(c) for c in out.columns[2:]])


_COHORT_METRICS = ["n_participants", *[f"mean_{c}" for c in ["age", "mean_cycle_length", "sd_cycle_length", "ovulatory_fraction", "seizure_days_per_month", "seizures_per_month"]], *[f"prevalence_{c}" for c in Z.BINARY]]


@query(_PART + f", {_MODS}, a AS (SELECT cohort, {_RUNSUM} FROM mods GROUP BY 1), b AS (SELECT cohort, {_RUNSUM} FROM mods WHERE seizure_days_per_month >= 1 GROUP BY 1) SELECT cohort, " + ", ".join(f"round(a.{m}, 5)::DOUBLE AS {m}_old, round(b.{m}, 5)::DOUBLE AS {m}_new, round(b.{m} - a.{m}, 4)::DOUBLE AS {m}_delta" for m in _COHORT_METRICS) + " FROM a FULL OUTER JOIN b USING (cohort)")
def diff_cohorts(spark, sf):
    people = _people(spark, sf)
    out = K.diff_cohorts(people, people.where("seizure_days_per_month >= 1"))
    return out.select("cohort", *[F.round(F.round(c, 6), 4 if c.endswith("_delta") else 5).alias(c) for c in out.columns[1:]])


@query(CLS + f" SELECT {WK}, coalesce(label_H4_phase, '<NA>') AS label_H4_phase, '' AS pattern_category FROM w")
def normalize_keys(spark, sf):
    return K.normalize_keys(T.classified(spark, sf).select(*WKEY, "label_H4_phase"), ["label_H4_phase", "pattern_category"])


@query(CLS + f" SELECT {WK}, round(CASE WHEN NOT isinf(rr_C1) THEN rr_C1 END, 6) AS ratio FROM w")
def finite_or_null(spark, sf):
    return T.pooled(spark, sf).select(*WKEY, r6(C.finite_or_null("rr_C1"), "ratio"))


# --- cycle statistics

_BAND = "CASE WHEN age < 20 THEN '<20' WHEN age < 25 THEN '20-24' WHEN age < 30 THEN '25-29' WHEN age < 35 THEN '30-34' WHEN age < 40 THEN '35-39' WHEN age < 45 THEN '40-44' WHEN age < 50 THEN '45-49' ELSE '50+' END"
_CP = DAY + ", cp AS (SELECT participant_id, cycle_id, max(cohort) AS cohort, max(age) AS age, max(cycle_length) AS cycle_length, bool_or(ovulatory_flag) AS ovulatory_flag, max(ovulation_day) AS ovulation_day, sum(uterine_bleeding)::BIGINT AS bleeding_days FROM day GROUP BY 1, 2)"
_IRR = ", dd AS (SELECT *, abs(cycle_length - lag(cycle_length) OVER (PARTITION BY participant_id ORDER BY cycle_id)) AS d FROM cp)"


@query(_CP + f" SELECT participant_id, cycle_id, {_BAND} AS band FROM cp")
def age_band(spark, sf):
    return T.cycle_profiles(spark, sf).select("participant_id", "cycle_id", C.age_band("age").alias("band"))


@query(_CP + _IRR + " SELECT participant_id, round(avg(d), 6) AS irregularity, avg(d) >= 7 AS irregular FROM dd GROUP BY 1")
def cycle_irregularity(spark, sf):
    return Y.cycle_irregularity(T.cycle_profiles(spark, sf)).select("participant_id", r6("irregularity"), "irregular")


def _metric_sql(rows: str) -> str:
    """Metric rows from a query of name, kind, o, expected, lo, hi, which bounds count, decimals and citation."""
    return f"""SELECT name, kind, CASE WHEN dec = 3 THEN round_even(o, 3) ELSE round_even(o, 4) END AS observed, expected::DOUBLE AS expected, CASE WHEN dec = 3 THEN round_even(lo, 3) ELSE round_even(lo, 4) END AS lower_bound,
    CASE WHEN dec = 3 THEN round_even(hi, 3) ELSE round_even(hi, 4) END AS upper_bound, CASE counts WHEN 'lower' THEN o >= lo WHEN 'upper' THEN o <= hi ELSE o BETWEEN lo AND hi END AS passed, citation_key FROM ({rows})"""


def _first(group: str, source: str) -> str:
    """Of participants with at least 3 cycles in a group the first 11: a row each."""
    return f"""(SELECT {group}, participant_id, avg(cycle_length) AS m, stddev_samp(cycle_length) AS s, var_pop(cycle_length) * count(*) AS ss, count(*) - 1 AS df, avg(d) AS irr, avg((cycle_length < 24)::INT) AS sh, avg((cycle_length > 38)::INT) AS lo FROM (
    SELECT *, row_number() OVER q AS k, count(*) OVER (PARTITION BY participant_id, {group}) AS c, abs(cycle_length - lag(cycle_length) OVER q) AS d FROM {source} WINDOW q AS (PARTITION BY participant_id, {group} ORDER BY cycle_id)) WHERE k <= 11 AND c >= 3 GROUP BY 1, 2)"""


_BAND_TARGETS = """bt AS (SELECT * FROM (VALUES ('<20', 29.82, 5.33, 0.204, 0.0771, 0.0833), ('20-24', 29.62, 5.07, 0.209, 0.0722, 0.0688), ('25-29', 29.31, 4.70, 0.159, 0.0607, 0.0616), ('30-34', 28.75, 4.28, 0.116, 0.0671, 0.0449), ('35-39', 28.19, 3.79, 0.106, 0.0812, 0.0293),
('40-44', 27.70, 3.99, 0.128, 0.1189, 0.0248), ('45-49', 27.86, 5.42, 0.282, 0.1595, 0.0421), ('50+', 30.21, 11.19, 0.602, 0.1866, 0.1481)) v(band, e1, e2, e3, e4, e5))"""
_BAND_ROWS = f"""z AS {_first('band', f'(SELECT *, {_BAND} AS band FROM cp)')}, zb AS (SELECT band, avg(m) AS o1, sqrt(sum(ss) / sum(df)) AS o2, avg((irr >= 7)::INT) AS o3, avg(sh) AS o4, avg(lo) AS o5 FROM z GROUP BY band),
bandrows AS (SELECT 'cycle_mean_' || band AS name, o1 AS o, e1::DOUBLE AS expected, e1 - 0.55::DOUBLE AS lo, e1 + 0.55::DOUBLE AS hi, 3 AS dec FROM zb JOIN bt USING (band)
UNION ALL SELECT 'cycle_within_person_sd_' || band, o2, e2, e2 - CASE band WHEN '50+' THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END, e2 + CASE band WHEN '50+' THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END, 3 FROM zb JOIN bt USING (band)
UNION ALL SELECT 'cycle_irregularity_' || band, o3, e3, greatest(0, e3 - 0.035::DOUBLE), least(1, e3 + 0.035::DOUBLE), 4 FROM zb JOIN bt USING (band)
UNION ALL SELECT 'cycle_short_lt24_' || band, o4, e4, greatest(0, e4 - CASE band WHEN '50+' THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END), least(1, e4 + CASE band WHEN '50+' THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END), 4 FROM zb JOIN bt USING (band)
UNION ALL SELECT 'cycle_long_gt38_' || band, o5, e5, greatest(0, e5 - CASE band WHEN '50+' THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END), least(1, e5 + CASE band WHEN '50+' THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END), 4 FROM zb JOIN bt USING (band))"""
_BAND_METRICS = _metric_sql("SELECT *, 'cycle' AS kind, 'both' AS counts, 'li_2023_awhs' AS citation_key FROM bandrows")


def _metrics(df: DataFrame) -> DataFrame:
    return df.select("name", "kind", r6("observed"), r6("expected"), r6("lower_bound"), r6("upper_bound"), "passed", "citation_key")


@query(_CP + f", {_BAND_TARGETS}, {_BAND_ROWS} {_BAND_METRICS}")
def age_band_metrics(spark, sf):
    return _metrics(Y.age_band_metrics(spark, T.cycle_profiles(spark, sf)))


_EXT_ROWS = f"""xt AS (SELECT * FROM (VALUES ('18-25', 18, 26, 28.99, 4.14), ('26-30', 26, 31, 28.76, 3.95), ('31-35', 31, 36, 28.28, 3.80), ('36-40', 36, 41, 27.68, 3.72), ('41-45', 41, 46, 27.18, 3.92), ('46-50', 46, 51, 27.15, 4.72), ('51-55', 51, 56, 28.00, 6.52)) v(label, lo, hi, e1, e2)),
xz AS {_first('label', '(SELECT cp.*, label FROM cp JOIN xt ON age >= lo AND age < hi)')}, xb AS (SELECT label, avg(m) AS o1, avg(s) AS o2 FROM xz GROUP BY label),
extrows AS (SELECT 'external_cunningham_mean_' || label AS name, o1 AS o, e1::DOUBLE AS expected, e1 - CASE label WHEN '51-55' THEN 2.5::DOUBLE ELSE 1.5::DOUBLE END AS lo, e1 + CASE label WHEN '51-55' THEN 2.5::DOUBLE ELSE 1.5::DOUBLE END AS hi, 3 AS dec FROM xb JOIN xt USING (label)
UNION ALL SELECT 'external_cunningham_mean_personal_sd_' || label, o2, e2, e2 - CASE label WHEN '51-55' THEN 3.5::DOUBLE ELSE 1.25::DOUBLE END, e2 + CASE label WHEN '51-55' THEN 3.5::DOUBLE ELSE 1.25::DOUBLE END, 3 FROM xb JOIN xt USING (label))"""
_EXT_METRICS = _metric_sql("SELECT *, 'external' AS kind, 'both' AS counts, 'cunningham_2024_flo' AS citation_key FROM extrows")


@query(_CP + f", {_EXT_ROWS} {_EXT_METRICS}")
def external_metrics(spark, sf):
    return _metrics(Y.external_metrics(spark, T.cycle_profiles(spark, sf)))


_ALL_ROWS = """ov AS (SELECT CASE WHEN ovulatory_flag THEN ovulation_day END AS f, CASE WHEN ovulatory_flag THEN cycle_length - ovulation_day END AS l, bleeding_days AS b FROM cp),
ovrows AS (SELECT 'follicular_mean_days' AS name, avg(f) AS o, 16.9 AS expected, 15.9::DOUBLE AS lo, 17.9::DOUBLE AS hi FROM ov UNION ALL SELECT 'luteal_mean_days', avg(l), 12.4, 11.7, 13.1 FROM ov UNION ALL SELECT 'bleeding_mean_days', avg(b), 4.0, 3.6, 4.4 FROM ov
UNION ALL SELECT 'luteal_sd_days', stddev_samp(l), 2.4, 2.0, 2.8 FROM ov UNION ALL SELECT 'bleeding_sd_days', stddev_samp(b), 1.5, 1.25, 1.75 FROM ov)"""
_ALL_METRICS = _metric_sql("SELECT *, 'overall' AS kind, 'both' AS counts, 3 AS dec, 'bull_2019_natural_cycles' AS citation_key FROM ovrows")


@query(_CP + f", {_ALL_ROWS} {_ALL_METRICS}")
def overall_metrics(spark, sf):
    return _metrics(Y.overall_metrics(spark, T.cycle_profiles(spark, sf)))


def _part(size: str, f: float, least: int) -> str:
    return f"greatest({least}, round_even({size} * {f}::DOUBLE, 0))"


_LUT = "(cycle_length - ovulation_day)"
_SUBPHASE = f"""CASE WHEN ovulation_day <= 0 THEN NULL WHEN cycle_day <= {_part('ovulation_day', 0.2, 2)} THEN 'early_follicular' WHEN cycle_day <= {_part('ovulation_day', 0.6, 3)} THEN 'mid_follicular' WHEN cycle_day < ovulation_day THEN 'pre_ovulatory' WHEN cycle_day = ovulation_day THEN 'ovulation'
WHEN cycle_day - ovulation_day <= {_part(_LUT, 0.3, 3)} THEN 'early_luteal' WHEN cycle_day - ovulation_day BETWEEN {_part(_LUT, 0.35, 4)} AND {_part(_LUT, 0.7, 5)} THEN 'mid_luteal' ELSE 'late_luteal' END"""


@query(DAY + f" SELECT participant_id, calendar_day_index, {_SUBPHASE} AS subphase FROM day")
def subphase(spark, sf):
    return T.daily(spark, sf).select(*D.DAY, Y.subphase("cycle_day", "ovulation_day", "cycle_length").alias("subphase"))


def _whole_ovulatory(spark, sf, share: float | None = None) -> DataFrame:
    """Days of complete ovulatory cycles, of the participants below a share of the hash range; a participant's complete cycles are one row, which
    travels to the days' bucket."""
    done = T.whole_cycles(spark, sf)
    done = done.where(F.col("_at") < share) if share is not None else done
    days = T.daily(spark, sf).where("ovulatory_flag").join(done.hint("shuffle_hash"), "participant_id")
    return days.where(F.array_contains("_done", F.col("cycle_id"))).drop("_done", "_at")


_WHOLE = "whole AS (SELECT day.* FROM day JOIN cycall USING (participant_id, cycle_id) WHERE complete_cycle_flag AND ovulatory_flag)"
_SUB_ROWS = f"""sp AS (SELECT {_SUBPHASE} AS subphase, quantile_cont(estradiol, 0.5) AS e, quantile_cont(progesterone, 0.5) AS p FROM whole GROUP BY 1),
spt AS (SELECT subphase, e2 / 3.671::DOUBLE AS te, p4 / 3.18::DOUBLE AS tp FROM (VALUES ('early_follicular', 125.0, 0.380), ('mid_follicular', 172.0, 0.210), ('pre_ovulatory', 464.0, 0.188), ('ovulation', 817.0, 1.59), ('early_luteal', 390.0, 22.6), ('mid_luteal', 505.0, 39.2), ('late_luteal', 396.0, 18.2)) v(subphase, e2, p4)),
sprows AS (SELECT 'estradiol_' || subphase AS name, e AS o, round(te, 3) AS expected, te * 0.4::DOUBLE AS lo, te * 1.85::DOUBLE AS hi FROM sp JOIN spt USING (subphase)
UNION ALL SELECT 'progesterone_' || subphase, p, round(tp, 3), CASE WHEN subphase LIKE '%luteal' THEN greatest(0.05::DOUBLE, tp * 0.45::DOUBLE) ELSE 0.05 END, CASE WHEN subphase = 'ovulation' THEN 2.0 WHEN subphase LIKE '%luteal' THEN tp * 1.85::DOUBLE ELSE 0.65 END FROM sp JOIN spt USING (subphase))"""
_SUB_METRICS = _metric_sql("SELECT *, 'subphase' AS kind, 'both' AS counts, 3 AS dec, 'anckaert_2021_hormones' AS citation_key FROM sprows")


@query(_ALL + f", {_WHOLE}, {_SUB_ROWS} {_SUB_METRICS}")
def subphase_medians(spark, sf):
    return _metrics(Y.subphase_medians(spark, _whole_ovulatory(spark, sf)))


_WAVE_ROWS = """
wp AS (SELECT *, max(CASE WHEN cycle_day <= ovulation_day THEN estradiol END) OVER c AS fp, max(progesterone) OVER c AS pp, lag(progesterone) OVER (PARTITION BY participant_id, cycle_id ORDER BY cycle_day) AS b FROM whole WINDOW c AS (PARTITION BY participant_id, cycle_id)),
ws AS (SELECT participant_id, cycle_id, count_if(cycle_day <= ovulation_day AND estradiol >= fp * 0.8) AS a1, max(CASE WHEN cycle_day > ovulation_day THEN estradiol END) / max(fp) AS a2, count_if(progesterone >= pp * 0.75) AS a3, min(CASE WHEN progesterone = pp THEN cycle_day END) - max(ovulation_day) AS a4,
min(CASE WHEN cycle_day >= ovulation_day AND progesterone >= 5 THEN cycle_day END) - max(ovulation_day) AS a5, max(cycle_day) - coalesce(max(CASE WHEN b IS NOT NULL AND progesterone >= b THEN cycle_day END), 1) AS a6, arg_max(progesterone, cycle_day) / max(pp) AS a7, arg_min(progesterone, cycle_day) AS f, arg_max(progesterone, cycle_day) AS l FROM wp GROUP BY 1, 2),
wj AS (SELECT *, CASE WHEN lead(cycle_id) OVER q = cycle_id + 1 THEN abs(lead(f) OVER q - l) END AS a8 FROM ws WINDOW q AS (PARTITION BY participant_id ORDER BY cycle_id)), wrows AS (
""" + " UNION ALL ".join(f"SELECT '{m}' AS name, quantile_cont(a{i}::DOUBLE, 0.5) AS o, {e} AS expected, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi, '{counts}' AS counts, {dec} AS dec FROM wj" for i, m, e, lo, hi, counts, dec in (
    (1, "estradiol_preovulatory_peak_width_days", 3.0, 2.0, 5.0, "both", 3), (2, "estradiol_luteal_secondary_peak_ratio", 0.59, 0.35, 0.8, "both", 4), (3, "progesterone_plateau_width_days", 6.0, 3.0, 9.0, "both", 3), (4, "progesterone_peak_offset_from_ovulation_days", 6.0, 3.0, 9.0, "both", 3),
    (5, "progesterone_rise_to_5ng_offset_days", 2.0, 1.0, 4.0, "both", 3), (6, "progesterone_premenstrual_withdrawal_days", 4.0, 3.0, 8.0, "lower", 3), (7, "progesterone_terminal_to_peak_ratio", 0.04, 0.0, 0.2, "upper", 4), (8, "progesterone_cross_cycle_jump_ng_ml", 0.0, 0.0, 1.0, "upper", 4))) + ")"
_WAVE_METRICS = _metric_sql("SELECT *, 'waveform' AS kind, 'stricker_2006_reference' AS citation_key FROM wrows")


@query(_ALL + f", {_WHOLE}, {_WAVE_ROWS} {_WAVE_METRICS}")
def waveform_metrics(spark, sf):
    return _metrics(Y.waveform_metrics(spark, _whole_ovulatory(spark, sf)))


_BASE = _ALL + ", " + _CP.removeprefix(DAY).lstrip(", ") + f", {_WHOLE}, {_BAND_TARGETS}, {_BAND_ROWS}, {_EXT_ROWS}, {_ALL_ROWS}, {_SUB_ROWS}, {_WAVE_ROWS}, base AS ({' UNION ALL BY NAME '.join((_BAND_METRICS, _ALL_METRICS, _SUB_METRICS, _WAVE_METRICS, _EXT_METRICS))})"


@query(_BASE + """ SELECT gate, count(*) AS n, count_if(passed)::BIGINT AS n_passed, bool_and(coalesce(passed, false)) AS all_passed FROM (SELECT *, unnest(list_filter(['baseline', CASE WHEN kind = 'external' THEN 'external' ELSE 'calibration' END,
CASE WHEN name LIKE 'estradiol_%' OR name LIKE 'progesterone_%' THEN 'waveform' END], lambda x: x IS NOT NULL)) AS gate FROM base) GROUP BY 1""")
def metric_gate(spark, sf):
    return Y.all_passed(Y.baseline_metrics(spark, T.cycle_profiles(spark, sf), _whole_ovulatory(spark, sf)))


def _profiles(spark, sf) -> DataFrame:
    """Participants with a nested factor struct derived from their keys."""
    pid = F.col("participant_id")
    oc = F.when(pid % 4 == 0, F.when(pid % 8 == 0, "cyclic").otherwise("continuous"))
    factors = F.struct(
        (pid % 7 == 0).alias("pcos"), (pid % 5 == 0).alias("hormonal_iud"), (pid % 3 == 0).alias("copper_iud"), (F.col("age") >= 45).alias("perimenopause"), (F.col("age") < 16).alias("peri_menarche"), (pid % 11 == 0).alias("dysmenorrhea"), oc.alias("oral_contraceptive_mode"))
    return T.participants(spark, sf).select("participant_id", "age", factors.alias("factors"))


_FX = """fx AS (SELECT participant_id, age, (participant_id % 7 = 0)::INT AS pcos, (participant_id % 5 = 0)::INT AS hormonal_iud, (participant_id % 3 = 0)::INT AS copper_iud, (age >= 45)::INT AS perimenopause, (age < 16)::INT AS peri_menarche, (participant_id % 11 = 0)::INT AS dysmenorrhea,
CASE WHEN participant_id % 8 = 0 THEN 'cyclic' WHEN participant_id % 4 = 0 THEN 'continuous' ELSE 'none' END AS oral_contraceptive_mode, CASE WHEN participant_id % 4 = 0 THEN 'oral_contraceptive' WHEN participant_id % 5 = 0 THEN 'hormonal_iud' WHEN participant_id % 3 = 0 THEN 'copper_iud' ELSE 'none' END AS medication_category FROM people)"""
_FACT = _PART + ", " + _FX


def _scenario_cycles(spark, sf) -> DataFrame:
    flat = Y.flatten_factors(_profiles(spark, sf)).drop("age")
    return T.cycle_profiles(spark, sf).join(flat, "participant_id")


_AGED = {"perimenopause": (45, 55), "peri_menarche": (13, 18)}
_MEMBER = ", ".join(
    f"CASE WHEN age >= {lo} AND age < {hi} AND {x} THEN '{k}' END, CASE WHEN age >= {lo} AND age < {hi} AND free THEN 'baseline {k}' END"
    for k, x, (lo, hi) in ((k, x, _AGED.get(k, (18, 45))) for k, x in (("pcos", "pcos = 1"), ("cyclic_ocp", "oral_contraceptive_mode = 'cyclic'"), ("continuous_ocp", "oral_contraceptive_mode = 'continuous'"), ("hormonal_iud", "hormonal_iud = 1"), ("copper_iud", "copper_iud = 1"), ("perimenopause", "perimenopause = 1"), ("peri_menarche", "peri_menarche = 1"), ("dysmenorrhea", "dysmenorrhea = 1"))))
_GROUPS = _FACT + ", " + _CP.removeprefix(DAY).lstrip(", ") + f""", sd AS (SELECT cp.*, fx.* EXCLUDE (participant_id, age), abs(cycle_length - lag(cycle_length) OVER (PARTITION BY cp.participant_id ORDER BY cycle_id)) AS d,
oral_contraceptive_mode = 'none' AND pcos + hormonal_iud + copper_iud + perimenopause + peri_menarche + dysmenorrhea = 0 AS free FROM cp JOIN fx ON cp.participant_id = fx.participant_id),
se AS (SELECT *, unnest(list_filter([{_MEMBER}], lambda x: x IS NOT NULL)) AS scenario FROM sd), si AS (SELECT scenario, participant_id, avg(d) AS d FROM se GROUP BY 1, 2),
sg AS (SELECT * FROM (SELECT scenario, round_even(avg(cycle_length), 3) AS mean_cycle_days, round_even(avg(ovulatory_flag::INT), 3) AS ovulation_rate, round_even(avg(bleeding_days), 3) AS mean_bleeding_days, round_even(avg((bleeding_days = 0)::INT), 3) AS amenorrhea_rate FROM se GROUP BY 1)
JOIN (SELECT scenario, round_even(avg((d >= 7)::INT), 3) AS irregularity_rate FROM si GROUP BY 1) USING (scenario)),
sb AS (SELECT a.scenario, {', '.join(f'a.{m}, b.{m} AS base_{m}, round_even(a.{m} - b.{m}, 3) AS delta_{m}' for m in Y.MEASURES)} FROM sg a LEFT JOIN sg b ON b.scenario = 'baseline ' || a.scenario WHERE a.scenario NOT LIKE 'baseline %')"""


@query(_GROUPS + " SELECT * FROM sb")
def subgroup_summary(spark, sf):
    out = Y.subgroup_summary(_scenario_cycles(spark, sf))
    return out.select("scenario", *[r6(c) for c in out.columns[1:]])


_RULES_SQL = """rule AS (
SELECT scenario, 'pcos_longer_cycles' AS name, mean_cycle_days AS o, base_mean_cycle_days + 2 AS expected, base_mean_cycle_days + 2 AS lo, 999 AS hi, mean_cycle_days - base_mean_cycle_days >= 2 - 1e-9 AS passed, 'mortimer_2026_pcos' AS citation_key FROM sb WHERE scenario = 'pcos'
UNION ALL SELECT scenario, 'pcos_higher_irregularity', irregularity_rate, base_irregularity_rate + 0.08, base_irregularity_rate + 0.08, 1, irregularity_rate - base_irregularity_rate >= 0.08 - 1e-9, 'mortimer_2026_pcos' FROM sb WHERE scenario = 'pcos'
UNION ALL SELECT scenario, 'pcos_lower_ovulation', ovulation_rate, base_ovulation_rate - 0.18, 0, base_ovulation_rate - 0.18, base_ovulation_rate - ovulation_rate >= 0.18 - 1e-9, 'doi_2005_pcos_hormones' FROM sb WHERE scenario = 'pcos'
UNION ALL SELECT scenario, scenario || '_ovulation_suppression', ovulation_rate, 0, 0, 0.02, ovulation_rate <= 0.02, 'edelman_2014_ocp' FROM sb WHERE scenario IN ('cyclic_ocp', 'continuous_ocp')
UNION ALL SELECT scenario, 'cyclic_ocp_withdrawal_bleeding', mean_bleeding_days, 4, 3, 5, mean_bleeding_days BETWEEN 3 AND 5, 'edelman_2014_ocp' FROM sb WHERE scenario = 'cyclic_ocp'
UNION ALL SELECT scenario, 'continuous_ocp_low_bleeding', mean_bleeding_days, 1.5, 0, 2.5, mean_bleeding_days <= 2.5, 'edelman_2014_ocp' FROM sb WHERE scenario = 'continuous_ocp'
UNION ALL SELECT scenario, 'continuous_ocp_amenorrhea', amenorrhea_rate, 0.55, 0.4, 0.9, amenorrhea_rate >= 0.4, 'edelman_2014_ocp' FROM sb WHERE scenario = 'continuous_ocp'
UNION ALL SELECT scenario, 'hormonal_iud_preserved_ovulation', ovulation_rate, 0.8, 0.7, 0.9, ovulation_rate BETWEEN 0.7 AND 0.9, 'xiao_1995_lng_iud' FROM sb WHERE scenario = 'hormonal_iud'
UNION ALL SELECT scenario, 'hormonal_iud_amenorrhea', amenorrhea_rate, 0.17, 0.1, 0.25, amenorrhea_rate BETWEEN 0.1 AND 0.25, 'xiao_1995_lng_iud' FROM sb WHERE scenario = 'hormonal_iud'
UNION ALL SELECT scenario, 'copper_iud_ovulation_preserved', ovulation_rate, base_ovulation_rate, base_ovulation_rate - 0.05, base_ovulation_rate + 0.05, abs(ovulation_rate - base_ovulation_rate) <= 0.05 + 1e-9, 'faundes_1980_copper_iud' FROM sb WHERE scenario = 'copper_iud'
UNION ALL SELECT scenario, 'copper_iud_bleeding_increase', mean_bleeding_days, base_mean_bleeding_days + 0.5, base_mean_bleeding_days + 0.5, base_mean_bleeding_days + 2, mean_bleeding_days - base_mean_bleeding_days BETWEEN 0.5 - 1e-9 AND 2 + 1e-9, 'malmqvist_1974_copper_bleeding' FROM sb WHERE scenario = 'copper_iud'
UNION ALL SELECT scenario, 'perimenopause_irregularity', irregularity_rate, 0.27, 0.25, 1, irregularity_rate >= 0.25, 'santoro_2011_perimenopause' FROM sb WHERE scenario = 'perimenopause'
UNION ALL SELECT scenario, 'perimenopause_lower_ovulation', ovulation_rate, 0.7, 0.45, 0.8, ovulation_rate BETWEEN 0.45 AND 0.8, 'santoro_2011_perimenopause' FROM sb WHERE scenario = 'perimenopause'
UNION ALL SELECT scenario, 'peri_menarche_long_cycles', mean_cycle_days, 30.5, 30, 40, mean_cycle_days >= 30, 'who_1986_adolescent_cycles' FROM sb WHERE scenario = 'peri_menarche'
UNION ALL SELECT scenario, 'peri_menarche_irregularity', irregularity_rate, 0.3, 0.28, 1, irregularity_rate >= 0.28, 'who_1986_adolescent_cycles' FROM sb WHERE scenario = 'peri_menarche'
UNION ALL SELECT scenario, 'peri_menarche_lower_ovulation', ovulation_rate, 0.55, 0.3, 0.6, ovulation_rate <= 0.6, 'venturoli_1986_menarche' FROM sb WHERE scenario = 'peri_menarche'
UNION ALL SELECT scenario, 'dysmenorrhea_preserved_ovulation', ovulation_rate, base_ovulation_rate, base_ovulation_rate - 0.08, base_ovulation_rate + 0.08, abs(ovulation_rate - base_ovulation_rate) <= 0.08 + 1e-9, 'dawood_2006_dysmenorrhea' FROM sb WHERE scenario = 'dysmenorrhea'
UNION ALL SELECT scenario, 'dysmenorrhea_bleeding_shift', mean_bleeding_days, base_mean_bleeding_days + 0.2, base_mean_bleeding_days + 0.2, base_mean_bleeding_days + 1.2, mean_bleeding_days - base_mean_bleeding_days BETWEEN 0.2 - 1e-9 AND 1.2 + 1e-9, 'dawood_2006_dysmenorrhea' FROM sb WHERE scenario = 'dysmenorrhea')"""


@query(_GROUPS + f", {_RULES_SQL} SELECT scenario, name, o AS observed, round(expected::DOUBLE, 6) AS expected, round(lo::DOUBLE, 6) AS lower_bound, round(hi::DOUBLE, 6) AS upper_bound, passed, citation_key FROM rule")
def subgroup_checks(spark, sf):
    out = Y.subgroup_checks(spark, Y.subgroup_summary(_scenario_cycles(spark, sf)))
    return out.select("scenario", "name", "observed", r6("expected"), r6("lower_bound"), r6("upper_bound"), "passed", "citation_key")


_GROUP4 = "CASE WHEN age < 20 THEN '12-19' WHEN age < 30 THEN '20-29' WHEN age < 40 THEN '30-39' ELSE '40-52' END"


@query(_CP + f" SELECT {_GROUP4} AS age_group, count(DISTINCT participant_id) AS patients, count(*) AS cycles, round(avg(cycle_length), 6) AS mean_cycle_length, round(avg(ovulatory_flag::INT), 6) AS ovulatory_cycle_rate, round(avg(bleeding_days), 6) AS mean_bleeding_days FROM cp GROUP BY 1")
def age_group_summary(spark, sf):
    return Y.age_group_summary(T.cycle_profiles(spark, sf)).select("age_group", "patients", "cycles", r6("mean_cycle_length"), r6("ovulatory_cycle_rate"), r6("mean_bleeding_days"))


@query(_CP + _IRR + """, pi AS (SELECT participant_id, max(age) AS age, avg(d) AS irr FROM dd GROUP BY 1) SELECT 'patients' AS metric, count(*)::DOUBLE AS value FROM pi UNION ALL SELECT 'mean_age', round(avg(age), 6) FROM pi UNION ALL SELECT 'median_age', round(quantile_cont(age, 0.5), 6) FROM pi
UNION ALL SELECT 'mean_adjacent_difference', round(avg(irr), 6) FROM pi UNION ALL SELECT 'irregular_share', round(avg(coalesce(irr >= 7, false)::INT), 6) FROM pi UNION ALL SELECT 'mean_cycle_length', round(avg(cycle_length), 6) FROM cp UNION ALL SELECT 'ovulatory_cycle_rate', round(avg(ovulatory_flag::INT), 6) FROM cp UNION ALL SELECT 'mean_bleeding_days', round(avg(bleeding_days), 6) FROM cp""")
def cohort_metrics(spark, sf):
    return Y.cohort_metrics(T.cycle_profiles(spark, sf)).select("metric", r6("value"))


@query(_FACT + " SELECT * EXCLUDE (age) FROM fx")
def flatten_factors(spark, sf):
    return Y.flatten_factors(_profiles(spark, sf)).drop("age")


@query(_FACT + " " + " UNION ALL ".join(f"SELECT '{k}' AS feature, count_if({x})::BIGINT AS patients, round(count_if({x}) * 100.0::DOUBLE / count(*), 6) AS percent FROM fx" for k, x in (("PCOS", "pcos = 1"), ("Dysmenorrhea", "dysmenorrhea = 1"), ("Cyclic oral contraceptive", "oral_contraceptive_mode = 'cyclic'"), ("Hormonal IUD", "hormonal_iud = 1"), ("Copper IUD", "copper_iud = 1"))))
def factor_prevalence(spark, sf):
    return Y.factor_prevalence(Y.flatten_factors(_profiles(spark, sf))).select("feature", "patients", r6("percent"))


@query(_FACT + f" SELECT {_GROUP4} AS age_group, " + ", ".join(f"round(count_if(medication_category = '{v}') * 100.0::DOUBLE / count(*), 6) AS {v}" for v in ("none", "oral_contraceptive", "hormonal_iud", "copper_iud")) + " FROM fx GROUP BY 1")
def medication_mix(spark, sf):
    out = Y.medication_mix(Y.flatten_factors(_profiles(spark, sf)))
    return out.select("age_group", *[r6(c) for c in out.columns[1:]])


@query(_CP + _IRR + f", pi AS (SELECT participant_id, max(age) AS age, avg(d) AS irr FROM dd GROUP BY 1) SELECT {_GROUP4} AS age_group, round(avg(coalesce(irr >= 7, false)::INT), 6) AS irregular_participant_prevalence FROM pi GROUP BY 1")
def irregular_by_age(spark, sf):
    return Y.irregular_by_age(T.cycle_profiles(spark, sf)).select("age_group", r6("irregular_participant_prevalence"))


def _share_sql(share: float) -> str:
    """All checks of the participants below a share of the hash range, as a query of its own."""
    inner = _BASE.replace("FROM supplier, per)", f"FROM supplier, per WHERE {Q.sha('s_suppkey + shift')} < {share} * 4294967296)")
    return f"SELECT {share}::DOUBLE AS share, * FROM ({inner} SELECT * FROM base)"


@query("SELECT share, bool_and(coalesce(passed, false)) AS overall_passed, bool_and(coalesce(passed, false) OR kind = 'external') AS calibration_passed, bool_and(coalesce(passed, false) OR kind <> 'external') AS external_crosscheck_passed, count_if(passed)::BIGINT AS checks_passed, count(*) AS checks_total FROM ("
       + " UNION ALL BY NAME ".join(_share_sql(s) for s in (0.25, 0.5, 1.0)) + ") GROUP BY 1")
def convergence(spark, sf):
    """Checks passed by the first quarter, half and all of the participants in hash order."""
    kept = {
        "hashed_profiles": lambda s, d: T.cycle_profiles(s, d).withColumn("_at", T.at()),
        "hashed_waveforms": lambda s, d: Y.cycle_waveforms(_whole_ovulatory(s, d)).withColumn("_at", T.at()),
    }
    below = lambda name, share: T.written(spark, sf, name, kept[name]).where(F.col("_at") < share).drop("_at")
    parts = [Y.baseline_metrics(spark, below("hashed_profiles", s), _whole_ovulatory(spark, sf, s), below("hashed_waveforms", s)).withColumn("share", F.lit(s)) for s in (0.25, 0.5, 1.0)]
    return Y.convergence(parts[0].unionByName(parts[1]).unionByName(parts[2]), "share")


@query(DAY + " SELECT participant_id, calendar_day_index, round(estradiol / 3.671::DOUBLE, 6) AS estradiol, round(progesterone / 3.18::DOUBLE, 6) AS progesterone FROM day")
def unit_convert(spark, sf):
    return T.daily(spark, sf).select(*D.DAY, r6(C.estradiol_pg_ml("estradiol"), "estradiol"), r6(C.progesterone_ng_ml("progesterone"), "progesterone"))


# --- files


def _summary(spark, sf) -> DataFrame:
    df = T.classified(spark, sf)
    return S.unified_summary(*[_rates(x) for x in (S.summarize_windows(df), S.summarize_participants(df), S.summarize_patterns(df), S.summarize_reasons(df))])


def _written_results(spark, sf) -> str:
    """The five result tables and the summary. The table named for 30 participants holds all sizes, as it always has."""
    path = T.shared_folder(spark)
    people, daily = T.participants(spark, sf), D.add_phase_labels(T.daily(spark, sf), "strict_herzog")
    sample = daily.join(D.audit_sample(people, 0.1).select("participant_id"), "participant_id", "left_semi")
    tables = {"participant_summary": people, "window_results": V.ordered_row(T.results(spark, sf)), "study_level_3month": T.studies(spark, sf), "study_level_3month_n30": T.studies(spark, sf), "audit_daily_sample": sample}
    io.write_outputs({k: io.normalize_output(v) for k, v in tables.items()}, _summary(spark, sf), path)
    return path


@query(STUDIES_ALL + f", {_STRATA}, r AS (SELECT participant_id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY {Q.sha('participant_id')}, participant_id) AS r, count(*) OVER (PARTITION BY cohort) AS c FROM people), " + ", ".join((_LONG, _SUB, _LONGSUB, _CAT, _WHY)) + """
SELECT 'participant_summary' AS name, count(*) AS n FROM people UNION ALL SELECT 'window_results', count(*) FROM w UNION ALL SELECT 'study_level_3month', count(*) FROM studies UNION ALL SELECT 'study_level_3month_n30', count(*) FROM studies
UNION ALL SELECT 'audit_daily_sample', count(*) FROM day JOIN (SELECT participant_id FROM r WHERE r <= greatest(1, round_even(c * 0.1, 0))) USING (participant_id)
UNION ALL SELECT 'summary', (SELECT count(*) FROM (""" + _WINDOWS_SQL + ")) + (SELECT count(*) FROM (" + _PARTICIPANTS_SQL + ")) + (SELECT count(*) FROM (" + _PATTERNS_SQL + ")) + (SELECT count(*) FROM (" + _REASONS_SQL + "))")
def write_outputs(spark, sf):
    """Rows of each file that was written, as read back."""
    path = _written_results(spark, sf)
    names = ["participant_summary", "window_results", "study_level_3month", "study_level_3month_n30", "audit_daily_sample"]
    out = [t.agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, t in io.read_result_tables(spark, path, *names).items()]
    out.append(spark.read.option("header", True).csv(f"{path}/summary").agg(F.lit("summary").alias("name"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, out)


@query(CLS + " SELECT * EXCLUDE (" + ", ".join(c for c in V.SCHEMA if c.startswith("label_D")) + f") FROM (SELECT {_ROW_SQL})")
def read_result_tables(spark, sf):
    """The written window results as read back, without the labels of definition D, which SQL cannot fit."""
    rows = io.read_result_tables(spark, _written_results(spark, sf), "window_results")["window_results"]
    return rows.select(*[r6(c) if t == "double" else c for c, t in V.SCHEMA.items() if not c.startswith("label_D")])


_CSV = ["table_type", "subset", "cohort", "phase_mode", "window_type", "window_value", "definition", "n_windows", "n_classifiable", "positives", "false_positive_rate", "wilson95_low", "wilson95_high", "indeterminate_rate", "n_participants", "pattern_category", "indeterminate_reason"]


@query(ALL_SUM + f", run AS ({' UNION ALL BY NAME '.join((_WINDOWS_SQL, _PARTICIPANTS_SQL, _PATTERNS_SQL, _REASONS_SQL))}) SELECT {', '.join(_CSV)} FROM run")
def read_summary_csv(spark, sf):
    folder, summary = T.shared_folder(spark), _summary(spark, sf).select(*_CSV)
    io.write_outputs({}, summary, folder)
    return io.read_summary_csv(spark, folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in summary.schema))


@query(CLS + f" SELECT {WK}, indeterminate_reason, label_H4_phase FROM w")
def normalize_output(spark, sf):
    return io.normalize_output(T.classified(spark, sf)).select(*WKEY, "indeterminate_reason", "label_H4_phase")


@query()
def output_manifest(spark, sf):
    return io.output_manifest(spark, _written_results(spark, sf))


def _patients(spark, sf, key: str | None = None) -> DataFrame:
    """The diary as files have it; ``key`` in place of the text ``patient_id``."""
    return T.daily(spark, sf).select(key or F.col("participant_id").cast("string").alias("patient_id"), F.col("calendar_day_index").alias("day_index"), F.col("age").alias("age_years"), F.col("cycle_id").alias("cycle_index"), "cycle_day", "cycle_length",
                                     F.col("estradiol").alias("estradiol_pg_ml"), F.col("progesterone").alias("progesterone_ng_ml"), (F.col("cycle_day") == F.col("ovulation_day")).alias("ovulation"), "uterine_bleeding")


_PAT = " SELECT participant_id::VARCHAR AS patient_id, calendar_day_index AS day_index, cycle_id AS cycle_index, cycle_day, cycle_length, round(progesterone, 6) AS progesterone_ng_ml, cycle_day = ovulation_day AS ovulation, uterine_bleeding FROM day"


def _diary_columns(df: DataFrame) -> DataFrame:
    return df.select("patient_id", "day_index", "cycle_index", "cycle_day", "cycle_length", r6("progesterone_ng_ml"), "ovulation", "uterine_bleeding")


@query(DAY + _PAT)
def read_diary(spark, sf):
    path = T.shared_folder(spark)
    io.write_diary_csv(_patients(spark, sf), path)
    return _diary_columns(io.read_diary(spark, path, "csv"))


@query(DAY + _PAT)
def write_nested_json(spark, sf):
    path, key = T.shared_folder(spark), "participant_id"  # days lie in buckets by it, so that none is shuffled
    days = _patients(spark, sf, key)
    io.write_nested_json(days.select(key).distinct(), days, path, key)
    day = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in days.schema if f.name != key)
    rows = spark.read.schema(f"patient_id string, diary array<struct<{day}>>").json(path)  # given, so that no pass is made to find it
    return _diary_columns(rows.select("patient_id", F.explode("diary").alias("d")).select("patient_id", "d.*"))


@query(_CP + f", {_BAND_TARGETS}, {_BAND_ROWS} {_BAND_METRICS}")
def write_metric_report(spark, sf):
    path = T.shared_folder(spark)
    io.write_metric_report(Y.age_band_metrics(spark, T.cycle_profiles(spark, sf)), path)
    return _metrics(spark.read.json(path))
