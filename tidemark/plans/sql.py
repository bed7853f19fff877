"""DuckDB SQL of the diary, windows and labels, as common table expressions for the queries' SQL."""

from __future__ import annotations

CYC = """
ship AS (SELECT min(l_shipdate::DATE) AS first, max(l_shipdate::DATE) AS last FROM lineitem),
per AS (SELECT p, CASE WHEN p < 0 THEN -2*p - 1 ELSE 2*p END::BIGINT * 1000000000 AS shift, greatest(DATE '1996-01-01' + p*1080, first) AS begins, least(DATE '1996-01-01' + p*1080 + 1079, last) AS ends
    FROM (SELECT unnest(generate_series(floor((first - DATE '1996-01-01') / 1080.0)::BIGINT, floor((last - DATE '1996-01-01') / 1080.0)::BIGINT))::INT AS p, first, last FROM ship)),
dia AS (SELECT s_suppkey + shift AS participant_id, (ends - begins + 1)::INT AS diary_days FROM supplier, per),
cyc0 AS (SELECT participant_id, diary_days, k::INT AS cycle_id, (21 + (participant_id*7 + k*5) % 16)::INT AS cycle_length,
    CASE WHEN participant_id % 2 = 0 THEN 'healthy_ovulatory' ELSE 'population' END AS cohort FROM dia, generate_series(1, 60) g(k)),
cyc AS (SELECT *, CASE WHEN ovulatory_flag THEN cycle_length - 13 ELSE 0 END AS ovulation_day, CASE WHEN ovulatory_flag THEN 'ovulatory' ELSE 'anovulatory' END AS cycle_stage FROM (
    SELECT *, (sum(cycle_length) OVER (PARTITION BY participant_id ORDER BY cycle_id) - cycle_length - (participant_id*5) % (21 + (participant_id*7 + 5) % 16) + 1)::INT AS cycle_start,
    (cohort = 'healthy_ovulatory' OR (participant_id + cycle_id) % 4 <> 0) AS ovulatory_flag FROM cyc0) WHERE cycle_start <= diary_days)"""
DAYS = (
    CYC
    + """,
cd0 AS (SELECT cyc.*, d::INT AS calendar_day_index, (d - cycle_start + 1)::INT AS cycle_day FROM cyc, generate_series(1, 1080) g(d) WHERE d <= diary_days AND d >= cycle_start AND d < cycle_start + cycle_length),
cd AS (SELECT * EXCLUDE (cycle_start, diary_days), (cycle_day = 1)::INT AS menses_onset_flag,
    CASE WHEN ovulatory_flag THEN 0.5::DOUBLE + (3 + (participant_id*3 + cycle_id*2) % 10) * greatest(0::DOUBLE, 1 - abs(cycle_day - (ovulation_day + 6)) / 7.0::DOUBLE) ELSE 0.5::DOUBLE END AS progesterone,
    CASE WHEN ovulatory_flag THEN 40::DOUBLE + 200 * greatest(0::DOUBLE, 1 - abs(cycle_day - (ovulation_day - 1)) / 5.0::DOUBLE) + 100 * greatest(0::DOUBLE, 1 - abs(cycle_day - (ovulation_day + 7)) / 6.0::DOUBLE) ELSE 40::DOUBLE END AS estradiol,
    (cycle_day <= 3 + (participant_id + cycle_id) % 3)::INT AS uterine_bleeding, 13 + ((participant_id*37) % 410) / 10.0::DOUBLE AS age FROM cd0),
evd AS (SELECT l_suppkey + shift AS participant_id, l_shipdate::DATE - begins + 1 AS calendar_day_index, count(*) AS n FROM lineitem JOIN per ON l_shipdate::DATE BETWEEN begins AND ends WHERE l_returnflag = 'R' GROUP BY 1, 2),
ilp0 AS (SELECT participant_id, cycle_id, max(progesterone) AS whole, max(CASE WHEN cycle_day BETWEEN ovulation_day + 5 AND ovulation_day + 9 THEN progesterone END) AS mid,
    max(CASE WHEN cycle_day > ovulation_day THEN progesterone END) AS late, bool_or(ovulatory_flag AND ovulation_day > 0) AS ovulated FROM cd GROUP BY 1, 2),
ilp AS (SELECT participant_id, cycle_id, CASE WHEN ovulated THEN coalesce(mid, late) ELSE whole END AS mid_luteal_progesterone,
    NOT ovulated OR coalesce(coalesce(mid, late) < 5, false) AS ilp_flag FROM ilp0),
day AS (SELECT cd.*, coalesce(n, 0) + CASE WHEN cd.participant_id % 5 = 0 AND cycle_day IN (1, 2) THEN 1 ELSE 0 END AS seizure_count,
    (coalesce(n, 0) + CASE WHEN cd.participant_id % 5 = 0 AND cycle_day IN (1, 2) THEN 1 ELSE 0 END > 0)::INT AS seizure_day, mid_luteal_progesterone, ilp_flag
    FROM cd LEFT JOIN evd USING (participant_id, calendar_day_index) JOIN ilp USING (participant_id, cycle_id))"""
)

STRICT = "CASE WHEN cycle_day < 1 OR cycle_day > cycle_length THEN NULL WHEN cycle_day <= 3 OR bd >= -3 THEN 'M' WHEN cycle_day <= 9 THEN 'F' WHEN bd <= -13 THEN 'O' ELSE 'L' END"
SHORT = f"CASE WHEN cycle_length >= 23 THEN {STRICT} WHEN cycle_day < 1 OR cycle_day > cycle_length THEN NULL WHEN cycle_day <= 3 OR bd >= -3 THEN 'M' WHEN bd BETWEEN -19 AND -13 THEN 'O' WHEN bd BETWEEN -12 AND -4 THEN 'L' ELSE 'F' END"
ANCHORED = "CASE WHEN cycle_day < 1 OR cycle_day > cycle_length THEN NULL WHEN cycle_day <= 3 OR bd >= -3 THEN 'M' WHEN bd BETWEEN -12 AND -4 THEN 'L' WHEN bd BETWEEN -16 AND -13 THEN 'O' ELSE 'F' END"
REDDY = "CASE WHEN cycle_day < 1 OR cycle_day > cycle_length THEN NULL WHEN cycle_day <= 3 OR bd >= -3 THEN 'P' WHEN cycle_day <= 9 THEN 'F' WHEN cycle_day <= 16 THEN 'O' ELSE 'L' END"

LABELLED = (
    DAYS
    + f""",
modes AS (SELECT * FROM (VALUES ('healthy_ovulatory', 'strict_herzog'), ('population', 'strict_herzog'), ('population', 'modified_short_cycle')) m(cohort, phase_mode)),
bday AS (SELECT day.*, cycle_day - (cycle_length + 1) AS bd FROM day),
lab AS (SELECT bday.* EXCLUDE (bd), bd AS backward_day, phase_mode, CASE WHEN phase_mode = 'strict_herzog' THEN {STRICT} ELSE {SHORT} END AS phase, {REDDY} AS phase_reddy,
    cycle_length BETWEEN 23 AND 35 AS strict_herzog_cycle_eligible, phase_mode = 'modified_short_cycle' AS short_cycle_modified_flag FROM bday JOIN modes USING (cohort))"""
)


def sha(*parts: str) -> str:
    return "('0x' || substr(sha256(concat_ws('|', " + ", ".join(["'1'", *parts]) + ")), 1, 8))::BIGINT"


SPANS = "span AS (SELECT participant_id, max(cohort) AS cohort, max(calendar_day_index) AS total_days FROM day GROUP BY 1)"


def calendar(name: str, months: str, kind: str = "calendar", repeats: int = 1) -> str:
    return f"""
{name} AS (SELECT participant_id, cohort, 'calendar' AS window_type, m::VARCHAR AS window_value, q::INT AS window_seq, m*30 <= total_days AS valid,
    CASE WHEN m*30 <= total_days THEN 1 + {sha('participant_id', f"'{kind}'", 'm', 'q')} % greatest(total_days - m*30 + 1, 1) END AS start_day,
    CASE WHEN m*30 <= total_days THEN m*30 + {sha('participant_id', f"'{kind}'", 'm', 'q')} % greatest(total_days - m*30 + 1, 1) END AS end_day,
    CASE WHEN m*30 > total_days THEN 'calendar_window_longer_than_diary' END AS invalid_reason
    FROM span, (SELECT unnest([{months}]) AS m), generate_series(1, {repeats}) g(q) WHERE m*30 <= total_days OR q = 1)"""


COMPLETE = """
cyn AS (SELECT *, sum(new) OVER (PARTITION BY participant_id ORDER BY calendar_day_index)::BIGINT AS cycle_run FROM (SELECT *, (lag(cycle_id) OVER (PARTITION BY participant_id ORDER BY calendar_day_index) IS DISTINCT FROM cycle_id)::INT AS new FROM day)),
cycall AS (SELECT participant_id, cycle_id, cycle_run, count(*) AS n_days, min(cycle_day) AS first_cycle_day, max(cycle_day) AS last_cycle_day, arg_min(cycle_length, calendar_day_index) AS cycle_length, min(calendar_day_index) AS first_day,
    max(calendar_day_index) AS last_day, bool_and(cycle_length BETWEEN 23 AND 35) AS strict_cycle_flag, count(*) = arg_min(cycle_length, calendar_day_index) AND min(cycle_day) = 1 AND max(cycle_day) = arg_min(cycle_length, calendar_day_index) AS complete_cycle_flag FROM cyn GROUP BY 1, 2, 3)"""
RUNS = f"""
cycid AS (SELECT participant_id, cycle_id, bool_or(complete_cycle_flag) AS complete_cycle_flag, min(first_day) AS first_day, max(last_day) AS last_day FROM cycall GROUP BY 1, 2),
isl AS (SELECT participant_id, cycle_id, first_day, last_day, cycle_id - row_number() OVER (PARTITION BY participant_id ORDER BY cycle_id) AS island FROM cycid WHERE complete_cycle_flag),
st AS (SELECT a.participant_id, n, a.cycle_id, a.first_day AS start_day, b.last_day AS end_day FROM (SELECT * FROM isl, (SELECT unnest([3, 6, 12]) AS n)) a JOIN isl b ON a.participant_id = b.participant_id AND a.island = b.island AND b.cycle_id = a.cycle_id + n - 1),
pick AS (SELECT *, row_number() OVER (PARTITION BY participant_id, n ORDER BY {sha('participant_id', "'cycle'", 'n', 'cycle_id')}, cycle_id) AS r FROM st),
wcyc AS (SELECT participant_id, cohort, 'cycle' AS window_type, n::VARCHAR AS window_value, 1 AS window_seq, start_day IS NOT NULL AS valid, start_day::BIGINT AS start_day, end_day::BIGINT AS end_day,
    CASE WHEN start_day IS NULL THEN 'not_enough_complete_cycles' END AS invalid_reason FROM (SELECT * FROM span, (SELECT unnest([3, 6, 12]) AS n)) LEFT JOIN (SELECT participant_id, n, start_day, end_day FROM pick WHERE r = 1) USING (participant_id, n))"""
WINDOWS = (
    SPANS + "," + calendar("wcal", "1, 3, 4, 6, 9, 12, 18, 24, 36") + "," + COMPLETE + "," + RUNS + """,
wfull AS (SELECT participant_id, cohort, 'full' AS window_type, 'full_diary' AS window_value, 1 AS window_seq, true AS valid, 1::BIGINT AS start_day, total_days::BIGINT AS end_day, NULL::VARCHAR AS invalid_reason FROM span),
win AS (SELECT * FROM wcal UNION ALL SELECT * FROM wfull UNION ALL SELECT * FROM wcyc)"""
)


def counted(windows: str = "win") -> str:
    per = ", ".join(
        f"coalesce(sum(CASE WHEN phase = '{p}' THEN 1 END), 0) AS days_{p}, coalesce(sum(CASE WHEN phase = '{p}' THEN seizure_count END), 0) AS events_{p}, "
        f"coalesce(sum(CASE WHEN phase = '{p}' AND ilp_flag THEN 1 END), 0) AS ilp_days_{p}, coalesce(sum(CASE WHEN phase = '{p}' AND ilp_flag THEN seizure_count END), 0) AS ilp_events_{p}"
        for p in "MOFL"
    )
    reddy = ", ".join(f"coalesce(sum(CASE WHEN phase_reddy = '{p}' THEN 1 END), 0) AS reddy_days_{p}, coalesce(sum(CASE WHEN phase_reddy = '{p}' THEN seizure_count END), 0) AS reddy_events_{p}" for p in "PFOL")
    return f"""
cnt AS (SELECT w.participant_id, w.cohort, m.phase_mode, window_type, window_value, window_seq, valid, start_day, end_day, invalid_reason, count(l.participant_id) AS n_days, coalesce(sum(seizure_count), 0) AS seizure_count_total,
    coalesce(sum(seizure_day), 0) AS seizure_days_total, coalesce(sum(seizure_count * seizure_count), 0) AS squares, coalesce(bool_and(strict_herzog_cycle_eligible), false) AS strict_herzog_eligible_flag,
    coalesce(bool_or(short_cycle_modified_flag), false) AS short_cycle_modified_flag, coalesce(bool_or(ilp_flag), false) AS any_ilp, coalesce(bool_or(cycle_length < 23), false) AS any_short, count(phase) AS labelled_days, {per}, {reddy},
    coalesce(sum(CASE WHEN cycle_day BETWEEN 1 AND 4 OR backward_day BETWEEN -3 AND -1 THEN seizure_count END), 0) AS h1_events, coalesce(sum(CASE WHEN cycle_day BETWEEN 1 AND 6 OR backward_day BETWEEN -4 AND -1 THEN seizure_count END), 0) AS h2_events
    FROM {windows} w JOIN modes m USING (cohort) LEFT JOIN lab l ON w.valid AND l.participant_id = w.participant_id AND l.phase_mode = m.phase_mode AND l.calendar_day_index BETWEEN w.start_day AND w.end_day
    GROUP BY ALL)"""


def rr(nc: str, nd: str, cc: str, cd: str) -> str:
    """The ratio, infinite over zero and null where undefined."""
    return f"CASE WHEN {nd} > 0 AND {cd} > 0 THEN CASE WHEN {cc} > 0 THEN ({nc})::DOUBLE / {nd} / (({cc})::DOUBLE / {cd}) WHEN {nc} > 0 THEN 'Infinity'::DOUBLE END END"


def why(nc: str, nd: str, cc: str, cd: str) -> str:
    return f"CASE WHEN {nd} <= 0 THEN 'missing_numerator_phase' WHEN {cd} <= 0 THEN 'missing_comparator_phase' WHEN {nc} = 0 AND {cc} = 0 THEN 'undefined_zero_over_zero' END"


_C1 = ("events_M", "days_M", "(CASE WHEN short_cycle_modified_flag AND any_short THEN events_L ELSE events_F + events_L END)", "(CASE WHEN short_cycle_modified_flag AND any_short THEN days_L ELSE days_F + days_L END)")
_C2 = ("events_O", "days_O", "(events_F + events_L)", "(days_F + days_L)")
_C3 = ("(ilp_events_O + ilp_events_L + ilp_events_M)", "(ilp_days_O + ilp_days_L + ilp_days_M)", "ilp_events_F", "ilp_days_F")
_USE3 = "cohort = 'population' AND any_ilp AND n_days > 0"


def category(c1: str, c2: str, c3: str) -> str:
    return f"""CASE WHEN coalesce({c1}, {c2}, {c3}) IS NULL THEN NULL WHEN {c3} IS TRUE AND ({c1} IS TRUE OR {c2} IS TRUE) THEN 'C3 plus C1/C2' WHEN {c3} IS TRUE THEN 'C3 only'
    WHEN {c1} IS TRUE AND {c2} IS TRUE THEN 'C1+C2' WHEN {c1} IS TRUE THEN 'C1 only' WHEN {c2} IS TRUE THEN 'C2 only' ELSE 'none' END"""


def family(name: str) -> str:
    a, b, c = (f"label_{name}_{p}" for p in ("C1", "C2", "C3"))
    return f"greatest({a}, {b}, {c}) AS label_{name}_any, greatest({a}, {b}) AS label_{name}_C1_or_C2, greatest({a}, {b}) AS label_{name}_excluding_C3, {category(a, b, c)} AS label_{name}_pattern_category"


CYCLE_LABELS = f"""
cl0 AS (SELECT participant_id, phase_mode, cycle_id, max(cohort) AS cohort, min(calendar_day_index) AS first_day, max(calendar_day_index) AS last_day, bool_and(strict_herzog_cycle_eligible) AS strict, bool_or(ilp_flag) AS ilp,
    bool_or(ovulatory_flag) AS ov, {", ".join(f"coalesce(sum(CASE WHEN phase = '{p}' THEN 1 END), 0) AS day_{p}, coalesce(sum(CASE WHEN phase = '{p}' THEN seizure_count END), 0) AS ev_{p}" for p in "MOFL")}
    FROM lab GROUP BY 1, 2, 3 HAVING count(*) = max(cycle_length) AND min(cycle_day) = 1 AND max(cycle_day) = max(cycle_length)),
cl AS (SELECT participant_id, phase_mode, cycle_id, cohort, first_day, last_day, strict, ilp, CASE WHEN ov THEN {rr('ev_M', 'day_M', '(ev_F + ev_L)', '(day_F + day_L)')} >= 1.69 ELSE false END AS c1,
    CASE WHEN ov THEN {rr('ev_O', 'day_O', '(ev_F + ev_L)', '(day_F + day_L)')} >= 1.83 ELSE false END AS c2, CASE WHEN cohort = 'population' AND ilp THEN {rr('(ev_O + ev_L + ev_M)', '(day_O + day_L + day_M)', 'ev_F', 'day_F')} >= 1.62 ELSE false END AS c3 FROM cl0),
cc AS (SELECT c.participant_id, c.phase_mode, window_type, window_value, window_seq, count(*) AS n_complete_cycles, count_if(ilp) AS n_ilp_cycles, count_if(strict) AS n_strict_cycles,
    count_if(c1) AS c1_yes, count_if(c1 IS NULL) AS c1_unknown, count_if(c2) AS c2_yes, count_if(c2 IS NULL) AS c2_unknown, count_if(ilp AND c3) AS c3_yes, count_if(ilp AND c3 IS NULL) AS c3_unknown,
    count_if(strict AND (c1 OR c2 OR c3)) AS exact_any_yes, count_if(strict AND (c1 OR c2 OR c3) IS NULL) AS exact_any_unknown, count_if(strict AND c1) AS exact_c1_yes, count_if(strict AND c1 IS NULL) AS exact_c1_unknown,
    count_if(strict AND c2) AS exact_c2_yes, count_if(strict AND c2 IS NULL) AS exact_c2_unknown, count_if(strict AND c3) AS exact_c3_yes, count_if(strict AND c3 IS NULL) AS exact_c3_unknown
    FROM cl c JOIN win w ON w.valid AND c.participant_id = w.participant_id AND first_day >= start_day AND last_day <= end_day GROUP BY ALL)"""


def repro(p: str, n: str) -> str:
    pooled = f"label_A_windowed_{p.upper()}"
    return f"CASE WHEN {p}_yes >= (2*{n} + 2) // 3 AND {pooled} IS TRUE THEN true WHEN {pooled} IS NOT NULL AND {p}_unknown = 0 THEN false END"


def c_family(name: str, least: int) -> str:
    ok = f"phase_mode = 'strict_herzog' AND n_complete_cycles >= {least} AND n_days > 0"
    return f"""CASE WHEN {ok} THEN {repro('c1', 'n_complete_cycles')} END AS label_{name}_C1, CASE WHEN {ok} THEN {repro('c2', 'n_complete_cycles')} END AS label_{name}_C2,
    CASE WHEN {ok} AND cohort = 'population' AND n_ilp_cycles >= {least} AND label_A_windowed_C3 IS NOT NULL THEN {repro('c3', 'n_ilp_cycles')} END AS label_{name}_C3,
    CASE WHEN n_days > 0 THEN CASE WHEN phase_mode <> 'strict_herzog' THEN 'reproducibility_not_evaluated_for_phase_mode' WHEN NOT ({ok}) THEN 'fewer_than_required_complete_cycles' END END AS {name.lower()}_reason"""


_EXACT = "phase_mode = 'strict_herzog' AND window_type = 'cycle' AND window_value = '3' AND n_days > 0"


def exact(p: str) -> str:
    return f"CASE WHEN {_EXACT} AND n_strict_cycles = 3 THEN CASE WHEN exact_{p}_yes >= 2 THEN true WHEN exact_{p}_unknown = 0 THEN false END END"


_H = "phase_mode = 'strict_herzog' AND n_days > 0"
_TWICE = {p: f"CASE WHEN {_H} THEN {rr(f'reddy_events_{p}', f'reddy_days_{p}', f'(seizure_count_total - reddy_events_{p})', f'(n_days - reddy_days_{p})')} >= 2 END" for p in "PFOL"}

CLASSIFIED = (
    LABELLED + "," + WINDOWS + "," + counted() + "," + CYCLE_LABELS + f""",
c0 AS (SELECT cnt.*, seizure_days_total / (n_days / 30.0::DOUBLE) AS seizure_days_per_month_, coalesce(n_complete_cycles, 0) AS n_complete_cycles, coalesce(n_ilp_cycles, 0) AS n_ilp_cycles, coalesce(n_strict_cycles, 0) AS n_strict_cycles,
    {", ".join(f"coalesce({x}_yes, 0) AS {x}_yes, coalesce({x}_unknown, 0) AS {x}_unknown" for x in ("c1", "c2", "c3", "exact_any", "exact_c1", "exact_c2", "exact_c3"))}
    FROM cnt LEFT JOIN cc USING (participant_id, phase_mode, window_type, window_value, window_seq)),
c1t AS (SELECT * EXCLUDE (seizure_days_per_month_), CASE WHEN n_days > 0 THEN seizure_days_per_month_ END AS seizure_days_per_month, CASE WHEN n_days > 0 THEN seizure_count_total / (n_days / 30.0::DOUBLE) END AS seizures_per_month,
    cohort = 'population' AND any_ilp AS c3_applicable_flag, valid AND labelled_days > 0 AS analyzable_flag,
    CASE WHEN n_days > 0 THEN {rr(*_C1)} END AS rr_C1, CASE WHEN n_days > 0 THEN {rr(*_C2)} END AS rr_C2, CASE WHEN {_USE3} THEN {rr(*_C3)} END AS rr_C3,
    CASE WHEN n_days > 0 THEN {why(*_C1)} END AS reason_C1, CASE WHEN n_days > 0 THEN {why(*_C2)} END AS reason_C2, CASE WHEN {_USE3} THEN {why(*_C3)} END AS reason_C3 FROM c0),
c2t AS (SELECT *, rr_C1 >= 1.69 AS label_A_windowed_C1, rr_C2 >= 1.83 AS label_A_windowed_C2, rr_C3 >= 1.62 AS label_A_windowed_C3, coalesce(reason_C1, reason_C2, reason_C3) AS a_windowed_reason,
    CASE WHEN seizure_days_total < 4 THEN 'seizure_days_below_minimum' WHEN NOT (coalesce(n_days / 30.0::DOUBLE >= 4, false) OR (window_type = 'cycle' AND coalesce(TRY_CAST(window_value AS INT) >= 6, false))) THEN 'window_duration_below_minimum' END AS data_reason FROM c1t),
c3t AS (SELECT *, {family('A_windowed')}, {", ".join(f"CASE WHEN data_reason IS NULL AND n_days > 0 THEN label_A_windowed_{p} END AS label_B_{p}" for p in ("C1", "C2", "C3"))},
    CASE WHEN n_days > 0 THEN coalesce(data_reason, a_windowed_reason) END AS b_reason, {c_family('C', 6)}, {c_family('C12', 12)},
    {exact('any')} AS label_A_exact_any, {exact('c1')} AS label_A_exact_C1, {exact('c2')} AS label_A_exact_C2, CASE WHEN cohort = 'population' THEN {exact('c3')} END AS label_A_exact_C3,
    CASE WHEN {_H} AND seizure_count_total > 0 THEN h1_events::DOUBLE / seizure_count_total END AS h1_share, CASE WHEN {_H} AND seizure_count_total > 0 THEN h2_events::DOUBLE / seizure_count_total END AS h2_share,
    CASE WHEN {_H} THEN rr_C1 >= 2 END AS label_H3_C1, CASE WHEN {_H} THEN rr_C2 >= 2 END AS label_H3_C2, CASE WHEN {_H} THEN rr_C3 >= 2 END AS label_H3_C3,
    {", ".join(f"{v} AS h4_{p}" for p, v in _TWICE.items())} FROM c2t),
cw AS (SELECT *, {family('B')}, {family('C')}, {family('C12')}, CASE WHEN n_days > 0 THEN CASE WHEN phase_mode <> 'strict_herzog' THEN 'exact_herzog_only_evaluated_for_strict_herzog_phase_mode'
    WHEN NOT ({_EXACT}) THEN 'exact_herzog_only_applies_to_three_cycle_windows' WHEN n_strict_cycles <> 3 THEN 'requires_three_complete_strict_23_35_day_cycles' WHEN label_A_exact_any IS NULL THEN 'undefined_cycle_ratio' END END AS a_exact_reason,
    h1_share > 0.5 AS label_H1_any, h1_share > 0.667 AS label_H1_sensitivity_any, h2_share >= 0.75 AS label_H2_any, greatest(label_H3_C1, label_H3_C2, label_H3_C3) AS label_H3_any, greatest(h4_P, h4_F, h4_O, h4_L) AS label_H4_any,
    nullif(concat_ws(',', CASE WHEN h4_P THEN 'P' END, CASE WHEN h4_F THEN 'F' END, CASE WHEN h4_O THEN 'O' END, CASE WHEN h4_L THEN 'L' END), '') AS label_H4_phase FROM c3t),
w AS (SELECT *, coalesce(CASE WHEN n_days = 0 THEN coalesce(invalid_reason, 'invalid_window') END, a_exact_reason, a_windowed_reason, b_reason, c_reason) AS indeterminate_reason FROM cw)"""
)
