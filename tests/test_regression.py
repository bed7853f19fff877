"""Definition D: closed form, cycle effects, robust fallback, shared fits and the gates before a fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import definitions as X
from tidemark.operators import diary as D
from tidemark.operators import glm as G

SCHEMA = "participant_id long, cohort string, calendar_day_index int, cycle_id int, cycle_day int, cycle_length int, seizure_count int, seizure_day int, ovulatory_flag boolean, ilp_flag boolean"
WINDOW = "participant_id long, cohort string, window_type string, window_value string, window_seq int, valid boolean, start_day long, end_day long, invalid_reason string"


def diary(spark, count, cycles=12, length=28, cohort="healthy_ovulatory", people=1, ilp=False):
    """``count(person, cycle, day)`` events."""
    rows = []
    for p in range(1, people + 1):
        for c in range(cycles):
            for d in range(1, length + 1):
                n = count(p, c, d)
                rows.append((p, cohort, c * length + d, c + 1, d, length, n, int(n > 0), True, ilp))
    return D.fan_out_phase_modes(spark.createDataFrame(rows, SCHEMA))


def fitted(spark, daily, kind, value, days, alphas=None, **more):
    own = daily.select("participant_id", "cohort").distinct().collect()
    windows = spark.createDataFrame([(r.participant_id, r.cohort, kind, value, 1, True, 1, days, None) for r in own], WINDOW)
    return G.label_d(daily, windows, X.classify_windows(daily, windows), alphas, **more)


def fixed(spark, people, alpha):
    return spark.createDataFrame([(p, alpha) for p in range(1, people + 1)], "participant_id long, alpha double")


def test_menstrual_enrichment_is_positive_and_flat_counts_are_not(spark):
    daily = diary(spark, lambda p, c, d: 5 if d <= 3 or d >= 26 else 1)
    r = fitted(spark, daily, "cycle", "12", 336, fixed(spark, 1, 1.0)).first()
    assert r.label_D_C1 and r.label_D_any and r.label_D_pattern_category == "C1 only" and r.d_reason is None
    r = fitted(spark, diary(spark, lambda p, c, d: 1), "cycle", "12", 336, fixed(spark, 1, 1.0)).first()
    assert r.label_D_any is False and r.d_beta_M == pytest.approx(0, abs=1e-6)


def test_gates_before_a_fit(spark):
    reason = lambda *a: fitted(spark, *a, fixed(spark, 1, 1.0)).first().d_reason
    assert reason(diary(spark, lambda p, c, d: int(c == 0 and d < 4)), "cycle", "12", 336) == "seizure_days_below_minimum"
    assert reason(diary(spark, lambda p, c, d: 1, cycles=3), "calendar", "1", 84) == "window_duration_below_minimum"


def test_closed_form_equals_the_iterated_fit(spark):
    rng = np.random.default_rng(3)
    counts = rng.poisson(rng.gamma(0.5, 1, (30, 5, 42)))
    daily = diary(spark, lambda p, c, d: int(counts[p - 1, c, d - 1]), cycles=3, length=42, people=30)
    alphas = fixed(spark, 30, 0.7)
    out = {r.participant_id: r for r in fitted(spark, daily, "calendar", "4", 126, alphas).collect()}
    cells = {}
    strict = daily.where("phase_mode = 'strict_herzog' and phase is not null").groupBy("participant_id", "phase").agg(F.count("*").alias("n"), F.sum("seizure_count").alias("e"))
    for r in strict.collect():
        g = {"M": 1, "O": 2}.get(r.phase, 0)
        n, e = cells.setdefault(r.participant_id, {}).get(g, (0, 0))
        cells[r.participant_id][g] = n + r.n, e + r.e
    seen = 0
    for p, r in out.items():
        if r.d_reason not in (None, "separated"):
            continue
        seen += 1
        groups = sorted(cells[p])
        got = G.fit_cells(np.zeros(len(groups), int), np.array(groups), np.array([cells[p][g][0] for g in groups]), np.array([cells[p][g][1] for g in groups]), 0.7)
        for (beta, _), mine in zip(got, (r.d_beta_M, r.d_beta_O), strict=True):
            assert (beta is None) == (mine is None) and (beta is None or mine == pytest.approx(beta, abs=1e-9))
    assert seen > 20
    form = G.closed_form(spark.createDataFrame([(4, 9, 6, 12, 20, 50, 10, 30, 0.3)], "events_M int, days_M int, events_O int, days_O int, events_F int, days_F int, events_L int, days_L int, alpha double"), "alpha").first()
    want = G.fit_cells(np.zeros(3, int), np.array([0, 1, 2]), np.array([80, 9, 12]), np.array([30, 4, 6]), 0.3)
    assert (form.beta_1, form.se_1, form.beta_2, form.se_2) == pytest.approx(tuple(v for x in want for v in x), abs=1e-9)


def rowwise_poisson(cycle, group, y):
    """Poisson regression with HC0 errors over single days."""
    ids = np.unique(cycle)
    x = np.concatenate([(cycle[:, None] == ids).astype(float), (group[:, None] == [1, 2]).astype(float)], 1)
    beta = np.zeros(x.shape[1])
    for _ in range(200):
        mu = np.exp(x @ beta)
        beta = beta + np.linalg.solve(x.T @ (mu[:, None] * x), x.T @ (y - mu))
    mu = np.exp(x @ beta)
    bread = np.linalg.inv(x.T @ (mu[:, None] * x))
    cov = bread @ (x.T @ (((y - mu) ** 2)[:, None] * x)) @ bread
    k = len(ids)
    return [(beta[k + i], np.sqrt(cov[k + i, k + i])) for i in range(2)]


def day_cells(cycle, group, y):
    keys = sorted(set(zip(cycle.tolist(), group.tolist(), strict=True)))
    part = [y[(cycle == c) & (group == g)] for c, g in keys]
    return np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([len(v) for v in part]), np.array([v.sum() for v in part]), np.array([(v**2).sum() for v in part])


@pytest.mark.parametrize("cycles", [1, 5])
def test_robust_fit_equals_single_days(cycles):
    rng = np.random.default_rng(cycles)
    cycle, group = np.repeat(np.arange(cycles), 28), np.tile(np.repeat([1, 0, 2, 0], 7), cycles)
    y = rng.poisson(1 + group).astype(float)
    got = G.fit_poisson_robust(*day_cells(cycle, group, y))
    for a, b in zip(got, rowwise_poisson(cycle, group, y), strict=True):
        assert a == pytest.approx(b, abs=1e-8)


def test_failed_fits_fall_back(spark):
    daily = diary(spark, lambda p, c, d: (d + c) % 3)
    r = fitted(spark, daily, "cycle", "12", 336, fixed(spark, 1, -1.0)).first()
    assert r.d_reason == "poisson_robust_fallback" and r.label_D_any is not None
    strict = daily.where("phase_mode = 'strict_herzog' and phase is not null").toPandas()
    group = strict.phase.map({"M": 1, "O": 2}).fillna(0).astype(int).to_numpy()
    want = rowwise_poisson(strict.cycle_id.to_numpy(), group, strict.seizure_count.to_numpy().astype(float))
    assert (r.d_beta_M, r.d_beta_O) == pytest.approx((want[0][0], want[1][0]), abs=1e-8)


def test_equal_dispersions_share_one_fit(spark, monkeypatch):
    daily = diary(spark, lambda p, c, d: (d * p + c) % 4 + 2 * (d == 15), people=3)
    own = daily.where("phase_mode = 'strict_herzog'").groupBy("participant_id").agg(F.count("*").alias("n"), F.sum("seizure_count").alias("s"), F.sum(F.col("seizure_count") ** 2).alias("q"))
    alphas = own.select("participant_id", F.when(F.col("participant_id") == 1, 2.5).otherwise(X.nb_alpha("n", "s", "q")).alias("alpha"))
    seen = []
    fit = G.fit_windows
    monkeypatch.setattr(G, "fit_windows", lambda cells, keys: seen.append(cells.select(*keys).distinct().count()) or fit(cells, keys))
    out = fitted(spark, daily, "full", "full_diary", 336, alphas, both=True)
    assert seen == [4]  # two dispersions for one participant, one for each of the others
    assert out._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == 1
    rows = {r.participant_id: r for r in out.collect()}
    assert rows[1].d_alpha == 2.5 != rows[1].d_window_alpha and rows[1].d_p_adj_O != rows[1].d_window_p_adj_O
    for p in (2, 3):
        assert rows[p].d_alpha == rows[p].d_window_alpha and rows[p].d_beta_M == rows[p].d_window_beta_M and rows[p].label_D_any == rows[p].label_D_window_alpha_any


def c3(spark, daily, alpha=0.2):
    return G.label_d_c3(daily, D.complete_cycles(daily.where("phase_mode = 'strict_herzog'")), fixed(spark, 1, alpha)).first()


PHASES = ["M", "M", "M", "F", "F", "F", "O", "O", "L", "L"]


def ilp_diary(spark, cycles, f, other, cohort="population", drop=None):
    rows = []
    for c in range(1, cycles + 1):
        for d, p in enumerate(PHASES, 1):
            n = f if p == "F" else other
            rows.append((1, cohort, (c - 1) * 10 + d, c, d, 10, n, int(n > 0), True, True, None if p == drop else p, "strict_herzog"))
    return spark.createDataFrame(rows, SCHEMA + ", phase string, phase_mode string")


@pytest.mark.parametrize(("cycles", "f", "other", "cohort", "drop", "reason"), [
    (4, 0, 1, "healthy_ovulatory", None, "not_applicable_to_cohort"), (3, 0, 1, "population", None, "fewer_than_required_complete_ilp_cycles"), (8, 1, 4, "population", "F", "missing_follicular_phase"),
    (4, 0, 0, "population", None, "seizure_days_below_minimum"),
])
def test_c3_gates(spark, cycles, f, other, cohort, drop, reason):
    r = c3(spark, ilp_diary(spark, cycles, f, other, cohort, drop))
    assert r.label_D_C3_exploratory is None and r.d_c3_reason == reason


def test_c3_finds_enrichment_and_leaves_the_null(spark):
    r = c3(spark, ilp_diary(spark, 8, 1, 4))
    assert r.label_D_C3_exploratory is True and r.d_c3_rr >= 1.62 and r.d_c3_reason is None
    assert c3(spark, ilp_diary(spark, 8, 1, 1)).label_D_C3_exploratory is False


def test_windows_fitted_side_by_side_equal_single_fits():
    rng, cells, alphas, cycles = np.random.default_rng(1), [], [], 0
    for w in range(200):
        alphas.append(float(rng.choice([0.001, 0.3, 1.0, 5.0, -1.0])))
        mean = rng.choice([0.02, 0.1, 1.0])
        for _ in range(int(rng.integers(4, 40))):
            for g in range(3):
                n = int(rng.integers(3, 14))
                if rng.random() < 0.9:
                    cells.append((w, cycles, g, n, int(rng.poisson(mean * n))))
            cycles += 1
        # cycles of one phase group each tell nothing of the others: to be fitted alone
    cells += [(200, cycles + i, i % 3, 9, 5) for i in range(6)]
    alphas.append(0.3)
    w, c, g, n, e = (np.array(x) for x in zip(*cells, strict=True))
    beta, error, alone = G._side_by_side(w, c, g, n, e, np.array(alphas))
    assert alone[200] and 0 < alone.sum() < 100
    for i in np.flatnonzero(~alone):
        at = w == i
        for k, (b, s) in enumerate(G.fit_cells(c[at], g[at], n[at], e[at], alphas[i])):
            assert np.isnan(beta[i, k]) if b is None else (beta[i, k], error[i, k]) == pytest.approx((b, s), abs=1e-8)


def test_dispersion_where_variance_equals_mean(spark):
    # 81 events on 1,080 days with 87 as sum of squares: variance and mean are equal, so there is no overdispersion
    got = spark.createDataFrame([(1080, 81, 87), (1080, 1, 1), (1080, 81, 89)], "n long, s long, q long").select(X.nb_alpha("n", "s", "q").alias("a")).collect()
    assert [r.a for r in got[:2]] == [1.0, 1.0] and got[2].a == pytest.approx((1080 * 89 - 81**2 - 81 * 1079) * 1080 / (1079 * 81**2))
