"""Definition D: grouped negative-binomial regression of daily counts on the phase.

Days of one cycle and phase group share their mean, so (n, events) of each cell are
sufficient. The log link has an effect for each cycle where four or more cycles are complete: Spark
aggregates the cells, and the fit of each window (at most three cells a cycle) runs in one small group.
Cycles without events tell nothing about the phases and are left out. With fewer complete cycles the fit is a column expression. Where a
phase group has no events the estimate diverges and its Wald statistic
tends to 0: the label is then false, p 0.5 and the ratio null. A fit that fails gives way to a Poisson fit with robust errors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .definitions import PHASES, complete_cycles_inside, minimum_data_reason, nb_alpha, window_counters
from .windows import KEYS, subset_window

FIT = "beta_1 double, se_1 double, beta_2 double, se_2 double, robust boolean"
#: Windows with fewer complete cycles have no cycle effects: their fit has a closed form.
CYCLE_EFFECTS = 4
Estimates = list[tuple[float | None, float | None]]


def _design(cycle: np.ndarray, group: np.ndarray, events: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, int]:
    """The cells that tell something about the phases, the groups that have an estimate, the matrix with a column for each cycle and then each of these
    groups, and the number of cycles; no groups where the fit is separated."""
    use = np.isin(cycle, [c for c in np.unique(cycle) if events[cycle == c].sum() > 0])
    some = [g for g in (1, 2) if events[use & (group == g)].sum() > 0]
    if not events[use & (group == 0)].sum() or not some:
        return use, [], np.zeros((0, 0)), 0
    use &= np.isin(group, [0, *some])
    ids, place = np.unique(cycle[use], return_inverse=True)
    x = np.zeros((int(use.sum()), len(ids) + len(some)))
    x[np.arange(len(x)), place] = 1
    for k, g in enumerate(some):
        x[:, len(ids) + k] = group[use] == g
    return use, some, x, len(ids)


def _estimates(some: list[int], first: int, beta: np.ndarray, variance: np.ndarray) -> Estimates:
    out: Estimates = [(None, None), (None, None)]
    if not np.isfinite(beta).all() or not np.isfinite(variance).all():
        raise FloatingPointError("the fit has no finite estimate")
    for k, g in enumerate(some):
        out[g - 1] = float(beta[first + k]), float(math.sqrt(max(variance[first + k, first + k], 0)))
    return out


def fit_cells(cycle: np.ndarray, group: np.ndarray, n: np.ndarray, events: np.ndarray, alpha: float, rounds: int = 100) -> Estimates:
    """Log rate ratios of groups 1 and 2 against 0 with their standard errors, (None, None) where separated. Raises
    ``FloatingPointError`` or ``LinAlgError`` where the fit fails."""
    use, some, x, first = _design(cycle, group, events)
    if not some:
        return [(None, None), (None, None)]
    if not 0 < alpha < math.inf:
        raise FloatingPointError("the dispersion must be positive and finite")
    n, events = n[use].astype(float), events[use].astype(float)
    rate = events / n
    mu = (rate + events.sum() / n.sum()) / 2
    eta, before = np.log(mu), math.inf
    for _ in range(rounds):
        w = n * mu / (1 + alpha * mu)
        inverse = np.linalg.pinv(x.T @ (w[:, None] * x))
        beta = inverse @ (x.T @ (w * (eta + (rate - mu) / mu)))
        eta = np.clip(x @ beta, -50, 50)
        mu = np.exp(eta)
        fit = float((n * (rate * eta - (rate + 1 / alpha) * np.log1p(alpha * mu))).sum())
        if abs(fit - before) < 1e-10:
            break
        before = fit
    inverse = np.linalg.pinv(x.T @ ((n * mu / (1 + alpha * mu))[:, None] * x))
    return _estimates(some, first, beta, inverse)


def fit_poisson_robust(cycle: np.ndarray, group: np.ndarray, n: np.ndarray, events: np.ndarray, squares: np.ndarray, rounds: int = 100) -> Estimates:
    """The same ratios by a Poisson regression with heteroscedasticity-consistent (HC0) standard errors.

    Days of a cell share their mean ``mu``, so their squared residuals add up to ``squares - 2 mu events + n mu**2``.
    """
    use, some, x, first = _design(cycle, group, events)
    if not some:
        return [(None, None), (None, None)]
    n, events, squares = (v[use].astype(float) for v in (n, events, squares))
    rate = events / n
    mu = (rate + events.sum() / n.sum()) / 2
    eta, before = np.log(mu), math.inf
    for _ in range(rounds):
        w = n * mu
        beta = np.linalg.pinv(x.T @ (w[:, None] * x)) @ (x.T @ (w * (eta + (rate - mu) / mu)))
        eta = np.clip(x @ beta, -50, 50)
        mu = np.exp(eta)
        fit = float((n * (rate * eta - mu)).sum())
        if abs(fit - before) < 1e-10:
            break
        before = fit
    bread = np.linalg.pinv(x.T @ ((n * mu)[:, None] * x))
    meat = x.T @ ((squares - 2 * mu * events + n * mu**2)[:, None] * x)
    return _estimates(some, first, beta, bread @ meat @ bread)


#: Groups in which windows are fitted side by side, and the least share of a phase group's weight that must tell it from the cycles.
FIT_GROUPS, LEAST_SHARE = 1024, 1e-9


def _side_by_side(window: np.ndarray, cycle: np.ndarray, group: np.ndarray, n: np.ndarray, events: np.ndarray, alpha: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`fit_cells` of many windows at once: log ratios and standard errors (windows x 2, NaN where separated), and the windows whose fit
    must be made alone as its matrix is nearly singular, a number is not finite or the dispersion is not positive.

    ``cycle`` is numbered over all windows, ``alpha`` is a window's. The matrix of a window has a diagonal block of its cycles, so these are eliminated
    and two equations remain.
    """
    count, cycles = len(alpha), int(cycle.max()) + 1
    per = lambda at, v, size: np.bincount(at, v, size)
    use = per(cycle, events, cycles)[cycle] > 0
    total = np.stack([per(window, events * (use & (group == g)), count) for g in range(3)], 1) > 0
    fitted = total[:, 0] & (total[:, 1] | total[:, 2])
    alone = fitted & ~((alpha > 0) & (alpha < math.inf))
    use &= total[window, group] & (fitted & ~alone)[window]
    beta, error = np.full((count, 2), np.nan), np.full((count, 2), np.nan)
    if not use.any():
        return beta, error, alone
    w, c, g, n, e = window[use], cycle[use], group[use], n[use].astype(float), events[use].astype(float)
    own_cycle = np.zeros(cycles, dtype=np.int64)
    own_cycle[c] = w
    rate, a, some = e / n, alpha[w], total[:, 1:]
    mu = (rate + per(w, e, count)[w] / per(w, n, count)[w]) / 2
    eta, before, active = np.log(mu), np.full(count, math.inf), fitted & ~alone

    def reduced(v: np.ndarray):
        """Weights of cycles, of cycles and phase groups, and the matrix that remains."""
        ac = per(c, v, cycles)
        bc = np.stack([per(c, v * (g == k), cycles) for k in (1, 2)], 1)
        share = np.divide(bc, ac[:, None], out=np.zeros_like(bc), where=ac[:, None] > 0)
        weight = np.stack([per(w, v * (g == k), count) for k in (1, 2)], 1)
        s11, s22 = (weight[:, k] - per(own_cycle, bc[:, k] * share[:, k], count) for k in (0, 1))
        s12 = -per(own_cycle, bc[:, 0] * share[:, 1], count)
        poor = (some[:, 0] & ~(s11 > LEAST_SHARE * weight[:, 0])) | (some[:, 1] & ~(s22 > LEAST_SHARE * weight[:, 1]))
        s11, s22 = np.where(some[:, 0], s11, 1.0), np.where(some[:, 1], s22, 1.0)
        det = s11 * s22 - s12 * s12
        return ac, bc, share, s11, s12, s22, det, poor | ~(det > LEAST_SHARE * s11 * s22)

    with np.errstate(all="ignore"):
        for _ in range(rounds):
            v = n * mu / (1 + a * mu)
            ac, bc, share, s11, s12, s22, det, poor = reduced(v)
            z = v * (eta + (rate - mu) / mu)
            zc = per(c, z, cycles)
            t1, t2 = (per(w, z * (g == k + 1), count) - per(own_cycle, share[:, k] * zc, count) for k in (0, 1))
            new = np.stack([(s22 * t1 - s12 * t2) / det, (s11 * t2 - s12 * t1) / det], 1)
            beta[active] = new[active]
            alone |= active & (poor | ~np.isfinite(new).all(1))
            active = active & ~alone
            theta = np.divide(zc, ac, out=np.zeros_like(zc), where=ac > 0) - (share * new[own_cycle]).sum(1)
            turn = active[w]
            eta = np.where(turn, np.clip(theta[c] + np.where(g > 0, new[w, g - 1], 0.0), -50, 50), eta)
            mu = np.where(turn, np.exp(eta), mu)
            fit = per(w, n * (rate * eta - (rate + 1 / a) * np.log1p(a * mu)), count)
            active = active & ~(np.abs(fit - before) < 1e-10)
            before = fit
            if not active.any():
                break
        _, _, _, s11, s12, s22, det, poor = reduced(n * mu / (1 + a * mu))
        error = np.sqrt(np.stack([s22 / det, s11 / det], 1))
        alone |= fitted & (poor | ~np.isfinite(error).all(1))
    beta[~(some & fitted[:, None])] = error[~(some & fitted[:, None])] = np.nan
    return beta, error, alone


def fit_windows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Fits each group of ``keys`` over its cells ``cycle, grp, n, events, squares, alpha``; ``robust`` where the Poisson fit stands in for
    a negative-binomial one that failed. Windows are dealt into :data:`FIT_GROUPS` groups by hash and fitted side by side there."""
    names = ("beta_1", "se_1", "beta_2", "se_2")

    def one(rows: pd.DataFrame) -> tuple[Estimates, bool]:
        cells_ = [rows[c].to_numpy() for c in ("cycle", "grp", "n", "events")]
        try:
            return fit_cells(*cells_, float(rows["alpha"].iloc[0])), False
        except (FloatingPointError, np.linalg.LinAlgError):
            return fit_poisson_robust(*cells_, rows["squares"].to_numpy()), True

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        window = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(window, return_index=True)[1]
        cycle = pd.DataFrame({"w": window, "c": pdf["cycle"].to_numpy()}).groupby(["w", "c"], sort=False, dropna=False).ngroup().to_numpy()
        beta, error, alone = _side_by_side(window, cycle, pdf["grp"].to_numpy().astype(int), pdf["n"].to_numpy(), pdf["events"].to_numpy(), pdf["alpha"].to_numpy().astype(float)[first])
        out = pdf[keys].iloc[first].reset_index(drop=True)
        robust = np.zeros(len(out), dtype=bool)
        for w in np.flatnonzero(alone):
            got, robust[w] = one(pdf[window == w])
            beta[w], error[w] = (np.array([x[i] for x in got], dtype=float) for i in (0, 1))
        for name, v in zip(names, (beta[:, 0], error[:, 0], beta[:, 1], error[:, 1]), strict=True):
            out[name] = v  # NaN becomes null
        out["robust"] = robust
        return out

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    dealt = F.pmod(F.xxhash64(*keys), F.lit(FIT_GROUPS)).alias("_group")
    return cells.select(*keys, *[c for c in ("cycle", "grp", "n", "events", "squares", "alpha") if c not in keys], dealt).groupBy("_group").applyInPandas(fit, f"{kinds}, {FIT}")


def closed_form(df: DataFrame, alpha: str) -> DataFrame:
    """Adds ``beta_1, se_1, beta_2, se_2`` of groups M and O against the other labelled days, from the window's counters.

    Without cycle effects each group's mean is its own rate r, so the log ratio is that of two rates, and its variance
    ``(1 + alpha r) / events`` summed over both. Null where a group has no events.
    """
    e0, d0 = F.col("events_F") + F.col("events_L"), F.col("days_F") + F.col("days_L")
    part = lambda e, d: F.try_divide(1 + F.col(alpha) * F.try_divide(e, d), e)
    out = {}
    for k, p in ((1, "M"), (2, "O")):
        e, d = F.col(f"events_{p}"), F.col(f"days_{p}")
        ok = (e > 0) & (e0 > 0)
        out[f"beta_{k}"] = F.when(ok, F.log(F.try_divide(e, d)) - F.log(F.try_divide(e0, d0)))
        out[f"se_{k}"] = F.when(ok, F.sqrt(part(e, d) + part(e0, d0)))
    return df.withColumns(out)


def _p(beta: str, se: str):
    """One-sided Wald p; 0.5 where separated."""
    z = F.try_divide(F.col(beta), F.col(se))
    return F.when(F.col(beta).isNull(), 0.5).when(F.col(se) > 0, 1 - C.normal_cdf(z)).when(F.col(beta) > 0, 0.0).otherwise(1.0)


def fit_fields(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """What :func:`label_d` reads of the classified ``windows``, without classifying any: ``daily`` is labelled strictly, each day once."""
    modes = windows.select("cohort").distinct().withColumn("phase_mode", F.lit("strict_herzog"))
    columns = ["n_days", "seizure_count_total", "seizure_days_total", "squares", *[f"{k}_{p}" for p in PHASES for k in ("days", "events")]]
    out = window_counters(daily, windows, modes).select("phase_mode", *KEYS, "invalid_reason", *columns)
    return out.join(complete_cycles_inside(daily, windows), KEYS, "left").na.fill(0, ["n_complete_cycles"])


#: Columns of one dispersion's labels; of the window's own dispersion they begin with ``d_window_`` and ``label_D_window_alpha_``.
MEASURES = ["d_alpha", "d_beta_M", "d_beta_O", "d_rr_M", "d_rr_O", "d_p_adj_M", "d_p_adj_O", "label_D_C1", "label_D_C2", "label_D_any", "label_D_C1_or_C2", "label_D_pattern_category", "d_reason"]


def label_d(daily: DataFrame, windows: DataFrame, classified: DataFrame, alphas: DataFrame | None = None, both: bool = False) -> DataFrame:
    """``participant_id``, window keys and ``label_D_*, d_*`` for the windows given, strict labelling only.

    ``classified`` holds these windows, classified or as :func:`fit_fields` has them. ``alphas`` has ``participant_id, alpha`` (of the full diary); without it each window's own dispersion is used. With ``both`` there are the labels of both
    (:data:`MEASURES`); where the two dispersions agree, one fit serves both. Windows with fewer than four complete cycles have a closed form
    and read no days; the cells of the others are aggregated once for both dispersions.
    """
    base = classified.where("phase_mode = 'strict_herzog'").join(windows.select(*KEYS), KEYS, "left_semi")
    base = base.withColumn("window_alpha", nb_alpha("n_days", "seizure_count_total", "squares"))
    base = base.join(alphas, "participant_id", "left") if alphas is not None else base.withColumn("alpha", F.col("window_alpha"))
    labelled = sum((F.col(f"events_{p}") for p in PHASES), F.lit(0))
    reason = (
        F.when(F.col("n_days") == 0, F.coalesce("invalid_reason", F.lit("invalid_window"))).otherwise(minimum_data_reason())
    )
    reason = F.coalesce(reason, F.when(labelled <= 0, "no_labeled_seizure_data").when((F.col("days_M") == 0) | (F.col("days_O") == 0), "missing_m_or_o_phase"))
    base = base.withColumn("d_reason", reason).withColumn("kind", F.explode(F.array(*[F.lit(k) for k in (["", "window_"] if both else [""])])))
    base = base.withColumn("alpha", F.when(F.col("kind") == "window_", F.col("window_alpha")).otherwise(F.col("alpha")))
    run = F.col("d_reason").isNull()
    closed = closed_form(base.where(run & (F.col("n_complete_cycles") < CYCLE_EFFECTS)), "alpha").withColumn("robust", F.lit(False))
    fit = base.where(run & (F.col("n_complete_cycles") >= CYCLE_EFFECTS)).groupBy(*KEYS).agg(F.collect_set("alpha").alias("alphas"))
    fits = fit_windows(_cells(daily.where("phase_mode = 'strict_herzog'"), windows, fit), [*KEYS, "alpha"])
    columns = [*KEYS, "kind", "alpha", "d_reason"]
    estimates = ["beta_1", "se_1", "beta_2", "se_2", "robust"]
    rest = base.where(~(run & (F.col("n_complete_cycles") < CYCLE_EFFECTS))).select(*columns).join(fits, [*KEYS, "alpha"], "left")
    out = _labelled(closed.select(*columns, *estimates).unionByName(rest.select(*columns, *estimates)))
    if not both:
        return out.drop("kind")
    name = lambda m: m.replace("label_D_", "label_D_window_alpha_") if m.startswith("label") else m.replace("d_", "d_window_", 1)
    pick = lambda m, kind: F.max(F.when(F.col("kind") == kind, F.col(m)))
    return out.groupBy(*KEYS).agg(*[pick(m, "").alias(m) for m in MEASURES], *[pick(m, "window_").alias(name(m)) for m in MEASURES])


def _cells(days: DataFrame, windows: DataFrame, fit: DataFrame) -> DataFrame:
    """``cycle, grp, n, events, squares, alpha`` of the windows in ``fit``, for each of their dispersions."""
    grp = F.when(F.col("phase") == "M", 1).when(F.col("phase") == "O", 2).otherwise(0)
    c = F.col("seizure_count")
    inside = subset_window(days.where("phase is not null"), windows.join(fit.select(*KEYS), KEYS, "left_semi"))
    cells = inside.groupBy(*KEYS, F.col("cycle_id").alias("cycle"), grp.alias("grp")).agg(F.count("*").alias("n"), F.sum(c).alias("events"), F.sum(c * c).alias("squares"))
    return cells.join(fit, KEYS).withColumn("alpha", F.explode("alphas")).drop("alphas")


def _labelled(out: DataFrame) -> DataFrame:
    """Labels from the estimates."""
    run = F.col("d_reason").isNull()
    out = out.withColumn("p_m", F.when(run, _p("beta_1", "se_1"))).withColumn("p_o", F.when(run, _p("beta_2", "se_2")))
    adj_m, adj_o = C.holm_two("p_m", "p_o")
    out = out.withColumns({"d_p_adj_M": F.when(run, adj_m), "d_p_adj_O": F.when(run, adj_o), "d_rr_M": F.exp("beta_1"), "d_rr_O": F.exp("beta_2")})
    yes = lambda rr, p, t: F.when(run, F.coalesce((F.col(rr) >= C.THRESHOLDS[t]) & (F.col(p) < 0.05), F.lit(False)))
    out = out.withColumns({"label_D_C1": yes("d_rr_M", "d_p_adj_M", "C1"), "label_D_C2": yes("d_rr_O", "d_p_adj_O", "C2")})
    separated = run & (F.col("beta_1").isNull() | F.col("beta_2").isNull())
    return out.select(
        *KEYS, "kind", F.col("alpha").alias("d_alpha"), F.col("beta_1").alias("d_beta_M"), F.col("beta_2").alias("d_beta_O"), "d_rr_M", "d_rr_O", "d_p_adj_M", "d_p_adj_O", "label_D_C1", "label_D_C2",
        (F.col("label_D_C1") | F.col("label_D_C2")).alias("label_D_any"), (F.col("label_D_C1") | F.col("label_D_C2")).alias("label_D_C1_or_C2"),
        C.pattern_category("label_D_C1", "label_D_C2", F.lit(None).cast("boolean")).alias("label_D_pattern_category"),
        F.when(run & F.coalesce("robust", F.lit(False)), "poisson_robust_fallback").when(separated, "separated").otherwise(F.col("d_reason")).alias("d_reason"),
    )


def label_d_c3(daily: DataFrame, cycles: DataFrame, alphas: DataFrame, least_cycles: int = 4, least_days: int = 4, threshold: float = C.THRESHOLDS["C3"]) -> DataFrame:
    """Exploratory C3: all phases but F against F on complete cycles of inadequate luteal phase, always
    with cycle effects; a row a participant. ``cycles`` is :func:`complete_cycles`."""
    strict = daily.where("phase_mode = 'strict_herzog'")
    done = cycles.where("complete_cycle_flag").select("participant_id", "cycle_id")
    days = strict.join(done, ["participant_id", "cycle_id"], "left_semi").where("ilp_flag")
    by = days.groupBy("participant_id").agg(
        F.countDistinct("cycle_id").alias("n_ilp"), F.count("phase").alias("n_labelled"), F.sum(F.when(F.col("phase").isNotNull(), F.col("seizure_day"))).alias("event_days"),
        F.count_if(F.col("phase") == "F").alias("f_days"), F.count_if(F.col("phase").isin("M", "O", "L")).alias("other_days"))
    everyone = strict.select("participant_id", "cohort").distinct().groupBy("participant_id").agg(F.max("cohort").alias("cohort")).join(by, "participant_id", "left").join(alphas, "participant_id")
    any_done = done.select("participant_id").distinct().withColumn("done", F.lit(True))
    reason = (
        F.when(F.col("cohort") != "population", "not_applicable_to_cohort").when(F.col("done").isNull(), "no_complete_cycles")
        .when(F.coalesce("n_ilp", F.lit(0)) < least_cycles, "fewer_than_required_complete_ilp_cycles").when(F.col("n_labelled") == 0, "no_labeled_ilp_data")
        .when(F.col("event_days") < least_days, "seizure_days_below_minimum").when(F.col("f_days") == 0, "missing_follicular_phase").when(F.col("other_days") == 0, "missing_nonfollicular_phase")
    )
    everyone = everyone.join(any_done, "participant_id", "left").withColumn("reason", reason)
    fit = everyone.where("reason is null").select("participant_id", "alpha")
    grp = F.when(F.col("phase") == "F", 0).otherwise(1)
    cells = days.where("phase is not null").join(fit, "participant_id").groupBy("participant_id", F.col("cycle_id").alias("cycle"), grp.alias("grp"), "alpha").agg(
        F.count("*").alias("n"), F.sum("seizure_count").alias("events"), F.sum(F.col("seizure_count") * F.col("seizure_count")).alias("squares"))
    out = everyone.join(fit_windows(cells, ["participant_id"]), "participant_id", "left")
    run = F.col("reason").isNull()
    out = out.withColumn("p", F.when(run, _p("beta_1", "se_1"))).withColumn("rr", F.exp("beta_1"))
    label = F.when(run, F.coalesce((F.col("rr") >= threshold) & (F.col("p") < 0.05), F.lit(False)))
    return out.select(
        "participant_id", "cohort", label.alias("label_D_C3_exploratory"), F.col("beta_1").alias("d_c3_beta"), F.col("rr").alias("d_c3_rr"), F.col("p").alias("d_c3_p"), F.col("alpha").alias("d_c3_alpha"),
        F.when(run & F.coalesce("robust", F.lit(False)), "poisson_robust_fallback").when(run & F.col("beta_1").isNull(), "separated").otherwise(F.col("reason")).alias("d_c3_reason"), F.coalesce("n_ilp", F.lit(0)).alias("n_complete_ilp_cycles"),
    )
