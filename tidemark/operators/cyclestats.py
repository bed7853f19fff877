"""Cycle statistics against published targets.

Cycles have ``participant_id, cycle_id, age, cycle_length, ovulatory_flag, ovulation_day, bleeding_days``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .quantiles import quantiles

# Published targets by age band (mean length, within-person SD, shares of irregular
# participants, of cycles under 24 and over 38 days), by external age band (lower and upper age, mean of
# means, mean of personal SDs), overall, and by hormone subphase (estradiol pmol/L, progesterone nmol/L).
AGE_TARGETS = [
    ("<20", 29.82, 5.33, 0.204, 0.0771, 0.0833), ("20-24", 29.62, 5.07, 0.209, 0.0722, 0.0688), ("25-29", 29.31, 4.70, 0.159, 0.0607, 0.0616), ("30-34", 28.75, 4.28, 0.116, 0.0671, 0.0449),
    ("35-39", 28.19, 3.79, 0.106, 0.0812, 0.0293), ("40-44", 27.70, 3.99, 0.128, 0.1189, 0.0248), ("45-49", 27.86, 5.42, 0.282, 0.1595, 0.0421), ("50+", 30.21, 11.19, 0.602, 0.1866, 0.1481),
]
EXTERNAL_TARGETS = [
    ("18-25", 18.0, 26.0, 28.99, 4.14), ("26-30", 26.0, 31.0, 28.76, 3.95), ("31-35", 31.0, 36.0, 28.28, 3.80), ("36-40", 36.0, 41.0, 27.68, 3.72),
    ("41-45", 41.0, 46.0, 27.18, 3.92), ("46-50", 46.0, 51.0, 27.15, 4.72), ("51-55", 51.0, 56.0, 28.00, 6.52),
]
OVERALL_TARGETS = [("follicular_mean_days", 16.9), ("luteal_mean_days", 12.4), ("bleeding_mean_days", 4.0), ("luteal_sd_days", 2.4), ("bleeding_sd_days", 1.5)]
SUBPHASE_TARGETS = [
    ("early_follicular", 125.0, 0.380), ("mid_follicular", 172.0, 0.210), ("pre_ovulatory", 464.0, 0.188), ("ovulation", 817.0, 1.59),
    ("early_luteal", 390.0, 22.6), ("mid_luteal", 505.0, 39.2), ("late_luteal", 396.0, 18.2),
]
IRREGULAR_DAYS, FIRST_CYCLES, LEAST_CYCLES = 7.0, 11, 3
# Margins around the targets (the last age band has wider ones), and bounds where they are given as such.
AGE_MARGINS = {"cycle_mean": (0.55, 0.55), "cycle_within_person_sd": (0.35, 1.00), "cycle_irregularity": (0.035, 0.035), "cycle_short_lt24": (0.03, 0.05), "cycle_long_gt38": (0.03, 0.05)}
EXTERNAL_MARGINS = {"external_cunningham_mean": (1.50, 2.50), "external_cunningham_mean_personal_sd": (1.25, 3.50)}
OVERALL_BOUNDS = {"follicular_mean_days": (15.9, 17.9), "luteal_mean_days": (11.7, 13.1), "bleeding_mean_days": (3.6, 4.4), "luteal_sd_days": (2.0, 2.8), "bleeding_sd_days": (1.25, 1.75)}
ESTRADIOL_RATIOS, PROGESTERONE_RATIOS, LEAST_PROGESTERONE = (0.40, 1.85), (0.45, 1.85), 0.05
FOLLICULAR_PROGESTERONE, OVULATION_PROGESTERONE = (0.05, 0.65), (0.05, 2.00)
# name: expected, lower and upper bound, which bounds count, decimals
WAVEFORM_TARGETS = {
    "estradiol_preovulatory_peak_width_days": (3.0, 2.0, 5.0, "both", 3), "estradiol_luteal_secondary_peak_ratio": (0.59, 0.35, 0.80, "both", 4), "progesterone_plateau_width_days": (6.0, 3.0, 9.0, "both", 3),
    "progesterone_peak_offset_from_ovulation_days": (6.0, 3.0, 9.0, "both", 3), "progesterone_rise_to_5ng_offset_days": (2.0, 1.0, 4.0, "both", 3), "progesterone_premenstrual_withdrawal_days": (4.0, 3.0, 8.0, "lower", 3),
    "progesterone_terminal_to_peak_ratio": (0.04, 0.0, 0.20, "upper", 4), "progesterone_cross_cycle_jump_ng_ml": (0.0, 0.0, 1.0, "upper", 4),
}
CITED = {"cycle": "li_2023_awhs", "external": "cunningham_2024_flo", "overall": "bull_2019_natural_cycles", "subphase": "anckaert_2021_hormones", "waveform": "stricker_2006_reference"}
# Age ranges of the scenarios, and their 19 rules: scenario, rule, measure, what is added to the matched baseline (None: the value itself counts) as
# expected, lower and upper bound, which bounds count, citation.
SCENARIOS = {
    "pcos": (18.0, 45.0), "cyclic_ocp": (18.0, 45.0), "continuous_ocp": (18.0, 45.0), "hormonal_iud": (18.0, 45.0), "copper_iud": (18.0, 45.0), "perimenopause": (45.0, 55.0), "peri_menarche": (13.0, 18.0), "dysmenorrhea": (18.0, 45.0),
}
RULES = [
    ("pcos", "pcos_longer_cycles", "mean_cycle_days", (2.0, 2.0, None), (None, None, 999.0), "lower", "mortimer_2026_pcos"),
    ("pcos", "pcos_higher_irregularity", "irregularity_rate", (0.08, 0.08, None), (None, None, 1.0), "lower", "mortimer_2026_pcos"),
    ("pcos", "pcos_lower_ovulation", "ovulation_rate", (-0.18, None, -0.18), (None, 0.0, None), "upper", "doi_2005_pcos_hormones"),
    ("cyclic_ocp", "cyclic_ocp_ovulation_suppression", "ovulation_rate", (None, None, None), (0.0, 0.0, 0.02), "upper", "edelman_2014_ocp"),
    ("cyclic_ocp", "cyclic_ocp_withdrawal_bleeding", "mean_bleeding_days", (None, None, None), (4.0, 3.0, 5.0), "both", "edelman_2014_ocp"),
    ("continuous_ocp", "continuous_ocp_ovulation_suppression", "ovulation_rate", (None, None, None), (0.0, 0.0, 0.02), "upper", "edelman_2014_ocp"),
    ("continuous_ocp", "continuous_ocp_low_bleeding", "mean_bleeding_days", (None, None, None), (1.5, 0.0, 2.5), "upper", "edelman_2014_ocp"),
    ("continuous_ocp", "continuous_ocp_amenorrhea", "amenorrhea_rate", (None, None, None), (0.55, 0.40, 0.90), "lower", "edelman_2014_ocp"),
    ("hormonal_iud", "hormonal_iud_preserved_ovulation", "ovulation_rate", (None, None, None), (0.80, 0.70, 0.90), "both", "xiao_1995_lng_iud"),
    ("hormonal_iud", "hormonal_iud_amenorrhea", "amenorrhea_rate", (None, None, None), (0.17, 0.10, 0.25), "both", "xiao_1995_lng_iud"),
    ("copper_iud", "copper_iud_ovulation_preserved", "ovulation_rate", (0.0, -0.05, 0.05), (None, None, None), "both", "faundes_1980_copper_iud"),
    ("copper_iud", "copper_iud_bleeding_increase", "mean_bleeding_days", (0.5, 0.5, 2.0), (None, None, None), "both", "malmqvist_1974_copper_bleeding"),
    ("perimenopause", "perimenopause_irregularity", "irregularity_rate", (None, None, None), (0.27, 0.25, 1.0), "lower", "santoro_2011_perimenopause"),
    ("perimenopause", "perimenopause_lower_ovulation", "ovulation_rate", (None, None, None), (0.70, 0.45, 0.80), "both", "santoro_2011_perimenopause"),
    ("peri_menarche", "peri_menarche_long_cycles", "mean_cycle_days", (None, None, None), (30.5, 30.0, 40.0), "lower", "who_1986_adolescent_cycles"),
    ("peri_menarche", "peri_menarche_irregularity", "irregularity_rate", (None, None, None), (0.30, 0.28, 1.0), "lower", "who_1986_adolescent_cycles"),
    ("peri_menarche", "peri_menarche_lower_ovulation", "ovulation_rate", (None, None, None), (0.55, 0.30, 0.60), "upper", "venturoli_1986_menarche"),
    ("dysmenorrhea", "dysmenorrhea_preserved_ovulation", "ovulation_rate", (0.0, -0.08, 0.08), (None, None, None), "both", "dawood_2006_dysmenorrhea"),
    ("dysmenorrhea", "dysmenorrhea_bleeding_shift", "mean_bleeding_days", (0.2, 0.2, 1.2), (None, None, None), "both", "dawood_2006_dysmenorrhea"),
]


def cycle_irregularity(cycles: DataFrame) -> DataFrame:
    """``participant_id, irregularity``: mean absolute difference of neighbouring cycles, null with fewer than 2."""
    by = Window.partitionBy("participant_id").orderBy("cycle_id")
    d = cycles.withColumn("d", F.abs(F.col("cycle_length") - F.lag("cycle_length").over(by)))
    return d.groupBy("participant_id").agg(F.avg("d").alias("irregularity")).withColumn("irregular", F.col("irregularity") >= IRREGULAR_DAYS)


def _first_cycles(cycles: DataFrame, group: str) -> DataFrame:
    """A row a participant and group with at least 3 cycles there, of the first 11: mean, SDs, irregularity, tails."""
    key = [group, "participant_id"]
    by = Window.partitionBy(*key).orderBy("cycle_id")
    rows = cycles.withColumn("k", F.row_number().over(by)).withColumn("all", F.count("*").over(Window.partitionBy(*key))).withColumn("d", F.abs(F.col("cycle_length") - F.lag("cycle_length").over(by)))
    rows = rows.where(f"k <= {FIRST_CYCLES} and all >= {LEAST_CYCLES}")
    return rows.groupBy(*key).agg(
        F.avg("cycle_length").alias("mean"), F.stddev_samp("cycle_length").alias("sd"), (F.var_pop("cycle_length") * F.count("*")).alias("ss"), (F.count("*") - 1).alias("df"), F.avg("d").alias("irregularity"),
        F.avg((F.col("cycle_length") < 24).cast("int")).alias("short"), F.avg((F.col("cycle_length") > 38).cast("int")).alias("long"))


def _named(df: DataFrame, group: str | None, values: dict[str, str]) -> DataFrame:
    """``name, observed`` from columns, with the group after the name."""
    rows = ", ".join(f"'{kind}', cast({v} as double)" for kind, v in values.items())
    out = df.select(*([group] if group else []), F.expr(f"stack({len(values)}, {rows}) as (kind, observed)"))
    return out.select(F.concat("kind", F.lit("_"), group).alias("name") if group else F.col("kind").alias("name"), "observed")


#: Columns of a target: name, family, expected, lower, upper, which bounds count (both, lower, upper), decimals, citation.
TARGET = "name string, kind string, expected double, lower double, upper double, counts string, decimals int, citation_key string"


def metric_gate(spark: SparkSession, observed: DataFrame, targets: list[tuple]) -> DataFrame:
    """Metric rows from ``name, observed`` and target tuples as in :data:`TARGET`: rounded value and bounds, and whether the value itself
    is within the bounds that count. Names without a target are left out."""
    both = observed.join(F.broadcast(spark.createDataFrame(targets, TARGET)), "name")  # some dozens of rows
    o, low, high = F.col("observed"), F.col("lower"), F.col("upper")
    ok = F.when(F.col("counts") == "lower", o >= low).when(F.col("counts") == "upper", o <= high).otherwise(o.between(low, high))
    shown = lambda c: F.when(F.col("decimals") == 3, F.bround(c, 3)).otherwise(F.bround(c, 4))
    return both.select("name", "kind", shown(o).alias("observed"), F.col("expected"), shown(low).alias("lower_bound"), shown(high).alias("upper_bound"), ok.alias("passed"), "citation_key")


def all_passed(metrics: DataFrame) -> DataFrame:
    """``gate, n, n_passed, all_passed``: calibration (all but the external checks), waveform (hormones), external, and baseline (all)."""
    hormone = F.col("name").startswith("estradiol_") | F.col("name").startswith("progesterone_")
    outside = F.col("kind") == "external"
    gates = F.array_compact(F.array(F.lit("baseline"), F.when(outside, "external").otherwise("calibration"), F.when(hormone, "waveform")))
    each = metrics.select("passed", F.explode(gates).alias("gate"))
    return each.groupBy("gate").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("all_passed"))


def age_band_metrics(spark: SparkSession, cycles: DataFrame) -> DataFrame:
    """Mean, pooled within-person SD, irregular share and tails of each age band."""
    obs = _first_cycles(cycles.withColumn("band", C.age_band("age")), "band").groupBy("band").agg(
        F.avg("mean").alias("mean"), F.sqrt(F.try_divide(F.sum("ss"), F.sum("df"))).alias("sd"), F.avg((F.col("irregularity") >= IRREGULAR_DAYS).cast("int")).alias("irregular"), F.avg("short").alias("short"), F.avg("long").alias("long"))
    targets = []
    for band, *expected in AGE_TARGETS:
        for (kind, (usual, last)), value in zip(AGE_MARGINS.items(), expected, strict=True):
            margin = last if band == AGE_TARGETS[-1][0] else usual
            share = kind not in ("cycle_mean", "cycle_within_person_sd")
            low, high = value - margin, value + margin
            targets.append((f"{kind}_{band}", "cycle", value, max(0.0, low) if share else low, min(1.0, high) if share else high, "both", 4 if share else 3, CITED["cycle"]))
    return metric_gate(spark, _named(obs, "band", dict(zip(AGE_MARGINS, ("mean", "sd", "irregular", "short", "long"), strict=True))), targets)


def external_metrics(spark: SparkSession, cycles: DataFrame) -> DataFrame:
    """Mean of participants' means and of their SDs by external age band (a range join with 7 rows), by the same first cycles."""
    bands = spark.createDataFrame([x[:3] for x in EXTERNAL_TARGETS], "label string, age_min double, age_max double")
    rows = cycles.join(F.broadcast(bands), (F.col("age") >= F.col("age_min")) & (F.col("age") < F.col("age_max")))
    obs = _first_cycles(rows, "label").groupBy("label").agg(F.avg("mean").alias("mean"), F.avg("sd").alias("sd"))
    targets = []
    for label, _, _, *expected in EXTERNAL_TARGETS:
        for (kind, (usual, last)), value in zip(EXTERNAL_MARGINS.items(), expected, strict=True):
            margin = last if label == EXTERNAL_TARGETS[-1][0] else usual
            targets.append((f"{kind}_{label}", "external", value, value - margin, value + margin, "both", 3, CITED["external"]))
    return metric_gate(spark, _named(obs, "label", dict(zip(EXTERNAL_MARGINS, ("mean", "sd"), strict=True))), targets)


def overall_metrics(spark: SparkSession, cycles: DataFrame) -> DataFrame:
    """Means and sample SDs of phase lengths (ovulatory cycles) and bleeding (all cycles)."""
    fol, lut = F.when(F.col("ovulatory_flag"), F.col("ovulation_day")), F.when(F.col("ovulatory_flag"), F.col("cycle_length") - F.col("ovulation_day"))
    obs = cycles.agg(F.avg(fol).alias("follicular_mean_days"), F.avg(lut).alias("luteal_mean_days"), F.avg("bleeding_days").alias("bleeding_mean_days"), F.stddev_samp(lut).alias("luteal_sd_days"), F.stddev_samp("bleeding_days").alias("bleeding_sd_days"))
    targets = [(k, "overall", v, *OVERALL_BOUNDS[k], "both", 3, CITED["overall"]) for k, v in OVERALL_TARGETS]
    return metric_gate(spark, _named(obs, None, {k: k for k, _ in OVERALL_TARGETS}), targets)


def subphase(day, ovulation, length) -> Column:
    """One of seven subphases of an ovulatory cycle by fractions of its two phases, rounded half to even."""
    d, ov, lut = C.col(day), C.col(ovulation), C.col(length) - C.col(ovulation)
    part = lambda n, f, least: F.greatest(F.lit(least), F.bround(n * F.lit(f)).cast("int"))
    off = d - ov
    label = (
        F.when(d <= part(ov, 0.2, 2), "early_follicular").when(d <= part(ov, 0.6, 3), "mid_follicular").when(d < ov, "pre_ovulatory").when(d == ov, "ovulation").when(off <= part(lut, 0.3, 3), "early_luteal")
        .when((off >= part(lut, 0.35, 4)) & (off <= part(lut, 0.7, 5)), "mid_luteal").otherwise("late_luteal")
    )
    return F.when((ov > 0) & (lut > 0), label)


def subphase_medians(spark: SparkSession, daily: DataFrame) -> DataFrame:
    """Median estradiol and progesterone by subphase (``daily`` holds only days of complete ovulatory cycles), against bounds
    around the published medians."""
    long = daily.select(subphase("cycle_day", "ovulation_day", "cycle_length").alias("subphase"), F.expr("stack(2, 'estradiol', cast(estradiol as double), 'progesterone', cast(progesterone as double)) as (hormone, value)"))
    obs = quantiles(long.where("subphase is not null"), ["subphase", "hormone"], "value", [0.5]).groupBy("subphase").agg(
        *[F.max(F.when(F.col("hormone") == h, F.get("quantiles", F.lit(0)))).alias(h) for h in ("estradiol", "progesterone")])
    targets = []
    for name, pmol, nmol in SUBPHASE_TARGETS:
        e2, p4 = pmol / C.PMOL_L_PER_PG_ML, nmol / C.NMOL_L_PER_NG_ML
        low, high = max(LEAST_PROGESTERONE, p4 * PROGESTERONE_RATIOS[0]), p4 * PROGESTERONE_RATIOS[1]
        if name == "ovulation":
            low, high = OVULATION_PROGESTERONE
        elif not name.endswith("luteal"):
            low, high = FOLLICULAR_PROGESTERONE
        targets.append((f"estradiol_{name}", "subphase", round(e2, 3), e2 * ESTRADIOL_RATIOS[0], e2 * ESTRADIOL_RATIOS[1], "both", 3, CITED["subphase"]))
        targets.append((f"progesterone_{name}", "subphase", round(p4, 3), low, high, "both", 3, CITED["subphase"]))
    return metric_gate(spark, _named(obs, "subphase", {"estradiol": "estradiol", "progesterone": "progesterone"}), targets)


def cycle_waveforms(daily: DataFrame) -> DataFrame:
    """Shape figures of each complete ovulatory cycle (``daily`` holds only their days)."""
    key = ["participant_id", "cycle_id"]
    cycle = Window.partitionBy(*key)
    d, e2, p4, ov = F.col("cycle_day"), F.col("estradiol"), F.col("progesterone"), F.col("ovulation_day")
    rows = daily.withColumn("f_peak", F.max(F.when(d <= ov, e2)).over(cycle)).withColumn("p_peak", F.max(p4).over(cycle)).withColumn("before", F.lag("progesterone").over(cycle.orderBy("cycle_day")))
    return rows.groupBy(*key).agg(
        F.max("ovulation_day").alias("ov"), F.count_if((d <= ov) & (e2 >= F.col("f_peak") * 0.8)).alias("estradiol_peak_days"), F.try_divide(F.max(F.when(d > ov, e2)), F.max("f_peak")).alias("estradiol_secondary_ratio"),
        F.count_if(p4 >= F.col("p_peak") * 0.75).alias("progesterone_plateau_days"), (F.min(F.when(p4 == F.col("p_peak"), d)) - F.max("ovulation_day")).alias("progesterone_peak_offset"),
        (F.min(F.when((d >= ov) & (p4 >= 5), d)) - F.max("ovulation_day")).alias("progesterone_rise_offset"), (F.max("cycle_day") - F.coalesce(F.max(F.when(F.col("before").isNotNull() & (p4 >= F.col("before")), d)), F.lit(1))).alias("progesterone_withdrawal_days"),
        F.try_divide(F.max_by("progesterone", "cycle_day"), F.max("p_peak")).alias("progesterone_terminal_ratio"), F.min_by("progesterone", "cycle_day").alias("first_p4"), F.max_by("progesterone", "cycle_day").alias("last_p4"))


WAVEFORMS = ["estradiol_peak_days", "estradiol_secondary_ratio", "progesterone_plateau_days", "progesterone_peak_offset", "progesterone_rise_offset", "progesterone_withdrawal_days", "progesterone_terminal_ratio", "progesterone_cycle_jump"]


def waveform_metrics(spark: SparkSession, daily: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Medians of the shape figures, with the progesterone step to the next complete cycle, against their bounds. ``shapes`` are the
    :func:`cycle_waveforms` of ``daily``, where these are there already."""
    shapes = cycle_waveforms(daily) if shapes is None else shapes
    by = Window.partitionBy("participant_id").orderBy("cycle_id")
    jump = F.when(F.lead("cycle_id").over(by) == F.col("cycle_id") + 1, F.abs(F.lead("first_p4").over(by) - F.col("last_p4")))
    pairs = ", ".join(f"'{name}', cast({m} as double)" for name, m in zip(WAVEFORM_TARGETS, WAVEFORMS, strict=True))
    long = shapes.withColumn("progesterone_cycle_jump", jump).select(F.expr(f"stack({len(WAVEFORMS)}, {pairs}) as (name, value)"))
    obs = quantiles(long, ["name"], "value", [0.5]).select("name", F.get("quantiles", F.lit(0)).alias("observed"))
    return metric_gate(spark, obs, [(k, "waveform", *v, CITED["waveform"]) for k, v in WAVEFORM_TARGETS.items()])


def baseline_metrics(spark: SparkSession, cycles: DataFrame, whole_ovulatory: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """All checks of a population: cycles by age, overall, hormones and external."""
    parts = [age_band_metrics(spark, cycles), overall_metrics(spark, cycles), subphase_medians(spark, whole_ovulatory), waveform_metrics(spark, whole_ovulatory, shapes), external_metrics(spark, cycles)]
    return reduce(DataFrame.unionByName, parts)


def convergence(metrics: DataFrame, size: str) -> DataFrame:
    """Checks passed by cohort size (``metrics`` with a column ``size``), and whether all of each family passed."""
    ok = F.coalesce("passed", F.lit(False))
    outside = F.col("kind") == "external"
    return metrics.groupBy(size).agg(
        F.bool_and(ok).alias("overall_passed"), F.bool_and(ok | outside).alias("calibration_passed"), F.bool_and(ok | ~outside).alias("external_crosscheck_passed"), F.count_if(ok).alias("checks_passed"), F.count("*").alias("checks_total"))


MEASURES = ["mean_cycle_days", "ovulation_rate", "mean_bleeding_days", "irregularity_rate", "amenorrhea_rate"]


def scenario_names() -> Column:
    """Scenarios that a cycle with flattened factors and an age belongs to, and those whose baseline it belongs to (no factor, same ages)."""
    has = {"cyclic_ocp": F.col("oral_contraceptive_mode") == "cyclic", "continuous_ocp": F.col("oral_contraceptive_mode") == "continuous"}
    free = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in SCENARIOS if c not in has], F.col("oral_contraceptive_mode") == "none")
    out = []
    for name, (low, high) in SCENARIOS.items():
        aged = (F.col("age") >= low) & (F.col("age") < high)
        out += [F.when(aged & has.get(name, F.col(name) == 1 if name not in has else F.lit(False)), name), F.when(aged & free, f"baseline {name}")]
    return F.array_compact(F.array(*out))


def subgroup_summary(cycles: DataFrame) -> DataFrame:
    """``scenario`` with its measures (three decimals), those of its age-matched baseline (``base_``) and the differences (``delta_``).

    ``cycles`` have flattened factors. A participant is irregular from 7 days of mean adjacent difference on (those with
    one cycle do not count); a cycle without bleeding counts as amenorrhea. Without a baseline its columns are null.
    """
    by = Window.partitionBy("participant_id").orderBy("cycle_id")
    rows = cycles.withColumn("d", F.abs(F.col("cycle_length") - F.lag("cycle_length").over(by))).withColumn("scenario", F.explode(scenario_names()))
    people = rows.groupBy("scenario", "participant_id").agg(
        F.sum("cycle_length").alias("days"), F.sum(F.col("ovulatory_flag").cast("int")).alias("ov"), F.sum("bleeding_days").alias("bled"), F.count_if(F.col("bleeding_days") == 0).alias("none"), F.count("*").alias("n"), F.avg("d").alias("d"))
    n = F.sum("n")
    got = people.groupBy("scenario").agg(
        *[F.bround(x, 3).alias(m) for m, x in zip(MEASURES, (F.sum("days") / n, F.sum("ov") / n, F.sum("bled") / n, F.avg((F.col("d") >= IRREGULAR_DAYS).cast("int")), F.sum("none") / n), strict=True)])
    base = got.where("scenario like 'baseline %'").select(F.substring("scenario", 10, 99).alias("scenario"), *[F.col(m).alias(f"base_{m}") for m in MEASURES])
    own = got.where("scenario not like 'baseline %'").join(F.broadcast(base), "scenario", "left")  # a row a scenario
    return own.select("scenario", *MEASURES, *[f"base_{m}" for m in MEASURES], *[F.bround(F.col(m) - F.col(f"base_{m}"), 3).alias(f"delta_{m}") for m in MEASURES])


def subgroup_checks(spark: SparkSession, summary: DataFrame) -> DataFrame:
    """The 19 rules on the summary: rounded value, expected, bounds, and whether the bounds that count hold."""
    flat = [(scenario, rule, measure, *added, *fixed, counts, cited) for scenario, rule, measure, added, fixed, counts, cited in RULES]
    parts = ("expected", "lower_bound", "upper_bound")
    rules = spark.createDataFrame(flat, "scenario string, name string, measure string, " + ", ".join(f"add_{x} double" for x in parts) + ", " + ", ".join(f"fix_{x} double" for x in parts) + ", counts string, citation_key string")
    pairs = ", ".join(f"'{m}', {m}, base_{m}" for m in MEASURES)
    long = summary.select("scenario", F.expr(f"stack({len(MEASURES)}, {pairs}) as (measure, observed, base)"))
    both = long.join(F.broadcast(rules), ["scenario", "measure"])
    both = both.select("scenario", "name", "observed", "counts", "citation_key", *[F.coalesce(f"fix_{x}", F.col("base") + F.col(f"add_{x}")).alias(x) for x in parts])
    o, low, high = F.col("observed"), F.col("lower_bound"), F.col("upper_bound")
    # to the nine decimals to which sums of three-decimal numbers are exact
    above, below = F.round(o - low, 9) >= 0, F.round(high - o, 9) >= 0
    return both.withColumn("passed", F.when(F.col("counts") == "lower", above).when(F.col("counts") == "upper", below).otherwise(above & below)).drop("counts")


# Age groups of the cohort report by lower bound.
AGE_GROUPS = [("12-19", 0.0), ("20-29", 20.0), ("30-39", 30.0), ("40-52", 40.0)]


def age_group(age) -> Column:
    out = F.lit(AGE_GROUPS[-1][0])
    for (name, _), (_, upper) in reversed(list(zip(AGE_GROUPS, AGE_GROUPS[1:], strict=False))):
        out = F.when(C.col(age) < upper, name).otherwise(out)
    return F.when(C.col(age).isNotNull(), out)


def age_group_summary(cycles: DataFrame) -> DataFrame:
    """Patients, cycles and means by age group."""
    return cycles.groupBy(age_group("age").alias("age_group")).agg(
        F.countDistinct("participant_id").alias("patients"), F.count("*").alias("cycles"), F.avg("cycle_length").alias("mean_cycle_length"), F.avg(F.col("ovulatory_flag").cast("int")).alias("ovulatory_cycle_rate"), F.avg("bleeding_days").alias("mean_bleeding_days"))


def cohort_metrics(cycles: DataFrame) -> DataFrame:
    """``metric, value`` of the whole cohort."""
    people = cycles.groupBy("participant_id").agg(F.max("age").alias("age")).join(cycle_irregularity(cycles), "participant_id")
    who = people.agg(
        F.count("*").cast("double").alias("patients"), F.avg("age").alias("mean_age"), F.avg("irregularity").alias("mean_adjacent_difference"),
        F.avg(F.coalesce("irregular", F.lit(False)).cast("int")).alias("irregular_share"))
    what = cycles.agg(F.avg("cycle_length").alias("mean_cycle_length"), F.avg(F.col("ovulatory_flag").cast("int")).alias("ovulatory_cycle_rate"), F.avg("bleeding_days").alias("mean_bleeding_days"))
    half = quantiles(people, [], "age", [0.5]).select(F.get("quantiles", F.lit(0)).alias("median_age"))
    both = who.crossJoin(what).join(half, how="left")  # one row each
    return both.select(F.expr(f"stack({len(both.columns)}, " + ", ".join(f"'{c}', {c}" for c in both.columns) + ") as (metric, value)"))


# Features of the factor report and the flattened columns they come from.
FACTORS = {"PCOS": "pcos = 1", "Dysmenorrhea": "dysmenorrhea = 1", "Cyclic oral contraceptive": "oral_contraceptive_mode = 'cyclic'", "Hormonal IUD": "hormonal_iud = 1", "Copper IUD": "copper_iud = 1"}


def factor_prevalence(profiles: DataFrame) -> DataFrame:
    """``feature, patients, percent`` of flattened profiles."""
    counts = profiles.agg(F.count("*").alias("total"), *[F.count_if(F.expr(x)).alias(f"_{i}") for i, x in enumerate(FACTORS.values())])
    rows = ", ".join(f"'{k}', _{i}" for i, k in enumerate(FACTORS))
    return counts.select("total", F.expr(f"stack({len(FACTORS)}, {rows}) as (feature, patients)")).select("feature", "patients", F.try_divide(F.col("patients") * 100.0, "total").alias("percent"))


MEDICATIONS = ["none", "oral_contraceptive", "hormonal_iud", "copper_iud"]


def medication_mix(profiles: DataFrame, values: list[str] = MEDICATIONS) -> DataFrame:
    """Row percentages of medication categories by age group, zero where absent."""
    wide = profiles.groupBy(age_group("age").alias("age_group")).pivot("medication_category", values).count().na.fill(0)
    total = sum((F.col(v) for v in values), F.lit(0))
    return wide.select("age_group", *[F.try_divide(F.col(v) * 100.0, total).alias(v) for v in values])


def irregular_by_age(cycles: DataFrame) -> DataFrame:
    """Share of irregular participants by age group (those with one cycle count as not irregular)."""
    people = cycles.groupBy("participant_id").agg(F.max("age").alias("age")).join(cycle_irregularity(cycles), "participant_id")
    return people.groupBy(age_group("age").alias("age_group")).agg(F.avg(F.coalesce("irregular", F.lit(False)).cast("int")).alias("irregular_participant_prevalence"))


def flatten_factors(profiles: DataFrame, struct: str = "factors") -> DataFrame:
    """A nested factor struct as 0/1 columns, the oral contraceptive mode (``none`` if absent) and ``medication_category`` (oral
    contraceptive before hormonal before copper device)."""
    f = lambda n: F.col(f"{struct}.{n}")
    names = ["pcos", "hormonal_iud", "copper_iud", "perimenopause", "peri_menarche", "dysmenorrhea"]
    mode = F.coalesce(F.nullif(f("oral_contraceptive_mode"), F.lit("")), F.lit("none"))
    category = F.when(mode != "none", "oral_contraceptive").when(f("hormonal_iud"), "hormonal_iud").when(f("copper_iud"), "copper_iud").otherwise("none")
    return profiles.select(*[c for c in profiles.columns if c != struct], *[F.coalesce(f(n).cast("int"), F.lit(0)).alias(n) for n in names], mode.alias("oral_contraceptive_mode"), category.alias("medication_category"))
