"""Sensitivity tables and diagnostics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .quantiles import quantiles

# Thresholds of the cumulative ratio table.
THRESHOLDS = (1.0, 1.25, 1.5, 1.62, 1.69, 1.83, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0)


def cumulative_ratio(windows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """For each pattern, cohort and threshold of strict three-cycle windows the number of ratios that reach it; infinite ones do."""
    rows = windows.where("phase_mode = 'strict_herzog' and window_type = 'cycle' and window_value = '3'")
    long = rows.select("cohort", F.expr("stack(3, 'C1', rr_C1, true, 'C2', rr_C2, true, 'C3', rr_C3, c3_applicable_flag) as (pattern, ratio, applicable)"))
    each = long.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    on = F.col("applicable")
    out = each.groupBy("pattern", "cohort", "threshold").agg(
        F.count("*").alias("n_attempted"), F.count_if(on).alias("n_applicable"), F.count_if(on & F.col("ratio").isNotNull()).alias("n_defined"),
        F.count_if(on & F.col("ratio").isNull()).alias("n_undefined"), F.count_if(on & F.coalesce(F.col("ratio") >= F.col("threshold"), F.lit(False))).alias("n_at_least"))
    return out.withColumn("percent", F.try_divide(F.col("n_at_least") * 100.0, "n_defined"))


def ensured(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """The table itself; the job that reads it fails with ``message`` at a row for which ``holds`` is not true. No pass of its own."""
    return df.where(F.when(holds, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def assert_unique_key(df: DataFrame, *keys: str) -> DataFrame:
    """The table itself; reading it fails if a key occurs twice. Rows are dealt out by the key, as a join on it needs anyway."""
    counted = df.withColumn("_copies", F.count("*").over(Window.partitionBy(*keys)))
    return ensured(counted, F.col("_copies") == 1, f"keys are not unique: {', '.join(keys)}").drop("_copies")


def assert_monotone(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """The table itself; reading it fails if the value rises along the order."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    return ensured(df.withColumn("_before", before), F.coalesce(F.col(value) <= F.col("_before"), F.lit(True)), f"{value} is not non-increasing").drop("_before")


def assert_reconciled(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The left table; reading it fails if a value differs from the right one's or a key is missing there."""
    other = right.select(*keys, F.col(value).alias("_other"))
    return ensured(left.join(other, keys, "left"), F.col(value).eqNullSafe(F.col("_other")), f"{value} does not reconcile").drop("_other")


def _interval(df: DataFrame, total: str, rate: str = "false_positive_rate_classifiable") -> DataFrame:
    low, high = C.wilson("positives", "n_classifiable")
    df = df.withColumn(rate, F.try_divide("positives", "n_classifiable")).withColumn("wilson95_low", low).withColumn("wilson95_high", high)
    return df.withColumn("positive_rate_all_attempted", F.try_divide("positives", total)) if total else df


def _yes(c) -> Column:
    return F.count_if(F.coalesce(C.col(c), F.lit(False)))


def _json_counts(rows: DataFrame, key: list[str], reason: Column, name: str) -> DataFrame:
    """Counts of a few fixed reasons as JSON text, in order of the reason."""
    each = rows.groupBy(*key, reason.alias("_r")).agg(F.count("*").alias("_n"))
    return each.groupBy(*key).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_r", "_n"))))).alias(name))


def c3_window_sensitivity(windows: DataFrame) -> DataFrame:
    """By strict population window: where C3 applies, labels and rates among these, and why labels are missing."""
    rows = windows.where("cohort = 'population' and phase_mode = 'strict_herzog'")
    key = ["window_type", "window_value"]
    on, label = F.coalesce("c3_applicable_flag", F.lit(False)), F.col("label_A_windowed_C3")
    out = rows.groupBy(*key).agg(F.count("*").alias("n_attempted"), F.count_if(on).alias("n_applicable"), F.count(F.when(on, label)).alias("n_classifiable"), _yes(F.when(on, label)).alias("positives"))
    why = _json_counts(rows.where(on & label.isNull()), key, F.coalesce("a_windowed_reason", F.lit("unspecified")), "indeterminate_reasons")
    out = _interval(out.join(why, key, "left"), "n_attempted").withColumn("cohort", F.lit("population"))
    return out.withColumn("indeterminate_reasons", F.coalesce("indeterminate_reasons", F.lit("{}")))


def minimum_data_sensitivity(windows: DataFrame, least: tuple[int, ...] = (2, 3, 4, 6), months: int = 4, cycles: int = 6) -> DataFrame:
    """Rates of C1 or C2 if windows need so many event days, and calendar windows ``months``, cycle windows ``cycles``
    (full diaries are long enough)."""
    rows = windows.where("phase_mode = 'strict_herzog'").withColumn("min_seizure_days", F.explode(F.array(*map(F.lit, least))))
    size = F.col("window_value").try_cast("double")
    long_enough = ((F.col("window_type") == "calendar") & (size >= months)) | ((F.col("window_type") == "cycle") & (size >= cycles)) | (F.col("window_type") == "full")
    ok = F.coalesce(long_enough & (F.col("seizure_days_total").try_cast("double") >= F.col("min_seizure_days")), F.lit(False))
    label = F.when(ok, F.col("label_A_windowed_C1_or_C2"))
    out = rows.groupBy("min_seizure_days", "cohort", "window_type", "window_value").agg(
        F.count("*").alias("n_attempted"), F.count_if(ok).alias("n_meeting_minimum"), F.count(label).alias("n_classifiable"), _yes(label).alias("positives"))
    return _interval(out, "n_attempted")


def c3_nb_summary(fits: DataFrame, windows: DataFrame, threshold: float = 1.62, p_value: float = 0.05) -> DataFrame:
    """One row over the C3 fits (``participant_id, label_D_C3_exploratory, d_c3_reason``) of population participants beside
    their full windows: how many apply, are classifiable and positive, and why the others are not."""
    full = assert_unique_key(windows.where("cohort = 'population' and phase_mode = 'strict_herzog' and window_type = 'full'").select("participant_id", "c3_applicable_flag"), "participant_id")
    both = assert_unique_key(fits.where("cohort = 'population'"), "participant_id").join(full, "participant_id", "left").withColumn("_all", F.lit(1))
    label = "label_D_C3_exploratory"
    out = both.groupBy("_all").agg(F.count("*").alias("n_attempted_audit_participants"), _yes("c3_applicable_flag").alias("n_ratio_c3_applicable"), F.count(label).alias("n_classifiable"), _yes(label).alias("positives"))
    why = _json_counts(both, ["_all"], F.coalesce("d_c3_reason", F.lit("classifiable")), "reason_counts")
    out = _interval(out.join(why, "_all"), "n_attempted_audit_participants").drop("_all").withColumnRenamed("n_classifiable", "n_nb_classifiable")
    return out.withColumn("effect_threshold", F.lit(threshold)).withColumn("p_threshold_one_sided", F.lit(p_value))


#: Outcomes, continuous and binary features that the driver analysis reports.
OUTCOMES = ["label_A_windowed_any", "label_A_windowed_C1_or_C2", "label_A_windowed_C3"]
CONTINUOUS = ["age", "seizure_days_per_month", "seizures_per_month", "mean_cycle_length", "sd_cycle_length", "ovulatory_fraction", "dominant_seizure_cycle_days"]
BINARY = ["pcos", "peri_menarche", "perimenopause"]


def driver_analysis(df: DataFrame, features: list[str] = CONTINUOUS, outcomes: list[str] = OUTCOMES, binary: list[str] = BINARY, bins: int = 5) -> DataFrame:
    """Rates of outcomes by quantile bins of continuous features and by value of binary ones, within each cohort.

    Bins are closed on the right, equal edges merged; features with under 10 values or 2 distinct ones in a cohort are left
    out there, and C3 outside the population. ``level`` is the bin's number or the value; ``lower`` and ``upper`` its edges. Values
    and edges are rounded to 9 decimals, so that a value does not cross an edge by the order of a sum.
    """
    pairs = ", ".join(f"'{f}', round(cast({f} as double), 9)" for f in features)
    long = df.select("cohort", *outcomes, F.expr(f"stack({len(features)}, {pairs}) as (feature, value)")).where("value is not null")
    # the first and last edge are the least and the largest value
    edges = quantiles(long, ["cohort", "feature"], "value", [i / bins for i in range(bins + 1)]).where(f"n >= 10 and quantiles[0] < quantiles[{bins}]")
    edges = edges.select("cohort", "feature", F.array_distinct(F.transform("quantiles", lambda e: F.round(e, 9))).alias("edges"))
    both = long.join(F.broadcast(edges), ["cohort", "feature"])  # a row for each cohort and feature
    bin_ = F.greatest(F.size(F.filter("edges", lambda e: e < F.col("value"))), F.lit(1))
    both = both.withColumn("bin", bin_).select("cohort", "feature", F.col("bin").cast("string").alias("level"), F.expr("edges[bin - 1]").alias("lower"), F.expr("edges[bin]").alias("upper"), *outcomes)
    if binary:
        pairs = ", ".join(f"'{f}', cast({f} as boolean)" for f in binary)
        own = df.select("cohort", *outcomes, F.expr(f"stack({len(binary)}, {pairs}) as (feature, value)")).where("value is not null")
        nothing = F.lit(None).cast("double")
        both = both.unionByName(own.select("cohort", "feature", F.col("value").cast("string").alias("level"), nothing.alias("lower"), nothing.alias("upper"), *outcomes))
    counts = [x for i, o in enumerate(outcomes) for x in (F.count(o).alias(f"_n{i}"), _yes(o).alias(f"_p{i}"))]
    key = ["cohort", "feature", "level", "lower", "upper"]
    marks = ", ".join(f"'{o}', _n{i}, _p{i}" for i, o in enumerate(outcomes))
    out = both.groupBy(*key).agg(F.count("*").alias("n_group"), *counts).select(*key, "n_group", F.expr(f"stack({len(outcomes)}, {marks}) as (outcome, n_classifiable, positives)"))
    return _interval(out.where("outcome <> 'label_A_windowed_C3' or cohort = 'population'"), "", "rate")


def audit_features(daily: DataFrame) -> DataFrame:
    """A row a participant: variance over mean of the counts, how much likelier an event day is after an event day, the dominant
    period, and length, ovulation and ILP over the cycles."""
    by = Window.partitionBy("participant_id").orderBy("calendar_day_index")
    nxt = daily.withColumn("next_day", F.lead("seizure_day").over(by))
    out = nxt.groupBy("participant_id").agg(
        F.max("cohort").alias("cohort"), F.avg("seizure_count").alias("m"), F.var_samp("seizure_count").alias("v"), F.avg(F.when(F.col("seizure_day") == 1, F.col("next_day"))).alias("after"), F.avg("seizure_day").alias("base"))
    cycles = daily.groupBy("participant_id", "cycle_id").agg(F.min_by("cycle_length", "calendar_day_index").alias("len"), F.min_by("ovulatory_flag", "calendar_day_index").cast("int").alias("ov"), F.max(F.col("ilp_flag").cast("int")).alias("ilp"))
    cycles = cycles.groupBy("participant_id").agg(
        F.avg("len").alias("audit_mean_cycle_length"), F.stddev_samp("len").alias("audit_sd_cycle_length"), F.avg("ov").alias("audit_ovulatory_fraction"), F.avg("ilp").alias("audit_ilp_fraction"), F.count("*").alias("n_audit_cycles"))
    out = out.join(cycles, "participant_id").join(dominant_period(daily), "participant_id", "left")
    return out.select(
        "participant_id", "cohort", F.try_divide("v", "m").alias("daily_count_overdispersion"), (F.col("after") - F.col("base")).alias("next_day_cluster_propensity"),
        F.col("period_days").alias("spectral_dominant_period_days"), F.col("amplitude").alias("spectral_amplitude_seizures_per_day"), *cycles.columns[1:])


#: Days of counts that one call of the Fourier transform holds.
SPECTRUM_DAYS = 2_000_000


def _spectra(longest: int):
    """For batches of ``participant_id, n, days, counts``: all diaries of one length in one call of the transform."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            size = np.asarray(pc.list_value_length(batch.column("days")))
            start = np.cumsum(size) - size
            days, counts = batch.column("days").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            period, amplitude = np.full(len(n), np.nan), np.full(len(n), np.nan)
            for length in np.unique(n).tolist():
                first = max(1, -(-length // longest))
                if first > length // 2:
                    continue
                mine = np.flatnonzero(n == length)
                step = max(1, SPECTRUM_DAYS // length)
                for rows in np.split(mine, range(step, len(mine), step)):
                    at = np.repeat(start[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(int(size[rows].sum()))
                    y = np.zeros((len(rows), length))
                    np.add.at(y, (np.repeat(np.arange(len(rows)), size[rows]), days[at] % length), counts[at])
                    # the mean adds at frequency 0 alone, which is not looked at
                    power = np.round(2 * np.abs(np.fft.rfft(y, axis=1))[:, first : length // 2 + 1] / length, 9)
                    best = power.argmax(1)  # of equal ones the first: the longer period
                    period[rows], amplitude[rows] = length / (best + first), power[np.arange(len(rows)), best]
            known = pa.array(~np.isnan(period))
            yield pa.RecordBatch.from_arrays([batch.column("participant_id"), pa.array(period), pa.array(amplitude)], ["participant_id", "period_days", "amplitude"]).filter(known)

    return run


def dominant_period(daily: DataFrame, longest: int = 365) -> DataFrame:
    """``participant_id, period_days, amplitude``: the period (2 to ``longest`` days) of largest amplitude of each participant's counts
    by a fast Fourier transform of the zero-padded days; ties to the longer period. Participants without events have no row.

    Only days with events travel to the participant; their number and the diary's length bound a row.
    """
    some = F.when(F.col("seizure_count") > 0, F.struct((F.col("calendar_day_index") - 1).cast("long").alias("t"), F.col("seizure_count").cast("double").alias("c")))
    people = daily.groupBy("participant_id").agg(F.count("*").alias("n"), F.collect_list(some).alias("events")).where(F.size("events") > 0)
    people = people.select("participant_id", "n", F.col("events.t").alias("days"), F.col("events.c").alias("counts"))
    kind = daily.schema["participant_id"].dataType.simpleString()
    return people.mapInArrow(_spectra(longest), f"participant_id {kind}, period_days double, amplitude double")


def ratio_audit(windows: DataFrame, thresholds: dict[str, float] = C.THRESHOLDS, every: bool = False) -> DataFrame:
    """Finite, infinite and undefined ratios of strict three-cycle windows by pattern and cohort (C3 of the population where it applies), how many
    reach the pattern's threshold, infinite ones included, and the infinite ones' percentage of these. With ``every`` those of all windows, by phase
    mode and window kind too, with ``n_not_applicable``: windows to which C3 does not apply."""
    rows = windows if every else windows.where("phase_mode = 'strict_herzog' and window_type = 'cycle' and try_cast(window_value as double) = 3")
    kind = ["phase_mode", "window_type", "window_value"] if every else []
    use3 = "coalesce(cohort = 'population' and c3_applicable_flag, false)"
    parts = ", ".join(f"'{p}', rr_{p}, {use3 if p == 'C3' else 'true'}, cast({t} as double)" for p, t in thresholds.items())
    long = rows.select("cohort", *kind, F.expr(f"stack({len(thresholds)}, {parts}) as (pattern, ratio, used, threshold)"))
    long = long if every else long.where("used")
    used = F.col("used")
    known, inf = ~F.isnan("ratio") & F.col("ratio").isNotNull(), F.col("ratio") == float("inf")
    yes = lambda c: F.count_if(used & F.coalesce(c, F.lit(False)))
    out = long.groupBy(*kind, "pattern", "cohort", "threshold").agg(
        yes(known & (F.abs("ratio") < float("inf"))).alias("n_finite"), yes(inf).alias("n_infinite"), yes(~F.coalesce(known, F.lit(False))).alias("n_undefined"),
        yes(known & (F.col("ratio") >= F.col("threshold"))).alias("n_at_least"), *([F.count_if(~used).alias("n_not_applicable")] if every else []))
    return out.withColumn("infinite_percent", F.try_divide(F.col("n_infinite") * 100.0, "n_at_least"))


def cycle_day_profile(daily: DataFrame, most: int = 35) -> DataFrame:
    out = daily.where(F.col("cycle_day").between(1, most)).groupBy("cohort", "cycle_day").agg(F.count("*").alias("days"), F.sum("seizure_count").alias("events"))
    return out.withColumn("rate", F.col("events") / F.col("days")).withColumn("error", F.sqrt(F.greatest("events", F.lit(1))) / F.col("days"))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float, *keys: str) -> DataFrame:
    """Equal bins of [low, high], the last closed; values outside are left out."""
    v = F.col(value)
    b = F.least(F.floor((v - low) / F.lit((high - low) / bins)).cast("int"), F.lit(bins - 1))
    out = df.where(v.between(low, high)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    total = out.groupBy(*keys).agg(F.sum("n").alias("total")) if keys else out.agg(F.sum("n").alias("total"))
    joined = out.join(F.broadcast(total), list(keys)) if keys else out.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("share", F.col("n") / F.col("total")).drop("total")


# The panels of realised distributions and their fields, four of each.
PANELS = {
    "seizure_process": ["seizures_per_month", "seizure_days_per_month", "daily_count_overdispersion", "next_day_cluster_propensity"],
    "seizure_rhythm": ["dominant_seizure_cycle_days", "spectral_dominant_period_days", "spectral_amplitude_seizures_per_day", "mean_seizure_frequency_month"],
    "menstrual_cycle": ["mean_cycle_length", "sd_cycle_length", "ovulatory_fraction", "audit_ilp_fraction"],
}
#: Shown for the population alone.
POPULATION_ONLY = ("audit_ilp_fraction",)


def winsorized_histogram(people: DataFrame, panels: dict[str, list[str]] = PANELS, bins: int = 35) -> DataFrame:
    """``panel, field, cohort, bin, lower, n, density``: realised values of participants clipped to their 0.5 and 99.5 percentiles by cohort
    (infinite ones left out), in equal bins between the two, the last closed; values that all agree lie in the middle of a bin range of width 1.

    Fields that ``people`` lacks are left out. Values are rounded to 9 decimals, so that they don't cross an edge by the order of a sum.
    """
    some = [(p, f) for p, fields in panels.items() for f in fields if f in people.columns]
    pairs = ", ".join(f"'{p}', '{f}', round(cast({f} as double), 9)" for p, f in some)
    rows = people.select("cohort", F.expr(f"stack({len(some)}, {pairs}) as (panel, field, v)")).withColumn("v", C.finite_or_null("v")).where("v is not null")
    rows = rows.where(~F.col("field").isin(*POPULATION_ONLY) | (F.col("cohort") == "population"))
    key = ["panel", "field", "cohort"]
    edge = quantiles(rows, key, "v", [0.005, 0.995]).select(*key, F.col("n").alias("total"), F.round(F.get("quantiles", F.lit(0)), 9).alias("lo"), F.round(F.get("quantiles", F.lit(1)), 9).alias("hi"))
    alone = F.col("lo") == F.col("hi")
    edge = edge.select(*key, "total", F.when(alone, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(alone, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    each = rows.join(F.broadcast(edge), key).withColumn("v", F.least(F.greatest("v", "lo"), "hi"))  # a row a field and cohort
    width = (F.col("hi") - F.col("lo")) / bins
    each = each.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / width).cast("int"), F.lit(bins - 1)))
    out = each.groupBy(*key, "bin", "lo", "hi", "total").agg(F.count("*").alias("n"))
    return out.select(*key, "bin", (F.col("lo") + F.col("bin") * width).alias("lower"), "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def age_histogram(participants: DataFrame, bins: int = 30) -> DataFrame:
    """Density of ages in equal bins between the least and the largest of each cohort, the last closed."""
    rows = participants.select("cohort", F.col("age").cast("double").alias("v")).where("v is not null")
    edge = rows.groupBy("cohort").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    width = F.try_divide(F.col("hi") - F.col("lo"), F.lit(bins))
    each = rows.join(F.broadcast(edge), "cohort")  # a row a cohort
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)).cast("int"), F.lit(bins - 1)), F.lit(0))
    out = each.groupBy("cohort", at.alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
    return out.select("cohort", "bin", (F.col("lo") + F.col("bin") * width).alias("lower"), "n", F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def modifier_prevalence(participants: DataFrame, modifiers: list[str] = BINARY) -> DataFrame:
    """Share of each cohort with each modifier."""
    return participants.groupBy("cohort").agg(F.count("*").alias("n"), *[F.avg(F.col(m).cast("int")).alias(m) for m in modifiers])


def prevalence_histogram(studies: DataFrame, bins: int = 30) -> DataFrame:
    """Shares of simulated studies by apparent prevalence among all participants, for each cohort and study size: of
    ``A_windowed_any``, strict labelling (of all definitions if it is not there)."""
    strict = studies.where("phase_mode = 'strict_herzog'")
    main = strict.where("definition = 'A_windowed_any'")
    return histogram(strict if main.isEmpty() else main, "prevalence_all", bins, 0.0, 1.0, "cohort", "n_participants")


#: Definitions of the frontier and of the comparison with historical ones.
SHOWN = ["A_windowed_any", "A_windowed_C1_or_C2", "B_minimum_data_C1_or_C2", "D_nb_regression_C1_or_C2", "H1_newmark_penry_any", "H2_duncan1993_any", "H3_herzog1997_twofold_any", "H4_reddy2007_any_phase2x_any"]


def _shown(summary: DataFrame) -> DataFrame:
    rows = summary.where("table_type = 'window_false_positive' and subset = 'all' and false_positive_rate is not null")
    return rows.where(F.col("definition").isin(SHOWN))


def frontier(summary: DataFrame) -> DataFrame:
    """A point (indeterminate rate, false-positive rate) for every window kind and phase mode of the shown definitions."""
    return _shown(summary).select("definition", "cohort", "phase_mode", "window_type", "window_value", "indeterminate_rate", "false_positive_rate")


def core_vs_historical(summary: DataFrame) -> DataFrame:
    """Mean rate of each shown definition and cohort over the three-month windows, over all windows if there are none."""
    rows = _shown(summary)
    three = rows.where("window_type = 'calendar' and window_value = '3'")
    rows = rows if three.isEmpty() else three
    return rows.groupBy("cohort", "definition", "assumption_based_historical").agg(F.avg("false_positive_rate").alias("false_positive_rate"))


# Categories of the composition, from the axis outwards.
CATEGORIES = ["none", "indeterminate", "C3 only", "C3 plus C1/C2", "C1 only", "C2 only", "C1+C2"]


def stacked_composition(windows: DataFrame) -> DataFrame:
    """``cohort, definition, category, n, share``: pattern categories and indeterminate windows of definitions A and B as shares of all attempted
    full diaries, strict labelling; categories that do not occur are there with 0."""
    rows = windows.where("phase_mode = 'strict_herzog' and window_type = 'full'")
    each = rows.select("cohort", F.expr("stack(2, 'A_windowed', label_A_windowed_pattern_category, 'B_minimum_data', label_B_pattern_category) as (definition, category)"))
    own = F.coalesce("category", F.lit("indeterminate"))
    counts = each.groupBy("cohort", "definition").agg(F.count("*").alias("total"), *[F.count_if(own == c).alias(f"_{i}") for i, c in enumerate(CATEGORIES)])
    marks = ", ".join(f"'{c}', _{i}" for i, c in enumerate(CATEGORIES))
    long = counts.select("cohort", "definition", "total", F.expr(f"stack({len(CATEGORIES)}, {marks}) as (category, n)"))
    return long.select("cohort", "definition", "category", "n", (F.col("n") / F.col("total")).alias("share"))
