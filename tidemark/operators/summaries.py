"""Rates, subsets and reports over the window table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

# Reported definitions and their label columns, the historical ones, and the pattern categories.
DEFINITIONS = {
    "A_exact_any": "label_A_exact_any", "A_windowed_any": "label_A_windowed_any", "A_windowed_excluding_C3": "label_A_windowed_excluding_C3", "A_windowed_C1_or_C2": "label_A_windowed_C1_or_C2",
    "A_windowed_C1_only": "label_A_windowed_C1", "A_windowed_C2_only": "label_A_windowed_C2", "A_windowed_C3_only": "label_A_windowed_C3", "B_minimum_data_any": "label_B_any",
    "B_minimum_data_excluding_C3": "label_B_excluding_C3", "B_minimum_data_C1_or_C2": "label_B_C1_or_C2", "C_reproducibility_any": "label_C_any", "C_reproducibility_C1_or_C2": "label_C_C1_or_C2",
    "C_reproducibility_12cycle_any": "label_C12_any", "C_reproducibility_12cycle_C1_or_C2": "label_C12_C1_or_C2", "D_nb_regression_any": "label_D_any", "D_nb_regression_C1_or_C2": "label_D_C1_or_C2",
    "D_nb_regression_window_alpha_any": "label_D_window_alpha_any", "D_nb_regression_window_alpha_C1_or_C2": "label_D_window_alpha_C1_or_C2", "H1_newmark_penry_any": "label_H1_any",
    "H1_newmark_penry_66_7_any": "label_H1_sensitivity_any", "H2_duncan1993_any": "label_H2_any", "H3_herzog1997_twofold_any": "label_H3_any", "H4_reddy2007_any_phase2x_any": "label_H4_any",
}
CATEGORY_COLUMNS = {"A_windowed": "label_A_windowed_pattern_category", "B_minimum_data": "label_B_pattern_category", "C_reproducibility": "label_C_pattern_category", "D_nb_regression": "label_D_pattern_category"}
CATEGORIES = ["C1 only", "C2 only", "C1+C2", "C3 only", "C3 plus C1/C2", "none"]
REASONS = {"A_exact_any": "a_exact_reason", "A_windowed_any": "a_windowed_reason", "B_minimum_data_any": "b_reason", "C_reproducibility_any": "c_reason", "D_nb_regression_any": "d_reason"}
HEADLINE = ["A_windowed_any", "A_windowed_C1_or_C2", "B_minimum_data_any", "B_minimum_data_C1_or_C2", "C_reproducibility_any", "D_nb_regression_C1_or_C2"]
UNSTABLE = "unstable; not interpreted"
LEAST_CLASSIFIABLE = 1000
GROUP = ["cohort", "phase_mode", "window_type", "window_value"]


def subset_names(columns: list[str]) -> Column:
    """Names of the overlapping subsets that a window is in, as an array. Commonly classifiable are windows with a label under
    each of A to D that is among ``columns``."""
    c = F.col
    labels = [x for x in ("label_A_windowed_any", "label_B_any", "label_C_any", "label_D_any") if x in columns]
    common = reduce(lambda a, b: a & b, [c(x).isNotNull() for x in labels], F.lit(bool(labels)))
    masks = {
        "all": F.lit(True), "ge_1_seizure_day_per_month": c("seizure_days_per_month") >= 1, "ge_2_seizures_per_month": c("seizures_per_month") >= 2,
        "strict_23_35_day_cycles_only": c("strict_herzog_eligible_flag"), "common_classifiable_subset": common, "window_seizure_days_0_to_3": c("seizure_days_total") <= 3,
        "window_seizure_days_4_to_7": c("seizure_days_total").between(4, 7), "window_seizure_days_8_to_15": c("seizure_days_total").between(8, 15), "window_seizure_days_ge_16": c("seizure_days_total") >= 16,
    }
    return F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in masks.items()]))


def stratum_names() -> Column:
    return F.array_compact(F.array(F.concat(F.lit("seizure_frequency:"), F.col("seizure_frequency_stratum")), F.concat(F.lit("cycle_regularity:"), F.col("cycle_regularity_stratum"))))


def with_missing(df: DataFrame, columns, kind: str = "boolean") -> DataFrame:
    """Adds the columns that are absent as nulls."""
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def _present(df: DataFrame, named: dict[str, str]) -> dict[str, str]:
    return {k: v for k, v in named.items() if v in df.columns}


def _counts(labels: dict[str, str]) -> list[Column]:
    """For each definition the labelled and the positive rows, side by side, so that no row is multiplied by the definitions."""
    return [x for i, v in enumerate(labels.values()) for x in (F.count(v).alias(f"_n{i}"), F.count_if(F.coalesce(v, F.lit(False))).alias(f"_p{i}"))]


def _stacked(wide: DataFrame, keep: list[str], labels: dict[str, str]) -> DataFrame:
    triples = ", ".join(f"'{k}', _n{i}, _p{i}" for i, k in enumerate(labels))
    return wide.select(*keep, F.expr(f"stack({len(labels)}, {triples}) as (definition, n_classifiable, positives)"))


def _rates(df: DataFrame, attempted: str = "n_windows", interval: bool = True) -> DataFrame:
    """Rates over the classifiable and over all attempted, the interval, and the mark of a small denominator."""
    df = df.withColumn("false_positive_rate", F.try_divide("positives", "n_classifiable")).withColumn("positive_rate_all_attempted", F.try_divide("positives", attempted))
    if interval:
        low, high = C.wilson("positives", "n_classifiable")
        df = df.withColumn("wilson95_low", low).withColumn("wilson95_high", high)
    few = (F.col("n_classifiable") > 0) & (F.col("n_classifiable") < LEAST_CLASSIFIABLE)
    df = df.withColumn("indeterminate_rate", 1 - F.try_divide("n_classifiable", attempted)).withColumn("unstable_denominator", few)
    return df.withColumn("interpretation_note", F.when(few, UNSTABLE).otherwise(""))


def summarize_windows(df: DataFrame, definitions: dict[str, str] = DEFINITIONS, strata: bool = True) -> DataFrame:
    """A rate for each subset, definition (of those whose label the table has) and window kind. Each row is read once and counted
    where it is, before anything is shuffled."""
    labels, names = _present(df, definitions), subset_names(df.columns)
    each = df.withColumn("subset", F.explode(F.concat(names, stratum_names()) if strata else names))
    wide = each.groupBy("subset", *GROUP).agg(F.count("*").alias("n_windows"), *_counts(labels))
    out = _rates(_stacked(wide, ["subset", *GROUP, "n_windows"], labels))
    return out.withColumn("assumption_based_historical", F.col("definition").startswith("H")).withColumn("table_type", F.lit("window_false_positive"))


def summarize_participants(df: DataFrame, definitions: dict[str, str] = DEFINITIONS) -> DataFrame:
    """By window kind: a participant is positive if one of the windows is, classifiable if one is."""
    labels = _present(df, definitions)
    people = df.groupBy(*GROUP, "participant_id").agg(F.count("*").alias("n"), *[F.max(v).alias(v) for v in labels.values()])
    wide = people.groupBy(*GROUP).agg(F.sum("n").alias("n_windows"), F.count("*").alias("n_participants"), *_counts(labels))
    out = _rates(_stacked(wide, [*GROUP, "n_windows", "n_participants"], labels), "n_participants")
    out = out.withColumn("assumption_based_historical", F.col("definition").startswith("H")).withColumn("subset", F.lit("any_window_per_participant"))
    return out.withColumn("table_type", F.lit("participant_false_positive"))


def summarize_patterns(df: DataFrame) -> DataFrame:
    """Counts of the six categories for each group and definition, zeros included."""
    named = _present(df, CATEGORY_COLUMNS)
    pairs = ", ".join(f"'{k}', {v}" for k, v in named.items())
    long = df.select(*GROUP, F.expr(f"stack({len(named)}, {pairs}) as (definition, category)"))
    counts = [F.count_if(F.col("category") == c).alias(f"_{i}") for i, c in enumerate(CATEGORIES)]
    wide = long.groupBy(*GROUP, "definition").agg(F.count("*").alias("n_windows"), F.count("category").alias("n_classifiable"), *counts)
    stacked = ", ".join(f"'{c}', _{i}" for i, c in enumerate(CATEGORIES))
    out = wide.select(*GROUP, "definition", "n_windows", "n_classifiable", F.expr(f"stack({len(CATEGORIES)}, {stacked}) as (pattern_category, positives)"))
    return _rates(out, interval=False).withColumn("subset", F.lit("mutually_exclusive_patterns")).withColumn("table_type", F.lit("pattern_decomposition"))


def summarize_reasons(df: DataFrame, reasons: dict[str, str] = REASONS) -> DataFrame:
    """Why windows have no label: count of each reason (none given counts as unknown), of all without a label, and share
    of all windows. Definitions whose label or reason the table lacks are left out."""
    own = {k: v for k, v in _present(df, reasons).items() if DEFINITIONS[k] in df.columns}
    rows = ", ".join(f"'{d}', {DEFINITIONS[d]}, {r}" for d, r in own.items())
    why = F.when(F.col("label").isNull(), F.coalesce("reason", F.lit("unknown")))
    long = df.select(*GROUP, F.expr(f"stack({len(own)}, {rows}) as (definition, label, reason)"))
    counts = long.groupBy(*GROUP, "definition", why.alias("indeterminate_reason")).agg(F.count("*").alias("positives"))
    kind = Window.partitionBy(*GROUP, "definition")  # a few reasons each
    counts = counts.withColumn("n_windows", F.sum("positives").over(kind)).withColumn("n_indeterminate", F.sum(F.when(F.col("indeterminate_reason").isNotNull(), F.col("positives"))).over(kind))
    out = counts.where("indeterminate_reason is not null").withColumn("positive_rate_all_attempted", F.col("positives") / F.col("n_windows"))
    return out.withColumn("subset", F.lit("all")).withColumn("table_type", F.lit("indeterminate_reasons"))


def summarize_studies(studies: DataFrame, benchmarks: tuple[float, float] = (0.391, 0.442)) -> DataFrame:
    """Mean, 2.5 and 97.5 percentiles and shares at or above the benchmarks, for both denominators."""
    kinds = "stack(2, 'apparent_prevalence_all', prevalence_all, 'apparent_prevalence_classifiable', prevalence_classifiable) as (subset, prevalence)"
    long = studies.select("cohort", "phase_mode", "n_participants", "definition", F.expr(kinds))
    p = F.percentile("prevalence", F.array(F.lit(0.025), F.lit(0.975)))
    shares = [F.avg((F.col("prevalence") >= b).cast("int")).alias(f"p_prevalence_ge_{b * 100:.1f}".replace(".", "_")) for b in benchmarks]
    out = long.groupBy("cohort", "phase_mode", "n_participants", "definition", "subset").agg(F.count("prevalence").alias("n_windows"), F.avg("prevalence").alias("false_positive_rate"), p.alias("p"), *shares)
    out = out.withColumn("n_classifiable", F.col("n_windows")).withColumn("positive_rate_all_attempted", F.col("false_positive_rate"))
    out = out.withColumn("wilson95_low", F.get("p", F.lit(0))).withColumn("wilson95_high", F.get("p", F.lit(1))).drop("p")
    out = out.withColumn("window_type", F.lit("study_mc_calendar")).withColumn("window_value", F.lit("3")).withColumn("assumption_based_historical", F.col("definition").startswith("H"))
    return out.withColumn("unstable_denominator", F.lit(False)).withColumn("interpretation_note", F.lit("")).withColumn("table_type", F.lit("study_level_3month"))


def headline(summary: DataFrame) -> DataFrame:
    """The rates of the main definitions on full diaries, strict labelling."""
    rows = summary.where("table_type = 'window_false_positive' and subset = 'all' and phase_mode = 'strict_herzog' and window_type = 'full'")
    return rows.where(F.col("definition").isin(HEADLINE)).select("cohort", "definition", "n_classifiable", "false_positive_rate", "wilson95_low", "wilson95_high").orderBy("cohort", "definition")


def unified_summary(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def cohort_table(participants: DataFrame) -> DataFrame:
    means = ["mean_cycle_length", "sd_cycle_length", "ovulatory_fraction", "seizure_days_per_month", "seizures_per_month"]
    return participants.groupBy("cohort").agg(F.countDistinct("participant_id").alias("participants"), F.avg("age").alias("age_mean"), F.stddev_samp("age").alias("age_sd"), *[F.avg(c).alias(c) for c in means])


def report_slices(summary: DataFrame) -> dict[str, DataFrame]:
    """The nine views of the unified summary that reports show: filter, projection and order."""
    base = summary.withColumn("window", C.window_label("window_type", "window_value")).withColumn("rate_ci", C.rate_ci_text("false_positive_rate", "wilson95_low", "wilson95_high"))
    rates = base.where("table_type = 'window_false_positive'")
    strict = rates.where("phase_mode = 'strict_herzog'")
    whole = strict.where("subset = 'all'")
    three = (F.col("window_type") == "calendar") & (F.col("window_value") == "3")
    full = F.col("window_type") == "full"
    counts = ["n_classifiable", "positives"]

    def view(df: DataFrame, where: Column, keys: list[str], rest: list[str], order: list[str] | None = None) -> DataFrame:
        return df.where(where).select(*keys, *rest).orderBy(*(order or keys))

    defined = lambda *names: F.col("definition").isin(*names)
    a = ["A_windowed_any", "A_windowed_C1_or_C2"]
    kind = F.when(F.col("subset").startswith("seizure_frequency:"), "seizure frequency").when(F.col("subset").startswith("cycle_regularity:"), "cycle regularity").when(F.col("subset").startswith("window_seizure_days_"), "window seizure days")
    name = F.when(F.col("subset").contains(":"), F.split_part("subset", F.lit(":"), F.lit(2))).otherwise(F.replace(F.replace("subset", F.lit("window_seizure_days_"), F.lit("")), F.lit("_"), F.lit(" ")))
    strata = strict.withColumn("stratum_type", kind).withColumn("stratum", name)
    shown = F.col("subset").isin("ge_1_seizure_day_per_month", "ge_2_seizures_per_month", "strict_23_35_day_cycles_only", "common_classifiable_subset")
    return {
        "primary": view(whole, full & defined(*HEADLINE), ["cohort", "definition"], ["n_windows", *counts, "rate_ci", "indeterminate_rate"]),
        "by_window": view(
            whole, defined("A_exact_any", *a, "B_minimum_data_C1_or_C2", "C_reproducibility_C1_or_C2", "D_nb_regression_C1_or_C2"), ["cohort", "window", "definition"], [*counts, "false_positive_rate", "indeterminate_rate"]
        ),
        "phase_mode": view(
            rates.where("subset = 'all'"), (full | three) & defined(*a, "A_windowed_C3_only"), ["cohort", "phase_mode", "window", "definition"], [*counts, "rate_ci", "indeterminate_rate"],
            ["cohort", "window", "definition", "phase_mode"],
        ),
        "study": view(
            base.where("table_type = 'study_level_3month' and phase_mode = 'strict_herzog'"), defined("A_windowed_any", "B_minimum_data_C1_or_C2", "C_reproducibility_C1_or_C2", "D_nb_regression_C1_or_C2"),
            ["cohort", "definition", "n_participants", "subset"], ["n_windows", "false_positive_rate", "wilson95_low", "wilson95_high", *[c for c in base.columns if c.startswith("p_prevalence_ge_")]],
        ),
        "subsets": view(
            strict, full & shown & defined(*a, "B_minimum_data_C1_or_C2", "C_reproducibility_C1_or_C2", "D_nb_regression_C1_or_C2"), ["cohort", "subset", "definition"], [*counts, "rate_ci", "indeterminate_rate"]
        ),
        "patterns": view(
            base.where("table_type = 'pattern_decomposition' and phase_mode = 'strict_herzog'"), full & defined("A_windowed", "B_minimum_data", "D_nb_regression"), ["cohort", "definition", "pattern_category"],
            [*counts, "false_positive_rate", "positive_rate_all_attempted", "indeterminate_rate"],
        ),
        "alpha": view(whole, full & defined("D_nb_regression_C1_or_C2", "D_nb_regression_window_alpha_C1_or_C2"), ["cohort", "window", "definition"], [*counts, "rate_ci", "indeterminate_rate"]),
        "strata": view(
            strata.where("stratum_type is not null"), defined(*a, "B_minimum_data_C1_or_C2", "D_nb_regression_C1_or_C2"), ["cohort", "stratum_type", "stratum", "definition"], [*counts, "false_positive_rate", "indeterminate_rate"]
        ),
        "historical": view(
            whole.where("assumption_based_historical"), full | three, ["cohort", "window", "definition"], [*counts, "rate_ci", "indeterminate_rate", "assumption_based_historical"]
        ),
    }
