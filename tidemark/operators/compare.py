"""Comparison of two runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null
from .diagnostics import BINARY, assert_unique_key

MISSING = "<NA>"
# Keys and metrics by which summary tables of two runs are aligned and compared.
KEYS = ["table_type", "subset", "cohort", "window_type", "window_value", "definition", "phase_mode", "assumption_based_historical", "n_participants", "pattern_category", "indeterminate_reason"]
METRICS = [
    "n_windows", "n_classifiable", "positives", "false_positive_rate", "wilson95_low", "wilson95_high", "indeterminate_rate", "positive_rate_all_attempted", "n_indeterminate",
    "p_prevalence_ge_39_1", "p_prevalence_ge_44_2",
]
SELECTED_KEYS = ["cohort", "window_type", "window_value", "definition", "phase_mode"]
SELECTED_METRICS = ["n_classifiable", "positives", "false_positive_rate", "indeterminate_rate"]


def normalize_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys as text, null ones as a mark, absent ones empty."""
    return df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit(MISSING)) if k in df.columns else F.lit("") for k in keys})


def _sides(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    a = assert_unique_key(normalize_keys(old, keys), *keys).select(*keys, F.lit(True).alias("_old"), *[F.col(m).cast("double").alias(f"old_{m}") for m in metrics])
    b = assert_unique_key(normalize_keys(new, keys), *keys).select(*keys, F.lit(True).alias("_new"), *[F.col(m).cast("double").alias(f"new_{m}") for m in metrics])
    return a.join(b, keys, "full_outer")


def diff_runs(old: DataFrame, new: DataFrame, keys: list[str] = KEYS, metrics: list[str] = METRICS) -> DataFrame:
    """A row a metric that both have: rows in both, in one only, comparable and changed values, largest and mean change."""
    metrics = [m for m in metrics if m in old.columns and m in new.columns]
    pairs = ", ".join(f"'{m}', old_{m}, new_{m}" for m in metrics)
    both = _sides(old, new, keys, metrics).select("_old", "_new", F.expr(f"stack({len(metrics)}, {pairs}) as (metric, a, b)"))
    aligned = F.col("_old") & F.col("_new")
    d = finite_or_null(F.when(F.coalesce(aligned, F.lit(False)), F.abs(F.col("b") - F.col("a"))))
    return both.groupBy("metric").agg(
        F.count_if(F.coalesce(aligned, F.lit(False))).alias("n_aligned"), F.count_if(F.col("_new").isNull()).alias("n_old_only"), F.count_if(F.col("_old").isNull()).alias("n_new_only"),
        F.count(d).alias("n_comparable"), F.count_if(F.coalesce(d > 1e-12, F.lit(False))).alias("n_changed"), F.max(d).alias("max_abs_delta"), F.avg(d).alias("mean_abs_delta"))


def diff_selected(old: DataFrame, new: DataFrame, keys: list[str] = SELECTED_KEYS, metrics: list[str] = SELECTED_METRICS) -> DataFrame:
    """Old, new and difference side by side, and which side has the row."""
    both = _sides(old, new, keys, metrics)
    where = F.when(F.col("_new").isNull(), "left_only").when(F.col("_old").isNull(), "right_only").otherwise("both")
    value = lambda side, m: finite_or_null(f"{side}_{m}")
    return both.select(*keys, where.alias("alignment"), *[c for m in metrics for c in (value("old", m).alias(f"{m}_old"), value("new", m).alias(f"{m}_new"), (value("new", m) - value("old", m)).alias(f"{m}_delta"))])


def selected_endpoints(summary: DataFrame) -> DataFrame:
    """The rows reported for each run, strict labelling: main definitions on full diaries, any pattern on three months, the exact
    rule on three cycles."""
    rows = summary.where("table_type = 'window_false_positive' and subset = 'all' and phase_mode = 'strict_herzog'")
    filters = [
        "window_type = 'full' and definition in ('A_windowed_any', 'A_windowed_C1_or_C2', 'A_windowed_C3_only', 'D_nb_regression_C1_or_C2')",
        "window_type = 'calendar' and window_value = '3' and definition = 'A_windowed_any'", "window_type = 'cycle' and window_value = '3' and definition = 'A_exact_any'",
    ]
    return rows.where(reduce(lambda a, b: a | b, map(F.expr, filters))).orderBy("window_type", "definition", "cohort")


def run_cohort_summary(participants: DataFrame) -> DataFrame:
    """Numbers, means and, where the table has them, prevalences of modifiers by cohort."""
    means = ["age", "mean_cycle_length", "sd_cycle_length", "ovulatory_fraction", "seizure_days_per_month", "seizures_per_month"]
    shares = [c for c in BINARY if c in participants.columns]
    return participants.groupBy("cohort").agg(
        F.count("*").alias("n_participants"), *[F.avg(c).alias(f"mean_{c}") for c in means], *[F.avg(F.col(c).cast("int")).alias(f"prevalence_{c}") for c in shares])


def diff_cohorts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two participant tables' cohort summaries side by side."""
    a, b = run_cohort_summary(old), run_cohort_summary(new)
    metrics = [c for c in dict.fromkeys([*a.columns, *b.columns]) if c != "cohort"]
    fill = lambda df: df.select("cohort", *[F.col(m) if m in df.columns else F.lit(None).cast("double").alias(m) for m in metrics])
    return diff_selected(fill(a), fill(b), ["cohort"], metrics).drop("alignment")
