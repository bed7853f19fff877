"""Counters of each window from running sums, and the definitions as projections of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .diary import MODES, fan_out_phase_modes
from .windows import KEYS

PHASES = ("M", "O", "F", "L")


def _sum_if(condition: Column, value=1) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def phase_counts(days: DataFrame, *keys: str) -> DataFrame:
    """Days and events of each phase by the keys (``days_M, events_M, ...``)."""
    return days.groupBy(*keys).agg(*[x for p in PHASES for x in (_sum_if(F.col("phase") == p).alias(f"days_{p}"), _sum_if(F.col("phase") == p, F.col("seizure_count")).alias(f"events_{p}"))])


def _counters() -> dict[str, Column]:
    """All additive counters of a day."""
    phase, ev = F.col("phase"), F.col("seizure_count")
    one = lambda condition: F.when(condition, 1)
    out = {
        "n_days": F.lit(1), "seizure_count_total": ev, "seizure_days_total": F.col("seizure_day"), "squares": ev * ev, "labelled_days": one(phase.isNotNull()), "_not_strict": one(~F.col("strict_herzog_cycle_eligible")),
        "_short": one(F.col("short_cycle_modified_flag")), "_anchored": one(F.col("luteal_anchored_ovulatory_flag")), "_ilp": one(F.col("ilp_flag")), "_under": one(F.col("cycle_length") < 23),
    }
    for p in PHASES:
        here, ilp = phase == p, (phase == p) & F.col("ilp_flag")
        out |= {f"days_{p}": one(here), f"events_{p}": F.when(here, ev), f"ilp_days_{p}": one(ilp), f"ilp_events_{p}": F.when(ilp, ev)}
    for p in ("P", "F", "O", "L"):
        out |= {f"reddy_days_{p}": one(F.col("phase_reddy") == p), f"reddy_events_{p}": F.when(F.col("phase_reddy") == p, ev)}
    d, b = F.col("cycle_day"), F.col("backward_day")
    return out | {"h1_events": F.when(d.between(1, 4) | b.between(-3, -1), ev), "h2_events": F.when(d.between(1, 6) | b.between(-4, -1), ev)}


DAY_COLUMNS = ["phase", "phase_reddy", "seizure_count", "seizure_day", "strict_herzog_cycle_eligible", "short_cycle_modified_flag", "luteal_anchored_ovulatory_flag", "ilp_flag", "cycle_length", "cycle_day", "backward_day"]


def _upto_ends(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Days with ``_day``: the next day, from the day itself on, at which a window of the participant ends or before which one begins; days after
    all of these are left out, as no window asks for them. A participant's windows are one row with such a day for each of the days."""
    ends = windows.where("valid").select("participant_id", F.explode(F.array((F.col("start_day") - 1).cast("long"), F.col("end_day").cast("long"))).alias("_end"))
    each = ends.where("_end is not null").groupBy("participant_id").agg(F.sort_array(F.collect_set("_end")).alias("_ends"))
    steps = F.transform(F.sequence(F.lit(2), F.size("_ends")), lambda i: F.array_repeat(F.get("_ends", i - 1), (F.get("_ends", i - 1) - F.get("_ends", i - 2)).cast("int")))
    first = F.get("_ends", F.lit(0))
    each = each.select("participant_id", first.alias("_first"), F.when(F.size("_ends") > 1, F.flatten(steps)).alias("_next"))
    at = F.when(F.col("calendar_day_index") <= F.col("_first"), F.col("_first")).otherwise(F.get("_next", (F.col("calendar_day_index") - F.col("_first") - 1).cast("int")))
    keep = ["participant_id", "phase_mode", *DAY_COLUMNS]
    return daily.join(each.hint("shuffle_hash"), "participant_id").select(*keep, at.alias("_day")).where("_day is not null")


def window_counters(daily: DataFrame, windows: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """All additive counters of each window and phase mode, and the window's own columns; windows without
    days are kept with zeros. Every pooled label is a projection of this table.

    Days are read once a mode however many windows overlap, and summed where they are up to the next day at which a window ends or before
    which one begins. Running sums go over these few sums: a window asks for those at its last day and at the day before its first, as two rows beside them. ``modes`` (``cohort, phase_mode``) are
    those of ``daily``; without them they are looked up there.
    """
    modes = daily.select("cohort", "phase_mode").distinct() if modes is None else modes
    each = windows.join(F.broadcast(modes), "cohort")  # a row for each cohort and mode
    counters, who = _counters(), ["participant_id", "phase_mode"]
    ends = F.explode(F.array(F.struct((F.col("start_day") - 1).cast("long").alias("day"), F.lit(-1).alias("sign")), F.struct(F.col("end_day").cast("long").alias("day"), F.lit(1).alias("sign"))))
    asked = each.where("valid").select(*who, *KEYS[1:], ends.alias("_end")).select(*who, *KEYS[1:], F.col("_end.day").alias("_day"), F.col("_end.sign").alias("_sign"))
    upto = Window.partitionBy(*who).orderBy("_day", F.abs("_sign")).rowsBetween(Window.unboundedPreceding, 0)
    days = _upto_ends(daily, windows).groupBy(*who, "_day").agg(*[F.sum(c).cast("long").alias(n) for n, c in counters.items()]).withColumn("_sign", F.lit(0))
    sums = days.unionByName(asked, allowMissingColumns=True).select(*who, *KEYS[1:], "_sign", *[F.sum(n).over(upto).alias(n) for n in counters])
    counted = sums.where("_sign <> 0").groupBy("phase_mode", *KEYS).agg(*[F.sum(F.coalesce(n, F.lit(0)) * F.col("_sign")).alias(n) for n in counters])
    out = each.join(counted, ["phase_mode", *KEYS], "left").na.fill(0, list(counters))
    flags = {
        "strict_herzog_eligible_flag": (F.col("n_days") > 0) & (F.col("_not_strict") == 0), "short_cycle_modified_flag": F.col("_short") > 0, "luteal_anchored_ovulatory_flag": F.col("_anchored") > 0,
        "any_ilp": F.col("_ilp") > 0, "any_short": F.col("_under") > 0,
    }
    return out.withColumns(flags).drop("_not_strict", "_short", "_anchored", "_ilp", "_under")


def base_fields(counters: DataFrame) -> DataFrame:
    """Per-month rates, whether C3 applies, and whether the window can be analysed."""
    months = C.month_denominator("n_days")
    return counters.withColumns(
        {
            "seizure_days_per_month": F.col("seizure_days_total") / months, "seizures_per_month": F.col("seizure_count_total") / months,
            "c3_applicable_flag": (F.col("cohort") == "population") & F.col("any_ilp"), "analyzable_flag": F.col("valid") & (F.col("labelled_days") > 0),
        }
    )


def pooled_ratios(df: DataFrame, prefix: str = "") -> DataFrame:
    """``adsf_*``, ``rr_C1..C3`` and their reasons from the counters (``c3_applicable_flag`` decides on C3)."""
    c = lambda name: F.col(name)
    fl_d, fl_e = c("days_F") + c("days_L"), c("events_F") + c("events_L")
    short = c("short_cycle_modified_flag") & c("any_short")
    rate = lambda e, d: F.when(d > 0, F.try_divide(e.cast("double"), d))
    out = df.withColumns(
        {
            "_c1": C.adsf_ratio("events_M", "days_M", F.when(short, c("events_L")).otherwise(fl_e), F.when(short, c("days_L")).otherwise(fl_d)),
            "_c2": C.adsf_ratio("events_O", "days_O", fl_e, fl_d),
            "_c3": C.adsf_ratio(c("ilp_events_O") + c("ilp_events_L") + c("ilp_events_M"), c("ilp_days_O") + c("ilp_days_L") + c("ilp_days_M"), "ilp_events_F", "ilp_days_F"),
            **{f"adsf_{p}": rate(c(f"events_{p}"), c(f"days_{p}")) for p in PHASES},
            "adsf_FL": rate(fl_e, fl_d), "adsf_OLM": rate(c("events_O") + c("events_L") + c("events_M"), c("days_O") + c("days_L") + c("days_M")),
        }
    )
    ok = c("n_days") > 0
    use3 = ok & c("c3_applicable_flag")
    return out.withColumns(
        {
            "rr_C1": F.when(ok, c("_c1.ratio")), "rr_C2": F.when(ok, c("_c2.ratio")), "rr_C3": F.when(use3, c("_c3.ratio")),
            "reason_C1": F.when(ok, c("_c1.reason")), "reason_C2": F.when(ok, c("_c2.reason")), "reason_C3": F.when(use3, c("_c3.reason")),
        }
    ).drop("_c1", "_c2", "_c3")


def _family(df: DataFrame, name: str, c1: Column, c2: Column, c3: Column) -> DataFrame:
    df = df.withColumns({f"label_{name}_C1": c1, f"label_{name}_C2": c2, f"label_{name}_C3": c3})
    a, b, c = (F.col(f"label_{name}_{p}") for p in ("C1", "C2", "C3"))
    return df.withColumns({f"label_{name}_any": C.any_known(a, b, c), f"label_{name}_C1_or_C2": C.any_known(a, b), f"label_{name}_excluding_C3": C.any_known(a, b), f"label_{name}_pattern_category": C.pattern_category(a, b, c)})


def label_a_windowed(df: DataFrame, thresholds: dict[str, float] = C.THRESHOLDS) -> DataFrame:
    out = _family(df, "A_windowed", *[C.ratio_positive(f"rr_{p}", thresholds[p]) for p in ("C1", "C2", "C3")])
    return out.withColumn("a_windowed_reason", C.first_reason("reason_C1", "reason_C2", "reason_C3"))


def minimum_data_reason(min_months: float = 4.0, min_cycles: int = 6, min_days: int = 4) -> Column:
    """Null if the window has enough data for definitions B and D, else why not."""
    cycles = F.coalesce((F.col("window_type") == "cycle") & (F.expr("try_cast(window_value as int)") >= min_cycles), F.lit(False))
    months = F.coalesce(C.month_denominator("n_days") >= min_months, F.lit(False))
    return F.when(F.col("seizure_days_total") < min_days, "seizure_days_below_minimum").when(~(months | cycles), "window_duration_below_minimum")


def label_b(df: DataFrame) -> DataFrame:
    """Definition A's labels where there are enough data (nulls in windows without days)."""
    why = minimum_data_reason()
    out = df.withColumn("_why", why)
    gate = lambda p: F.when(F.col("_why").isNull() & (F.col("n_days") > 0), F.col(f"label_A_windowed_{p}"))
    out = _family(out, "B", gate("C1"), gate("C2"), gate("C3"))
    return out.withColumn("b_reason", F.when(F.col("n_days") > 0, F.coalesce("_why", "a_windowed_reason"))).drop("_why")


def cycle_labels(daily: DataFrame, thresholds: dict[str, float] = C.THRESHOLDS) -> DataFrame:
    """Each complete cycle's pattern labels by phase mode, with its first and last day. Days of one id are one cycle if
    they count from the same first day, so an id that comes again is another cycle.

    C1 and C2 are false without ovulation; C3 is false but in the population's cycles of inadequate luteal phase.
    """
    return _cycle_labels(_alike(daily, "phase_mode", "phase", "strict_herzog_cycle_eligible"), thresholds)


def cycle_labels_by_mode(days: DataFrame, modes: tuple[str, ...] = MODES, thresholds: dict[str, float] = C.THRESHOLDS) -> DataFrame:
    """:func:`cycle_labels` of days that have no phases yet, in the ``modes`` of their cohorts: days are summed by their phases in all modes, and only
    these few rows are copied for each mode."""
    phases = [C.PHASES[m]("cycle_day", "cycle_length").alias(f"_phase_{i}") for i, m in enumerate(dict.fromkeys((*modes, "strict_herzog")))]
    parts = _alike(days, *phases)
    return _cycle_labels(fan_out_phase_modes(parts.withColumn("cycle_day", F.col("_lo")), modes), thresholds)


def _alike(days: DataFrame, *more) -> DataFrame:
    """Days summed by what they have in common, so that only these few rows are told apart by phase."""
    begins = (F.col("calendar_day_index") - F.col("cycle_day")).alias("_begins")
    return days.groupBy("participant_id", "cycle_id", "cohort", begins, "cycle_length", "ovulatory_flag", "ilp_flag", *more).agg(
        F.count("*").alias("_n"), F.sum("seizure_count").alias("_events"), F.min("cycle_day").alias("_lo"), F.max("cycle_day").alias("_hi"), F.min("calendar_day_index").alias("_first"), F.max("calendar_day_index").alias("_last"))


def _cycle_labels(parts: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    keys = ["participant_id", "phase_mode", "cycle_id"]
    c = F.col
    aggs = [F.sum("_n").alias("n"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.max("cycle_length").alias("cycle_length"), F.min("_first").alias("first_day"),
            F.max("_last").alias("last_day"), F.min_by("ovulatory_flag", "_first").alias("ovulatory"), F.bool_or("ilp_flag").alias("ilp"), F.bool_and("strict_herzog_cycle_eligible").alias("strict"), _sum_if(c("phase").isNotNull(), c("_n")).alias("labelled")]
    for p in PHASES:
        aggs += [_sum_if(c("phase") == p, c("_n")).alias(f"d{p}"), _sum_if(c("phase") == p, c("_events")).alias(f"e{p}")]
    cyc = parts.groupBy(*keys, "cohort", "_begins").agg(*aggs).where("n = cycle_length and lo = 1 and hi = cycle_length")
    fl_e, fl_d = c("eF") + c("eL"), c("dF") + c("dL")
    r1, r2 = C.adsf_ratio("eM", "dM", fl_e, fl_d)["ratio"], C.adsf_ratio("eO", "dO", fl_e, fl_d)["ratio"]
    r3 = C.adsf_ratio(c("eO") + c("eL") + c("eM"), c("dO") + c("dL") + c("dM"), "eF", "dF")["ratio"]
    some, ov = c("labelled") > 0, F.coalesce(c("ovulatory"), F.lit(False))
    pos = lambda on, r, p: F.when(some, F.when(on, C.ratio_positive(r, thresholds[p])).otherwise(False))
    return cyc.select(*keys, "cohort", "first_day", "last_day", "strict", "ilp", pos(ov, r1, "C1").alias("c1"), pos(ov, r2, "C2").alias("c2"), pos((c("cohort") == "population") & c("ilp"), r3, "C3").alias("c3"))


def complete_cycles_inside(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """``n_complete_cycles`` of each valid window that has any, as :func:`cycle_counters` counts them, from the days without their phases; ``daily`` has each day once."""
    begins = (F.col("calendar_day_index") - F.col("cycle_day")).alias("_begins")
    cyc = daily.groupBy("participant_id", "cycle_id", begins).agg(
        F.count("*").alias("n"), F.min("cycle_day").alias("lo"), F.max("cycle_day").alias("hi"), F.max("cycle_length").alias("cycle_length"), F.min("calendar_day_index").alias("first_day"), F.max("calendar_day_index").alias("last_day"))
    done = cyc.where("n = cycle_length and lo = 1 and hi = cycle_length").select("participant_id", "first_day", "last_day")
    w = windows.where("valid").select(*KEYS, "start_day", "end_day").hint("shuffle_hash")
    return done.join(w, "participant_id").where("first_day >= start_day and last_day <= end_day").groupBy(*KEYS).agg(F.count("*").alias("n_complete_cycles"))


def cycle_counters(windows: DataFrame, cycles: DataFrame) -> DataFrame:
    """For each window and mode: complete cycles inside it and how many have each label or none."""
    inside = cycles.drop("cohort").join(windows.where("valid").select(*KEYS, "start_day", "end_day"), "participant_id").where("first_day >= start_day and last_day <= end_day")
    aggs = [F.count("*").alias("n_complete_cycles"), F.count_if("ilp").alias("n_ilp_cycles"), F.count_if("strict").alias("n_strict_cycles")]
    either = F.col("c1") | F.col("c2") | F.col("c3")  # unknown unless one is true or all are known
    for name, label, rows in (("c1", F.col("c1"), F.lit(True)), ("c2", F.col("c2"), F.lit(True)), ("c3", F.col("c3"), F.col("ilp"))):
        aggs += [F.count_if(rows & label).alias(f"{name}_yes"), F.count_if(rows & label.isNull()).alias(f"{name}_unknown")]
    for name, label in (("any", either), ("c1", F.col("c1")), ("c2", F.col("c2")), ("c3", F.col("c3"))):
        aggs += [F.count_if(F.col("strict") & label).alias(f"exact_{name}_yes"), F.count_if(F.col("strict") & label.isNull()).alias(f"exact_{name}_unknown")]
    return inside.groupBy("phase_mode", *KEYS).agg(*aggs)


def with_cycle_counters(df: DataFrame, counters: DataFrame) -> DataFrame:
    out = df.join(counters, ["phase_mode", *KEYS], "left")
    return out.na.fill(0, [c for c in counters.columns if c not in KEYS and c != "phase_mode"])


def label_c(df: DataFrame, least: int = 6, name: str = "C") -> DataFrame:
    """Reproducibility: two thirds of the complete cycles and the pooled window positive. Only for strict labelling."""
    strict = F.col("phase_mode") == "strict_herzog"
    ok = strict & (F.col("n_complete_cycles") >= least) & (F.col("n_days") > 0)

    def one(p: str, n: str) -> Column:
        pooled = F.col(f"label_A_windowed_{p.upper()}")
        need = F.expr(f"(2 * {n} + 2) div 3")
        return F.when((F.col(f"{p}_yes") >= need) & F.coalesce(pooled, F.lit(False)), True).when(pooled.isNotNull() & (F.col(f"{p}_unknown") == 0), False)

    c3 = F.when(ok & (F.col("cohort") == "population") & (F.col("n_ilp_cycles") >= least) & F.col("label_A_windowed_C3").isNotNull(), one("c3", "n_ilp_cycles"))
    out = _family(df, name, F.when(ok, one("c1", "n_complete_cycles")), F.when(ok, one("c2", "n_complete_cycles")), c3)
    reason = F.when(~strict, "reproducibility_not_evaluated_for_phase_mode").when(~ok, "fewer_than_required_complete_cycles")
    return out.withColumn(f"{name.lower()}_reason", F.when(F.col("n_days") > 0, reason))


def label_a_exact(df: DataFrame) -> DataFrame:
    """Three complete 23-35 day cycles, two of them positive; strict three-cycle windows only."""
    here = (F.col("phase_mode") == "strict_herzog") & (F.col("window_type") == "cycle") & (F.col("window_value") == "3") & (F.col("n_days") > 0)
    ok = here & (F.col("n_strict_cycles") == 3)
    subject = lambda p: F.when(ok, F.when(F.col(f"exact_{p}_yes") >= 2, True).when(F.col(f"exact_{p}_unknown") == 0, False))
    out = df.withColumns({"label_A_exact_any": subject("any"), "label_A_exact_C1": subject("c1"), "label_A_exact_C2": subject("c2"), "label_A_exact_C3": F.when(F.col("cohort") == "population", subject("c3"))})
    reason = (
        F.when(F.col("phase_mode") != "strict_herzog", "exact_herzog_only_evaluated_for_strict_herzog_phase_mode").when(~here, "exact_herzog_only_applies_to_three_cycle_windows")
        .when(~ok, "requires_three_complete_strict_23_35_day_cycles").when(F.col("label_A_exact_any").isNull(), "undefined_cycle_ratio")
    )
    return out.withColumn("a_exact_reason", F.when(F.col("n_days") > 0, reason))


def historical_all(df: DataFrame, h1: float = 0.5, h1_sensitivity: float = 0.667) -> DataFrame:
    """H1 to H4, for strict labelling."""
    ok = (F.col("phase_mode") == "strict_herzog") & (F.col("n_days") > 0)
    total = F.col("seizure_count_total")
    share = lambda e: F.when(ok & (total > 0), F.try_divide(F.col(e).cast("double"), total))
    three = [F.when(ok, C.ratio_positive(f"rr_{p}", 2.0)) for p in ("C1", "C2", "C3")]
    twice = {}
    for p in ("P", "F", "O", "L"):
        e, d = F.col(f"reddy_events_{p}"), F.col(f"reddy_days_{p}")
        twice[p] = F.when(ok, C.ratio_positive(C.adsf_ratio(e, d, total - e, F.col("n_days") - d)["ratio"], 2.0))
    names = F.nullif(F.concat_ws(",", *[F.when(v, F.lit(p)) for p, v in twice.items()]), F.lit(""))
    return df.withColumns(
        {
            "label_H1_any": share("h1_events") > h1, "label_H1_sensitivity_any": share("h1_events") > h1_sensitivity, "label_H2_any": share("h2_events") >= 0.75,
            "label_H3_any": C.any_known(*three), "label_H3_C1": three[0], "label_H3_C2": three[1], "label_H3_C3": three[2], "label_H4_any": C.any_known(*twice.values()), "label_H4_phase": names,
        }
    )


def nb_alpha(n, total, squares, fallback: float = 1.0) -> Column:
    """Dispersion by the method of moments from count, sum and sum of squares, within [1e-6, 50]."""
    n, s, q = (C.col(x).cast("double") for x in (n, total, squares))
    above = n * q - s * s - s * (n - 1)  # n (n - 1) times variance less mean: whole numbers, so exact where both are equal
    return F.when((n > 1) & (s > 0) & (above > 0), F.greatest(F.lit(1e-6), F.least(F.lit(50.0), F.try_divide(above * n, (n - 1) * s * s)))).otherwise(F.lit(float(fallback)))


def pooled_windows(daily: DataFrame, windows: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """Counters, rates and ratios of each window and phase mode: what needs no cycle inside the window. ``daily`` is labelled for all ``modes``."""
    return pooled_ratios(base_fields(window_counters(daily, windows, modes)))


def classify_windows(daily: DataFrame, windows: DataFrame, modes: DataFrame | None = None, cycles: DataFrame | None = None, pooled: DataFrame | None = None) -> DataFrame:
    """All projections above over one aggregation of days and one of cycles. ``daily`` is labelled for all ``modes``; ``cycles`` are its
    :func:`cycle_labels`, ``pooled`` its :func:`pooled_windows`, where these are there already."""
    # labels of the pooled window before the join with cycles, so that those made of them read columns instead of repeating their expressions
    out = historical_all(label_b(label_a_windowed(pooled_windows(daily, windows, modes) if pooled is None else pooled)))
    out = with_cycle_counters(out, cycle_counters(windows, cycle_labels(daily) if cycles is None else cycles))
    out = label_a_exact(label_c(label_c(out), 12, "C12"))
    invalid = F.when(F.col("n_days") == 0, F.coalesce("invalid_reason", F.lit("invalid_window")))
    return out.withColumn("indeterminate_reason", C.first_reason(invalid, "a_exact_reason", "a_windowed_reason", "b_reason", "c_reason"))
