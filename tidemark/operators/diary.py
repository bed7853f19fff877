"""Preparation of daily diaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .resample import hash_ranked

DAY = ["participant_id", "calendar_day_index"]
MODES = ("strict_herzog", "modified_short_cycle")


def align_diaries(events: DataFrame, cycles: DataFrame, check: bool = True) -> DataFrame:
    """One row a participant and day from both diaries, with ``seizure_day``. A day that only one has makes the job fail that reads the
    result; the check is part of the join, not a pass of its own."""
    joined = events.withColumn("_a", F.lit(1)).join(cycles.withColumn("_b", F.lit(1)), DAY, "full_outer")
    if check:
        both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
        joined = joined.where(F.when(both, True).otherwise(F.raise_error(F.lit("the diaries must have the same calendar-day index")).cast("boolean")))
    return joined.drop("_a", "_b").withColumn("seizure_day", (F.col("seizure_count") > 0).cast("int"))


def enrich_daily(daily: DataFrame, cycles: DataFrame) -> DataFrame:
    """Attaches ``ovulatory_flag, ovulation_day, cycle_stage`` of the cycle and flags its first day.

    Only the participant is the join's key, so that days in buckets by it stay where they are and cycles, whose size Spark underrates after
    an ``explode``, are not broadcast; the cycle is a range of one id.
    """
    own = cycles.select("participant_id", F.col("cycle_id").alias("_id"), "ovulatory_flag", "ovulation_day", "cycle_stage").withColumnRenamed("participant_id", "_who").hint("shuffle_hash")
    days = daily.drop("ovulatory_flag", "ovulation_day", "cycle_stage")
    out = days.join(own, (F.col("participant_id") == F.col("_who")) & (F.col("_id") >= F.col("cycle_id")) & (F.col("_id") <= F.col("cycle_id")), "left").drop("_who", "_id")
    return out.withColumn("ovulation_day", F.coalesce("ovulation_day", F.lit(0))).withColumn("menses_onset_flag", (F.col("cycle_day") == 1).cast("int"))


def derive_cycles(daily: DataFrame) -> DataFrame:
    """Cycles from onset flags: ``derived_cycle_id`` (0 before the first onset), ``derived_cycle_day`` and
    ``derived_cycle_length``; the last, unfinished cycle and days before the first onset have no length."""
    by_day = Window.partitionBy("participant_id").orderBy("calendar_day_index")
    cycle = Window.partitionBy("participant_id", "derived_cycle_id")
    out = daily.withColumn("derived_cycle_id", F.sum("menses_onset_flag").over(by_day))
    out = out.withColumn("derived_cycle_day", F.row_number().over(cycle.orderBy("calendar_day_index")))
    last = F.max("derived_cycle_id").over(Window.partitionBy("participant_id"))
    done = (F.col("derived_cycle_id") > 0) & (F.col("derived_cycle_id") < last)
    return out.withColumn("derived_cycle_length", F.when(done, F.count("*").over(cycle)))


def ilp_cycles(daily: DataFrame, threshold: float = 5.0) -> DataFrame:
    """``participant_id, cycle_id, mid_luteal_progesterone, ilp_flag``: inadequate luteal phase by cycle.

    The peak of days 5 to 9 after ovulation counts (later days if there are none); cycles without
    ovulation are inadequate, their peak is of the whole cycle."""
    d, ov = F.col("cycle_day"), F.col("ovulation_day")
    agg = daily.groupBy("participant_id", "cycle_id").agg(
        F.max("progesterone").alias("whole"), F.max(F.when((d >= ov + 5) & (d <= ov + 9), F.col("progesterone"))).alias("mid"),
        F.max(F.when(d > ov, F.col("progesterone"))).alias("late"), F.max(F.coalesce("ovulatory_flag", F.lit(False)) & (F.coalesce(ov, F.lit(0)) > 0)).alias("ovulated"),
    )
    mid = F.when(F.col("ovulated"), F.coalesce("mid", "late")).otherwise(F.col("whole"))
    flag = ~F.col("ovulated") | F.coalesce(mid < threshold, F.lit(False))
    return agg.select("participant_id", "cycle_id", mid.alias("mid_luteal_progesterone"), flag.alias("ilp_flag"))


def add_phase_labels(daily: DataFrame, mode: str) -> DataFrame:
    """Phase columns, eligibility and mode flags for one way of labelling; unknown modes are an error."""
    if mode not in C.PHASES:
        raise ValueError(f"unknown phase mode: {mode}")
    return daily.withColumns(
        {
            "backward_day": C.backward_day("cycle_day", "cycle_length"),
            "phase": C.PHASES[mode]("cycle_day", "cycle_length"),
            "phase_reddy": C.phase_reddy("cycle_day", "cycle_length"),
            "strict_herzog_cycle_eligible": F.coalesce(F.col("cycle_length").between(23, 35), F.lit(False)),
            "short_cycle_modified_flag": F.lit(mode == "modified_short_cycle"),
            "luteal_anchored_ovulatory_flag": F.lit(mode == "luteal_anchored_ovulatory"),
            "phase_mode": F.lit(mode),
        }
    )


def _own_modes(modes: tuple[str, ...]) -> Column:
    names = lambda ms: F.array(*[F.lit(m) for m in dict.fromkeys(ms)])  # noqa: E731  (constants, made once and not for every day)
    strictly = ["strict_herzog" if m == "modified_short_cycle" else m for m in modes]
    return F.when(F.col("cohort") != "population", names(strictly)).otherwise(names(modes))


def cohort_modes(rows: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """``cohort, phase_mode``: the modes in which :func:`fan_out_phase_modes` labels each cohort of ``rows``."""
    return rows.select("cohort").distinct().withColumn("phase_mode", F.explode(_own_modes(modes)))


def fan_out_phase_modes(daily: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """A copy of each day for each mode of its cohort, labelled in one pass. Cohorts other than
    ``population`` are labelled strictly in place of ``modified_short_cycle``; each mode comes once."""
    for mode in modes:
        if mode not in C.PHASES:
            raise ValueError(f"unknown phase mode: {mode}")
    out = daily.withColumn("phase_mode", F.explode(_own_modes(modes)))
    phase = F.lit(None).cast("string")
    for m in dict.fromkeys((*modes, "strict_herzog")):
        phase = F.when(F.col("phase_mode") == m, C.PHASES[m]("cycle_day", "cycle_length")).otherwise(phase)
    return out.withColumns(
        {
            "backward_day": C.backward_day("cycle_day", "cycle_length"), "phase": phase, "phase_reddy": C.phase_reddy("cycle_day", "cycle_length"),
            "strict_herzog_cycle_eligible": F.coalesce(F.col("cycle_length").between(23, 35), F.lit(False)),
            "short_cycle_modified_flag": F.col("phase_mode") == "modified_short_cycle", "luteal_anchored_ovulatory_flag": F.col("phase_mode") == "luteal_anchored_ovulatory",
        }
    )


def cycle_runs(daily: DataFrame, *extra: str) -> DataFrame:
    """Adds ``cycle_run``, a number for each run of days with one cycle_id, from 1 in order of the days: an id that comes again begins a run of its own."""
    by = Window.partitionBy("participant_id", *extra).orderBy("calendar_day_index")
    new = (F.row_number().over(by) == 1) | ~F.col("cycle_id").eqNullSafe(F.lag("cycle_id").over(by))
    return daily.withColumn("_new", new.cast("int")).withColumn("cycle_run", F.sum("_new").over(by)).drop("_new")


def _cycle_rows(days: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("calendar_day_index").cast("long")
    return days.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.min("cycle_day").alias("first_cycle_day"), F.max("cycle_day").alias("last_cycle_day"), F.min_by("cycle_length", "calendar_day_index").alias("cycle_length"),
        F.min("calendar_day_index").alias("first_day"), F.max("calendar_day_index").alias("last_day"), F.bool_and(F.coalesce(F.col("cycle_length").between(23, 35), F.lit(False))).alias("strict_cycle_flag"),
        F.count("calendar_day_index").alias("_known"), F.sum(d).alias("_sum"), F.sum(d * d).alias("_squares"))


def complete_cycles(daily: DataFrame, *extra: str) -> DataFrame:
    """A row a run of one cycle_id: days, first and last day, ``complete_cycle_flag`` (as many days as its length, from day 1 to it)
    and ``strict_cycle_flag``.

    Ids whose days follow one another, apart from other ids' days, are runs as they are. Only participants with another id are read
    day by day.
    """
    who = ["participant_id", *extra]
    ids = _cycle_rows(daily, [*who, "cycle_id"])
    n, first, last = F.col("n_days"), F.col("first_day").cast("long"), F.col("last_day").cast("long")
    upto = lambda x: F.floor(x * (x + 1) * (2 * x + 1) / 6)
    whole = (F.col("_known") == n) & (last - first + 1 == n) & (F.col("_sum") * 2 == (first + last) * n) & (F.col("_squares") == upto(last) - upto(first - 1))
    by = Window.partitionBy(*who).orderBy("first_day")
    apart = F.coalesce(F.col("first_day") > F.max("last_day").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    ids = ids.withColumn("_whole", F.coalesce(whole, F.lit(False)) & apart).withColumn("cycle_run", F.row_number().over(by).cast("long"))
    split = ids.where("not _whole").select(*[F.col(k).alias(f"_{k}") for k in who]).distinct()
    if not split.isEmpty():
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in who])
        again = cycle_runs(daily.join(split, same, "left_semi"), *extra)
        ids = ids.join(split, same, "left_anti").drop("_whole").unionByName(_cycle_rows(again, [*who, "cycle_id", "cycle_run"]))
    done = (n == F.col("cycle_length")) & (F.col("first_cycle_day") == 1) & (F.col("last_cycle_day") == F.col("cycle_length"))
    columns = [*who, "cycle_id", "cycle_run", "n_days", "first_cycle_day", "last_cycle_day", "cycle_length", "first_day", "last_day", "strict_cycle_flag"]
    return ids.select(*columns, F.coalesce(done, F.lit(False)).alias("complete_cycle_flag"))


def mark_complete_cycles(daily: DataFrame) -> DataFrame:
    """Adds ``complete_cycle_flag`` to each day: whether its run of one cycle_id is complete."""
    run = Window.partitionBy("participant_id", "cycle_run")
    length = F.min_by("cycle_length", "calendar_day_index").over(run)
    done = (F.count("*").over(run) == length) & (F.min("cycle_day").over(run) == 1) & (F.max("cycle_day").over(run) == length)
    return cycle_runs(daily).withColumn("complete_cycle_flag", F.coalesce(done, F.lit(False))).drop("cycle_run")


def inject_enrichment(daily: DataFrame, target: str = "M", rate_ratio: float = 1.5, seed: int = 1) -> DataFrame:
    """Adds Poisson events with mean (rate_ratio - 1) x the participant's mean on days of the target phase.

    Draws invert the distribution function at a hashed uniform number, so they repeat. No change for ratios up to 1.
    """
    if rate_ratio <= 1:
        return daily
    mean = F.avg("seizure_count").over(Window.partitionBy("participant_id")) * (rate_ratio - 1)
    u = (C.stable_hash(seed, "participant_id", "calendar_day_index") + 0.5) / F.lit(2.0**32)
    out = daily.withColumn("_m", mean).withColumn("_u", u)
    # struct: logarithm of the probability of k, cumulated probability, draws so far; 12 deviations lie beyond any 32-bit number
    m = F.col("_m")
    start = F.struct((-m).alias("p"), F.exp(-m).alias("c"), F.lit(0).alias("n"))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.ceil(m + 12 * F.sqrt(m) + 20).cast("int")), start,
        lambda a, k: F.struct((a["p"] + F.log(m / k)).alias("p"), (a["c"] + F.exp(a["p"] + F.log(m / k))).alias("c"), (a["n"] + (F.col("_u") > a["c"]).cast("int")).alias("n")),
    )["n"]
    more = F.when((F.col("phase") == target) & (F.col("_m") > 0), draw).otherwise(0)
    return out.withColumn("seizure_count", F.col("seizure_count") + more).withColumn("seizure_day", (F.col("seizure_count") > 0).cast("int")).drop("_m", "_u")


def audit_sample(participants: DataFrame, fraction: float = 0.01, seed: int = 1) -> DataFrame:
    """``max(1, round(n x fraction))`` participants of each cohort, by hash order."""
    take = F.greatest(F.lit(1), F.bround(F.col("_total") * F.lit(float(fraction))))
    return hash_ranked(participants, ["cohort"], C.stable_hash(seed, "participant_id"), "participant_id", take).drop("_rank")


def participant_summary(daily: DataFrame) -> DataFrame:
    """One row a participant: cycle length statistics, share of ovulatory cycles, totals, rates per 30 days, strata."""
    cycles = daily.groupBy("participant_id", "cycle_id").agg(F.max("cycle_length").alias("len"), F.max(F.col("ovulatory_flag").cast("int")).alias("ov"))
    by_cycle = cycles.groupBy("participant_id").agg(
        F.avg("len").alias("mean_cycle_length"), F.coalesce(F.stddev_samp("len"), F.lit(0.0)).alias("sd_cycle_length"), F.avg("ov").alias("ovulatory_fraction"), F.count("*").alias("n_cycles"))
    each = daily.groupBy("participant_id", "cohort").agg(  # texts as keys, so that days are hashed, not sorted
        F.max("age").alias("age"), F.count("*").alias("n_days"), F.sum("seizure_count").alias("seizure_count_total"), F.sum("seizure_day").alias("seizure_days_total"), F.min("calendar_day_index").alias("_first"),
        F.min_by("cycle_day", "calendar_day_index").alias("start_cycle_day"), F.min_by("cycle_length", "calendar_day_index").alias("start_cycle_length"))
    totals = each.groupBy("participant_id").agg(
        F.max("cohort").alias("cohort"), F.max("age").alias("age"), F.sum("n_days").alias("n_days"), F.sum("seizure_count_total").alias("seizure_count_total"), F.sum("seizure_days_total").alias("seizure_days_total"),
        F.min_by("start_cycle_day", "_first").alias("start_cycle_day"), F.min_by("start_cycle_length", "_first").alias("start_cycle_length"))
    out = totals.join(by_cycle, "participant_id")
    months = C.month_denominator("n_days")
    out = out.withColumn("seizures_per_month", F.col("seizure_count_total") / months).withColumn("seizure_days_per_month", F.col("seizure_days_total") / months)
    return out.withColumn("seizure_frequency_stratum", C.seizure_frequency_stratum("seizure_days_per_month")).withColumn("cycle_regularity_stratum", C.cycle_regularity_stratum("sd_cycle_length"))


def attach_strata(windows: DataFrame, participants: DataFrame) -> DataFrame:
    """Participant fields copied to each of their windows."""
    own = participants.select(
        "participant_id", F.col("seizure_days_per_month").alias("full_diary_seizure_days_per_month"), F.col("seizures_per_month").alias("full_diary_seizures_per_month"),
        F.col("mean_cycle_length").alias("participant_mean_cycle_length"), F.col("sd_cycle_length").alias("participant_sd_cycle_length"), "seizure_frequency_stratum", "cycle_regularity_stratum")
    return windows.join(own, "participant_id")


def resample_diary(daily: DataFrame, k: int) -> DataFrame:
    """Sums of blocks of ``k`` consecutive days; a block at the end may be shorter."""
    return daily.groupBy("participant_id", F.expr(f"(calendar_day_index - 1) div {k}").alias("block")).agg(F.sum("seizure_count").alias("seizure_count"), F.count("*").alias("n_days"))


def clip_counts(daily: DataFrame, most: int) -> DataFrame:
    return daily.withColumn("seizure_count", F.least("seizure_count", F.lit(most))).withColumn("seizure_day", (F.col("seizure_count") > 0).cast("int"))
