"""Observation windows: ``participant_id, cohort, window_type, window_value, window_seq, valid, start_day, end_day, invalid_reason``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

KEYS = ["participant_id", "window_type", "window_value", "window_seq"]
# Months of calendar windows and cycles of cycle windows.
MONTHS = (1, 3, 4, 6, 9, 12, 18, 24, 36)
CYCLES = (3, 6, 12)


def _spec(df: DataFrame) -> DataFrame:
    return df.select("participant_id", "cohort", "window_type", "window_value", "window_seq", "valid", "start_day", "end_day", "invalid_reason")


def spans(daily: DataFrame) -> DataFrame:
    each = daily.groupBy("participant_id", "cohort").agg(F.max("calendar_day_index").alias("total_days"))  # texts as keys, so that days are hashed, not sorted
    return each.groupBy("participant_id").agg(F.max("cohort").alias("cohort"), F.max("total_days").alias("total_days"))


def windows_calendar(span: DataFrame, months: tuple[int, ...] = MONTHS, seed: int = 1, kind: str = "calendar", repeats: int = 1) -> DataFrame:
    """A window of each number of months at a uniform hashed start; too long ones are invalid."""
    each = span.withColumn("m", F.explode(F.array(*map(F.lit, months)))).withColumn("window_seq", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    n = F.col("m") * C.DAYS_PER_MONTH
    ok = n <= F.col("total_days")
    first = 1 + F.pmod(C.stable_hash(seed, "participant_id", F.lit(kind), "m", "window_seq"), F.greatest(F.col("total_days") - n + 1, F.lit(1)))
    out = each.withColumn("valid", ok).withColumn("start_day", F.when(ok, first)).withColumn("end_day", F.when(ok, first + n - 1))
    out = out.where(ok | (F.col("window_seq") == 1))
    return _spec(out.withColumns({"window_type": F.lit("calendar"), "window_value": F.col("m").cast("string"), "invalid_reason": F.when(~ok, "calendar_window_longer_than_diary")}))


def windows_full(span: DataFrame) -> DataFrame:
    return _spec(
        span.withColumns(
            {"window_type": F.lit("full"), "window_value": F.lit("full_diary"), "window_seq": F.lit(1), "valid": F.lit(True), "start_day": F.lit(1).cast("long"), "end_day": F.col("total_days").cast("long"), "invalid_reason": F.lit(None).cast("string")}
        )
    )


def windows_cycle_runs(span: DataFrame, cycles: DataFrame, counts: tuple[int, ...] = CYCLES, seed: int = 1) -> DataFrame:
    """A run of complete consecutive cycles of each length, its first cycle chosen by hash; else invalid."""
    # an id that comes again counts once, with all its days
    done = cycles.groupBy("participant_id", "cycle_id").agg(F.bool_or("complete_cycle_flag").alias("done"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")).where("done")
    run = done.withColumn("island", F.col("cycle_id") - F.row_number().over(Window.partitionBy("participant_id").orderBy("cycle_id")))
    ahead = Window.partitionBy("participant_id", "island").orderBy("cycle_id")
    starts = None
    for n in counts:
        span_of = ahead.rowsBetween(0, n - 1)
        one = run.withColumns({"start_day": F.min("first_day").over(span_of), "end_day": F.max("last_day").over(span_of), "_n": F.count("*").over(span_of)}).where(F.col("_n") == n)
        one = one.select("participant_id", "cycle_id", "start_day", "end_day", F.lit(n).alias("n"))
        starts = one if starts is None else starts.unionByName(one)
    pick = Window.partitionBy("participant_id", "n").orderBy(C.stable_hash(seed, "participant_id", F.lit("cycle"), "n", "cycle_id"), "cycle_id")
    chosen = starts.withColumn("r", F.row_number().over(pick)).where("r = 1").select("participant_id", "n", "start_day", "end_day")
    each = span.withColumn("n", F.explode(F.array(*map(F.lit, counts)))).join(chosen, ["participant_id", "n"], "left")
    ok = F.col("start_day").isNotNull()
    return _spec(
        each.withColumns({"window_type": F.lit("cycle"), "window_value": F.col("n").cast("string"), "window_seq": F.lit(1), "valid": ok, "invalid_reason": F.when(~ok, "not_enough_complete_cycles"), "start_day": F.col("start_day").cast("long"), "end_day": F.col("end_day").cast("long")})
    )


def windows_study_pool(span: DataFrame, n: int = 5, months: int = 3, seed: int = 1) -> DataFrame:
    """``n`` random calendar windows a participant, which may repeat; one invalid window if too long."""
    return windows_calendar(span, (months,), seed, "study", n)


def primary_windows(daily: DataFrame, cycles: DataFrame, seed: int = 1, span: DataFrame | None = None) -> DataFrame:
    """Calendar windows, the full diary and runs of cycles; ``span`` are the diary's :func:`spans` where these are there already."""
    span = spans(daily) if span is None else span
    return windows_calendar(span, seed=seed).unionByName(windows_full(span)).unionByName(windows_cycle_runs(span, cycles, seed=seed))


def subset_window(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """The days of each valid window: an equi-join on the participant with a range on the day, which
    keeps the partitioning by participant for the aggregation that follows."""
    w = windows.where("valid").select(*KEYS, "start_day", "end_day").hint("shuffle_hash")  # a participant has far fewer windows than days
    return daily.join(w, "participant_id").where("calendar_day_index between start_day and end_day")


def window_selector(windows: DataFrame, rules: list[dict]) -> DataFrame:
    """Windows that match a rule ``{window_type, window_value?}``; without a value any matches."""
    match = F.lit(False)
    for r in rules:
        one = F.col("window_type") == r["window_type"]
        if r.get("window_value") is not None:
            one &= F.col("window_value") == str(r["window_value"])
        match |= one
    return windows.where(match)
