"""Tables that many queries share, written once a session to the shared folder and read from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import definitions as X
from ..operators import diary as D
from ..operators import glm as G
from ..operators import resample as R
from ..operators import summaries as S
from ..operators import windows as W
from . import diary as P

#: Given tables that the shared ones are made from.
SOURCES = ("supplier", "lineitem")

#: Of the session while a shared table is written: Java compiles no methods over 8,000 bytes, so wide rows are projected outside of whole-stage code; rows in
#: buckets go to a writer a bucket, not through a sort.
WRITING = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.maxConcurrentOutputFileWriters": "16"}

_written: dict[tuple, str] = {}


@contextmanager
def _writing(spark: SparkSession):
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a local one if the session runs inside one
    machine (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tables-", dir="/tmp")
    return f"{base}/{uuid.uuid4().hex}"


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """Number, bytes and a hash of names, sizes and times of the source files, so that changed input is not answered from older tables."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in SOURCES]).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def written(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame], buckets: int = 0) -> DataFrame:
    """The table as written by its first use in this application since the source files last changed. With ``buckets`` its rows are in so many
    buckets by participant, so that joins and groups by participant need not shuffle them."""
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, sf_dir), name)
    if key not in _written:
        path = f"{shared_folder(spark)}/{name}"
        table = make(spark, sf_dir)
        with _writing(spark):
            if buckets:
                name = f"tidemark_{name}_{uuid.uuid4().hex}"
                table.write.bucketBy(buckets, "participant_id").option("path", path).saveAsTable(name)
            else:
                table.write.parquet(path)
        _written[key] = name if buckets else path
    return spark.read.parquet(_written[key]) if "/" in _written[key] else spark.table(_written[key])


def forget() -> None:
    """Later uses write all shared tables anew."""
    _written.clear()


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned base diary, in buckets of whole participants."""
    parts = P.partitions(spark, sf_dir)
    return P.aligned(written(spark, sf_dir, "daily", lambda s, d: P.counted_days(s, d, parts), buckets=parts))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fan_out_phase_modes(daily(spark, sf_dir))


def strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day once, labelled strictly."""
    return D.fan_out_phase_modes(daily(spark, sf_dir), ("strict_herzog",))


def cycle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "cycles", lambda s, d: D.complete_cycles(daily(s, d)))


def at() -> Column:
    """A participant's place in the range of its hash, from 0 to 1."""
    return C.stable_hash(1, "participant_id") / F.lit(2.0**32)


def whole_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each participant's complete cycles as one row, with its place by hash, so that days are neither joined by cycle nor hashed."""
    make = lambda s, d: cycle_table(s, d).where("complete_cycle_flag").groupBy("participant_id").agg(F.collect_set("cycle_id").alias("_done")).withColumn("_at", at())
    return written(spark, sf_dir, "whole_cycles", make)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "spans", lambda s, d: W.spans(daily(s, d)))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "windows", lambda s, d: W.primary_windows(daily(s, d), cycle_table(s, d), span=spans(s, d)))


def cycle_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of complete cycles by phase mode; each mode's are the same whichever others are labelled beside it."""
    return written(spark, sf_dir, "cycle_labels", lambda s, d: X.cycle_labels_by_mode(daily(s, d)))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "participants", lambda s, d: D.participant_summary(daily(s, d)))


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window's counters, rates and ratios, without labels of cycles, definitions and strata."""
    return written(spark, sf_dir, "pooled", lambda s, d: X.pooled_windows(labelled(s, d), windows(s, d), D.cohort_modes(windows(s, d))))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window under every definition but D, with strata."""
    return written(spark, sf_dir, "classified", lambda s, d: D.attach_strata(X.classify_windows(labelled(s, d), windows(s, d), cycles=cycle_labels(s, d), pooled=pooled(s, d)), participants(s, d)))


def alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("seizure_count")
    sums = daily(spark, sf_dir).groupBy("participant_id").agg(F.count("*").alias("n"), F.sum(c).alias("s"), F.sum(c * c).alias("q"))
    return sums.select("participant_id", X.nb_alpha("n", "s", "q").alias("alpha"))


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition D on full diaries, with the participant's dispersion and the window's."""
    full = windows(spark, sf_dir).where("window_type = 'full'")
    return written(spark, sf_dir, "regression", lambda s, d: G.label_d(strict(s, d), full, classified(s, d), alphas(s, d), both=True))


def yearly_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition D on full diaries and windows of twelve months, from these windows alone."""
    span = spans(spark, sf_dir)
    some = W.windows_full(span).unionByName(W.windows_calendar(span, (12,)))
    fields = written(spark, sf_dir, "fit_fields", lambda s, d: G.fit_fields(strict(s, d), some))
    return G.label_d(strict(spark, sf_dir), some, fields, alphas(spark, sf_dir), both=True)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window results: all definitions, D attached where it was evaluated."""
    d = regression(spark, sf_dir).withColumn("phase_mode", F.lit("strict_herzog"))
    return classified(spark, sf_dir).join(d, ["phase_mode", *W.KEYS], "left")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study pool: five random three-month windows a participant, strict labelling."""

    def make(s: SparkSession, d: str) -> DataFrame:
        w = written(s, d, "study_windows", lambda s, d: W.windows_study_pool(spans(s, d)))
        return X.classify_windows(D.fan_out_phase_modes(daily(s, d), ("strict_herzog",)), w, D.cohort_modes(w, ("strict_herzog",)), cycle_labels(s, d).where("phase_mode = 'strict_herzog'"))

    return written(spark, sf_dir, "pool", make)


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 simulated studies of each size under every definition; D has no label on three months and counts none."""
    columns = S.DEFINITIONS.values()
    return written(spark, sf_dir, "studies", lambda s, d: R.study_mc(S.with_missing(pool(s, d), columns), S.DEFINITIONS, n_studies=10_000, sizes=(30, 50, 100)))


def cycle_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a cycle with age and bleeding days."""
    return daily(spark, sf_dir).groupBy("participant_id", "cycle_id", "cohort").agg(  # a participant has one cohort
        F.max("age").alias("age"), F.max("cycle_length").alias("cycle_length"), F.bool_or("ovulatory_flag").alias("ovulatory_flag"),
        F.max("ovulation_day").alias("ovulation_day"), F.sum("uterine_bleeding").alias("bleeding_days"))
