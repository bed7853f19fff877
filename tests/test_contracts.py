"""Contracts that hold or make the reading job fail, and manifests of files."""

import hashlib
import json
import os

import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import functions as F

from tidemark.operators import compare as K
from tidemark.operators import diagnostics as Z
from tidemark.operators import diary as D
from tidemark.sources import io


@pytest.fixture
def jobs(spark):
    """Numbers of jobs that calls start."""

    def count(call):
        group = f"jobs-{os.urandom(4).hex()}"
        spark.sparkContext.setJobGroup(group, "")
        call()
        spark.sparkContext.setJobGroup("others", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    return count


@pytest.fixture
def days(spark):
    return spark.createDataFrame([(p, d, d % 2) for p in (1, 2) for d in range(1, 5)], "participant_id long, calendar_day_index int, seizure_count int")


def runs(spark):
    rows = [("window_false_positive", "all", c, "full", "full_diary", "A_windowed_any", "strict_herzog", False, 1, 4, 2, 0.5) for c in ("a", "b")]
    names = ["table_type", "subset", "cohort", "window_type", "window_value", "definition", "phase_mode", "assumption_based_historical", "n_windows", "n_classifiable", "positives", "false_positive_rate"]
    return spark.createDataFrame(rows, names)


def test_contracts_start_no_job_of_their_own(spark, jobs, days):
    cycles = days.select("participant_id", "calendar_day_index", F.lit(1).alias("cycle_id"))
    assert jobs(lambda: D.align_diaries(days, cycles)) == 0
    assert jobs(lambda: Z.assert_unique_key(days, "participant_id", "calendar_day_index")) == 0
    assert jobs(lambda: Z.assert_monotone(days, ["participant_id"], "calendar_day_index", "participant_id")) == 0
    assert jobs(lambda: Z.assert_reconciled(days, days, ["participant_id", "calendar_day_index"], "seizure_count")) == 0
    run = runs(spark)
    assert jobs(lambda: K.diff_runs(run, run)) == 0
    # reading the checked days takes no more jobs than reading them unchecked
    assert jobs(D.align_diaries(days, cycles).collect) == jobs(D.align_diaries(days, cycles, check=False).collect)


def test_contracts_fail_the_reading_job(spark, days):
    for df, message in [
        (Z.assert_unique_key(days, "participant_id"), "keys are not unique: participant_id"), (Z.assert_monotone(days, ["participant_id"], "calendar_day_index", "seizure_count"), "not non-increasing"),
        (Z.assert_reconciled(days, days.where("calendar_day_index < 4"), ["participant_id", "calendar_day_index"], "seizure_count"), "does not reconcile"),
        (D.align_diaries(days, days.where("calendar_day_index < 4").drop("seizure_count")), "same calendar-day index"), (K.diff_runs(runs(spark).union(runs(spark)), runs(spark)), "keys are not unique"),
    ]:
        with pytest.raises(SparkRuntimeException, match=message):
            df.collect()
        with pytest.raises(SparkRuntimeException, match=message):
            df.select(df.columns[0]).count()


def test_contracts_leave_good_tables_as_they_are(days):
    assert sorted(Z.assert_unique_key(days, "participant_id", "calendar_day_index").collect()) == sorted(days.collect())
    assert sorted(Z.assert_monotone(days.withColumn("v", -F.col("calendar_day_index")), ["participant_id"], "calendar_day_index", "v").drop("v").collect()) == sorted(days.collect())
    other = days.withColumn("seizure_count", F.when(F.col("participant_id") == 1, F.col("seizure_count")))
    assert Z.assert_reconciled(other, other, ["participant_id", "calendar_day_index"], "seizure_count").count() == 8  # null agrees with null


def test_manifest_and_its_refresh(spark, tmp_path, monkeypatch):
    folder = tmp_path / "out files"
    (folder / "part=1").mkdir(parents=True)
    content = {folder / "a.bin": os.urandom(3 * io.PIECE + 17), folder / "part=1" / "b c.bin": b"", folder / "d.txt": b"short"}
    for path, data in content.items():
        path.write_bytes(data)
    want = {path.name: (len(data), hashlib.sha256(data).hexdigest()) for path, data in content.items()}
    rows = io.output_manifest(spark, str(folder)).withColumn("role", F.lit("result"))
    assert {r.path.replace("%20", " ").rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in rows.collect()} == want
    manifest = str(tmp_path / "manifest.json")
    io.write_manifest(rows, manifest)
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".manifest") and not f.endswith(".crc")]
    (folder / "d.txt").write_bytes(b"longer text")
    got = {r.path.rsplit("/", 1)[1]: r for r in io.refresh_manifest(spark, manifest).collect()}
    assert (got["d.txt"].bytes, got["d.txt"].sha256, got["d.txt"].role) == (11, hashlib.sha256(b"longer text").hexdigest(), "result")
    assert len(got) == 3 and all(r.finalized_unix_time > 1.6e9 for r in got.values())
    before = open(manifest).read()
    assert len([json.loads(x) for x in before.splitlines()]) == 3
    (folder / "a.bin").unlink()
    with pytest.raises(PythonException, match="FileNotFoundError"):
        io.refresh_manifest(spark, manifest)
    assert open(manifest).read() == before
