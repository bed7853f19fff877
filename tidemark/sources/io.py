"""Diaries, results and reports as files, through Spark's readers and writers."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIARY = "patient_id string, day_index int, age_years double, cycle_index int, cycle_day int, cycle_length int, estradiol_pg_ml double, progesterone_ng_ml double, ovulation boolean, uterine_bleeding int"


def read_diary(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A diary from JSON (``{diary: [...]}`` documents or plain rows) or CSV with a header, with fixed types; values that do not fit are null."""
    want = {x.split()[0]: x.split()[1] for x in DIARY.split(", ")}
    if fmt == "csv":
        rows = spark.read.option("header", True).csv(path)
    else:
        rows = spark.read.option("multiLine", True).json(path)
        if "diary" in rows.columns:
            rows = rows.select(F.explode("diary").alias("d")).select("d.*")
    return rows.select(*[(F.col(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in want.items()])


def write_diary_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def nested(profiles: DataFrame, diary: DataFrame, key: str = "patient_id") -> DataFrame:
    """A row a person: profile fields and the ordered ``diary`` array (a person's days are bounded)."""
    days = diary.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in sorted(diary.columns, key=lambda c: c != "day_index") if c != key]))).alias("diary"))
    return profiles.join(days, key, "left")


def write_nested_json(profiles: DataFrame, diary: DataFrame, path: str, key: str = "patient_id") -> None:
    """A document a person, as lines of gzip-compressed JSON (names repeat on each day, so plain text is some twenty times as large). ``key`` is written as ``patient_id``, a text."""
    people = nested(profiles, diary, key)
    rest = [c for c in people.columns if c != key]
    people.select(F.col(key).cast("string").alias("patient_id"), *rest).write.mode("overwrite").json(path, compression="gzip")


def write_outputs(tables: dict[str, DataFrame], summary: DataFrame, path: str, partition: str = "cohort") -> None:
    """Result tables as Parquet by cohort, the long summary as CSV."""
    for name, df in tables.items():
        _write(df, f"{path}/{name}", partition)
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def _write(df: DataFrame, path: str, partition: str) -> None:
    writer = df.write.mode("overwrite")
    # a table without rows would leave no file, and so no schema, in folders by value
    (writer.partitionBy(partition) if partition in df.columns and not df.isEmpty() else writer).parquet(path)


def read_result_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def read_summary_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(f"{path}/summary")


def normalize_output(df: DataFrame, columns: tuple[str, ...] = ("window_value", "indeterminate_reason", "label_H4_phase")) -> DataFrame:
    """Mixed columns as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})


#: Bytes of a file that a task holds at once while hashing it.
PIECE = 1 << 20


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, bytes, sha256``: reads each file in pieces through the file system that its path names; a missing one is an error."""
    for batch in batches:
        paths, sizes, digests = batch.column("path").to_pylist(), [], []
        for path in paths:
            local = re.match(r"file:/*(/.*)", path)
            store, name = (fs.LocalFileSystem(), unquote(local[1])) if local else fs.FileSystem.from_uri(path)
            digest, size = hashlib.sha256(), 0
            with store.open_input_stream(name) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
                    size += len(piece)
            sizes.append(size)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(digests)], ["path", "bytes", "sha256"])


def output_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path`` (as a URI), ``bytes, sha256`` of every file below a folder that all executors share, without names that begin with ``_`` or ``.``; files of
    any size are hashed in pieces by the tasks, the driver holds names alone."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()  # a scan would leave out empty files
    files = spark.createDataFrame([(x,) for x in sorted(names)], "path string").repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism * 4)))
    return files.mapInArrow(_hashed, "path string, bytes long, sha256 string")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One file of JSON lines, in place of an older one in a single step: readers see the old or the new manifest, whole.

    Rows stream through the driver, as many at once as a partition holds.
    """
    spark = manifest.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fresh = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(fresh)
    try:
        for row in manifest.select(F.to_json(F.struct("*")).alias("row")).toLocalIterator():
            out.write(bytearray(row["row"].encode() + b"\n"))
    except BaseException:
        out.close()
        target.getFileSystem(conf).delete(fresh, False)
        raise
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark._sc._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fresh, target, how)


def refresh_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest that :func:`write_manifest` left at ``path``, with bytes and hashes of its files as they are now and ``finalized_unix_time``; other columns stay.

    A listed file that is missing is an error, and the manifest stays as it was.
    """
    old = spark.read.json(path)
    keep = [c for c in old.columns if c not in ("bytes", "sha256", "finalized_unix_time")]
    now = old.select("path").distinct().mapInArrow(_hashed, "path string, bytes long, sha256 string")
    write_manifest(old.select(*keep).join(now, "path").withColumn("finalized_unix_time", F.unix_micros(F.current_timestamp()) / 1e6), path)
    return spark.read.json(path)


def write_metric_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
