"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled at once inside a task; bounds the numpy scratch memory.
BLOCK_CHARS = 500_000
#: Rows of a batch that goes to Python at once.
BATCH_ROWS = 2_000


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are made and run inside are removed as each ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with ``checkpoint()`` in the shared folder; its shuffle files, which nothing reads again, go at once.

    The folder is ``spark.checkpoint.dir`` of the session; one of its own is set only where the
    session names none and runs inside one machine (tests). On a cluster without the setting this is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not (folder := df.sparkSession.conf.get("spark.checkpoint.dir", None)):
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        context.setCheckpointDir(folder)
    with released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that this session sends to Python, as whole texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def input_tasks(spark: SparkSession, df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows of ``df``: as many as its scan has, at least
    the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters each (a longer text is alone)."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def over_batches(make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]):
    """A ``mapInArrow`` function: ``make()`` runs once a task and gives the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or make()
                yield from step(batch)

    return run


def text_list(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


class Members:
    """A bit for each remainder of 64-bit keys: tells for sure which keys are not among those given.

    Its size does not depend on the keys: with very many it lets more through, never less.
    """

    def __init__(self, keys: DataFrame, name: str = "key", bits: int = 21):
        self.bits = bits
        spot = F.pmod(F.col(name), F.lit(1 << bits))
        cells = keys.select(F.shiftright(spot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(pmod({name}, {1 << bits}) & 63 as int))").alias("bit"))
        self.words = np.zeros(1 << bits - 6, np.int64)
        with released(keys.sparkSession):
            got = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2**(bits - 6) rows at most
        self.words[got.column("cell").to_numpy()] = got.column("bits").to_numpy()

    def may_hold(self, key: int) -> bool:
        at = key % (1 << self.bits)
        return bool(int(self.words[at >> 6]) >> (at & 63) & 1)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a compressed Parquet table in the shared folder and read back; cuts the lineage as :func:`saved` does."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        saved(df.sparkSession.range(1))  # makes sure that a shared folder is set
    path = f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
