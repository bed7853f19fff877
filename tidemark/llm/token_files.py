"""Token ids in segments of patched frame-of-reference blocks.

A segment holds consecutive documents in order of doc_id. Its ids are cut into blocks of
256: the block minimum is subtracted, the differences are packed at the width of a
percentile of them, and the higher bits of the others go to exception lists. A block
index has each block's minimum, width, first word and first exception, so any block
decodes alone. Segments are rows of a Parquet table, written and read by Spark.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TextEncoder
from .common import blocks, input_tasks, over_batches, saved, text_list

BLOCK = 256
#: Ids of a segment before it is closed (a longer document has its segment alone).
SEGMENT = 1 << 20
PERCENTILE = 98
INDEX = np.dtype([("low", "<u4"), ("word", "<u4"), ("patch", "<u4"), ("width", "u1")])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, bytes, bytes, bytes]:
    """Block index, packed words, exception places (u1) and exception high bits (u4)."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1] if len(ids) else 0
    full = full.reshape(n, BLOCK)
    index = np.zeros(n, INDEX)
    if not n:
        return b"", b"", b"", b""
    index["low"] = full.min(1)
    rest = full - index["low"][:, None]
    at = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    index["width"] = _bits(np.partition(rest, at, axis=1)[:, at])
    words = index["width"].astype(np.int64) * (BLOCK // 64)
    index["word"] = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), np.uint64)
    high = rest >> index["width"][:, None]
    block, place = np.nonzero(high)
    index["patch"] = np.searchsorted(block, np.arange(n))
    for w in np.unique(index["width"]).tolist():
        if w:
            own = np.flatnonzero(index["width"] == w)
            value = np.ascontiguousarray((rest[own] & np.uint32(2**w - 1)).T.astype(np.uint64))
            lanes = np.zeros((w * BLOCK // 64, len(own)), np.uint64)
            for j in range(BLOCK):
                word, shift = divmod(j * w, 64)
                lanes[word] |= value[j] << np.uint64(shift)
                if shift + w > 64:
                    lanes[word + 1] |= value[j] >> np.uint64(64 - shift)
            out[(index["word"][own][:, None] + np.arange(len(lanes))).ravel()] = lanes.T.ravel()
    return index.tobytes(), out.tobytes(), place.astype(np.uint8).tobytes(), high[block, place].astype("<u4").tobytes()


def unpack_blocks(index: bytes, packed: bytes, places: bytes, highs: bytes) -> np.ndarray:
    """All ids of a segment, the last block filled up."""
    index, words = np.frombuffer(index, INDEX), np.frombuffer(packed, np.uint64)
    out = np.zeros((len(index), BLOCK), np.uint32)
    for w in np.unique(index["width"]).tolist():
        if w:
            own = np.flatnonzero(index["width"] == w)
            lanes = np.ascontiguousarray(words[index["word"][own][:, None] + np.arange(w * BLOCK // 64)].T)
            value = np.empty((BLOCK, len(own)), np.uint32)
            for j in range(BLOCK):
                word, shift = divmod(j * w, 64)
                x = lanes[word] >> np.uint64(shift)
                if shift + w > 64:
                    x = x | lanes[word + 1] << np.uint64(64 - shift)
                value[j] = x & np.uint64(2**w - 1)
            out[own] = value.T
    place, high = np.frombuffer(places, np.uint8), np.frombuffer(highs, "<u4")
    block = np.repeat(np.arange(len(index)), np.diff(np.append(index["patch"], len(place))))
    out[block, place] |= high << index["width"][block].astype(np.uint32)
    return (out + index["low"][:, None]).ravel()


SCHEMA = "part long, segment long, doc_ids array<long>, sizes array<int>, block_index binary, packed binary, places binary, highs binary"


def segments(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """One row a segment. Rows of equal doc_id stand in order of their text, repeated rows each once; a null doc_id comes first; a null text
    counts as empty and has the end id alone; an empty table gives no segments."""
    tasks = input_tasks(docs.sparkSession, docs)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = placed.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = None, 0, 0
        docs, sizes, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            row = [[part], [number], [docs], [sizes], *([x] for x in pack_blocks(np.concatenate(parts)))]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            encoder = encoder or TextEncoder(tokenizer)
            texts, keys = text_list(batch), batch.column("doc_id").to_pylist()
            for lo, hi in blocks(texts):
                part = batch.column("part")[lo].as_py()
                ids, bounds = encoder.encode(texts[lo:hi])
                n = np.diff(bounds) + 1
                joined = np.full(int(n.sum()), end_id, np.uint32)
                inside = np.ones(len(joined), bool)
                inside[np.cumsum(n) - 1] = False
                joined[inside] = ids
                docs, sizes, parts, held = docs + keys[lo:hi], sizes + n.tolist(), [*parts, joined], held + len(joined)
                if held >= SEGMENT:
                    yield close()
                    docs, sizes, parts, held, number = [], [], [], 0, number + 1
        if docs:
            yield close()

    return placed.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes the segments of ``docs`` to the folder ``path``, replacing what is there."""
    segments(docs, tokenizer, end_id).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document from the files at ``path``."""
    files = spark.read.schema(SCHEMA).parquet(path)
    total = files.select("part", "segment", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    by_part = total.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each task of the writer
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    begins = total.join(before, "part").select(
        "part", "segment", (F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n")).alias("begin")
    )

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for r in batch.to_pylist():
                ids = unpack_blocks(r["block_index"], r["packed"], r["places"], r["highs"]).astype("<u4")
                n = np.array(r["sizes"], np.int64)
                end = np.cumsum(n)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((end - n).tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(n), pa.int64()), pa.array([r["segment"]] * len(n), pa.int64()), pa.array(r["doc_ids"], pa.int64()), *(pa.array(x, pa.int64()) for x in (end - n, n, crc))],
                    ["part", "segment", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

        return step

    got = files.mapInArrow(over_batches(start), "part long, segment long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return got.join(begins, ["part", "segment"]).select("doc_id", (F.col("begin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Empty tables give no rows, repeated rows one each. Writes ``docs`` into a new folder below ``spark.checkpoint.dir`` and reads it back."""
    spark = docs.sparkSession
    saved(spark.range(1))  # makes sure that a shared folder is set
    path = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return read(spark, path)
