"""Packing documents into training sequences by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``width`` tokens. The histogram of piece lengths
(at most ``width`` rows) is packed on the driver: lengths are placed longest first, each
into the open pattern with the most room, and only counts of patterns are kept. Pieces
then find their place by rank within their length. Ids are not stored: a piece
carries its checksum.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TextEncoder
from .common import blocks, over_batches, saved, text_list

#: Rows of one length are ranked in so many parts, or one for each PART_ROWS of all rows, as one length may hold most pieces.
RANK_PARTS, PART_ROWS = 128, 500_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, width: int = 1024) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: each document's ids with ``end_id``
    after them, cut every ``width`` ids. A null or empty text has the end id alone; repeated
    rows are cut each on their own; an empty table gives no pieces."""

    def start():
        encoder = TextEncoder(tokenizer)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, end = text_list(batch), np.array([end_id], "<u4")
            for lo, hi in blocks(texts):
                ids, bounds = encoder.encode(texts[lo:hi])
                ids, row, begin, size, crc, total = ids.astype("<u4"), [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), lo):
                    n = b - a + 1
                    for s in range(0, n, width):
                        e = min(n, s + width)
                        c = zlib.crc32(ids[a + s : min(b, a + e)])
                        row.append(i), begin.append(s), size.append(e - s), total.append(n)
                        crc.append(zlib.crc32(end, c) if e == n else c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (begin, size, crc, total))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(over_batches(start), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns with their counts. Each length takes the open patterns of most room first;
    a pattern's count is split when only a part of its packs gets the piece."""
    room: dict[int, list[list]] = defaultdict(list)
    full: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            gap = max((g for g in room if room[g] and g >= length), default=None)
            if gap is None:
                n, pattern, after = left, (length,), width - length
            else:
                n, before = room[gap].pop()
                if n > left:
                    room[gap].append([n - left, before])
                    n = left
                pattern, after = (*before, length), gap - length
            left -= n
            if after:
                room[after].append([n, pattern])
            else:
                full.append((n, pattern))
    return full + [(n, p) for g in sorted(room) for n, p in room[g]]


def slots(spark: SparkSession, patterns: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """For each place in a pattern the ranks of its length that go there: ``slot_length,
    from_rank, to_rank, first_sequence, offset``. Its size follows from the width alone."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for n, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return spark.createDataFrame(rows, "slot_length long, from_rank long, to_rank long, first_sequence long, offset long")


def pack(cut: DataFrame, width: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` (gapless from 0) and ``offset`` to pieces (``doc_id, start, length, ids_crc32, doc_tokens``).

    ``cut`` is read several times; save it first. No pieces give no rows. Repeated
    rows are packed each on its own.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = slots(spark, shortest_pack_first(histogram, width))
    parts = max(RANK_PARTS, sum(histogram.values()) // PART_ROWS)
    part = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)))
    sizes = part.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = part.withColumn("k", F.row_number().over(within)).join(base, ["length", "part"]).withColumn("k", F.col("base") + F.col("k") - 1)
    there = (F.col("length") == F.col("slot_length")) & (F.col("k") >= F.col("from_rank")) & (F.col("k") < F.col("to_rank"))
    return ranked.join(F.broadcast(place), there).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("k") - F.col("from_rank")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, width: int = 1024) -> DataFrame:
    """Cuts and packs whole documents, repeated rows each on their own; an empty table gives no rows. See :func:`pieces` and :func:`pack`."""
    return pack(saved(pieces(docs, tokenizer, end_id, width)), width)
