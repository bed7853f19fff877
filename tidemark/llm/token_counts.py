"""Token counts without ids.

Within a block of documents the pre-token frequencies of each document are gathered
(texts are cut into chunks at white space first, and each distinct chunk is split into pre-tokens once).
The pieces of each distinct pre-token are counted once, and remembered by the task up to a bound; the frequencies
are joined to them by code and summed. The join runs inside the task: frequencies of
all documents together are about as large as the texts, and a shuffle by pre-token would send them all and
make common words hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import PieceCounter
from .common import blocks, over_batches, text_list


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row, repeated rows each on their own; a null text
    counts as empty, long texts count whole, an empty table gives no rows."""

    def start():
        counter = PieceCounter(tokenizer)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = text_list(batch)
            n = np.concatenate([counter.count(texts[lo:hi]) for lo, hi in blocks(texts)])
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(over_batches(start), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
