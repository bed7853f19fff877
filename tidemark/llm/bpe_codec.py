"""BPE encoding and decoding through the automaton of :class:`~.bpe.MergeAutomaton`."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import TextEncoder, vocabulary
from .common import blocks, over_batches, text_list


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids`` (array of int) for each row, repeated rows each on their own; a null text counts as empty, an empty one has no ids, an
    empty table gives no rows. Other columns play no part."""

    def start():
        encoder = TextEncoder(tokenizer, automaton=True)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = text_list(batch)
            for lo, hi in blocks(texts):
                ids, bounds = encoder.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], ["doc_id", "ids"])

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(over_batches(start), f"doc_id {kind}, ids array<int>")


def decode_ids(ids: np.ndarray, labels: list[str]) -> str:
    """The labels of the arcs that the ids name, with a space between (the library's
    way for a vocabulary without decoder)."""
    return " ".join(map(labels.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``, a row for each; null ids give the empty text, an empty table no rows."""

    def start():
        labels = vocabulary(tokenizer).labels

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = [decode_ids(np.array(x or [], np.int64), labels) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

        return step

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(over_batches(start), f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes and decodes each text in one
    pass and keeps only digests, so that ids are never stored. A null text counts as empty; repeated rows each have theirs; an empty table
    gives no rows; other columns play no part."""

    def start():
        encoder = TextEncoder(tokenizer, automaton=True)
        labels = encoder.v.labels

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, n, of_ids, of_text = text_list(batch), [], [], []
            for lo, hi in blocks(texts):
                ids, bounds = encoder.encode(texts[lo:hi])
                n.append(np.diff(bounds))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    of_ids.append(hashlib.sha256(ids[a:b].astype("<u4")).hexdigest())
                    of_text.append(hashlib.sha256(decode_ids(ids[a:b], labels).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(n), pa.int64()), pa.array(of_ids), pa.array(of_text)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(over_batches(start), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
