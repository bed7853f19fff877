"""Canonical exact fingerprints.

A text is normalised (NFKC), case-folded and its white space folded; the fingerprint is
the 128-bit xxhash of the result. Texts of equal hash are compared byte by byte over
the whole corpus, and different texts that share a hash get a number after it.
Two fingerprints are alike 1.0 if equal, else 0.0.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Members, input_tasks, over_batches, saved, text_list


def canonical(text: str) -> bytes:
    """The text without differences of Unicode form, case and white space, as UTF-8."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


class Fingerprinter:
    """Fingerprints of single texts; ``shared``: for hashes of several texts these, in order."""

    def __init__(self, shared: dict[str, list[bytes]], bits: int = 128):
        self.shared, self.digits = shared, bits // 4

    def digest(self, body: bytes) -> str:
        return xxhash.xxh3_128_hexdigest(body)[: self.digits]

    def __call__(self, text: str) -> str:
        body = canonical(text)
        name = self.digest(body)
        if others := self.shared.get(name):
            # a text that no document has comes after those that documents have
            return f"{name}-{others.index(body)}" if body in others else f"{name}-{len(others)}-{hashlib.sha256(body).hexdigest()}"
        return name


#: Clashing hashes, and texts with such hashes, that may go to the driver.
MOST_SHARED = 10_000
#: Most bits of the filter of repeated hashes (16 MB); it is sparse up to some 30 million of them.
MEMBER_BITS = 27


def _key(digest: str) -> int:
    return int(digest[:15], 16)


def digest_keys(docs: DataFrame, bits: int = 128) -> DataFrame:
    """``key`` of the hashes of the texts, each once a batch, so that a large group of copies is small."""
    name = Fingerprinter({}, bits).digest

    def keys_of():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            own = {canonical(t) for t in set(text_list(batch))}
            yield pa.RecordBatch.from_pydict({"key": pa.array([_key(name(x)) for x in own], pa.int64())})

        return step

    return docs.select("text").mapInArrow(over_batches(keys_of), "key long")


def shared_digests(docs: DataFrame, keys: DataFrame, bits: int = 128) -> dict[str, list[bytes]]:
    """Hashes that belong to more than one canonical text, with these texts in order.

    ``keys`` are those of the hashes (:func:`digest_keys`). Only texts whose key came more than once are sent
    (compressed, each once a batch) and grouped by hash and bytes. With 128 bits the result is empty for any corpus one can
    expect; it alone goes to the driver, and more than ``MOST_SHARED`` such hashes or texts end the run with an error.
    """
    name = Fingerprinter({}, bits).digest
    repeated = saved(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    n = repeated.count()
    if not n:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(Members(repeated, bits=min(MEMBER_BITS, max(21, (8 * n).bit_length()))))

    def bodies_of():
        small = zstandard.ZstdCompressor(level=3)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            own = [(name(x), x) for x in {canonical(t) for t in set(text_list(batch))}]
            own = [(n, small.compress(x)) for n, x in own if shared.value.may_hold(_key(n))]
            yield pa.RecordBatch.from_pydict({"digest": pa.array([n for n, _ in own], pa.string()), "body": pa.array([x for _, x in own], pa.binary())})

        return step

    bodies = docs.select("text").mapInArrow(over_batches(bodies_of), "digest string, body binary").groupBy("digest", "body").agg(F.count("*").alias("n"))
    several = bodies.groupBy("digest").agg(F.count("*").alias("n"), F.min("body").alias("a"), F.max("body").alias("b")).where("n > 1").select("digest")
    out: dict[str, list[bytes]] = {}
    if names := [r["digest"] for r in several.limit(MOST_SHARED + 1).collect()]:
        plain = zstandard.ZstdDecompressor()
        texts = bodies.where(F.col("digest").isin(names[:MOST_SHARED])).limit(MOST_SHARED + 1).collect()
        if max(len(names), len(texts)) > MOST_SHARED:
            raise ValueError(f"more than {MOST_SHARED} hashes or texts in clashes: {bits} bits are too few for these texts")
        for r in texts:
            out.setdefault(r["digest"], []).append(plain.decompress(r["body"]))
    return {k: sorted(v) for k, v in out.items()}


def fingerprints(docs: DataFrame, bits: int = 128) -> DataFrame:
    """``doc_id, fingerprint`` for each row, repeated rows each on their own; a null text counts as empty, an empty table gives no rows."""
    shared = shared_digests(docs, digest_keys(docs, bits), bits)

    def start():
        of = Fingerprinter(shared, bits)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([of(t) for t in text_list(batch)], pa.string())], ["doc_id", "fingerprint"])

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(over_batches(start), f"doc_id {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sensitivity(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Fingerprint of each text, of its edited text, and likeness to these and the next document.

    Documents follow each other by doc_id, then text (null first, as the empty text), the first after the last. Rows that repeat
    a doc_id follow each other likewise. Texts travel once, sorted within ranges of doc_id, and are fingerprinted there; the last
    of a range waits for the first of the next one, which are as few as the ranges. A null text counts as empty, long
    texts count whole, an empty table gives no rows. Hashes that came more than once are then compared byte by byte; only if
    two texts share one is everything named again.
    """
    out = _follow(docs, bits, {})
    keys = out.where("kind <> 'first'").select(F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("long").alias("key"))
    if shared := shared_digests(docs, keys, bits):
        out = _follow(docs, bits, shared)
    return _closed(out, bits, shared)


NAMES = [x.split()[0] for x in RESULT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _result(of: Fingerprinter, doc_id, own: str, text: str, next_own: str, following: str) -> tuple:
    other = edited(text, following)
    name = of(other)
    return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), own, name, float(name == own), float(own == next_own)


def _follow(docs: DataFrame, bits: int, shared: dict[str, list[bytes]]) -> DataFrame:
    """Results of all but the last document of each range (kind ``done``), and each range's ``first`` and ``last`` document
    with its compressed text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = texts.repartitionByRange(input_tasks(docs.sparkSession, docs), "doc_id").sortWithinPartitions("doc_id", "text")
    names, types = ["kind", "part", "body", *NAMES], [pa.string(), pa.int64(), pa.binary(), *TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, small, before = Fingerprinter(shared, bits), zstandard.ZstdCompressor(level=4), None
        end = lambda kind, r: (kind, r[0], small.compress(r[3].encode()), r[1], None, None, r[2], None, None, None)
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            rows = []
            for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):
                now = (part, doc_id, of(text), text)
                if before is None:
                    rows.append(end("first", now))
                else:
                    rows.append(("done", part, None, *_result(of, *before[1:], *now[2:])))
                before = now
            if rows:
                yield table(rows)
        if before is not None:
            yield table([end("last", before)])

    return saved(ranges.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, f"kind string, part long, body binary, {RESULT}"))


def _closed(out: DataFrame, bits: int, shared: dict[str, list[bytes]]) -> DataFrame:
    """The results of :func:`_follow` with those of the last document of each range."""
    firsts = out.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("fingerprint").alias("next_fingerprint"), F.col("body").alias("next_body"))
    order = Window.orderBy("next_part")  # a row for each range
    after = firsts.select(F.col("next_part").alias("part"), F.coalesce(F.lead("next_part").over(order), F.min("next_part").over(Window.partitionBy())).alias("next_part"))
    waiting = out.where("kind = 'last'").join(after, "part").join(firsts, "next_part").select("doc_id", "fingerprint", "body", "next_fingerprint", "next_body")

    def close():
        of, plain = Fingerprinter(shared, bits), zstandard.ZstdDecompressor()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            text = lambda x: plain.decompress(x).decode()
            rows = [_result(of, r["doc_id"], r["fingerprint"], text(r["body"]), r["next_fingerprint"], text(r["next_body"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

        return step

    return out.where("kind = 'done'").select(*NAMES).unionByName(waiting.mapInArrow(over_batches(close), RESULT))
