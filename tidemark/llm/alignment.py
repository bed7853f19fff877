"""Alignment of two tokenizers over a corpus, each distinct text once.

1. Rows are shuffled by their full text and copies counted. The tasks tokenise and align each distinct text, by
   *stretches*: cuts before a space that follows no white space, where both tokenizers begin anew. Consecutive texts of
   a task form a block, in which each distinct stretch is aligned once.
2. Each block gives its id pairs with their links, weighted by the number of copies of each text. They are summed over
   the corpus, and each pair learns whether it is its second id's most frequent one.
3. The sums go back to the blocks that asked for them, blocks add them up for each stretch and text, and texts' measures are
   joined to doc_ids by the text's SHA-256. Texts that hold over a thousandth of all rows (under a thousand of them) are
   broadcast; the others have few rows each.

Nothing that is broadcast grows with the data, and a block's memory is bounded by its stretches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codes, TextEncoder, byte_symbols, gather
from .common import blocks, input_tasks, saved, stored

#: A block ends after so many distinct stretches or characters of text.
BLOCK_STRETCHES, BLOCK_TEXT = 100_000, 64_000_000
#: Ids of the first tokenizer lie below this; a pair is ``second id * PAIR_BASE + first id``.
PAIR_BASE = 1 << 31
#: Texts with more than 1/HOT_SHARE of all rows have their measures broadcast: fewer than HOT_SHARE rows.
HOT_SHARE = 1000

_CUT = re.compile(r"(?<=\S) ")
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _flat_bytes(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries' bytes one after another, where each begins, and its length."""
    size = np.fromiter(map(len, entries), np.int64, len(entries))
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size


class Tokenizers:
    """Both tokenizers and the bytes of their entries: byte-level BPE of ``tokenizers`` (A, asked with a space before the text) and
    a ``sentencepiece`` model that adds it itself (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = TextEncoder(path_a)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes_a = _flat_bytes([bytes(byte.get(c, 0) for c in x) for x in self.a.v.labels])
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if self.a.v.kind != "byte":
            raise ValueError("the first tokenizer must be byte-level")
        if any("▁" in x.lstrip("▁") for x in names) or "".join(b.encode("  a  b ", out_type=str)) != "▁▁▁a▁▁b▁":
            raise ValueError("the second tokenizer must keep white space and have no piece over the begin of a word")
        self.bytes_b = _flat_bytes([bytes([int(x[3:5], 16)]) if b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])
        self.space = b.piece_to_id("▁")

    def ids_a(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each stretch with its space before it, and their number."""
        self.a._forget()
        known = len(self.a.size)
        self.a._learn(stretches)
        start, size = self.a.start[known:], self.a.size[known:].astype(np.int64)
        return self.a.ids[gather(np.arange(len(size)), start, size)], size

    def ids_b(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [x or [self.space] for x in self.b.encode(stretches, num_threads=1)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.int64, int(size.sum())), size


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _same_bytes(ids: np.ndarray, size: np.ndarray, table: tuple, raw: np.ndarray, raw_size: np.ndarray) -> np.ndarray:
    """For each stretch whether its ids' joined bytes are its own."""
    flat, start, length = table
    of = np.repeat(np.arange(len(size)), size)
    total = np.bincount(of, weights=length[ids], minlength=len(size)).astype(np.int64)
    ok = total == raw_size
    keep, mine = ok[of], np.repeat(ok, raw_size)
    differ = flat[gather(ids[keep], start, length)] != raw[mine]
    ok[np.repeat(np.arange(len(size)), raw_size)[mine][differ]] = False
    return ok


class Block:
    """Stretches of a run of texts, each aligned when it first appears."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.code, self.slot = Codes(), Codes()
        self.names: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whole
        self.links: list[np.ndarray] = []
        self.weight = np.zeros(0, np.int64)

    def add(self, texts: list[str], times: np.ndarray) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """For each text: n_a, n_b, n_groups, n_links; its groups as text; its distinct stretches and how often each occurs."""
        cut = [_CUT.split(t) for t in texts]
        self.code.new.clear()
        coded = [np.fromiter(map(self.code.__getitem__, x), np.int64, len(x)) for x in cut]
        if self.code.new:
            self._learn(self.code.new)
        for codes, n in zip(coded, times.tolist(), strict=True):
            own, often = np.unique(codes, return_counts=True)
            total = often @ self.counts[own]
            if total[4] < len(codes):  # some bytes differ: no tokens
                yield np.zeros(4, np.int64), "", own[:0], often[:0]
                continue
            self.weight[own] += often * n
            yield total[:4], ";".join(map(self.names.__getitem__, codes.tolist())), own, often

    def _learn(self, new: list[str]) -> None:
        raw_bytes = [b" " + s.encode("utf-8", "surrogatepass") for s in new]
        raw, raw_size = np.frombuffer(b"".join(raw_bytes), np.uint8), np.fromiter(map(len, raw_bytes), np.int64, len(new))
        (a, n_a), (b, n_b) = self.both.ids_a(new), self.both.ids_b(new)
        whole = _same_bytes(a, n_a, self.both.bytes_a, raw, raw_size) & _same_bytes(b, n_b, self.both.bytes_b, raw, raw_size)
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        n_a, n_b = n_a * whole, n_b * whole
        # all stretches one after another: stretches end where tokens of both end, so the groups of one never reach into the next
        end_a, end_b = np.cumsum(self.both.bytes_a[2][a]), np.cumsum(self.both.bytes_b[2][b])
        ends = np.union1d(end_a, end_b)
        of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)  # tokens that share the bytes before each end
        closes = (end_a[of_a] == ends) & (end_b[of_b] == ends) if len(ends) else np.zeros(0, bool)
        stretch = np.repeat(np.arange(len(new)), n_a)[of_a]
        n_links, n_groups = np.bincount(stretch, minlength=len(new)), np.bincount(stretch[closes], minlength=len(new))
        pairs = b[of_b] * PAIR_BASE + a[of_a]
        slots = np.fromiter(map(self.slot.__getitem__, pairs.tolist()), np.int32, len(pairs))
        self.links.append(slots)
        self.counts = np.concatenate((self.counts, np.stack((n_a, n_b, n_groups, n_links, whole), 1)))
        self.weight = np.concatenate((self.weight, np.zeros(len(new), np.int64)))
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        stop_a, stop_b = (of_a[closes] + 1).tolist(), (of_b[closes] + 1).tolist()
        groups = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip([0, *stop_a], stop_a, [0, *stop_b], stop_b, strict=False)]
        at = np.concatenate(([0], np.cumsum(n_groups))).tolist()
        self.names += [";".join(groups[i:j]) for i, j in zip(at, at[1:], strict=False)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each id pair of the block by its slot, and its links in all copies of the block's texts."""
        total = np.zeros(len(self.slot), np.int64)
        np.add.at(total, self.slots(), np.repeat(self.weight, self.counts[:, 3]))
        return np.fromiter(self.slot, np.int64, len(self.slot)), total

    def slots(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *self.links])


#: kind 0: an id pair of a block; 1: the block's stretches; 2: a text.
ALIGNED = (
    "block string, kind int, slot int, pair long, links long, digest binary, times long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "stretches binary, often binary"
)
_FIELDS = [x.split() for x in ALIGNED.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(n: int, **given) -> pa.RecordBatch:
    columns = [pa.array(given[c], _TYPES[t]) if c in given else pa.nulls(n, _TYPES[t]) for c, t in _FIELDS]
    return pa.RecordBatch.from_arrays(columns, [c for c, _ in _FIELDS])


def _align(path_a: str, path_b: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, number, block, chars = tokenizers(path_a, path_b), 0, None, 0
        task = TaskContext.get().partitionId()

        def closed() -> Iterator[pa.RecordBatch]:
            name = f"{task}-{number}"
            pairs, links = block.pairs()
            linked = np.flatnonzero(links)  # pairs of texts without tokens have none
            for at in range(0, len(linked), 50_000):
                some = linked[at : at + 50_000]
                n = len(some)
                yield _rows(n, block=[name] * n, kind=np.zeros(n, np.int32), slot=some.astype(np.int32), pair=pairs[some], links=links[some])
            yield _rows(1, block=[name], kind=[1], stretches=[block.slots().tobytes()], often=[block.counts[:, 3].astype(np.int32).tobytes()])

        for batch in batches:
            texts, times = batch.column("text").to_pylist(), batch.column("times").to_numpy()
            for lo, hi in blocks(texts):
                block = block or Block(both)
                counts, shown, own, often = [], [], [], []
                for total, groups, stretches, n in block.add(texts[lo:hi], times[lo:hi]):
                    counts.append(total)
                    shown.append(hashlib.sha256(groups.encode()).hexdigest() if digest and groups else groups)
                    own.append(stretches.astype(np.int32).tobytes())
                    often.append(n.astype(np.int32).tobytes())
                c = np.stack(counts)
                yield _rows(
                    hi - lo, block=[f"{task}-{number}"] * (hi - lo), kind=np.full(hi - lo, 2, np.int32), digest=batch.column("digest").slice(lo, hi - lo).to_pylist(),
                    times=times[lo:hi], n_a=c[:, 0], n_b=c[:, 1], n_groups=c[:, 2], n_links=c[:, 3], groups=shown, stretches=own, often=often,
                )
                chars += sum(map(len, texts[lo:hi]))
                if len(block.code) >= BLOCK_STRETCHES or chars >= BLOCK_TEXT:
                    yield from closed()
                    number, block, chars = number + 1, None, 0
        if block:
            yield from closed()

    return run


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, digest: bool = True) -> DataFrame:
    """Rows ``ALIGNED`` of all distinct texts with a character, written to the shared folder."""
    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("times")).select("text", "times", F.unhex(F.sha2("text", 256)).alias("digest"))
    return stored(texts.mapInArrow(_align(path_a, path_b, digest), ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, a_id, b_id, count, best``: the links of each id pair in the whole corpus, and whether no other pair of its ``b_id`` has more."""
    pairs = saved(aligned.where("kind = 0").groupBy("pair").agg(F.sum("links").alias("count")).withColumn("b_id", F.expr(f"pair div {PAIR_BASE}")))
    most = pairs.groupBy("b_id").agg(F.max("count").alias("most"))  # a row for each entry of the vocabulary at most
    return pairs.join(F.broadcast(most), "b_id").select("pair", (F.col("pair") % PAIR_BASE).alias("a_id"), "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the pairs' counts for each stretch and text of a block; rows come by block, then kind."""
    name, slots, count, best, ready = None, [], [], [], None
    for batch in batches:
        names, kinds = np.array(batch.column("block").to_pylist(), object), batch.column("kind").to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (kinds[1:] != kinds[:-1]), [True])))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if names[lo] != name:
                name, slots, count, best, ready = names[lo], [], [], [], None
            part = batch.slice(lo, hi - lo)
            if kinds[lo] == 0:
                slots.append(part.column("slot").to_numpy())
                count.append(part.column("count").to_numpy())
                best.append(part.column("best").to_numpy(zero_copy_only=False))
            elif kinds[lo] == 1:
                links = np.frombuffer(part.column("stretches")[0].as_py(), np.int32)
                number = [np.zeros(int(links.max(initial=-1)) + 1, np.int64) for _ in range(2)]
                for known, flag, total in zip(slots, best, count, strict=True):
                    number[0][known], number[1][known] = flag, total
                end = np.cumsum(np.frombuffer(part.column("often")[0].as_py(), np.int32), dtype=np.int64)
                sums = [np.concatenate(([0], np.cumsum(x[links]))) for x in number]
                ready = [s[end] - s[np.concatenate(([0], end[:-1]))] for s in sums]
            else:
                got = []
                for own, often in zip(part.column("stretches").to_pylist(), part.column("often").to_pylist(), strict=True):
                    own, often = np.frombuffer(own, np.int32), np.frombuffer(often, np.int32).astype(np.int64)
                    got.append([int(often @ x[own]) for x in ready])
                g = np.array(got, np.int64).reshape(-1, 2)
                kept = ["digest", "times", "n_a", "n_b", "n_groups", "n_links", "groups"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(g[:, 0]), pa.array(g[:, 1])], [*kept, "n_best", "count_sum"])


def measure_texts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``digest, times, n_a, n_b, n_groups, n_links, groups, n_best, count_sum`` for each distinct text."""
    known = aligned.where("kind = 0").select("block", "kind", "slot", "pair").join(counts.select("pair", "count", "best"), "pair").drop("pair")
    rest = aligned.where("kind > 0").select("block", "kind", "digest", "times", "n_a", "n_b", "n_groups", "n_links", "groups", "stretches", "often")
    both = known.unionByName(rest, allowMissingColumns=True)
    dealt = both.repartition(input_tasks(aligned.sparkSession, aligned), "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(_measured, "digest binary, times long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = True) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each row of ``docs`` (``doc_id, text``).

    ``groups`` lists the ids between shared byte offsets (``a1,a2|b1;a3|b2,b3``), or is its SHA-256 with ``digest``. A text
    that is null or empty, or that a tokenizer does not give back byte for byte, has zeros and an empty ``groups``. Repeated
    rows each count and each get their row; rows without doc_id too; other columns play no part; an empty table gives no rows. Very long
    texts are aligned whole.
    """
    aligned = aligned_blocks(docs, path_a, path_b, digest)
    texts = stored(measure_texts(aligned, pair_counts(aligned)), "measures")
    total = texts.agg(F.sum("times")).first()[0] or 0
    columns = [*MEASURES, "groups"]
    hot = texts.where(F.col("times") * HOT_SHARE > total).select(F.col("digest").alias("hot_digest"), F.struct(*columns).alias("hot"))
    cold = texts.where(F.col("times") * HOT_SHARE <= total).select(F.col("digest").alias("key"), F.struct(*columns).alias("cold"))
    rows = docs.select("doc_id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("digest"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    # rows that are done are spread over all tasks: no text has 8 bytes as its key
    done = F.col("digest").isNull() | F.col("hot").isNotNull()
    rows = rows.withColumn("key", F.when(done, F.unhex(F.hex(F.xxhash64("doc_id", F.monotonically_increasing_id())))).otherwise(F.col("digest")))
    found = F.coalesce("hot", "cold")
    joined = rows.join(cold, "key", "left").withColumn("found", found)
    return joined.select("doc_id", *[F.coalesce(F.col(f"found.{c}"), F.lit(0).cast("long")).alias(c) for c in MEASURES], F.coalesce("found.groups", F.lit("")).alias("groups"))
