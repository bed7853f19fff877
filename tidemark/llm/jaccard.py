"""Near duplicates: Jaccard join of word n-gram sets, with signature trees.

1.  Each distinct text set is one class (its 64-bit key comes from a 128-bit digest of
    the sorted shingle hashes; digests that share a key are told apart).
2.  Shingles are ordered by how common they are (counts of hash buckets over all
    documents, a table of fixed size) and a set's prefix in that order is dealt out:
    two sets that link share a number of shingles of both prefixes, whatever the order.
    Keys that share fewer with all others together are left out.
3.  In each prefix group the member that shares most with others leads. Every
    key is compared exactly with the leader that it meets most often, and linked keys are
    contracted, so that large groups of copies need no pairs.
4.  Groups that still hold several components go through signature trees: nodes hold
    OR-combined bitmaps, size ranges and the component if it is one; a dual traversal
    drops node pairs whose largest possible overlap is too small or that are already
    connected. Pairs that remain are compared exactly.
5.  Components of all links, by alternating large-star and small-star steps.

A link is lost nowhere: steps 3 and 4 leave out only pairs that cannot link or that are
connected already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Members, blocks, over_batches, released, saved

#: Hash buckets whose document counts order the shingles, and the parts in which they are summed.
BUCKET_BITS, SLICES = 20, 64
BITMAP_BITS = 2048
LEAF, FAN = 48, 8
#: Prefixes are longer by one in so many shingles, and linked sets then share as many shingles of both prefixes.
SHARED = 16
#: Rows of a prefix group that one task compares; larger groups are compared by pairs of blocks that may hold links.
GROUP_ROWS = 2_000
#: A shingle of more documents than 2**SPLIT_BITS (by its bucket) is dealt into parts of about as many.
SPLIT_BITS = 16
#: A leader's keys are dealt into so many parts, or one for each LEADER_KEYS of all pairs.
LEADER_PARTS, LEADER_KEYS = 16, 50_000
#: Rows of counts that one task adds up.
COUNT_ROWS = 256
#: Keys that a task remembers to have sent.
SENT_KEYS = 500_000
#: Most bits of the filter of candidates' keys (16 MB); it is sparse up to some 30 million candidates.
MEMBER_BITS = 27
#: More clashing keys than any corpus can have by chance end the run with an error.
MOST_CLASHES = 100_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, _INVERSE):
        factors = np.full(1 << bits, b, np.uint64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return tuple(out)


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text one after another, and where each begins
    (with the end of the last). Words are separated by ASCII white space; A-Z count as a-z."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    gap = _SPACE[raw]
    before = np.concatenate(([True], gap[:-1]))
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    power, inverse = _powers(max(20, int(len(raw)).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])))
    word = _mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, np.cumsum(size) - size)  # of each text's words
    count = np.diff(np.append(first, len(start)))
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    begin = np.cumsum(n) - n
    at = np.repeat(first - begin, n) + np.arange(n.sum())  # the first word of each shingle
    padded = np.concatenate((word, np.zeros(words, np.uint64)))
    full = np.repeat(np.minimum(count, words), n)
    out = full.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    for k in range(words):
        out += np.where(full > k, padded[at + k] * _PLACE[k], np.uint64(0))
    out = _mixed(out)
    for a, b in zip(begin.tolist(), (begin + n).tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begin[n > 0]] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], place[np.append(begin, len(out))]


def _least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with which sets of so many elements together link."""
    return -(-(total * percent) // (100 + percent))


class Keys:
    """The 64-bit key of a set; ``clashes`` holds digests that would share one."""

    def __init__(self, clashes: dict[bytes, int]):
        self.clashes = clashes

    def __call__(self, digest: bytes) -> int:
        return self.clashes.get(digest) or int.from_bytes(digest[:8], "little", signed=True)


def digest_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document (doc_id, n, digest), and for each task its shingle counts (slice, counts)."""
    names = ["doc_id", "n", "digest", "key", "slice", "counts"]
    of = Keys({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in batches:
            texts = _texts(batch)
            for lo, hi in blocks(texts):
                hashes, bound = shingle_sets(texts[lo:hi], words)
                total += np.bincount(hashes >> np.uint64(64 - BUCKET_BITS), minlength=len(total)).astype(np.uint32)
                digests = [digest_of(hashes[a:b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
                k = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, k).cast(pa.int64()), pa.array(np.diff(bound), pa.int64()), pa.array(digests, pa.binary()), pa.array(map(of, digests), pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if total.any():
            small = zstandard.ZstdCompressor(level=1)
            parts = [small.compress(x.tobytes()) for x in np.split(total, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, key long, slice int, counts binary")


def _classes(survey: DataFrame) -> np.ndarray:
    """For each hash bucket how common it is, on a logarithmic scale: 2**BUCKET_BITS bytes."""

    def add(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plain, small = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
            at, total = None, None

            def done() -> pa.RecordBatch:
                if last:
                    body = np.minimum(255, 6 * np.log2(1 + total)).astype(np.uint8).tobytes()
                else:
                    body = small.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes())
                return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([body], pa.binary())], ["slice", "counts"])

            for batch in batches:
                for k, x in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                    if k != at:
                        if at is not None:
                            yield done()
                        at, total = k, np.zeros((1 << BUCKET_BITS) // SLICES, np.int64)
                    total += np.frombuffer(plain.decompress(x.as_py()), np.uint32)
            if at is not None:
                yield done()

        return run

    counts = survey.where("slice is not null").select("slice", "counts")
    groups = counts.count() // SLICES // COUNT_ROWS
    if groups > 1:  # add up in two levels, so that no task reads a row of every scan task
        part = F.pmod(F.xxhash64("counts"), F.lit(groups))
        counts = counts.repartition("slice", part).sortWithinPartitions("slice").mapInArrow(add(False), "slice int, counts binary")
    out = np.zeros((SLICES, (1 << BUCKET_BITS) // SLICES), np.uint8)
    for r in counts.repartition("slice").sortWithinPartitions("slice").mapInArrow(add(True), "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def _key_clashes(rows: DataFrame) -> dict[bytes, int]:
    """Keys of their own for digests whose first 8 bytes are not theirs alone (expected: none)."""
    several = rows.where("n > 0").groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("key").limit(MOST_CLASHES + 1).collect()
    if len(several) > MOST_CLASHES:
        raise ValueError(f"more than {MOST_CLASHES} keys with several digests")
    out: dict[bytes, int] = {}
    if several:
        for r in rows.where(F.col("key").isin([r["key"] for r in several])).select("digest").distinct().collect():
            out[bytes(r["digest"])] = int.from_bytes(xxhash.xxh3_64_digest(bytes(r["digest"]), 1), "little", signed=True) or 1
    return out


def _each_set(docs: DataFrame, words: int, schema: str, clashes: dict[bytes, int], rows_of) -> DataFrame:
    """Runs ``rows_of(key, hashes, text)`` -> columns over the distinct sets of each task (as far as it remembers)."""
    names, of = [x.split()[0] for x in schema.split(", ")], Keys(clashes)
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def start():
        seen: set[int] = set()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = _texts(batch)
            for lo, hi in blocks(texts):
                if len(seen) > SENT_KEYS:
                    seen.clear()
                hashes, bound = shingle_sets(texts[lo:hi], words)
                out: list[list] = [[] for _ in names]
                for i, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True), lo):
                    if b > a and (key := of(digest_of(hashes[a:b]))) not in seen:
                        seen.add(key)
                        for c, x in zip(out, rows_of(key, hashes[a:b], texts[i]), strict=True):
                            c.append(x)
                if out[0]:
                    flat = [pa.array(np.concatenate(c), t) if isinstance(c[0], np.ndarray) else pa.array(c, t) for c, t in zip(out, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(flat, names)

        return step

    return docs.select("text").mapInArrow(over_batches(start), schema)


def _prefixes(docs: DataFrame, words: int, percent: int, classes: np.ndarray, clashes: dict[bytes, int]) -> DataFrame:
    """``token, key, n, parts`` for each shingle of each set's prefix; ``parts``: in how many the token's rows are dealt."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def rows_of(key: int, hashes: np.ndarray, _: bytes):
        n = len(hashes)
        p = n - -(-n * percent // 100) + max(1, n // SHARED) if n > 1 else 0  # a single shingle links with its equals only
        common = shared.value[hashes >> np.uint64(64 - BUCKET_BITS)]
        first = np.argsort(common, kind="stable")[:p]
        parts = 1 << np.maximum(0, common[first].astype(np.int64) // 6 + 1 - SPLIT_BITS)
        return hashes[first].view(np.int64), np.full(p, key), np.full(p, n), parts

    return _each_set(docs, words, "token long, key long, n long, parts int", clashes, rows_of)


#: How each value over a token's rows is made, and made again from those of its parts.
OVER = {"low": F.min, "high": F.max, "size": F.sum, "lead": F.max}


def over_parts(rows: DataFrame, of: dict[str, Column]) -> DataFrame:
    """``rows`` (``token, key, parts``) with aggregates (names as in :data:`OVER`) over the rows of their token that lie
    in the same part: all of them, unless the token is common and so dealt into several parts by key."""
    here = Window.partitionBy("token", "sub")
    dealt = rows.withColumn("sub", F.pmod(F.xxhash64("key"), F.col("parts").cast("long")))
    return dealt.select("*", *(OVER[name](x).over(here).alias(name) for name, x in of.items()))


def over_tokens(rows: DataFrame, of: dict[str, Column], split: bool) -> DataFrame:
    """``rows`` with aggregates over all rows of their token. ``split``: whether any token has several parts; what
    is found in these is then combined and joined back to each part. ``rows`` are read twice; save them first."""
    if not split:
        here = Window.partitionBy("token")
        return rows.select("*", *(OVER[name](x).over(here).alias(name) for name, x in of.items()))
    each = over_parts(rows, of)
    whole = rows.where("parts > 1").groupBy("token", "parts").agg(*(OVER[name](x).alias(f"all_{name}") for name, x in of.items()))
    whole = whole.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
    joined = each.join(whole, ["token", "sub"], "left")
    return joined.select(*rows.columns, *(F.when(F.col("parts") > 1, F.col(f"all_{name}")).otherwise(F.col(name)).alias(name) for name in of))


def _bodies(docs: DataFrame, words: int, wanted: DataFrame, clashes: dict[bytes, int]) -> DataFrame:
    """``key, body`` (compressed text) of the sets whose keys are ``wanted``."""
    bits = min(MEMBER_BITS, max(21, (8 * wanted.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(Members(wanted, bits=bits))

    def rows_of(key: int, _: np.ndarray, text: bytes):
        if shared.value.may_hold(key):
            return np.array([key]), np.array([zstandard.compress(text, 1)], object)
        return np.zeros(0, np.int64), np.zeros(0, object)

    found = _each_set(docs, words, "key long, body binary", clashes, rows_of)
    return found.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("body").alias("body"))


def _linked(bodies: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the ``pairs`` (leader, key) those that link, by comparing their whole sets.

    ``pairs`` is read several times; save it first. A leader's set goes once to each part of its keys, ahead of them."""
    part = F.pmod(F.xxhash64("key"), F.lit(max(LEADER_PARTS, pairs.count() // LEADER_KEYS)))
    members = pairs.join(bodies, "key").select("leader", part.alias("part"), F.lit(1).alias("kind"), "key", "body")
    ahead = pairs.select("leader", part.alias("part")).distinct()
    leaders = ahead.join(bodies.select(F.col("key").alias("leader"), "body"), "leader").select("leader", "part", F.lit(0).alias("kind"), F.col("leader").alias("key"), "body")
    met = members.unionByName(leaders).repartition("leader", "part").sortWithinPartitions("leader", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, lead = zstandard.ZstdDecompressor(), np.zeros(0, np.uint64)
        for batch in batches:
            kind, leader, key = (batch.column(c).to_pylist() for c in ("kind", "leader", "key"))
            bodies = batch.column("body")
            out: list[tuple[int, int]] = []
            for lo in range(0, len(kind), 256):
                hi = min(len(kind), lo + 256)
                hashes, bound = shingle_sets([plain.decompress(bodies[i].as_py()) for i in range(lo, hi)], words)
                for i in range(lo, hi):
                    own = hashes[bound[i - lo] : bound[i - lo + 1]]
                    if kind[i] == 0:
                        lead = own
                        continue
                    place = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
                    both = int((lead[place] == own).sum())
                    if 100 * both >= percent * (len(lead) + len(own) - both):
                        out.append((leader[i], key[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["leader", "key"])

    return met.mapInArrow(run, "leader long, key long")


def components(links: DataFrame) -> DataFrame:
    """``key, component`` (the smallest key reachable) for each key of the links (``leader, key``)."""

    def smallest(sides: DataFrame) -> DataFrame:
        # the small side is dealt anew, so that the join exchanges both sides by itself and a hub's edges can be split at run time
        return sides.join(sides.groupBy("a").agg(F.min("b").alias("m")).repartition("a", "m"), "a")

    edges = saved(links.select(F.greatest("leader", "key").alias("a"), F.least("leader", "key").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        large = smallest(both).select("a", "b", F.least("a", "m").alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        near = smallest(large)
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = saved(small)
        with released(edges.sparkSession):
            state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if state == before:
            return edges.select(F.col("a").alias("key"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct())
        before = state


class SignatureTree:
    """Sets of one block under nodes of OR-combined bitmaps and size ranges.

    Level 0 has the sets, in order of size; each level above has a node for every
    ``LEAF`` sets, then for every ``FAN`` nodes. ``spare`` is the largest number of elements
    of a set beyond its bits, ``one``: the node's component, or the smallest value if it has several.
    """

    MANY = -(2**63)

    def __init__(self, key: np.ndarray, component: np.ndarray, n: np.ndarray, bits: np.ndarray):
        order = np.argsort(n, kind="stable")
        self.key, self.component, self.n, self.bits = key[order], component[order], n[order], bits[order]
        self.pop = np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.levels: list[tuple[np.ndarray, ...]] = []
        low, high, bits, spare = self.n, self.n, self.bits, self.n - self.pop
        one, fan = self.component, LEAF
        while True:
            cut = np.arange(0, len(low), fan)
            same = np.minimum.reduceat(one, cut) == np.maximum.reduceat(one, cut)
            one = np.where(same, one[cut], self.MANY)
            low, high, spare = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(spare, cut)
            bits = np.bitwise_or.reduceat(bits, cut, axis=0)
            self.levels.append((low, high, bits, spare, one))
            if len(low) == 1:
                return
            fan = FAN

    def pairs(self, other: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of pairs, one of each tree, that may link and are of two components."""
        top_a, top_b = len(self.levels) - 1, len(other.levels) - 1
        stack = [(top_a, np.array([0]), top_b, np.array([0]))]
        while stack:
            la, a, lb, b = stack.pop()
            (low_a, high_a, bits_a, spare_a, one_a), (low_b, high_b, bits_b, spare_b, one_b) = self.levels[la], other.levels[lb]
            may = (100 * high_a[a] >= percent * low_b[b]) & (100 * high_b[b] >= percent * low_a[a])
            may &= ~((one_a[a] == one_b[b]) & (one_a[a] != self.MANY))
            if self is other and la == lb:
                may &= a <= b
            a, b = a[may], b[may]
            overlap = np.bitwise_count(bits_a[a] & bits_b[b]).sum(1).astype(np.int64) + np.minimum(spare_a[a], spare_b[b])
            may = overlap >= _least_overlap(low_a[a] + low_b[b], percent)
            a, b = a[may], b[may]
            if not len(a):
                continue
            if la == lb == 0:
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    yield from self._leaves(other, x, y, percent)
                continue
            down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
            kids = lambda tree, level, x: (x[:, None] * FAN + np.arange(FAN), len(tree.levels[level - 1][0]))
            for s in range(0, len(a), 64):
                x, y = a[s : s + 64, None], b[s : s + 64, None]
                ok = np.ones((len(x), 1, 1), bool)
                if down_a:
                    x, most = kids(self, la, x[:, 0])
                    ok = ok & (x < most)[:, :, None]
                if down_b:
                    y, most = kids(other, lb, y[:, 0])
                    ok = ok & (y < most)[:, None, :]
                shape = np.broadcast_shapes(ok.shape, (len(x), x.shape[1], y.shape[1]))
                ok = np.broadcast_to(ok, shape)
                stack.append((la - down_a, np.broadcast_to(x[:, :, None], shape)[ok], lb - down_b, np.broadcast_to(y[:, None, :], shape)[ok]))

    def _leaves(self, other: SignatureTree, x: int, y: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = np.arange(x * LEAF, min(len(self.n), (x + 1) * LEAF)), np.arange(y * LEAF, min(len(other.n), (y + 1) * LEAF))
        na, nb = self.n[a][:, None], other.n[b][None]
        may = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (self.component[a][:, None] != other.component[b][None])
        if self is other and x == y:
            may &= a[:, None] < b[None]
        i, j = np.nonzero(may)
        if len(i):
            a, b = a[i], b[j]
            both = np.bitwise_count(self.bits[a] & other.bits[b]).sum(1).astype(np.int64)
            most = np.minimum(self.n[a] - (self.pop[a] - both), other.n[b] - (other.pop[b] - both))
            ok = most >= _least_overlap(self.n[a] + other.n[b], percent)
            if ok.any():
                yield self.key[a[ok]], other.key[b[ok]]


def _bitmaps(bodies: DataFrame, words: int) -> DataFrame:
    """``key, bits``: each set's elements hashed into ``BITMAP_BITS`` bits."""

    def start():
        plain = zstandard.ZstdDecompressor()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                hashes, bound = shingle_sets([plain.decompress(x) for x in part.column("body").to_pylist()], words)
                out = []
                for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                    flags = np.zeros(BITMAP_BITS, np.uint8)
                    flags[hashes[a:b] & np.uint64(BITMAP_BITS - 1)] = 1
                    out.append(np.packbits(flags).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.binary())], ["key", "bits"])

        return step

    return bodies.mapInArrow(over_batches(start), "key long, bits binary")


def size_bounds(percent: int) -> list[int]:
    """First sizes of classes so wide that two sets whose classes are not the same or neighbours cannot link."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // min(percent, 75) + 1)
    return out


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """``token, i, j, block, key, n, component``: each row once for each pair of blocks ``(i, j)`` that its own ``block`` is in.

    A group of up to ``GROUP_ROWS`` rows is one block. The rows of a larger one are dealt by class of size, and within a class
    a component of more than ``GROUP_ROWS`` rows has blocks to itself. Blocks of one component, or of sizes too far
    apart, are never paired, so that a large component beside few other rows costs as much as its rows.
    """
    # saved tables: each join has plain exchanges on both sides, so that a large group's rows can be split at run time
    large = saved(rows.groupBy("token").agg(F.count("*").alias("rows")).where(F.col("rows") > GROUP_ROWS).select("token"))
    zero, columns = F.lit(0).cast("long"), ["token", "i", "j", "block", "key", "n", "component"]
    if large.isEmpty():
        return rows.select("token", zero.alias("i"), zero.alias("j"), zero.alias("block"), "key", "n", "component")
    few = rows.join(large, "token", "left_anti").select("token", zero.alias("i"), zero.alias("j"), zero.alias("block"), "key", "n", "component")
    bounds = F.array(*(F.lit(x).cast("long") for x in size_bounds(percent)))
    many = rows.join(large, "token", "left_semi").withColumn("class", F.size(F.filter(bounds, lambda x: x <= F.col("n"))))
    cells = saved(many.groupBy("token", "class", "component").agg(F.count("*").alias("rows")))
    # a component with rows enough has a unit of its own (``home``), the others of a class are one unit
    apart = F.col("rows") > GROUP_ROWS
    homes = saved(cells.where(apart).select("token", "class", "component", F.lit(True).alias("own")))
    units = cells.groupBy("token", "class", apart.alias("own"), F.when(apart, F.col("component")).otherwise(zero).alias("home")).agg(F.sum("rows").alias("rows"))
    units = units.withColumn("blocks", F.ceil(F.col("rows") / GROUP_ROWS).cast("long"))
    before = Window.partitionBy("token").orderBy("class", "own", "home").rowsBetween(Window.unboundedPreceding, -1)  # a row for each unit
    units = saved(units.select("token", "class", "own", "home", "blocks", F.coalesce(F.sum("blocks").over(before), zero).alias("start")))
    other = units.select("token", *(F.col(c).alias(f"{c}_2") for c in ("class", "own", "home", "blocks", "start")))
    met = (F.abs(F.col("class") - F.col("class_2")) <= 1) & ~(F.col("own") & F.col("own_2") & (F.col("home") == F.col("home_2")))
    partners = saved(units.join(other, "token").where(met).select("token", "class", "own", "home", "blocks", "start", "blocks_2", "start_2"))
    many = many.join(homes, ["token", "class", "component"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    many = many.withColumn("home", F.when(F.col("own"), F.col("component")).otherwise(zero)).join(partners, ["token", "class", "own", "home"])
    many = many.withColumn("block", F.col("start") + F.pmod(F.xxhash64("key"), F.col("blocks")))
    many = many.withColumn("with", F.explode(F.sequence(F.col("start_2"), F.col("start_2") + F.col("blocks_2") - 1)))
    many = many.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    return few.select(columns).unionByName(many.select(columns))


def _tree_pairs(rows: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """``leader, key`` of pairs from the groups (``token, key, n, component``) that pass the signature trees."""
    dealt = _in_blocks(rows, percent)
    met = dealt.join(bitmaps, "key").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        at = None
        sent: set[tuple[int, int]] = set()

        def compare() -> pa.RecordBatch | None:
            block, key, n, component, bits = (np.concatenate(c) for c in zip(*held, strict=True))
            own, out = block == at[1], []
            tree = SignatureTree(key[own], component[own], n[own], bits[own]) if own.any() else None
            other = tree if at[1] == at[2] else SignatureTree(key[~own], component[~own], n[~own], bits[~own]) if (~own).any() else None
            if tree and other:
                for a, b in tree.pairs(other, percent):
                    out += zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)
            if len(sent) > 200_000:
                sent.clear()
            new = set(out) - sent
            sent.update(new)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*new, strict=True)], ["leader", "key"]) if new else None

        for batch in batches:
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("token", "i", "j")], 1)
            cut = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(group)]
            block, key, n, component = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "key", "n", "component"))
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(key), -1)
            for a, b in zip(cut, cut[1:], strict=False):
                if at is not None and tuple(group[a]) != at:
                    if (out := compare()) is not None:
                        yield out
                    held = []
                at = tuple(group[a].tolist())
                held.append([x[a:b] for x in (block, key, n, component, bits)])
        if held and (out := compare()) is not None:
            yield out

    return met.mapInArrow(run, "leader long, key long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest doc_id reachable by links, its own without any. Texts that are
    null or without words have no shingles and no links; with fewer than ``words``
    words the whole sequence is the only shingle. Long texts count whole. Repeated rows
    have equal sets and so one component; an empty table gives no rows.
    """
    survey = saved(_survey(docs, words))
    rows = survey.where("slice is null").select("doc_id", "n", "digest", "key")
    classes, clashes = _classes(survey), _key_clashes(rows)
    met = _prefixes(docs, words, percent, classes, clashes)
    ends = {"low": F.col("key"), "high": F.col("key"), "size": F.lit(1).cast("long")}
    met = saved(over_parts(met, ends).where("low <> high or parts > 1").select("token", "key", "n", "parts", "size"))
    split = not met.where("parts > 1").isEmpty()
    columns = ["token", "key", "n", *(["parts"] if split else [])]

    def shared(rows: DataFrame) -> DataFrame:
        return saved(over_tokens(rows.select(columns), ends, split).where("low <> high").select(*columns, "size"))

    met = shared(met) if split else met
    need = F.greatest(F.lit(1), F.expr(f"cast(ceil({percent} * n / 100.0) as long) div {SHARED}"))
    for _ in range(2):
        # a partner has at least percent % of n shingles, and so shares as many as such a prefix is longer
        enough = met.groupBy("key", "n").agg(F.countDistinct("token").alias("tokens")).where(F.col("tokens") >= need).select("key")
        met = shared(met.join(enough, "key", "left_semi"))

    score = met.groupBy("key").agg(F.sum("size").alias("score"))
    ranked = over_tokens(met.join(score, "key"), {"lead": F.struct("score", "key", "n")}, split)
    fits = "key <> lead.key and 100 * least(n, lead.n) >= {0} * greatest(n, lead.n)".format(percent)
    often = ranked.where(fits).groupBy("key", F.col("lead.key").alias("leader")).agg(F.count("*").alias("times"))
    first = saved(often.groupBy("key").agg(F.max(F.struct("times", "leader")).alias("x")).select("key", F.col("x.leader").alias("leader")))
    bodies = saved(_bodies(docs, words, met.select("key").distinct(), clashes))
    links = saved(_linked(bodies, first, words, percent))

    joined = components(links)
    named = met.select(columns).distinct().join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = over_tokens(named, {"low": F.col("component"), "high": F.col("component")}, split).where("low <> high").select("token", "key", "n", "component")
    pairs = _tree_pairs(saved(named), _bitmaps(bodies, words), percent)
    links = links.unionByName(_linked(bodies, saved(pairs), words, percent))

    if clashes:
        spark = docs.sparkSession
        own = spark.createDataFrame([(bytearray(k), v) for k, v in clashes.items()], "digest binary, own long")
        rows = rows.join(F.broadcast(own), "digest", "left").withColumn("key", F.coalesce("own", "key"))
    keyed = rows.join(components(links), "key", "left").withColumn("component", F.coalesce("component", "key")).where("n > 0")
    least = keyed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1")
    # saved, so that the join has a plain exchange on both sides and a large component's rows can be split at run time
    out = keyed.join(saved(least.select("component", "component_id")), "component", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
