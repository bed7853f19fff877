"""Hard negatives by exact integer inner products.

Components are integers. A residue-number system carries each product: the component matrices modulo several small primes,
centred around 0, are multiplied in float32 (every sum of ``INNER`` terms stays below 2**24, so it is exact), and
the scores are put together from the residues by Chinese remaindering with mixed radix digits. The number of primes
follows from the largest squared norm, which bounds every score.

Anchors are packed into blocks; each task holds one block and streams its share of all rows past it, twice: for the best
positives of each anchor, then for the best negatives in the window below each positive. What a task gives is bounded
by its anchors, and window functions choose among the tasks' results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Largest primes p with INNER * ((p - 1) / 2) ** 2 < 2 ** 24; eight of them hold any product of 63 bits.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983, 977)
INNER = 64
#: Anchors that one task holds, and rows and anchors multiplied at once.
ANCHOR_BLOCK, TILE_ROWS, TILE_ANCHORS = 8_192, 4_096, 512
#: Parts of the rows, each of which meets each block in a task of its own. What tasks give grows with it, so it depends on nothing else.
PARTS = 32
#: Squared norms from here on leave the range of a score.
NORM_LIMIT = 2.0**62


def primes_for(bound: float) -> tuple[int, ...]:
    """The fewest primes whose product exceeds twice ``bound``."""
    product = 1
    for k, p in enumerate(PRIMES):
        product *= p
        if product > 2 * bound + 1:
            return PRIMES[: k + 1]
    raise ValueError("scores do not fit 63 bits")


def residues(x: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """The integers modulo each prime as float32, from -(p - 1) / 2 to (p - 1) / 2."""
    out = []
    for p in primes:
        r = x % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def products(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products (int64) of all rows of ``a`` and ``b``, given as residues."""
    digits: list[np.ndarray] = []
    for k, (x, y, p) in enumerate(zip(a, b, primes, strict=True)):
        r = np.zeros((len(x), len(y)), np.int32)
        for at in range(0, x.shape[1], INNER):
            r = _mod(r + (x[:, at : at + INNER] @ y[:, at : at + INNER].T).astype(np.int32), p)
        # mixed radix: score = d0 + d1 p0 + d2 p0 p1 + ...
        for d, q in zip(digits, primes[:k], strict=True):
            r = _mod(_mod(r - d, p) * np.int32(pow(q, -1, p)), p)
        digits.append(r)
    # M is the product of the primes; scores above (M - 1) / 2 stand for negative ones. Sums wrap modulo 2**64, as they should
    total, weight, half = np.zeros(digits[0].shape, np.int64), 1, int(np.prod([int(p) for p in primes], dtype=object)) // 2
    above, decided = np.zeros(total.shape, bool), np.zeros(total.shape, bool)
    half_digits, rest = [], half
    for p in primes:
        half_digits.append(rest % p)
        rest //= p
    with np.errstate(over="ignore"):
        for d, p in zip(digits, primes, strict=True):
            total += d.astype(np.int64) * np.int64(_wrapped(weight))
            weight *= p
        for d, h in zip(digits[::-1], half_digits[::-1], strict=True):
            above |= ~decided & (d > h)
            decided |= d != h
        total[above] -= np.int64(_wrapped(weight))
    return total


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    return x - x // np.int32(p) * np.int32(p)


def _wrapped(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def prepared(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, dim, vector`` (integers) of the rows that take part: label, vec_id and vector not null, all components
    finite, squared norm of the integers below 2**62. Rows that agree in all of these count once."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    norm = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)))
    good = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("norm", norm).where(F.col("norm") < NORM_LIMIT)
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "norm", integers(F.col("embedding"), scale).alias("vector"))
    return good.dropDuplicates(["vec_id", "label", "vector"]).withColumn("dim", F.size("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


PACKED = "dim int, block int, number array<long>, anchor_id array<long>, anchor_label array<long>, lows array<long>, highs array<long>, vectors binary"


def _pack(table: pa.Table) -> pa.Table:
    """One row for a block of anchors."""
    table = table.sort_by("number").combine_chunks()
    dim = table.column("dim")[0].as_py()
    one = {c: pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("number", "anchor_id", "anchor_label")}
    for c in ("lows", "highs"):
        one[c] = pa.array([[x for row in table.column(c).to_pylist() for x in row]], pa.list_(pa.int64()))
    flat = np.array(table.column("vector").to_pylist(), np.int64).reshape(len(table), dim)
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1), **one, "vectors": pa.array([flat.tobytes()], pa.binary())})


def _first(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the ``k`` largest allowed scores of each row, of equal ones the first columns; where few are allowed, of all."""
    many = ok.sum(1)
    if many.sum() > 8 * k * len(ok) and score.shape[1] > k:
        some = np.flatnonzero(many > k)
        fit, score = ok[some], score[some]
        score = np.where(fit, score, np.iinfo(np.int64).min)
        edge = np.partition(score, -k, axis=1)[:, -k][:, None]
        over, level = score > edge, fit & (score == edge)
        ok = ok.copy()
        ok[some] = over | (level & (np.cumsum(level, 1) <= k - over.sum(1)[:, None]))
    return np.nonzero(ok)


def _scan(k: int, positive: bool, primes: tuple[int, ...], windows: int):
    """Streams rows past a block of anchors: the ``k`` best of the anchor's label, or of the others in each of its windows."""

    def best(out: list[tuple]) -> None:
        """Cuts the results so far to ``k`` for each anchor and window."""
        if not out:
            return
        number, window, vec_id, score = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((vec_id, -score, window, number))
        number, window, vec_id, score = number[order], window[order], vec_id[order], score[order]
        first = np.concatenate(([True], (number[1:] != number[:-1]) | (window[1:] != window[:-1])))
        rank = np.arange(len(number)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = rank < k
        out[:] = [(number[keep], window[keep], vec_id[keep], score[keep])]

    def given(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        best(out)
        for number, window, vec_id, score in out:
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(window.astype(np.int32)), pa.array(vec_id), pa.array(score)], ["number", "window", "vec_id", "score"])
        out.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        out: list[tuple] = []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("dim", "block", "part", "kind")], 1)
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True]))).tolist()
            for lo, hi in zip(cut, cut[1:], strict=False):
                dim, kind = int(key[lo, 0]), int(key[lo, 3])
                if kind == 0:
                    yield from given(out)
                    r = batch.slice(lo, 1).to_pylist()[0]
                    ints = lambda c, r=r: np.array(r[c], np.int64)
                    vectors = np.frombuffer(r["vectors"], np.int64).reshape(len(r["number"]), dim)
                    held = {"key": tuple(key[lo, :3]), "number": ints("number"), "id": ints("anchor_id"), "label": ints("anchor_label"), "x": residues(vectors, primes)}
                    held |= {c: ints(c).reshape(len(vectors), -1) for c in ("lows", "highs")}
                    continue
                if held.get("key") != tuple(key[lo, :3]):
                    continue  # no anchor has vectors of this length
                for at in range(lo, hi, TILE_ROWS):
                    part = batch.slice(at, min(TILE_ROWS, hi - at))
                    vec_id, label = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                    order = np.argsort(vec_id, kind="stable")
                    vec_id, label = vec_id[order], label[order]
                    y = residues(_matrix(part.column("vector"), dim)[order], primes)
                    for a in range(0, len(held["id"]), TILE_ANCHORS):
                        own = slice(a, a + TILE_ANCHORS)
                        score = products([x[own] for x in held["x"]], y, primes)
                        same = held["label"][own, None] == label[None, :]
                        allowed = same & (held["id"][own, None] != vec_id[None, :]) if positive else ~same
                        for w in range(windows):
                            ok = allowed if positive else allowed & (score >= held["lows"][own, w : w + 1]) & (score <= held["highs"][own, w : w + 1])
                            i, j = _first(score, ok, k)
                            out.append((held["number"][own][i], np.full(len(i), w), vec_id[j], score[i, j]))
                    if sum(len(x[0]) for x in out) > 100_000 + 4 * k * windows * len(held["id"]):
                        best(out)
        yield from given(out)

    return run


def _searched(rows: DataFrame, anchors: DataFrame, k: int, windows: int, blocks: int, primes: tuple[int, ...], positive: bool) -> DataFrame:
    """``number, window, vec_id, score``: up to ``k`` for each anchor, window and task."""
    packed = saved(anchors.groupBy("dim", "block").applyInArrow(_pack, PACKED))
    held = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("kind", F.lit(0))
    sent = rows.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id", "label"), F.lit(PARTS)).cast("int").alias("part"), F.lit(1).alias("kind"),
        "vec_id", "label", "vector",
    )
    key = ["dim", "block", "part"]
    met = held.unionByName(sent, allowMissingColumns=True)
    met = met.repartition(PARTS * blocks, *key).sortWithinPartitions(*key, "kind")
    return met.mapInArrow(_scan(k, positive, primes, windows), "number long, window int, vec_id long, score long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` rows of largest score for each key, with ``rank``; of equal scores the smaller vec_id."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, embedding, label``.

    For each anchor (a row where ``is_anchor``) its ``positives`` best other rows of the same label, and for each of them the ``negatives``
    best rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's. Scores are exact inner products of
    ``floor(scale * x)``; higher ones come first, ties by smaller vec_id.

    Takes part what :func:`prepared` lets in; vectors of another length than the anchor's do not. Rows that repeat vec_id, label
    and vector count once; a vec_id with several labels or vectors is several rows, none of which is a positive of another, and a
    positive or negative that several of them give is listed for each. An empty table gives no rows. Other columns play no part.
    """
    given = rows.select("vec_id", "embedding", "label")
    points = saved(prepared(given, scale))
    primes = primes_for(points.agg(F.max("norm")).first()[0] or 0.0)
    points = points.drop("norm")
    anchors = points.where(is_anchor).withColumn("number", F.monotonically_increasing_id())
    many = anchors.groupBy("dim").count().collect()  # a row for each vector length of the anchors
    if not many:
        return rows.sparkSession.createDataFrame([], RESULT)
    blocks = max(1, -(-max(r["count"] for r in many) // ANCHOR_BLOCK))
    none = F.array().cast("array<long>")
    anchors = saved(
        anchors.select("dim", F.pmod(F.xxhash64("vec_id", "number"), F.lit(blocks)).cast("int").alias("block"), "number", F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), "vector")
    )
    near = _searched(points, anchors.withColumn("lows", none).withColumn("highs", none), positives, 1, blocks, primes, True)
    near = saved(_ranked(near, ["number"], positives).select("number", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low * positive <= 100 * negative <= high * positive; a window without positive holds nothing
    bound = near.select(
        "number", "window", F.expr(f"cast(ceil(cast(positive_score as decimal(38,0)) * {low} / 100) as long)").alias("low"),
        F.expr(f"cast(floor(cast(positive_score as decimal(38,0)) * {high} / 100) as long)").alias("high"),
    )
    at = lambda c, w, empty: F.coalesce(F.max(F.when(F.col("window") == w, F.col(c))), F.lit(empty))
    bounds = bound.groupBy("number").agg(
        F.array(*[at("low", w, 1) for w in range(positives)]).alias("lows"), F.array(*[at("high", w, 0) for w in range(positives)]).alias("highs")
    )
    empty_low, empty_high = F.array_repeat(F.lit(1).cast("long"), positives), F.array_repeat(F.lit(0).cast("long"), positives)
    with_bounds = anchors.join(bounds, "number", "left").withColumn("lows", F.coalesce("lows", empty_low)).withColumn("highs", F.coalesce("highs", empty_high))
    hard = _ranked(_searched(points, with_bounds, negatives, positives, blocks, primes, False), ["number", "window"], negatives)
    named = near.join(anchors.select("number", "anchor_id"), "number")
    return named.join(hard, ["number", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
