"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Weights are not positive: a feature can only speak against a text, so that much ordinary text
does not outweigh a few bad words. A text's features are its distinct lower-case words and marks, the 4-grams of characters
inside longer words (bad words may come with ever other endings) and a few coarse shape
features, hashed into a fixed number of buckets. One weight vector is shared by all
grades; ordered thresholds ``t_1 < t_2 < ...`` give ``P(grade >= j) = 1 / (1 + exp(t_j - w x))``,
from which the expected grade and the tail probability used for selection follow.
The fit sees at most ``sample_rows`` rated rows; scoring sees every text whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, text_list

BITS = 20
#: Only buckets that occur in so many rated texts, and whose share of texts below some grade is higher than that of
#: all by so many standard errors (by the likelihood ratio), get a weight; the others would only fit chance.
LEAST_TEXTS, LEAST_ERRORS = 4, 4.0
#: Words from so many characters on count with their 4-grams too.
LONG_WORD = 6
#: Rated texts whose features are counted at once.
COUNT_ROWS = 1_000
_PIECES = re.compile(r"\w+|[^\w\s]+")


def gram_buckets(words: list[str]) -> np.ndarray:
    """The hashed 4-grams of characters inside the words."""
    c = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    a, b, d, e = c[:-3], c[1:-2], c[2:-1], c[3:]
    inside = (a != 32) & (b != 32) & (d != 32) & (e != 32)
    # 16 bits of each are enough to tell letters apart; multiplied, the top bits depend on all
    mixed = ((a << np.uint64(48)) ^ (b << np.uint64(32)) ^ (d << np.uint64(16)) ^ e) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed[inside] >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """The distinct hashed features of a text; none if it has no word."""
    pieces = _PIECES.findall(text)
    if not pieces:
        return np.zeros(0, np.int64)
    words = [p for p in pieces if p[0].isalnum()]
    lines = text.split("\n")
    share = lambda part, whole: int(10 * part / max(whole, 1))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    shape = (
        f" upper {share(upper, len(words))}", f" marks {share(len(pieces) - len(words), len(pieces))}", f" distinct {share(len(set(words)), len(words))}",
        f" lines {share(len(set(lines)), len(lines))}", f" size {len(words).bit_length()}",
    )
    own = {p.lower() for p in pieces}
    grams = gram_buckets([p for p in own if len(p) >= LONG_WORD and p[0].isalnum()])
    own |= set(shape)
    return np.unique(np.concatenate((np.fromiter((zlib.crc32(p.encode("utf-8", "surrogatepass")) >> 32 - BITS for p in own), np.int64, len(own)), grams)))


def telling(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> np.ndarray:
    """The buckets that get a weight."""
    seen, below = np.zeros(1 << BITS), np.zeros((n_grades - 1, 1 << BITS))
    for a in range(0, len(rows), COUNT_ROWS):
        part, own = rows[a : a + COUNT_ROWS], grades[a : a + COUNT_ROWS]
        seen += np.bincount(np.concatenate(part), minlength=1 << BITS)
        for j in range(1, n_grades):
            low = [r for r, g in zip(part, own.tolist(), strict=True) if g < j]
            below[j - 1] += np.bincount(np.concatenate([*low, np.zeros(0, np.int64)]), minlength=1 << BITS)
    some = np.flatnonzero(seen >= min(LEAST_TEXTS, max(1, len(rows) // 4)))
    n, apart = seen[some], np.zeros(len(some), bool)
    for j in range(1, n_grades):
        share = (grades < j).mean() if len(grades) else 0
        if 0 < share < 1:
            k = below[j - 1, some]
            ratio = 2 * (k * np.log(np.maximum(k, 1e-9) / (n * share)) + (n - k) * np.log(np.maximum(n - k, 1e-9) / (n * (1 - share))))
            apart |= (k > n * share) & (ratio >= LEAST_ERRORS**2)
    return some[apart]


@dataclass
class Ordinal:
    """Weights by bucket and the ordered thresholds of grades 1, 2, ..."""

    weights: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 300, penalty: float = 2e-4) -> Ordinal:
        """Maximum likelihood with a squared penalty, by Adam over all rows. Thresholds stay
        ordered because the steps between them are exponentials."""
        used = telling(rows, grades, n_grades)
        place = np.full(1 << BITS, -1, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        some_rows, some_cols = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for a in range(0, len(rows), COUNT_ROWS):  # few large arrays instead of one a row
            part = rows[a : a + COUNT_ROWS]
            col = place[np.concatenate(part)]
            row = np.repeat(np.arange(a, a + len(part), dtype=np.int32), np.fromiter(map(len, part), np.int64, len(part)))
            some_rows.append(row[col >= 0]), some_cols.append(col[col >= 0])
        row, col = np.concatenate(some_rows), np.concatenate(some_cols)
        k = n_grades - 1
        share = np.clip([(grades >= j).mean() if len(grades) else 0.5 for j in range(1, k + 1)], 1e-3, 1 - 1e-3)
        cut = -np.log(share / (1 - share))
        steps = np.log(np.maximum(np.diff(cut), 1e-2))
        x = np.concatenate((np.zeros(len(used)), cut[:1], steps))
        mean, square = np.zeros_like(x), np.zeros_like(x)
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        for t in range(1, rounds + 1):
            cut = x[len(used)] + np.concatenate(([0], np.cumsum(np.exp(x[len(used) + 1 :]))))
            score = np.bincount(row, weights=x[: len(used)][col], minlength=len(rows))
            # P(grade >= j), with 1 before and 0 after; of each row the ones around its grade
            tail = np.concatenate((np.ones((len(rows), 1)), sig(score[:, None] - cut), np.zeros((len(rows), 1))), 1)
            i = np.arange(len(rows))
            above, below = tail[i, grades], tail[i, grades + 1]
            p = np.maximum(above - below, 1e-9)
            d_above, d_below = above * (1 - above) / p, below * (1 - below) / p
            n = max(len(rows), 1)
            g_score = -(d_above - d_below) / n
            g_cut = np.array([(d_above[grades == j].sum() - d_below[grades == j - 1].sum()) / n for j in range(1, k + 1)])
            g = np.concatenate((np.bincount(col, weights=g_score[row], minlength=len(used)) + penalty * x[: len(used)] / 10, [g_cut.sum()], [g_cut[j:].sum() * np.exp(x[len(used) + j]) for j in range(1, k)]))
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            x = x - 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
            x[: len(used)] = np.minimum(x[: len(used)], 0)
        weights = np.zeros(1 << BITS, np.float32)
        weights[used] = x[: len(used)]
        return cls(weights, x[len(used)] + np.concatenate(([0], np.cumsum(np.exp(x[len(used) + 1 :])))))

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """``P(grade >= j)`` for each row and grade 1, 2, ...; 0 for a row without features."""
        score = np.array([self.weights[r].sum(dtype=np.float64) for r in rows])
        some = np.array([len(r) > 0 for r in rows])
        return np.where(some[:, None], 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -40, 40))), 0.0)


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 for low quality, 1 for toxic, 2 for neither; of several ratings the
    lowest, rows without quality left out (null toxicity counts as none)."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample_rows: int = 16_000) -> Ordinal | None:
    """Fits on the rows of ``docs`` that ``ratings`` (``doc_id, grade``) grade, of these on the
    ``sample_rows`` ratings of smallest hash; None if there are none. Of rows that repeat a doc_id the smallest text counts once; a null
    text counts as empty."""
    sample = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rated = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lists = [features(t).tolist() for t in text_list(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(lists, pa.list_(pa.int32()))], ["grade", "features"])

        return step

    got = rated.mapInArrow(over_batches(start), "grade int, features array<int>").toArrow()
    if not got.num_rows:
        return None
    lists = got.column("features").combine_chunks()
    flat, bound = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    rows = [flat[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
    grades = got.column("grade").to_numpy().astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: (grades[i], xxhash.xxh3_128_digest(rows[i])))  # the same for any order of rows
    return Ordinal.fit([rows[i] for i in order], grades[order], n_grades)


def score(docs: DataFrame, model: Ordinal | None, min_tail: float = 0.8) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, keep`` for each row: the probability of the top grade, kept
    from ``min_tail`` on. A text without words has grade 0 and is not kept; without
    a model the figures are null and every row is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def start():
        m = shared.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n = batch.num_rows
            if m is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([True] * n)], ["doc_id", "expected_grade", "tail_probability", "keep"])
                return
            tails = m.tails([features(t) for t in text_list(batch)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= min_tail)], ["doc_id", "expected_grade", "tail_probability", "keep"]
            )

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(over_batches(start), f"doc_id {kind}, expected_grade double, tail_probability double, keep boolean")


def selected(docs: DataFrame, model: Ordinal | None, min_tail: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps, with all columns and without a join: no text without words (null, empty), repeated rows alike,
    all without a model; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield batch if m is None else batch.filter(pa.array(m.tails([features(t) for t in text_list(batch)])[:, -1] >= min_tail))

        return step

    return docs.mapInArrow(over_batches(start), docs.schema)
