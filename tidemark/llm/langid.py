"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters and marks are folded to lower case, everything else to a single space (a text whose
only such characters are marks has no letter); the n-grams of 1 to 3 characters are hashed into a fixed number of buckets. Training counts
buckets on at most ``sample_per_language`` rows of each language; the log-probability
matrix (buckets x languages, a fixed size for each language, of bounded number) goes to the tasks with the
function, which add the matrix rows of each document's n-grams in numpy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, over_batches, text_list

BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
SAMPLE_PARTS = 16
#: The matrix has 256 KB for each language; with more than these (256 MB) training stops with an error.
MOST_LANGUAGES = 1_024


@lru_cache(maxsize=1)
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its folded form (the lower-case letter or mark, else a space), and whether it is a letter."""
    out, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        kind = unicodedata.category(c := chr(i))[0]
        if kind in "LM":
            out[i], letter[i] = ord(c.lower()[0]), kind == "L"
    return out, letter


def ngram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram at each place of the folded texts (one
    after another, a space around each), where each text begins, and whether it has a letter."""
    raw = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    fold, is_letter = _folds()
    folded = fold[raw]
    first = np.zeros(len(raw), bool)
    begin = np.cumsum(size) - size
    letters = np.logical_or.reduceat(is_letter[raw], begin)
    first[begin] = True
    keep = (folded != 32) | first
    keep[1:] |= folded[:-1] != 32
    place = np.cumsum(keep) - keep
    chars, begin = folded[keep], place[begin]
    out, key = [], np.zeros(len(chars), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        key[: len(chars) - n + 1] = key[: len(chars) - n + 1] * np.uint32(0x01000193) ^ chars[n - 1 :]
        if n in ORDERS:
            mixed = (key + np.uint32(n)) * np.uint32(0x9E3779B1)
            out.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
    return out, begin, letters


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(labelled: DataFrame, sample_per_language: int = 2_000) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix (float32, buckets x languages).

    ``labelled`` has ``doc_id, text, lang``; rows without language or text are left out. For each
    language the rows of smallest hash of doc_id in each of ``SAMPLE_PARTS`` parts are used, up to
    the bound in all (rows that share a doc_id count together).
    """
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    order = F.xxhash64("doc_id")
    part = F.pmod(order, F.lit(SAMPLE_PARTS)).cast("int")
    ranked = rows.select("lang", part.alias("part"), order.alias("h")).withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h")))
    last = ranked.where(F.col("k") <= max(1, sample_per_language // SAMPLE_PARTS)).groupBy("lang", "part").agg(F.max("h").alias("h")).collect()
    languages = sorted({r["lang"] for r in last})
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a matrix of at most {MOST_LANGUAGES} goes to the tasks")
    if not languages:
        return [], np.zeros((1 << BITS, 0), np.float32)
    upto = F.create_map(*[F.lit(x) for r in last for x in (f"{r['part']} {r['lang']}", r["h"])])
    sample = rows.where(order <= upto[F.concat_ws(" ", part.cast("string"), F.col("lang"))]).repartition(8)

    def start():
        def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in set(langs.tolist()):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = np.zeros(1 << BITS, np.int64)
                for lo, hi in blocks(own):
                    for b in ngram_buckets(own[lo:hi])[0]:
                        total += np.bincount(b, minlength=1 << BITS)
                yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [total.tobytes()]})

        return count

    counts = np.zeros((1 << BITS, len(languages)))
    for r in sample.select("lang", "text").mapInArrow(over_batches(start), "lang string, counts binary").toLocalIterator():
        counts[:, languages.index(r["lang"])] += np.frombuffer(r["counts"], np.int64)
    counts += 0.5
    return languages, np.log(counts / counts.sum(0)).astype(np.float32)


def posteriors(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the place of its best language (the first of equals), that one's posterior probability
    under equal priors, and whether the text has a letter."""
    best, prob, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for lo, hi in blocks(texts):
        grams, begin, letters[lo:hi] = ngram_buckets(texts[lo:hi])
        total = np.zeros((hi - lo, matrix.shape[1]))
        for b in grams:
            for k in range(matrix.shape[1]):
                total[:, k] += np.add.reduceat(matrix[:, k][b], begin, dtype=np.float64)
        if matrix.shape[1]:
            best[lo:hi] = total.argmax(1)
            prob[lo:hi] = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
    return best, prob, letters


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs`` (``doc_id, text``), repeated rows each on their own.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned.
    The score is the posterior probability under equal priors; ties go to the smaller name.
    Long texts count whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(matrix)  # 2**BITS rows by at most MOST_LANGUAGES

    def start():
        def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            best, prob, letters = posteriors(text_list(batch), shared.value)
            known = letters if languages else np.zeros(len(best), bool)
            names = [languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, prob, 0.0))], ["doc_id", "lang_pred", "score"])

        return score

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(over_batches(start), f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with at least ``min_score``; all columns kept.

    The predictor is trained on the labelled rows of ``docs`` that are not held out. Texts that are null or
    have no letter go. If there is no labelled row, nothing is known to reject by and every text with a letter stays.
    Repeated rows are judged alike; an empty table gives no rows. Scoring runs beside the rows themselves, without a join.
    """
    languages, matrix = train(docs.where(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def start():
        def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            _, prob, letters = posteriors(text_list(batch), shared.value)
            yield batch.filter(pa.array(letters & (prob >= min_score) if languages else letters))

        return keep

    return docs.mapInArrow(over_batches(start), docs.schema)
