"""Repeated rows, equal texts in shards, vectors of doubles, guards, and the quality fit against an independent one."""

import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tidemark.llm import ann, bpe, bpe_codec, langid, packing, quality, sharding, token_counts, token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(1, "the cat sat on the mat and the dog", "en"), (1, "the cat sat on the mat and the dog", "en"), (1, "another text of the same id", "en"), (2, None, "en"), (2, None, "en"), (3, "", "de"), (3, "", "de"), (None, "no id here", "en"),
        (4, "der Hund und die Katze " * 400, "de"), (4, "der Hund und die Katze " * 400, "de")]


@pytest.fixture(scope="module")
def repeated(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.withColumns({"ids": F.lit(1), "length": F.lit("x"), "part": F.lit(0), "n_tokens": F.lit(5)}).repartition(3)


def texts():
    return [t or "" for _, t, _ in ROWS]


def test_repeated_rows_keep_their_own_results(spark, repeated):
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    ids = [word.encode(t, add_special_tokens=False).ids for t in texts()]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe_codec.round_trip_digests(repeated, WORD).collect())
    assert got == Counter((d, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for (d, _, _), x in zip(ROWS, ids, strict=True))
    counts = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(repeated, BYTE).collect())
    assert counts == Counter((d, len(t.encode()), len(byte.encode(t, add_special_tokens=False).ids)) for (d, _, _), t in zip(ROWS, texts(), strict=True))
    languages, matrix = langid.train(repeated)
    found = langid.predict(repeated, languages, matrix).collect()
    assert len(found) == len(ROWS) and len({(r.doc_id, r.lang_pred) for r in found if r.doc_id == 4}) == 1
    score = quality.score(repeated, None).collect()
    assert len(score) == len(ROWS) and all(r.keep for r in score)


def test_repeated_ids_count_once_in_the_quality_fit(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} common text", "x") for i in range(60)], "doc_id long, text string, grade string")
    many = docs.unionByName(docs).unionByName(docs.where("doc_id < 5").withColumn("text", F.lit("zzz later")))
    ratings = spark.createDataFrame([(i, 0 if i % 3 == 0 else 2) for i in range(60)], "doc_id long, grade int")
    a, b = quality.fit(docs, ratings), quality.fit(many, ratings)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


def test_repeated_rows_in_token_files_and_sequences(spark, repeated):
    known = repeated.where("doc_id is not null")
    rows = [(d, t or "") for d, t, _ in ROWS if d is not None]
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    back = token_files.write_and_read(known, WORD, end_id=1).collect()
    want = Counter()
    for d, t in rows:
        ids = word.encode(t, add_special_tokens=False).ids + [1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in back) == want
    spans = sorted((r.start, r.n_tokens) for r in back)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    packed = packing.pack_documents(known, BYTE, end_id=0, width=1024).collect()
    assert sum(r.length for r in packed) == sum(len(byte.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for x in by_sequence.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(n for _, n in x) <= 1024


def test_packing_at_its_own_width(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    byte = Tokenizer.from_file(BYTE)
    out = packing.pack_documents(docs, BYTE, end_id=0, width=1024).collect()
    ids = {r.doc_id: byte.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    for r in out:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in out) == sum(map(len, ids.values()))
    full = len({r.sequence_id for r in out}) * 1024
    assert sum(r.length for r in out) > 0.97 * full


def groups(placed):
    out = {}
    for r in placed:
        out.setdefault((r.text_crc32, r.size), []).append(r)
    return [g for g in out.values() if len(g) > 1]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_equal_texts_lie_in_neighbouring_shards(spark, sf):
    rows = entry.queries()["op3_hilbert_shards"](spark, f"/root/testdata/{sf}").collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sizes[shard]))
    found = groups(rows)
    assert found
    for g in found:
        shards = {r.shard for r in g}
        assert max(shards) - min(shards) <= 1 + len(g) // min(sizes.values())


def test_a_hot_text_is_one_run_whatever_its_sources(spark, monkeypatch):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i % 200}", ("en", "de", None)[i % 3], f"source {i % 7}") for i in range(3000)] + [(None, "the same text", "fr", "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"salt": F.lit(1), "run": F.lit("r"), "sub": F.lit(0)}).repartition(5)
    for share in (1000, 2):  # with and without the list of hot texts
        monkeypatch.setattr(sharding, "HOT_SHARE", share)
        out = sharding.hilbert_shards(docs, 24).collect()
        assert len(out) == 3001 and max(Counter(r.shard for r in out).values()) == 126
        for g in groups(out):
            shards = sorted({r.shard for r in g})
            assert shards == list(range(shards[0], shards[-1] + 1)) and len(shards) <= len(g) // 125 + 2
            assert len({r.cell for r in g}) == 1


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 6)) * 1e3
    x = np.concatenate([base, base * (1 + 1e-12)])  # the same as float
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    out, hits = {}, 0
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(out) == {0, 20, 40, 60}
    for q, rows in out.items():
        score = [float((x[q] * x[i]).sum()) for i in range(len(x))]
        found = [(v, s) for _, v, s in sorted(rows)]
        assert len({v for v, _ in found}) == 20 and all(s == pytest.approx(score[v], rel=1e-15) for v, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += len({v for v, _ in found} & set(sorted((i for i in range(len(x)) if i != q), key=lambda i: (-score[i], i))[:20]))
    assert hits >= 0.95 * 80


def test_unsupported_vocabularies_are_refused(tmp_path):
    with open(BYTE, encoding="utf-8") as f:
        file = json.load(f)
    for name, change in (("ids", None), ("byte_fallback", True), ("ignore_merges", True), ("type", "WordPiece")):
        own = json.loads(json.dumps({**file, "model": {**file["model"], "merges": []}}))
        if change is None:
            own["model"]["vocab"]["<far>"] = 65_536
        else:
            own["model"][name] = change
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(own))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(path))


def plain_loss(dense, grades, weights, cuts, penalty):
    """Mean negative log-likelihood of the cumulative-link model with its penalty, row by row."""
    cut = np.concatenate(([-np.inf], cuts, [np.inf]))
    z = dense @ weights
    above, below = (1 / (1 + np.exp(np.clip(cut[grades + k] - z, -700, 700))) for k in (0, 1))
    return -np.log(np.maximum(above - below, 1e-12)).mean() + penalty / 20 * float(weights @ weights)


def test_quality_fit_equals_an_independent_one():
    """The optimum of the same likelihood, weights at most 0, by coordinate search with no code of the operator."""
    rng = np.random.default_rng(6)
    n, penalty = 600, 2e-4
    truth = np.array([-4.0, -3.5, -3.0])
    dense = (rng.random((n, 3)) < 0.15).astype(float)
    z = dense @ truth + rng.logistic(size=n)
    grades = (z > -3.0).astype(int) + (z > -1.5).astype(int)
    buckets = [10, 500, 9000]
    rows = [np.array([b for b, on in zip([*buckets, 77], [*x, 1.0], strict=True) if on], np.int64) for x in dense]
    used = quality.telling(rows, grades, 3)
    assert set(used) <= set(buckets) and len(used) >= 2  # the bucket of every row tells nothing
    mine = quality.Ordinal.fit(rows, grades, 3, penalty=penalty)
    some = [buckets.index(b) for b in used.tolist()]
    dense = dense[:, some]
    x = np.concatenate((np.zeros(len(some)), [-1.0, 0.0]))

    def loss(x):
        return plain_loss(dense, grades, x[: len(some)], x[len(some) :], penalty) if x[-2] < x[-1] else np.inf

    best, step = loss(x), 0.5
    while step > 1e-4:
        better = False
        for i in range(len(x)):
            for d in (step, -step):
                y = x.copy()
                y[i] += d
                if i < len(some):
                    y[i] = min(y[i], 0)
                if (v := loss(y)) < best - 1e-12:
                    x, best, better = y, v, True
        step = step if better else step / 2
    own = np.concatenate((mine.weights[used].astype(float), mine.thresholds))
    assert loss(own) <= best + 1e-4
    assert own == pytest.approx(x, abs=0.05)
    tails = mine.tails(rows)
    assert tails == pytest.approx(1 / (1 + np.exp(own[len(some) :] - (dense @ own[: len(some)])[:, None])), abs=1e-6)


def test_quality_and_packing_stages_of_odd_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    empty = docs.limit(0)
    assert pipeline.quality_filter(spark, empty, "/root/testdata/sf0.001").count() == 0 and pipeline.pack(spark, empty, "").count() == 0
    odd = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (900_003, "...", None, None, 3)], docs.schema)
    kept = pipeline.quality_filter(spark, docs.unionByName(odd), "/root/testdata/sf0.001").where("doc_id >= 900000").collect()
    assert not {r.doc_id for r in kept} & {900_001, 900_002}  # texts without words go
    packed = pipeline.pack(spark, odd.unionByName(odd), "").collect()
    assert Counter(r.doc_id for r in packed) == {900_001: 2, 900_002: 2, 900_003: 2}
    assert {r.length for r in packed if r.doc_id in (900_001, 900_002)} == {1}
