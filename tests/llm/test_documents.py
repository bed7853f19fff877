import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, fingerprints, jaccard, langid, quality, sharding

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


ODD = [None, "", "   ", "123 !!", "one two three", "One  TWO three", "a b c d e f g", "A B c d e f g", "ÀÉ straße STRASSE ﬁ", "word " * 30_000, "same text here with several words", "same text here with several words"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", i, i, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, part string").repartition(3)


# language id


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, matrix = langid.train(docs.where(~langid.held_out()))
    out = langid.predict(docs, languages, matrix).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_equals_plain_naive_bayes(odd, documents):
    languages, matrix = langid.train(documents)
    for r in langid.predict(odd, languages, matrix).collect():
        text = ODD[r.doc_id] or ""
        if not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = np.zeros(len(languages))
        for b in langid.ngram_buckets([text])[0]:
            for x in b.tolist():
                total += matrix[x].astype(np.float64)
        assert r.lang_pred == languages[int(total.argmax())]


def test_language_of_nothing(odd, none):
    assert {r.lang_pred for r in langid.predict(odd, *langid.train(none)).collect()} == {"und"}
    assert langid.predict(none, *langid.train(none)).count() == 0 and langid.accepted(none).count() == 0


def test_marks_are_no_letters(spark):
    texts = ["\u2764\ufe0f", "123 \u2764\ufe0f!!", "\u0301", "e\u0301", "\u2164", "7a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("one two", "en"), ("un deux", "fr")] * 20)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, *langid.train(docs)).collect()}
    assert [i for i, x in got.items() if x == "und"] == [0, 1, 2, 4]


def test_training_counts(spark):
    """The matrix against counts of plain n-grams."""
    rows = [(1, "Ab a", "x"), (2, "ba! B", "y"), (3, None, "x"), (4, "cc", None)]
    languages, matrix = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == ["x", "y"]
    for k, text in enumerate((" ab a ", " ba b ")):
        grams = [(n, text[i : i + n]) for n in (1, 2, 3) for i in range(len(text))]  # the last ones are cut short
        scale = np.exp(matrix[:, k].astype(np.float64))
        want = sorted((grams.count(g) + 0.5) / (len(grams) + 0.5 * len(scale)) for g in set(grams))
        assert np.isclose(scale.sum(), 1, atol=1e-3) and np.allclose(sorted(scale)[-len(want) :], want, rtol=1e-3)
        assert np.allclose(sorted(scale)[: -len(want)], 0.5 / (len(grams) + 0.5 * len(scale)), rtol=1e-3)


def test_language_stage_without_anything_learned(odd):
    kept = {r.doc_id for r in langid.accepted(odd.withColumn("lang", F.lit(None).cast("string"))).collect()}
    assert kept == {i for i, t in enumerate(ODD) if re.search(r"[^\W\d_]", t or "")}


def test_held_out_rule(documents):
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in documents.select("doc_id", langid.held_out().alias("h")).collect())


# shards


def test_curve_visits_neighbours(spark):
    cells = spark.range(512).select((F.col("id") / 64).cast("int").alias("x"), (F.col("id") / 8 % 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("z"))
    path = sorted(tuple(r) for r in cells.select(sharding.hilbert_index([F.col(c) for c in "xyz"], 3).alias("h"), "x", "y", "z").collect())
    assert [p[0] for p in path] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:], strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_shards_are_even_runs_of_the_curve(name, request):
    df = request.getfixturevalue(name)
    out = sharding.hilbert_shards(df, 5).collect()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    sizes = defaultdict(list)
    for r in out:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        sizes[r.shard].append(r.slot)
    assert len(out) == len(texts) and all(sorted(v) == list(range(len(v))) for v in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    order = [r.cell for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_no_shards(none):
    assert sharding.hilbert_shards(none).count() == 0


def test_shards_are_written(odd, spark, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_shards_of_repeated_rows_and_clashing_names(spark, tmp_path):
    rows = [(i % 5 or None, f"t {i % 5}", "en", "s", "x", 7) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string, slot int").repartition(3)
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1]) for r in rows)
    assert {k: sorted(r.slot for r in back if r.shard == k) for k in range(4)} == {k: list(range(5)) for k in range(4)}


def test_files_prune_on_several_dimensions(spark):
    """With 24 shards each holds few of the sources, languages and sizes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    placed = sharding.hilbert_shards(docs).withColumn("z", F.floor(F.log2("size"))).join(docs.select("doc_id", "lang", "source"), "doc_id")
    held = {c: placed.select("shard", c).distinct().count() / 24 / placed.select(c).distinct().count() for c in ("lang", "source", "z")}
    print(held)
    assert sum(held.values()) / 3 < 0.6
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 1
    # copies of a text from one source lie in one shard or in neighbours
    texts = docs.select("doc_id", "text").join(placed.select("doc_id", "shard", "source", "lang"), "doc_id")
    span = texts.groupBy("text", "source", "lang").agg((F.max("shard") - F.min("shard")).alias("d")).agg(F.max("d")).first()[0]
    assert span <= 1


# fingerprints


@pytest.mark.parametrize("bits", [128, 8, 4])
def test_fingerprints_are_equal_for_equal_canonical_texts(spark, bits):
    rows = [(i, t) for i, t in enumerate([*ODD, *(f"t {i}" for i in range(40))])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df, bits).collect()}
    want = {i: fingerprints.canonical(t or "") for i, t in rows}
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in got for b in got)


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_sensitivity(name, request):
    df = request.getfixturevalue(name)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    out = fingerprints.sensitivity(df).collect()
    assert sorted(r.doc_id for r in out) == ids
    for r in out:
        text, following = texts[r.doc_id], texts[after[r.doc_id]]
        k = len(text) // 4
        other = text[: len(text) - k] + following[:k]
        same = lambda a, b: float(fingerprints.canonical(a) == fingerprints.canonical(b))
        assert (r.n_chars, r.near_edited, r.near_next) == (len(text), same(text, other), same(text, following))
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == tuple(xxhash.xxh3_128_hexdigest(fingerprints.canonical(x)) for x in (text, other))


def test_sensitivity_with_shared_hashes(spark):
    """With few bits different texts share hashes; their names still differ."""
    rows = [(i, f"text {i % 30}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in fingerprints.sensitivity(df, 4).collect()}
    assert all((out[a].fingerprint == out[b].fingerprint) == (rows[a][1] == rows[b][1]) for a in out for b in out)
    assert all(r.near_next == 0 for r in out.values())


def test_sensitivity_of_repeated_ids(spark):
    """Rows of one doc_id follow each other by text."""
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (None, "zz")], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0, r.n_chars, r.near_next) for r in fingerprints.sensitivity(df).collect()))
    assert got == [(0, 2, 0.0), (1, 1, 0.0), (1, 1, 0.0), (1, 1, 1.0), (2, 0, 0.0)]


def test_one_and_no_document(spark, none):
    assert fingerprints.sensitivity(none).count() == 0
    one = fingerprints.sensitivity(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert (one.doc_id, one.near_next, one.near_edited) == (5, 1.0, 0.0)


# nearest neighbours


def brute(rows, k):
    out = {}
    ok = {i: np.array(v, np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-float(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
        out[q] = [i for _, i in best]
    return out


def test_neighbours_of_small_and_odd_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(90)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(60)]  # one common vector
    rows += [(200, None), (220, [0.0] * 4), (240, [float("nan")] * 4), (260, [1.0, None, 0.0, 0.0]), (280, []), *[(300 + i, [1.0 + i, 2.0]) for i in range(3)], *[(320 + i, [2.0, 1.0, float(i)]) for i in range(22)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    out = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        out[r.query_id].append((r["rank"], r.vec_id))
    want = brute(rows, 20)
    assert {q: [i for _, i in sorted(v)] for q, v in out.items()} == {q: v for q, v in want.items() if v}


def test_repeated_vectors_and_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows + rows[:50] + rows[:50] + [(200, [9.0, 9.0, 9.0, 9.0]), (200, [-9.0, 9.0, 9.0, 9.0])], "vec_id long, embedding array<float>")
    out = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        out[r.query_id].append((r["rank"], r.vec_id))
    for q, near in out.items():
        assert [k for k, _ in sorted(near)] == list(range(1, len(near) + 1)) and len({i for _, i in near}) == len(near) and q not in {i for _, i in near}
    want = brute([*rows, (199, [9.0, 9.0, 9.0, 9.0])], 20)
    ids = {q: [i for _, i in sorted(v)] for q, v in out.items()}
    assert all(len(v) in (19, 20) for v in ids.values())
    assert len(set(ids[20]) & {200 if i == 199 else i for i in want[20]}) >= 18


def clustered(n, dim=32):
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(12, dim))
    return (centers[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)


@pytest.mark.parametrize("n", [500, 2_000, 20_000])
def test_recall_of_nearest(spark, n):
    x = clustered(n)
    rows = [*((i, v.tolist()) for i, v in enumerate(x)), *((i, x[i].tolist()) for i in range(0, n, 7))]  # some repeated
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        assert abs(r.score - float(x[r.query_id].astype(np.float64) @ x[r.vec_id].astype(np.float64))) < 1e-9
        got[r.query_id].add(r.vec_id)
    q = np.arange(0, n, 20)
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -np.inf
    true = np.argsort(-near, axis=1)[:, :20]
    recall = np.mean([len(got[i] & set(t)) / 20 for i, t in zip(q.tolist(), true.tolist(), strict=True)])
    print("recall", n, recall)
    assert sorted(got) == q.tolist() and all(len(v) == 20 for v in got.values()) and recall >= 0.9


@pytest.mark.parametrize("n", [20, 200, 1_000])
def test_the_graph_answers_at_every_size(n):
    """Without its links a graph finds nothing but the places it starts from."""
    x = clustered(n)
    graph = ann.Graph.build(ann._level(x))
    q = np.concatenate((x[:5], np.zeros((5, 1), np.float32)), 1)
    assert (graph.search(q, 10) >= 0).sum() == 50 and len(graph.layers) >= (2 if n > 100 else 1)
    graph.layers = [(m, np.full_like(a, -1)) for m, a in graph.layers]
    assert (graph.search(q, 10) >= 0).sum() <= 5


def test_recall_of_the_graph():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 32))
    x = (centers[rng.integers(0, 12, 6000)] + 0.4 * rng.normal(size=(6000, 32))).astype(np.float32)
    graph = ann.Graph.build(ann._level(x))
    q = x[::40]
    found = graph.search(np.concatenate((q, np.zeros((len(q), 1), np.float32)), 1), 21)
    true = np.argsort(-(q @ x.T), axis=1)[:, :21]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(found.tolist(), true.tolist(), strict=True)]) >= 0.9


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df).count() == 0


# near duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(texts):
    sets, parent = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in texts}


@pytest.fixture(scope="module")
def families(spark):
    """Copies, near copies, chains of near copies, texts that share a passage, and odd texts."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefg"), 5))
    passage = [word() for _ in range(60)]
    texts = list(ODD)
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(8):
            own = list(base)
            for i in rng.integers(0, 120, rng.integers(0, 5)):
                own[i] = word()
            texts.append(" ".join(own))
        chain = list(base)
        for _ in range(6):
            chain[rng.integers(0, 120)] = word()
            texts.append(" ".join(chain))
    for n in (20, 60, 200):
        texts += [" ".join([word() for _ in range(n)] + passage) for _ in range(12)]
    return spark.createDataFrame([(i * 3, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, token string").repartition(4)


def test_near_duplicates_equal_brute_force(families):
    texts = {r.doc_id: r.text for r in families.collect()}
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(families).collect()}
    assert out == components(texts)
    assert len({c for _, c in out.values()}) < len(texts) - 40


def test_near_duplicates_in_blocks_of_groups(families, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 5)
    monkeypatch.setattr(jaccard, "LEAF", 2)
    texts = {r.doc_id: r.text for r in families.collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(families).collect()} == components(texts)


def test_near_duplicates_with_split_tokens(families, monkeypatch):
    """Common tokens dealt into parts, counts added up in two levels, several leader parts."""
    monkeypatch.setattr(jaccard, "SPLIT_BITS", 2)
    monkeypatch.setattr(jaccard, "COUNT_ROWS", 1)
    monkeypatch.setattr(jaccard, "LEADER_KEYS", 2)
    monkeypatch.setattr(jaccard, "SENT_KEYS", 3)
    texts = {r.doc_id: r.text for r in families.collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(families).collect()} == components(texts)


def test_aggregates_over_split_tokens(spark):
    rows = [(t, k, 1 if t else 4) for t in (0, 1) for k in range(40)]
    df = spark.createDataFrame(rows, "token long, key long, parts int")
    out = jaccard.over_tokens(df, {"low": F.col("key"), "size": F.lit(1).cast("long")}, True).collect()
    assert len(out) == 80 and {(r.low, r["size"]) for r in out} == {(0, 40)}


def test_tree_loses_no_pair():
    rng = np.random.default_rng(4)
    sets = [set(rng.choice(400, rng.integers(5, 60), replace=False).tolist()) for _ in range(150)]
    sets += [s - set(list(s)[:2]) | {1000 + i} for i, s in enumerate(sets[:100])]
    bits = np.zeros((len(sets), 4), np.uint64)
    for i, s in enumerate(sets):
        for x in s:
            bits[i, x % 256 // 64] |= np.uint64(1) << np.uint64(x % 64)
    key, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    tree = jaccard.SignatureTree(key, key, size, bits)
    got = {tuple(sorted(p)) for a, b in tree.pairs(tree, 75) for p in zip(a.tolist(), b.tolist(), strict=True)}
    linked = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {tuple(sorted(p)) for p in linked} <= got and len(got) < len(sets) ** 2 / 8


def test_blocks_pair_all_that_may_link(spark, monkeypatch):
    """Any two rows of a group that may link meet in one pair of blocks; a large component beside few others is not repeated for itself."""
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 20)
    rng = np.random.default_rng(7)
    rows = [(1, k, int(rng.integers(2, 400)), int(rng.integers(0, 30))) for k in range(300)] + [(2, 1000 + k, 50, 7) for k in range(400)]
    rows += [(2, 2000, 50, 8), (2, 2001, 66, 9), (2, 2002, 5000, 10), (3, 3000, 5, 1), (3, 3001, 6, 2)]
    out = jaccard._in_blocks(spark.createDataFrame(rows, "token long, key long, n long, component long"), 75).collect()
    held = {}
    for r in out:
        assert r.block in (r.i, r.j)
        held.setdefault((r.token, r.i, r.j), []).append(r)
    met = {}
    for own in held.values():
        for a in own:
            for b in own:
                if a.key < b.key and (a.i == a.j or a.block != b.block):
                    met[a.token, a.key, b.key] = met.get((a.token, a.key, b.key), 0) + 1
    may = {(t, a, b) for t, a, n, c in rows for u, b, m, d in rows if t == u and a < b and c != d and 100 * min(n, m) >= 75 * max(n, m)}
    assert may <= met.keys() and max(met.values()) == 1
    assert sum(r.token == 2 for r in out) < 2 * 400 + 100 and max(len(x) for x in held.values()) < 100


@pytest.mark.parametrize("percent", [50, 75, 80, 100])
def test_size_classes(percent):
    bounds = np.array(jaccard.size_bounds(percent))
    for n in range(1, 3000):
        most = n * 100 // percent
        assert np.searchsorted(bounds, most, "right") - np.searchsorted(bounds, n, "right") <= 1


def test_components_with_hubs(spark):
    """A key linked with most others, cut at run time into parts, and a chain."""
    links = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(40)] + [(2999, 5020)]
    names = {"skewJoin.skewedPartitionFactor": "1", "skewJoin.skewedPartitionThresholdInBytes": "1KB", "advisoryPartitionSizeInBytes": "1KB", "autoBroadcastJoinThreshold": "-1"}
    for k, v in names.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        out = dict(jaccard.components(spark.createDataFrame(links, "leader long, key long")).collect())
    finally:
        for k in names:
            spark.conf.unset(f"spark.sql.adaptive.{k}")
    assert out == dict.fromkeys([*range(3000), *range(5000, 5041)], 0)


def test_no_near_duplicates(none):
    assert jaccard.near_duplicates(none).count() == 0


# quality


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    ratings = quality.graded(labels)
    known = ratings.where("doc_id % 5 <> 0")
    out = quality.score(docs, quality.fit(docs, known)).join(ratings.where("doc_id % 5 = 0"), "doc_id").collect()
    kept = {g: np.mean([r.keep for r in out if r.grade == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.97 and kept[0] < 0.05 and kept[1] < 0.35
    grade = {g: np.mean([r.expected_grade for r in out if r.grade == g]) for g in (0, 1, 2)}
    assert grade[0] < grade[1] < grade[2]


def test_quality_in_every_language(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    ratings = quality.graded(labels)
    out = quality.score(docs, quality.fit(docs, ratings)).join(ratings, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in {r.lang for r in out}:
        kept = {g: np.mean([r.keep for r in out if (r.lang, r.grade) == (lang, g)]) for g in (1, 2)}
        assert kept[1] < 0.25 and kept[2] > 0.95


def test_quality_without_words_or_ratings(odd, none, documents, spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    got = {r.doc_id: r for r in quality.score(odd, quality.fit(documents, quality.graded(labels))).collect()}
    assert [got[i].keep for i in range(3)] == [False] * 3 and len(got) == len(ODD)
    assert all(r.keep and r.tail_probability is None for r in quality.score(odd, quality.fit(documents, quality.graded(labels.limit(0)))).collect())
    assert quality.score(none, quality.fit(none, quality.graded(labels))).count() == 0
    strange = spark.createDataFrame([(1, None, 1), (2, 0, None), (2, 1, 0), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.graded(strange).collect()} == {2: 0, 3: 2}


def test_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 10)) for _ in range(300)]
    model = quality.Ordinal.fit(rows, np.array([min(2, int((r < 10).sum())) for r in rows]), 3)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(rows)
    assert (tails[:, 0] >= tails[:, 1]).all()
