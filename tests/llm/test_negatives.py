import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives


def brute(rows, anchor, positives=5, negatives_=3, low=50, high=95, scale=256):
    """All pairs in Python integers; rows are (vec_id, vector, label)."""
    seen, good = set(), []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        u = tuple(int(np.floor(scale * float(x))) for x in v)
        if (i, label, u) not in seen and sum(x * x for x in u) < 2**62:
            seen.add((i, label, u))
            good.append((i, label, u))
    out = []
    for i, label, u in good:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(u, w, strict=True)), j, other) for j, other, w in good if len(w) == len(u))
        best = [(s, j) for s, j, other in scored if other == label and j != i][:positives]
        for p, j in best:
            fit = [(s, k) for s, k, other in scored if other != label and low * -p <= 100 * -s <= high * -p][:negatives_]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, anchor="vec_id % 5 = 0", **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"dim": F.lit("x"), "number": F.lit(1), "part": F.lit(0)}).repartition(3)
    return sorted(map(tuple, negatives.mine(df, F.expr(anchor), **more).collect()))


def data(n, dim, seed, spread=1.0, labels=4):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(0, spread, (n, dim)))
    return [(i, [float(v) for v in x[i]], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("dim", "spread"), [(8, 0.2), (3, 1e-3), (130, 1.0), (5, 3e5)])
def test_equals_all_pairs(spark, dim, spread):
    rows = data(120, dim, dim, spread)
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_signed_residues_are_exact():
    rng = np.random.default_rng(1)
    for top in (3, 1000, 2**24, 2**29):
        a, b = rng.integers(-top, top + 1, (17, 70)), rng.integers(-top, top + 1, (23, 70))
        if top == 2**29:
            a, b = a[:, :3], b[:, :3]
        want = a.astype(object) @ b.T.astype(object)
        primes = negatives.primes_for(float(top) ** 2 * a.shape[1])
        assert (negatives.products(negatives.residues(a, primes), negatives.residues(b, primes), primes) == want.astype(np.int64)).all()
    with pytest.raises(ValueError):
        negatives.primes_for(1e30)


def test_blocks_parts_and_ties(spark, monkeypatch):
    rows = [(i, [1.0, float(i % 3), 0.5], i % 2) for i in range(90)] + [(i, [0.6, float(i % 2), 0.25], 2) for i in range(90, 140)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert want and mined(spark, rows) == want
    for name, value in (("ANCHOR_BLOCK", 4), ("TILE_ROWS", 7), ("TILE_ANCHORS", 3), ("PARTS", 5)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    rows = data(40, 4, 3, 0.3) + [
        (100, None, 1), (101, [0.1, None, 0.2, 0.3], 1), (102, [float("nan"), 0.0, 0.0, 0.0], 1), (103, [float("inf"), 0.0, 0.0, 0.0], 1), (104, [0.1] * 4, None), (None, [0.1] * 4, 1),
        (105, [0.0] * 4, 1), (110, [0.0] * 4, 2), (115, [], 1), (106, [], 2), (107, [0.5] * 7, 1), (120, [0.5] * 7, 1), (108, [0.4] * 7, 2), (109, [1e12] * 4, 1), (0, [0.2] * 4, 1), (0, [0.2] * 4, 1),
        (125, [-0.5] * 4, 3), (126, [0.5] * 4, 3),
    ]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 1)]) == []  # no anchor
    assert mined(spark, [(5, [0.5], 1)]) == []  # no other row
