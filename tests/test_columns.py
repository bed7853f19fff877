import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import cyclestats as Y
from tidemark.operators import glm as G


def labels(spark, function, length):
    days = spark.range(1, length + 1).select(F.col("id").cast("int").alias("d"), F.lit(length).alias("n"))
    return "".join(r.x for r in days.select("d", function("d", "n").alias("x")).orderBy("d").collect())


@pytest.mark.parametrize(
    ("function", "length", "expected"),
    [
        (C.phase_strict, 28, "MMMFFFFFFOOOOOO" + "O" + "LLLLLLLLL" + "MMM"),
        (C.phase_strict, 23, "MMMFFFFFFOO" + "LLLLLLLLL" + "MMM"),
        (C.phase_strict, 35, "MMMFFFFFF" + "O" * 14 + "L" * 9 + "MMM"),
        (C.phase_modified_short, 21, "MMM" + "OOOOOO" + "L" * 9 + "MMM"),
        (C.phase_luteal_anchored, 28, "MMM" + "F" * 9 + "OOOO" + "L" * 9 + "MMM"),
        (C.phase_reddy, 28, "PPP" + "FFFFFF" + "OOOOOOO" + "L" * 9 + "PPP"),
    ],
)
def test_phases(spark, function, length, expected):
    assert labels(spark, function, length) == expected


def test_phase_outside_cycle_is_null(spark):
    row = spark.sql("select 0 as d, 28 as n").select(C.phase_strict("d", "n").alias("a"), C.phase_reddy("d", "n").alias("b")).first()
    assert row.a is None and row.b is None


@pytest.mark.parametrize(
    ("args", "ratio", "reason"),
    [((1, 3, 0, 10), math.inf, None), ((0, 3, 0, 10), None, "undefined_zero_over_zero"), ((1, 0, 1, 10), None, "missing_numerator_phase"), ((1, 3, 1, 0), None, "missing_comparator_phase"), ((2, 4, 1, 4), 2.0, None)],
)
def test_ratio(spark, args, ratio, reason):
    x = spark.range(1).select(C.adsf_ratio(*map(F.lit, args)).alias("x")).first().x
    assert (x.ratio, x.reason) == (ratio, reason)
    assert spark.range(1).select(C.ratio_positive(C.adsf_ratio(*map(F.lit, args))["ratio"], 1.69).alias("p")).first().p == (None if ratio is None else ratio >= 1.69)


@pytest.mark.parametrize(
    ("labels", "expected"),
    [((None, None, None), None), ((True, False, None), "C1 only"), ((False, True, None), "C2 only"), ((True, True, None), "C1+C2"), ((False, False, True), "C3 only"), ((True, None, True), "C3 plus C1/C2"), ((False, None, None), "none")],
)
def test_categories(spark, labels, expected):
    c = [F.lit(x).cast("boolean") for x in labels]
    row = spark.range(1).select(C.pattern_category(*c).alias("x"), C.any_known(*c).alias("any")).first()
    assert row.x == expected
    known = [x for x in labels if x is not None]
    assert row.any == (any(known) if known else None)


def test_normal_cdf(spark):
    for z in (-5, -1.96, -0.3, 0, 0.7, 1.645, 4):
        assert abs(spark.range(1).select(C.normal_cdf(F.lit(float(z))).alias("p")).first().p - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-6


def test_wilson(spark):
    low, high = C.wilson(F.lit(12), F.lit(197))
    row = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (round(row.a, 4), round(row.b, 4)) == (0.0352, 0.1034)
    low, high = C.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low.alias("a"), high.alias("b")).first()) == (None, None)


def test_holm(spark):
    a, b = C.holm_two(F.lit(0.04), F.lit(0.01))
    assert tuple(spark.range(1).select(a.alias("a"), b.alias("b")).first()) == (0.04, 0.02)


def test_irregularity(spark):
    rows = [(p, i, x) for p, xs in (("a", [28, 35, 28]), ("b", [28, 36, 28, 36]), ("c", [28])) for i, x in enumerate(xs)]
    got = {r.participant_id: r.irregularity for r in Y.cycle_irregularity(spark.createDataFrame(rows, "participant_id string, cycle_id int, cycle_length int")).collect()}
    assert got == {"a": 7.0, "b": 8.0, "c": None}


def test_grouped_fit_equals_closed_form():
    import numpy as np

    # without cycle effects the three groups are saturated: log ratios of means, and known standard errors
    n, y, alpha = np.array([40, 20, 20]), np.array([10, 15, 6]), 0.5
    (b1, s1), (b2, s2) = G.fit_cells(np.zeros(3, int), np.array([0, 1, 2]), n, y, alpha)
    mu = y / n
    w = n * mu / (1 + alpha * mu)
    assert b1 == pytest.approx(math.log(mu[1] / mu[0]), abs=1e-8) and b2 == pytest.approx(math.log(mu[2] / mu[0]), abs=1e-8)
    assert s1 == pytest.approx(math.sqrt(1 / w[1] + 1 / w[0]), abs=1e-8) and s2 == pytest.approx(math.sqrt(1 / w[2] + 1 / w[0]), abs=1e-8)


def test_separated_fit_is_null():
    import numpy as np

    assert G.fit_cells(np.zeros(3, int), np.array([0, 1, 2]), np.array([9, 9, 9]), np.array([0, 3, 2]), 1.0) == [(None, None), (None, None)]
    first, second = G.fit_cells(np.zeros(3, int), np.array([0, 1, 2]), np.array([9, 9, 9]), np.array([4, 0, 2]), 1.0)
    assert first == (None, None) and second[0] is not None
