import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantiles, range_of

SHARES = [0.0, 0.005, 0.25, 0.5, 0.75, 0.995, 1.0]


def plain(values):
    out, v = [], sorted(values)
    for p in SHARES:
        x = p * (len(v) - 1)
        low, high = v[math.floor(x)], v[math.ceil(x)]
        out.append(low if low == high else low + (high - low) * (x - math.floor(x)))
    return out


def groups():
    rng = random.Random(5)
    special = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 1.7e308, -1.7e308, 1.0, math.nextafter(1.0, 0), math.nextafter(2.0, 3), 2.0**52, 2.0**53 - 1]
    return {
        "all distinct": [rng.gauss(0, 1) for _ in range(4000)], "one repeated value": [3.25] * 3000 + [rng.random() for _ in range(1000)], "all equal": [-7.5] * 500, "one": [2.0], "two": [1.0, 4.0],
        "wide": special + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(1500)], "near": [1.0 + i * 2.0**-52 for i in range(700)], None: [float(i) for i in range(10)],
    }


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_equal_sorted_values(spark, few):
    rows = [(k, v, "x") for k, x in groups().items() for v in x] + [("nulls only", None, "x"), ("two", None, "x")]
    df = spark.createDataFrame(rows, "name string, value double, n string").repartition(5)
    got = {r["name"]: r for r in quantiles(df, ["name"], "value", SHARES, few).collect()}
    assert set(got) == set(groups())
    for name, values in groups().items():
        assert got[name].n == len(values)
        assert list(got[name].quantiles) == pytest.approx(plain(values), rel=1e-12, abs=0.0)


def test_quantiles_without_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert list(quantiles(df, [], "v", [0.5, 0.25]).first().quantiles) == [50.0, 25.0]
    assert quantiles(df.where("v < 0"), [], "v", [0.5]).collect() == []
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (2.0,)], "v double")
    got = quantiles(odd, [], "v", [0.0, 0.25, 0.5, 0.75, 1.0]).first().quantiles
    assert got[:4] == [float("-inf"), 1.0, 2.0, float("inf")] and math.isnan(got[4])


def test_ranges_rise_with_the_value(spark):
    values = sorted(v for x in groups().values() for v in x)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", range_of(F.col("v")).alias("r")).orderBy("i").collect()
    assert (np.diff([r.r for r in rows]) >= 0).all()


def test_no_task_collects_a_group(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.sqrt("id").alias("v"))
    plan = quantiles(df, ["k"], "v", [0.5])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list(_v" not in plan


def test_the_second_pass_works_out_no_ranges(spark):
    df = spark.range(2_000).select((F.col("id") % 2).alias("k"), F.sqrt("id").alias("v"))
    plan = quantiles(df, ["k"], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert sum("LOG2(" in line for line in plan.splitlines()) == 1
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (0.0,), (1.0,)], "v double")
    assert list(quantiles(zeros, [], "v", [0.0, 1.0]).first().quantiles) == [0.0, 1.0]
