"""Exact quantiles of groups of any size, by selection in two passes.

A double maps to a whole number that rises with it: its sign, binary exponent and the first bits of its mantissa. The first pass
counts the rows of each such range, combined before the exchange, so a group holds a bounded number of ranges whatever its
rows. Running sums of the counts tell the ranges that hold the wanted ranks. The second pass reads only the rows of these
ranges, counts their distinct values (a repeated value is one row after the scan) and takes those at the ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the mantissa that tell ranges apart: 65,536 ranges between a power of two and the next.
BITS = 16


def range_of(v: Column) -> Column:
    """The range of a double: equal or rising where the value rises; infinities and NaN (largest) are ranges of their own."""
    size, a = 1 << BITS, F.abs(v)
    guess = F.floor(F.log2(a))
    # next to a power of two the logarithm may be off by one; powers of two and quotients by them are exact
    exponent = guess - F.when(F.pow(F.lit(2.0), guess) > a, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), guess + 1) <= a, 1).otherwise(0)
    code = (exponent + 1075) * size + F.floor((a / F.pow(F.lit(2.0), exponent) - 1) * size)
    far = F.lit(4096 * size).cast("long")
    code = F.when(v == 0, F.lit(0).cast("long")).when(a == float("inf"), far).otherwise(code)
    return F.when(F.isnan(v), far + 1).when(v < 0, -code).otherwise(code)


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], few: bool = True) -> DataFrame:
    """``keys, n, quantiles``: the number of values of each group and the quantiles at ``shares``, as an array of doubles.

    Between two ranks the quantile is interpolated linearly. Null values do not count; groups without others give no row; null is a
    key like any other; NaN is larger than all. With ``few`` the groups must be of a fixed kind (cohorts, features), as up to
    ``2 * len(shares)`` ranges of each are broadcast; without it they are joined by shuffle.
    """
    values = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    own = values.withColumn("_range", range_of(F.col("_v")))
    counts = own.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    group = Window.partitionBy(*keys)
    before, total = F.sum("_rows").over(group.orderBy("_range")) - F.col("_rows"), F.sum("_rows").over(group)
    place = [F.lit(float(p)) * (F.col("_total") - 1) for p in shares]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_rows"))
    cells = counts.withColumns({"_before": before, "_total": total}).withColumn("_ranks", F.filter(ranks, inside)).where(F.size("_ranks") > 0)
    cells = cells.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_cell"), "_low", "_high", "_before", "_total", "_ranks")
    # a group's few ranges are told apart by their smallest and largest values, so that no value's range is worked out again; a shuffle needs it
    same = F.col("_v").between(F.col("_low"), F.col("_high")) if few else F.col("_range") == F.col("_cell")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near = values.join(F.broadcast(cells), same) if few else own.join(cells, same)
    valued = near.groupBy(*keys, "_cell", "_v", "_before", "_total", "_ranks").agg(F.count("*").alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy(*keys, "_cell").orderBy("_v"))
    valued = valued.withColumn("_before", F.col("_before") + upto - F.col("_rows"))
    found = valued.withColumn("_rank", F.explode(F.filter("_ranks", inside)))
    held = found.groupBy(*keys).agg(F.max("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")).where("_total is not null")

    def between(x: Column) -> Column:
        low, high = F.element_at("_at", F.floor(x).cast("long")), F.element_at("_at", F.ceil(x).cast("long"))
        return F.when(low == high, low).otherwise(low + (high - low) * (x - F.floor(x)))

    return held.select(*keys, F.col("_total").alias("n"), F.array(*[between(x) for x in place]).alias("quantiles"))
