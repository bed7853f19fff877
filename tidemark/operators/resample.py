"""Sampling by hashed ranks: the same rows for the same seed, in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


#: Rows are ranked within 2**(32 - BUCKET_SHIFT) ranges of their hash, so that no group is ranked in one task.
BUCKET_SHIFT = 22
#: Draws that one task makes for a replicate.
BLOCK_DRAWS = 100_000


def hash_ranked(df: DataFrame, group: list[str], hashed: Column, tie: str, most: Column | None = None) -> DataFrame:
    """``df`` with ``_rank``, from 0 in order of a hash below 2**32 and ``tie`` within each group. ``most``, an expression that may
    name ``_total`` (rows of the group): only so many ranks; ranges of the hash beyond them are not ranked."""
    each = df.withColumn("_h", hashed).withColumn("_b", F.shiftright("_h", BUCKET_SHIFT))
    counts = each.groupBy(*group, "_b").agg(F.count("*").alias("_n"))  # at most 1,024 rows a group
    base = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_bb"), (F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy(*group)).alias("_total"))
    same = F.col("_b") == F.col("_bb")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = each.join(base, same)
    if most is not None:
        joined = joined.where(F.col("_base") < most)
    out = joined.withColumn("_rank", F.col("_base") + F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", tie)) - 1)
    if most is not None:
        out = out.where(F.col("_rank") < most)
    return out.select(*df.columns, "_rank")


def study_mc(pool: DataFrame, definitions: dict[str, str], n_studies: int = 200, sizes: tuple[int, ...] = (30,), seed: int = 1) -> DataFrame:
    """Prevalence of each definition in simulated studies of ``n`` participants, one pool window of each.

    ``pool`` has ``cohort, phase_mode, participant_id, window_seq`` and the label columns. A study takes ``n`` participants
    without replacement, each set with the same chance: the first ``n`` different ones of hashed draws, or, where ``n`` is over
    a quarter of the cohort, those of smallest hash. Both are made inside the study's own row. Sizes above a cohort give no rows.
    """
    key = ["cohort", "phase_mode"]
    people = pool.groupBy(*key, "participant_id").agg(F.count("*").alias("n_windows"))
    # ranks within a cohort: one number a participant, by hash
    people = hash_ranked(people, key, C.stable_hash(seed, F.lit("rank"), "participant_id"), "participant_id").withColumnRenamed("_rank", "rank")
    cohorts = people.groupBy(*key).agg(F.count("*").alias("total")).withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).where("n <= total")
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that few rows that become many are dealt out
    study = [*key, "n", "study_id"]
    studies = cohorts.withColumn("study_id", F.explode(F.sequence(F.lit(1), F.lit(n_studies)))).repartition(parts, *study)
    hashed = lambda x: C.stable_hash(seed, F.lit("draw"), *key, "n", "study_id", x)
    drawn = lambda a, b: F.transform(F.sequence(a, b), lambda slot: F.pmod(hashed(slot), F.col("total")))
    usual = F.col("n") * 2 + 20
    first = F.array_distinct(drawn(F.lit(1), usual))
    # enough with all but certainty; else so many more that a lack has a chance below 1e-100, and is an error
    more = F.array_distinct(F.concat(first, drawn(usual + 1, usual + 100 * F.col("n") + 1000)))
    few = F.when(F.size(first) >= F.col("n"), first).otherwise(F.when(F.size(more) >= F.col("n"), more).otherwise(F.raise_error(F.lit("too few different draws"))))
    every = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), lambda r: F.struct(hashed(r).alias("o"), r.alias("r")))), lambda x: x["r"])
    ranks = F.slice(F.when(F.col("n") * 4 > F.col("total"), every).otherwise(few), F.lit(1), F.col("n"))
    chosen = studies.select(*study, F.explode(ranks).alias("rank")).join(people, [*key, "rank"])
    seq = 1 + F.pmod(C.stable_hash(seed, F.lit("window"), *key, "n", "study_id", "participant_id"), F.col("n_windows"))
    nth = Window.partitionBy(*key, "participant_id").orderBy("window_seq")
    numbered = pool.withColumn("seq", F.row_number().over(nth)).select(*key, "participant_id", "seq", *definitions.values())
    rows = chosen.withColumn("seq", seq.cast("int")).join(numbered, [*key, "participant_id", "seq"])
    # counted side by side and stacked after, so that no row is multiplied by the definitions
    counts = [x for i, v in enumerate(definitions.values()) for x in (F.count(v).alias(f"_n{i}"), F.count_if(F.coalesce(v, F.lit(False))).alias(f"_p{i}"))]
    wide = rows.select(*study, *definitions.values()).repartition(parts, *study).groupBy(*study).agg(*counts)
    triples = ", ".join(f"'{k}', _n{i}, _p{i}" for i, k in enumerate(definitions))
    agg = wide.select(*study, F.expr(f"stack({len(definitions)}, {triples}) as (definition, n_classifiable, positives)"))
    return agg.withColumnRenamed("n", "n_participants").withColumn("prevalence_all", F.col("positives") / F.col("n_participants")).withColumn("prevalence_classifiable", F.try_divide("positives", "n_classifiable"))


def bootstrap_by_participant(df: DataFrame, partials: dict[str, Column], statistic: Column, n: int = 100, seed: int = 1) -> DataFrame:
    """Cluster bootstrap: ``replicate, statistic``. Rows are summed to one a participant (``partials``), these are drawn
    with replacement, and ``statistic`` is an expression over the sums of the draws. Draws are dealt out in blocks."""
    people = df.groupBy("participant_id").agg(*[F.sum(c).alias(k) for k, c in partials.items()])
    ranked = hash_ranked(people, [], C.stable_hash(seed, "participant_id"), "participant_id").withColumnRenamed("_rank", "rank")
    total = people.agg(F.count("*").alias("total")).where("total > 0")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = total.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {BLOCK_DRAWS}"))))
    upto = F.least((F.col("block") + 1) * BLOCK_DRAWS, F.col("total"))
    slots = blocks.repartition(parts, "replicate", "block").withColumn("slot", F.explode(F.sequence(F.col("block") * BLOCK_DRAWS + 1, upto)))
    draws = slots.select("replicate", F.pmod(C.stable_hash(seed, F.lit("boot"), "replicate", "slot"), F.col("total")).alias("rank"))
    # the table of participants is the small side, though Spark takes the exploded draws for a few rows and would broadcast them
    joined = draws.join(ranked.hint("shuffle_hash"), "rank")
    return joined.groupBy("replicate").agg(*[F.sum(k).alias(k) for k in partials]).select("replicate", statistic.alias("statistic"))


def quota_sample(df: DataFrame, stratum: str, order: str, quota: int, strata: list[str], seed: int = 1) -> DataFrame:
    """A quota spread evenly over the strata in order, the remainder to the first ones."""
    even, more = divmod(quota, max(len(strata), 1))
    share = F.create_map(*[x for i, s in enumerate(strata) for x in (F.lit(s), F.lit(even + (i < more)))])
    return hash_ranked(df, [stratum], C.stable_hash(seed, order), order, F.coalesce(share[F.col(stratum)], F.lit(0))).drop("_rank")
