"""Rebalancing and weights, reproducible at any partitioning.

Random order is the md5 of seed and key. ``ties`` completes the order where keys repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.expressions import hash_key, hash_unit
from sensorloom.operators.ordered import EVEN, Series, hash_series, mark_lowest, mark_lowest_per_key, positions, salted_join, with_scalar

HASH = "__h"
#: Copies that one task makes of a row at a time.
COPIES_AT_ONCE = 4096


def count_where(df: DataFrame, cond: Column) -> Column:
    """Row count as a scalar subquery: one number, computed once, no join."""
    return df.agg(F.count(F.when(cond, 1)).alias("n")).scalar()


def class_sizes(df: DataFrame, label: str) -> Column:
    """Map from class to row count as a scalar subquery; one entry per class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("m")).scalar()


def _hashed(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    return df.withColumn(HASH, hash_key(seed, *keys))


def replicated(df: DataFrame, columns: Sequence[str], copies: Column) -> DataFrame:
    """``columns`` and ``copy``: each row ``copies`` times, numbered from 1; rows with no copies go.

    A row with many copies becomes one row per chunk of copies first; chunks are exchanged by row hash and number, and a task
    then makes those of its chunks. Such rows are few, since each stands for a chunk of the result; the others do not move.
    """
    counted = df.withColumn("__copies", copies.cast("long")).filter("__copies > 0")
    few = counted.filter(F.col("__copies") <= COPIES_AT_ONCE).withColumn("__from", F.lit(0).cast("long"))
    chunk = F.sequence(F.lit(0).cast("long"), F.expr(f"(__copies - 1) div {COPIES_AT_ONCE}"))
    many = counted.filter(F.col("__copies") > COPIES_AT_ONCE).withColumn("__chunk", F.explode(chunk)).withColumn("__from", F.col("__chunk") * COPIES_AT_ONCE).drop("__chunk")
    many = many.withColumn("__copies", F.least(F.col("__copies") - F.col("__from"), F.lit(COPIES_AT_ONCE).cast("long")))
    many = many.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), HASH, "__from")
    return few.unionByName(many).select(*columns, F.explode(F.expr("sequence(cast(__from + 1 AS int), cast(__from + __copies AS int))")).alias("copy"))


def oversample_random(df: DataFrame, label: str, keys: Sequence[str], seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """Every class replicated to exactly the size of the largest one.

    Each row is copied size-ratio times, and the rest comes from the rows first in hash order.
    """
    ranked = positions(_hashed(df, keys, seed), hash_series([label], HASH, ties), "__rn")
    ranked = with_scalar(ranked, __sizes=class_sizes(df, label))
    largest, own = F.array_max(F.map_values("__sizes")), F.col("__sizes")[F.col(label)]
    copies = F.floor(largest / own) + F.when(F.col("__rn") <= largest % own, 1).otherwise(0)
    return replicated(ranked, df.columns, copies)


def undersample_random(df: DataFrame, label: str, keys: Sequence[str], seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """All minority rows and as many majority rows, first in hash order."""
    minority, majority = df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)
    n = count_where(df, F.col(label) == 1)
    kept = mark_lowest(_hashed(majority, keys, seed), n, hash_series([], HASH, ties, digits=5))
    return kept.filter("chosen").select(*df.columns).unionByName(minority)


def oversample_stratified(df: DataFrame, label: str, strata: Sequence[str], keys: Sequence[str], ratio: float = 1.0,
                          seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """Minority replicated to majority * ratio rows; the incomplete last copy takes the lowest
    ranks of every stratum first."""
    minority, majority = df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)
    plan = df.agg(F.struct(F.floor(F.count(F.when(F.col(label) == 0, 1)) * F.lit(ratio)).alias("target"),
                           F.count(F.when(F.col(label) == 1, 1)).alias("have")).alias("p")).scalar()
    ranked = positions(_hashed(minority, keys, seed), hash_series(strata, HASH, ties), "__rank")
    by_rank = Series([], ["__rank", HASH, *strata, *ties], EVEN)
    marked = with_scalar(mark_lowest(ranked, plan["target"] % F.nullif(plan["have"], F.lit(0)), by_rank), __plan=plan)
    copies = F.floor(F.col("__plan.target") / F.col("__plan.have")) + F.when(F.col("chosen"), 1).otherwise(0)
    extra = replicated(marked, df.columns, copies)
    return majority.withColumn("copy", F.lit(1)).unionByName(extra)


def stratum_quota(df: DataFrame, label: str, strata: Sequence[str], ratio: float = 1.0) -> DataFrame:
    """Minority rows per stratum times ratio, for the strata that have any."""
    return df.filter(F.col(label) == 1).groupBy(*strata).agg(
        F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("quota"))


def undersample_stratified(df: DataFrame, label: str, strata: Sequence[str], keys: Sequence[str], ratio: float = 1.0,
                           seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """All minority rows; per stratum minority * ratio majority rows, none without minority."""
    minority, majority = df.filter(F.col(label) == 1), df.filter(F.col(label) == 0)
    marked = mark_lowest_per_key(_hashed(majority, keys, seed), hash_series(strata, HASH, ties),
                                 stratum_quota(df, label, strata, ratio), "quota")
    return marked.filter("chosen").select(*df.columns).unionByName(minority)


def rank_in_stratum(df: DataFrame, strata: Sequence[str], keys: Sequence[str], seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """Rank in hash order within each stratum."""
    return positions(_hashed(df, keys, seed), hash_series(strata, HASH, ties), "rank").drop(HASH)


def stratum_counts(df: DataFrame, label: str, strata: Sequence[str]) -> DataFrame:
    """Majority and minority rows per stratum; 0 where there is no minority."""
    n1 = df.filter(F.col(label) == 1).groupBy(*strata).agg(F.count(F.lit(1)).alias("minority"))
    n0 = df.filter(F.col(label) == 0).groupBy(*strata).agg(F.count(F.lit(1)).alias("majority"))
    return n0.join(n1, list(strata), "left").withColumn("minority", F.coalesce(F.col("minority"), F.lit(0)))


def undersample_fraction(df: DataFrame, label: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Majority rows kept with probability minority / majority, each on its own; no shuffle of rows."""
    share = count_where(df, F.col(label) == 1).cast("double") / F.nullif(count_where(df, F.col(label) == 0), F.lit(0))
    return df.filter((F.col(label) == 1) | ((F.col(label) == 0) & (hash_unit(seed, *keys) < share)))


def draw_weights(df: DataFrame, base: str, label: str) -> DataFrame:
    """(rows of the base + 1) / (rows of the base with this label + 1)."""
    pair = df.groupBy(base, label).agg(F.count(F.lit(1)).alias("__nl"))
    whole = pair.groupBy(base).agg(F.sum("__nl").alias("__nb"))
    table = pair.join(whole, base).select(base, label, ((F.col("__nb") + 1) / (F.col("__nl") + 1)).alias("weight"))
    return salted_join(df, table, [base, label])


def weighted_draw(df: DataFrame, weight: str, n: int | Column, keys: Sequence[str], seed: int = 42,
                  ties: Sequence[str] = ()) -> DataFrame:
    """``n`` rows drawn without replacement with chances in proportion to the weight: the
    lowest -ln(u) / w (Efraimidis and Spirakis), u from the hash."""
    u = (hash_unit(seed, *keys) * F.lit(4294967296.0) + F.lit(0.5)) / F.lit(4294967296.0)
    keyed = df.withColumn("__e", -F.log(u) / F.col(weight))
    n = F.lit(n) if not isinstance(n, Column) else n
    order = Series([], ["__e", *keys, *ties], EVEN)
    return mark_lowest(keyed, n, order).filter("chosen").select(*df.columns)


def inverse_class_weight(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("weight", F.lit(1.0) / class_sizes(df, label)[F.col(label)])


def target_fraction_weight(df: DataFrame, label: str, fraction: float) -> DataFrame:
    """Weight of positives so that they make up ``fraction`` of the drawn rows; 1 for the others."""
    pos, neg = count_where(df, F.col(label) == 1), count_where(df, F.col(label) == 0)
    alpha = F.lit(fraction) * neg / (F.lit(1.0 - fraction) * F.nullif(pos, F.lit(0)))
    return df.withColumn("weight", F.when(F.col(label) == 1, alpha).otherwise(F.lit(1.0)))


def balanced_class_weight(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * class size)."""
    sizes = class_sizes(df, label)
    total = count_where(df, F.col(label).isNotNull())
    return df.withColumn("weight", total / (F.size(F.map_keys(sizes)) * sizes[F.col(label)]))


def pos_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive, one row."""
    pos, neg = F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) == 0, 1))
    return df.agg(pos.alias("pos"), neg.alias("neg"), (neg / F.nullif(pos, F.lit(0))).alias("pos_weight"))


def bag_weight(df: DataFrame, bag: Sequence[str], label: str) -> DataFrame:
    """1 / rows in the bag, times negatives per positive."""
    sizes = df.groupBy(*bag).agg(F.count(F.lit(1)).alias("__size"))
    pos, neg = count_where(df, F.col(label) == 1), count_where(df, F.col(label) == 0)
    return salted_join(df, sizes, list(bag)).withColumn(
        "weight", F.lit(1.0) / F.col("__size") * (neg / F.greatest(pos, F.lit(1)))).drop("__size")
