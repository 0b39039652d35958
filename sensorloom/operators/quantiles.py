"""Exact quantiles in two passes: a sketch brackets each rank, then only the values inside the brackets are looked at.

The first pass keeps a mergeable quantile sketch per group and channel, whose rank error is bounded, so two of its quantiles
hold the wanted ranks between them. The second pass meets the rows with these brackets: values below a bracket are counted
(combined on the map side), values inside are counted one by one. Rows times channels never leave a task; what does is a
small, fixed share of them. The values inside a bracket are cut into equal steps, and only the step with the rank is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.ordered import null_safe_join, salted_join
from sensorloom.session import cut_lineage

#: Inverse rank error of the sketches, and group sizes from which a bracket is narrower: it must span the error and two ranks to
#: either side. A smaller group has one bracket with all its values.
ACCURACY, SIZES = 2000, (32, 125, 500, 2000)
#: Equal steps of a bracket.
STEPS = 256
#: Rows of a group up to which its values are sorted as they are.
SMALL = 4096


def brackets(rows: DataFrame, keys: Sequence[str], names: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row per key with the array ``__b``: each channel's number of values, then a lower end per channel and probability, then
    the upper ends. As one column it reaches both readers of the brackets alike, so the sketches are made once."""
    reaches = [2 / size + 1 / ACCURACY for size in SIZES]
    ask = [min(1.0, max(0.0, p + sign * r)) for sign in (-1, 1) for p in probs for r in reaches]
    sketches = rows.groupBy(*keys).agg(*[e for c in names for e in (
        F.percentile_approx(c, ask, ACCURACY).alias(f"s{c}"), F.count(c).alias(f"n{c}"), F.min(c).alias(f"l{c}"), F.max(c).alias(f"g{c}"))])

    def end(c: str, sign: int, j: int) -> Column:
        n, first = F.col(f"n{c}"), (sign * len(probs) + j) * len(SIZES)
        level = F.lit(first)
        for k, size in enumerate(SIZES[1:], 1):
            level = F.when(n >= size, first + k).otherwise(level)
        return F.when(n >= SIZES[0], F.get(f"s{c}", level)).otherwise(F.col(f"{'lg'[sign]}{c}"))

    return sketches.select(*keys, F.array(*[F.col(f"n{c}").cast("double") for c in names], *[
        end(c, sign, j) for sign in (0, 1) for c in names for j in range(len(probs))]).alias("__b"))


def bisected(x: Column, cuts: Sequence[float], strict: bool = False) -> Column:
    """How many of the cuts are at most ``x`` (less than it, if strict); 0 for a null. NaN counts as the largest number."""
    rising = np.sort(np.array(cuts, float))

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(rising, v.to_numpy(float), "left" if strict else "right"))

    return F.when(x.isNull(), 0).otherwise(place(x.cast("double")))


def counted_by_group(rows: DataFrame, found: DataFrame, keys: Sequence[str], names: Sequence[str], probs: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Per key and cell ``__e`` the rows below its bracket (``__bk`` -1, with the channel's number of values), and per key, cell and step
    the values ``__v`` inside it with their copies: rows meet their group's brackets by a salted join."""
    with_ends = salted_join(rows, found, keys, names, null_safe=True)
    size, ends = len(names), F.col("__b")
    cells = [(e, names[e // len(probs)], ends[size + e], ends[size + size * len(probs) + e]) for e in range(size * len(probs))]
    below = with_ends.groupBy(*keys).agg(*[F.count_if(F.col(c) < lo).alias(f"b{e}") for e, c, lo, _ in cells], *[F.first(ends[i]).alias(f"n{i}") for i in range(size)])
    floor = below.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(e).alias("__e"), F.lit(-1).alias("__bk"), F.col(f"b{e}").alias("__n"), F.col(f"n{e // len(probs)}").cast("long").alias("__total")) for e, *_ in cells])).alias("__x")).select(*keys, "__x.*").where("__total > 0")
    hit = lambda c, lo, hi: F.col(c).between(lo, hi)
    inside = F.array_compact(F.array(*[F.when(hit(c, lo, hi), F.struct(F.lit(e).alias("e"), step(F.col(c), lo, hi).alias("bk"), F.col(c).alias("v"))) for e, c, lo, hi in cells]))
    few = with_ends.where(reduce(Column.__or__, [hit(c, lo, hi) for _, c, lo, hi in cells]))
    counts = few.select(*keys, F.explode(inside).alias("__x")).groupBy(
        *keys, F.col("__x.e").alias("__e"), F.col("__x.bk").alias("__bk"), F.col("__x.v").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    return floor, counts


def counted_overall(rows: DataFrame, found: DataFrame, names: Sequence[str], probs: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """The same without keys. The brackets are one row, so their ends are constants: a value finds the cells around it by bisection, and
    copies of a value are counted before they are laid out by cell. One pass over the rows gives both tables."""
    ends, size, width = found.first()["__b"], len(names), len(probs)
    order = sorted(range(width), key=lambda j: probs[j])  # in it both ends rise

    def rising(i: int, upper: int) -> list[float]:
        return [ends[size + upper * size * width + i * width + j] for j in order] if ends[i] else []

    # A value lies in the cells from the first whose upper end it does not pass to the last whose lower end it reaches.
    placed = rows.select(F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), F.col(c).alias("v"), bisected(F.col(c), rising(i, 1), strict=True).alias("a"), bisected(F.col(c), rising(i, 0)).alias("b"))
        for i, c in enumerate(names)])).alias("x")).select("x.*").where("v IS NOT NULL")
    seen = placed.groupBy("i", "a", "b", F.when(F.col("a") < F.col("b"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    seen = cut_lineage(seen)  # read twice
    cell = (F.col("i") * width + F.get(F.array(*[F.lit(j) for j in order]), F.col("k"))).alias("__e")
    floor = seen.groupBy("i", "b").agg(F.sum("n").alias("n")).select("i", "b", "n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k")).groupBy(cell).agg(
        F.sum(F.when(F.col("b") <= F.col("k"), F.col("n")).otherwise(0)).alias("__n"), F.sum("n").alias("__total")).select("__e", F.lit(-1).alias("__bk"), "__n", "__total")
    numbers = F.array(*[F.lit(x).cast("double") for x in ends[size:]])
    lo, hi = F.get(numbers, F.col("__e")), F.get(numbers, F.col("__e") + size * width)
    inside = seen.where("v IS NOT NULL").select("i", "v", "n", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("k")).select(cell, "v", "n")
    return floor, inside.select("__e", step(F.col("v"), lo, hi).alias("__bk"), F.col("v").alias("__v"), F.col("n").alias("__n"))


def step(v: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * STEPS).cast("int"))), F.lit(0))


FOUND = ("__e", "__v", "__rank", "__frac", "__total", "__is_lo", "__is_hi")


def ranked_cells(df: DataFrame, keys: Sequence[str], values: dict[str, Column], probs: Sequence[float]) -> DataFrame:
    """For each key, channel and probability (``__e`` counts both) the one or two values ``__v`` at its lower and upper rank
    (``__is_lo``, ``__is_hi``), with the number of values up to them (``__rank``), the ranks' fraction ``__frac`` and the number of all
    values. Small groups are sorted; only the others' ranks are bracketed first."""
    names = [f"__v{i}" for i in range(len(values))]
    number = lambda v: F.when(~F.isnan(v.cast("double")), v.cast("double"))
    rows = df.select(*keys, *[number(v).alias(c) for c, v in zip(names, values.values())])
    if not keys:
        return bracketed_cells(rows, keys, names, probs)
    large = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > SMALL).select(*keys))
    if large.isEmpty():
        return sorted_cells(rows, keys, names, probs)
    large = F.broadcast(large)  # fewer than one row per SMALL rows
    both = [make(null_safe_join(rows, large, keys, how), keys, names, probs) for make, how in ((sorted_cells, "left_anti"), (bracketed_cells, "left_semi"))]
    return both[0].unionByName(both[1])


def sorted_cells(rows: DataFrame, keys: Sequence[str], names: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``ranked_cells`` of groups of bounded size: one exchange of the rows by the key, and a sort of the values behind it."""
    listed = rows.repartition(*keys).select(*keys, F.posexplode(F.array(*names)).alias("__i", "__v")).where("__v IS NOT NULL")
    group = Window.partitionBy(*keys, "__i")
    placed = listed.select("*", F.row_number().over(group.orderBy("__v")).alias("__at"), F.count(F.lit(1)).over(group.orderBy("__v")).alias("__rank"),
                           F.count(F.lit(1)).over(group).alias("__total"))
    places = [F.lit(float(p)) * (F.col("__total") - 1) for p in probs]
    ranks = F.array(*[F.struct((F.col("__i") * len(probs) + j).alias("__e"), (F.floor(h) + 1).alias("__lo"), (F.ceil(h) + 1).alias("__hi"), (h - F.floor(h)).alias("__frac"))
                      for j, h in enumerate(places)])
    mine = F.filter(ranks, lambda x: (x["__lo"] == F.col("__at")) | (x["__hi"] == F.col("__at")))
    return placed.select(*keys, "__v", "__rank", "__total", "__at", F.inline(mine)).select(
        "*", (F.col("__at") == F.col("__lo")).alias("__is_lo"), (F.col("__at") == F.col("__hi")).alias("__is_hi")).select(*keys, *FOUND)


def bracketed_cells(rows: DataFrame, keys: Sequence[str], names: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``ranked_cells`` of groups of any size."""
    found = brackets(rows, keys, names, probs)
    floor, counts = counted_by_group(rows, found, keys, names, probs) if keys else counted_overall(rows, found, names, probs)
    group = [*keys, "__e"]
    whole = Window.partitionBy(*group)
    steps = counts.groupBy(*group, "__bk").agg(F.sum("__n").alias("__n")).withColumn("__total", F.lit(None).cast("long")).unionByName(floor).select(
        *group, "__bk", "__n", F.max("__total").over(whole).alias("__total"),
        F.sum("__n").over(whole.orderBy("__bk").rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"), F.sum("__n").over(whole).alias("__seen"))
    p = F.array(*[F.lit(float(x)) for x in probs])[F.pmod("__e", F.lit(len(probs)))]
    h = p * (F.col("__total") - 1)
    wanted = steps.select(*group, "__bk", "__total", "__seen", (F.col("__upto") - F.col("__n")).alias("__before"), "__upto", (F.floor(h) + 1).alias("__lo"),
                          (F.ceil(h) + 1).alias("__hi"), (h - F.floor(h)).alias("__frac"))
    # The sketch's bound keeps both ranks inside; were it ever broken, an error is better than a wrong value.
    held = (F.col("__bk") >= 0) | ((F.col("__upto") < F.col("__lo")) & (F.col("__hi") <= F.col("__seen")))
    wanted = wanted.where(F.when(held, F.col("__bk") >= 0).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("boolean")))
    holds = lambda r: (F.col("__before") < F.col(r)) & (F.col(r) <= F.col("__upto"))
    wanted = wanted.where(holds("__lo") | holds("__hi"))
    place = Window.partitionBy(*group, "__bk").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = null_safe_join(counts, wanted.drop("__seen", "__upto"), [*group, "__bk"]).withColumn("__rank", F.col("__before") + F.sum("__n").over(place))
    return ranked.select("*", at_rank("__lo").alias("__is_lo"), at_rank("__hi").alias("__is_hi")).where("__is_lo OR __is_hi").select(*keys, *FOUND)


def at_rank(rank: str) -> Column:
    return (F.col("__rank") - F.col("__n") < F.col(rank)) & (F.col(rank) <= F.col("__rank"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    probs: dict[str, float],
    above: dict[str, str] | None = None,
) -> DataFrame:
    """One row per key with a column ``name + suffix`` per value and probability.

    Linear interpolation between the two neighbouring ranks; null and NaN are ignored. A key without any value has no row;
    without keys there is always one row. ``above`` maps some of these columns to names of further ones, with the number of
    values greater than the quantile.
    """
    keys, width = list(keys), len(probs)
    found = ranked_cells(df, keys, values, list(probs.values()))
    entry = F.struct(F.col("__e").alias("k"), F.struct("__v", "__rank", "__frac", "__total").alias("x"))
    # Two small maps per key: the values at the lower and at the upper rank.
    packed = found.groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(F.when(F.col(f"__is_{r}"), entry))).alias(f"__{r}") for r in ("lo", "hi")])
    columns, further = [], []
    for i, n in enumerate(values):
        for j, s in enumerate(probs):
            lo, hi = (F.try_element_at(r, F.lit(i * width + j)) for r in ("__lo", "__hi"))
            value = F.when(lo["__v"] == hi["__v"], lo["__v"]).otherwise(lo["__v"] + (hi["__v"] - lo["__v"]) * lo["__frac"])
            columns.append(value.alias(f"{n}{s}"))
            if name := (above or {}).get(f"{n}{s}"):
                further.append((lo["__total"] - F.when(value >= hi["__v"], hi["__rank"]).otherwise(lo["__rank"])).alias(name))
    return packed.select(*keys, *columns, *further)


def quantile_columns(df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` of plain columns."""
    return exact_quantiles(df, keys, {c: F.col(c) for c in cols}, probs)
