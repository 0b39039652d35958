"""Windows over long series without one task per key.

A plain window puts all rows of a key into one task. A key that holds a third of the data
would then be sorted by a single executor. The functions here cut each key into blocks: a
monotone function of the ordering columns (a calendar day, the leading digits of a hash, a
value bucket). Rows are windowed per (key, block); what crosses a block border is carried by
one row per block, or by the few rows at its ends, which is bounded by the number of blocks
and not by the number of rows. Results equal those of the plain window.

The order must be total (ties only between equal rows). Null keys form one series, and a null in the order
comes first; where block totals are joined back, key and block are compared as one struct, in which nulls equal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "__block"
PART = "__part"


#: Marks a series whose blocks are cut from the data by ``even_blocks``.
EVEN = "even"
#: Blocks that a table is cut into then, and sampled rows per block.
BLOCKS, SAMPLED = 1024, 32


def even_blocks(df: DataFrame, order: Sequence[str | Column], name: str = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """Number the rows' blocks: of nearly equal size (with many rows, at most twice the mean), rising along ``order``.

    The cuts are rows at equal steps of one random sample of bounded size, held in a scalar subquery; a row finds its block
    among them by bisection, one projection per step, so nothing is joined or broadcast. Equal rows share a block. A null in
    the order comes first, NaN last.
    """
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])
    sample = df.select(key.alias("k")).orderBy(F.rand(7)).limit(blocks * SAMPLED).agg(F.sort_array(F.collect_list("k")).alias("s"))
    step = F.sequence(F.lit(1), F.lit(blocks - 1))
    cuts = sample.select(F.when(F.size("s") > 0, F.array_distinct(F.transform(
        step, lambda j: F.col("s")[F.floor(j * F.size("s") / blocks).cast("int")]))).alias("c")).scalar()
    out = df.withColumns({"__key": key, name: F.lit(0)})
    for half in (1 << k for k in reversed(range((blocks - 1).bit_length()))):
        at = F.col(name)
        out = out.withColumn(name, at + F.when(F.get(cuts, at + (half - 1)) <= F.col("__key"), half).otherwise(0))
    return out.drop("__key")


@dataclass(frozen=True)
class Series:
    """Keys, total order, and the block that cuts a key into pieces.

    ``block`` defaults to the first ordering column. It must not decrease along the order. ``EVEN`` cuts
    blocks of equal size from the data, for an order whose values may crowd together.
    """

    keys: Sequence[str]
    order: Sequence[str | Column]
    block: Column | str | None = None

    def blocked(self, df: DataFrame) -> DataFrame:
        if isinstance(self.block, str):
            return even_blocks(df, [*self.keys, *self.order])
        first = self.order[0]
        default = F.col(first) if isinstance(first, str) else first
        return df.withColumn(BLOCK, self.block if self.block is not None else default)

    @property
    def parts(self) -> list[str]:
        return [*self.keys, BLOCK]

    def parted(self, df: DataFrame) -> DataFrame:
        """Rows with their key and block as one struct, which is never null."""
        return self.blocked(df).withColumn(PART, F.struct(*self.parts))

    def across(self, turn: Callable = F.asc) -> WindowSpec:
        """Earlier blocks of a key, for a table with one row per part."""
        return Window.partitionBy(*[F.col(PART)[k] for k in self.keys]).orderBy(turn(F.col(PART)[BLOCK])).rowsBetween(
            Window.unboundedPreceding, -1)


def hash_series(keys: Sequence[str], hash_col: str, ties: Sequence[str] = (), digits: int = 4) -> Series:
    """Series in hash order, with 16**digits blocks per key."""
    return Series(keys, [hash_col, *ties], F.substring(F.col(hash_col), 1, digits))


def running(df: DataFrame, series: Series, sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums in series order.

    Row sums stay inside a block; the block totals are summed apart and joined back on the
    keys by which the rows are already partitioned, so the rows are shuffled once.
    """
    rows = series.parted(df)
    totals = rows.groupBy(PART).agg(*[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()])
    before = totals.select(PART, *[F.sum(f"__t_{n}").over(series.across()).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy(PART).orderBy(*series.order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("*", *[F.sum(e).over(inside).alias(f"__w_{n}") for n, e in sums.items()])
    zero = F.lit(0)
    return within.join(before, PART, "left").select(
        *df.columns,
        *[(F.coalesce(f"__w_{n}", zero) + F.coalesce(f"__b_{n}", zero)).alias(n) for n in sums],
    )


def positions(df: DataFrame, series: Series, name: str = "rn") -> DataFrame:
    """Exact row number per key, 1-based."""
    return running(df, series, {name: F.lit(1).cast("long")})


def bounded_window(
    df: DataFrame,
    series: Series,
    exprs: Callable[[WindowSpec], dict[str, Column]],
    lookback: int,
    lookahead: int = 0,
) -> DataFrame:
    """Window expressions that reach at most ``lookback`` rows back and ``lookahead`` ahead.

    Rows away from the block ends see their whole frame inside the block. The others are
    computed again over the first and last ``lookback + lookahead`` rows of all blocks, which
    hold every row their frames can touch.
    """
    reach = lookback + lookahead
    parts = series.parts
    rows = series.blocked(df)
    inside = Window.partitionBy(*parts).orderBy(*series.order)
    head = F.row_number().over(inside)
    size = F.count(F.lit(1)).over(Window.partitionBy(*parts))
    first = rows.select("*", head.alias("__head"), size.alias("__size"),
                        *[e.alias(n) for n, e in exprs(inside).items()])
    first = first.withColumn("__tail", F.col("__size") - F.col("__head") + 1)
    names = list(exprs(inside))
    edge_row = (F.col("__head") <= lookback) | (F.col("__tail") <= lookahead)
    done = first.filter(~edge_row).select(*df.columns, *names)
    border = first.filter((F.col("__head") <= reach) | (F.col("__tail") <= reach))
    border = border.select(*df.columns, "__head", "__tail")
    across = Window.partitionBy(*series.keys).orderBy(*series.order)
    fixed = border.select("*", *[e.alias(n) for n, e in exprs(across).items()]).filter(edge_row)
    return done.unionByName(fixed.select(*df.columns, *names))


def carry_forward(df: DataFrame, series: Series, cols: dict[str, Column], strict: bool = False,
                  backward: bool = False) -> DataFrame:
    """Last non-null value at or before each row (before it, if ``strict``); with ``backward``
    the next one at or after it. The order must be plain column names."""
    rows, order = series.parted(df), list(series.order)
    turn = F.desc if backward else F.asc
    inside = Window.partitionBy(PART).orderBy(*[turn(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, -1 if strict else 0)
    outermost = F.min if backward else F.max
    latest = rows.groupBy(PART).agg(*[
        outermost(F.when(e.isNotNull(), F.struct(*order, e.alias("__v")))).alias(f"__l_{n}") for n, e in cols.items()])
    before = latest.select(PART, *[
        F.last(F.col(f"__l_{n}")["__v"], ignorenulls=True).over(series.across(turn)).alias(f"__c_{n}") for n in cols])
    within = rows.select("*", *[F.last(e, ignorenulls=True).over(inside).alias(f"__w_{n}") for n, e in cols.items()])
    keep = [c for c in df.columns if c not in cols]
    return within.join(before, PART, "left").select(
        *keep, *[F.coalesce(f"__w_{n}", f"__c_{n}").alias(n) for n in cols])


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key in the given order.

    The rank filter is pushed below the shuffle (window group limit), so a hot key sends at
    most ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match, keeping the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def mark_lowest(df: DataFrame, n: Column, series: Series, name: str = "chosen") -> DataFrame:
    """Flag the first ``n`` rows of the whole table in series order.

    Block counts tell in which block the n-th row lies. Blocks before it are in, blocks after
    it are out, without moving a row; only the rows of that one block are ranked.
    """
    rows = series.blocked(df)
    counts = with_scalar(rows.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n")), __wanted=n)
    upto = F.sum("n").over(Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0))
    cut = counts.select(BLOCK, "n", "__wanted", upto.alias("upto")).filter("upto > __wanted").agg(
        F.min(F.struct(F.col(BLOCK).alias("block"), (F.col("__wanted") - F.col("upto") + F.col("n")).alias("left"))).alias("cut")).scalar()
    marked = with_scalar(rows, __cut=cut)
    # As structs, in which a null block equals itself and comes first.
    mine, cuts = F.struct(F.col(BLOCK).alias("b")), F.struct(F.col("__cut.block").alias("b"))
    inside = F.col("__cut").isNull() | (mine < cuts)
    at_cut = F.col("__cut").isNotNull() & (mine == cuts)
    clear = marked.filter(~at_cut).withColumn(name, inside)
    rank = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*series.order))
    edge = marked.filter(at_cut).withColumn(name, rank <= F.col("__cut.left"))
    return clear.unionByName(edge).drop(BLOCK, "__cut")


def mark_lowest_per_key(df: DataFrame, series: Series, quota: DataFrame, amount: str, name: str = "chosen") -> DataFrame:
    """Flag the first rows of each key, as many as ``quota`` grants it; none where it grants nothing.

    The quota is split over the blocks of a key before it meets the rows, so rows are moved
    once, by (key, block), and a hot key is spread over its blocks.
    """
    rows, keys = series.parted(df), list(series.keys)
    counts = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(series.across()), F.lit(0))
    by_key = counts.select(PART, *[F.col(PART)[k].alias(k) for k in keys], before.alias("__before"))
    granted = null_safe_join(by_key, quota.select(*keys, amount), keys).select(
        PART, (F.col(amount) - F.col("__before")).alias("__granted"))
    rank = F.row_number().over(Window.partitionBy(PART).orderBy(*series.order))
    return rows.withColumn("__rank", rank).join(granted, PART, "left").select(
        *df.columns, F.coalesce(F.col("__rank") <= F.col("__granted"), F.lit(False)).alias(name))


def with_scalar(df: DataFrame, **scalars: Column) -> DataFrame:
    """Add scalar subqueries as columns, so that a plan holds each of them once however often
    its fields are used."""
    return df.withColumns(scalars)


def salted_join(df: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[str] | None = None, salts: int = 16,
                null_safe: bool = False) -> DataFrame:
    """Left join to a table with one row per key, in which a hot key is spread over ``salts`` tasks.

    The salt comes from the values of ``spread`` (all columns by default), so a repeated task
    sends its rows to the same place again. With ``null_safe``, null keys match.
    """
    salt = F.pmod(F.xxhash64(*(spread or df.columns)), F.lit(salts)).cast("int")
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("__salt", salt)
    joined = null_safe_join(salted, copies, [*keys, "__salt"], "left") if null_safe else salted.join(copies, [*keys, "__salt"], "left")
    return joined.drop("__salt")
