"""Mix sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Targets are shares of a total, capped at a multiple of the source's own size. Each source is dealt by a seeded hash into
shards of bounded size, so a source that holds a third of all rows is no single group. A shard's documents, in seeded order,
form a line; the line twice over is cut into equal blocks, of which the last may be short. A source whose target is its cap
takes all of them. To the others the method of highest quotients gives each shard its number of blocks, and a seeded order
chooses them, those of the first pass over the line before those of the second. Where whole
documents are wanted, the parts of documents that blocks take are given to whole copies by systematic sampling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import bucket_of, keep, table, text_of

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, SHARE, CAP, BLOCK, SHARD_WORDS, SEED = (3, 1, 2), 1.5, 2, 64, 1 << 18, 7
#: A block is at most this part of the least target below a cap, so that a small target is met by many blocks too.
PARTS = 64
UNIT = 1 << 30


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, source_no, source_size, target`` from rows of ``source, size``.

    Sources by code point, null last, take the weights in turn. A target that exceeds ``cap`` times its source's size is set
    to that, and the excess is shared again by weight among the others until none exceeds.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source, as in the table of weights itself.
    per = per.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1)
    per = keep(per.withColumn("weight", turn), "mix-sources")
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = (F.col("weight") * level > cap * F.col("source_size")) if capped >= 0 else F.lit(False)
        held, free, n = per.agg(F.coalesce(F.sum(F.when(over, cap * F.col("source_size"))), F.lit(0)),
                                F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count(F.when(over, 1))).first()
        if n == capped or not free:
            break
        level, capped = (total - held) / free, n
    return per.select("source", "source_no", "source_size", F.least(F.col("weight") * level, (cap * F.col("source_size")).cast("double")).alias("target"))


def quotas(cells: DataFrame, keys: list[str], seats: int, rounds: int = 8, fan: int = 32) -> DataFrame:
    """Add ``quota``: ``seats`` blocks by highest quotients target / (2 k + 1), at most ``room`` per cell.

    The quota of a cell is target / divisor, rounded, for the divisor at which the quotas sum to ``seats``. Each round sums the
    quotas for ``fan`` divisors in one aggregate. Cells that still tie take the remaining seats by quotient, then by key.
    """
    def at(d: float):
        return F.least("room", F.floor(F.col("target") / d + 0.5))

    total, room, most = cells.agg(F.sum("target"), F.sum("room"), F.max("target")).first()
    if not room or seats <= 0 or not total:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    if seats >= room:
        return cells.withColumn("quota", F.col("room"))
    low, high = total / seats / 4096, 2.0 * most + 1  # at the upper end every quota is 0
    for _ in range(rounds):
        divisors = [low * (high / low) ** (i / fan) for i in range(fan + 1)]
        sums = cells.agg(*[F.sum(at(d)) for d in divisors[1:-1]]).first()
        i = sum(s >= seats for s in sums)
        low, high = divisors[i], divisors[i + 1]
    base = cells.withColumn("quota", at(high))
    left = seats - base.agg(F.sum("quota")).first()[0]
    quotient = F.col("target") / (2 * F.col("quota") + 1)
    extra = base.where(at(low) > F.col("quota")).orderBy(quotient.desc(), *keys).limit(max(0, left)).select(*keys, F.lit(1).alias("extra"))
    return base.join(extra, keys, "left").withColumn("quota", F.col("quota") + F.coalesce("extra", F.lit(0))).drop("extra")


def taken_words(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS,
                seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``mixed_words`` with their place: ``source_no, shard, order, start``.

    A block has ``block`` words, or fewer where a target below a cap would hold fewer than ``PARTS`` of them.
    """
    rows = keep(docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
                            F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long").alias("size")), "mix-sizes")
    targets = keep(source_targets(rows, weights, share, cap), "mix-targets")
    whole = F.col("target") >= cap * F.col("source_size")
    least = targets.where(~whole & (F.col("target") > 0)).agg(F.min("target")).first()[0]
    block = block if least is None else max(1, min(block, int(least // PARTS)))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    # A table with one row per source; Spark broadcasts it while it is small and splits a hot source otherwise.
    rows = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id")).withColumn("shard", F.pmod(F.shiftright("order", 20), shards))
    cell = ["source_no", "shard"]
    line = Window.partitionBy(*cell).orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = keep(rows.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0))), "mix-lines")
    cells = rows.groupBy(*cell, "source_size", "target").agg(F.sum("size").alias("words")).where("words > 0")
    cells = keep(cells.select(*cell, "words", (F.col("target") * F.col("words") / F.col("source_size")).alias("target"),
                              F.ceil(cap * F.col("words") / block).alias("room"), whole.alias("whole")), "mix-cells")
    seats = round((targets.where(~whole).agg(F.sum("target")).first()[0] or 0) / block)
    cells = quotas(cells.where("NOT whole"), cell, seats).unionByName(cells.where("whole").withColumn("quota", F.col("room")))
    blocks = cells.where("room > 0").select(*cell, "words", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("room") - 1)).alias("block"))
    seeded = Window.partitionBy(*cell).orderBy(F.floor(F.col("block") * block / F.col("words")), F.xxhash64(F.lit(seed), *cell, "block"), "block")
    chosen = blocks.withColumn("rank", F.row_number().over(seeded)).where("rank <= quota").select(*cell, "block")
    words = rows.join(cells.select(*cell, "words"), cell).where("size > 0")
    spans = words.select("*", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("turn"))
    spans = spans.withColumn("from", F.col("start") + F.col("turn") * F.col("words")).withColumn("to", F.col("from") + F.col("size"))
    spans = spans.withColumn("block", F.explode(F.expr(f"sequence(`from` div {block}, (`to` - 1) div {block})")))
    overlap = F.least("to", (F.col("block") + 1) * block) - F.greatest("from", F.col("block") * block)
    # Rows with words have a start of their own within their cell.
    # Spark takes the exploded blocks for as small as the cells they come from and would broadcast them.
    taken = spans.join(chosen.hint("merge"), [*cell, "block"]).groupBy(*cell, "start").agg(F.sum(overlap).alias("taken"))
    with_words = rows.where("size > 0").join(taken, [*cell, "start"], "left")
    out = with_words.unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_words(docs: DataFrame, **settings) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken``.

    ``size`` counts runs of characters other than ASCII white space (a null text has none), ``taken`` the words that the mix
    takes, at most ``cap`` times the size. A null source is a source of its own, the last. Rows without words take none. An
    empty table gives no rows. Settings as of ``taken_words``.
    """
    return taken_words(docs, **settings).select("doc_id", "source", "size", "source_size", "target", "taken")


def whole_copies(taken: DataFrame) -> DataFrame:
    """``doc_id, times``: the copies of whole documents that make up each source's taken words.

    A document stands as often as its taken words fill it; the rest is a fraction of one more copy. The fractions are summed
    along each source's shards, the longest documents of a shard first and equal ones in seeded order, and a document at which
    the sum passes a half number gets that copy. A shard's words so differ from those taken by no more than its longest
    document, and a document's chance of the copy is its fraction. Fractions are whole multiples of 1 / ``UNIT``, exact in any order.
    """
    part = F.expr(f"(taken % size) * {UNIT}L div size")
    rows = keep(taken.where("size > 0").select("doc_id", "source_no", "shard", "order", "start", "size",
                                               F.expr("taken div size").alias("whole"), part.alias("part")), "mix-fractions")
    cell = ["source_no", "shard"]
    # One row per shard of bounded size.
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy(*cell).agg(F.sum("part").alias("part")).select(*cell, F.coalesce(F.sum("part").over(before), F.lit(0)).alias("before"))
    along = Window.partitionBy(*cell).orderBy(F.col("size").desc(), "order", "start").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("part").over(along)).join(shards, cell)
    passed = f"(before + sum + {UNIT // 2}L) div {UNIT}L - (before + sum - part + {UNIT // 2}L) div {UNIT}L"
    return rows.select("doc_id", (F.col("whole") + F.expr(passed)).cast("int").alias("times"))


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """The documents that the mix takes, with all their columns, in whole copies whose words per source meet the taken ones.

    A row that repeats another's identifier and text should have been removed before.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64(text_of()).alias("text_hash"))
    mix = taken_words(docs.select(key.alias("key"), "text", "source"), id_column="key", **settings)
    times = whole_copies(mix).select(F.col("doc_id").alias("__key"), F.col("times").alias("__times"))
    rows = docs.select(F.struct("*").alias("__row"), key.alias("__key")).join(times.where("__times > 0"), "__key")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")


def op10_source_mix(spark, sf_dir):
    return mixed_words(table(spark, sf_dir, "documents")).drop("source")


SQL = None
