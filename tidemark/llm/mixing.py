"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets follow from weights and caps (water filling). Each source's target, cut into blocks of ``block`` words, is
apportioned to sources, within a source to groups of shards, and within a group to its shards: seats go to the highest
quotients votes / (2k + 1). Shards are in proportion to the words, and a group holds about as many shards as a source
has groups, so no window holds more rows than the square root of the number of shards.
A shard lays its documents end to end in an order seeded by hash; its quota of q blocks out of n is every block
q div n times, and q mod n blocks once more, spread evenly from a seeded start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, passing, row_of, written

WEIGHTS = (5, 2, 1)
BLOCK = 16
#: Words that a shard has on the mean.
SHARD_WORDS = 100_000
CAP = 3
#: Parts of a document that copies are rounded from.
_PARTS = 1 << 20


def text_size(text: Column) -> Column:
    """Number of words; null and blank texts have 0."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, WS + "+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes (source, source_size) with rank, weight and target; one row per source, so windows over all of it are small.

    Sources by code point, null last, weigh weights in turn. Water filling: with sources ordered by the level at which
    they reach cap times their size, those before the first level that suffices are full, the rest share by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    w = F.array(*[F.lit(x) for x in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", F.get(w, F.pmod("rank", F.lit(len(weights)))))
    by_level = Window.orderBy("reach", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (
        ranked.withColumn("reach", cap * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after))
    )
    held = level.withColumn("water", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "rank", "level"))).over(everything)["level"])
    return held.select(
        "source", "source_size", "rank", "weight", F.least(F.col("weight") * F.col("water"), (cap * F.col("source_size")).cast("double")).alias("target")
    )


def sainte_lague(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str) -> DataFrame:
    """votes with a column quota: within each group, its seats go to the highest quotients vote / (2k + 1).

    Rounding vote * seats / total is off by some d seats in all, and moving the divisor until d is 0 only adds seats or
    only removes them, so no quota moves by more than d: quotients are made for 2d + 1 values of k around the rounded
    share and no more. Ties go to the smaller key.
    """
    w = Window.partitionBy(*group)
    share = F.when(F.col("_t") > 0, F.col(vote) * F.col(seats) / F.col("_t")).otherwise(0.0)
    near = votes.withColumn("_t", F.sum(vote).over(w)).withColumn("_q", F.floor(share + 0.5))
    near = near.withColumn("_d", F.abs(F.sum("_q").over(w) - F.col(seats))).withColumn("_lo", F.greatest(F.lit(0), F.col("_q") - F.col("_d")))
    near = near.withColumn("_open", F.col(seats) - F.sum("_lo").over(w))
    tried = near.withColumn("_k", F.explode(F.sequence(F.col("_lo"), F.col("_q") + F.col("_d"))))
    best = Window.partitionBy(*group).orderBy((F.col(vote) / (2 * F.col("_k") + 1)).desc(), *key)
    won = tried.withColumn("_won", (F.row_number().over(best) <= F.col("_open")) & (F.col(vote) > 0))
    return (
        won.groupBy(*votes.columns, "_lo").agg(F.count_if("_won").alias("_more"))
        .withColumn("quota", F.col("_lo") + F.col("_more")).drop("_lo", "_more")
    )


def _cell() -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), F.lit(":"), F.col("shard").cast("string"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, seed: int = 7, cap: int = CAP, keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns in keep) with a struct column _m: size, source_size, target, taken (words, repeats counted).

    Documents without a word have size and taken 0; sources that only have such documents have target 0, as has a table
    without any word. No document is taken more than cap times its size. Rows with equal ids are laid out by their text,
    and fully equal rows are interchangeable. Equal input gives equal output, in whatever order or partitions it comes.
    """
    keep = passing(docs.columns if keep is None else keep, ["_m"])
    laid = _laid(docs, id_col, text_col, source_col, weights, block, seed, cap, keep)
    return laid.select("r.*", F.struct("size", "source_size", "target", "taken").alias("_m"))


def _laid(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], block: int, seed: int, cap: int, keep: list[str], shard_words: int = SHARD_WORDS
) -> DataFrame:
    """r (the columns that stay), source, shard, cell (both as one text), place, tie, size, source_size, target, taken of every document."""
    # Id and text together, as one id may have many rows.
    sized = docs.select(
        row_of(keep), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("place"), F.xxhash64(F.col(text_col)).alias("tie"),
    )
    light = written(sized.select("source", "size", "place"), "sizes")
    words = light.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    width = max(1, round(shards**0.5))  # shards in a group
    shard = F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(shards))
    cells = written(light.groupBy("source", shard.alias("shard")).agg(F.sum("size").alias("cell_size")), "cells")
    groups = cells.groupBy("source", F.expr(f"shard div {width}").alias("group")).agg(F.sum("cell_size").alias("group_size"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, cap)
    seats = sainte_lague(targets.withColumn("_seats", F.lit(round(words / block))), [], ["rank"], "target", "_seats")
    seats = seats.select("source", "source_size", "target", F.col("quota").alias("source_blocks"))
    of_source = lambda x, y: F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source"))
    parted = groups.alias("g").join(seats.alias("s"), of_source("g", "s")).select("g.source", "group", "group_size", "source_size", "target", "source_blocks")
    parted = sainte_lague(parted, ["source"], ["group"], "group_size", "source_blocks").withColumnRenamed("quota", "group_blocks")
    parted = parted.select("source", "group", "source_size", "target", "group_blocks")
    every = cells.withColumn("group", F.expr(f"shard div {width}"))
    quotas = sainte_lague(
        every.alias("c").join(parted.alias("p"), of_source("c", "p") & (F.col("c.group") == F.col("p.group")))
        .select("c.source", "c.group", "shard", "cell_size", "source_size", "target", "group_blocks"),
        ["source", "group"], ["shard"], "cell_size", "group_blocks",
    )
    n = F.ceil(F.col("cell_size") / block)
    plan = quotas.withColumn("n", n).withColumn("quota", F.least("quota", cap * F.col("n"))).select(
        _cell().alias("cell"), "source_size", F.col("target").cast("double").alias("target"), "n",
        F.when(F.col("n") > 0, F.expr("quota div n")).otherwise(0).alias("every"),
        F.when(F.col("n") > 0, F.pmod("quota", "n")).otherwise(0).alias("more"),
        F.when(F.col("n") > 0, F.pmod(F.xxhash64("source", "shard", F.lit(seed + 1)), "n")).otherwise(0).alias("start"),
    )
    # One key, never null, for windows and join alike: rows move to their cell once.
    laid = sized.withColumn("shard", shard).withColumn("cell", _cell()).withColumn(
        "end", F.sum("size").over(Window.partitionBy("cell").orderBy("place", "tie", "size").rowsBetween(Window.unboundedPreceding, 0))
    )
    both = laid.join(plan, "cell")

    def chosen(j: str) -> str:
        """Chosen blocks before block j, in whole numbers."""
        return f"CASE WHEN n > 0 THEN ({j} * more + start) div n ELSE 0 END"

    def words_before(p: str) -> Column:
        j = f"(({p}) div {block})"
        return F.expr(f"{chosen(j)} * {block} + ({chosen(f'({j} + 1)')} - {chosen(j)}) * (({p}) - {j} * {block})")

    taken = F.col("every") * F.col("size") + words_before("end") - words_before("end - size")
    return both.select("r", "source", "shard", "cell", "place", "tie", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, seed: int = 7, cap: int = CAP,
) -> DataFrame:
    """The mix as whole documents, all their columns: each row taken / size times, rounded up or down.

    Parts of copies add up along a shard's documents in order of size, from a seeded start, and whenever a whole is full
    the document there gets one more copy. So what rounding moves stays within a shard and between documents of
    neighbouring sizes: a shard's words differ from its quota by less than its largest document. Documents without a
    word have no copy. Equal input gives equal output.
    """
    laid = _laid(docs, id_col, text_col, source_col, weights, block, seed, cap, docs.columns)
    part = F.when(F.col("size") > 0, F.expr(f"(taken % size) * {_PARTS} div size")).otherwise(0)
    start = F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), F.lit(_PARTS))
    by_size = Window.partitionBy("cell").orderBy("size", "place", "tie").rowsBetween(Window.unboundedPreceding, 0)
    upto = laid.withColumn("part", part).withColumn("upto", start + F.sum("part").over(by_size))
    copies = F.when(F.col("size") > 0, F.expr(f"taken div size + upto div {_PARTS} - (upto - part) div {_PARTS}")).otherwise(0)
    return upto.select("r", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("r.*")
