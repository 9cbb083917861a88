"""Running values over long keys in two levels: within chunks, and carried from chunk to chunk by a small table.

A window over all rows of a key puts the key into one task. Here a task holds one chunk of it (a day, a range of ids),
and only one row per key and chunk goes through the window that carries values on. Frames of a number of rows have blocks
of numbered rows instead, each with a halo: the rows before and after it that its frames reach, sent along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FOLDS = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, lambda a, b: F.greatest(a, b))}


def previous(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], cols: list[str], name: str = "prev") -> DataFrame:
    """rows with a struct ``name`` of cols in the key's row before; null in its first. chunk must not fall along the order."""
    rows = rows.withColumn("_chunk", chunk)
    held = F.struct(*cols)
    inside = rows.withColumn(name, F.lag(held).over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
    ends = rows.groupBy(*keys, "_chunk").agg(F.max_by(held, F.struct(*order)).alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_end")
    return inside.join(before, [*keys, "_chunk"]).withColumn(name, F.coalesce(name, "_before")).drop("_chunk", "_before")


def running(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], value: Column, fold: str, name: str, current: bool = True, parts: int | None = None) -> DataFrame:
    """rows with ``name``: the sum or maximum of value over the key's rows so far, with the current one or without it. Chunks are
    dealt to ``parts`` tasks if that is given."""
    agg, both = _FOLDS[fold]
    rows = rows.withColumn("_chunk", chunk).withColumn("_value", value)
    frame = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    per = rows.groupBy(*keys, "_chunk").agg(agg("_value").alias("_total"))
    upto = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumn("_before", agg("_total").over(upto)).drop("_total")
    dealt = rows.repartition(parts, *keys, "_chunk") if parts else rows
    inside = dealt.withColumn("_inside", agg("_value").over(frame)).join(before, [*keys, "_chunk"])
    total = F.when(F.col("_before").isNull(), F.col("_inside")).when(F.col("_inside").isNull(), F.col("_before")).otherwise(both(F.col("_inside"), F.col("_before")))
    return inside.withColumn(name, total).drop("_chunk", "_value", "_inside", "_before")


#: Rows of a block; no frame may reach further than that.
BLOCK = 4096
_BLOCK, _HALO = "_block", "_halo"


def numbered(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], name: str = "i") -> DataFrame:
    """rows with their number within the key from 0, counted by chunk and carried over chunks."""
    return running(rows, keys, chunk, order, F.lit(1), "sum", name).withColumn(name, (F.col(name) - 1).cast("long"))


def haloed(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], before: int, after: int = 0, size: int = BLOCK, number: str = "_i") -> DataFrame:
    """rows with their number and their block of ``size`` rows of the key, and copies for the blocks whose frames reach them.

    A frame of up to ``before`` rows before a row and ``after`` rows behind it lies wholly within block_window(). inside()
    takes the copies away again.
    """
    if max(before, after) > size:
        raise ValueError("a frame may not reach further than a block")
    block, at = F.expr(f"{number} div {size}"), F.pmod(number, F.lit(size))
    place = lambda b, halo: F.struct(b.alias(_BLOCK), F.lit(halo).alias(_HALO))
    places = [place(block, False)]
    if before:
        places.append(F.when(at >= size - before, place(block + 1, True)))
    if after:
        places.append(F.when((at < after) & (block > 0), place(block - 1, True)))
    made = numbered(rows, keys, chunk, order, number)
    return made.withColumn("_place", F.explode(F.array_compact(F.array(*places)))).select("*", f"_place.{_BLOCK}", f"_place.{_HALO}").drop("_place")


def block_window(keys: list[str], order: list[str]):
    """The window of haloed rows."""
    return Window.partitionBy(*keys, _BLOCK).orderBy(*order)


def inside(rows: DataFrame, number: str = "_i") -> DataFrame:
    """Haloed rows without the copies, block and number."""
    return rows.filter(f"NOT {_HALO}").drop(_BLOCK, _HALO, number)
