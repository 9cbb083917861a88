"""Sets of id intervals (symbol, lo, hi; both ends included): what has been captured, what is missing, what a replay repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import previous, running

#: Ids of a chunk: windows hold a chunk's rows.
CHUNK = 100_000


def covered(rows: DataFrame, id_col: str = "id", key: str = "symbol") -> DataFrame:
    """The intervals of the ids in rows, repeats counted once: runs within chunks of ids, which merged() joins across."""
    ids = rows.select(F.col(key).alias(key), F.col(id_col).alias("id")).distinct()
    seen = previous(ids, [key], F.expr(f"id div {CHUNK}"), ["id"], ["id"], "_prev")
    begins = F.when(F.col("_prev.id") == F.col("id") - 1, 0).otherwise(1)
    runs = running(seen.select(key, "id", begins.alias("_begins")), [key], F.expr(f"id div {CHUNK}"), ["id"], F.col("_begins"), "sum", "_run")
    return runs.groupBy(key, "_run").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).drop("_run")


def merged(*sets: DataFrame, key: str = "symbol") -> DataFrame:
    """The union of interval sets: intervals that overlap or touch become one."""
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    chunk, order = F.expr(f"lo div {CHUNK}"), ["lo", "hi"]
    seen = running(every.distinct(), [key], chunk, order, F.col("hi"), "max", "_reach", current=False)
    begins = F.when(F.col("lo") <= F.col("_reach") + 1, 0).otherwise(1)
    runs = running(seen.withColumn("_begins", begins), [key], chunk, order, F.col("_begins"), "sum", "_run")
    return runs.groupBy(key, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def gaps(intervals: DataFrame, hole: int = 50_000, key: str = "symbol") -> DataFrame:
    """What lies between the intervals of a merged set: key, lo, hi, missing, is_hole (wider than the limit)."""
    seen = previous(intervals, [key], F.expr(f"lo div {CHUNK}"), ["lo"], ["hi"], "_prev").filter("_prev IS NOT NULL")
    missing = F.col("lo") - F.col("_prev.hi") - 1
    return seen.select(key, (F.col("_prev.hi") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"), missing.alias("missing"), (missing > hole).alias("is_hole"))


def _chunked(intervals: DataFrame, id_col: str, key: str) -> DataFrame:
    """A row for every chunk that an interval reaches into."""
    chunks = F.sequence(F.expr(f"lo div {CHUNK}"), F.expr(f"hi div {CHUNK}"))
    return intervals.select(F.col(key).alias(key), F.col("lo").alias(id_col), F.col("hi").alias("_hi"), F.explode(chunks).alias("_chunk"), F.lit(False).alias("_row"))


def _covering(rows: DataFrame, intervals: DataFrame, id_col: str, key: str) -> DataFrame:
    """rows with ``_in``: whether an interval of their key holds their id. Rows and intervals of a chunk are sorted together,
    and a row looks at the furthest end of the intervals that begin at it or before, so none meets them one by one."""
    held = rows.withColumns({"_hi": F.lit(None).cast("long"), "_chunk": F.expr(f"`{id_col}` div {CHUNK}"), "_row": F.lit(True)})
    both = held.unionByName(_chunked(intervals, id_col, key), allowMissingColumns=True)
    before = Window.partitionBy(key, "_chunk").orderBy(id_col, "_row").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.max("_hi").over(before) >= F.col(id_col)
    return both.withColumn("_in", F.coalesce(reached, F.lit(False))).filter("_row").drop("_hi", "_chunk", "_row")


def within(rows: DataFrame, intervals: DataFrame, id_col: str = "id", key: str = "symbol") -> DataFrame:
    """rows whose id lies in an interval of their key."""
    return _covering(rows, intervals, id_col, key).filter("_in").drop("_in")


def without(rows: DataFrame, intervals: DataFrame, id_col: str = "id", key: str = "symbol") -> DataFrame:
    """rows whose id lies in no interval of their key."""
    return _covering(rows, intervals, id_col, key).filter("NOT _in").drop("_in")
